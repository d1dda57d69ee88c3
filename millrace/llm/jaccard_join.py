"""N-gram Jaccard join: a blocked sparse product of document by n-gram incidence with size-derived bounds.

1. Equal sets are one class; from here on a class is one row of the matrix.
2. Every n-gram of every class goes, packed, to a bucket that tells which occur in other classes.  A class can only
   have a partner if at least 70 % of its n-grams do; the others are done.
3. The rest keep the n-grams that others of the rest share, rarest first.  Two sets that are similar share one of
   the first n - ceil(0.7 n) + 1, counting those that nobody shares; a star over each such n-gram links candidates.
4. Rows that the stars connect are multiplied block by block: overlap counts accumulate over runs of n-grams, and a
   pair goes as soon as what is left can't bring it to the bound that both sizes demand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common as C
from millrace.llm.components import ONE_TASK, Forest, components
from millrace.llm.wordhash import Hashes, grams, groups, hashed

#: Similar: PERCENT * union <= 100 * intersection.
GRAM, PERCENT = 3, 70
#: Words of a chunk whose n-grams are counted before they travel; rows and n-grams of a block of the matrix.
CHUNK_WORDS, BLOCK_ROWS, BLOCK_GRAMS = 1_000_000, 1024, 400_000
#: N-grams in a run of the product, and the rows up to which an n-gram's pairs are counted one by one.
RUN, FEW_ROWS = 4096, 48


def shingle_sets(column: pa.Array, hashes: Hashes, gram: int = GRAM) -> list[np.ndarray]:
    """The sorted set of each text's n-grams as 64-bit hashes; fewer words than n are one shingle."""
    h, sizes = hashed(column, hashes, True)
    ends = np.cumsum(sizes)
    g = grams(h, gram)
    out = []
    for a, z in zip((ends - sizes).tolist(), ends.tolist()):
        if z - a >= gram:
            out.append(np.unique(g[a : z - gram + 1]))
        else:
            out.append(grams(h[a:z], z - a) ^ np.uint64(z - a) if z > a else np.zeros(0, np.uint64))
    return out


def need(n: int | np.ndarray, percent: int = PERCENT):
    """The least overlap of a set of n with any that is similar: the other one has at least as many."""
    return -(-n * percent // 100)


def product(sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs (i, j) with i in left, j in right, i <> j, each once: the blocked sparse product.

    Left and right are the same rows or have none in common.
    """
    own = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(own, kind="stable")
    own, row = own[order], row[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(own)])
    keep = np.repeat(count > 1, count)
    gram = np.repeat(np.arange(len(first)), count)[keep]
    row = row[keep]
    remains = np.bincount(row, minlength=len(sets))
    # A row that others of the block share r n-grams with has partners of at most r * (100 + p) / p - n: two rows of which
    # each only takes smaller ones don't pair.  Most blocks of rows that just share passages end here.
    strong = remains * (100 + percent) >= 2 * percent * sizes
    if not strong[left].any() and not strong[right].any():
        return left[:0], right[:0]
    same, weak = left is right, left[~strong[left]]
    found = [_pairs(sizes, len(sets), gram, row, remains, left[strong[left]], right, percent)]
    if len(weak):
        found.append(_pairs(sizes, len(sets), gram, row, remains, weak, right[strong[right]], percent) if not same else (left[:0], right[:0]))
    i, j = (np.concatenate(x) for x in zip(*found))
    if same:  # strong rows met all rows: a pair of them twice
        i, j = np.minimum(i, j), np.maximum(i, j)
        at = np.unique(i * len(sets) + j)
        i, j = at // len(sets), at % len(sets)
    return i, j


def _pairs(sizes: np.ndarray, rows: int, gram: np.ndarray, row: np.ndarray, remains: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs of left and right rows, from the (gram, row) incidence of n-grams that several rows have."""
    if not len(left) or not len(right):
        return left[:0], right[:0]
    kind = np.int32 if sizes.max() < 5_000_000 else np.int64
    remains = remains.astype(kind)
    a, b = sizes[left].astype(kind)[:, None], sizes[right].astype(kind)[None, :]
    # 100 o >= p (a + b - o)
    wanted = (percent * (a + b) + kind(99 + percent)) // kind(100 + percent)
    alive = (100 * a >= percent * b) & (100 * b >= percent * a) & (left[:, None] != right[None, :])  # bounds of the sizes alone
    alive &= np.minimum(remains[left][:, None], remains[right][None, :]) >= wanted
    if not alive.any():
        return left[:0], right[:0]
    gram = np.unique(gram, return_inverse=True)[1] if len(gram) else gram
    total = int(gram.max()) + 1 if len(gram) else 0
    overlap = np.zeros(alive.shape, np.int32)
    at_left, at_right = np.full(rows, -1), np.full(rows, -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    # By runs of n-grams, the rare ones first: those of few rows add up pair by pair, the others as a dense slab.
    each = np.bincount(gram, minlength=total)
    rank = np.argsort(each, kind="stable")
    place = np.empty(total, np.int64)
    place[rank] = np.arange(total)
    order = np.argsort(place[gram], kind="stable")
    gram, row, each = place[gram][order], row[order], each[rank]
    starts = np.cumsum(each) - each
    start = 0
    while start < total:
        stop = min(total, start + RUN)
        if each[start] <= FEW_ROWS:
            stop = min(stop, int(np.searchsorted(each, FEW_ROWS, "right")))
        a, z = int(starts[start]), int(starts[stop - 1] + each[stop - 1])
        g, r = gram[a:z] - start, row[a:z]
        if each[start] <= FEW_ROWS:
            size = each[start:stop][g]
            i = np.repeat(np.arange(len(g)), size)
            j = (starts[start:stop][g] - a)[i] + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
            x, y = at_left[r[i]], at_right[r[j]]
            both = (x >= 0) & (y >= 0)
            overlap += np.bincount(x[both] * len(right) + y[both], minlength=overlap.size).reshape(overlap.shape).astype(np.int32)
        else:
            x, y = at_left[r], at_right[r]
            m = np.zeros((len(left), stop - start), np.float32)
            m[x[x >= 0], g[x >= 0]] = 1
            w = np.zeros((len(right), m.shape[1]), np.float32)
            w[y[y >= 0], g[y >= 0]] = 1
            i, j = np.flatnonzero(alive.any(1) & m.any(1)), np.flatnonzero(alive.any(0) & w.any(1))
            if len(i) and len(j):
                overlap[np.ix_(i, j)] += (m[i] @ w[j].T).astype(np.int32)
        remains -= np.bincount(r, minlength=rows).astype(kind)
        alive &= overlap + np.minimum(remains[left][:, None], remains[right][None, :]) >= wanted
        if not alive.any():
            break
        start = stop
    i, j = np.nonzero(alive & (overlap >= wanted))
    return left[i], right[j]


def _rows(docs: DataFrame, id_col: str, text_col: str, gram: int, carry: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, set_key, n, and with carry the columns of docs), written; and texts (row, text).

    To carry columns rows are numbered as they are written.  Else a row's number is a hash of its id and text, so that
    texts needn't be written: only rows that repeat both share one.
    """
    own, at, types = C.carried(docs, text_col, carry)
    own = own if carry else [F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__c0")]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *own)
    slim = slim.select("doc_id", F.lit(0).cast("long").alias("row") if carry else F.xxhash64("doc_id", "__c0").alias("row"), *types.fieldNames())

    def keys(it):
        hashes = Hashes()
        row = TaskContext.get().partitionId() << 40
        for b in C.batches(it):
            sets = shingle_sets(b.column(2 + at), hashes, gram)
            key = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets], pa.binary())
            passed = b.columns[2:] if carry else []
            new = [b.column(0), pa.array(row + np.arange(len(sets))) if carry else b.column(1), key, pa.array([len(s) for s in sets], pa.int64())]
            row += len(sets)
            yield pa.RecordBatch.from_arrays([*passed, *new], [*(types.fieldNames() if carry else []), "doc_id", "row", "set_key", "n"])

    rows = C.materialize(slim.mapInArrow(keys, C.fields(types if carry else T.StructType(), "doc_id long, row long, set_key binary, n long")), "join-rows")
    return rows, (rows.where("n > 0") if carry else slim).select("row", F.col(f"__c{at}").alias("text"))


def _classes(rows: DataFrame) -> DataFrame:
    """(set_key, row, n, members, first, cid): a row for each set, of which the first row has the least id."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    classes = rows.where("n > 0").groupBy("set_key").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.count("*").alias("members"), F.min(first).alias("first"))
    return C.materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "join-classes")


def _survivors(texts: DataFrame, gram: int, percent: int, buckets: int) -> DataFrame:
    """(key): the first 8 bytes of the set keys of classes with enough n-grams that other classes have."""

    def send(it):
        schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("singles", pa.binary()), ("many", pa.binary())])
        hashes = Hashes()
        sets: dict[int, np.ndarray] = {}
        held = 0

        def out():
            keys = np.array(list(sets), np.int64)
            own = np.concatenate([*sets.values(), np.zeros(0, np.uint64)])
            row = np.repeat(np.arange(len(keys)), [len(s) for s in sets.values()])
            order = np.argsort(own, kind="stable")
            own, row = own[order], row[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(own)])
            several = np.repeat(count > 1, count)
            # What the chunk has twice is known to be shared; the bucket only needs it once, for other chunks.
            local = np.bincount(row[several], minlength=len(keys))
            ns = np.array([len(s) for s in sets.values()], np.int64)
            yield C.table(schema, np.full(len(keys), -1, np.int32), keys, ns, local, [b""] * len(keys), [b""] * len(keys))
            many, single, whose = own[first][count > 1], own[~several], row[~several]
            of = lambda g: ((g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            bs, bm = of(single), of(many)
            pick = np.lexsort((whose, bs))
            single, whose, bs = single[pick], whose[pick], bs[pick]
            for b in range(buckets):
                a, z = np.searchsorted(bs, [b, b + 1])
                ma, mz = np.searchsorted(bm, [b, b + 1])
                if a == z and ma == mz:
                    continue
                who, each = np.unique(whose[a:z], return_counts=True)
                blob = b"".join((np.array([len(who)], "<i8").tobytes(), keys[who].tobytes(), each.astype("<u4").tobytes(), _five(single[a:z])))
                yield C.table(schema, [b], [0], [0], [0], [blob], [_five(many[ma:mz])])
            sets.clear()

        for b in C.batches(it):
            for s in shingle_sets(b.column(0), hashes, gram):
                if len(s):
                    key = int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True)
                    held += len(s) if key not in sets else 0
                    sets[key] = s
                if held > CHUNK_WORDS:
                    yield from out()
                    held = 0
        if sets:
            yield from out()

    def answer(it):
        schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("shared", pa.int64())])
        for t in groups(it, 1):
            if t.column(0)[0].as_py() < 0:
                for b in t.select(["key", "n", "shared"]).to_batches():
                    yield C.table(schema, *b.columns)
                continue
            keys, own, several = [], [], []
            for blob, many in zip(t.column(4).to_pylist(), t.column(5).to_pylist()):
                k = int(np.frombuffer(blob, "<i8", 1)[0])
                each = np.frombuffer(blob, "<u4", k, 8 + 8 * k)
                keys.append(np.repeat(np.frombuffer(blob, "<i8", k, 8), each))
                own.append(_unfive(blob[8 + 12 * k :]))
                several.append(_unfive(many))
            key, g, known = np.concatenate(keys), np.concatenate(own), np.unique(np.concatenate(several))
            order = np.argsort(g, kind="stable")
            key, g = key[order], g[order]
            if not len(g):
                continue
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            apart = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)
            apart |= np.isin(g[first], known)
            hit = key[np.repeat(apart, np.diff(np.r_[first, len(g)]))]
            who, count = np.unique(hit, return_counts=True)
            yield C.table(schema, who, np.zeros(len(who), np.int64), count)

    sent = texts.mapInArrow(send, "bucket int, key long, n long, shared long, singles binary, many binary")
    # Rows of bucket -1 tell a class's size and what its chunk shares; they spread by their key.
    placed = sent.repartition(buckets, F.when(F.col("bucket") < 0, F.col("key")).otherwise(F.col("bucket").cast("long"))).sortWithinPartitions("bucket")
    told = placed.mapInArrow(answer, "key long, n long, shared long")
    # A class in several chunks tells its size each time; what any of them found shared counts for all.
    return told.groupBy("key").agg(F.max("n").alias("n"), F.sum("shared").alias("shared")).where(F.col("shared") * 100 >= F.col("n") * percent).select("key")


def _five(g: np.ndarray) -> bytes:
    """The low 40 bits of each hash; the bucket has the high ones."""
    return g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT, bound: int = C.BROADCAST_BYTES, one_task: int = ONE_TASK, block_rows: int = BLOCK_ROWS, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, n_similar, component_id, class_size.

    A set is the distinct ``gram``-word shingles, A-Z lower-cased; rows link when 100 * intersection >= percent *
    union.  n_similar counts the other rows linked directly, copies included; component_id is the least id that
    links reach.  Null, empty and white texts have no shingles and link with nothing; repeated rows are copies of
    each other; a null id is linked like any other, but is a component's id only if it has no other; an empty table
    gives no rows; other columns are ignored.  With ``carry`` the result is the columns of docs, whatever their names,
    then _first: true for one row of each component, of those with its least id, and for rows without shingles.
    Shingles are told apart by 64-bit hashes, sets by 128-bit ones.
    """
    n = C.parts(docs.sparkSession)
    rows, every = _rows(docs, id_col, text_col, gram, carry)
    classes = _classes(rows)
    alive = _survivors(every.select("text"), gram, percent, n)
    left = C.materialize(classes.withColumn("key", _signed_head("set_key")).join(alive, "key", "left_semi").select("row", "cid", "members"), "join-left")
    texts = every.join(C.checked(left, 24, bound), "row")

    def sets_of(it):
        schema = pa.schema([("cid", pa.int64()), ("members", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])
        hashes = Hashes()
        for b in C.batches(it):
            sets = shingle_sets(b.column(0), hashes, gram)
            yield C.table(schema, b.column(1), b.column(2), [len(s) for s in sets], [s.tobytes() for s in sets])

    sets = C.materialize(texts.select("text", "cid", "members").mapInArrow(sets_of, "cid long, members long, n long, grams binary"), "join-sets")
    if sets.count() > left.count():  # rows that repeat id and text stand for one class each
        sets = C.materialize(sets.dropDuplicates(["cid"]), "join-sets")

    def incidence(it):
        schema = pa.schema([("g", pa.int64()), ("cid", pa.int64()), ("n", pa.int64())])
        for b in C.batches(it, 256):
            own = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            each = [len(s) for s in own]
            yield C.table(schema, np.concatenate(own), np.repeat(b.column(0).to_numpy(), each), np.repeat(b.column(1).to_numpy(), each))

    inc = sets.select("cid", "n", "grams").mapInArrow(incidence, "g long, cid long, n long")
    df = inc.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    have = inc.join(df, "g").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("gs"))
    lone = F.col("n") - F.size("gs")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - lone
    stars = C.materialize(have.where(prefix > 0).select("cid", F.explode(F.slice("gs", F.lit(1), prefix.cast("int"))).alias("s")).select("cid", F.col("s.g").alias("g")), "join-prefixes")
    centre = stars.groupBy("g").agg(F.min("cid").alias("b"), F.count("*").alias("k")).where("k > 1").select("g", "b")
    edges = stars.join(centre, "g").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
    roots = components(edges, one_task)
    grouped = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "cid")

    # Blocks: by size class, a power of 1/0.7, then spread by a hash.  Only equal and adjacent classes can be similar.
    ratio = float(np.log(100 / percent))
    tier = F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int")
    placed = sets.join(grouped, "cid").withColumn("tier", tier)
    tiers = C.materialize(placed.groupBy("root", "tier").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("k")), "join-tiers")
    up = tiers.select("root", (F.col("tier") - 1).alias("tier"), F.col("k").alias("k_up"))
    down = tiers.select("root", (F.col("tier") + 1).alias("tier"), F.col("k").alias("k_down"))
    plan = C.materialize(tiers.join(up, ["root", "tier"], "left").join(down, ["root", "tier"], "left").na.fill(0, ["k_up", "k_down"]), "join-plan")
    mine = F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")
    rng = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.concat(
        F.transform(rng(F.col("k")), lambda o: F.struct(F.col("tier").alias("t"), F.lit(0).alias("up"), F.least(F.col("mine"), o).alias("x"), F.greatest(F.col("mine"), o).alias("y"), (F.col("mine") > o).alias("right"))),
        F.transform(rng(F.col("k_up")), lambda o: F.struct(F.col("tier").alias("t"), F.lit(1).alias("up"), F.col("mine").alias("x"), o.alias("y"), F.lit(False).alias("right"))),
        F.transform(rng(F.col("k_down")), lambda o: F.struct((F.col("tier") - 1).alias("t"), F.lit(1).alias("up"), o.alias("x"), F.col("mine").alias("y"), F.lit(True).alias("right"))),
    )
    work = placed.join(plan, ["root", "tier"]).withColumn("mine", mine).select("root", F.explode(pairs).alias("p"), "cid", "members", "grams").select("root", (F.col("p.t") * 2 + F.col("p.up")).alias("step"), "p.x", "p.y", "p.right", "cid", "members", "grams")

    def multiply(it):
        schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
        outs: list[tuple] = []
        for t in groups(it, 4):
            step, x, y = (t.column(c)[0].as_py() for c in (1, 2, 3))
            cids, at = np.unique(t.column(5).to_numpy(), return_index=True)
            if len(cids) < 2:
                continue
            own = [np.frombuffer(g, np.uint64) for g in t.column(7).take(pa.array(at)).to_pylist()]
            members = t.column(6).to_numpy()[at]
            sizes = np.array([len(s) for s in own], np.int64)
            on_right = t.column(4).to_numpy(zero_copy_only=False)[at].astype(bool)
            if step % 2 == 0 and x == y:
                l = r = np.arange(len(cids))
            else:
                l, r = np.flatnonzero(~on_right), np.flatnonzero(on_right)
            if not len(l) or not len(r):
                continue
            i, j = product(sizes, own, l, r, percent)
            linked = np.bincount(i, members[j], len(cids)) + np.bincount(j, members[i], len(cids))
            outs += [(0, int(c), int(w)) for c, w in zip(cids, linked) if w]
            f = Forest()
            outs += [(1, int(cids[max(p, q)]), int(cids[min(p, q)])) for p, q in zip(i.tolist(), j.tolist()) if f.join(p, q)]
            if len(outs) > 50_000:
                yield C.table(schema, *map(list, zip(*outs)))
                outs = []
        if outs:
            yield C.table(schema, *map(list, zip(*outs)))

    found = C.materialize(work.repartition(n, "root", "step", "x", "y").sortWithinPartitions("root", "step", "x", "y").mapInArrow(multiply, "kind int, a long, b long"), "join-links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    final = components(found.where("kind = 1").select("a", "b"), one_task)
    known = classes.join(links, "cid", "left").join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = C.materialize(known.select("set_key", "first", "members", F.coalesce("links", F.lit(0)).alias("links"), "root"), "join-known")
    firsts = known.groupBy("root").agg(F.min("first").alias("first"))
    if carry:
        stay = firsts.select(F.col("first.row").alias("row")).union(rows.where("n = 0").select("row")).withColumn("_first", F.lit(True))
        return rows.join(stay, "row", "left").select(*C.restored(docs), F.coalesce("_first", F.lit(False)).alias("_first"))
    ids = firsts.select("root", F.col("first.doc_id").alias("component_id"))
    by_set = C.materialize(known.join(ids, "root").select("set_key", "members", "links", "component_id"), "join-sets-known")
    return C.join_groups(rows.select("doc_id", "n", "set_key"), by_set, ["set_key"], "members", 48, bound).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.col("links") + F.col("members") - 1, F.lit(0)).cast("long").alias("n_similar"),
        F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("members", F.lit(1)).cast("long").alias("class_size"),
    )


def _signed_head(column: str):
    """The first 8 bytes of a binary column as a little-endian signed long."""
    h = F.hex(F.substring(F.col(column), 1, 8))
    swapped = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)])
    return F.conv(swapped, 16, -10).cast("long")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 2), ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 70 * (x.n + y.n - o)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.k, 0)::BIGINT AS n_similar, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id, coalesce(c.c, 1)::BIGINT AS class_size
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) k ON k.a = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN (SELECT a, 1 + count(*) AS c FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o = x.n AND o = y.n GROUP BY a) c ON c.a = d.doc_id
"""
