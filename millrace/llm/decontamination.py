"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common as C

WINDOW = 10
#: Distinct windows of one block of the benchmark: bounds what is broadcast (about 100 bytes each).
BLOCK_WINDOWS = 100_000


class WuManber:
    """All occurrences of patterns of ``m`` words.

    A block is the last ``b`` words of the part of the text looked at (2, or 1 for one-word patterns).  ``shift``
    has for each block that occurs in a pattern how far its last place is from the pattern's end; any other block
    lets the search skip ``m - b + 1`` words.  At shift 0 ``buckets`` gives the patterns that end with the block
    and direct comparison of the words confirms.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list], m: int):
        self.m, self.b = m, min(2, m)
        self.most = m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for p, owners in patterns.items():
            for j in range(self.b, m + 1):
                key = p[j - self.b : j]
                self.shift[key] = min(self.shift.get(key, self.most), m - j)
            self.buckets.setdefault(p[m - self.b :], {})[p] = owners

    def search(self, words: list[bytes]):
        """Yields (start, owners) for each occurrence."""
        m, b, most, shift, buckets = self.m, self.b, self.most, self.shift.get, self.buckets
        at, n = m, len(words)
        while at <= n:
            block = (words[at - 2], words[at - 1]) if b == 2 else (words[at - 1],)
            skip = shift(block, most)
            if skip:
                at += skip
                continue
            owners = buckets[block].get(tuple(words[at - m : at]))
            if owners is not None:
                yield at - m, owners
            at += 1


def item_words(text: bytes) -> list[bytes]:
    return text.translate(C.ITEM_WORDS).split()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK_WINDOWS, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of letters and digits and non-ASCII characters, A-Z lower-cased.  Each ``window`` consecutive
    words of an item are a pattern; an item with fewer words, but not none, is one pattern.  A word of a document
    inside any occurrence is hit.  Null or empty texts and items have no words; an empty benchmark hits nothing;
    repeated items count once; items with a null id match but aren't counted or named; other columns are ignored.
    The benchmark is the query set: it goes over the documents in blocks of a bounded number of windows, so that
    what is broadcast is bounded however large it grows; the text is read once for each block.  With ``carry`` the
    result is the columns of docs, whatever their names, then _contaminated.
    """
    spark = docs.sparkSession

    def windows(it):
        schema = pa.schema([("item_id", pa.string()), ("pattern", pa.string())])
        for b in C.batches(it):
            ids, pats = [], []
            for i, x in zip(b.column(0).to_pylist(), C.texts(b.column(1))):
                w = item_words(x)
                for p in {b" ".join(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} if w else ():
                    ids.append(i)
                    pats.append(p.decode("utf-8", "replace"))
            yield C.table(schema, ids, pats)

    patterns = C.materialize(
        items.select(F.col(item_id).cast("string"), F.col(item_text)).mapInArrow(windows, "item_id string, pattern string")
        .groupBy("pattern").agg(F.collect_set("item_id").alias("items")), "leak-patterns",
    )
    blocks = max(1, -(-patterns.count() // block))
    own, at, types = C.carried(docs, text_col, carry)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *own)
    if blocks > 1:
        # Rows are numbered once and written: every block finds the same numbers.
        slim = C.materialize(slim.withColumn("row", F.monotonically_increasing_id()), "leak-docs")
    else:
        slim = slim.withColumn("row", F.lit(0).cast("long"))
    slim = slim.select("row", "doc_id", *types.fieldNames())
    passed = types if carry else T.StructType()

    def searched(part: int) -> DataFrame:
        few = patterns if blocks == 1 else patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == part)
        by: dict[int, dict] = {}
        for p, names in few.toLocalIterator():
            w = tuple(p.encode().split())
            by.setdefault(len(w), {})[w] = tuple(sorted(names))
        tables = spark.sparkContext.broadcast(by)
        made: list[WuManber] = []

        def search(it):
            if not made:
                made.extend(WuManber(p, m) for m, p in sorted(tables.value.items()))
            for b in C.batches(it):
                counts, spans, found = [], [], []
                for x in C.texts(b.column(2 + at)):
                    w = item_words(x)
                    hits = sorted((start, start + s.m, owners) for s in made for start, owners in s.search(w))
                    flat: list[int] = []
                    for a, z, _ in hits:
                        if flat and a <= flat[-1]:
                            flat[-1] = max(flat[-1], z)
                        else:
                            flat += [a, z]
                    counts.append(len(w))
                    spans.append(flat)
                    found.append(sorted({o for _, _, owners in hits for o in owners}))
                new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[2:][: len(passed)], b.column(0), b.column(1), *new], [*passed.fieldNames(), "row", "doc_id", "n_words", "spans", "items"])

        return slim.mapInArrow(search, C.fields(passed, "row long, doc_id long, n_words long, spans array<long>, items array<string>"))

    def digest(it):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
        for b in it:
            hit, ids, names = [], [], []
            for spans, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                covered = end = 0
                for a, z in sorted(zip(spans[::2], spans[1::2])):
                    covered += max(0, z - max(a, end))
                    end = max(end, z)
                hit.append(covered)
                own = sorted(set(found))
                ids.append(len(own))
                names.append(hashlib.sha256(",".join(own).encode()).hexdigest())
            yield C.table(schema, b.column(0), b.column(1), hit, ids, names, [x > 0 for x in hit])

    out = searched(0)
    if blocks > 1:
        # Only documents with hits carry arrays; numbers of rows keep repeated documents apart.
        every = C.materialize(out, "leak-rows")
        hits = every.where(F.size("spans") > 0).select("row", "spans", "items")
        for part in range(1, blocks):
            hits = hits.unionByName(C.materialize(searched(part).where(F.size("spans") > 0).select("row", "spans", "items"), "leak-hits"))
        hits = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
        out = every.drop("spans", "items").join(hits, "row", "left").select(*passed.fieldNames(), "doc_id", "n_words", none("spans", "array<long>"), none("items", "array<string>"))
    if carry:
        return out.select(*C.restored(docs), (F.size("spans") > 0).alias("_contaminated"))
    return out.select("doc_id", "n_words", "spans", "items").mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM iw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS p FROM ip),
lens AS (SELECT DISTINCT m FROM pat),
dp AS (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS s FROM dw, lens),
win AS (SELECT doc_id, s, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS p FROM dp),
hit AS (SELECT win.doc_id, win.s, win.m, pat.item_id FROM win JOIN pat ON win.p = pat.p AND win.m = pat.m),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS k FROM hit) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN own USING (doc_id)
"""
