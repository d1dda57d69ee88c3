"""Postings of texts for a stored index: grouped where the texts are, sent packed, put in the order of terms."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of a bucket, which one task holds and writes, and of a slice, which one task groups at a time.
BUCKET, SLICE = 2_000_000, 2_000_000
#: Sampled tokens a bucket, from which the bounds between buckets come, and texts that are looked at for them, at least.
SAMPLED, TEXTS = 60, 20_000
COLUMNS = ["term", "doc_id", "field", "dl", "tf", "positions"]


def _ranked(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each value its place among the distinct ones in order, and those; null is one of them."""
    d = a.dictionary_encode("encode")
    order = pc.sort_indices(d.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[d.indices.to_numpy()], d.dictionary.take(order)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, pa.int32()))


def _stream(b: pa.RecordBatch) -> pa.Buffer:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, b.schema) as w:
        w.write_batch(b)
    return out.getvalue()


def _slices(b: pa.RecordBatch, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of about SLICE tokens, one row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, to
        at = to


def _cuts(docs: DataFrame, texts: int, words: int) -> list[tuple[str, int]]:
    """The least (term, hash of the document) of each bucket but the first.

    A term that fills several buckets is cut between documents.  Only the bounds come from a sample, of texts spread
    evenly and of their tokens: all texts are in the index.
    """
    buckets = -(-words // BUCKET)
    if buckets <= 1:
        return []
    looked = min(1.0, max(TEXTS, 8 * buckets) / texts)
    own = (docs.sample(looked, seed=7) if looked < 1 else docs).select("hash", F.explode("ts").alias("term"))
    seen = sorted(map(tuple, own.where(F.rand(7) < SAMPLED * buckets / (looked * words)).select("term", "hash").collect()))
    return sorted({seen[k * len(seen) // buckets] for k in range(1, buckets)}) if seen else []


def _packed(cuts: list[tuple[str, int]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    terms, hashes = [t for t, _ in cuts], np.array([h for _, h in cuts], np.int64)

    def run(it):
        for b in it:
            sizes = b.column("ts").value_lengths().to_numpy()
            for at, to in _slices(b, sizes):
                yield from one(b.slice(at, to - at), sizes[at:to].astype(np.int64))

    def one(b: pa.RecordBatch, sizes: np.ndarray):
        codes, words = _ranked(b.column("ts").flatten())
        if not len(codes):
            return
        rows = np.repeat(np.arange(b.num_rows), sizes)
        places = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = codes * b.num_rows + rows
        order = np.argsort(key, kind="stable")  # places stay in order
        key = key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        word, row = np.divmod(key[start], b.num_rows)
        names = words.to_pylist()
        low = np.array([bisect_left(terms, w) for w in names])
        high = np.array([bisect_right(terms, w) for w in names])
        bucket, hash_ = low[word], b.column("hash").to_numpy()
        for w in np.flatnonzero(low < high).tolist():
            own = slice(*np.searchsorted(word, [w, w + 1]))
            bucket[own] += np.searchsorted(hashes[low[w] : high[w]], hash_[row[own]], "right")
        by = np.argsort(bucket, kind="stable")
        lists = _lists(np.diff(np.r_[start, len(key)]), places[order]).take(pa.array(by))
        bucket, word, row = bucket[by], word[by], pa.array(row[by])
        posts = pa.RecordBatch.from_arrays([words.take(pa.array(word)), *(b.column(c).take(row) for c in ("doc_id", "field", "dl")), lists], ["term", "doc_id", "field", "dl", "positions"])
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        sent = [_stream(posts.slice(x, y - x)) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[edges[:-1]], pa.int32()), pa.array([x.size for x in sent], pa.int64()), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in sent], pa.binary())], ["bucket", "size", "posts"]
        )

    return run


def _ordered(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition is a bucket: its postings by term and document; of rows of one document and length there is one."""
    sent = [pa.ipc.open_stream(pa.decompress(p, size, "zstd")).read_all() for b in it for size, p in zip(b.column("size").to_pylist(), b.column("posts").to_pylist())]
    if not sent:
        return
    t = pa.concat_tables(sent)
    sent.clear()
    columns = {c: pa.chunked_array(t.column(c)).combine_chunks() for c in t.column_names}
    keys = [_ranked(columns[c])[0] for c in ("term", "doc_id", "field")] + [columns["dl"].to_numpy().astype(np.int64)]
    order = np.lexsort(keys[::-1])
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
    start, order = np.flatnonzero(new), pa.array(order)
    lists = columns.pop("positions").take(order)
    sizes, values = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
    if len(start) < len(new):
        values = values[np.lexsort((values, np.repeat(np.cumsum(new), sizes)))]
        sizes, order = np.add.reduceat(sizes, start), order.take(pa.array(start))
    columns = {c: a.take(order) for c, a in columns.items()} | {"tf": pa.array(sizes, pa.int64()), "positions": _lists(sizes, values)}
    out = pa.RecordBatch.from_arrays([columns[c] for c in COLUMNS], COLUMNS)
    for at in range(0, out.num_rows, 65_536):
        yield out.slice(at, 65_536)


def ordered(docs: DataFrame, stats: list, schema: T.StructType) -> DataFrame:
    """Postings of docs (doc_id, field, ts, dl) as in ``schema``, a partition for each range of terms, sorted in it.

    stats: (n, avgdl) of each field.  A task groups the tokens of its texts and sends each bucket one block of them,
    compressed; nothing is sorted by rows, so what moves is about what is written.
    """
    texts, words = sum(r["n"] for r in stats), round(sum(r["n"] * (r["avgdl"] or 0) for r in stats))
    docs = docs.select("doc_id", "field", "dl", F.xxhash64("doc_id").alias("hash"), "ts")
    cuts = _cuts(docs, texts, words)
    packed = docs.mapInArrow(_packed(cuts), "bucket int, size long, posts binary")
    return packed.repartitionById(len(cuts) + 1, F.col("bucket")).mapInArrow(_ordered, schema)
