"""Exact dedup: counting quotient filters per partition, merged by quotient range, then byte verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

FINGERPRINT_BITS = 64
#: Rows of one filter, and of one bucket where filters merge.
FILTER_ROWS, BUCKET_ROWS = 2_000_000, 2_000_000
#: Bits of the Bloom filter, as a power of two, at most (32 MB), and of a page of it.
BLOOM_BITS, PAGE_BITS = 28, 16


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints: a run of sorted remainders for each occupied quotient, with counters.

    The quotient is the high ``q`` bits.  ``occupied`` has the occupied quotients, ``ends`` where each one's run
    of ``remainders`` ends, ``counts`` a counter for each remainder.  Merging interleaves sorted runs and adds
    counters, so nothing is lost and the order of merges doesn't matter.
    """

    __slots__ = ("counts", "ends", "occupied", "q", "remainders")

    def __init__(self, q: int, occupied: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.occupied, self.ends, self.remainders, self.counts = q, occupied, ends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, q: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        fp = fingerprints.astype(np.uint64)
        order = np.argsort(fp, kind="stable")
        fp = fp[order]
        each = np.ones(len(fp), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, np.int64)
        total = np.add.reduceat(each, first) if len(fp) else each
        fp = fp[first]
        low = np.uint64(FINGERPRINT_BITS - q)
        occupied, starts = np.unique(fp >> low, return_index=True)
        ends = np.r_[starts[1:], len(fp)] if len(fp) else starts
        return cls(q, occupied, ends.astype(np.int64), fp & np.uint64((1 << int(low)) - 1), total)

    def fingerprints(self) -> np.ndarray:
        runs = np.diff(np.r_[0, self.ends])
        return np.repeat(self.occupied << np.uint64(FINGERPRINT_BITS - self.q), runs) | self.remainders

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        every = (self, *others)
        return CountingQuotientFilter.build(
            np.concatenate([x.fingerprints() for x in every]), self.q, np.concatenate([x.counts for x in every])
        )

    def split(self, buckets: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """Parts by ranges of quotients, so that the same fingerprint of any partition gets to the same bucket."""
        owner = (self.occupied * np.uint64(buckets)) >> np.uint64(self.q)
        for b in np.unique(owner):
            lo, hi = np.searchsorted(owner, [b, b + np.uint64(1)])
            a, z = (self.ends[lo - 1] if lo else 0), self.ends[hi - 1]
            yield int(b), CountingQuotientFilter(
                self.q, self.occupied[lo:hi], self.ends[lo:hi] - a, self.remainders[a:z], self.counts[a:z]
            )

    def pack(self) -> bytes:
        small = self.counts.max(initial=0) < 256
        head = np.array([self.q, len(self.occupied), len(self.remainders), small], "<i8")
        return b"".join((
            head.tobytes(), self.occupied.astype("<u4").tobytes(), self.ends.astype("<i8").tobytes(),
            self.remainders.astype("<u8").tobytes(), self.counts.astype("u1" if small else "<i8").tobytes(),
        ))

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        q, n, m, small = (int(x) for x in np.frombuffer(data, "<i8", 4))
        at = 32
        occupied = np.frombuffer(data, "<u4", n, at).astype(np.uint64)
        ends = np.frombuffer(data, "<i8", n, at + 4 * n)
        at += 12 * n
        remainders = np.frombuffer(data, "<u8", m, at)
        counts = np.frombuffer(data, "u1" if small else "<i8", m, at + 8 * m).astype(np.int64)
        return cls(q, occupied, ends, remainders, counts)


def bloom_places(fingerprints: np.ndarray, bits: int) -> np.ndarray:
    """The places of each fingerprint in a Bloom filter of 2 ** bits bits, a row each."""
    x = fingerprints.view(np.uint64)
    low = np.uint64(64 - bits)
    return np.stack([(x * np.uint64(m)) >> low for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)])


def _bloom(again: DataFrame, most: int) -> np.ndarray:
    """A Bloom filter of fingerprints, of 16 bits each but never more than 2 ** most bits: its pages are made where the data is."""
    bits = min(most, max(PAGE_BITS, (16 * max(1, again.count()) - 1).bit_length()))

    def pages(it):
        schema = pa.schema([("page", pa.int64()), ("bits", pa.binary())])
        held: dict[int, np.ndarray] = {}
        for b in it:
            at = np.unique(bloom_places(b.column(0).to_numpy(), bits)).astype(np.int64)
            page = at >> PAGE_BITS
            cut = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
            for a, z in zip(cut, [*cut[1:], len(at)]):
                own = held.setdefault(int(page[a]), np.zeros(1 << PAGE_BITS, bool))
                own[at[a:z] & ((1 << PAGE_BITS) - 1)] = True
            if len(held) > 256:
                yield C.table(schema, list(held), [np.packbits(x).tobytes() for x in held.values()])
                held.clear()
        if held:
            yield C.table(schema, list(held), [np.packbits(x).tobytes() for x in held.values()])

    def joined(it):
        schema = pa.schema([("page", pa.int64()), ("bits", pa.binary())])
        held: dict[int, np.ndarray] = {}
        for b in it:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x, np.uint8)
                held[k] = held[k] | x if k in held else x
        if held:
            yield C.table(schema, list(held), [x.tobytes() for x in held.values()])

    out = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << PAGE_BITS - 3
    parts = C.parts(again.sparkSession)
    for r in again.mapInArrow(pages, "page long, bits binary").repartition(parts, "page").mapInArrow(joined, "page long, bits binary").toLocalIterator():
        out[r["page"] * size : (r["page"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = 20, bound: int = C.BROADCAST_BYTES, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, fingerprint.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays.  Null text counts
    as empty.  A null id never stays beside another id; if a group has null ids only, keep_id is null and its rows
    are kept.  Rows that repeat the id that stays are all marked kept.  An empty table gives no rows; other columns
    are ignored.  Fingerprints with a count of one need no look at any other text; the others' bytes are grouped as
    they are, so a collision of fingerprints can't join two texts.  A Bloom filter of bounded size, of the fingerprints
    counted more than once, keeps other texts from travelling; what it lets through by chance is sorted out by a join.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def digest(it):
        schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64()), ("text_sha256", pa.string())])
        for b in C.batches(it):
            norm = [x.lower() for x in C.texts(b.column(1))]
            fp = np.array([xxhash.xxh3_64_intdigest(x) for x in norm], np.uint64).view(np.int64)
            yield C.table(schema, b.column(0), fp, [hashlib.sha256(x).hexdigest() for x in norm])

    ids = C.materialize(slim.mapInArrow(digest, "doc_id long, fingerprint long, text_sha256 string"), "dedup-ids")
    buckets = max(C.parts(spark), -(-ids.count() // BUCKET_ROWS))

    def filters(it):
        """A filter for each partition, or for each FILTER_ROWS rows of a larger one, in parts for the buckets."""
        schema = pa.schema([("bucket", pa.int32()), ("filter", pa.binary())])
        held, size = [], 0

        def out():
            parts = [(k, part.pack()) for k, part in CountingQuotientFilter.build(np.concatenate(held), q).split(buckets)]
            return C.table(schema, *map(list, zip(*parts)))

        for b in it:
            held.append(b.column(0).to_numpy().view(np.uint64))
            size += b.num_rows
            if size > FILTER_ROWS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def merged(t: pa.Table) -> pa.Table:
        first, *rest = [CountingQuotientFilter.unpack(x) for x in t.column("filter").to_pylist()]
        f = first.merge(*rest)
        return pa.table({"fingerprint": f.fingerprints()[f.counts > 1].view(np.int64)})

    again = C.materialize(
        ids.select("fingerprint").mapInArrow(filters, "bucket int, filter binary")
        .groupBy("bucket").applyInArrow(merged, "fingerprint long"), "dedup-again",
    )
    shared = spark.sparkContext.broadcast(_bloom(again, bloom_bits))

    def suspects(it):
        schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64()), ("norm", pa.binary())])
        bloom = shared.value
        bits = len(bloom).bit_length() + 2
        for b in C.batches(it):
            norm = [x.lower() for x in C.texts(b.column(1))]
            fp = np.array([xxhash.xxh3_64_intdigest(x) for x in norm], np.uint64).view(np.int64)
            at = bloom_places(fp, bits)
            take = (bloom[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)
            if take.any():
                yield C.table(schema, b.column(0).filter(pa.array(take)), fp[take], [x for x, y in zip(norm, take) if y])

    routed = slim.mapInArrow(suspects, "doc_id long, fingerprint long, norm binary")
    groups = (
        routed.groupBy("fingerprint", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("fingerprint", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
        .join(again, "fingerprint", "left_semi")
    )
    groups = C.materialize(groups, "dedup-groups")
    return C.join_groups(ids, groups, ["fingerprint", "text_sha256"], "group_size", 128, bound).select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256", "fingerprint",
    )
