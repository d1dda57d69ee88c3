"""Substring dedup: windows that share a minimiser travel as one packed string to its bucket, where sorting counts them.

1. Each window of 35 words has a minimiser, its least 8-word hash.  Places of minimisers are counted over all texts:
   two equal windows have theirs at two places, so windows whose minimiser has one place are unique and stay home.
2. Runs of consecutive windows with the same, repeated minimiser are packed as one string and go to its bucket;
   sorting the windows of a bucket compares their words and finds those that start at two places or more.
3. The spans of those windows go back to their documents.

A minimiser with very many places is hot: its windows travel singly, salted by their own hash, and equal ones of a
chunk travel once.  They meet in GROUPS groups first, of which each sends an equal window on once, so no bucket holds more
than a row per GROUPS chunks, or GROUPS rows, for any text however many copies it has.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm.wordhash import Hashes, grams, groups, hashed

WINDOW, GRAM = 35, 8
#: Texts whose words are told apart at once.
BATCH = 1024
#: Groups in which equal windows of hot minimisers meet before all do.
GROUPS = 64
#: Places of a minimiser beyond which its windows are salted by their own hash; words looked at together.
HOT, CHUNK_WORDS = 2000, 1_000_000


def each_hashes(column: pa.Array, hashes: Hashes) -> list[np.ndarray]:
    """The hashes of each text's words."""
    h, sizes = hashed(column, hashes, False)
    return np.split(h, np.cumsum(sizes)[:-1]) if len(sizes) else []


def minimisers(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a text: the least gram hash in it and the leftmost place that has it."""
    g = grams(h, gram)
    span = window - gram + 1
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, place, width = g, np.arange(len(g)), 1
    while 2 * width <= span:
        right = value[width:] < value[: len(value) - width]
        place = np.where(right, place[width:], place[: len(place) - width])
        value = np.minimum(value[width:], value[: len(value) - width])
        width *= 2
    off = span - width
    right = value[off : off + n] < value[:n]
    return np.minimum(value[:n], value[off : off + n]), np.where(right, place[off : off + n], place[:n])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    A word is removed if a window that covers it also starts anywhere else; windows are judged on the input.  Null
    text has no words; texts shorter than a window keep all; null ids are fine; of repeated rows every window
    repeats, so all of them lose those words; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n = C.parts(spark)
    # A row's key: repeated rows share it, which does no harm, as they share their spans too.
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text"
    )

    def places(it):
        schema = pa.schema([("m", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("n", pa.int32())])
        hashes = Hashes()
        for b in C.batches(it, BATCH):
            ks, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            ms, rows, ns = [], [], []
            for i, own in enumerate(each_hashes(b.column(2), hashes)):
                value, place = minimisers(own, window, gram)
                if len(value):
                    new = np.r_[True, place[1:] != place[:-1]]
                    own, count = np.unique(value[new], return_counts=True)
                    ms.append(own)
                    ns.append(count)
                    rows.append(np.full(len(own), i))
            if ms:
                r = np.concatenate(rows)
                yield C.table(schema, np.concatenate(ms).view(np.int64), ks[r], hs[r], np.concatenate(ns).astype(np.int32))

    # Written: it is read to count and again to join, and finding minimisers is the dear part.
    found = C.materialize(slim.select("k", "h", "text").mapInArrow(places, "m long, k long, h long, n int"), "substring-places")
    shared = found.groupBy("m").agg(F.sum("n").alias("places")).where("places > 1")
    own = found.select("m", "k", "h").join(shared, "m").groupBy("k", "h").agg(F.collect_set(F.struct("m", "places")).alias("shared"))

    def pack(it):
        schema = pa.schema([("m", pa.int64()), ("salt", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("k", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("done", pa.int32())])
        hashes = Hashes()
        rows: list[tuple] = []
        seen: dict[tuple[int, bytes], list] = {}
        held = 0

        def out():
            # Windows of hot minimisers: one that the chunk has twice is settled here and travels once, as settled.
            for (m, w), (places_, at) in seen.items():
                salt = xxhash.xxh3_64_intdigest(w) % (places_ // hot + 1)
                settled = len(at) > 1
                rows.append((m, salt, (at[0][0] ^ at[0][1]) % GROUPS, w, *at[0], at[0][2] + window, int(settled)))
                rows.extend((m, 1 + i % n, -1, b"", *x, x[2] + window, 2) for i, x in enumerate(at) if settled)
            seen.clear()
            if rows:
                batch = C.table(schema, *map(list, zip(*rows)))
                rows.clear()
                yield batch

        for b in C.batches(it, 128):
            for k, h, x, pairs, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), C.texts(b.column(2)), b.column(3).to_pylist(), each_hashes(b.column(2), hashes)):
                words = x.split()
                value, _ = minimisers(own, window, gram)
                value = value.view(np.int64)
                many = {p["m"]: p["places"] for p in pairs}
                ms = np.array(sorted(many), np.int64)
                at = np.minimum(np.searchsorted(ms, value), len(ms) - 1)
                good = ms[at] == value
                edge = np.flatnonzero(np.r_[True, value[1:] != value[:-1], True])
                for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    if not good[a]:
                        continue
                    m = int(value[a])
                    if many[m] > hot:
                        for s in range(a, z):
                            seen.setdefault((m, b" ".join(words[s : s + window])), [many[m], []])[1].append((k, h, s))
                    else:
                        rows.append((m, 0, -1, b" ".join(words[a : z - 1 + window]), k, h, a, z - 1 + window, 0))
                held += len(words)
                if held > CHUNK_WORDS:
                    yield from out()
                    held = 0
        yield from out()

    # The same columns as in the last join, so that both read one exchange of the texts.
    packed = slim.join(own, ["k", "h"]).select("k", "h", "text", "shared", "doc_id").mapInArrow(pack, "m long, salt long, part int, words binary, k long, h long, start long, stop long, done int")

    def count(it, last: bool):
        """Spans of windows that occur again, without words; of a hot minimiser's windows, unless it is the last time, one row each to meet the others."""
        schema = pa.schema([("m", pa.int64()), ("salt", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("k", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("done", pa.int32())])
        ms, salts, ks, hs, starts, stops, on = [], [], [], [], [], [], []

        def out():
            none = [None] * len(ks)
            yield C.table(schema, ms, salts, none, none, ks, hs, starts, stops, none)
            if on:
                yield C.table(schema, *map(list, zip(*on)))
            for x in (ms, salts, ks, hs, starts, stops, on):
                x.clear()

        for t in groups(it, 2 if last else 3):
            m, salt, part = (t.column(c)[0].as_py() for c in range(3))
            strings, done = t.column(3).to_pylist(), t.column(8).to_pylist()
            k, h, start, stop = (t.column(c).to_pylist() for c in (4, 5, 6, 7))
            live = [i for i, d in enumerate(done) if d < 2]
            spans = [(i, start[i], stop[i]) for i, d in enumerate(done) if d == 2]
            if part >= 0 and not last:
                equal: dict[bytes, list[int]] = {}
                for i in live:
                    equal.setdefault(strings[i], []).append(i)
                for w, own in equal.items():
                    again = len(own) > 1 or done[own[0]] == 1
                    spans += [(i, start[i], stop[i]) for i in own if again]
                    i = own[0]
                    on.append((m, salt, part, w, k[i], h[i], start[i], stop[i], int(again)))
                spans.sort()
            elif len(live) > 1 and len({strings[i] for i in live}) == 1:
                spans += [(i, start[i], stop[i]) for i in live]
            elif live:
                every = []
                for i in live:
                    s = strings[i]
                    cuts = [0, *(np.flatnonzero(np.frombuffer(s, np.uint8) == 32) + 1).tolist(), len(s) + 1]
                    every += [(s[cuts[j] : cuts[j + window] - 1], i, j) for j in range(len(cuts) - window)]
                every.sort()
                for q, (w, i, j) in enumerate(every):
                    if q and every[q - 1][0] == w or q + 1 < len(every) and every[q + 1][0] == w or done[i] == 1:
                        spans.append((i, start[i] + j, start[i] + j + window))
                spans.sort()
            merged: list[list[int]] = []
            for i, a, z in spans:
                if merged and merged[-1][0] == i and a <= merged[-1][2]:
                    merged[-1][2] = max(z, merged[-1][2])
                else:
                    merged.append([i, a, z])
            for i, a, z in merged:
                ms.append(m)
                salts.append(salt)
                ks.append(k[i])
                hs.append(h[i])
                starts.append(a)
                stops.append(z)
            if len(ks) + len(on) > 20_000:
                yield from out()
        if ks or on:
            yield from out()

    def settle(it):
        """Spans that were found come first and pass."""
        for b in it:
            if b.column(3).null_count:
                yield b.slice(0, b.column(3).null_count)
            if b.column(3).null_count < b.num_rows:
                yield from count(itertools.chain([b.slice(b.column(3).null_count)], it), True)

    kinds = "m long, salt long, part int, words binary, k long, h long, start long, stop long, done int"
    # One plan up to the result and nothing written in between: what packs and what removes words read one exchange of the texts.
    met = packed.repartition(n, "m", "salt", "part").sortWithinPartitions("m", "salt", "part", "words").mapInArrow(lambda it: count(it, False), kinds)
    # Spans keep their minimiser's place, so that they spread however many one row has.
    rest = met.repartition(n, "m", "salt").sortWithinPartitions(F.col("words").isNotNull(), "m", "salt", "words").mapInArrow(settle, kinds)
    spans = rest.groupBy("k", "h").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def keep(it):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
        for b in C.batches(it):
            ns, gone, shas = [], [], []
            for x, own_spans in zip(C.texts(b.column(1)), b.column(2).to_pylist()):
                words = x.split()
                left, at = [], 0
                for s in sorted((s["start"], s["stop"]) for s in own_spans or ()):
                    if s[0] > at:
                        left += words[at : s[0]]
                    at = max(at, s[1])
                left += words[at:]
                ns.append(len(words))
                gone.append(len(words) - len(left))
                shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield C.table(schema, b.column(0), ns, gone, shas)

    return slim.join(spans, ["k", "h"], "left").select("doc_id", "text", "spans").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS s FROM d),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 34), ' ') AS t FROM p),
dup AS (SELECT doc_id, s FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(s, s + 35)) AS k FROM dup) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS k FROM d),
cover AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(s, s + 35)) AS k FROM dup)),
kept AS (SELECT word.doc_id, string_agg(t, ' ' ORDER BY word.k) AS text FROM word LEFT JOIN cover ON word.doc_id = cover.doc_id AND word.k = cover.k WHERE cover.k IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
