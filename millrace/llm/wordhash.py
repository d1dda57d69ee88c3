"""Words of texts as 64-bit hashes, and streams of rows cut into groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from millrace.llm.common import words_of

CACHE_WORDS = 250_000


class Hashes(dict):
    """Words to the hashes that they have, computed once while they stay."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hashed(column, hashes: Hashes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of a column of texts, words of each text)."""
    at, sizes, words = words_of(column, lower)
    return hashes.of(words)[at] if len(words) else np.zeros(0, np.uint64), sizes


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that lets every bit depend on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words."""
    size = len(h) - n + 1
    total = np.zeros(max(0, size), np.uint64)
    for k in range(n if size > 0 else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + size]
    return mixed(total)


def groups(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows that agree in the first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in it:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        starts = np.flatnonzero(change).tolist()
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for s in starts:
            held.append(b.slice(at, s - at))
            yield pa.Table.from_batches(held)
            held, at = [], s
        held.append(b.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
