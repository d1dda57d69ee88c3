"""Hashed n-gram text embedding: a vectorized function over broadcast parameters."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_WORD = 8
#: The reference reads no more of a text than this: ``most`` for results equal to its own.
REFERENCE_CODEPOINTS = 2048
#: Rows of the projection matrix taken at once.
BLOCK = 65_536
#: Counts of buckets held at once.
EMBED_VALUES = 1_048_576
#: Beyond this many values of the projection matrix its rows are made when touched.
MATRIX_VALUES = 8_388_608
A, B, MASK = 1103515245, 12345, 0xFFFFFFFF


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The generator's state after i + 1 steps is a[i] * seed + b[i] (mod 2^32)."""
    a, b = np.array([A], np.uint64), np.array([B], np.uint64)
    mask = np.uint64(MASK)
    while len(a) < n:
        a, b = np.r_[a, a * a[-1] & mask], np.r_[b, (a * b[-1] + b) & mask]
    return a[:n], b[:n]


def _values(state: np.ndarray) -> np.ndarray:
    return (((state >> np.uint64(16)) & np.uint64(0x7FFF)).astype(np.float64) / 16384 - 1).astype(np.float32)


class Embedder:
    """Texts to unit vectors: words by the longest match in a dictionary, n-grams of codepoints hashed to rows of a
    fixed pseudo-random matrix, summed and normalized.  Whole texts are read, or their first ``most`` codepoints."""

    def __init__(self, dim: int = 128, ngram: int = 3, dictionary: Iterable[str] = (), seed: int = 42, most: int | None = None):
        self.most = most
        self.dim, self.ngram, self.dictionary, self.seed = dim, ngram, frozenset(dictionary), seed
        self.buckets = dim * 256
        self._matrix: np.ndarray | None = None
        self._wide: np.ndarray | None = None
        self._rows: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_matrix": None, "_wide": None, "_rows": {}}

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        if self.buckets * self.dim <= MATRIX_VALUES:
            if self._matrix is None:
                a, b = _powers(self.buckets * self.dim)
                self._matrix = _values((a * np.uint64(self.seed) + b) & np.uint64(MASK)).reshape(self.buckets, self.dim)
            return self._matrix[buckets]
        return np.stack([self._row(int(k)) for k in buckets])

    def _row(self, bucket: int) -> np.ndarray:
        if bucket not in self._rows:
            steps, mul, add = bucket * self.dim, 1, 0
            pa_, pb = A, B
            while steps:
                if steps & 1:
                    mul, add = mul * pa_ & MASK, (add * pa_ + pb) & MASK
                pa_, pb, steps = pa_ * pa_ & MASK, (pa_ * pb + pb) & MASK, steps >> 1
            a, b = _powers(self.dim)
            start = np.uint64((mul * self.seed + add) & MASK)
            self._rows[bucket] = _values((a * start + b) & np.uint64(MASK))
        return self._rows[bucket]

    def segment(self, text: str) -> str:
        out, at, text = [], 0, text[: self.most]
        if not self.dictionary:
            return "".join(c + " " for c in text)
        while at < len(text):
            for k in range(min(LONGEST_WORD, len(text) - at), 0, -1):
                if k == 1 or text[at : at + k] in self.dictionary:
                    out.append(text[at : at + k])
                    at += k
                    break
        return "".join(w + " " for w in out)

    def _codes(self, text: str) -> np.ndarray:
        """Code points of what ``segment`` makes of a text."""
        if self.dictionary:
            return np.frombuffer(self.segment(text).encode("utf-32-le", "replace"), np.uint32)
        own = np.frombuffer(text[: self.most].encode("utf-32-le", "replace"), np.uint32)
        out = np.full(2 * len(own), 32, np.uint32)
        out[::2] = own
        return out

    def _buckets(self, codes: np.ndarray) -> np.ndarray:
        n = min(self.ngram, len(codes))
        h = np.full(len(codes) - n + 1, 2166136261, np.uint32)
        wide = int(codes.max(initial=0)).bit_length()
        for k in range(n):
            own = codes[k : k + len(h)]
            for shift in range(0, 32, 8):
                if shift < wide:
                    h ^= (own >> np.uint32(shift)) & np.uint32(255)
                h *= np.uint32(16777619)
        return h % np.uint32(self.buckets)

    def embed_all(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: how often each bucket occurs, times the matrix."""
        out = np.zeros((len(texts), self.dim), np.float64)
        whole = self.buckets * self.dim <= MATRIX_VALUES
        step = max(1, EMBED_VALUES // self.buckets)
        for at in range(0, len(texts), step):
            some = texts[at : at + step]
            counts = np.zeros((len(some), self.buckets), np.float32) if whole else None
            for i, x in enumerate(some):
                if not x:
                    continue
                own = self._buckets(self._codes(x))
                if whole:
                    counts[i] = np.bincount(own, minlength=self.buckets)
                else:
                    used, times = np.unique(own, return_counts=True)
                    for a in range(0, len(used), BLOCK):
                        out[at + i] += times[a : a + BLOCK] @ self.rows(used[a : a + BLOCK]).astype(np.float64)
            if whole:
                self.rows(np.zeros(0, np.int64))
                if self._wide is None:
                    self._wide = self._matrix.astype(np.float64)
                out[at : at + step] = counts.astype(np.float64) @ self._wide
        norm = (out * out).sum(1, keepdims=True)
        return (out / np.where(norm > 1e-30, np.sqrt(norm), 1)).astype(np.float32)

    def embed(self, text: str | None) -> np.ndarray:
        return self.embed_all([text])[0]

    def __call__(self, text: Column) -> Column:
        own = self

        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(list(own.embed_all(s.tolist())))

        return run(text)
