"""Scalar (one byte per dimension) and product quantization, as expressions over small model arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import INVAL, NOTFOUND, EngineError
from millrace.functions.distance import l2, vector
from millrace.operators.vector import lloyd, sampled


class Sq8:
    def __init__(self, low: Sequence[float], span: Sequence[float]):
        self.low, self.span = list(low), list(span)

    @classmethod
    def train(cls, df: DataFrame, column: str = "embedding") -> Sq8:
        """Least value and range of each dimension over all rows; a constant one has range 1."""
        rows = df.select(F.posexplode(column).alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("dim").collect()
        if not rows:
            raise EngineError(INVAL, "no rows to train from")
        return cls([float(r.lo) for r in rows], [float(r.hi) - float(r.lo) or 1.0 for r in rows])

    @property
    def code_size(self) -> int:
        return len(self.low)

    def encode(self, v: Column) -> Column:
        model = F.arrays_zip(vector(self.low).alias("lo"), vector(self.span).alias("span"))
        unit = lambda x, m: F.greatest(F.least((x.cast("double") - m["lo"]) / m["span"], F.lit(1.0)), F.lit(0.0))
        return F.zip_with(v, model, lambda x, m: F.floor(unit(x, m) * 255 + 0.5).cast("int"))

    def decode(self, code: Column) -> Column:
        model = F.arrays_zip(vector(self.low).alias("lo"), vector(self.span).alias("span"))
        return F.zip_with(code, model, lambda c, m: m["lo"] + c / F.lit(255.0) * m["span"])

    def encode_one(self, q: Sequence[float]) -> list[int]:
        u = np.clip((np.asarray(q, float) - self.low) / np.array(self.span), 0, 1)
        return np.floor(u * 255 + 0.5).astype(int).tolist()

    def distance(self, code: Column, q: Sequence[float]) -> Column:
        """Squared L2 between what both codes decode to."""
        own = np.array(self.low) + np.array(self.encode_one(q)) / 255.0 * np.array(self.span)
        return l2(self.decode(code), vector(own))


class Pq:
    """codebooks: [sub-space][code][dimension]; trailing dimensions that don't divide are left out."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.tables = np.stack([((b[:, None, :] - b[None, :, :]) ** 2).sum(2) for b in books])

    @classmethod
    def train(cls, df: DataFrame, subspaces: int, column: str = "embedding", codes: int = 256, rounds: int = 20, sample: int = 50_000) -> Pq:
        """Lloyd's algorithm on about ``sample`` rows by a hash of the id, twice as many at most."""
        rows = sampled(df, sample).orderBy(F.xxhash64("id"), "id").select(column).toPandas()[column].tolist()
        if not rows or subspaces < 1:
            raise EngineError(INVAL, "no rows to train from")
        x = np.array(rows, np.float64)
        d = x.shape[1] // subspaces
        if not d:
            raise EngineError(INVAL, "more sub-spaces than dimensions")
        return cls(np.stack([lloyd(x[:, s * d : (s + 1) * d], codes, rounds) for s in range(subspaces)]))

    @property
    def code_size(self) -> int:
        return len(self.books)

    def codes_of(self, x: np.ndarray) -> np.ndarray:
        d = self.books.shape[2]
        return np.stack([np.argmin((b * b).sum(1)[None, :] - 2 * x[:, s * d : (s + 1) * d] @ b.T, 1) for s, b in enumerate(self.books)], 1)

    def encode(self, v: Column) -> Column:
        own = self

        @F.pandas_udf("array<int>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(own.codes_of(np.array(s.tolist(), np.float64)).tolist())

        return run(v)

    def decode(self, code: Column) -> Column:
        own = self

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda c: np.concatenate([b[k] for b, k in zip(own.books, c)]).tolist())

        return run(code)

    def distance(self, code: Column, q: Sequence[float]) -> Column:
        """Symmetric: between the centroids of both, from one table per sub-space."""
        lut = self.tables[np.arange(len(self.books)), self.codes_of(np.asarray(q, np.float64)[None, :])[0]]

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            c = np.array(s.tolist())
            return pd.Series(lut[np.arange(len(lut))[None, :], c].sum(1))

        return run(code)


class QuantizedIndex:
    """(id, embedding, code): codes are made once, searches read only them."""

    def __init__(self, df: DataFrame, quantizer: Sq8 | Pq):
        self.quantizer, self.df = quantizer, df.select("id", "embedding", quantizer.encode(F.col("embedding")).alias("code"))

    def insert(self, rows: DataFrame) -> QuantizedIndex:
        """Repeated ids stay; what is there already isn't encoded again."""
        own = QuantizedIndex.__new__(QuantizedIndex)
        own.quantizer, own.df = self.quantizer, self.df.unionByName(QuantizedIndex(rows, self.quantizer).df)
        return own

    def search(self, q: Sequence[float], k: int = 10) -> DataFrame:
        if k <= 0:
            raise EngineError(INVAL, f"k {k}")
        return self.df.select("id", self.quantizer.distance(F.col("code"), q).alias("distance")).orderBy("distance", "id").limit(k)

    def decode(self, id_: int) -> list[float]:
        found = self.df.where(F.col("id") == id_).select(self.quantizer.decode(F.col("code")).alias("v")).head(1)
        if not found:
            raise EngineError(NOTFOUND, str(id_))
        return found[0]["v"]
