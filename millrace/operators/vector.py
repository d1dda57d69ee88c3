"""Vectors: exact top-k, radius and filtered search, batches of queries, an inverted-file approximation, upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import INVAL, NOTFOUND, EngineError
from millrace.functions.distance import METRICS, metric, vector
from millrace.sources.shared import Files

#: Rows that a block of queries is compared with at a time.
TILE = 1024


def sampled(df: DataFrame, rows: int, id_col: str = "id") -> DataFrame:
    """About ``rows`` rows by a hash of the id, twice as many at most; all of them if there are no more."""
    n = df.count()
    million = 1_000_000
    return df if n <= rows else df.where(F.pmod(F.xxhash64(id_col), F.lit(million)) < -(-million * rows // n)).limit(2 * rows)


def batch_of(b: pa.RecordBatch, column: int) -> np.ndarray:
    """A column of vectors as a matrix, without a Python object for each value."""
    v = b.column(column)
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0))


def _nearest(d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k least distances, or all, in order, and their ids; of equal ones the least ids, NaN last."""
    if d.shape[1] > k:
        kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero(~(d > kth))  # k of a row at least, more where the last one ties
        order = np.lexsort((i[row, column], d[row, column], row))
        row, column = row[order], column[order]
        first = np.searchsorted(row, np.arange(len(d)))
        own = (first[:, None] + np.arange(k)[None, :]).ravel()
        row, column = row[own].reshape(-1, k), column[own].reshape(-1, k)
        return d[row, column], i[row, column]
    order = np.lexsort((i, d), axis=1)
    return np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)


def searchable(filter_: Column | Callable) -> Column:
    """A Column predicate as it is; a Python callable on ids as a vectorized function."""
    if isinstance(filter_, Column):
        return filter_

    @F.pandas_udf("boolean")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: bool(filter_(x)))

    return run(F.col("id"))


class VectorIndex:
    """(id, embedding) rows; the latest of an id that is inserted again wins."""

    def __init__(self, df: DataFrame, dim: int | None = None, metric: str = "l2", embedder=None):
        self.df, self.dim, self.metric, self.embedder = df.select("id", "embedding"), dim, metric, embedder

    @classmethod
    def of(cls, df: DataFrame, id_col: str, vec_col: str, **options) -> VectorIndex:
        return cls(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding")), **options)

    def _with(self, df: DataFrame) -> VectorIndex:
        return VectorIndex(df, self.dim, self.metric, self.embedder)

    def _query(self, q: Sequence[float], k: int | None = None) -> Column:
        if k is not None and k <= 0 or self.dim is not None and len(q) != self.dim:
            raise EngineError(INVAL, f"k {k}, dimension {len(q)}")
        return vector(np.asarray(q, np.float32).astype(float))

    def insert(self, rows: DataFrame) -> VectorIndex:
        """Of an id that the batch repeats the later row counts, as far as rows have an order."""
        new = rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        new = new.withColumn("at", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by("embedding", "at").alias("embedding"))
        return self._with(self.df.join(new.select("id").distinct(), "id", "left_anti").unionByName(new))

    insert_batch = insert

    def insert_text(self, rows: DataFrame) -> VectorIndex:
        return self.insert(rows.select("id", self.embedder(F.col("text")).alias("embedding")))

    def delete(self, ids: Sequence[int] | DataFrame) -> VectorIndex:
        gone = ids if isinstance(ids, DataFrame) else self.df.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
        return self._with(self.df.join(gone.select("id"), "id", "left_anti"))

    def get(self, id_: int) -> DataFrame:
        return self.df.where(F.col("id") == id_)

    def fetch(self, id_: int) -> list[float]:
        found = self.get(id_).head(1)
        if not found:
            raise EngineError(NOTFOUND, str(id_))
        return found[0]["embedding"]

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("count"))

    def stats(self) -> DataFrame:
        """Capacity means nothing here; memory is what the values and ids take."""
        size = F.coalesce(F.max(F.size("embedding")), F.lit(0))
        return self.df.agg(F.count("*").alias("count"), size.cast("int").alias("dim"), (F.count("*") * (4 * size + 8)).cast("long").alias("memory_bytes"))

    def scored(self, q: Sequence[float], filter_: Column | Callable | None = None, k: int | None = None) -> DataFrame:
        df = self.df if filter_ is None else self.df.where(searchable(filter_))
        return df.select("id", metric(self.metric)(F.col("embedding"), self._query(q, k)).alias("distance"))

    def search(self, q: Sequence[float], k: int = 10, filter_: Column | Callable | None = None) -> DataFrame:
        """Each partition keeps its k nearest; only those meet."""
        return self.scored(q, filter_, k).orderBy("distance", "id").limit(k)

    def search_radius(self, q: Sequence[float], radius: float, most: int | None = None) -> DataFrame:
        """All rows within the radius, or the ``most`` nearest of them."""
        own = self.scored(q).where(F.col("distance") <= radius).orderBy("distance", "id")
        return own if most is None else own.limit(most)

    def search_text(self, text: str, k: int = 10, filter_: Column | Callable | None = None) -> DataFrame:
        return self.search(self.embedder.embed(text), k, filter_)

    def batch_knn(self, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
        """(qid, id, distance) for each row of queries (qid, embedding): a stated query set, in blocks, against all rows.

        A block of queries is a broadcast matrix; each partition compares it with TILE rows at a time, whatever the size of
        Arrow's batches, and keeps its k best for each query; a window over those finds the k best of all.  The driver reads
        queries block by block; blocks stay broadcast.
        """
        name, spark = self.metric if self.metric in METRICS else "l2", self.df.sparkSession
        sent = None
        rows = queries.select("qid", "embedding").toLocalIterator()
        held: list = []

        def part(held_) -> DataFrame:
            ids = np.array([r[0] for r in held_], np.int64)
            m = np.array([r[1] for r in held_], np.float64)
            shared = spark.sparkContext.broadcast((ids, m))

            def run(it):
                qids, q = shared.value
                best_d, best_i = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int64)
                for t in (b.slice(at, TILE) for b in it for at in range(0, b.num_rows, TILE)):
                    own, x = t.column(0).to_numpy(), batch_of(t, 1)
                    if name == "l2":
                        d = np.empty((len(q), len(x)))
                        for j, v in enumerate(q):
                            d[j] = ((x - v) ** 2).sum(1)
                    elif name == "ip":
                        d = -(q @ x.T)
                    else:
                        norm = np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)[None, :])
                        d = np.where(norm == 0, 1.0, 1 - (q @ x.T) / np.where(norm == 0, 1, norm))
                    best_d, best_i = _nearest(np.concatenate([best_d, d], 1), np.concatenate([best_i, np.broadcast_to(own, d.shape)], 1), k)
                n = best_d.shape[1]
                if n:
                    yield pa.RecordBatch.from_pydict({"qid": np.repeat(qids, n), "id": best_i.ravel(), "distance": best_d.ravel()})

            return self.df.mapInArrow(run, "qid long, id long, distance double")

        for r in rows:
            held.append(r)
            if len(held) == block:
                sent = part(held) if sent is None else sent.unionByName(part(held))
                held = []
        if held:
            sent = part(held) if sent is None else sent.unionByName(part(held))
        if sent is None:
            return self.df.sparkSession.createDataFrame([], "qid long, id long, distance double")
        w = Window.partitionBy("qid").orderBy("distance", "id")
        return sent.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")

    def save(self, path: str) -> VectorIndex:
        """Writes a version beside the ones there are, then its parameters: a reader opens the newest that is whole."""
        files = Files(self.df.sparkSession, path)
        n = max([0, *(int(x.removesuffix(".json")) for x in files.names() if x.endswith(".json"))]) + 1
        self.df.write.mode("overwrite").parquet(f"{path}/{n:06d}")
        files.write(f"{n:06d}.json", {"dim": self.dim, "metric": self.metric})
        return VectorIndex.load(self.df.sparkSession, path, embedder=self.embedder)

    @classmethod
    def load(cls, spark, path: str, embedder=None) -> VectorIndex:
        files = Files(spark, path)
        whole = [x for x in files.names() if x.endswith(".json")]
        if not whole:
            raise EngineError(NOTFOUND, path)
        m = files.read(whole[-1])
        return cls(spark.read.schema("id long, embedding array<float>").parquet(f"{path}/{whole[-1].removesuffix('.json')}"), m["dim"], m["metric"], embedder)


def lloyd(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k centroids, starting from evenly spaced rows; an empty cluster keeps its centroid, ties go to the lowest."""
    x = x.astype(np.float64)
    c = x[(np.arange(k) * len(x) // k)].copy()
    for _ in range(rounds):
        near = np.argmin((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 1)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            total = np.bincount(near, x[:, j], k)
            c[:, j] = np.where(n > 0, total / np.maximum(n, 1), c[:, j])
    return c


class IvfIndex:
    """Approximate search: rows by nearest centroids, the ``probe`` nearest cells read, exact distances in them.

    Centroids are fitted on a bounded sample (about ``sample`` rows by hash of the id); every row is indexed, in each of
    its ``spill`` nearest cells, so that a row near a border is found from either side.
    """

    def __init__(self, index: VectorIndex, cells: int = 16, sample: int = 20_000, rounds: int = 20, spill: int = 2):
        rows = sampled(index.df, sample).orderBy(F.xxhash64("id"), "id").toPandas()
        x = np.array(rows["embedding"].tolist(), np.float64)
        self.index, self.spill = index, spill
        self.centroids = lloyd(x, min(cells, len(x)), rounds) if len(x) else np.zeros((0, 0))
        self.cells = self._placed(index.df)

    def _placed(self, df: DataFrame) -> DataFrame:
        """(id, embedding, cell, nearer): a row lies in each of its cells, with those nearer to it: of the cells read only the first gives it."""
        cents, spill = self.centroids, self.spill

        def place(it):
            for b in it:
                x = batch_of(b, 1)
                near = np.argsort((cents * cents).sum(1)[None, :] - 2 * x @ cents.T, 1, kind="stable")[:, :spill].astype(np.int32) if len(cents) and len(x) else np.zeros((len(x), 1), np.int32)
                for k in range(near.shape[1]):
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near[:, k]), pa.array(near[:, :k].tolist(), pa.list_(pa.int32()))], ["id", "embedding", "cell", "nearer"])

        return df.select("id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(place, "id long, embedding array<float>, cell int, nearer array<int>")

    def save(self, path: str) -> IvfIndex:
        """Partitioned by cell: a search then lists and reads only the cells it probes."""
        self.cells.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)
        spark = self.index.df.sparkSession
        Files(spark, path).write("_centroids.json", {"centroids": self.centroids.tolist(), "spill": self.spill, "dim": self.index.dim, "metric": self.index.metric})
        return IvfIndex.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> IvfIndex:
        own, m = cls.__new__(cls), Files(spark, path).read("_centroids.json")
        own.centroids, own.spill = np.array(m["centroids"], np.float64), m["spill"]
        own.cells = spark.read.schema("id long, embedding array<float>, nearer array<int>, cell int").parquet(path).select("id", "embedding", "cell", "nearer")
        own.index = VectorIndex(own.cells.where(F.size("nearer") == 0), m["dim"], m["metric"])
        return own

    def _with(self, cells: DataFrame) -> IvfIndex:
        own = IvfIndex.__new__(IvfIndex)
        own.centroids, own.spill, own.cells = self.centroids, self.spill, cells
        own.index = self.index._with(cells.where(F.size("nearer") == 0))
        return own

    def insert(self, rows: DataFrame) -> IvfIndex:
        """Into the cells that there are; an id that is there already is replaced."""
        new = VectorIndex(self.cells.limit(0)).insert(rows).df
        left = self.cells.join(new.select("id"), "id", "left_anti").select(self.cells.columns)
        return self._with(left.unionByName(self._placed(new)))

    def delete(self, ids: Sequence[int] | DataFrame) -> IvfIndex:
        gone = ids if isinstance(ids, DataFrame) else self.cells.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
        return self._with(self.cells.join(gone.select("id"), "id", "left_anti").select(self.cells.columns))

    def get(self, id_: int) -> DataFrame:
        return self.index.get(id_)

    def count(self) -> DataFrame:
        return self.index.count()

    def _probed(self, q: np.ndarray, probe: int) -> np.ndarray:
        """For each query a flag for each cell."""
        if not len(self.centroids):
            return np.ones((len(q), 1), bool)
        near = np.argsort((self.centroids**2).sum(1)[None, :] - 2 * q @ self.centroids.T, 1, kind="stable")[:, :probe]
        out = np.zeros((len(q), len(self.centroids)), bool)
        np.put_along_axis(out, near, True, 1)
        return out

    def search(self, q: Sequence[float], k: int = 10, probe: int = 4) -> DataFrame:
        near = np.flatnonzero(self._probed(np.asarray(q, np.float64)[None, :], probe)[0]).tolist()
        own = self.cells.where(F.col("cell").isin(near) & ~F.arrays_overlap("nearer", F.array(*map(F.lit, near)).cast("array<int>")))
        return self.index._with(own).search(q, k)

    def batch_knn(self, queries: DataFrame, k: int, probe: int = 4, block: int = 1024) -> DataFrame:
        """(qid, id, distance) for each row of queries (qid, embedding), in blocks: the rows of the cells that a query
        probes are compared with it, and each partition keeps its k best for each query."""
        spark, name = self.cells.sparkSession, self.index.metric if self.index.metric in METRICS else "l2"
        none = spark.createDataFrame([], "qid long, id long, distance double")

        def part(held: list) -> DataFrame:
            qids, q = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)
            probed = self._probed(q, probe)
            shared = spark.sparkContext.broadcast((qids, q, probed))
            cells = np.flatnonzero(probed.any(0)).tolist()

            def run(it):
                qids, q, probed = shared.value
                best: list = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
                for b in it:
                    ids, x, cell = b.column(0).to_numpy(), batch_of(b, 1), b.column(2).to_numpy()
                    nearer = np.zeros((len(ids), probed.shape[1]), bool)
                    lists = b.column(3)
                    nearer[np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
                    for c in np.unique(cell).tolist():
                        rows = np.flatnonzero(cell == c)
                        asks = np.flatnonzero(probed[:, c])
                        own, near = x[rows], nearer[rows]
                        for i in asks.tolist():
                            ok = ~(near & probed[i]).any(1)
                            v, found = own[ok], ids[rows][ok]
                            if name == "l2":
                                d = ((v - q[i]) ** 2).sum(1)
                            elif name == "ip":
                                d = -(v @ q[i])
                            else:
                                norm = np.sqrt((v * v).sum(1) * (q[i] @ q[i]))
                                d = np.where(norm == 0, 1.0, 1 - (v @ q[i]) / np.where(norm == 0, 1, norm))
                            d, found = np.r_[best[i][0], d], np.r_[best[i][1], found]
                            keep = np.lexsort((found, d))[:k]
                            best[i] = d[keep], found[keep]
                out = [(int(qids[i]), int(f), float(d)) for i, (ds, fs) in enumerate(best) for d, f in zip(ds, fs)]
                if out:
                    a, f, d = zip(*out)
                    yield pa.RecordBatch.from_pydict({"qid": pa.array(a, pa.int64()), "id": pa.array(f, pa.int64()), "distance": pa.array(d, pa.float64())})

            return self.cells.where(F.col("cell").isin(cells)).mapInArrow(run, "qid long, id long, distance double")

        held, sent = [], none
        for r in queries.select("qid", "embedding").toLocalIterator():
            held.append(r)
            if len(held) == block:
                sent, held = sent.unionByName(part(held)), []
        sent = sent.unionByName(part(held)) if held else sent
        w = Window.partitionBy("qid").orderBy("distance", "id")
        return sent.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
