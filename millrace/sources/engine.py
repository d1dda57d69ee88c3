"""The engine: a session's named tables, text indexes, vector index and quantized index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.errors import EXISTS, INVAL, NOTFOUND, EngineError
from millrace.plans.query import Query
from millrace.sources.changelog import ChangeLog
from millrace.sources.shared import Files

TYPES = {"int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "blob": T.BinaryType(), "bool": T.BooleanType()}
#: Where the folder of a database has its indexes: no table can have such a name.
FTS, VECTORS = "+fts", "+vectors"


class Engine:
    """Opens a folder of change-logs, if given one, and any DataFrames that are registered.

    Stored text indexes and the stored vector index of the folder are opened with it; without a folder they live as
    plans of the session.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/") if path else None, read_only
        self.tables: dict[str, tuple[DataFrame, str]] = {}
        self.logs: dict[str, ChangeLog] = {}
        self.fts: dict = {}
        self.vectors = self.quantized = self.quantizer = None
        self.refresh()

    def refresh(self) -> None:
        """Finds tables and indexes that others made; rows of tables are read anew by every scan."""
        from millrace.operators.fts import TextIndex
        from millrace.operators.vector import VectorIndex

        if not self.path:
            return
        files = Files(self.spark, self.path)
        for name in files.names():
            if files.exists(f"{name}/schema.json"):
                self.logs[name] = ChangeLog(self.spark, f"{self.path}/{name}")
        for name in files.names(FTS):
            table, _, column = name.partition("+")
            if files.exists(f"{FTS}/{name}/index.json"):
                self.fts[table, column] = TextIndex.load(self.spark, f"{self.path}/{FTS}/{name}")
        if files.exists(f"{VECTORS}/current.json") or files.names(VECTORS):
            self.vectors = VectorIndex.load(self.spark, f"{self.path}/{VECTORS}", embedder=self.vectors.embedder if self.vectors else None)

    def close(self) -> None:
        for index in self.fts.values():
            index.drop()
        self.fts, self.tables, self.logs = {}, {}, {}
        self.vectors = self.quantized = self.quantizer = None

    def register(self, name: str, df: DataFrame, key: str) -> Engine:
        self.tables[name] = (df, key)
        return self

    def create_table(self, name: str, columns: list[tuple[str, str]], key: str) -> ChangeLog:
        if not self.path or self.read_only:
            raise EngineError(INVAL, "no folder to write to")
        if name in self.logs or name in self.tables:
            raise EngineError(EXISTS, name)
        if not name or "+" in name or len({c for c, _ in columns}) != len(columns) or any(t not in TYPES for _, t in columns):
            raise EngineError(INVAL, name)
        log = ChangeLog.create(self.spark, f"{self.path}/{name}", T.StructType([T.StructField(c, TYPES[t]) for c, t in columns]), key)
        self.logs[name] = log
        return log

    def _log(self, name: str) -> ChangeLog:
        if name not in self.logs:
            raise EngineError(NOTFOUND, name)
        return self.logs[name]

    def put(self, name: str, rows) -> None:
        self._writable()
        self._log(name).put(rows)

    def delete(self, name: str, keys) -> None:
        self._writable()
        self._log(name).delete(keys)

    def _writable(self) -> None:
        if self.read_only:
            raise EngineError(INVAL, "opened for reading")

    def get(self, name: str, key) -> dict:
        found = self._log(name).get(key).head(1)
        if not found:
            raise EngineError(NOTFOUND, f"{name}: {key}")
        return found[0].asDict()

    def compact(self, name: str) -> None:
        self._writable()
        self._log(name).compact()

    def scan(self, name: str) -> DataFrame:
        return self.tables[name][0] if name in self.tables else self._log(name).view()

    def key(self, name: str) -> str:
        return self.tables[name][1] if name in self.tables else self._log(name).key

    def query(self, name: str) -> Query:
        return Query(self, name)

    def fts_create_index(self, table: str, column: str, **options):
        """The index of a folder's table is written beside it and found again by whoever opens the folder."""
        from millrace.operators.fts import TextIndex

        if (table, column) in self.fts:
            raise EngineError(EXISTS, f"{table}.{column}")
        index = TextIndex.build(self.scan(table), self.key(table), [column], **options)
        if self.path and not self.read_only and table in self.logs:
            index = index.save(f"{self.path}/{FTS}/{table}+{column}")
        self.fts[table, column] = index
        return index

    def fts_drop_index(self, table: str, column: str) -> None:
        self._fts(table, column).drop()
        del self.fts[table, column]
        if self.path and not self.read_only:
            Files(self.spark, self.path).delete(f"{FTS}/{table}+{column}")

    def _fts(self, table: str, column: str):
        if (table, column) not in self.fts:
            raise EngineError(NOTFOUND, f"{table}.{column}")
        return self.fts[table, column]

    def fts_search(self, table: str, column: str, query: str) -> DataFrame:
        return self._fts(table, column).search(query)

    def vec_create_index(self, dim: int = 128, ngram: int = 3, metric: str = "l2", dictionary: Sequence[str] = ()) -> Engine:
        """An empty vector index with an embedder of its own."""
        from millrace.functions.embed import Embedder
        from millrace.operators.vector import VectorIndex

        if self.vectors is not None:
            raise EngineError(EXISTS, "vector index")
        if dim < 1:
            raise EngineError(INVAL, f"dim {dim}")
        self.vectors = VectorIndex(self.spark.createDataFrame([], "id long, embedding array<float>"), dim, metric, Embedder(dim, ngram, dictionary))
        return self

    def _vectors(self):
        if self.vectors is None:
            raise EngineError(NOTFOUND, "vector index")
        return self.vectors

    def vec_destroy_index(self) -> None:
        self._vectors()
        self.vectors = self.quantized = None
        if self.path and not self.read_only:
            Files(self.spark, self.path).delete(VECTORS)

    def vec_set_embed(self, embed: Callable[[Column], Column]) -> None:
        """``embed`` makes a column of vectors from one of texts; for searches by text it has ``embed(text)`` too."""
        self._vectors().embedder = embed

    def vec_insert_vector(self, id_: int, vector: Sequence[float]) -> None:
        self.vec_insert_batch([(id_, vector)])

    def vec_insert_batch(self, rows: DataFrame | list[tuple[int, Sequence[float]]]) -> None:
        if not isinstance(rows, DataFrame):
            if any(self._vectors().dim not in (None, len(v)) for _, v in rows):
                raise EngineError(INVAL, "dimension")
            rows = self.spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>").coalesce(1)
        self.vectors = self._vectors().insert(rows)

    def vec_insert_text(self, id_: int, text: str) -> None:
        self.vec_insert_text_batch([(id_, text)])

    def vec_insert_text_batch(self, rows: DataFrame | list[tuple[int, str]]) -> None:
        self._vectors()
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, "id long, text string").coalesce(1)
        self.vectors = self.vectors.insert_text(df)

    def vec_delete(self, id_: int) -> None:
        if not self._vectors().get(id_).head(1):
            raise EngineError(NOTFOUND, str(id_))
        self.vectors = self.vectors.delete([id_])

    def vec_count(self) -> int:
        return self._vectors().count().first()[0]

    def vec_flush(self) -> None:
        """Writes the index to the folder: inserts and deletions end there as plans."""
        self._writable()
        if self.path:
            self.vectors = self._vectors().save(f"{self.path}/{VECTORS}")

    def vec_search(self, query: Sequence[float], k: int = 10, filter_=None) -> DataFrame:
        return self._vectors().search(query, k, filter_)

    def vec_search_text(self, text: str, k: int = 10, filter_=None) -> DataFrame:
        return self._vectors().search_text(text, k, filter_)

    vec_search_text_filtered = vec_search_text

    def quant_create(self, kind: str = "sq8", subspaces: int = 8) -> None:
        if kind not in ("sq8", "pq"):
            raise EngineError(INVAL, kind)
        self.quantizer, self.quantized = (kind, subspaces), None

    def quant_train(self, rows: DataFrame) -> None:
        from millrace.operators.quantize import Pq, QuantizedIndex, Sq8

        if self.quantizer is None:
            raise EngineError(NOTFOUND, "quantizer")
        kind, subspaces = self.quantizer
        self.quantized = QuantizedIndex(rows.limit(0), Sq8.train(rows) if kind == "sq8" else Pq.train(rows, subspaces))

    def _quantized(self):
        if self.quantized is None:
            raise EngineError(INVAL, "not trained")
        return self.quantized

    def quant_insert(self, rows: DataFrame) -> None:
        """Into both: the codes, which keep repeated ids, and the vector index, if there is one."""
        self.quantized = self._quantized().insert(rows)
        if self.vectors is not None:
            self.vectors = self.vectors.insert(rows)

    def quant_search(self, query: Sequence[float], k: int = 10) -> DataFrame:
        return self._quantized().search(query, k)

    def quant_destroy(self) -> None:
        self.quantizer = self.quantized = None

    def hybrid_search(self, table: str, column: str, fts_query: str, query: Sequence[float], k: int = 10, **options) -> DataFrame:
        """Text and vector rankings of k rows each, fused."""
        from millrace.operators.hybrid import hybrid_search

        return hybrid_search(self._vectors(), self._fts(table, column), fts_query, query, k, **options)
