"""Keyed tables as append-only change-logs of Parquet: the latest write of a key wins, a deletion hides it.

A log is a folder.  ``numbers`` has a file for each number that a writer took, ``data`` a folder for each append and
``base`` one for each compaction, with the appends that it stands for in a JSON file beside it.  Folders are written
elsewhere and renamed into place, so readers see an append or a compaction as a whole or not at all, writers don't wait
for each other, and what is appended during a compaction stays.  The file system must rename atomically.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import EXISTS, INVAL, NOTFOUND, EngineError
from millrace.sources.shared import Files

KEY, SEQ, DELETED = "_key", "_seq", "_deleted"
#: The number of the append, then the place in it.
SEQ_TYPE = T.StructType([T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType())])


def latest(log: DataFrame, key: str = KEY, seq: str | list[str] = SEQ, deleted: str = DELETED, live: bool = True) -> DataFrame:
    """The live rows, or all newest ones: one aggregate whose partial step keeps the newest write of each key before the shuffle."""
    order = F.struct(*[F.col(c) for c in ([seq] if isinstance(seq, str) else seq)])
    every = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    newest = log.groupBy(F.col(key).alias("__k")).agg(F.max_by(every, order).alias("__r")).select("__r.*")
    return newest.where(~F.col(deleted)) if live else newest


class ChangeLog:
    """A table under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark, root), root.rstrip("/")
        self.__meta = None

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType, key: str) -> ChangeLog:
        log = cls(spark, root)
        if log.files.exists("schema.json"):
            raise EngineError(EXISTS, root)
        if key not in schema.fieldNames():
            raise EngineError(INVAL, f"no column {key}")
        log.files.write("schema.json", {"key": key, "schema": json.loads(schema.json())})
        return log

    def _meta(self) -> tuple[str, T.StructType]:
        if self.__meta is None:
            if not self.files.exists("schema.json"):
                raise EngineError(NOTFOUND, self.root)
            m = self.files.read("schema.json")
            self.__meta = m["key"], T.StructType.fromJson(m["schema"])
        return self.__meta

    @property
    def key(self) -> str:
        return self._meta()[0]

    @property
    def schema(self) -> T.StructType:
        return self._meta()[1]

    @property
    def log_schema(self) -> T.StructType:
        key, schema = self._meta()
        return T.StructType([T.StructField(KEY, schema[key].dataType), T.StructField(SEQ, SEQ_TYPE), T.StructField(DELETED, T.BooleanType()), *schema.fields])

    def _number(self) -> int:
        """The next number, taken for good."""
        taken = self.files.names("numbers")
        n = int(taken[-1]) + 1 if taken else 1
        while not self.files.claim(f"numbers/{n:012d}"):
            n += 1
        return n

    def _place(self, rows: DataFrame, folder: str) -> None:
        """Writes rows aside, with a Bloom filter of their keys, and moves them, whole, to where readers look."""
        aside = f"aside/{uuid.uuid4().hex}"
        rows.write.option("parquet.bloom.filter.enabled#" + KEY, "true").parquet(f"{self.root}/{aside}")
        if not self.files.rename(self.files.path(aside), self.files.path(folder)):
            raise EngineError(EXISTS, folder)

    def _append(self, rows: DataFrame, deleted: bool) -> None:
        key, schema = self._meta()
        n = self._number()
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        # Within a batch the later row wins, as far as rows have an order.
        place = F.monotonically_increasing_id()
        seq = F.struct(F.lit(n).cast("long").alias("batch"), F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
        self._place(rows.select(F.col(f"`{key}`").cast(schema[key].dataType).alias(KEY), seq.alias(SEQ), F.lit(deleted).alias(DELETED), *columns), f"data/{n:012d}")

    def put(self, rows: DataFrame | list) -> None:
        """Upserts."""
        self._append(rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema).coalesce(1), False)

    def delete(self, keys: DataFrame | list) -> None:
        """Hides keys, whether or not they are there."""
        key, schema = self._meta()
        rows = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in keys], T.StructType([schema[key]]))
        self._append(rows, True)

    def _now(self) -> tuple[str | None, list[str]]:
        """The newest compaction and the appends that it doesn't stand for."""
        done = [x for x in self.files.names("base") if not x.endswith(".json")]
        inside = set(self.files.read(f"base/{done[-1]}.json")) if done else set()
        return done[-1] if done else None, [x for x in self.files.names("data") if x not in inside]

    def _read(self, base: str | None, own: list[str]) -> DataFrame:
        paths = [f"{self.root}/base/{base}"] * (base is not None) + [f"{self.root}/data/{x}" for x in own]
        return self.spark.read.schema(self.log_schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.log_schema)

    def log(self) -> DataFrame:
        return self._read(*self._now())

    def view(self) -> DataFrame:
        return latest(self.log()).select(*self.schema.fieldNames())

    def get(self, key) -> DataFrame:
        """The filter on the key reaches the scan: only its writes are aggregated."""
        return latest(self.log().where(F.col(KEY) == F.lit(key))).select(*self.schema.fieldNames())

    def compact(self) -> None:
        """Writes the newest row of each key, sorted by key, with the number that it had.

        Deletions go, unless an append of a lower number than theirs may still come.
        """
        base, own = self._now()
        inside = set(own) | (set(self.files.read(f"base/{base}.json")) if base else set())
        n = self._number()
        done = {x.removesuffix(".json") for x in self.files.names("base")}
        waiting = [x for x in self.files.names("numbers") if int(x) < n and x not in inside and x not in done]
        rows = latest(self._read(base, own), live=not waiting)
        # The list comes first: a compaction counts once its folder is there.
        self.files.write(f"base/{n:012d}.json", sorted(inside))
        self._place(rows.repartitionByRange(KEY).sortWithinPartitions(KEY), f"base/{n:012d}")

    def vacuum(self) -> None:
        """Deletes what the newest compaction stands for: when no reader and no stream needs it any more."""
        base, own = self._now()
        for x in self.files.names("data") if base else ():
            if x not in own:
                self.files.delete(f"data/{x}")
        for x in self.files.names("base") if base else ():
            if not x.startswith(base):
                self.files.delete(f"base/{x}")


def as_log(df: DataFrame, key: Column, seq: Column, deleted: Column) -> DataFrame:
    """Any table as a change-log."""
    return df.withColumns({KEY: key, SEQ: seq, DELETED: deleted})
