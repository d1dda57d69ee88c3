"""Readers of a change-log: a file stream and an upsert of each micro-batch into a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.changelog import KEY, SEQ, ChangeLog, latest
from millrace.sources.shared import Files


def tail(spark: SparkSession, log: ChangeLog, files_per_batch: int | None = None) -> DataFrame:
    """The appended batches as a stream; deletions are in it too.  Compactions don't touch what it watches."""
    reader = spark.readStream.schema(log.log_schema).option("recursiveFileLookup", "true")
    log.files.fs.mkdirs(log.files.path("data"))
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{log.root}/data")


def follow(spark: SparkSession, log: ChangeLog, target: str, checkpoint: str, every: str | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """Applies the stream to ``target``: a folder with one sub-folder per micro-batch, each replaced as a whole when a
    batch is repeated after a crash, so that every write counts once.  Read it with ``followed``."""

    def apply(batch: DataFrame, number: int) -> None:
        # The newest write of each key in the batch is enough for the state.
        latest(batch, live=False).write.mode("overwrite").parquet(f"{target}/batch={number:09d}")

    writer = tail(spark, log, files_per_batch).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def followed(spark: SparkSession, log: ChangeLog, target: str) -> DataFrame:
    """The table as far as it was followed.  Writes carry their numbers, so batches and repeats meet in any order."""
    if not Files(spark, target).names():
        return spark.createDataFrame([], log.schema)
    return latest(spark.read.schema(log.log_schema).option("recursiveFileLookup", "true").parquet(target), KEY, SEQ).select(*log.schema.fieldNames())
