"""The folder that all executors share, and files in it by the session's Hadoop file system."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError

_scratch: set[str] = set()


class Files:
    """Paths by the Hadoop file system of the session: local, HDFS or another with atomic renames."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def claim(self, name: str) -> bool:
        """Makes an empty file unless it is there already: of several callers one gets True."""
        try:
            self.fs.create(self.path(name), False).close()
            return True
        except (Py4JJavaError, PySparkException):
            if self.exists(name):
                return False
            raise

    def write(self, name: str, value) -> None:
        """A JSON file, written beside and renamed; one that is there already stays as it is."""
        temp = self.path(f"_{uuid.uuid4().hex}")
        out = self.fs.create(temp)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not self.rename(temp, self.path(name)):
            self.fs.delete(temp, False)

    def rename(self, a, b) -> bool:
        return not self.fs.exists(b) and (self.fs.mkdirs(b.getParent()) and self.fs.rename(a, b))

    def read(self, name: str):
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name))) if self.exists(name) else []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own where that is unset and the session is local, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/") + "/millrace"


def fresh_path(spark: SparkSession, tag: str, kept: bool = False) -> str:
    """A new path in the shared folder.  Unless it is to be kept, it goes with the application."""
    if kept:
        return f"{shared_dir(spark)}/kept/{tag}-{uuid.uuid4().hex}"
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if own not in _scratch:
        _scratch.add(own)
        atexit.register(_drop, Files(spark, own))
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def _drop(files: Files) -> None:
    """At the driver's end; if the JVM went first the folder stays, under the application's name."""
    with contextlib.suppress(Exception):
        files.fs.delete(files.path(), True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
