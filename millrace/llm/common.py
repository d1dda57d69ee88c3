"""What the corpus operators share: written tables, checked broadcasts, words and bytes of texts, columns that rows carry."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.shared import fresh_path, materialize, shared_dir  # noqa: F401

#: Tables are broadcast up to so many bytes, counted as rows times the bytes of a row; beyond it the join shuffles.
BROADCAST_BYTES = 24_000_000

#: Upper case A-Z to lower case and everything but letters, digits and non-ASCII bytes to a space.
ITEM_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def fits(small: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> bool:
    """Whether a materialized table is within the bound of what is broadcast: its counted rows times ``row_bytes``."""
    return small.count() * row_bytes <= bound


def checked(small: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a materialized table for broadcast if it fits; else joins shuffle it."""
    return F.broadcast(small) if fits(small, row_bytes, bound) else small


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, row_bytes: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """rows left join groups, of which a row each has how many of the rows it meets.

    Groups within the bound are broadcast.  Beyond it those that meet more than a thousandth of all rows still are: they
    are a thousand at most.  What is left shuffles, and no key of it is hot.
    """
    if fits(groups, row_bytes, bound):
        return rows.join(F.broadcast(groups), keys, "left")
    hot = F.col(size) * 1000 > rows.count()
    few = groups.where(hot)
    rest = rows.join(F.broadcast(few.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(few), keys).unionByName(rest.join(groups.where(~hot), keys, "left"))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def words_of(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of a column of texts: for each its place among the distinct ones, words a text, distinct ones.

    Null has no words.  lower: A-Z are lower-cased first.  No word is an object of its own but the distinct ones.
    """
    # A copy that starts at its buffers' start: pyarrow 23 lower-cases others wrongly after a cast.
    column = pa.concat_arrays([column.slice(0, 0), column]).fill_null("")
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(column) if lower else column))
    sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
    if b"" in words:  # the one word that splitting nothing gives
        none = at == words.index(b"")
        sizes[np.repeat(np.arange(len(sizes)), sizes)[none]] = 0
        at = at[~none]
    return at, sizes, words


def carried(docs: DataFrame, text_col: str, carry: bool) -> tuple[list, int, T.StructType]:
    """(columns, place of the text among them, their schema): all of docs under names of their own, or the text alone.

    They go through Python as they are, so a filter by what an operator finds of a row needs no join by its id.
    """
    names = docs.columns if carry else [text_col]
    own = [F.col(f"`{x}`").alias(f"__c{k}") for k, x in enumerate(names)]
    types = docs.select([F.col(f"`{x}`") for x in names]).schema
    return own, names.index(text_col), T.StructType([T.StructField(f"__c{k}", f.dataType) for k, f in enumerate(types)])


def restored(docs: DataFrame) -> list:
    """The carried columns under the names that they had."""
    return [F.col(f"__c{k}").alias(x) for k, x in enumerate(docs.columns)]


def fields(schema: T.StructType, more: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def batches(it: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that long texts don't add up in a worker's memory."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]
