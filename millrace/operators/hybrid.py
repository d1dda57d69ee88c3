"""Fusion of a vector ranking and a text ranking: two top-k lists and a full outer join of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import INVAL, EngineError
from millrace.operators.fts import TextIndex
from millrace.operators.vector import VectorIndex

RRF = 60


def fuse(vec: DataFrame, fts: DataFrame, mode: str = "rrf", vector_weight: float = 0.5, fts_weight: float = 0.5, most: int = 10) -> DataFrame:
    """(id, score, vec_distance, fts_score) from vec (id, distance) and fts (id, score): two lists that are top-k already.

    An id that a list repeats counts with its best rank; what is absent is 0.
    """
    if mode not in ("rrf", "weighted"):
        raise EngineError(INVAL, mode)
    v = vec.groupBy("id").agg(F.min("distance").alias("d")).withColumn("rv", F.row_number().over(Window.orderBy("d", "id")))
    f = fts.groupBy("id").agg(F.max("score").alias("s")).withColumn("rf", F.row_number().over(Window.orderBy(F.col("s").desc(), "id")))
    both = v.join(f, "id", "full_outer")
    if mode == "rrf":
        part = lambda w, r: F.coalesce(F.lit(float(w)) / (RRF + F.col(r)), F.lit(0.0))
        score = part(vector_weight, "rv") + part(fts_weight, "rf")
    else:
        near = F.when(F.col("d").isNotNull(), F.lit(float(vector_weight)) * (1 - F.least(F.col("d"), F.lit(1.0)))).otherwise(0.0)
        score = near + F.when(F.col("s").isNotNull(), F.lit(float(fts_weight)) * F.col("s")).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select("id", score.alias("score"), zero("d").alias("vec_distance"), zero("s").alias("fts_score")).orderBy(F.col("score").desc(), "id").limit(most)


def hybrid_search(vectors: VectorIndex, texts: TextIndex, fts_query: str, query, k: int = 10, **options) -> DataFrame:
    k = k or 10
    fts = texts.search(fts_query).select(F.col("doc_id").cast("long").alias("id"), "score").orderBy(F.col("score").desc(), "id").limit(k)
    return fuse(vectors.search(query, k), fts, most=options.pop("most", k), **options)
