"""Connected components of any number of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Edges that one task may finish: 16 bytes each.
ONE_TASK = 2_000_000


class Forest:
    """Union-find over integers; the least of a component is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        at = x
        while (y := up.get(at, at)) != at:
            at = y
        while (y := up.get(x, x)) != at:
            up[x], x = at, y
        return at

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contracted(it):
    """The edges of a partition as stars around their local roots."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    f = Forest()
    nodes: set[int] = set()
    for b in it:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f.join(x, y)
            nodes.add(x)
            nodes.add(y)
    pairs = [(x, r) for x in nodes if (r := f.root(x)) != x]
    if pairs:
        yield C.table(schema, *map(list, zip(*pairs)))


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for each node of edges (a, b) that isn't the least of its component.

    While there are more than ``one_task`` edges, rounds of large and small stars hang each node to the least of its
    neighbours, all distributed and each written; what is left, bounded, is finished in one task.  The result is the
    same whichever round ends it.
    """
    now = C.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("sum")).first()
        if state["n"] <= one_task:
            return C.materialize(now.coalesce(1).mapInArrow(_contracted, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = C.materialize(small.where("a <> b").distinct(), "edges")
