"""Mixing sources to target weights by systematic sampling over prefix sums of expected copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common as C

#: SALTS is prime, so that strided ids spread.
WEIGHTS, MOST, SALTS, SEED = (5, 2, 1), 3, 1021, "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(source, source_size, n, target, shift) from (source, size): one row per source.

    Targets share the total by weight; those above ``most`` times their source's size stop there and the excess is
    shared again, until none is above.  Each round is one aggregate over the sources; only its sums reach the driver.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # The rank by code point, null last: a range sort, counts per partition, then ranks within partitions.
    spread = C.materialize(by.withColumn("last", F.col("source").isNull()).repartitionByRange(C.parts(by.sparkSession), "last", "source").sortWithinPartitions("last", "source").withColumn("part", F.spark_partition_id()), "mix-sources")
    before = spread.groupBy("part").agg(F.count("*").alias("in_part")).withColumn("before", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    table = C.materialize(spread.join(before.select("part", "before"), "part").select("source", "source_size", "n", weight.alias("weight")), "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # Words times weights are beyond 32 bits in a corpus of some GB, and times the weights of many sources beyond 64.
    whole = lambda x: F.col(x).cast("decimal(19,0)")
    full = F.lit(False)
    left = share = None
    while True:
        now = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if now["weight"] == 0 or (left, share) == (total - most * now["full"], now["weight"]):
            left, share = total - most * now["full"], now["weight"]
            break
        left, share = total - most * now["full"], now["weight"]
        full = whole("weight") * F.lit(left) >= whole("source_size") * F.lit(most) * F.lit(share)
    target = F.when(full, (whole("source_size") * F.lit(most)).cast("double")).otherwise((whole("weight") * F.lit(left)).cast("double") / F.lit(float(share or 1)))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return table.select("source", "source_size", "n", target.alias("target"), shift.alias("shift"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies; and row_col, a key of rows, if given.

    Every document of a source expects target / source_size copies.  Documents stand in order of (size, salt, id);
    the expected copies are summed along it, one offset for the source is added, and a document is emitted once for
    each integer that its step crosses: a source gets within a copy of its expected number from every run of sizes,
    so its words come within about one long document of the target, and no document gets more than ``most`` copies.
    A source of any size is split by (size, salt): only counts cross between those groups.  Null text has size 0;
    a null source is a source of its own and comes last; null ids come first in their group; repeated rows are
    documents of their own; sources without words have target 0 and take nothing.  Other columns are ignored.
    """
    # Rows of null ids, which only differ by source and size, are spread before all others.
    key = [row_col] if row_col else []
    salt = F.coalesce(F.pmod(F.col("doc_id"), F.lit(SALTS)), -1 - F.pmod(F.col(row_col) if row_col else F.monotonically_increasing_id(), F.lit(SALTS)))
    sized = C.materialize(docs.select(*key, F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size")).withColumn("salt", salt), "mix-sizes")
    sources = C.materialize(source_targets(sized, weights, most, seed), "mix-targets")
    # The counts before each (source, size, salt): first of sizes, one row per distinct size, then of salts within a size.
    salts = sized.groupBy("source", "size", "salt").agg(F.count("*").alias("here"))
    within = salts.withColumn("before_salt", F.sum("here").over(Window.partitionBy("source", "size").orderBy("salt")) - F.col("here"))
    sizes = salts.groupBy("source", "size").agg(F.sum("here").alias("here")).withColumn("before_size", F.sum("here").over(Window.partitionBy("source").orderBy("size")) - F.col("here")).select("source", "size", "before_size")
    ranked = sized.withColumn("at", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id", *key)))
    same = lambda a, b, *names: [a[x].eqNullSafe(b[x]) for x in names]
    starts = within.join(sizes, same(within, sizes, "source", "size")).select(within["source"], within["size"], within["salt"], (F.col("before_salt") + F.col("before_size")).alias("before"))
    placed = ranked.join(starts, same(ranked, starts, "source", "size", "salt")).select(*[ranked[k] for k in key], ranked["doc_id"], ranked["source"], ranked["size"], (F.col("at") + F.col("before")).alias("rank"))
    named = lambda df: df.withColumn("name", F.md5(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).cast("binary"))).drop("source")
    out = C.join_groups(named(placed), named(sources), ["name"], "n", 100)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    step = lambda k: F.floor(k.cast("double") * rate + F.col("shift"))
    copies = (step(F.col("rank")) - step(F.col("rank") - 1)).cast("long")
    return out.select(*key, "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, 3 * source_size / weight::DOUBLE AS ratio FROM w),
p AS (SELECT *, (sum(source_size) OVER ())::BIGINT - 3 * coalesce((sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS rest,
  (sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS share FROM o),
f AS (SELECT *, weight * rest >= 3 * source_size * share AS capped FROM p),
r AS (SELECT (sum(source_size))::BIGINT - 3 * coalesce((sum(source_size) FILTER (WHERE capped))::BIGINT, 0) AS rest, (sum(weight) FILTER (WHERE NOT capped))::BIGINT AS share FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (weight * r.rest)::DOUBLE / r.share::DOUBLE END AS target,
  ('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'n')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift FROM f, r),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, coalesce(d.doc_id % 1021, -1), d.doc_id NULLS FIRST)::DOUBLE AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rank * rate + shift) - floor((rank - 1) * rate + shift))::BIGINT * size AS taken,
  (floor(rank * rate + shift) - floor((rank - 1) * rate + shift))::BIGINT AS copies FROM k
"""
