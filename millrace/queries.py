"""The registered queries of the engine's operators and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.embed import Embedder
from millrace.functions.text import tokens
from millrace.operators.fts import TextIndex
from millrace.operators.hybrid import fuse
from millrace.operators.quantize import Pq, QuantizedIndex, Sq8
from millrace.operators.vector import IvfIndex, VectorIndex
from millrace.plans.predicate import cond
from millrace.sources.changelog import DELETED, KEY, SEQ, ChangeLog, as_log, latest
from millrace.sources.engine import Engine
from millrace.sources.shared import fresh_path
from millrace.streaming.tail import follow, followed

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def engine(spark: SparkSession, d: str) -> Engine:
    e = Engine(spark)
    for name, key in KEYS.items():
        e.register(name, spark.read.parquet(f"{d}/{name}.parquet"), key)
    return e


def simple(name: str, table: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, d: build(engine(spark, d).query(table)).to_df()
    SQL[name] = sql


simple("scan_all", "region", lambda q: q, "SELECT * FROM region")
simple("filter_eq_string", "customer", lambda q: q.filter("c_mktsegment", "=", "BUILDING"), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
simple("filter_ne", "orders", lambda q: q.filter("o_orderstatus", "!=", "F"), "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
simple("filter_gt_int", "part", lambda q: q.filter("p_size", ">", "25"), "SELECT * FROM part WHERE p_size > 25")
simple("filter_ge_double", "orders", lambda q: q.filter("o_totalprice", ">=", "250000.5"), "SELECT * FROM orders WHERE o_totalprice >= 250000.5::DOUBLE")
simple("filter_lt", "customer", lambda q: q.filter("c_acctbal", "<", 0), "SELECT * FROM customer WHERE c_acctbal < 0")
simple("filter_le", "part", lambda q: q.filter("p_size", "<=", 10), "SELECT * FROM part WHERE p_size <= 10")
simple("filter_string_range", "customer", lambda q: q.filter("c_mktsegment", ">=", "B").filter("c_mktsegment", "<", "G"), "SELECT * FROM customer WHERE c_mktsegment >= 'B' AND c_mktsegment < 'G'")
simple("cond_and", "part", lambda q: q.where(cond("p_size", ">", 10) & cond("p_size", "<", 20)), "SELECT * FROM part WHERE p_size > 10 AND p_size < 20")
simple("cond_or", "part", lambda q: q.where(cond("p_size", "<", 5) | cond("p_retailprice", ">", 1800)), "SELECT * FROM part WHERE p_size < 5 OR p_retailprice > 1800")
simple("cond_not", "orders", lambda q: q.where(~cond("o_orderstatus", "=", "O")), "SELECT * FROM orders WHERE NOT o_orderstatus = 'O'")
simple("cond_nested", "part", lambda q: q.where(~(cond("p_size", ">", 18) & (cond("p_size", "<", 20) | cond("p_brand", "=", "Brand#12")))), "SELECT * FROM part WHERE NOT (p_size > 18 AND (p_size < 20 OR p_brand = 'Brand#12'))")
simple("where_replaces", "part", lambda q: q.filter("p_size", "<", 3).where(cond("p_size", ">", 40)).filter("p_size", "<", 45), "SELECT * FROM part WHERE p_size > 40 AND p_size < 45")
simple("filter_unknown_column", "part", lambda q: q.filter("nothing", "=", 1), "SELECT * FROM part WHERE false")
simple("int_literal_truncation", "part", lambda q: q.filter("p_size", ">", "25.7"), "SELECT * FROM part WHERE p_size > 25")
simple("sort_asc_limit", "orders", lambda q: q.sort("o_totalprice").limit(40), "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 40")
simple("sort_desc_limit", "orders", lambda q: q.sort("o_totalprice", 0).limit(40), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
simple("limit_zero", "orders", lambda q: q.limit(0), "SELECT * FROM orders LIMIT 0")
simple("filter_sort_limit", "orders", lambda q: q.filter("o_totalprice", ">", 400000).sort("o_totalprice", False).limit(50), "SELECT * FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
simple("join_left_outer", "orders", lambda q: q.join("customer", "o_custkey", "c_custkey"), "SELECT o.*, c.* EXCLUDE (c_custkey) FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey")
simple("join_after_limit", "orders", lambda q: q.sort("o_totalprice", False).limit(50).join("customer", "o_custkey", "c_custkey"), "SELECT o.*, c.* EXCLUDE (c_custkey) FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) o LEFT JOIN customer c ON o_custkey = c_custkey")


@query("SELECT n.*, r_name FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey")
def join_unmatched_kept(spark, d):
    e = engine(spark, d)
    return e.register("some", e.query("region").filter("r_regionkey", "<", 3).to_df(), "r_regionkey").query("nation").join("some", "n_regionkey", "r_regionkey").to_df()


def _log(spark, d) -> DataFrame:
    return as_log(spark.read.parquet(f"{d}/events.parquet"), F.col("user_id"), F.struct("ts", "event_id"), F.col("event_type") == "error")


LATEST = "SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type {} 'error'"


@query(LATEST.format("<>"))
def changelog_latest(spark, d):
    return latest(_log(spark, d)).drop(KEY, SEQ, DELETED)


@query("SELECT user_id FROM (" + LATEST.format("=") + ")")
def changelog_delete(spark, d):
    log = _log(spark, d)
    return log.select("user_id").distinct().join(latest(log).select("user_id"), "user_id", "left_anti")


@query(LATEST.format("<>") + " AND user_id = 7")
def changelog_get(spark, d):
    return latest(_log(spark, d).where(F.col(KEY) == 7)).drop(KEY, SEQ, DELETED)


@query(LATEST.format("<>"))
def changelog_compact(spark, d):
    rows = latest(_log(spark, d))
    return rows.repartitionByRange(KEY).sortWithinPartitions(KEY).drop(KEY, SEQ, DELETED)


def orders_log(spark, d) -> ChangeLog:
    """Stored: all orders, then those that are done at another price, then without the urgent ones, then two of them again."""
    own = spark.read.parquet(f"{d}/orders.parquet")
    log = ChangeLog.create(spark, fresh_path(spark, "orders-log"), own.schema, "o_orderkey")
    log.put(own)
    log.put(own.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1))
    log.delete(own.where("o_orderpriority = '1-URGENT'").select("o_orderkey"))
    log.put(own.where("o_orderpriority = '1-URGENT' and o_orderkey % 2 = 0"))
    return log


PUT = "SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE (o_orderpriority <> '1-URGENT' OR o_orderkey % 2 = 0)"


@query(PUT)
def table_put_delete(spark, d):
    return orders_log(spark, d).view()


@query(PUT + " AND o_orderkey = 32")
def table_get(spark, d):
    return orders_log(spark, d).get(32)


@query(PUT)
def table_compact(spark, d):
    log = orders_log(spark, d)
    log.compact()
    log.vacuum()
    return ChangeLog(spark, log.root).view()


@query(PUT)
def stream_follow(spark, d):
    """A stream that is stopped, and goes on after the table was compacted and written to."""
    log, target, kept = orders_log(spark, d), fresh_path(spark, "followed"), fresh_path(spark, "follow-state")
    follow(spark, log, target, kept).awaitTermination()
    log.put(log.view().where("o_orderstatus = 'O'").withColumn("o_totalprice", F.lit(0.0)))
    log.compact()
    log.put(spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'O' and (o_orderpriority <> '1-URGENT' or o_orderkey % 2 = 0)"))
    follow(spark, log, target, kept).awaitTermination()
    return followed(spark, log, target)


LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = "list_filter(regexp_extract_all(" + LOW + ", '[a-z0-9'']+'), lambda x: len(x) >= 2)"
STOP = ["the", "and", "of", "de", "la", "die", "der"]
T = f"WITH t AS (SELECT doc_id, {TOKENS} AS ts FROM documents), p AS (SELECT doc_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos, len(ts) AS dl FROM t), c AS (SELECT term, doc_id, count(*) AS tf, dl FROM p GROUP BY term, doc_id, dl), s AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM t)"
BM25 = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
SCORED = f", f AS (SELECT term, count(*)::DOUBLE AS df FROM c GROUP BY term), b AS (SELECT c.term, doc_id, {BM25} AS s FROM c JOIN f USING (term), s)"


def docs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def text_index(spark, d, **o) -> TextIndex:
    return TextIndex.build(docs(spark, d), "doc_id", ["text"], **o)


def found(spark, d, q: str) -> DataFrame:
    return text_index(spark, d).search(q).select("doc_id", F.round("score", 6).alias("score"))


@query(T + " SELECT doc_id, term, pos::INTEGER AS pos FROM p")
def fts_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term")).select("doc_id", "term", "pos")


STEM = "CASE " + " ".join(f"WHEN w LIKE '%{s}' THEN {len(s)}" for s in ("ing", "ed", "ly", "es", "s", "er", "or")) + " ELSE 0 END"


@query(f"""WITH w AS (SELECT unnest(regexp_extract_all({LOW}, '[a-z0-9'']+')) AS w FROM documents), c AS (SELECT w, len(w) - ({STEM}) AS k FROM w),
r AS (SELECT CASE WHEN k = len(w) OR k < 3 THEN w WHEN substr(w, k, 1) = substr(w, k - 1, 1) AND regexp_matches(substr(w, k, 1), '[a-z]') THEN substr(w, 1, k - 1) ELSE substr(w, 1, k) END AS term FROM c)
SELECT term, count(*) AS n FROM r WHERE len(term) >= 2 GROUP BY term""")
def fts_stem(spark, d):
    return docs(spark, d).select(F.explode(tokens(F.col("text"), stemming=True)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(T + f" SELECT term, count(*) AS n FROM p WHERE term NOT IN ({', '.join(repr(x) for x in STOP)}) GROUP BY term")
def fts_stopwords(spark, d):
    return docs(spark, d).select(F.explode(tokens(F.col("text"), stopwords=STOP)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(T + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM c GROUP BY term")
def fts_vocabulary(spark, d):
    return text_index(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(T + " SELECT doc_id, tf FROM c WHERE term = 'thing'")
def fts_term(spark, d):
    return text_index(spark, d).postings.where(F.col("term") == "thing").select("doc_id", "tf")


@query(T + " SELECT DISTINCT term FROM c WHERE term LIKE 'ther%'")
def fts_prefix(spark, d):
    return text_index(spark, d).prefix("ther")


@query(T + " SELECT DISTINCT term FROM c WHERE levenshtein(term, 'that') <= 1")
def fts_fuzzy(spark, d):
    return text_index(spark, d).fuzzy("that", 1)


def fts(name: str, q: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: found(spark, d, q)
    SQL[name] = T + SCORED + sql


fts("fts_bm25_or", "thing reon", " SELECT doc_id, round(sum(s), 6) AS score FROM b WHERE term IN ('thing', 'reon') GROUP BY doc_id")
fts("fts_and", "that AND thing", " SELECT doc_id, round(sum(s), 6) AS score FROM b WHERE term IN ('that', 'thing') GROUP BY doc_id HAVING count(*) = 2")
fts("fts_not", "that NOT thing", " SELECT doc_id, round(s, 6) AS score FROM b WHERE term = 'that' AND doc_id NOT IN (SELECT doc_id FROM c WHERE term = 'thing')")
fts("fts_phrase", '"of the"', " SELECT doc_id, round(sum(s), 6) AS score FROM b WHERE term IN ('of', 'the') AND doc_id IN (SELECT x.doc_id FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 WHERE x.term = 'of' AND y.term = 'the') GROUP BY doc_id")
fts("fts_range", "[thin TO thong]", " SELECT doc_id, round(sum(s), 6) AS score FROM b WHERE term BETWEEN 'thin' AND 'thong' GROUP BY doc_id")
fts("fts_boost", "thing^2.5 reon", " SELECT doc_id, round(sum(CASE term WHEN 'thing' THEN 2.5::DOUBLE * s ELSE s END), 6) AS score FROM b WHERE term IN ('thing', 'reon') GROUP BY doc_id")
fts("fts_fuzzy_search", "thing~1", " SELECT doc_id, round(sum(s), 6) AS score FROM b WHERE levenshtein(term, 'thing') <= 1 GROUP BY doc_id")


def stored_index(spark, d) -> TextIndex:
    return text_index(spark, d).save(fresh_path(spark, "text-index"))


@query(SQL["fts_bm25_or"])
def fts_stored_or(spark, d):
    return stored_index(spark, d).search("thing reon").select("doc_id", F.round("score", 6).alias("score"))


@query(SQL["fts_phrase"])
def fts_stored_phrase(spark, d):
    return stored_index(spark, d).search('"of the"').select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH a AS (SELECT doc_id, 'lang' AS field, lang AS text FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents), t AS (SELECT doc_id, field, {TOKENS} AS ts FROM a), c AS (SELECT field, unnest(ts) AS term, doc_id, 1.0::DOUBLE AS tf, len(ts) AS dl FROM t), f AS (SELECT field, term, count(*)::DOUBLE AS df FROM c GROUP BY field, term), s AS (SELECT field, count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM t GROUP BY field) SELECT doc_id, round({BM25}, 6) AS score FROM c JOIN f USING (field, term) JOIN s USING (field) WHERE field = 'lang' AND term = 'de'")
def fts_field(spark, d):
    return TextIndex.build(docs(spark, d), "doc_id", ["lang", "source"]).search("lang:de").select("doc_id", F.round("score", 6).alias("score"))


def vectors(spark, d, **o) -> VectorIndex:
    return VectorIndex.of(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", **o)


def first(spark, d) -> list[float]:
    return vectors(spark, d).fetch(1)


Q = "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 1), "
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
L2 = "list_sum(list_transform(list_zip(embedding, e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
COS = f"1 - {DOT.format('embedding', 'e')} / sqrt({DOT.format('embedding', 'embedding')} * {DOT.format('e', 'e')})"
IP = f"-{DOT.format('embedding', 'e')}"
TOP = Q + "v AS (SELECT vec_id AS id, {} AS d, label FROM embeddings, q) SELECT id, round(d, 6) AS distance FROM v {} ORDER BY d, id LIMIT {}"


def near(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


@query(TOP.format(L2, "", 10))
def vec_l2_topk(spark, d):
    return near(vectors(spark, d).search(first(spark, d), 10))


@query(TOP.format(COS, "", 10))
def vec_cosine_topk(spark, d):
    return near(vectors(spark, d, metric="cosine").search(first(spark, d), 10))


@query(TOP.format(IP, "", 10))
def vec_ip_topk(spark, d):
    return near(vectors(spark, d, metric="ip").search(first(spark, d), 10))


@query(TOP.format(L2, "WHERE d <= 1.7", 0).removesuffix(" LIMIT 0"))
def vec_radius(spark, d):
    return near(vectors(spark, d).search_radius(first(spark, d), 1.7))


@query(TOP.format(L2, "WHERE id % 2 = 0", 10))
def vec_filtered(spark, d):
    return near(vectors(spark, d).search(first(spark, d), 10, F.col("id") % 2 == 0))


@query("SELECT vec_id AS id, (unnest(range(0, len(embedding))))::INTEGER AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings WHERE vec_id = 1")
def vec_get(spark, d):
    return vectors(spark, d).get(1).select("id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@query("SELECT count(*) AS count FROM embeddings")
def vec_count(spark, d):
    return vectors(spark, d).count()


@query("SELECT count(*) AS count, max(len(embedding))::INTEGER AS dim, (count(*) * (4 * max(len(embedding)) + 8))::BIGINT AS memory_bytes FROM embeddings")
def vec_stats(spark, d):
    return vectors(spark, d).stats()


@query(TOP.format(L2, "WHERE id NOT IN (1, 2, 3)", 10))
def vec_delete(spark, d):
    return near(vectors(spark, d).delete([1, 2, 3]).search(first(spark, d), 10))


@query("WITH x AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT qid, vec_id AS id, " + L2 + " AS d FROM embeddings, x), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS k FROM v) SELECT qid, id, round(d, 6) AS distance FROM r WHERE k <= 5")
def vec_batch_knn(spark, d):
    i = vectors(spark, d)
    return near(i.batch_knn(i.df.where(F.col("id") % 20 == 0).withColumnRenamed("id", "qid"), 5))


FUSED = T + SCORED + ", q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 1), d0 AS (SELECT vec_id AS id, " + L2 + " AS d FROM embeddings, q), vt AS (SELECT * FROM d0 ORDER BY d, id LIMIT 20), v AS (SELECT *, row_number() OVER (ORDER BY d, id) AS rv FROM vt), bt AS (SELECT doc_id AS id, sum(s) AS s FROM b WHERE term IN ('thing', 'reon') GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 20), w AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rf FROM bt), j AS (SELECT coalesce(v.id, w.id) AS id, {} AS score, coalesce(d, 0) AS dd, coalesce(s, 0) AS ss FROM v FULL JOIN w ON v.id = w.id) SELECT id, round(score, 6) AS score, round(dd, 6) AS vec_distance, round(ss, 6) AS fts_score FROM j ORDER BY j.score DESC, id LIMIT 15"


def _hybrid(spark, d, mode: str) -> DataFrame:
    text = text_index(spark, d).search("thing reon").select(F.col("doc_id").alias("id"), "score").orderBy(F.col("score").desc(), "id").limit(20)
    out = fuse(vectors(spark, d).search(first(spark, d), 20), text, mode, 0.7, 0.3, 15)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("score", "vec_distance", "fts_score")])


@query(FUSED.format("coalesce(0.7::DOUBLE / (60 + rv), 0) + coalesce(0.3::DOUBLE / (60 + rf), 0)"))
def hybrid_rrf(spark, d):
    return _hybrid(spark, d, "rrf")


@query(FUSED.format("CASE WHEN d IS NULL THEN 0 ELSE 0.7::DOUBLE * (1 - least(d, 1)) END + CASE WHEN s IS NULL THEN 0 ELSE 0.3::DOUBLE * s END"))
def hybrid_weighted(spark, d):
    return _hybrid(spark, d, "weighted")


@query(FUSED.format("coalesce(0.7::DOUBLE / (60 + rv), 0) + coalesce(0.3::DOUBLE / (60 + rf), 0)"))
def hybrid_search(spark, d):
    """The same by the engine: an index of each kind, searched and fused."""
    e = engine(spark, d).vec_create_index(len(first(spark, d)))
    e.vec_insert_batch(vectors(spark, d).df)
    e.fts_create_index("documents", "text")
    out = e.hybrid_search("documents", "text", "thing reon", first(spark, d), 20, vector_weight=0.7, fts_weight=0.3, most=15)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("score", "vec_distance", "fts_score")])


@query(TOP.format(L2, "WHERE id > 3 OR id < 1", 10))
def vec_engine(spark, d):
    """Inserted twice, the first time wrongly, some deleted."""
    own = vectors(spark, d).df
    e = engine(spark, d).vec_create_index(len(first(spark, d)))
    e.vec_insert_batch(own.withColumn("embedding", F.transform("embedding", lambda x: x * 2)))
    e.vec_insert_batch(own)
    for k in (1, 2, 3):
        e.vec_delete(k)
    return near(e.vec_search(first(spark, d), 10))


CODES = "WITH x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS dim FROM embeddings), m AS (SELECT dim, min(v) AS lo, CASE WHEN max(v) = min(v) THEN 1 ELSE max(v) - min(v) END AS span FROM x GROUP BY dim), c AS (SELECT id, dim, lo, span, floor(greatest(least((v - lo) / span, 1), 0) * 255 + 0.5::DOUBLE)::INTEGER AS code FROM x JOIN m USING (dim))"


def quantized(spark, d) -> QuantizedIndex:
    df = vectors(spark, d).df
    return QuantizedIndex(df, Sq8.train(df))


@query(CODES + " SELECT id, dim::INTEGER AS dim, code FROM c")
def quant_sq8_codes(spark, d):
    return quantized(spark, d).df.select("id", F.posexplode("code").alias("dim", "code"))


@query(CODES + " SELECT id, dim::INTEGER AS dim, round(lo + code / 255.0::DOUBLE * span, 6) AS value FROM c WHERE id = 1")
def quant_sq8_decode(spark, d):
    q = quantized(spark, d)
    return q.df.where("id = 1").select("id", F.posexplode(q.quantizer.decode(F.col("code"))).alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(CODES + ", w AS (SELECT id, dim, lo + code / 255.0::DOUBLE * span AS y FROM c), z AS (SELECT a.id, sum((a.y - b.y) * (a.y - b.y)) AS dist FROM w a JOIN w b ON a.dim = b.dim AND b.id = 1 GROUP BY a.id) SELECT id, round(dist, 6) AS distance FROM z ORDER BY dist, id LIMIT 10")
def quant_sq8_topk(spark, d):
    return near(quantized(spark, d).search(first(spark, d), 10))


@query()
def quant_pq_topk(spark, d):
    df = vectors(spark, d).df
    return near(QuantizedIndex(df, Pq.train(df, 8)).search(first(spark, d), 10))


@query()
def embed_text(spark, d):
    return docs(spark, d).select("doc_id", Embedder(64)(F.col("text")).alias("embedding"))


def _texts(spark, d) -> VectorIndex:
    e = Embedder(64)
    return VectorIndex(docs(spark, d).select(F.col("doc_id").alias("id"), e(F.col("text")).alias("embedding")), 64, "cosine", e)


@query()
def search_text(spark, d):
    return near(_texts(spark, d).search_text("the thing of that", 10))


@query()
def search_text_filtered(spark, d):
    return near(_texts(spark, d).search_text("the thing of that", 10, F.col("id") % 2 == 0))


@query()
def ann_ivf_topk(spark, d):
    return near(IvfIndex(vectors(spark, d), 16).search(first(spark, d), 10, 8))


@query()
def ann_ivf_knn(spark, d):
    """Every row whose id is divisible by 20 against all rows, from stored cells."""
    i = IvfIndex(vectors(spark, d), 16).save(fresh_path(spark, "ivf"))
    return near(i.batch_knn(i.index.df.where(F.col("id") % 20 == 0).withColumnRenamed("id", "qid"), 10, 8))
