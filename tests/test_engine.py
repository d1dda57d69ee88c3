import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.errors import EXISTS, INVAL, NOTFOUND, EngineError, message
from millrace.functions.embed import Embedder, _powers, _values
from millrace.functions.text import tokens
from millrace.operators import postings
from millrace.operators.fts import TextIndex, parse
from millrace.operators.hybrid import fuse
from millrace.operators.quantize import Pq, QuantizedIndex, Sq8
from millrace.operators.vector import IvfIndex, VectorIndex, _nearest
from millrace.plans.predicate import cond
from millrace.sources.engine import Engine
from millrace.streaming.tail import follow, followed

USERS = [(1, "alice", 25), (2, "bob", 17), (3, "charlie", 30), (4, "diana", 12), (5, "eve", 22)]
COLUMNS = [("id", "int32"), ("name", "string"), ("age", "int32")]


@pytest.fixture
def users(spark):
    return Engine(spark).register("users", spark.createDataFrame(USERS, "id int, name string, age int"), "id")


@pytest.mark.parametrize(
    ("c", "n"),
    [
        (cond("age", ">", 18) & cond("age", "<", 28), 2), (cond("age", "<", 15) | cond("age", ">", 28), 2), ((cond("age", ">", 20) & cond("age", "<", 28)) | cond("age", "<", 15), 3),
        (~cond("age", ">", 20), 2), (~(cond("age", ">", 18) & (cond("age", "<", 20) | cond("name", "=", "eve"))), 4), (cond("age", ">", 25), 1), (cond("age", ">", "25.7"), 1),
        (cond("age", "=", "abc"), 0), (cond("none", "=", 1), 0), (~cond("none", "=", 1), 5), (cond("age", "?", 1), 0), (cond("name", "!=", "eve"), 4),
    ],
)
def test_conditions(users, c, n):
    assert users.query("users").where(c).to_df().count() == n


def test_null_is_two_valued(spark):
    e = Engine(spark).register("t", spark.createDataFrame([(1, None), (2, 3)], "id int, v int"), "id")
    assert e.query("t").where(~cond("v", "=", 3)).to_df().count() == 1


def test_sort_limit_and_errors(users):
    q = users.query("users")
    assert [r.age for r in q.sort("age", 0).limit(3).rows()] == [30, 25, 22]
    assert [r.age for r in q.sort("age").to_df().collect()] == [12, 17, 22, 25, 30]
    assert q.sort("none").to_df().count() == 5
    assert q.limit(0).to_df().count() == 0
    with pytest.raises(EngineError) as e:
        q.limit(-1)
    assert e.value.code == INVAL and message(-99) == "unknown error"
    assert q.filter("age", "<", 1).where(cond("age", ">", 20)).filter("age", "<", 30).to_df().count() == 2


def test_join_keeps_unmatched_and_limits_left(spark, users):
    users.register("cities", spark.createDataFrame([(25, "rome", "x"), (17, "bonn", "y")], "age int, city string, name string"), "age")
    rows = users.query("users").sort("id").limit(3).join("cities", "age", "age").to_df().collect()
    assert [(r.id, r.city) for r in rows] == [(1, "rome"), (2, "bonn"), (3, None)]
    assert rows[0].cities_name == "x"
    with pytest.raises(EngineError) as e:
        users.query("users").join("missing", "age", "age").to_df()
    assert e.value.code == NOTFOUND


def test_tables_survive_and_compact(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    e = Engine(spark, path)
    e.create_table("t", COLUMNS, "id")
    with pytest.raises(EngineError) as x:
        e.create_table("t", COLUMNS, "id")
    assert x.value.code == EXISTS
    assert e.scan("t").count() == 0
    e.put("t", USERS)
    e.put("t", [(1, "anna", 26)])
    e.delete("t", [2, 99])
    again = Engine(spark, path, read_only=True)
    assert again.get("t", 1)["name"] == "anna"
    with pytest.raises(EngineError):
        again.get("t", 2)
    with pytest.raises(EngineError):
        again.put("t", USERS)
    before = sorted(again.scan("t").collect())
    e.compact("t")
    assert sorted(Engine(spark, path).scan("t").collect()) == before and len(before) == 4
    e.put("t", [(2, "bob", 18)])
    assert e.get("t", 2)["age"] == 18


def test_stream_equals_batch(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    log = e.create_table("t", COLUMNS, "id")
    for rows in (USERS, [(1, "a", 1)], [(3, "c", 3)]):
        e.put("t", rows)
    e.delete("t", [1, 5])
    e.put("t", [(5, "back", 9)])
    for _ in range(2):
        q = follow(spark, log, f"{tmp_path}/out", f"{tmp_path}/cp", files_per_batch=2)
        q.awaitTermination(120)
        assert sorted(followed(spark, log, f"{tmp_path}/out").collect()) == sorted(log.view().collect())
        e.delete("t", [2])


@pytest.mark.parametrize(("text", "o", "want"), [("hello world", {}, ["hello", "world"]), ("running walked", {"stemming": True}, ["run", "walk"]), ("the apple", {"stopwords": ["the"]}, ["apple"]), ("Hello World", {}, ["hello", "world"]), ("", {}, []), (None, {}, []), ("a It's é x9", {}, ["it's", "x9"]), ("b" * 600 + " c " + "d" * 255 + "-ee", {}, ["b" * 255, "d" * 255, "ee"]), ("a bb ing", {"stopwords": ["bb"]}, ["ing"]), ("a bb asing", {"stemming": True}, ["bb", "asing"])])
def test_tokens(spark, text, o, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tokens(F.col("t"), **o).alias("x")).first().x == want


def test_parser():
    kinds = lambda q: [(c.kind, c.text, c.field, c.boost, c.edits) for c in parse(q).clauses]
    assert [k[0] for k in kinds("hello world")] == ["term", "term"]
    assert kinds('"hello world"')[0][:2] == ("phrase", ("hello world",))
    assert kinds("hello~2")[0][4] == 2 and kinds("hello~")[0][4] == 1
    assert kinds("hello^2.5")[0][3] == 2.5 and kinds("w^2~1")[0][3:] == (2.0, 1) and kinds("w~1^2")[0][3:] == (1.0, 1)
    assert kinds("title:hello")[0][2] == "title" and kinds('title:"a b"')[0][:3] == ("phrase", ("a b",), "title")
    assert parse("a AND b OR c NOT d").groups == [[(True, 0), (True, 1)], [(True, 2), (False, 3)]]
    assert kinds("AND x")[0][1] == ("AND",) and kinds("[a TO z]")[0][:2] == ("range", ("a", "z"))


def test_search(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple tree"), (3, "apple apple red"), (4, None), (5, "car cat bat")], "id long, text string")
    i = TextIndex.build(docs, "id", ["text"])
    ids = lambda q: sorted(r.doc_id for r in i.search(q).collect())
    assert ids("apple") == [1, 2, 3] and ids("red AND apple") == [1, 3] and ids("apple NOT red") == [2]
    assert ids('"red apple"') == [1] and ids("appel~2") == [1, 2, 3] and ids("[bat TO car]") == [5] and ids("pie tree") == [1, 2] and ids("zzz") == [] and ids("") == []
    s = {r.doc_id: r.score for r in i.search("apple^2").collect()}
    one = {r.doc_id: r.score for r in i.search("apple").collect()}
    assert all(math.isclose(s[k], 2 * one[k]) for k in s) and one[3] > one[1] > 0
    assert [r.term for r in i.prefix("ca").collect()] == ["car", "cat"] and [r.term for r in i.fuzzy("cat", 1).collect()] == ["bat", "car", "cat"]
    empty = TextIndex.build(docs.limit(0), "id", ["text"]).search("hello")
    assert [t for _, t in empty.dtypes] == ["bigint", "double"] and empty.count() == 0


def vecs(spark, rows, **o):
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    return VectorIndex(spark.createDataFrame(rows, "id long, embedding array<float>"), **o)


def test_vectors(spark):
    i = vecs(spark, [(1, [1.0, 0, 0]), (2, [0.0, 1, 0]), (3, [0.0, 0, 1]), (4, [1.0, 1, 1])])
    r = i.search([1, 0.1, 0], 2).collect()
    assert r[0].id == 1 and math.isclose(r[0].distance, 0.01, abs_tol=1e-6)
    assert vecs(spark, [(1, [0.0, 0]), (2, [1.0, 0]), (3, [0.0, 1]), (4, [3.0, 3]), (5, [5.0, 5])]).search_radius([0, 0], 1.5, 10).count() == 3
    assert vecs(spark, [(1, [2.0, 0]), (2, [1.0, 1]), (3, [1.0, 0])], metric="ip").search([1, 0], 1).first().distance == -2
    assert vecs(spark, [(1, [0.0, 0])], metric="cosine").search([1, 0], 1).first().distance == 1
    many = vecs(spark, [(k, [10.0 * k]) for k in range(1, 11)])
    assert [x.id for x in many.search([55], 10, lambda k: k % 2 == 0).collect()] == [6, 4, 8, 2, 10]
    line = vecs(spark, [(k, [float(k), 2.0 * k]) for k in range(100)])
    assert [x.id for x in line.search([50, 100], 5).collect()] == [50, 49, 51, 48, 52]
    assert line.delete([50]).search([50, 100], 1).first().id == 49
    assert line.insert(spark.createDataFrame([(7, [50.0, 100.0])], "id long, embedding array<float>")).search([50, 100], 2).collect()[0].id == 7
    got = line.batch_knn(line.df.where("id < 3").withColumnRenamed("id", "qid"), 2, block=2).collect()
    assert sorted((x.qid, x.id) for x in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 1), (2, 2)]
    with pytest.raises(EngineError):
        line.search([1, 2], 0)


def test_batch_knn_is_bounded(spark):
    """Against 10,000 rows in one batch a block of 1,024 queries takes little more memory than against 1,000; ties go to the least ids."""

    def peak(rows: int) -> int:
        import tracemalloc

        own = VectorIndex(spark.createDataFrame([(k, [float(k * 7919 % rows // 4)]) for k in range(rows)], "id long, embedding array<float>").coalesce(1))
        plans: list = []
        own.df = type("Seen", (), {"sparkSession": spark, "mapInArrow": lambda self, run, schema: plans.append(run) or spark.createDataFrame([], schema)})()
        own.batch_knn(spark.range(1024).select(F.col("id").alias("qid"), F.array(F.col("id").cast("float")).alias("embedding")), 5)
        ids = np.arange(rows)
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([[float(k * 7919 % rows // 4)] for k in ids.tolist()], pa.list_(pa.float32()))], ["id", "embedding"])
        tracemalloc.start()
        out = pa.Table.from_batches(plans[0](iter([batch]))).to_pydict()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        values = ids * 7919 % rows // 4
        for q in (0, 3, 100, 1023):
            d = (values - q) ** 2.0
            want = np.lexsort((ids, d))[:5]
            assert out["qid"][5 * q : 5 * q + 5] == [q] * 5 and out["id"][5 * q : 5 * q + 5] == want.tolist() and out["distance"][5 * q : 5 * q + 5] == d[want].tolist()
        return most

    assert peak(10_000) < 1.5 * peak(1000)


def test_nearest_has_nan_last():
    nan = math.nan
    d, i = np.array([[nan, 2.0, 1.0, 1.0], [nan, nan, nan, 0.0], [3.0, 3.0, 3.0, 3.0]]), np.array([[4, 3, 2, 1]] * 3)
    for k in (1, 2, 3, 4, 5):
        got_d, got_i = _nearest(d, i, k)
        want = np.lexsort((i, d), axis=1)[:, :k]
        assert np.array_equal(got_d, np.take_along_axis(d, want, 1), equal_nan=True) and np.array_equal(got_i, np.take_along_axis(i, want, 1))


def test_ivf_recall(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((600, 8)).astype(np.float32)
    i = vecs(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    ivf, hits = IvfIndex(i, 12), 0
    for q in x[:5]:
        hits += len({a.id for a in i.search(q, 10).collect()} & {a.id for a in ivf.search(q, 10, 8).collect()})
    assert hits / 50 >= 0.9


def test_registered_radius_gives_all(spark, tmp_path):
    rows = [(k, [k / 2000, 0.0]) for k in range(1, 1501)] + [(2000, [9.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r.id for r in queries.QUERIES["vec_radius"](spark, str(tmp_path)).collect()) == list(range(1, 1501))


def test_registered_ivf_recall(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hits, asked = 0, x[ids % 20 == 0]
    for q in asked:
        monkeypatch.setattr(queries, "first", lambda *_, q=q: q)
        got = [r.id for r in queries.QUERIES["ann_ivf_topk"](spark, d).collect()]
        assert len(set(got)) == len(got) == 10
        hits += len(set(got) & set(ids[np.lexsort((ids, ((x - q) ** 2).sum(1)))[:10]].tolist()))
    assert hits / (10 * len(asked)) >= 0.9


def test_quantizers(spark):
    df = spark.createDataFrame([(k, [float(v)] * 4) for k, v in enumerate((0, 10, 5))], "id long, embedding array<float>")
    q = QuantizedIndex(df, Sq8.train(df))
    back = QuantizedIndex(spark.createDataFrame([(9, [3.0, 7.0, 2.0, 9.0])], "id long, embedding array<float>"), q.quantizer).decode(9)
    assert max(abs(a - b) for a, b in zip(back, (3, 7, 2, 9))) < 10 / 255 + 0.01
    r = np.random.default_rng(1)
    x = np.r_[r.normal(0, 0.1, (50, 4)), r.normal(10, 0.1, (50, 4))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<float>")
    d = {a.id: a.distance for a in QuantizedIndex(df, Pq.train(df, 2)).search(x[0], 100).collect()}
    assert d[0] == 0 and min(d[k] for k in range(50, 100)) > 10 * max(d[k] for k in range(50))


def test_hybrid(spark):
    v = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id long, distance double")
    f = spark.createDataFrame([(2, 0.9), (4, 0.8), (3, 0.7)], "id long, score double")
    r = fuse(v, f).collect()
    assert {x.id for x in r} == {1, 2, 3, 4} and {x.id for x in r[:2]} == {2, 3}
    w = fuse(spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, distance double"), spark.createDataFrame([(1, 0.9), (3, 0.7)], "id long, score double"), "weighted", 0.7, 0.3).collect()
    assert w[0].id == 1 and len(w) == 3 and w[-1].vec_distance == 0


def test_embedding_reads_whole_texts(spark, tmp_path):
    texts = ["ab " * 700 + end for end in ("", "zebra", "zebra" * 30_000)]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.embedding for r in queries.QUERIES["embed_text"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert not np.allclose(got[0], got[1]) and not np.allclose(got[1], got[2])
    old = Embedder(16, most=2048)
    assert np.array_equal(old.embed(texts[1]), old.embed(texts[2])) and not np.allclose(Embedder(16).embed(texts[1]), old.embed(texts[1]))
    assert Embedder(16).segment("abc") == "a b c " == Embedder(16, dictionary=["zz"]).segment("abc")


def test_embedding(spark):
    e = Embedder(16)
    a = e.embed("hello world")
    assert np.allclose(a, Embedder(16).embed("hello world")) and math.isclose(float(np.linalg.norm(a)), 1, abs_tol=1e-5)
    assert not np.allclose(e.embed("hello"), e.embed("goodbye")) and np.linalg.norm(Embedder(16, 5).embed("ab")) > 0 and not e.embed(None).any()
    s, want = 42, []
    for _ in range(20 * 16):
        s = (s * 1103515245 + 12345) % 2**32
        want.append(((s >> 16) & 0x7FFF) / 16384 - 1)
    x, y = _powers(320)
    assert np.allclose(_values((x * np.uint64(42) + y) & np.uint64(2**32 - 1)), want) and np.allclose(e._row(19), want[19 * 16 :])
    assert Embedder(8, dictionary=["ab"]).segment("abc") == "ab c "
    i = VectorIndex(spark.createDataFrame([], "id long, embedding array<float>"), 16, "cosine", e).insert_text(spark.createDataFrame([(1, "good day"), (2, "far away")], "id long, text string"))
    assert i.search_text("good day", 1).first().id == 1


def test_writes_order_across_many_partitions(spark, tmp_path):
    """Of a batch the later row wins, in any number of partitions, and of batches the later one."""
    e = Engine(spark, f"file://{tmp_path}/db")
    e.create_table("t", [("id", "int64"), ("v", "int64")], "id")
    e.put("t", spark.range(0, 200, 1, 200).selectExpr("0L as id", "id as v"))
    assert e.get("t", 0)["v"] == 199
    e.put("t", spark.range(0, 3, 1, 1).selectExpr("0L as id", "id as v"))
    assert e.get("t", 0)["v"] == 2


def test_append_during_compaction_stays(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/db")
    log = e.create_table("t", COLUMNS, "id")
    e.put("t", USERS)
    e.delete("t", [2])
    write = log.files.write

    def late(name, value):
        write(name, value)
        monkeypatch.setattr(log.files, "write", write)
        log.put([(2, "bob", 1), (3, "late", 2)])

    monkeypatch.setattr(log.files, "write", late)
    log.compact()
    want = [(1, "alice", 25), (2, "bob", 1), (3, "late", 2), (4, "diana", 12), (5, "eve", 22)]
    assert sorted(map(tuple, log.view().collect())) == want
    number = log._number()  # a writer that took its number and hasn't written yet
    log.delete([4])
    log.compact()
    row = spark.createDataFrame([(4, {"batch": number, "part": 0, "row": 0}, False, 4, "early", 0)], log.log_schema)
    log._place(row, f"data/{number:012d}")
    assert sorted(map(tuple, log.view().collect())) == [x for x in want if x[0] != 4]
    log.compact()
    log.vacuum()
    assert sorted(map(tuple, log.view().collect())) == [x for x in want if x[0] != 4] and len(log.files.names("base")) == 2 and not log.files.names("data")
    assert not log.files.claim(f"numbers/{number:012d}")


def test_stream_goes_on_after_compaction(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    log = e.create_table("t", COLUMNS, "id")
    q = follow(spark, log, f"{tmp_path}/out", f"{tmp_path}/cp", every="200 milliseconds")
    try:
        for rows in (USERS, [(1, "a", 1)]):
            log.put(rows)
        log.compact()
        log.put([(2, "b", 2)])
        log.delete([3])
        q.processAllAvailable()
        assert sorted(followed(spark, log, f"{tmp_path}/out").collect()) == sorted(log.view().collect())
    finally:
        q.stop()


def test_reader_refreshes(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    e = Engine(spark, path)
    e.create_table("a", COLUMNS, "id")
    reader = Engine(spark, path, read_only=True)
    e.create_table("b", COLUMNS, "id")
    e.put("b", USERS)
    with pytest.raises(EngineError):
        reader.scan("b")
    reader.refresh()
    assert reader.scan("b").count() == 5 and reader.query("a").from_("b").filter("age", ">", 20).to_df().count() == 3
    reader.close()
    with pytest.raises(EngineError):
        reader.scan("b")


def test_stored_text_index(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    e = Engine(spark, path)
    e.create_table("t", [("id", "int64"), ("body", "string")], "id")
    e.put("t", [(1, "red apples fall"), (2, "green apple tree"), (3, None)])
    e.fts_create_index("t", "body", stemming=True)
    with pytest.raises(EngineError) as x:
        e.fts_create_index("t", "body")
    assert x.value.code == EXISTS
    plain = TextIndex.build(e.scan("t"), "id", ["body"], stemming=True)
    reader = Engine(spark, path, read_only=True)
    for q in ("appl", "apples", "apple NOT red", '"green apple"', "re~1", "[a TO g]", ""):
        assert sorted(map(tuple, reader.fts_search("t", "body", q).collect())) == sorted(map(tuple, plain.search(q).collect()))
    assert sorted(r.term for r in reader.fts["t", "body"].prefix("a").collect()) == sorted(r.term for r in plain.prefix("a").collect())
    e.fts_drop_index("t", "body")
    with pytest.raises(EngineError):
        Engine(spark, path).fts_search("t", "body", "apple")


def moved(spark) -> int:
    """Bytes that all stages so far wrote to shuffles or spilled."""
    stages = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in stages)


def test_stored_postings_move_once(spark, tmp_path, monkeypatch):
    """Rows (4,096 of 60 words, ids that repeat or are null) are grouped where they are, and buckets come in the order of terms."""
    monkeypatch.setattr(postings, "BUCKET", 30_000)
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("w"), F.floor(F.pow(F.pmod(F.xxhash64("n", k), F.lit(1000)) / 1000.0, 3) * 2000).cast("string")))
    docs = spark.range(4096).withColumnRenamed("id", "n").select(F.when(F.col("n") % 100 > 0, F.col("n") % 3000).alias("id"), F.when(F.col("n") % 50 > 1, F.concat_ws(" ", words)).alias("a"), F.lit("w0 w0 b").alias("b"))
    index = TextIndex.build(docs, "id", ["a", "b"])
    want = sorted(map(str, index.postings.collect()))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = moved(spark)
    stored = index.save(f"file://{tmp_path}/index")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert moved(spark) - before < 4 * sum(p.stat().st_size for p in tmp_path.rglob("postings/*.parquet"))
    assert stored.postings.dtypes == index.postings.dtypes and sorted(map(str, stored.postings.collect())) == want
    own = [r.terms for r in stored.postings.groupBy(F.input_file_name().alias("f")).agg(F.collect_list("term").alias("terms")).orderBy("f").collect()]
    assert len(own) > 5 and all(x == sorted(x) for x in own) and all(x[-1] <= y[0] for x, y in zip(own, own[1:]))
    assert sorted(map(tuple, stored.search('"w0 w0" w7').collect()), key=str) == sorted(map(tuple, index.search('"w0 w0" w7').collect()), key=str)
    assert TextIndex.build(docs.limit(0), "id", ["a"]).save(f"file://{tmp_path}/none").search("w0").count() == 0


def test_engine_vectors(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    e = Engine(spark, path)
    with pytest.raises(EngineError) as x:
        e.vec_count()
    assert x.value.code == NOTFOUND
    e.vec_create_index(16, metric="cosine")
    with pytest.raises(EngineError):
        e.vec_create_index(16)
    e.vec_insert_text(1, "good day")
    e.vec_insert_text_batch([(2, "far away"), (3, "good night"), (3, "other words")])
    e.vec_insert_vector(4, [1.0] * 16)
    with pytest.raises(EngineError) as x:
        e.vec_insert_vector(5, [1.0] * 3)
    assert x.value.code == INVAL and e.vec_count() == 4
    assert e.vec_search_text("other words", 1).first().id == 3 and e.vec_search_text_filtered("good day", 1, lambda i: i != 1).first().id != 1
    e.vec_flush()
    e.vec_delete(2)
    with pytest.raises(EngineError):
        e.vec_delete(2)
    e.vec_flush()
    again = Engine(spark, path)
    assert again.vec_count() == 3 and again.vectors.dim == 16 and again.vectors.metric == "cosine"
    again.vec_set_embed(Embedder(16))
    assert again.vec_search_text("good day", 1).first().id == 1
    e.vec_destroy_index()
    assert Engine(spark, path).vectors is None


def test_engine_quantizer(spark):
    e = Engine(spark).vec_create_index(4)
    rows = spark.createDataFrame([(k, [float(v)] * 4) for k, v in ((1, 0), (2, 10), (3, 5), (3, 5))], "id long, embedding array<float>")
    with pytest.raises(EngineError):
        e.quant_train(rows)
    e.quant_create("sq8")
    with pytest.raises(EngineError):
        e.quant_insert(rows)
    e.quant_train(rows)
    e.quant_insert(rows)
    assert [r.id for r in e.quant_search([5.0] * 4, 2).collect()] == [3, 3] and e.vec_count() == 3
    e.quant_destroy()
    with pytest.raises(EngineError):
        e.quant_search([1.0] * 4)


def test_hybrid_lists(spark):
    v = lambda *rows: spark.createDataFrame(list(rows), "id long, distance double")
    f = lambda *rows: spark.createDataFrame(list(rows), "id long, score double")
    assert [r.id for r in fuse(v(), f((1, 0.9), (2, 0.8))).collect()] == [1, 2] and [r.id for r in fuse(v((10, 0.5), (20, 0.8)), f()).collect()] == [10, 20]
    assert fuse(v(), f()).count() == 0 and len(fuse(v(*[(k, k / 10) for k in range(5)]), f(), most=3).collect()) == 3
    same = fuse(v((1, 0.1), (2, 0.2)), f((1, 0.9), (2, 0.8))).collect()
    assert len(same) == 2 and same[0].score > same[1].score
    assert {r.id for r in fuse(v((1, 0.1)), f((2, 0.9), (2, 0.9), (3, 0.7))).collect()} == {1, 2, 3}
    scores = [r.score for r in fuse(v(*[(k, k / 10) for k in range(1, 11)]), f(*[(k, 1 / k) for k in range(5, 15)]), most=20).collect()]
    assert scores == sorted(scores, reverse=True)


def test_hybrid_search(spark):
    e = Engine(spark).register("t", spark.createDataFrame([(1, "red apple"), (2, "green apple"), (3, "blue")], "id long, body string"), "id")
    e.vec_create_index(2).vec_insert_batch([(1, [0.0, 0.0]), (3, [1.0, 1.0])])
    e.fts_create_index("t", "body")
    got = e.hybrid_search("t", "body", "apple red", [1.0, 1.0], 0).collect()
    assert {r.id for r in got} == {1, 2, 3} and got[0].id == 1
    assert e.hybrid_search("t", "body", "zzz", [1.0, 1.0]).first().id == 3


def test_vectors_repeat_and_persist(spark, tmp_path):
    i = vecs(spark, [(1, [0.0, 0.0])], dim=2, metric="ip")
    new = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 3.0]), (2, [2.0, 0.0])], "id long, embedding array<float>").coalesce(1)
    path = f"file://{tmp_path}/v"
    for _ in range(2):
        i = i.insert(new).save(path)
    back = VectorIndex.load(spark, path)
    assert back.dim == 2 and back.metric == "ip" and sorted((r.id, r.embedding[0]) for r in back.df.collect()) == [(1, 1.0), (2, 2.0)]
    with pytest.raises(EngineError):
        back.search([1.0], 1)
    with pytest.raises(EngineError):
        VectorIndex.load(spark, f"file://{tmp_path}/none")


def test_registered_ivf_knn(spark):
    """Every query of the registered settings against brute force."""
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got: dict = {}
    for r in queries.QUERIES["ann_ivf_knn"](spark, d).collect():
        got.setdefault(r.qid, {})[r.id] = r.distance
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        dist = ((x - x[ids == q][0]) ** 2).sum(1)
        assert len(got[q]) == 10 and all(abs(dist[ids == i][0] - v) < 1e-5 for i, v in got[q].items())
        hits += len(set(got[q]) & set(ids[np.lexsort((ids, dist))[:10]].tolist()))
    assert len(got) == (ids % 20 == 0).sum() and hits / (10 * len(got)) >= 0.9


def test_ivf_changes(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.standard_normal((200, 4)).round(3)
    i = IvfIndex(vecs(spark, [(k, v.tolist()) for k, v in enumerate(x)]), 6).save(f"file://{tmp_path}/ivf")
    i = i.insert(spark.createDataFrame([(7, [9.0, 9.0, 9.0, 9.0]), (500, [9.0, 9.0, 9.0, 8.0])], "id long, embedding array<float>")).delete([8])
    assert i.count().first()[0] == 200 and i.get(7).first().embedding[0] == 9 and not i.get(8).head(1)
    assert [a.id for a in i.search([9.0] * 4, 2, 2).collect()] == [7, 500]
    full = i.batch_knn(i.index.df.where("id < 30").withColumnRenamed("id", "qid"), 5, 6, block=7)
    want = i.index.batch_knn(i.index.df.where("id < 30").withColumnRenamed("id", "qid"), 5)
    assert sorted((a.qid, a.id) for a in full.collect()) == sorted((a.qid, a.id) for a in want.collect())
    assert IvfIndex(vecs(spark, []).insert(spark.createDataFrame([], "id long, embedding array<float>"))).search([1.0], 3).count() == 0


def brute_embedding(text, dim, ngram=3, seed=42):
    """By the definition, one value at a time."""
    cells = dim * 256
    state, values = seed, []
    for _ in range(cells * dim):
        state = (state * 1103515245 + 12345) % 2**32
        values.append(((state >> 16) & 0x7FFF) / 16384 - 1)
    codes = [c for x in text or "" for c in (ord(x), 32)]
    n, total = min(ngram, len(codes)), [0.0] * dim
    for at in range(len(codes) - n + 1 if codes else 0):
        h = 2166136261
        for c in codes[at : at + n]:
            for byte in c.to_bytes(4, "little"):
                h = (h ^ byte) * 16777619 % 2**32
        row = h % cells
        total = [a + b for a, b in zip(total, values[row * dim : (row + 1) * dim])]
    norm = math.sqrt(sum(a * a for a in total))
    return [a / norm if norm else 0.0 for a in total]


def test_embedding_and_text_search_by_definition(spark, tmp_path):
    texts = ["a", "", None, "the thing of that", "été 漢字 \U0001f600 x", "the thing of this " * 9, "ab"]
    got = Embedder(8).embed_all(texts)
    want = [brute_embedding(t, 8) for t in texts]
    assert np.allclose(got, want, atol=1e-6)
    i = VectorIndex(spark.createDataFrame([], "id long, embedding array<float>"), 8, "cosine", Embedder(8)).insert_text(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    q = brute_embedding("the thing of that", 8)
    near = sorted((1.0 if not any(v) else 1 - float(np.dot(v, q)), k) for k, v in enumerate(want))
    found = [(r.id, r.distance) for r in i.search_text("the thing of that", 7).collect()]
    assert [k for k, _ in found][0] == 3 and np.allclose([d for _, d in found], [d for d, _ in near], atol=1e-5)
    assert [r.id for r in i.search_text("the thing of that", 2, F.col("id") % 2 == 0).collect()] == [k for _, k in near if k % 2 == 0][:2]
    big = Embedder(256)  # rows of the matrix are made when touched
    assert np.allclose(big.embed("abc"), big.embed_all(["x", "abc"])[1]) and math.isclose(float(np.linalg.norm(big.embed("abc"))), 1, abs_tol=1e-5)


def test_registered_pq_by_brute_force(spark):
    """Distances are those of the nearest centroids in each sub-space, taken one at a time."""
    d = "/root/testdata/sf0.001"
    df = queries.vectors(spark, d).df
    q = Pq.train(df, 8)
    rows = {r.id: np.array(r.embedding, np.float64) for r in df.collect()}
    k = q.books.shape[2]
    near = lambda v: np.concatenate([b[min(range(len(b)), key=lambda c: ((b[c] - v[s * k : (s + 1) * k]) ** 2).sum())] for s, b in enumerate(q.books)])
    own = near(rows[1])
    want = sorted((round(float(((near(v) - own) ** 2).sum()), 6), i) for i, v in rows.items())[:10]
    got = sorted((r.distance, r.id) for r in queries.QUERIES["quant_pq_topk"](spark, d).collect())
    assert np.allclose([a for a, _ in got], [a for a, _ in want], atol=2e-6)
    assert Pq.train(df, 8, sample=50).codes_of(np.array(list(rows.values()))).shape == (len(rows), 8)
