import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from semblance.operators import harvest as V
from semblance.operators import incremental as I
from semblance.operators import pairs as P
from semblance.operators import vectors as VE
from semblance.operators import workspaces as W
from semblance.plans import analysis as AN
from semblance.plans.harvest import refresh_urls
from semblance.plans.ingest import ingest_batch
from semblance.plans.preprocess import preprocess_all, preprocess_with_cache, with_embeddings
from semblance.sources import tables as ST
from semblance.streaming import streams as SM


def test_preprocess_with_cache(corpus):
    old = corpus({"c": {"same": "def f(): return 1", "gone": "x"}})
    now = corpus({"c": {"same": "changed text", "new": "y = 2"}})
    cached, _ = preprocess_with_cache(old, preprocess_all(old.limit(0)))
    merged, fresh = preprocess_with_cache(now, cached)
    rows = {r.name: r for r in merged.collect()}
    assert set(rows) == {"same", "new"} and [r.name for r in fresh.collect()] == ["new"]
    assert rows["same"].raw_text == "def f(): return 1" and rows["new"].tokens == ["y", "=", "0"]
    status = {r.status: r.n for r in I.cache_status(now, cached).collect()}
    assert status == {"new": 1, "cached": 1, "stale": 1}


def test_feature_rows(spark, corpus):
    code = "import os\nfor i in range(3):\n    if i > 1:\n        show(i + 1)\n"
    subs = corpus({"c": {"a": code, "b": ""}})
    vectors = spark.createDataFrame([("c", "a", [0.5])], "corpus_id string, name string, embedding array<double>")
    rows = {r.name: r for r in with_embeddings(preprocess_all(subs), vectors).collect()}
    shapes = rows["a"].ast
    assert shapes.function_calls == ["FUNC_CALL"] * 2 and shapes.control_flow == ["For", "If"] and shapes.operators == [">", "+"]
    assert shapes.node_types[:4] == ["import", "W", "for", "W"] and rows["b"].ast.node_types == []
    assert rows["a"].dense_embedding == [0.5] and rows["b"].dense_embedding is None and rows["a"].error is None


def test_changed_files(spark, corpus):
    subs = corpus({"c": {"a": "1", "b": "2", "n": "3"}})
    manifest = I.changed_files(corpus({"c": {"a": "1", "b": "old", "gone": "g"}}), subs.limit(0).withColumn("content_hash", F.lit("")))
    got = {r.name: r.status for r in I.changed_files(subs, manifest).collect()}
    assert got == {"b": "changed", "n": "new"}
    assert I.changed_files(subs, manifest, force=True).count() == 3


def test_upserts(spark):
    schema = "corpus_id string, name string, v int"
    stored = spark.createDataFrame([("c", "a", 1), ("c", "b", 2)], schema)
    subs = stored.select("corpus_id", "name")
    updates = spark.createDataFrame([("c", "b", 9), ("c", "unknown", 5)], schema)
    assert {(r.name, r.v) for r in I.upsert_features(stored, subs, updates).collect()} == {("a", 1), ("b", 9)}


def test_replace_chunks(spark):
    chunks = spark.createDataFrame([("n", "a", 0), ("n", "a", 1), ("n", "b", 0)], "namespace string, name string, chunk_no int")
    changed = spark.createDataFrame([("n", "a")], "corpus_id string, name string")
    fresh = spark.createDataFrame([("n", "a", 0)], "namespace string, name string, chunk_no int")
    assert sorted((r.name, r.chunk_no) for r in I.replace_chunks(chunks, changed, fresh).collect()) == [("a", 0), ("b", 0)]


def test_vectors(spark):
    rng = random.Random(4)
    rows = [("n1" if i % 3 else "n2", f"f{i // 2}", i % 2, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)]
    rows.append(("n1", "zero", 0, [0.0] * 8))
    chunks = spark.createDataFrame(rows, "namespace string, name string, chunk_no int, embedding array<double>")
    queries = spark.createDataFrame([("n1", "q", rows[1][3])], "namespace string, query string, embedding array<double>")

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = sorted(((cos(r[3], rows[1][3]), r[1], r[2]) for r in rows if r[0] == "n1"), key=lambda x: (-x[0], x[1], x[2]))[:10]
    hits = VE.vector_topk(chunks, queries)
    got = [(r.score, r.name, r.chunk_no) for r in hits.orderBy("rank").collect()]
    assert [g[1:] for g in got] == [w[1:] for w in want]
    assert [g[0] for g in got] == pytest.approx([w[0] for w in want])
    low = {r.name: r.score for r in VE.file_scores(hits).collect()}
    high = {r.name: r.score for r in VE.file_scores(hits, "max").collect()}
    for name in low:
        scores = [w[0] for w in want if w[1] == name]
        assert (low[name], high[name]) == (pytest.approx(min(scores)), pytest.approx(max(scores)))
    assert VE.drop_namespace(chunks, "n1").select("namespace").distinct().collect()[0][0] == "n2"


def test_top_k_is_limited_before_the_shuffle(spark):
    chunks = spark.range(100).selectExpr("'n' AS namespace", "concat('f', id) AS name", "0 AS chunk_no", "array(id, 1.0D) AS embedding")
    queries = spark.createDataFrame([("n", "q", [1.0, 0.0])], "namespace string, query string, embedding array<double>")
    plan = VE.vector_topk(chunks, queries)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_vector_scores_need_all_embeddings(spark):
    schema = "corpus_id string, name string, embedding array<double>, ingest_order long"
    rows = [("full", "a", [1.0, 0.0], 0), ("full", "b", [1.0, 1.0], 1), ("gap", "a", [1.0], 0), ("gap", "b", None, 1), ("gap", "c", [1.0], 2)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.corpus_id, r.other): r.vector for r in VE.vector_cosine(df, P.default_targets(df)).collect()}
    assert got == {("full", "b"): pytest.approx(math.sqrt(0.5)), ("gap", "b"): None, ("gap", "c"): None}


def test_analyze_vector_scores_the_nearest_only(spark, corpus):
    subs = corpus({"c": {f"f{i}": f"text number {i}" for i in range(6)}})
    rows = [("c", f"f{i}", 0, [1.0, float(i)]) for i in range(6)]
    chunks = spark.createDataFrame(rows, "namespace string, name string, chunk_no int, embedding array<double>")
    got = AN.analyze_vector(subs, P.default_targets(subs), chunks, k=3).collect()
    assert {r.other for r in got} == {"f1", "f2"}
    assert {r.other: round(r.vector, 6) for r in got}["f1"] == round(1 / math.sqrt(2), 6)
    sparse = AN.analyze_sparse(subs, P.default_targets(subs), vectors=chunks.withColumnRenamed("namespace", "corpus_id"))
    row = {r.other: r for r in sparse.collect()}["f1"]
    assert row.vector == pytest.approx(1 / math.sqrt(2)) and row.cosine == pytest.approx(1.0)


MESSAGES = [
    (1, "ch", "old #nlp http://a.example/1"),
    (2, "ch", "#NLP see https://b.example/2?x=1, and http://a.example/1"),
    (3, "ch", "no tag http://c.example/3"),
    (4, "ch", "about nlp: HTTP://D.example/%20x http://a.example/1"),
    (5, "other", "#nlp http://e.example"),
]


def test_harvest_and_cache(spark):
    messages = spark.createDataFrame(MESSAGES, "msg_id long, channel_id string, content string")
    marks = spark.createDataFrame([("ch", "#nlp", "1"), ("other", "none", None)], "channel_id string, tag string, last_message_id string")
    latest = V.latest_messages(messages, marks)
    fresh = V.tag_urls(latest)
    assert [(r.url) for r in fresh.orderBy(F.desc("msg_id"), "at").collect()] == [
        "HTTP://D.example/%20x", "http://a.example/1", "https://b.example/2?x=1,",
    ]
    cached = spark.createDataFrame([("ch", "nlp", "http://a.example/1", 0), ("ch", "nlp", "http://z.example", 1)],
                                   "channel_id string, tag string, url string, pos int")
    merged = V.merge_into_cache(cached, fresh).orderBy("age", "p1", "p2").collect()
    assert [r.url for r in merged] == ["HTTP://D.example/%20x", "http://a.example/1", "https://b.example/2?x=1,", "http://z.example"]
    old = marks.withColumn("tag", ST.plain_tag(F.col("tag"))).withColumn("last_scraped_at", F.lit(None).cast("timestamp"))
    heads = {r.tag: r for r in V.next_marks(latest, fresh, old, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert heads["nlp"].last_message_id == "4" and heads["nlp"].last_scraped_at == dt.datetime(2024, 1, 1)
    assert heads["none"].last_message_id is None
    at = F.lit("2024-01-02").cast("timestamp")
    forced, moved = refresh_urls(messages, cached, old, at, force=True)
    assert "http://z.example" not in {r.url for r in forced.collect()} and forced.count() == 3
    assert {r.tag: r.last_message_id for r in moved.collect()} == {"nlp": "4", "none": None}
    again, _ = refresh_urls(messages, cached, old, at)
    assert [r.url for r in again.orderBy("age", "p1", "p2").collect()] == [r.url for r in merged]
    assert ST.cached_urls(cached, "ch", "##nlp").count() == 2
    assert V.latest_messages(messages, marks, limit=1).filter("channel_id = 'ch'").first().msg_id == 4


def test_workspaces(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("i1", "ann", "w1", ["u"], at), ("i2", "ann", "w2", [], at + dt.timedelta(days=1)), ("i3", "bob", "w3", [], at)]
    spaces = spark.createDataFrame(rows, "instance_id string, username string, name string, github_urls array<string>, created_at timestamp")
    assert [r.name for r in W.of_user(spaces, "ann").collect()] == ["w2", "w1"]
    assert [r.name for r in W.of_user(spaces, "ann", "i1").collect()] == ["w1"]
    assert [r.name for r in W.newest_first(spaces, ["username"], "instance_id").collect()] == ["w2", "w1", "w3"]
    ask = spark.createDataFrame([("i1", "bob"), ("i2", "ann")], "instance_id string, username string")
    assert {r.instance_id for r in W.delete_workspaces(spaces, ask).collect()} == {"i1", "i3"}
    new = ask.withColumn("github_urls", F.array(F.lit("n")))
    assert {r.instance_id: r.github_urls for r in W.update_urls(spaces, new).collect()} == {"i1": ["u"], "i2": ["n"], "i3": []}
    assert W.add_workspaces(spaces, spaces.limit(1)).count() == 4


def test_harvest_stream(spark, tmp_path):
    source, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    schema = "msg_id long, channel_id string, content string"
    tags = spark.createDataFrame([("ch", "#nlp")], "channel_id string, tag string")

    def send(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        SM.harvest_stream(stream, tags, store, check).awaitTermination()
        return [r.url for r in SM.harvested_urls(spark, store).collect()]

    assert send(MESSAGES[:3]) == ["https://b.example/2?x=1,", "http://a.example/1"]
    assert send(MESSAGES[3:]) == ["HTTP://D.example/%20x", "http://a.example/1", "https://b.example/2?x=1,"]


def test_harvest_stream_reads_every_message(spark, tmp_path):
    source, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    schema = "msg_id long, channel_id string, content string"
    rows = [(i, "ch", f"#nlp http://e.example/{i}") for i in range(600)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    tags = spark.createDataFrame([("ch", "nlp")], "channel_id string, tag string")
    SM.harvest_stream(spark.readStream.schema(schema).parquet(source), tags, store, check).awaitTermination()
    urls = [r.url for r in SM.harvested_urls(spark, store).collect()]
    assert urls == [f"http://e.example/{i}" for i in reversed(range(600))]


def test_ingest_stream(spark, tmp_path):
    source, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    schema = "corpus_id string, name string, raw_text string, ingest_order long"

    def send(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        SM.ingest_stream(stream, store, check).awaitTermination()
        return {r.name: r.text for r in SM.ingested_chunks(spark, store).collect()}

    assert send([("c", "a", "one", 0), ("c", "b", "two", 1), ("c", "b", "two again", 2)]) == {"a": "one", "b": "two again"}
    assert send([("c", "a", "one", 3), ("c", "b", "three", 4)]) == {"a": "one", "b": "three"}
    parts = spark.read.parquet(f"{store}/chunks").filter("batch = 1").collect()
    assert [r.name for r in parts] == ["b"]
    # A file that becomes blank loses its chunks and counts as changed once.
    assert send([("c", "b", " ", 5)]) == {"a": "one"}
    assert send([("c", "b", " ", 6)]) == {"a": "one"}
    files = spark.read.parquet(f"{store}/files")
    assert sorted(r.batch for r in files.filter("name = 'b'").collect()) == [0, 1, 2]
    assert send([("c", "b", "back", 7)]) == {"a": "one", "b": "back"}


def test_buffer_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    at = dt.datetime(2024, 1, 1, 10)
    rows = [("c", "a", "x", at), ("c", "a", "newer", at + dt.timedelta(minutes=5)), ("c", "b", "y", at)]
    schema = "corpus_id string, name string, raw_text string, created_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    out = SM.buffer_stream(spark.readStream.schema(schema).parquet(source))
    query = out.writeStream.format("memory").queryName("buffer_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("buffer_rows")
    assert all(r.expires_at - r.created_at == dt.timedelta(hours=1) for r in got.collect())

    def live(minutes):
        now = F.lit(at + dt.timedelta(minutes=minutes)).cast("timestamp")
        return {r.name: r.raw_text for r in SM.current_buffer(got, now).collect()}

    assert live(10) == {"a": "newer", "b": "y"} and live(62) == {"a": "newer"} and live(70) == {}


def test_all_chunks_of_the_target_are_its_query(spark, corpus):
    subs = corpus({"c": {"t": "one", "x": "two", "y": "three"}})
    rows = [("c", "t", 0, [1.0, 0.0]), ("c", "t", 1, [0.0, 1.0]), ("c", "x", 0, [0.1, 1.0]), ("c", "y", 0, [-1.0, -1.0])]
    chunks = spark.createDataFrame(rows, "namespace string, name string, chunk_no int, embedding array<double>")
    got = AN.analyze_vector(subs, P.default_targets(subs), chunks, k=3).collect()
    assert {r.other: round(r.vector, 4) for r in got} == {"x": round(1 / math.sqrt(1.01), 4)}


def test_batch_ingest(spark, corpus):
    first = ingest_batch(corpus({"c": {"a": "one", "b": "two"}}), spark.createDataFrame([], SM.CHUNK_SCHEMA))
    second = ingest_batch(corpus({"c": {"a": "one", "b": "three"}, "d": {"a": "x"}}), first)
    assert {(r.namespace, r.name, r.text) for r in second.collect()} == {("c", "a", "one"), ("c", "b", "three"), ("d", "a", "x")}
