"""Large submissions in parts, saved buffers that are scored, and buffers with keyed state."""

import datetime as dt

from pyspark.sql import functions as F

from semblance.operators import corpus as C
from semblance.operators import pairs as P
from semblance.plans import analysis as AN
from semblance.plans import ingest as IN
from semblance.plans import regions as RE
from semblance.sources import sinks as SK
from semblance.sources import tables as ST
from semblance.streaming import streams as SM

CODE = "def f(a):\n    return g(a, 1)\n\n\ndef k(b):\n    for x in b:\n        g(x, 2)\n    return b"


def split(subs, spark):
    """Every text cut at its blank lines into ordered parts."""
    return subs.select(
        "corpus_id", "name", "ingest_order", F.posexplode(F.split("raw_text", "\n\n")).alias("part_no", "raw_text")
    )


def rows(df):
    return sorted(tuple(r) for r in df.drop("error").collect())


def test_split_and_whole_submissions_score_alike(spark, corpus):
    subs = corpus({
        "c": {"t": CODE, "same": CODE, "turned": "\n\n".join(reversed(CODE.split("\n\n"))), "one": "def f(a):\n    return 2", "empty": ""},
        "d": {"x": "a b\n\nc", "y": "a\n\nb c"},
    })
    parts = split(subs, spark)
    targets = P.default_targets(parts)
    assert parts.filter("part_no > 0").count() >= 5
    whole = {(r["corpus_id"], r["name"]): (r["raw_text"], r["ingest_order"]) for r in C.whole_texts(parts).collect()}
    assert whole == {(r["corpus_id"], r["name"]): (r["raw_text"], r["ingest_order"]) for r in subs.collect()}
    assert rows(AN.analyze_sparse(parts, targets)) == rows(AN.analyze_sparse(subs, targets))
    scores = AN.analyze_fast(parts, targets).filter("other = 'same'").collect()
    assert len(scores) == 1 and scores[0]["ast"] == 1.0
    plain, parted = (RE.region_report(s, targets, min_tokens=3).drop("function_matches", "token_matches") for s in (subs, parts))
    assert rows(plain) == rows(parted)
    requests = spark.createDataFrame([("c", "t", "same"), ("c", "t", "gone")], "corpus_id string, file1 string, file2 string")
    asked = {r["other"]: r for r in RE.requested_report(parts, requests, min_tokens=3).collect()}
    assert asked["same"]["overall_similarity"] == 1.0 and asked["gone"]["error"] == "File 'gone' not found"


def test_a_saved_buffer_is_scored(spark, tmp_path):
    spool = str(tmp_path / "spool")
    files = spark.createDataFrame(
        [("b.py", 2, CODE.encode()), ("a.py", 5, CODE.encode()), ("c.py", 7, b"x = 1")], "name string, ingest_order long, content binary"
    )
    buffer = IN.build_corpus(spool, files=files)
    report = AN.buffer_report(spark, spool, buffer).collect()
    assert [(r["target"], r["other"], r["rank"]) for r in report] == [("b.py", "a.py", 1), ("b.py", "c.py", 2)]
    assert report[0]["raw"] == 1.0 and report[0]["band"] == "red"
    assert AN.buffer_report(spark, spool, "none").count() == 0


def test_a_large_saved_submission_is_scored_once(spark, corpus, tmp_path):
    spool = str(tmp_path / "spool")
    subs = corpus({"c": {"t": CODE, "u": CODE}})
    buffer = SK.save_submissions(split(subs, spark), spool, "17")
    saved = ST.buffered_submissions(spark, spool, buffer)
    assert saved.count() == 4 and saved.first()["corpus_id"] == "17"
    report = AN.buffer_report(spark, spool, buffer).collect()
    assert len(report) == 1 and report[0]["ast"] == report[0]["raw"] == 1.0


def test_writes_of_one_time_leave_one_row(spark):
    at = dt.datetime(2024, 1, 1, 10)
    now = F.lit(at + dt.timedelta(minutes=5)).cast("timestamp")
    made = spark.createDataFrame(
        [("c", "a", "x", at, 1), ("c", "a", "y", at, 2), ("c", "a", "w", at, 2), ("c", "b", "z", at, None)],
        "corpus_id string, name string, raw_text string, created_at timestamp, ingest_order long",
    ).withColumn("expires_at", SK.expiry(F.col("created_at")))
    got = {r["name"]: r["raw_text"] for r in SM.current_buffer(made, now).collect()}
    assert SM.current_buffer(made, now).count() == 2 and got == {"a": "y", "b": "z"}
    bare = SM.current_buffer(made.drop("ingest_order").union(made.drop("ingest_order")), now)
    assert sorted((r["name"], r["raw_text"]) for r in bare.collect()) == [("a", "y"), ("b", "z")]
    parts = made.limit(2).withColumn("part_no", F.col("ingest_order")).withColumn("ingest_order", F.lit(3))
    assert SM.current_buffer(parts, now).count() == 2


def test_keyed_state_goes_after_its_hour(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    schema = "corpus_id string, name string, raw_text string, created_at timestamp, ingest_order long"
    start = dt.datetime(2024, 1, 1, 10)
    found = {}

    def keep(batch, batch_id):
        for r in batch.collect():
            found.setdefault(r["name"], []).append(None if r["expired"] else r["raw_text"])

    def send(*made):
        """Rows of ``(name, text, minute, order)``; returns the keys that have state."""
        values = [("c", name, text, start + dt.timedelta(minutes=minute), order) for name, text, minute, order in made]
        spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(source)
        changes = SM.buffer_changes(spark.readStream.schema(schema).parquet(source))
        query = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert send(("a", "one", 0, 1), ("a", "two", 0, 2), ("b", "first", 1, 3)) == 2
    assert found == {"a": ["two"], "b": ["first"]}
    # Same time and lower order loses; a later write wins and lives for an hour of its own.
    assert send(("a", "late", 0, 1), ("b", "second", 30, 4)) == 2
    assert found == {"a": ["two"], "b": ["first", "second"]}
    assert send(("c", "new", 62, 5)) == 2
    assert found["a"] == ["two", None] and found["b"] == ["first", "second"]
    # What comes after its hour changes nothing.
    assert send(("a", "too late", 1, 9), ("c", "newer", 200, 6)) == 1
    assert found == {"a": ["two", None], "b": ["first", "second", None], "c": ["new", "newer"]}
