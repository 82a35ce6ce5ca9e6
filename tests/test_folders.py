"""Folder listing that prunes, reading by bytes, and running sums over many tasks."""

import os
import random

from pyspark.sql import functions as F

from semblance.functions.prefix_sums import running_sums
from semblance.operators import corpus as C
from semblance.sources import files as SF


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40), rng.randint(0, 9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, v long")
    got = running_sums(df, ["k"], ["at"], "v", "total").collect()
    assert len(got) == 400
    for r in got:
        assert r["total"] == sum(v for k, at, v in rows if k == r["k"] and at <= r["at"])
    whole = running_sums(df, [], ["at", "k"], "v", "total").agg(F.max("total")).first()[0]
    assert whole == sum(v for *_, v in rows)
    assert running_sums(df.limit(0), ["k"], ["at"], "v", "total").count() == 0


def test_one_group_lies_in_many_tasks(spark):
    df = spark.range(4000).selectExpr("'a' AS k", "id AS at", "1L AS v")
    # Adaptive execution would join the small partitions of this little table.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = running_sums(df, ["k"], ["at"], "v", "total")
        assert made.filter("total <> at + 1").count() == 0
        used = made.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert max(r["count"] for r in used) < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts_of_one_archive_that_holds_all_members(spark):
    rows = [("z.zip", f"box/f{i:03}.txt", i, "x" * 50) for i in range(300)]
    members = spark.createDataFrame(rows, "archive string, member_path string, member_no int, content string")
    parts = C.archive_as_single(members, limit=1000).orderBy("part_no").collect()
    assert [p["part_no"] for p in parts] == list(range(len(parts))) and sum(p["n_members"] for p in parts) == 300
    assert len(parts) > 20 and all(len(p["raw_text"]) < 1100 for p in parts)
    text = "\n\n".join(p["raw_text"] for p in parts)
    assert text == "\n\n".join(f"# === {path} ===\n{content}" for _, path, _, content in rows)


def tree(root):
    files = {
        "a.py": "one", "pkg/__init__.py": "two", "pkg/deep/er/b.py": "three", "pkg/__pycache__/c.py": "no", "x.pdf": "no",
        "pkg/.hidden": "four", "blank.py": " \n", "pkg/deep/__pycache__/sub/d.py": "no",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return {k: v for k, v in files.items() if v not in ("no", " \n")}


def test_excluded_folders_are_never_opened(spark, tmp_path, monkeypatch):
    want = tree(tmp_path)
    opened = str(tmp_path / "pkg" / "__pycache__")
    os.chmod(opened, 0)
    try:
        monkeypatch.setattr(SF, "READ_BYTES", 100_000)
        got = SF.scan_folder(spark, str(tmp_path), ["__pycache__", "*.pdf"])
        assert {r.name: r.raw_text for r in got.collect()} == want
        # Two files of small size fill a task of this many bytes.
        assert got.rdd.getNumPartitions() > 1
    finally:
        os.chmod(opened, 0o755)
    listed = []
    entries = SF._list_entries

    def spy(batches):
        import pandas as pd

        for batch in batches:
            for k in range(len(batch)):
                listed.append(batch["path"][k])
            yield pd.concat(list(entries([batch])))

    frame = spark.createDataFrame([("", "", "")], "root string, path string, name string").toPandas()
    frame.loc[0] = [str(tmp_path), str(tmp_path), ""]
    first = next(spy([frame]))
    assert set(first["name"]) == {"a.py", "pkg", "x.pdf", "blank.py"} and listed == [str(tmp_path)]
    names = {r.name for r in SF.list_folder(spark, str(tmp_path), ["__pycache__"]).collect()}
    assert names == set(want) | {"x.pdf", "blank.py"}
    included = {r.name for r in SF.list_folder(spark, str(tmp_path), ["*.py"], exclude=False).collect()}
    assert "pkg/__pycache__/c.py" in included and "pkg/.hidden" not in included


def test_unreadable_files_and_missing_folders(spark, tmp_path):
    assert SF.scan_folder(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a.txt").write_text("text")
    os.symlink(tmp_path / "gone", tmp_path / "broken.txt")
    assert [r.name for r in SF.scan_folder(spark, str(tmp_path)).collect()] == ["a.txt"]
