import fnmatch
import html
import json

import pytest
from pyspark.sql import functions as F

from semblance.functions import html as H
from semblance.functions import urls as U
from semblance.operators import corpus as C
from semblance.plans import ingest as IN
from semblance.settings import OS_JUNK_PATTERNS
from semblance.sources import files as SF
from semblance.sources import sinks as SK
from semblance.sources import tables as ST


def members(spark, archive, files):
    rows = [(archive, path, i, content) for i, (path, content) in enumerate(files)]
    return spark.createDataFrame(rows, "archive string, member_path string, member_no int, content string")


def built(df):
    return {r.name: r.raw_text for r in df.collect()}


def test_container_folder(spark):
    df = members(spark, "s.zip", [
        ("box/", ""), ("box/ann/b.py", "2"), ("box/ann/a.py", "1"), ("box/bob/x.py", "3"), ("box/readme", "r"),
        ("__MACOSX/x", "junk"), ("box/bob/.DS_Store", "junk"), ("box/eve/blank.py", " \n"),
    ])
    assert built(C.archive_submissions(df, OS_JUNK_PATTERNS)) == {
        "ann": "# === box/ann/a.py ===\n1\n\n# === box/ann/b.py ===\n2",
        "bob": "# === box/bob/x.py ===\n3",
        "readme": "# === box/readme ===\nr",
    }


def test_several_top_folders_and_bare_file(spark):
    df = members(spark, "s.zip", [("ann/a.py", "1"), ("bob/b.py", "2"), ("solo.py", "3")])
    assert built(C.archive_submissions(df)) == {
        "ann": "# === ann/a.py ===\n1", "bob": "# === bob/b.py ===\n2", "solo.py": "3",
    }
    assert built(C.archive_submissions(df, ["*.py"], exclude=False)) == built(C.archive_submissions(df))
    assert built(C.archive_submissions(df, [], exclude=False)) == {}


def test_single_submission_keeps_archive_order(spark):
    df = members(spark, "work.v1.zip", [("z.py", "1"), ("a.py", "2")])
    assert built(C.archive_as_single(df)) == {"work.v1": "# === z.py ===\n1\n\n# === a.py ===\n2"}


@pytest.mark.parametrize("limit", [100, 16 << 20])
def test_large_group_comes_in_parts(spark, limit):
    size = 50 if limit == 100 else 6 << 20
    files = [(f"ann/{i}.py", chr(97 + i) * size) for i in range(5)] + [("bob/c.py", "z")]
    df = members(spark, "s.zip", files)
    rows = C.archive_submissions(df, limit=limit).orderBy("name", "part_no").collect()
    parts = [r for r in rows if r.name == "ann"]
    assert len(parts) > 1 and [r.part_no for r in parts] == list(range(len(parts)))
    assert "\n\n".join(r.raw_text for r in parts) == "\n\n".join(f"# === {p} ===\n{t}" for p, t in files[:5])
    assert sum(r.n_members for r in parts) == 5
    assert [r.raw_text for r in rows if r.name == "bob"] == ["# === bob/c.py ===\nz"]


def arrived(df, order):
    return df.withColumn("ingest_order", F.lit(order))


def test_later_archive_wins(spark):
    old = members(spark, "9.zip", [("a.py", "old"), ("b.py", "b"), ("notes.pdf", "dropped")])
    new = members(spark, "10.zip", [("a.py", "new"), ("c.py", "c")])
    df = arrived(old, 1).union(arrived(new, 2))
    assert {r.name: r.raw_text for r in IN.extract_archives(df).collect()} == {"a.py": "new", "b.py": "b", "c.py": "c"}


def test_last_wins_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 2, "y"), ("k", 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in C.last_wins(df, ["k"], "o").collect()} == {(None, "y"), ("k", "z")}


def test_articles_of_one_name_stay_apart(spark):
    title = "t" * 150
    pages = spark.createDataFrame(
        [(f"http://e.com/{i}", f"<title>{title}{i}</title><p>{i}</p>", 0) for i in range(2)]
        + [("http://e.com/0", f"<title>{title}0</title><p>new</p>", 1)], "url string, html string, o int",
    )
    got = {r.url: r for r in IN.extract_pages(pages, "o").collect()}
    assert got["http://e.com/0"].raw_text.endswith("new") and got["http://e.com/1"].raw_text.endswith("1")
    assert got["http://e.com/0"].name == got["http://e.com/1"].name


def test_build_corpus(spark, tmp_path):
    spool = str(tmp_path / "spool")
    zips = arrived(members(spark, "a.zip", [("ann/a.py", "1"), ("bob.py", "2"), ("x/Thumbs.db", "j")]), 1).withColumn(
        "content", F.encode("content", "utf-8")
    )
    files = spark.createDataFrame([("bob.py", 5, bytearray(b"later")), ("b.pdf", 6, bytearray(b"no"))], "name string, ingest_order int, content binary")
    pages = spark.createDataFrame([("http://e.com/1", "<title>T</title><article><p>p</p></article>", 7)], "url string, html string, ingest_order int")
    buffer = IN.build_corpus(spool, zips, files, pages)
    got = {r.name: r.raw_text for r in ST.read_submissions(spark, spool, buffer).collect()}
    assert got == {"ann": "# === ann/a.py ===\n1", "bob.py": "later", "T http://e.com/1": "# T\n\n\np"}


def test_character_references(spark):
    texts = [
        "&#8217;&#x27;&eacute;&mdash;&nbsp;&hellip;", "&amp;lt; &lt &copy", "a & b &nosuch; &#0; &#xD800; &#150;", "&#128512;",
        "plain", "&NotEqualTilde;&#x1F600;", "&", "&;&#;&#x;",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", H.decode_entities(F.col("t")).alias("d")).collect():
        assert r.d == html.unescape(texts[r.i]), texts[r.i]


def test_patterns_against_fnmatch(spark):
    names = ["a.pdf", "x/a.pdf.txt", "b[1].py", "cache/__pycache__/m.pyc", "A.PDF", "._x", "n\nl.log", ""]
    patterns = ["*.pdf", "__pycache__", "?[!a]*", "*.l?g", "[[]*", "x/*"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    for p in patterns:
        want = [fnmatch.fnmatchcase(n, p) or p.lstrip("*") in n for n in names]
        assert [r[0] for r in df.select(U.matches_patterns(F.col("n"), [p])).collect()] == want, p
    assert all(r[0] for r in df.select(U.matches_patterns(F.col("n"), ["*"])).collect())
    assert not any(r[0] for r in df.select(U.matches_patterns(F.col("n"), [])).collect())


def test_folder_scan(spark, tmp_path):
    (tmp_path / "sub dir" / "__pycache__").mkdir(parents=True)
    (tmp_path / "a+b%20.py").write_text("print(1)")
    (tmp_path / "sub dir" / "é.txt").write_bytes("ok é".encode() + b"\xff\xfe!")
    (tmp_path / "sub dir" / "blank.txt").write_text(" \n")
    (tmp_path / "sub dir" / "__pycache__" / "x.py").write_text("hidden")
    (tmp_path / "sub dir" / "__init__.py").write_text("init")
    (tmp_path / ".hidden").write_text("dot")
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": ["a = 1\n", "b"]}]}))
    got = {r.name: r.raw_text for r in SF.scan_folder(spark, str(tmp_path), ["__pycache__"]).collect()}
    assert got == {"a+b%20.py": "print(1)", "sub dir/é.txt": "ok é!", "n.ipynb": "a = 1\nb",
                   "sub dir/__init__.py": "init", ".hidden": "dot"}
    only = SF.scan_folder(spark, str(tmp_path), ["*.py"], exclude=False)
    assert {r.name for r in only.collect()} == {"a+b%20.py", "sub dir/__pycache__/x.py", "sub dir/__init__.py"}
    assert SF.scan_folder(spark, str(tmp_path / "none")).count() == 0


def test_notebooks(spark):
    cells = [
        {"cell_type": "code", "source": ["x = 1\n", "y = 2"]}, {"cell_type": "markdown", "source": "# no"},
        {"cell_type": "code", "source": "[1, 2]"}, {"cell_type": "code", "source": [" ", "\n"]},
        {"cell_type": "code"}, {"cell_type": "code", "source": "[i for i in x]"},
    ]
    df = spark.createDataFrame([(1, json.dumps({"cells": cells})), (2, "{broken"), (3, "{}")], "i int, c string").orderBy("i")
    mark = "\n\n# === CELL SEPARATOR ===\n\n"
    assert [r[0] for r in df.select(SF.notebook_code(F.col("c"))).collect()] == [
        mark.join(["x = 1\ny = 2", "[1, 2]", "[i for i in x]"]), "", "",
    ]


def test_articles(spark):
    page = (
        '<html><head><title> A &amp; B: "x" </title><meta name="author" content="Ann"><meta '
        'property="article:published_time" content="2024-01-02"><script>var a="<p>";</script></head>'
        "<body><nav>menu</nav><article><p>One  <b>two</b></p><!-- c --><p>3 &lt; 4</p></article></body></html>"
    )
    df = spark.createDataFrame([("http://e.com/slug?x", page), ("http://e.com/slug?x", "<p>t</p>")], "url string, html string")
    rows = SF.page_articles(df).collect()
    assert rows[0].name == "A  B x"
    assert rows[0].raw_text == (
        '# A & B: "x"\n\n**Authors:** Ann\n\n**Published:** 2024-01-02\n\n\nOne two\n3 < 4'
    )
    assert (rows[1].name, rows[1].raw_text) == ("slug", "\nt")


@pytest.mark.parametrize(
    "url, kind, fetched",
    [
        ("https://github.com/u/r", "repo", None),
        ("https://github.com/u/r/blob/main/a.py", "file", "https://raw.githubusercontent.com/u/r/main/a.py"),
        ("https://github.com/u/r/tree/main", "file", None),
        ("https://raw.githubusercontent.com/u/r/main/a.py", "file", None),
        ("https://Medium.com/@x/post", "article", None),
        ("https://e.org/a.pdf?d=1", "file", None),
    ],
)
def test_urls(spark, url, kind, fetched):
    df = spark.createDataFrame([(url,)], "u string")
    row = df.select(U.url_kind(F.col("u")).alias("k"), U.fetch_url(F.col("u")).alias("f")).first()
    assert (row.k, row.f) == (kind, fetched or url)


def test_names_and_lists(spark):
    df = spark.createDataFrame([("https://e.org/a.pdf?d=1", 'attachment; filename="b.pdf"', None)], "u string, d string, n string")
    row = df.select(
        U.url_filename(F.col("u")).alias("a"), U.url_filename(F.col("u"), F.col("d")).alias("b"),
        U.url_filename(F.col("u"), F.col("n")).alias("c"), U.repo_name(F.lit("https://x/y/z.git")).alias("r"),
        U.clean_name(F.lit("  A/b: c-d_é! " + "x" * 200)).alias("n"), U.without_extension(F.lit("a.b.zip")).alias("s"),
        U.parse_url_box(F.lit(" u1 \n\n\tu2\n")).alias("p"),
    ).first()
    assert (row.a, row.b, row.c, row.r, row.s, row.p) == ("a.pdf", "b.pdf", "a.pdf", "z", "a.b", ["u1", "u2"])
    assert row.n.startswith("Ab c-d_é x") and len(row.n) == 100
    lists = spark.createDataFrame([(["n", "n", "x"], ["x", "o", "o"])], "a array<string>, b array<string>")
    row = lists.select(U.merge_urls(F.col("a"), F.col("b")).alias("m"), U.urls_changed(F.col("a"), F.col("b")).alias("c")).first()
    assert (row.m, row.c) == (["n", "n", "x", "o", "o"], True)


def test_buffers(spark, corpus, tmp_path):
    path = str(tmp_path / "buffers")
    subs = corpus({"x": {"file1.py": "print('hello')", "file2.py": "x = 1"}})
    first = SK.save_submissions(subs, path)
    SK.save_submissions(subs.limit(1), path, "other")
    assert len(first) == 36 and first.count("-") == 4
    rows = ST.read_submissions(spark, path, first)
    assert {r.name for r in rows.collect()} == {"file1.py", "file2.py"}
    assert "PartitionFilters: [isnotnull(corpus_id" in rows._jdf.queryExecution().toString()
    life = rows.select((F.unix_seconds("expires_at") - F.unix_seconds("created_at")).alias("s")).distinct().collect()
    assert [r.s for r in life] == [3600]
    one = rows.limit(1)
    at = one.first().expires_at
    assert ST.live_buffers(one, F.lit(at)).count() == 0
    assert ST.live_buffers(one, F.lit(at) - F.expr("INTERVAL 1 SECOND")).count() == 1
    assert len(SK.save_submissions(subs.limit(0), path)) == 36


def test_partition_overwrite_and_history(spark, tmp_path):
    path = str(tmp_path / "t")
    SK.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "ns string, v int"), path, "ns")
    SK.overwrite_partitions(spark.createDataFrame([("a", 9)], "ns string, v int"), path, "ns")
    assert {tuple(r) for r in spark.read.parquet(path).select("ns", "v").collect()} == {("a", 9), ("b", 2)}
    log = str(tmp_path / "h")
    for i in range(2):
        SK.append_history(spark.createDataFrame([("u", [f"x{i}"], None)], "username string, urls array<string>, instance_id string"), log)
    assert spark.read.parquet(log).count() == 2


def test_small_files_are_dealt_to_all_cores(spark, tmp_path):
    from checks import tables as D
    from semblance.sources.sinks import save_submissions
    from semblance.sources.tables import buffered_submissions

    width = spark.sparkContext.defaultParallelism
    rows = [(i, f"n {i}", "b", "t", 1) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for read in (D.part_names, D.nested_names):
        found = read(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= width and found.count() == 40
    subs = D.part_names(spark, str(tmp_path)).withColumn("corpus_id", F.lit("b")).withColumn("part_no", F.lit(0).cast("long"))
    saved = save_submissions(subs.coalesce(1), str(tmp_path / "spool"))
    found = buffered_submissions(spark, str(tmp_path / "spool"), saved)
    assert found.rdd.getNumPartitions() >= width and found.count() == 40
