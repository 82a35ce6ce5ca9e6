"""The given tables in the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.functions.joins import spread
from semblance.functions.text import BLANKS, WORD, is_nonblank
from semblance.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with authors, a date, a paragraph full of character references, an aside inside the
    article, a foreign article inside an aside, and a second article."""
    head = F.concat(
        F.lit('<head><meta name="author" content="A. '), F.split_part("url", F.lit("/"), F.lit(3)),
        F.lit('"><META content=Bo name=\'Author\'><meta property="article:published_time" content="2024-'), F.col("page_id").cast("string"), F.lit('">'),
    )
    last = F.lit(
        "<aside title='a > b'>More</aside><p>It&#8217;s a caf&eacute; &mdash; &#x27;ok&#x27;&nbsp;&hellip;</p></article>"
        "<aside><article>Elsewhere</article></aside><article>Second</article>"
    )
    html = F.replace(F.replace("html", F.lit("<head>"), head), F.lit("</article>"), last)
    return spread(table(spark, sf_dir, "pages").withColumn("html", html), "page_id")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as submissions: the source is the corpus."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("corpus_id"), F.col("doc_id").cast("string").alias("name"),
        F.col("text").alias("raw_text"), F.col("doc_id").alias("ingest_order"),
    )
    return spread(docs, "corpus_id", "name")


def removed_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` items as submissions that are no longer part of any corpus."""
    return table(spark, sf_dir, "benchmark").select(
        F.lit("removed").alias("corpus_id"), F.col("item_id").cast("string").alias("name"),
        F.col("text").alias("raw_text"), F.col("item_id").alias("ingest_order"),
    )


def cached_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run has processed: the labelled documents and the removed items.

    A document of quality 0 has changed since then; its old text began with another word.
    """
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("name"), "quality"
    )
    old = F.when(F.col("quality") == 0, F.concat(F.lit("old "), F.col("raw_text"))).otherwise(F.col("raw_text"))
    known = submissions(spark, sf_dir).join(labels, "name").withColumn("raw_text", old)
    return known.select("corpus_id", "name", "raw_text", "ingest_order").unionByName(
        removed_submissions(spark, sf_dir)
    )


def code_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` rewritten as source code: every line becomes a function whose body is a
    chain of the line's words; the first line becomes a method of a class. Every third function
    has a string of several lines with a header in it, defaults, an annotation and a lambda."""
    subs = submissions(spark, sf_dir)
    lines = F.filter(F.split("raw_text", "\n"), is_nonblank)

    def words(line):
        return F.regexp_extract_all(line, F.lit(rf"[{WORD}]+"), F.lit(0))

    def body(line):
        return F.concat(F.lit("return lib."), F.array_join(words(line), "."))

    def block(line, i):
        label = F.concat(F.lit("part_"), (i % 7).cast("string"))
        return (
            F.when(i == 0, F.concat(F.lit("class Paper:\n    def title(self):\n        "), body(line)))
            .when(i % 3 == 0, F.concat(F.lit("async def "), label, F.lit("(arg):\n    "), body(line)))
            .when(
                i % 3 == 1,
                F.concat(
                    F.lit("def "), label, F.lit("(arg):\n    "), body(line),
                    F.lit("\n    def note():\n        return lib."),
                    F.coalesce(F.try_element_at(words(line), F.lit(-1)), F.lit("end")),
                ),
            )
            .otherwise(
                F.concat(
                    F.lit("def "), label, F.lit("(arg, kind: Dict[str, int] = pick(1), size="), F.length(line).cast("string"),
                    F.lit('):\n    text = """\ndef ghost(x):\n  '), F.array_join(words(line), " "),
                    F.lit('\n"""\n    keep = lambda row, *rest, top=pick(2): (row, top, kind)\n    '), body(line), F.lit("\n"),
                )
            )
        )

    return subs.withColumn("raw_text", F.array_join(F.transform(lines, block), "\n"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as archives: a turn is a member file. Archives take turns in having one
    container folder, several top folders, or bare files."""
    path = (
        F.when(F.col("conv_id") % 3 == 0, F.concat_ws("/", F.lit("box"), "role", F.concat(F.col("turn").cast("string"), F.lit(".txt"))))
        .when(F.col("conv_id") % 3 == 1, F.concat_ws("/", "role", F.concat(F.col("turn").cast("string"), F.lit(".txt"))))
        .otherwise(F.concat(F.col("turn").cast("string"), F.lit(".txt")))
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".zip")).alias("archive"),
        F.col("conv_id").alias("ingest_order"), path.alias("member_path"), F.col("turn").alias("member_no"),
        F.col("text").alias("content"),
    )


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of ``conversations`` as a notebook with a code cell given as a list, one given as
    a string, a prose cell and a blank cell; system turns hold no valid JSON."""
    text = F.col("text")

    def cell(kind, source):
        return F.concat(F.lit(f'{{"cell_type": "{kind}", "source": '), source, F.lit("}"))

    def quoted(value):
        doc = F.to_json(F.struct(value.alias("v")))
        return F.substring(doc, F.lit(6), F.length(doc) - 6)

    as_list = F.concat(F.lit("["), quoted(F.concat(F.col("role"), F.lit("\n"))), F.lit(", "), quoted(text), F.lit("]"))
    cells = F.concat_ws(
        ", ", cell("code", as_list), cell("markdown", quoted(F.col("role"))),
        cell("code", quoted(F.lit(" \n"))), cell("code", quoted(F.concat(F.lit("again "), text))),
    )
    doc = F.concat(F.lit('{"cells": ['), cells, F.lit("]}"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", F.lit("{broken")).otherwise(doc).alias("content")
    )


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page addresses, and for each one a repository, file view, tree, article and download."""
    slug = F.substring_index("url", "/", -1)
    return (
        table(spark, sf_dir, "pages")
        .select(
            "page_id",
            F.posexplode(
                F.array(
                    F.col("url"),
                    F.concat(F.lit("https://github.com/team/"), slug, F.lit(".git")),
                    F.concat(F.lit("https://github.com/team/"), slug, F.lit("/blob/main/a.py?raw=1")),
                    F.concat(F.lit("https://github.com/team/"), slug, F.lit("/tree/main")),
                    F.concat(F.lit("https://Writer.Medium.com/"), slug),
                    F.concat(F.lit("https://host.example/get/"), slug, F.lit(".pdf?x=1")),
                )
            ).alias("variant", "url"),
        )
        .withColumn(
            "disposition",
            F.when(F.col("variant") == 5, F.concat(F.lit('attachment; filename="'), F.col("page_id").cast("string"), F.lit('.pdf"'))),
        )
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a chat message that names its language as a tag and repeats its address."""
    lang = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("msg_id"), F.substring_index(host, ".", -1).alias("channel_id"),
        F.concat(
            F.lit("New on #"), F.upper(lang), F.lit(": "), F.col("url"), F.lit(" mirror http://"), host,
            F.lit("/all, again "), F.col("url"),
        ).alias("content"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One marker per channel and tag; the tag ``en`` has been read up to the 20th message."""
    msgs = messages(spark, sf_dir)
    tags = F.array(*[F.lit(t) for t in ("#en", "#fr", "##es", "de")])
    return msgs.select("channel_id").distinct().select("channel_id", F.explode(tags).alias("tag")).select(
        "channel_id", "tag", F.when(F.col("tag") == "#en", F.lit("20")).alias("last_message_id")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings``: the label is the namespace, four neighbouring vectors are one file."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("namespace"), F.floor(vec / 4).cast("string").alias("name"),
        (vec % 4).alias("chunk_no"), vec.cast("string").alias("vec"), "vec_id", "embedding",
    )


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a workspace its user created at that time."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("instance_id"), F.col("user_id").cast("string").alias("username"),
        F.col("event_type").alias("name"), F.col("props").alias("description"),
        F.array(F.col("event_type"), F.col("props"), F.col("event_type")).alias("github_urls"),
        F.col("ts").cast("timestamp").alias("created_at"), "event_id",
    )


def nested_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` filed twice: by source with a folder in the name, and by source and folder."""
    docs = submissions(spark, sf_dir)
    folder = (F.col("ingest_order") % 2).cast("string")
    return docs.select("corpus_id", F.concat(folder, F.lit("/"), "name").alias("name"), "raw_text").unionByName(
        docs.select(F.concat("corpus_id", F.lit("/"), folder).alias("corpus_id"), "name", "raw_text")
    )


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` names as submissions: the brand is the corpus."""
    names = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("corpus_id"), F.col("p_partkey").cast("string").alias("name"),
        F.col("p_name").alias("raw_text"), F.col("p_partkey").alias("ingest_order"),
    )
    return spread(names, "corpus_id", "name")


def nested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` names as small source texts whose words are nested in three ways."""
    word = [F.coalesce(F.get(F.split("p_name", " "), F.lit(i)), F.lit("none")) for i in range(2)]
    kind, size, key = F.col("p_type"), F.col("p_size").cast("string"), F.col("p_partkey") % 3
    last = F.element_at(F.split(kind, " "), -1)
    text = (
        F.when(key == 0, F.concat(F.lit("def "), word[0], F.lit("("), word[1], F.lit(", "), last, F.lit("):\n    return "), last, F.lit("("), size, F.lit(")")))
        .when(key == 1, F.concat(F.lit("def "), word[0], F.lit("("), last, F.lit("):\n    if "), word[1], F.lit(":\n        return "), last, F.lit("(\n"), size, F.lit(")\n")))
        .otherwise(F.concat(word[0], F.lit("("), word[1], F.lit("("), last, F.lit("), ["), size, F.lit("])\n\nend")))
    )
    names = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("corpus_id"), F.col("p_partkey").cast("string").alias("name"), text.alias("raw_text"),
        F.col("p_partkey").alias("ingest_order"),
    )
    return spread(names, "corpus_id", "name")
