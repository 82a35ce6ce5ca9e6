"""File, notebook and page sources."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.functions import html as H
from semblance.functions.joins import compute_once
from semblance.functions.prefix_sums import running_sums
from semblance.functions.text import is_nonblank
from semblance.functions.urls import clean_name, keeps_file, last_segment, matches_patterns, url_filename
from semblance.session import cut_lineage
from semblance.settings import NOTEBOOK_SEPARATOR

# Ship the file helpers inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOTEBOOK_SCHEMA = "cells array<struct<cell_type: string, source: variant>>"

# Tasks that list the folders of one level.
MAX_LISTING_TASKS = 1000
# Bytes that a task reads, and those that opening a file counts as.
READ_BYTES = 64 * 1024 * 1024
OPEN_BYTES = 64 * 1024


def decode_text(content: Column) -> Column:
    """UTF-8 with undecodable bytes left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def notebook_code(content: Column) -> Column:
    """The code cells of a notebook, joined by a separator; empty for broken JSON.

    A cell's source is a string or a list of strings, so it is read as a variant.
    """
    cells = F.from_json(content, NOTEBOOK_SCHEMA)["cells"]
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    sources = F.transform(
        code,
        lambda c: F.coalesce(
            F.array_join(F.try_variant_get(c["source"], "$", "array<string>"), ""),
            F.try_variant_get(c["source"], "$", "string"),
            F.lit(""),
        ),
    )
    return F.coalesce(
        F.array_join(F.filter(sources, is_nonblank), NOTEBOOK_SEPARATOR), F.lit("")
    )


def member_text(path: Column, content: Column) -> Column:
    """Text of one file: notebooks give their code cells, everything else its decoded bytes."""
    text = decode_text(content)
    return F.when(F.lower(path).endswith(".ipynb"), notebook_code(text)).otherwise(text)


def _list_entries(batches):
    """``(root, path, name, is_folder, size)`` of what lies directly in each given folder.

    A folder that cannot be opened has no entries.
    """
    import pandas as pd
    from pyarrow.fs import FileSelector, FileSystem, FileType

    for batch in batches:
        for root, path, name in zip(batch["root"], batch["path"], batch["name"]):
            system, _ = FileSystem.from_uri(root)
            try:
                infos = system.get_file_info(FileSelector(path))
            except OSError:
                infos = []
            infos = [i for i in infos if i.type in (FileType.File, FileType.Directory)]
            yield pd.DataFrame({
                "root": [root] * len(infos), "path": [i.path for i in infos],
                "name": [f"{name}/{i.base_name}" if name else i.base_name for i in infos],
                "is_folder": [i.type == FileType.Directory for i in infos], "size": [i.size or 0 for i in infos],
            }).astype({"size": "int64", "is_folder": "bool"})


def _read_files(batches):
    """``(name, content)``, one frame per file so that memory holds a single file. A file that
    cannot be opened is left out."""
    import pandas as pd
    from pyarrow.fs import FileSystem

    for batch in batches:
        for root, path, name in zip(batch["root"], batch["path"], batch["name"]):
            system, _ = FileSystem.from_uri(root)
            try:
                with system.open_input_stream(path) as stream:
                    content = stream.read()
            except OSError:
                continue
            yield pd.DataFrame({"name": [name], "content": [content]})


def list_folder(
    spark: SparkSession, folder: str, patterns: Sequence[str] = (), exclude: bool = True
) -> DataFrame:
    """``(root, path, name, size)`` of the files below ``folder`` that the patterns keep.

    Folders are listed level by level, those of a level by many tasks. When excluding, a folder
    whose name a pattern fits is never opened, however much lies below it. The driver sees only
    how many folders a level has.
    """
    system, base = FileSystem.from_uri(folder)
    schema = "root string, path string, name string, is_folder boolean, size long"
    exists = system.get_file_info(base).type == FileType.Directory
    level = spark.createDataFrame([(folder, base, "")] if exists else [], "root string, path string, name string")
    found, n = None, int(exists)
    while found is None or n:
        tasks = min(max(1, n), MAX_LISTING_TASKS)
        entries = cut_lineage(level.repartition(tasks, "path").mapInPandas(_list_entries, schema))
        files = entries.filter("NOT is_folder").filter(keeps_file(F.col("name"), patterns, exclude))
        found = files if found is None else found.unionByName(files)
        level = entries.filter("is_folder")
        if exclude:
            level = level.filter(~matches_patterns(last_segment(F.col("name")), patterns))
        level = level.select("root", "path", "name")
        n = level.count()
    return found.select("root", "path", "name", "size")


def scan_folder(
    spark: SparkSession, folder: str, patterns: Sequence[str] = (), exclude: bool = True
) -> DataFrame:
    """Every non-blank file below ``folder`` as ``(name, raw_text)``, keyed by relative path.

    The file readers of Spark pass over names that start with a dot or an underscore, such as
    ``__init__.py``, so tasks list and read the files themselves. Names are filtered before any
    content is read, and files are dealt to reading tasks by their bytes.
    """
    files = list_folder(spark, folder, patterns, exclude)
    weighed = running_sums(files.withColumn("weight", F.col("size") + OPEN_BYTES), [], ["path"], "weight", "end")
    dealt = cut_lineage(weighed.withColumn("task", F.floor((F.col("end") - 1) / READ_BYTES).cast("int")))
    last = dealt.agg(F.max("task")).first()[0]
    placed = dealt.select("root", "path", "name", "task").repartitionById((last or 0) + 1, F.col("task"))
    read = placed.mapInPandas(_read_files, "name string, content binary")
    texts = compute_once(read, raw_text=member_text(F.col("name"), F.col("content")))
    return texts.filter(is_nonblank(F.col("raw_text"))).select("name", "raw_text")


def page_articles(pages: DataFrame) -> DataFrame:
    """Article submissions from ``pages(url, html, ...)``: title, authors, date and body."""
    html = F.col("html")
    fields = compute_once(
        pages, title=H.page_title(html), authors=H.page_authors(html), published=H.page_date(html),
        body=H.page_text(html),
    )
    parts = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), F.col("title")),
        F.concat(F.lit("**Authors:** "), F.col("authors")),
        F.concat(F.lit("**Published:** "), F.col("published")),
        F.concat(F.lit("\n"), F.col("body")),
    )
    name = clean_name(F.coalesce(F.col("title"), url_filename(F.col("url"))))
    keep = [c for c in pages.columns if c != "html"]
    return fields.select(*keep, name.alias("name"), parts.alias("raw_text")).filter(
        is_nonblank(F.col("raw_text"))
    )
