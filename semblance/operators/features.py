"""Feature rows: processed text, tokens and structure of each submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.functions import code as C
from semblance.functions import shapes as H
from semblance.functions import text as X
from semblance.functions.arrays import let
from semblance.operators.corpus import whole_texts
from semblance.settings import CHUNK_OVERLAP, CHUNK_TOKENS, MAX_TEXT_BYTES, SHAPE_GRAM, TextOptions


def guard_size(submissions: DataFrame, limit: int = MAX_TEXT_BYTES) -> DataFrame:
    """Add ``error``: NULL, or the reason why an oversized text gets no features."""
    return submissions.withColumn("error", X.size_error(F.col("raw_text"), limit))


def build_features(
    submissions: DataFrame, options: TextOptions = TextOptions(), limit: int | None = None
) -> DataFrame:
    """Processed text and tokens of whole submissions; parts are joined first. With a ``limit`` in bytes, an oversized text gets none of them
    and a reason in ``error``; without one every text gets its features."""
    submissions = whole_texts(submissions)
    if limit is None:
        guarded = submissions.withColumn("error", F.lit(None).cast("string"))
    else:
        guarded = guard_size(submissions, limit)
    fits = F.col("error").isNull()
    processed = guarded.withColumn(
        "processed_text", F.when(fits, X.preprocess(F.col("raw_text"), options))
    ).withColumn("ast", F.when(fits, structure_lists(F.col("raw_text"), options.preserve_variable_names)))
    return processed.withColumn("tokens", X.tokens(F.col("processed_text")))


def token_array(rows: DataFrame, text: str) -> Column:
    """The tokens of a text column; feature rows bring those of their processed text along."""
    return F.col("tokens") if text == "processed_text" and "tokens" in rows.columns else X.tokens(F.col(text))


def structure_lists(text: Column, preserve_names: bool = False) -> Column:
    """The elements of four families of a source text, each as a list in order of the text."""
    flow = F.create_map(*[F.lit(x) for pair in C.CONTROL_FLOW.items() for x in pair])

    def lists(toks: Column) -> Column:
        # What comes before a bracket is seen first: few tokens need more.
        calls = F.filter(toks, lambda x: (x["a"] == "(") & C.is_call(x["t"], x["b"], x["a"]))
        steps = F.filter(toks, lambda x: x["t"].isin(list(C.CONTROL_FLOW)) & C.starts_statement(x["b"]))
        signs = F.filter(toks, lambda x: x["t"].isin(C.OPERATORS))
        return F.struct(
            _shapes(toks, preserve_names).alias("node_types"),
            F.transform(calls, lambda x: x["t"] if preserve_names else F.lit("FUNC_CALL")).alias("function_calls"),
            F.transform(steps, lambda x: flow[x["t"]]).alias("control_flow"),
            F.transform(signs, lambda x: x["t"]).alias("operators"),
        )

    return let(let(C.code_tokens(X.strip_comments(text)), C.with_neighbours), lists)


def _shapes(toks: Column, preserve_names: bool) -> Column:
    visible = F.filter(toks, lambda x: x["t"] != "\n")
    return F.transform(visible, lambda x: C.shape(x["t"], x["b"], x["a"], preserve_names))


def node_types(text: Column, preserve_names: bool = False) -> Column:
    """The first family of ``structure_lists`` alone."""
    return let(let(C.code_tokens(X.strip_comments(text)), C.with_neighbours), lambda toks: _shapes(toks, preserve_names))


def token_stream(submissions: DataFrame, text: str = "raw_text") -> DataFrame:
    return submissions.select(
        "corpus_id", "name", F.posexplode(X.tokens(F.col(text))).alias("pos", "token")
    )


def chunk_texts(
    submissions: DataFrame, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Overlapping token windows of each submission, with the hash of the whole text."""
    toks = whole_texts(submissions).select(
        F.col("corpus_id").alias("namespace"), "name",
        X.content_hash(F.col("raw_text")).alias("content_hash"),
        X.tokens(F.col("raw_text")).alias("toks"),
    ).filter(F.size("toks") > 0)
    windows = toks.select(
        "namespace", "name", "content_hash", "toks",
        F.posexplode(X.chunk_starts(F.size("toks"), size, overlap)).alias("chunk_no", "start"),
    )
    return windows.select(
        "namespace", "name", "chunk_no", "content_hash",
        F.array_join(F.slice("toks", F.col("start") + 1, F.lit(size)), " ").alias("text"),
    )


def structure_profile(submissions: DataFrame, preserve_names: bool = False) -> DataFrame:
    """How often each element of four families occurs in a submission.

    Equal tokens in equal surroundings are counted first, within the task that reads the text, so
    that only distinct ones are moved and classified.
    """
    token, before, after = F.col("token"), F.col("before"), F.col("after")
    placed = submissions.select(
        "corpus_id", "name", C.code_tokens(X.strip_comments(F.col("raw_text"))).alias("toks")
    )
    distinct = (
        C.explode_tokens(placed, "toks")
        .select(
            "corpus_id", "name", "token",
            F.when(before.isin("def", "class", ";", "\n"), before).when(before.isNotNull(), "").alias("before"),
            F.when(after == "(", "(").alias("after"),
        )
        .groupBy("corpus_id", "name", "token", "before", "after")
        .agg(F.count("*").alias("n"))
    )
    flow = F.create_map(*[F.lit(x) for pair in C.CONTROL_FLOW.items() for x in pair])
    called = token if preserve_names else F.lit("FUNC_CALL")

    def element(family: str, item: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), item.alias("item"))

    families = F.array(
        F.when(token != "\n", element("node_types", C.shape(token, before, after))),
        F.when(C.is_call(token, before, after), element("function_calls", called)),
        F.when(
            C.starts_statement(before) & token.isin(list(C.CONTROL_FLOW)),
            element("control_flow", flow[token]),
        ),
        F.when(token.isin(C.OPERATORS), element("operators", token)),
    )
    return (
        distinct.select("corpus_id", "name", "n", F.explode(F.array_compact(families)).alias("f"))
        .groupBy("corpus_id", "name", F.col("f.family").alias("family"), F.col("f.item").alias("item"))
        .agg(F.sum("n").alias("n"))
    )


def shape_grams(text: str = "raw_text", k: int = SHAPE_GRAM, preserve_names: bool = False) -> Column:
    """The k-grams of the shape classes of a text as one array, line feeds left out.

    A text with fewer than ``k`` tokens gives one gram of all its tokens.
    """

    return let(node_types(F.col(text), preserve_names), lambda arr: gram_array(arr, k))


def shape_gram_counts(text: str = "raw_text", k: int = SHAPE_GRAM, preserve_names: bool = False) -> Column:
    """How often each of the ``shape_grams`` occurs, as ``array<struct<item, n>>``."""
    code = X.strip_comments(F.col(text))
    return H.gram_counts(k, preserve_names)(C.code_tokens(code), H.other_letters(code))


def grams(items: str, k: int = SHAPE_GRAM) -> Column:
    """The k-grams of an array column; a shorter array gives one gram of all its items."""
    return gram_array(F.col(items), k)


def gram_array(arr: Column, k: int) -> Column:
    whole = F.when(F.size(arr) > 0, F.array(F.array_join(arr, " "))).otherwise(
        F.array().cast("array<string>")
    )
    shifted = [F.slice(arr, i + 1, F.greatest(F.size(arr) - (k - 1), F.lit(0))).alias(f"g{i}") for i in range(k)]
    joined = F.transform(
        F.arrays_zip(*shifted), lambda z: F.concat_ws(" ", *[z[f"g{i}"] for i in range(k)])
    )
    return F.when(F.size(arr) >= k, joined).otherwise(whole)
