"""Scoring jobs: every target against the rest of its corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semblance.functions import scores as S
from semblance.functions.arrays import counted
from semblance.operators.corpus import whole_texts
from semblance.operators.features import build_features, grams, shape_gram_counts
from semblance.operators.pairs import PAIR, bag_items, bag_scores, default_targets, missing_targets
from semblance.operators.tfidf import tfidf_cosine
from semblance.operators.token_scores import token_scores
from semblance.operators.vector_index import index_topk
from semblance.operators.vectors import file_scores, vector_cosine, vector_topk
from semblance.operators.verify import text_ratios
from semblance.session import cut_lineage
from semblance.settings import TOP_K, TextOptions
from semblance.sources.tables import buffered_submissions

METRICS = ["raw", "processed", "ast", "token", "cosine", "vector"]


def shape_scores(submissions: DataFrame, targets: DataFrame, preserve_names: bool = False) -> DataFrame:
    """Structure score: Dice of shape k-grams; a text without code tokens scores 0. Feature rows
    bring their shapes along."""
    ready = "ast" in submissions.columns
    bag = counted(grams("ast.node_types")) if ready else shape_gram_counts(preserve_names=preserve_names)
    return bag_scores(submissions, lambda rows: bag_items(rows, bag), targets, "ast", 0.0)


def feature_table(
    submissions: DataFrame, options: TextOptions = TextOptions(), limit: int | None = None
) -> DataFrame:
    """The features of all submissions, stored: every score of a job reads this table."""
    return cut_lineage(build_features(submissions, options, limit))


def analyze_fast(
    submissions: DataFrame,
    targets: DataFrame,
    options: TextOptions = TextOptions(),
    features: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Raw, processed, structure and token scores of each pair.

    ``features`` are those of an earlier run (``preprocess_with_cache``); without them they are
    built once. A pair with a text above ``limit`` bytes keeps its row with NULL scores. A target
    that does not exist has a row with ``error`` and no ``other``.
    """
    rows = feature_table(submissions, options, limit) if features is None else features
    fitting = rows.filter(F.col("error").isNull())
    shown = rows.withColumn("raw_text", F.when(F.col("error").isNull(), F.col("raw_text")))
    exact = text_ratios(shown, targets, {"raw_text": "raw", "processed_text": "processed"})
    scored = (
        exact.join(shape_scores(fitting, targets, options.preserve_variable_names), PAIR, "left")
        .join(token_scores(fitting, targets), PAIR, "left")
        .select(*PAIR, "raw", "processed", "ast", "token", "cover")
    )
    absent = missing_targets(targets, rows).select("corpus_id", "target", F.col("reason").alias("error"))
    return scored.withColumn("error", F.lit(None).cast("string")).unionByName(absent, allowMissingColumns=True)


def analyze_sparse(
    submissions: DataFrame,
    targets: DataFrame,
    options: TextOptions = TextOptions(),
    vectors: DataFrame | None = None,
    features: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The fast scores with TF-IDF cosine and, if vectors are given, dense cosine."""
    rows = feature_table(submissions, options, limit) if features is None else features
    fitting = rows.filter(F.col("error").isNull())
    scored = analyze_fast(submissions, targets, options, rows).join(
        tfidf_cosine(fitting, targets, "processed_text"), PAIR, "left"
    )
    if vectors is not None:
        scored = scored.join(vector_cosine(vectors, targets), PAIR, "left")
    return scored


def analyze_vector(
    submissions: DataFrame,
    targets: DataFrame,
    chunks: DataFrame,
    options: TextOptions = TextOptions(),
    k: int = TOP_K,
    agg: str = "min",
    centres: list[list[float]] | None = None,
) -> DataFrame:
    """Fast scores of the files among the ``k`` nearest chunks of each target.

    ``chunks(namespace, name, chunk_no, embedding)`` has the corpus as namespace; all chunks of
    the target are its query, and a chunk is as near as it is to the nearest of them. With the
    ``centres`` of an index, ``chunks`` is that index, and only cells that can hold them are read.
    """
    asked = targets.select(F.col("corpus_id").alias("namespace"), F.col("target").alias("name"))
    queries = chunks.join(asked, ["namespace", "name"], "left_semi").select(
        "namespace", F.col("name").alias("query"), "embedding"
    )
    hits = vector_topk(chunks, queries, k) if centres is None else index_topk(chunks, queries, centres, k)
    near = file_scores(hits, agg).select(
        F.col("namespace").alias("corpus_id"), F.col("query").alias("target"), "name",
        F.col("score").alias("vector"),
    )
    # At most k files per target, so the subset is short beside the submissions.
    wanted = near.select("corpus_id", "name").unionByName(
        targets.select("corpus_id", F.col("target").alias("name"))
    ).distinct()
    subset = whole_texts(submissions).join(wanted, ["corpus_id", "name"], "left_semi")
    scored = analyze_fast(subset, targets, options)
    return scored.join(near.withColumnRenamed("name", "other"), PAIR, "left").select(
        *PAIR, "raw", "processed", "ast", "token", "cover",
        F.when(F.col("error").isNull(), F.coalesce("vector", F.lit(0.0))).alias("vector"), "error",
    )


def buffer_report(spark: SparkSession, spool: str, buffer_id: str, options: TextOptions = TextOptions()) -> DataFrame:
    """From a saved buffer to its ranked report: the submission that arrived first against the rest."""
    saved = buffered_submissions(spark, spool, buffer_id)
    return ranked_report(analyze_fast(saved, default_targets(saved), options))


def ranked_report(scores: DataFrame) -> DataFrame:
    """Scores with the overall match and its band, ranked within each target.

    Scores that differ only by the order of a sum, beyond nine places, tie; the name decides.
    """
    present = [F.col(m) for m in METRICS if m in scores.columns]
    overall = S.overall_match(F.array_compact(F.array(*present)))
    best = Window.partitionBy("corpus_id", "target").orderBy(F.desc(F.round("overall", 9)), "other")
    return (
        scores.withColumn("overall", overall)
        .withColumn("band", S.overall_band(F.col("overall")))
        .withColumn("rank", F.row_number().over(best))
        .orderBy("corpus_id", "target", "rank")
    )
