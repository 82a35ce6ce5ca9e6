"""Incremental preprocessing: features only for submissions that have none yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.operators.features import build_features
from semblance.operators.incremental import merge_cache, new_submissions, valid_cache
from semblance.settings import TextOptions

FEATURES = ["corpus_id", "name", "raw_text", "processed_text", "tokens", "ast", "error"]


def preprocess_all(submissions: DataFrame, options: TextOptions = TextOptions()) -> DataFrame:
    return build_features(submissions, options).select(*FEATURES)


def preprocess_with_cache(
    submissions: DataFrame, cached: DataFrame, options: TextOptions = TextOptions()
) -> tuple[DataFrame, DataFrame]:
    """All current features and, separately, the newly built ones to be saved."""
    fresh = preprocess_all(new_submissions(submissions, cached), options)
    valid = valid_cache(cached, submissions).select(*FEATURES)
    return merge_cache(valid, fresh), fresh


def with_embeddings(features: DataFrame, vectors: DataFrame) -> DataFrame:
    """Feature rows with ``dense_embedding`` from ``vectors(corpus_id, name, embedding)``, NULL
    where a submission has none."""
    dense = vectors.select("corpus_id", "name", F.col("embedding").alias("dense_embedding"))
    return features.join(dense, ["corpus_id", "name"], "left")
