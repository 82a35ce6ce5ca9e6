"""The thin registered queries of the operators, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.llm import ann, bpe, decontaminate, hard_negatives, html_extract, langid, pii, quality, simhash, substrings, token_counts, toxicity, whitening
from semblance.llm.storage import held_out, new_folder
from semblance.session import local_checkpoints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(local_checkpoints(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out("doc_id", 4, 2)))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels.filter(~held_out("doc_id", 4, 2)))
    return quality.score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


@query
def op3_html(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op4_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op5_substrings(spark, sf_dir):
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_removed", "first_docs")


@query
def op6_decontaminate(spark, sf_dir):
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels.filter(~held_out("doc_id", 3, 1)))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@query
def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark, sf_dir):
    # A cache of its own per call: every distinct content is a miss and is encoded.
    cache = new_folder(spark, "token-cache")
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, cache)


@query
def op10_bpe(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path))


@query
def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query
def op12_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find(docs, pii.train(docs)))


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE["op6_decontaminate"] = r"""
WITH items AS (
    SELECT row_number() OVER () AS nr, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words
    FROM benchmark
), item_grams AS (
    SELECT DISTINCT nr, item_id, least(5, len(words)) AS width,
           unnest([array_to_string(words[i : i + least(5, len(words)) - 1], ' ')
                   FOR i IN range(1, len(words) - least(5, len(words)) + 2)]) AS gram
    FROM items WHERE len(words) > 0
), docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents
), doc_grams AS (
    SELECT DISTINCT row, doc_id, width,
           unnest([array_to_string(words[i : i + width - 1], ' ') FOR i IN range(1, len(words) - width + 2)]) AS gram
    FROM docs, (SELECT DISTINCT width FROM item_grams) WHERE len(words) >= width
), met AS (
    SELECT d.row, any_value(d.doc_id) AS doc_id, i.nr, any_value(i.item_id) AS item_id, count(*) AS n
    FROM doc_grams d JOIN item_grams i USING (width, gram) GROUP BY d.row, i.nr
)
SELECT doc_id, item_id, n / size AS containment
FROM met JOIN (SELECT nr, count(*) AS size FROM item_grams GROUP BY nr) USING (nr)
WHERE n / size >= 0.8
"""

ORACLE["op11_hard_negatives"] = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), met AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
), positives AS (
    SELECT * FROM met WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN met n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
