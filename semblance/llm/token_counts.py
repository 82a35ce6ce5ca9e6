"""Token counts through a digest cache.

The cache is a Parquet table ``(version, digest, n_tokens)`` in a shared folder, partitioned by
``version``, the digest of the tokenizer file. Contents are normalised in a way that cannot change
a count, digested, and joined to the cache; each distinct miss is encoded once and appended.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.llm.storage import stored

TOKEN_LIMIT = 2048
# Words whose counts a worker remembers, and the length of the longest one.
REMEMBERED_WORDS = 500_000
REMEMBERED_CHARS = 64
CACHE_SCHEMA = "digest binary, n_tokens long, version string"


@lru_cache(maxsize=4)
def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def blanks_fold(path: str) -> bool:
    """Whether a tokenizer file itself turns each run of white space into one blank."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    folds = any(
        s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps
    )
    # A special string with a blank in it, or one that takes blanks beside it, forbids folding.
    plain = not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    return folds and plain


def normal_content(text: Column, path: str) -> Column:
    """Content with what cannot change its count taken out; NULL is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, r"[ \t\n\r]+", " ") if blanks_fold(path) else text


def words_apart(path: str) -> bool:
    """Whether a tokenizer file never joins what a blank parts: blanks are folded, and the parts it
    keeps of a text hold none, so the counts of the words of a text add up to that of the text."""
    if not blanks_fold(path):
        return False
    with open(path, encoding="utf-8") as file:
        steps = (json.load(file).get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    pattern = first.get("pattern", {}).get("Regex", " ")
    others = re.findall(r"\[\^[^\]]*\]", pattern)
    rest = re.sub(r"\[\^[^\]]*\]", "", pattern)
    plain = not re.search(r"[ .]|\\[sSWDPH]", rest) and all(r"\s" in c for c in others)
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and plain


class WordCounter:
    """Counts of texts from the counts of their words; the library encodes each new word once."""

    def __init__(self, encode: Callable[[list[str]], list[int]]):
        self.encode = encode
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        parts = [text.split(" ") for text in texts]
        fresh = list({word for words in parts for word in words}.difference(self.known))
        self.known.update(zip(fresh, self.encode(fresh)))
        counts = [sum(map(self.known.__getitem__, words)) for words in parts]
        for word in fresh:
            if len(word) > REMEMBERED_CHARS:
                del self.known[word]
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """``texts -> counts`` of the library of a tokenizer file, loaded once per worker."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()

        def count(texts: list[str]) -> list[int]:
            return [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

        return WordCounter(count) if words_apart(path) else count
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty where nothing is stored yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    # Two jobs may have appended the same content; both counts are equal.
    return found.filter(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress contents for the shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [press.compress(t.encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "digest", "content"]
        )


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, unpress = counter(path), zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [unpress.decompress(t).decode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count(texts), pa.int64())], ["digest", "n_tokens"]
                )

    return run


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs(doc_id, text)``.

    The counts of contents that the cache in folder ``cache`` lacks are appended to it first. A
    NULL text counts as empty; repeated rows and NULL ids keep a row each; other columns are
    ignored; an empty table gives an empty result and leaves the cache alone.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        normal_content(F.col("text"), path).alias("content"),
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    known = read_cache(spark, cache, version)
    narrow = stored(rows.select("doc_id", "n_bytes", "digest"), "digests")
    # One row stands for each missing digest: the lowest id, found without moving any content.
    missing = narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(known, "digest", "left_anti")
    packed = rows.select("doc_id", "digest", "content").mapInArrow(
        _pack, "doc_id long, digest binary, content binary"
    )
    one_each = packed.join(
        missing.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi",
    )
    counted = one_each.select("digest", "content").mapInArrow(_count(path), "digest binary, n_tokens long")
    counted.withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    return narrow.join(read_cache(spark, cache, version), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
