"""One query per operator over the given tables. ``checks.oracle`` holds the matching SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import tables as D
from semblance.functions import scores as S
from semblance.functions import text as X
from semblance.functions import urls as U
from semblance.operators import blocks as B
from semblance.operators import corpus as C
from semblance.operators import features as A
from semblance.operators import harvest as V
from semblance.operators import incremental as I
from semblance.operators import matching as M
from semblance.operators import pairs as P
from semblance.operators import runs as R
from semblance.operators import sentences as SE
from semblance.operators import tfidf as TF
from semblance.operators import token_scores as TS
from semblance.operators import trees as TR
from semblance.operators import vector_index as VI
from semblance.operators import vectors as VE
from semblance.operators import verify as Q
from semblance.operators import workspaces as W
from semblance.plans import analysis as AN
from semblance.plans import ingest as IN
from semblance.plans import regions as RE
from semblance.plans.harvest import refresh_urls
from semblance.plans.preprocess import preprocess_with_cache
from semblance.session import checkpoint_folder, cut_lineage, local_checkpoints, stored_table
from semblance.settings import MAX_TEXT_BYTES
from semblance.sources import files as SF
from semblance.sources import sinks as SK
from semblance.sources import tables as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FIXED_TIME = "2024-01-01 00:00:00"
AS_OF = "2024-01-15 12:00:00"
SIZE_LIMIT = 4000
PATH_PATTERNS = ["*/en/*", "*.org/??/1*", "m.th[a-h]*", ".net"]


def query(fn: Query) -> Query:
    """Register ``fn``; whole numbers leave as BIGINT and fractions rounded to six places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(local_checkpoints(spark), sf_dir)
        out = []
        for field in df.schema.fields:
            col = F.col(f"`{field.name}`")
            if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
                col = col.cast("bigint")
            elif isinstance(field.dataType, T.DoubleType):
                col = F.round(col, 6)
            out.append(col.alias(field.name))
        return df.select(*out)

    QUERIES[fn.__name__] = run
    return fn


def _targets(subs: DataFrame) -> DataFrame:
    return P.default_targets(subs)


def _counted(items):
    return lambda rows: P.item_counts(rows, items)


# ---- sources and sinks ----


@query
def src_submissions(spark, sf):
    return D.submissions(spark, sf).select("corpus_id", "name", F.length("raw_text").alias("n_chars"))


@query
def src_features(spark, sf):
    features = A.build_features(D.submissions(spark, sf), limit=MAX_TEXT_BYTES)
    return ST.features_of(features).select("corpus_id", "name", F.size("tokens").alias("n_tokens"))


@query
def notebook_cells(spark, sf):
    return D.notebooks(spark, sf).select("conv_id", "turn", SF.notebook_code(F.col("content")).alias("code"))


@query
def page_articles(spark, sf):
    return SF.page_articles(D.pages(spark, sf)).select("page_id", "name", "raw_text")


@query
def buffer_rows(spark, sf):
    rows = SK.buffer_rows(D.submissions(spark, sf), "b1", F.lit(FIXED_TIME).cast("timestamp"))
    return rows.select(
        F.col("corpus_id").alias("buffer_id"), "name", F.length("raw_text").alias("n_chars"),
        F.unix_micros("created_at").alias("created_us"), F.unix_micros("expires_at").alias("expires_us"),
    )


@query
def buffer_live(spark, sf):
    rows = D.workspaces(spark, sf).select(
        "event_id", F.col("created_at"), SK.expiry(F.col("created_at")).alias("expires_at")
    )
    live = ST.live_buffers(rows, F.lit(AS_OF).cast("timestamp"))
    return live.select("event_id", F.unix_micros("expires_at").alias("expires_us"))


@query
def feature_upsert(spark, sf):
    subs = D.submissions(spark, sf)
    stored = A.build_features(D.cached_submissions(spark, sf)).select("corpus_id", "name", "processed_text")
    labels = D.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("name"))
    fresh = subs.join(labels, "name").unionByName(D.removed_submissions(spark, sf))
    updates = A.build_features(fresh).select("corpus_id", "name", "processed_text")
    return I.upsert_features(stored, subs, updates)


@query
def workspace_delete(spark, sf):
    spaces = D.workspaces(spark, sf)
    # Every user asks to delete the workspace after each of their own; few of these are theirs.
    asked = spaces.select((F.col("event_id") + 1).cast("string").alias("instance_id"), "username")
    return W.delete_workspaces(spaces, asked).select("instance_id", "username", "name")


@query
def workspace_update(spark, sf):
    spaces = D.workspaces(spark, sf)
    updates = spaces.select(
        (F.col("event_id") + 1).cast("string").alias("instance_id"), "username",
        F.array(F.lit("u/"), F.col("instance_id")).alias("github_urls"),
    )
    return W.update_urls(spaces, updates).select(
        "instance_id", "username", F.array_join("github_urls", "|").alias("urls")
    )


@query
def namespace_drop(spark, sf):
    return VE.drop_namespace(D.vectors(spark, sf), "3").select("namespace", "vec_id")


# ---- filters and projections ----


@query
def path_filter_exclude(spark, sf):
    path = F.substring_index("url", "//", -1)
    pages = D.table(spark, sf, "pages").select("page_id", path.alias("path"))
    return pages.select(
        "page_id", U.keeps_member(F.col("path"), PATH_PATTERNS).alias("member_kept"),
        U.keeps_file(F.col("path"), ["??", "*.net", "1*"]).alias("file_kept"),
    )


@query
def path_filter_include(spark, sf):
    path = F.substring_index("url", "//", -1)
    pages = D.table(spark, sf, "pages").select("page_id", path.alias("path"))
    return pages.filter(U.keeps_member(F.col("path"), PATH_PATTERNS, exclude=False)).select(
        "page_id", U.keeps_file(F.col("path"), ["1*"], exclude=False).alias("file_kept"),
        U.keeps_file(F.col("path"), [], exclude=False).alias("none_kept"),
        U.keeps_file(F.col("path"), ["*"], exclude=False).alias("all_kept"),
    )


@query
def nonblank_docs(spark, sf):
    lines = D.submissions(spark, sf).select(
        "corpus_id", "name", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "line")
    )
    return lines.filter(X.is_nonblank(F.col("line"))).groupBy("corpus_id", "name").agg(
        F.count("*").alias("n_lines"), F.sum("line_no").alias("line_sum")
    )


@query
def size_guard(spark, sf):
    return A.guard_size(D.submissions(spark, sf), SIZE_LIMIT).select("corpus_id", "name", "error")


@query
def strip_comments(spark, sf):
    return D.submissions(spark, sf).select("corpus_id", "name", X.strip_comments(F.col("raw_text")).alias("text"))


@query
def normalize_ws(spark, sf):
    return D.submissions(spark, sf).select("corpus_id", "name", X.normalize_ws(F.col("raw_text")).alias("text"))


@query
def anon_literals(spark, sf):
    return D.submissions(spark, sf).select("corpus_id", "name", X.anonymize_literals(F.col("raw_text")).alias("text"))


@query
def processed_text(spark, sf):
    return D.code_modules(spark, sf).select("corpus_id", "name", X.preprocess(F.col("raw_text")).alias("text"))


@query
def content_hash(spark, sf):
    return D.submissions(spark, sf).select("corpus_id", "name", X.content_hash(F.col("raw_text")).alias("hash"))


@query
def token_stream(spark, sf):
    return A.token_stream(D.submissions(spark, sf))


@query
def chunk_sentences(spark, sf):
    return SE.sentence_chunks(D.submissions(spark, sf), 100, 20)


@query
def chunk_docs(spark, sf):
    return A.chunk_texts(D.submissions(spark, sf))


@query
def url_kind(spark, sf):
    return D.url_variants(spark, sf).select(
        "page_id", "variant", U.url_kind(F.col("url")).alias("kind"), U.fetch_url(F.col("url")).alias("fetched")
    )


@query
def url_filename(spark, sf):
    return D.url_variants(spark, sf).select(
        "page_id", "variant", U.url_filename(F.col("url"), F.col("disposition")).alias("filename"),
        U.repo_name(F.col("url")).alias("repo"), U.clean_name(F.col("url")).alias("clean"),
        U.without_extension(F.col("url")).alias("stem"),
    )


@query
def url_box(spark, sf):
    boxes = D.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit(" \n\t"), "url", F.lit(" \n\n"), F.lower("url"), F.lit("\n  ")).alias("box")
    )
    return boxes.select("page_id", F.explode(U.parse_url_box(F.col("box"))).alias("url"))


@query
def missing_targets(spark, sf):
    items = D.table(spark, sf, "benchmark")
    corpus = F.concat(F.lit("src"), F.col("item_id").cast("string"))
    asked = items.select(corpus.alias("corpus_id"), F.col("item_id").cast("string").alias("target")).unionByName(
        items.select(corpus.alias("corpus_id"), (F.col("item_id") + 1).cast("string").alias("target"))
    )
    return P.missing_targets(asked, D.submissions(spark, sf))


@query
def pair_lookup(spark, sf):
    items = D.table(spark, sf, "benchmark")
    item, folder = F.col("item_id"), (F.col("item_id") % 2).cast("string")
    source = F.concat(F.lit("src"), item.cast("string"))

    def file(number):
        return F.concat(folder, F.lit("/"), number.cast("string"))

    # The same files by two names whose parts, put together, read alike.
    asked = items.select(source.alias("corpus_id"), file(item).alias("file1"), file(item + 20).alias("file2")).unionByName(
        items.select(
            F.concat(source, F.lit("/"), folder).alias("corpus_id"), item.cast("string").alias("file1"),
            (item + 20).cast("string").alias("file2"),
        )
    )
    found, _, errors = RE.pair_corpora(D.nested_submissions(spark, sf), asked)
    return found.select(
        "corpus_id.corpus_id", "corpus_id.file1", "name", F.length("raw_text").cast("string").alias("note")
    ).unionByName(errors.select("corpus_id", F.lit(None).cast("string").alias("file1"), "name", F.col("reason").alias("note")))


# ---- corpus building ----


@query
def zip_rollup(spark, sf):
    built = C.archive_submissions(D.members(spark, sf), ["*.pdf", "__MACOSX"])
    return built.select("archive", "name", "raw_text", "n_members")


@query
def archive_single(spark, sf):
    return C.archive_as_single(D.members(spark, sf)).select("name", "raw_text", "n_members")


@query
def archive_limit(spark, sf):
    built = C.archive_as_single(D.members(spark, sf), limit=SIZE_LIMIT)
    return built.select("archive", "part_no", F.length("raw_text").alias("n_chars"), "n_members")


@query
def archives_merged(spark, sf):
    return IN.extract_archives(D.members(spark, sf))


@query
def last_wins(spark, sf):
    turns = D.table(spark, sf, "conversations")
    return C.last_wins(turns, ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "text")


@query
def extract_counts(spark, sf):
    built = C.archive_submissions(D.members(spark, sf))
    return C.extract_summary(built, ["archive"])


@query
def default_target(spark, sf):
    return _targets(D.submissions(spark, sf))


# ---- pairs and metrics ----


@query
def target_pairs(spark, sf):
    subs = D.submissions(spark, sf)
    return P.target_pairs(subs, _targets(subs))


@query
def tfidf_weights(spark, sf):
    return TF.tfidf_weights(D.submissions(spark, sf))


@query
def tfidf_cosine(spark, sf):
    subs = D.submissions(spark, sf)
    return TF.tfidf_cosine(subs, _targets(subs))


@query
def raw_bound(spark, sf):
    subs = D.submissions(spark, sf)
    return P.bag_scores(subs, _counted(X.characters(F.col("raw_text"))), _targets(subs), "bound", 1.0)


@query
def processed_bound(spark, sf):
    subs = D.submissions(spark, sf)
    items = X.characters(X.preprocess(F.col("raw_text")))
    return P.bag_scores(subs, _counted(items), _targets(subs), "bound", 1.0)


@query
def token_dice(spark, sf):
    subs = D.submissions(spark, sf)
    return P.bag_scores(subs, _counted(X.tokens(X.preprocess(F.col("raw_text")))), _targets(subs), "dice", 0.0)


@query
def shape_similarity(spark, sf):
    subs = D.submissions(spark, sf)
    return AN.shape_scores(subs, _targets(subs))


@query
def tree_grams(spark, sf):
    grams = TR.tree_grams(D.nested_names(spark, sf), preserve_names=True)
    return grams.select("corpus_id", "name", F.array_join(F.array_sort("grams"), ";").alias("grams"))


@query
def tree_similarity(spark, sf):
    names = D.nested_names(spark, sf)
    return TR.tree_scores(names, _targets(names), preserve_names=True)


@query
def structure_profile(spark, sf):
    return A.structure_profile(D.code_modules(spark, sf))


@query
def raw_ratio(spark, sf):
    subs = D.submissions(spark, sf)
    return P.text_scores(subs, _targets(subs), {"raw_text": "raw"})


@query
def processed_ratio(spark, sf):
    subs = D.submissions(spark, sf).withColumn("processed_text", X.preprocess(F.col("raw_text")))
    return P.text_scores(subs, _targets(subs), {"processed_text": "processed"})


@query
def best_names(spark, sf):
    """The three part names of each brand most like its first, by bounds before exact ratios."""
    names = D.part_names(spark, sf)
    return Q.best_pairs(names, _targets(names), 3).select(*P.PAIR, "ratio", "rank", "n_pairs")


@query
def best_ratios(spark, sf):
    subs = D.submissions(spark, sf)
    return Q.best_pairs(subs, _targets(subs), 3)


@query
def token_ratio(spark, sf):
    subs = D.submissions(spark, sf)
    return TS.token_scores(AN.feature_table(subs), _targets(subs))


@query
def analyze_fast(spark, sf):
    subs = D.submissions(spark, sf)
    return AN.analyze_fast(subs, _targets(subs))


@query
def analyze_sparse(spark, sf):
    subs = D.submissions(spark, sf)
    return AN.analyze_sparse(subs, _targets(subs))


@query
def analyze_names(spark, sf):
    """All scores of short texts: every part name against the first of its brand."""
    names = D.part_names(spark, sf)
    return AN.analyze_sparse(names, _targets(names)).drop("error")


@query
def analyze_parts(spark, sf):
    """All scores of texts that come in two parts each: the words of every part name."""
    names = D.part_names(spark, sf)
    parts = names.select("corpus_id", "name", "ingest_order", F.posexplode(F.split("raw_text", " ")).alias("part_no", "raw_text"))
    return AN.analyze_sparse(parts, _targets(parts)).drop("error")


@query
def buffer_report(spark, sf):
    """Files uploaded into a saved buffer, then scored and ranked: every part name as a file."""
    files = D.part_names(spark, sf).select(
        F.concat("name", F.lit(".txt")).alias("name"), "ingest_order", F.encode("raw_text", "UTF-8").alias("content")
    )
    spool = f"{checkpoint_folder(spark).rstrip('/')}/buffers-{uuid.uuid4().hex}"
    report = AN.buffer_report(spark, spool, IN.build_corpus(spool, files=files))
    return report.select("target", "other", "raw", "processed", "ast", "token", "overall", "band", "rank")


# ---- regions ----


@query
def code_blocks(spark, sf):
    return B.code_blocks(D.code_modules(spark, sf))


@query
def block_norm(spark, sf):
    blocks = B.with_norm(B.code_blocks(D.code_modules(spark, sf)))
    return blocks.select("corpus_id", "name", "block", "norm")


def _modules(spark, sf):
    """``code_modules``, written once for the steps that read them."""
    return stored_table(D.code_modules(spark, sf), "modules")


def _matches(modules):
    # Counted as well as matched, so the blocks are found once and stored.
    blocks = B.stored_blocks(modules)
    return blocks, B.block_matches(modules, _targets(modules), blocks=blocks)


def _flat_lines(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in ("lines1", "lines2")],
        F.col("lines1.start").alias("start1"), F.col("lines1.end").alias("end1"),
        F.col("lines2.start").alias("start2"), F.col("lines2.end").alias("end2"),
    )


@query
def block_matches(spark, sf):
    return _flat_lines(_matches(D.code_modules(spark, sf))[1]).withColumn("band", S.block_band(F.col("similarity")))


@query
def top_regions(spark, sf):
    return _flat_lines(RE.top_blocks(_matches(D.code_modules(spark, sf))[1]))


@query
def region_stats(spark, sf):
    modules = _modules(spark, sf)
    blocks, matched = _matches(modules)
    targets = _targets(modules)
    runs = R.token_runs(modules, targets)
    return RE.region_stats(P.target_pairs(modules, targets), blocks, matched, runs)


@query
def token_runs(spark, sf):
    subs = D.submissions(spark, sf)
    return R.token_runs(subs, _targets(subs))


@query
def longest_matches(spark, sf):
    subs = D.submissions(spark, sf)
    return M.longest_matches(M.pair_matches(subs, _targets(subs)))


@query
def best_matches(spark, sf):
    subs = D.submissions(spark, sf)
    return M.best_matches(M.pair_matches(subs, _targets(subs)))


@query
def token_tiles(spark, sf):
    """Tilings of short texts: every part name against the first of its brand."""
    names = D.part_names(spark, sf)
    tiled = M.token_tiles(names, _targets(names), 2)
    shown = F.transform("tiles", lambda t: F.concat_ws(":", t["pos1"], t["pos2"], t["token_count"]))
    return tiled.select(*M.PAIR, F.array_join(shown, " ").alias("tiles"), "tiled", "tile_ratio")


@query
def tile_ratio(spark, sf):
    subs = D.submissions(spark, sf)
    return M.token_tiles(subs, _targets(subs)).select(*M.PAIR, "tiled", "tile_ratio")


@query
def token_matches(spark, sf):
    subs = D.submissions(spark, sf)
    return RE.top_runs(R.token_runs(subs, _targets(subs)))


@query
def region_report(spark, sf):
    modules = _modules(spark, sf)
    return RE.region_report(modules, _targets(modules))


# ---- vectors ----


def _queries(chunks: DataFrame) -> DataFrame:
    first = chunks.groupBy("namespace").agg(F.min("vec_id").alias("vec_id"))
    return chunks.join(first, ["namespace", "vec_id"], "left_semi").select(
        "namespace", F.col("name").alias("query"), "embedding"
    )


@query
def vector_cosine(spark, sf):
    rows = D.vectors(spark, sf).select(
        F.col("namespace").alias("corpus_id"), F.col("vec").alias("name"), "embedding", F.col("vec_id").alias("ingest_order")
    )
    return VE.vector_cosine(rows, _targets(rows))


@query
def vector_topk(spark, sf):
    chunks = D.vectors(spark, sf)
    return VE.vector_topk(chunks, _queries(chunks))


@query
def vector_index_topk(spark, sf):
    """The same rows from a stored index, to which the second half of the vectors was added later."""
    chunks = D.vectors(spark, sf)
    centres = VI.fit_cells(chunks)
    path = f"{checkpoint_folder(spark)}/vector-index-{uuid.uuid4().hex}"
    VI.write_index(chunks.filter(F.col("vec_id") % 2 == 0), centres, path)
    VI.write_index(chunks.filter(F.coalesce(F.col("vec_id") % 2, F.lit(1)) != 0), centres, path)
    return VI.index_topk(spark.read.parquet(path), _queries(chunks), centres)


@query
def file_scores(spark, sf):
    chunks = D.vectors(spark, sf)
    return VE.file_scores(VE.vector_topk(chunks, _queries(chunks)))


@query
def chunk_manifest(spark, sf):
    return VE.chunk_manifest(A.chunk_texts(D.submissions(spark, sf)))


@query
def analyze_vector(spark, sf):
    """Every document has three chunks; the vectors are dealt to them in turn."""
    subs = D.submissions(spark, sf)
    vectors = D.table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    chunks = subs.select(
        F.col("corpus_id").alias("namespace"), "name", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("chunk_no"), "ingest_order"
    ).withColumn("vec_id", (F.col("ingest_order") * 5 + F.col("chunk_no") * 11) % n)
    return AN.analyze_vector(subs, _targets(subs), chunks.join(vectors, "vec_id").drop("vec_id", "ingest_order"))


# ---- incremental work ----


@query
def cache_new(spark, sf):
    return I.new_submissions(D.submissions(spark, sf), D.cached_submissions(spark, sf)).select("corpus_id", "name")


@query
def cache_valid(spark, sf):
    return I.valid_cache(D.cached_submissions(spark, sf), D.submissions(spark, sf)).select("corpus_id", "name")


@query
def cache_merged(spark, sf):
    cached = A.build_features(D.cached_submissions(spark, sf))
    merged, _ = preprocess_with_cache(D.submissions(spark, sf), cached)
    return merged.select("corpus_id", "name", X.content_hash(F.col("processed_text")).alias("hash"), F.size("tokens").alias("n_tokens"))


@query
def cache_status(spark, sf):
    return I.cache_status(D.submissions(spark, sf), D.cached_submissions(spark, sf))


@query
def changed_files(spark, sf):
    manifest = D.cached_submissions(spark, sf).select("corpus_id", "name", X.content_hash(F.col("raw_text")).alias("content_hash"))
    return I.changed_files(D.submissions(spark, sf), manifest).select("corpus_id", "name", "content_hash", "status")


# ---- harvest and workspaces ----


@query
def latest_messages(spark, sf):
    return V.latest_messages(D.messages(spark, sf), D.marks(spark, sf), limit=30).select(
        "channel_id", "tag", "msg_id", "rank"
    )


@query
def tag_urls(spark, sf):
    return V.tag_urls(V.latest_messages(D.messages(spark, sf), D.marks(spark, sf)))


@query
def cache_upsert(spark, sf):
    messages, marks = D.messages(spark, sf), D.marks(spark, sf)
    # The cache of an earlier run: every address seen so far, with its first message.
    cached = messages.select(
        "channel_id", F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("tag"),
        F.explode(U.find_urls(F.col("content"))).alias("url"), F.col("msg_id").alias("pos"),
    ).groupBy("channel_id", "tag", "url").agg(F.min("pos").alias("pos"))
    old = marks.withColumn("last_scraped_at", F.lit(FIXED_TIME).cast("timestamp"))
    merged, heads = refresh_urls(messages, cached, old, F.lit(AS_OF).cast("timestamp"))
    return merged.join(heads, ["channel_id", "tag"], "left").select(
        "channel_id", "tag", "url", "age", "p1", "p2", "last_message_id",
        F.unix_micros("last_scraped_at").alias("scraped_us"),
    )


def _url_lists(spark, sf):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return D.table(spark, sf, "pages").select(
        "page_id", F.array(F.col("url"), host, F.col("url")).alias("new"),
        F.array(host, F.lit("old"), F.lit("old"), F.lower("url")).alias("old"),
        F.array(F.col("url"), F.lower("url"), host).alias("again"),
    )


@query
def url_merge(spark, sf):
    return _url_lists(spark, sf).select(
        "page_id", F.array_join(U.merge_urls(F.col("new"), F.col("old")), " ").alias("merged")
    )


@query
def url_changed(spark, sf):
    return _url_lists(spark, sf).select(
        "page_id", U.urls_changed(F.col("new"), F.col("old")).alias("changed"),
        U.urls_changed(F.col("new"), F.col("again")).alias("changed_again"),
    )


@query
def workspaces_newest(spark, sf):
    ranked = W.newest_first(D.workspaces(spark, sf), ["username"], "event_id")
    return ranked.select("username", "instance_id", "name", F.unix_micros("created_at").alias("created_us"), "rank")


@query
def history_by_user(spark, sf):
    history = D.workspaces(spark, sf).select(
        "username", F.col("name").alias("instance_id"), "created_at", "event_id"
    )
    everything = history.select("username", F.lit(None).cast("string").alias("instance_id")).distinct()
    asked = everything.unionByName(history.select("username", F.lit("click").alias("instance_id")).distinct())
    found = W.look_up_history(history, asked)
    return W.newest_first(found, ["username", "asked"], "event_id").select(
        "username", "asked", "event_id", F.unix_micros("created_at").alias("created_us"), "rank"
    )


# ---- reports ----


def _native_scores(spark, sf):
    subs = D.submissions(spark, sf)
    targets = _targets(subs)
    dice = P.bag_scores(subs, _counted(X.tokens(F.col("raw_text"))), targets, "token", 0.0)
    return dice.join(AN.shape_scores(subs, targets), P.PAIR).join(TF.tfidf_cosine(subs, targets), P.PAIR)


@query
def overall_match(spark, sf):
    # Rounded scores are often equal, so that the most frequent value counts.
    scores = _native_scores(spark, sf)
    rounded = F.array(*[F.round(m, 1) for m in ("ast", "token", "cosine")])
    return scores.select(*P.PAIR, S.overall_match(rounded).alias("overall"))


@query
def ranked_report(spark, sf):
    return AN.ranked_report(_native_scores(spark, sf))


@query
def score_bands(spark, sf):
    subs = D.submissions(spark, sf)
    scores = P.bag_scores(subs, _counted(X.tokens(F.col("raw_text"))), _targets(subs), "score", 0.0)
    return scores.select(
        *P.PAIR, S.overall_band(F.col("score")).alias("overall_band"), S.block_band(F.col("score")).alias("block_band")
    )


@query
def flagship(spark, sf):
    """Every corpus: the default target against the rest by TF-IDF cosine, ranked."""
    subs = D.submissions(spark, sf)
    return AN.ranked_report(TF.tfidf_cosine(subs, _targets(subs)))
