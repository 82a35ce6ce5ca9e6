import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.catalog import QUERIES
from checks.compare import check, duck
from checks.oracle import ORACLE

SMALL = "/root/testdata/sf0.001"
FAST = [
    "src_submissions", "notebook_cells", "page_articles", "path_filter_exclude", "processed_text", "zip_rollup",
    "archive_limit", "target_pairs", "tfidf_cosine", "token_dice", "shape_similarity", "structure_profile",
    "code_blocks", "block_norm", "token_runs", "vector_topk", "cache_merged", "changed_files", "cache_upsert",
    "workspace_update", "longest_matches", "token_tiles", "tree_similarity", "chunk_sentences",
]
# Exact sequence ratios of long texts; best_ratios has SQL over short texts as best_names.
WITHOUT_SQL = {
    "raw_ratio", "processed_ratio", "analyze_fast", "analyze_sparse", "analyze_vector", "region_report", "best_ratios",
}


def test_every_query_has_sql_unless_it_needs_a_kernel():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, con, name):
    assert check(spark, con, SMALL, name, queries()[name], oracle_sql()[name]).startswith("ok")


def test_flagship(spark):
    rows = entry(spark).collect()
    assert rows and rows[0].overall >= rows[1].overall
