"""Registered queries against DuckDB on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
# The whole set runs with ALL_QUERIES=1 (or python tests/oracle.py).
QUICK = (
    "group_agg filter_ops filter_region filter_dates raw_rows kpis dashboard_kpis category_breakdown histogram null_stats duplicate_rows "
    "numeric_stats correlation zscore_outliers score_num_cat score_cat_cat sanitize validate heal_impute daily_series trend_line "
    "label_encode stratified_folds write_dataset narrative profile_narrative chart_texts vector_topk keyword_search overlap tfidf_top detect_keys event_rate latency_p95 "
    "profile_increments value_clusters neighbour_information inclusion_dependencies column_keys keyword_index phrase_index dataset_versions"
).split()
KEYS = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, key):
    problem, _, _ = oracle.compare(spark, duck, entry.queries()[key], entry.oracle_sql()[key], SF)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "l_returnflag"
