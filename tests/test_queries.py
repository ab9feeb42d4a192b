"""Registered queries against DuckDB on the smallest tables. All of them run with
``python -m packsift_oracle.compare FOLDER``."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from packsift_oracle.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "domain_categories", "text_signals", "dependency_edges", "string_constants", "contacted_domains", "data_flows", "batch_summary", "code_urls",
    "url_classes", "sql_functions", "relative_paths", "store_category", "manifest_facts", "network_rule_findings", "call_sites", "final_findings",
    "category_states", "narratives", "batch_metrics", "batch_numbers", "top_order_lines", "reputation_cache", "request_limits", "review_parsing",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql_of_the_same_name():
    from packsift.plans.queries import QUERIES
    from packsift_oracle.sql import SQL
    assert set(SQL) == set(QUERIES) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_matches_duckdb(spark, duck, name):
    verdict, info = compare(spark, duck, FOLDER, queries()[name], oracle_sql()[name])
    assert verdict == "ok", info
