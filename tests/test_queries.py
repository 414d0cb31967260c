"""Registered queries against their SQL on the smallest tables, and what their plans must look like."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import TABLES, canonical
from plumbline.operators import clean
from tests.conftest import SF
from workload import catalog
from workload.tables import table

# The largest plans are compared by check_queries.py only.
SLOW = {"encode_label_wide", "vector_search_many", "sequence_windows_segmented", "box_stats_narrowed"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - SLOW))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, SF)
    result = db.sql(oracle_sql()[name])
    assert canonical(df.columns, df.collect()) == canonical(list(result.columns), result.fetchall())


def test_catalog():
    assert set(oracle_sql()) <= set(queries())
    assert not [n for n in catalog.QUERIES if re.match(r"op\d|pipeline|llm", n)]


def test_entry(spark):
    rows = entry(spark).collect()
    assert [r["figure"] for r in rows][:2] == ["平均price", "平均quantity"] and len(rows) == 8


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_outlier_filters_reach_the_scan(spark):
    text = plan(clean.remove_outliers(table(spark, SF, "events"), cols=["value"]))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(value", text)
    text = plan(table(spark, SF, "lineitem").select("l_tax"))
    assert "ReadSchema: struct<l_tax:double>" in text


@pytest.mark.parametrize("name", ["group_means_and_ratio", "encode_label", "box_stats", "chi_square", "vector_search", "nearest_neighbour_classifier"])
def test_no_pairwise_joins(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_group_means_do_not_shuffle_rows(spark):
    assert "Exchange hashpartitioning" not in plan(queries()["group_means_and_ratio"](spark, SF))


def test_top_k_is_trimmed_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(queries()["vector_search"](spark, SF))
    assert "WindowGroupLimit" in plan(queries()["category_profile_5"](spark, SF))
