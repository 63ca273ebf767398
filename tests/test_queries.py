"""Every registered query with SQL against DuckDB on the smallest tables, and the contract's shape."""

import duckdb
import pytest

import __spark_entry__ as registry
from tarnlake import queries as statistics

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Few, so that the tests stay short; the driver compares them all.
SOME = ["describe_groups", "encode_label_first_seen", "knn_search", "radius_search", "dbscan", "impute_by_group", "split_stratified", "roc_points", "metrics_ranked", "kruskal_wallis", "p_adjustments", "linear_model", "regression_stump", "composition_ilr", "recipe_steps"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    cur = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=str)
    assert got == expected


def test_contract(spark):
    assert registry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries()) and set(statistics.QUERIES) <= set(registry.queries())
