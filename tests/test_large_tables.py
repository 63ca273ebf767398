"""What larger tables asked for: no bound on rows, every gain, forests in passes over sorted rows, exact sums."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tarnlake.operators import cluster, ordination, trees

SF = "/root/testdata/sf0.001"


def test_single_linkage_of_one_column_takes_any_number_of_rows(spark):
    rng = np.random.default_rng(5)
    values = [*rng.integers(0, 60, 25).astype(float).tolist(), 7.0, 7.0]
    small = spark.createDataFrame(list(enumerate(values)), "row_id long, x double")
    h, m = cluster.HCA("single").fit(small, ["x"], "row_id"), cluster.LineLinkage().fit(small, "x", "row_id")
    assert [(r["step"], r["gap"]) for r in m.heights().orderBy("step").collect()] == [(k + 1, d) for k, (_, _, d, _) in enumerate(h.merges)]

    def parts(label: dict) -> set:
        return {frozenset(i for i in label if label[i] == c) for c in label.values()}

    for height in (0.0, 2.0, 100.0):
        got = {r["id"]: r["cluster"] for r in m.cut_height(height).collect()}
        assert parts(got) == parts(h.cut_height(height)) and all(got[c] == c and c <= i for i, c in got.items())
        assert parts({r["id"]: r["cluster"] for r in m.cut(len(set(got.values()))).collect()}) == parts(got)
    many = spark.range(5500).select("id", (F.col("id") * F.col("id")).cast("double").alias("x"))  # HCA holds 5000 at most
    gaps = [r["gap"] for r in cluster.LineLinkage().fit(many, "x", "id").heights().orderBy("step").collect()]
    assert gaps == [2.0 * k + 1 for k in range(5499)]


def test_heights_are_of_all_suppliers(spark):
    n = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert registry.queries()["hierarchy_heights"](spark, SF).count() == n - 1 and "s_nationkey" not in registry.oracle_sql()["hierarchy_heights"]


def test_cut_of_more_than_5000_suppliers(spark, tmp_path):
    gaps = F.col("id") + F.floor(F.col("id") / 1500) * 400  # four clusters
    spark.range(6000).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey"), gaps.cast("double").alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.queries()["hierarchy_cut"](spark, str(tmp_path)).groupBy("first").count().orderBy("first").collect()
    assert [tuple(r) for r in got] == [(k * 1500, 1500) for k in range(4)]


@pytest.mark.parametrize("name", ["pca_rotation", "recipe_pca"])
def test_axes_of_a_negative_correlation(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    assert con.execute("SELECT corr(l_quantity, l_extendedprice) FROM lineitem").fetchall()[0][0] < 0
    got = sorted(tuple(r) for r in registry.queries()[name](spark, SF).collect())
    assert got == sorted(con.execute(registry.oracle_sql()[name]).fetchall())


def test_axes_of_columns_that_hardly_correlate(monkeypatch):
    v1, v2 = 94.24, 127.57  # of which rounding makes unequal diagonals
    tie = 1e-9 * np.sqrt(v1 * v2)
    monkeypatch.setattr(ordination, "covariance", lambda df, columns: (1000, np.zeros(2), np.array([[v1, tie], [tie, v2]])))
    m = ordination.PCA(True, True).fit(None, ["a", "b"])
    assert np.abs(np.abs(m.vectors) - np.sqrt(0.5)).max() < 1e-15


def test_a_tree_takes_the_least_gain_allowed(spark, tmp_path):
    flags = spark.range(8000).select(F.lit(0).alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(0).alias("l_partkey"), F.when(F.col("id") % 4 < 2, "R").otherwise("N").alias("l_returnflag"), F.when(F.col("id") % 2 == 1, "O").otherwise("F").alias("l_linestatus"))
    flags.write.parquet(f"{tmp_path}/lineitem.parquet")  # both flags independent: nothing is gained
    got = registry.queries()["tree_classifier"](spark, str(tmp_path)).orderBy("o").collect()
    assert [tuple(r) for r in got] == [(0.0, 0.5, 0, 2, 2), (1.0, 0.5, 0, 3, 2)]
    m = trees.DecisionTree(max_depth=1).fit(flags.select(F.col("l_linestatus").alias("y"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("r")), ["r"], "y")
    assert m.split_counts() == {"r": 0}


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_a_forest_of_sorted_chunks_is_that_of_sums_by_value(spark, monkeypatch, task):
    x = [F.pmod(F.xxhash64(F.lit(j), "id"), F.lit(n)).cast("int") for j, n in enumerate((150, 7))]  # many ties, across chunks too
    rows = spark.range(700).select("id", x[0].alias("a"), x[1].alias("b"), F.pmod(F.col("id") + x[0] * x[1], F.lit(3)).cast("int").alias("y")).persist()
    grown = []
    for columns in (0, 4):
        monkeypatch.setattr(trees, "SORTED_COLUMNS", columns)
        monkeypatch.setattr(trees, "CHUNK_ROWS", 50)
        m = trees.RandomForest(task, n_estimators=3, max_depth=3, seed=4).fit(rows, ["a", "b"], "y", "id")
        grown.append([{i: (d.get("feature"), d.get("threshold"), np.round(d["stats"], 6).tolist(), round(d.get("gain", 0.0), 9)) for i, d in t.nodes.items()} for t in m.trees])
    assert grown[0] == grown[1] and all(len(t) > 3 for t in grown[0])


def test_levels_of_a_forest_shuffle_nothing(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("sums by value are shuffled at every level")

    monkeypatch.setattr(trees, "running_totals", refuse)
    rows = spark.range(300).select("id", (F.col("id") % 50).alias("a"), (F.col("id") > 120).alias("y"))
    m = trees.RandomForest(n_estimators=2, max_depth=2).fit(rows, ["a"], "y", "id")
    assert m.predict(rows).count() == 300 and all(len(t.nodes) > 1 for t in m.trees)
