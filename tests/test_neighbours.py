"""Neighbours, clusters and components against brute force, with cells and blocks made small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import expressions as ex
from tarnlake.operators import cluster, impute, kernels, neighbours


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.round(np.concatenate([rng.normal(size=(250, 3)), rng.normal(size=(60, 3)) * 0.05 + 2]), 2)
    x[40:70] = x[0]  # copies beyond k
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(900, None, 1.0, 1.0), (901, float("nan"), 0.0, 0.0)], "id long, a double, b double, c double").repartition(4)
    return x, df


def brute(x, d, k, skip):
    out = set()
    for i in range(len(x)):
        near = sorted((d[i, j], j) for j in range(len(x)) if not (skip and i == j))[:k]
        out |= {(i, j, round(float(v), 9), p + 1) for p, (v, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "canberra"])
def test_nearest(points, monkeypatch, metric):
    x, df = points
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 32)
    got = neighbours.nearest(df, df, ["a", "b", "c"], 4, "id", "id", metric, skip_self=True).collect()
    assert {(r["id_l"], r["id_r"], round(r["distance"], 9), r["place"]) for r in got} == brute(x, neighbours.distances(metric, x, x), 4, True)


def test_nearest_without_product(points):
    _, df = points
    for metric in ("euclidean", ex.euclidean):
        plan = neighbours.nearest(df, df, ["a", "b"], 2, "id", "id", metric)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    a, b = (neighbours.nearest(df.where("id < 900"), df.where("id < 900"), ["a", "b"], 2, "id", "id", m).orderBy("id_l", "place").collect() for m in ("euclidean", ex.euclidean))
    assert [(r["id_l"], r["id_r"], r["place"]) for r in a] == [(r["id_l"], r["id_r"], r["place"]) for r in b]


def test_distances_are_those_of_expressions(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(12, 3)), 1)
    x[0] = 0
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    for metric, f in ex.DISTANCES.items():
        both = df.crossJoin(df.select(F.col("id").alias("j"), *(F.col(c).alias(f"{c}2") for c in "abc"))).select("id", "j", f(["a", "b", "c"], ["a2", "b2", "c2"]).alias("d"))
        d = neighbours.distances(metric, x, x)
        assert all(abs(d[r["id"], r["j"]] - r["d"]) < 1e-12 for r in both.collect()), metric


def test_tree_of_equal_rows():
    tree = neighbours.CellTree(np.zeros((50, 2)), 8)
    assert tree.leaves == 1 and set(tree.cells(np.ones((3, 2)))) == {0}
    x = np.random.default_rng(0).normal(size=(500, 2))
    tree = neighbours.CellTree(x, 8)
    assert tree.leaves == 8 and len(set(tree.cells(x))) == 8


@pytest.mark.parametrize("width", [1, 2, 3])
def test_dbscan(points, monkeypatch, width):
    x, df = points
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 8)
    eps, least = {1: 0.02, 2: 0.25, 3: 0.5}[width], 5
    x = x[:, :width]
    near = neighbours.distances("euclidean", x, x) <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    n = 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            n, todo = n + 1, [i]
            label[i] = n
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(near[j] & core & (label < 0)):
                    label[k] = n
                    todo.append(k)
    expected = {i: int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))} | {900: -1, 901: -1}
    columns = list("abc"[:width])
    model = cluster.DBSCAN(eps, least)
    assert {r["id"]: r["cluster"] for r in model.fit_predict(df, columns, "id").collect()} == expected
    wide = df.withColumns({c: F.lit(0.0) for c in "def"})
    assert {r["id"]: r["cluster"] for r in cluster.DBSCAN(eps, least).fit_predict(wide, [*columns, "d", "e", "f"], "id").collect()} == expected
    assert {r["id"]: r["cluster"] for r in model.predict(df.where("id < 900")).collect() if core[r["id"]]} == {i: v for i, v in expected.items() if i < 900 and core[i]}


def test_components_take_few_rounds(spark):
    """A chain in shuffled order: rounds grow with the logarithm of its length."""
    order = np.random.default_rng(0).permutation(400).tolist()
    df = spark.createDataFrame([*zip(order, order[1:]), (1000, 1000), (2000, 2001)], "u long, v long")
    rounds = []
    got = {r["node"]: r["component"] for r in kernels.components(df, rounds=rounds).collect()}
    assert got == {k: 0 for k in range(400)} | {1000: 1000, 2000: 2000, 2001: 2000} and rounds[0] <= 12


def test_silhouettes(points, monkeypatch):
    x, df = points
    df = df.where("id < 900").withColumn("l", F.when(F.col("id") == 5, 9).otherwise(F.col("id") % 3).cast("int"))
    label = np.where(np.arange(len(x)) == 5, 9, np.arange(len(x)) % 3)
    for columns, size in ((["a"], 20), (["a"], 10**6), (["a", "b"], 50)):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", size)
        monkeypatch.setattr(cluster, "BLOCK_ROWS", size)
        d = neighbours.distances("euclidean", x[:, : len(columns)], x[:, : len(columns)])
        for r in cluster.silhouette_samples(df, columns, "l", "id").collect():
            i = r["id"]
            own = label == label[i]
            a = d[i, own].sum() / (own.sum() - 1) if own.sum() > 1 else 0.0
            b = min(d[i, label == k].mean() for k in set(label) - {label[i]})
            assert r["a"] == pytest.approx(a) and r["b"] == pytest.approx(b) and r["s"] == pytest.approx((b - a) / max(a, b))


def test_knn_impute(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(60, 3)), 2)
    gone = rng.random((60, 3)) < 0.25
    gone[0], gone[1] = True, [True, False, False]
    rows = [(i, *(None if g else float(v) for v, g in zip(x[i], gone[i], strict=True))) for i in range(60)]
    got = {r["id"]: r for r in impute.knn_impute(spark.createDataFrame(rows, "id long, a double, b double, c double"), ["a", "b", "c"], "id", k=3).collect()}
    for i in range(60):
        near = []
        for j in range(60):
            both = ~gone[i] & ~gone[j]
            if i != j and both.any() and (d := float(np.sqrt(((x[i] - x[j])[both] ** 2).sum()))) >= 1e-10:
                near.append((d, j))
        near = [j for _, j in sorted(near)[:3]]
        for c in range(3):
            have = [x[j, c] for j in near if not gone[j, c]]
            expected = x[i, c] if not gone[i, c] else np.mean(have) if have else x[~gone[:, c], c].mean()
            assert got[i]["abc"[c]] == pytest.approx(expected), (i, c)
