"""Estimators, the training loop, forests and hulls on whole tables, and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import estimator, glm, metrics, optimize, outliers, plotdata, smooth, splits, trees
from tarnlake.sources.persistence import load_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1]
    return spark.createDataFrame([(i, float(a), float(b), float(v), "p" if v > 1 else "n") for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double, c string").repartition(3).persist()


def test_estimator(rows):
    e = estimator.Regressor(lambda df, columns, y, **o: glm.fit_lm(df, y, columns, **o), ridge=0.0)
    with pytest.raises(RuntimeError):
        e.predict(rows)
    with pytest.raises(ValueError):
        e.fit(rows, ["nothing"], "y")
    e.fit(rows.select("a", "b", "y"), y="y")
    assert e.columns == ["a", "b"] and e.score(rows) == pytest.approx(1) and e.get_params() == {"ridge": 0.0}
    wide = rows.withColumns({f"w{k}": F.lit(0.0) for k in range(101)})
    e._arguments(wide, [f"w{k}" for k in range(101)], "y")
    assert e.has_warnings() and len(e.warnings("size")) == 1 and not e.warnings("other")
    e.clear_warnings()
    assert not e.has_warnings() and load_model(e.save())["columns"] == ["a", "b"]
    c = estimator.Classifier(lambda df, columns, y: trees.DecisionTree(max_depth=4).fit(df, columns, y)).fit(rows, ["a", "b"], "c")
    assert {r[0] for r in c.predict(rows).select("prediction").distinct().collect()} == {"n", "p"} and c.score(rows) > 0.85


def brute_split(x, y):
    """The best cut of a column of numbers by squared error."""
    best = None
    for t in sorted(set(x))[:-1]:
        a, b = y[x <= t], y[x > t]
        loss = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
        if best is None or loss < best[0] - 1e-9:
            best = (loss, t)
    return best


def test_tree_takes_every_cut(rows):
    """Cuts are exact however many values a column has, and one more value changes nothing elsewhere."""
    data = np.array(rows.select("a", "b", "y").orderBy("id").collect(), float)
    t = trees.DecisionTree("regression", max_depth=1).fit(rows, ["a", "b"], "y")
    (la, ta), (lb, tb) = (brute_split(data[:, k], data[:, 2]) for k in (0, 1))
    column, at = (0, ta) if la < lb else (1, tb)
    after = data[data[:, column] > at, column].min()
    assert t.nodes[1]["feature"] == "ab"[column] and t.nodes[1]["threshold"] == pytest.approx((at + after) / 2)
    deep = trees.DecisionTree("regression", max_depth=7).fit(rows, ["a", "b"], "y")
    assert deep.predict(rows).agg(metrics.r2("y", "prediction")).first()[0] > 0.95
    binned = trees.DecisionTree("regression", max_depth=1, max_bins=8).fit(rows, ["a", "b"], "y")
    assert binned.nodes[1]["feature"] == t.nodes[1]["feature"] and abs(binned.nodes[1]["threshold"] - t.nodes[1]["threshold"]) < 0.4


def test_forest_grows_as_single_trees(spark, rows):
    """A forest's trees are those that each weight gives alone, and the vote is that of their own predictions."""
    f = trees.RandomForest(n_estimators=4, max_depth=3, max_features=2).fit(rows, ["a", "b"], "c", "id")
    for k, t in enumerate(f.trees):
        drawn = rows.withColumn("w", f._weight(k, "id")).where("w > 0")
        alone = trees.DecisionTree(max_depth=3, max_features=2, seed=t.seed).fit(drawn, ["a", "b"], "c", "w")
        assert {i: (d.get("feature"), d.get("threshold")) for i, d in alone.nodes.items()} == {i: (d.get("feature"), d.get("threshold")) for i, d in t.nodes.items()}
    each = rows.select("id", *(t.prediction().alias(f"p{k}") for k, t in enumerate(f.trees)))
    got = f.predict(rows).join(each, "id").collect()
    for r in got:
        votes = [r[f"p{k}"] for k in range(4)]
        assert votes.count(r["prediction"]) == max(votes.count(v) for v in votes)


def test_training_loop(rows):
    def squares(w, x, y):
        away = w[0] + x @ w[1:] - y
        return (away**2).sum(), 2 * np.concatenate([[away.sum()], x.T @ away])

    seen = []
    r = optimize.train(squares, rows, ["a", "b"], "y", "id", np.zeros(3), optimize.GradientDescent(rate=0.2), 30, 3, (lambda e, loss, w, o: seen.append(loss),))
    assert np.allclose(r["params"], [1, 2, -1], atol=1e-3) and len(seen) == 30 and seen[-1] < seen[0]
    stop = optimize.EarlyStopping(patience=2)
    assert optimize.train(squares, rows, ["a", "b"], "y", "id", np.array([1.0, 2.0, -1.0]), "adam", 50, callbacks=(stop,))["epochs"] < 50


def test_network_learns_from_all_rows(rows):
    m = smooth.MLPRegressor((8,), "tanh", 50, 0.05, 32, task_rows=200).fit(rows, ["a", "b"], "y", "id")
    assert m.evaluate(rows, "y")["r2"] > 0.95 and m.losses[-1] < m.losses[0]


def test_isolation_trees_draw_from_all_rows(rows):
    out = outliers.IsolationForest(50, 64).fit(rows.union(rows.limit(1).selectExpr("9999L", "50.0", "50.0", "0.0", "'n'")), ["a", "b"], "id")
    assert out.score_samples(rows.limit(1).selectExpr("9999L as id", "50.0 as a", "50.0 as b")).first()["score"] < -0.6
    small = outliers.IsolationForest(4, 8).fit(rows, ["a", "b"], "id")  # disjoint draws
    assert len(small.trees) == 4 and small.size == 8


def test_hulls_are_exact(spark, rows):
    points = rows.withColumn("g", F.col("id") % 3)
    got = {r["g"]: {(p["x"], p["y"]) for p in r["corners"]} for r in plotdata.group_hulls(points, "a", "b", "g").collect()}
    for g in range(3):
        own = [(r["a"], r["b"]) for r in points.where(F.col("g") == g).collect()]
        assert got[g] == set(plotdata.convex_hull(own))


def test_kappa_and_random_numbers(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 1), (3, 3), (1, 3)], "y int, p int")
    po, pe = 4 / 6, (3 * 3 + 2 * 1 + 1 * 2) / 36
    assert metrics.cohen_kappa(df, "y", "p") == pytest.approx((po - pe) / (1 - pe))
    u = rows.select(splits.random_numbers("id", 1).alias("u"), splits.random_integers("id", 0, 4, 1).alias("k"))
    assert u.where("u < 0 or u >= 1 or k < 0 or k > 3").isEmpty() and u.select("k").distinct().count() == 4


def test_stream(spark, tmp_path):
    """Two files arrive one after the other; a batch that is run again replaces its own rows."""
    from tarnlake.streaming import apply_to_stream

    schema = "id long, v double"
    for k in range(2):
        spark.createDataFrame([(k * 10 + i, float(i)) for i in range(3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        apply_to_stream(stream, lambda d: d.withColumn("v", F.col("v") * 2), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out/*").collect()
    assert sorted((r["id"], r["v"]) for r in got) == [(k * 10 + i, 2.0 * i) for k in range(2) for i in range(3)]
