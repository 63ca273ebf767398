import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import distributions as D
from tarnlake.functions import special as sp
from tarnlake.functions.formula import apply_formula, parse_formula
from tarnlake.operators import cluster, composition, describe, glm, impute, interpret, kernels, metrics, optimize, ordination, outliers, prepare, smooth, splits, tests, trees
from tarnlake.plans.pipeline import BranchPipeline, distributions, grid_search_cv, parameter_grid, sample_from
from tarnlake.plans.recipe import recipe
from tarnlake.sources import persistence, tables

near = lambda v, tol=1e-6: pytest.approx(v, abs=tol)


def frame(spark, **columns):
    names = list(columns)
    even = [[float(x) if isinstance(x, int) and any(isinstance(y, float) for y in c) else x for x in c] for c in columns.values()]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*even, strict=True))], ["row_id", *names])


def test_special_functions():
    assert sp.t_cdf(2.228138852, 10) == near(0.975)
    assert sp.f_sf(4.256494729, 2, 9) == near(0.05)
    assert sp.chi2_sf(7.814727903, 3) == near(0.05)
    assert sp.gamma_p(30, 25) + sp.gamma_q(30, 25) == near(1)
    assert sp.studentized_range_quantile(0.95, 3, 10) == near(3.877, 2e-3)
    assert sp.normal_quantile(0.975) == near(1.959963985)


def test_distributions():
    assert D.Gamma(2, 1).cdf(1) == near(0.2642411)
    assert D.Beta(2, 2).cdf(0.5) == near(0.5)
    assert D.qchisq(0.95, 4) == near(9.487729, 1e-5)
    for d, xs in ((D.Normal(1, 2), (-1, 0.5, 3)), (D.Uniform(1, 3), (1.5, 2)), (D.Gamma(3, 2), (1, 6)), (D.Beta(2, 5), (0.2, 0.7)), (D.ChiSquare(5), (1, 9))):
        for x in xs:
            assert d.quantile(d.cdf(x)) == near(x, 1e-6)


def test_table_helpers(spark):
    df = tables.normalize(spark, [{"x": 1.0, "y": 2.0, "group": "A"}, {"x": 2.0, "y": 4.0, "group": "A"}, {"x": float("nan"), "y": 6.0, "group": None}])
    assert tables.na_omit(df, ["x", "group"]).count() == 2
    assert tables.to_columns(df.limit(2), ["y"], "x") == {"y": [2.0, 4.0]}
    assert tables.select(df, ["x", "absent"]).columns == ["x", "absent"]
    assert tables.na_omit_flag(None, False) is False and tables.na_omit_flag(True, False) is True
    with pytest.raises(Exception, match="no number"):
        tables.to_matrix(df, ["group"]).collect()
    small = df.where("group = 'A'").select("y", "x")
    out = tables.apply_columns(small, small.select("y", (F.col("x") * 10).alias("x")), ["x"], "y")
    assert sorted(r["x"] for r in out.collect()) == [10.0, 20.0]


def test_encoders_and_scalers(spark):
    df = frame(spark, species=["setosa", "versicolor", "setosa", None], v=[1.0, 2.0, 3.0, 4.0])
    enc = prepare.LabelEncoder().fit(df, "species", "row_id")
    assert [r["species"] for r in enc.transform(df, "species").orderBy("row_id").collect()] == [0.0, 1.0, 0.0, None]
    back = enc.inverse(enc.transform(df, "species"), "species").orderBy("row_id").collect()
    assert [r["species"] for r in back] == ["setosa", "versicolor", "setosa", None]
    with pytest.raises(Exception, match="unknown label"):
        prepare.LabelEncoder("error", ["setosa"]).transform(df, "species").collect()
    hot = prepare.OneHotEncoder().fit(df, ["species"]).transform(df).orderBy("row_id").collect()
    assert [r["species_setosa"] for r in hot] == [1.0, 0.0, 1.0, 0.0]
    s = prepare.StandardScaler().fit(df, ["v"])
    assert [r["v"] for r in s.inverse_transform(s.transform(df)).orderBy("row_id").collect()] == near([1.0, 2.0, 3.0, 4.0])
    m = prepare.MinMaxScaler(-1, 1).fit_transform(df, ["v"]).orderBy("row_id").collect()
    assert [r["v"] for r in m] == near([-1, -1 / 3, 1 / 3, 1])
    p = prepare.prepare_xy(df, ["v"], "species", order="row_id")
    assert p.data.count() == 3 and p.y == "species"
    text = frame(spark, t=["12abc", " -3.5e2x", "none", None])
    assert [r["t"] for r in prepare.parse_numeric(text, ["t"]).orderBy("row_id").collect()] == [12.0, -350.0, None, None]
    both = prepare.Preprocessor(label=["species"], order="row_id").fit(df)
    assert "species_idx" in both.transform(df).columns


def test_describe(spark):
    df = frame(spark, v=[1.0, 2.0, 3.0, float("nan"), 10.0])
    row = df.agg(describe.mean("v"), describe.stddev("v"), describe.quantile("v", [0.25, 0.5]), describe.percentile_of("v", 3), describe.maximum("v")).first()
    assert row[0] == near(4) and row[1] == near(np.std([1, 2, 3, 10], ddof=1)) and row[2] == near([1.75, 2.5]) and row[3] == near(0.75) and row[4] == 10
    assert describe.nearest_quantile(df, "v", 0.5) == 2.0
    assert describe.mode(frame(spark, c=["b", "a", "a", "b"]), "c", "row_id") == "b"
    assert [r.value for r in describe.value_range(spark, 0, 1, 0.25).orderBy("value").collect()] == near([0, 0.25, 0.5, 0.75, 1])
    with pytest.raises(Exception, match="missing"):
        df.agg(describe.mean("v", omit=False)).collect()


def test_running_totals_and_ranks(spark):
    v = [5, 3, 3, 9, 1, 3, 9, 7, 7, 2] * 7
    df = frame(spark, v=v)
    got = {r["v"]: r["rank"] for r in kernels.value_ranks(df, "v").collect()}
    order = sorted(v)
    assert got == {x: near(sum(i + 1 for i, y in enumerate(order) if y == x) / order.count(x)) for x in set(v)}
    pos = [(r["row_id"], r["position"]) for r in kernels.positions(df, [F.col("v"), F.col("row_id")]).collect()]
    assert sorted(pos, key=lambda p: p[1]) == [(i, k + 1) for k, (_, i) in enumerate(sorted((x, i) for i, x in enumerate(v)))]


def test_gram_of_many_columns(spark):
    x = np.random.default_rng(0).normal(size=(40, 30))
    df = spark.createDataFrame(x.tolist(), [f"c{k}" for k in range(30)])
    assert np.allclose(kernels.covariance(df, df.columns)[2], np.cov(x.T))


def test_formula(spark):
    f = parse_formula("log(y) ~ a*b + I(x^2) - a + (1 | g)")
    assert f.terms == [("b",), ("a", "b"), ("I(x^2)",)] and f.random[0].group == "g"
    assert parse_formula("y ~ x - 1").intercept is False and parse_formula("y ~ 0 + x").intercept is False
    df = frame(spark, y=[1.0, 2.0], x=[math.e, math.e**2])
    out, names, _ = apply_formula(df, "y ~ log(x) + poly(x, 2)")
    assert names == ["(Intercept)", "log(x)", "x", "x^2"]
    assert [r["x1"] for r in out.orderBy("y").collect()] == near([1, 2])
    with pytest.raises(ValueError):
        parse_formula("y = x")
    with pytest.raises(ValueError):
        apply_formula(df, "y ~ system(x)")


def test_hypothesis_tests(spark):
    g = lambda *lists: spark.createDataFrame([(float(v), k) for k, vs in enumerate(lists) for v in vs], ["v", "g"])
    kw = tests.kruskal_wallis(g(range(1, 6), range(6, 11), range(11, 16)), "v", "g")
    assert kw["statistic"] == near(12.5) and kw["df"] == 2
    lv = tests.levene_test(g(range(1, 6), range(2, 7), range(3, 8)), "v", "g")
    assert lv["statistic"] < 0.1 and (lv["df_between"], lv["df_within"]) == (2, 12)
    pt = tests.paired_t_test(frame(spark, a=[10.0, 12, 11, 14, 13], b=[12.0, 14, 13, 16, 15]), "a", "b")
    assert pt["statistic"] == -math.inf and pt["p_value"] == 0
    fe = tests.fisher_exact_test([[3, 1], [1, 3]])
    assert fe["p_value"] == near(0.485714) and fe["odds_ratio"] == near(9)
    cs = tests.chi_square_test(frame(spark, o=[10, 20, 30], e=[15.0, 20.0, 25.0]), "o", "e")
    assert cs["df"] == 2 and cs["statistic"] == near(25 / 15 + 1)
    a = tests.one_way_anova(g([1, 2, 3], [4, 5, 6], [7, 8, 9]), "v", "g")
    assert a["statistic"] == near(27) and tests.eta_squared(a) == near(0.9)
    t = tests.two_sample_t_test(g([1, 2, 3], [4, 5, 6]), "v", "g")
    assert t["statistic"] == near(-3.674235) and t["p_value"] == near(0.021312, 1e-5)
    u = tests.mann_whitney_u(g([1, 2, 3], [4, 5, 6]), "v", "g")
    assert u["statistic"] == 0
    assert tests.tukey_hsd(g([1, 2, 3], [4, 5, 6], [7, 8, 9]), "v", "g")["comparisons"][1]["significant"]
    assert tests.pearson_correlation(frame(spark, x=[1.0, 1, 1], y=[1.0, 2, 3]), "x", "y")["p_value"] == 1
    p = frame(spark, p=[0.01, 0.04, 0.03])
    assert [r["adjusted"] for r in tests.holm_bonferroni(p).orderBy("row_id").collect()] == near([0.03, 0.06, 0.06])
    assert [r["adjusted"] for r in tests.fdr(p).orderBy("row_id").collect()] == near([0.03, 0.04, 0.04])
    assert "p_value" in tests.OneWayAnova().fit(g([1, 2], [3, 5]), value="v", group="g").summary()


def test_glm_against_known_values(spark):
    y = [3, 5, 7, 6, 9, 11, 10, 13, 15, 17]
    df = frame(spark, x1=[float(k) for k in range(1, 11)], x2=[2.0, 3, 4, 3, 5, 6, 5, 7, 8, 9], y=[float(v) for v in y])
    m = glm.fit_glm(df, "y", ["x1", "x2"])
    assert m.coefficients == near([-0.0734, 0.4404, 1.3945], 1e-4) and m.standard_errors == near([0.1319, 0.0552, 0.0727], 1e-4)
    assert (m.deviance, m.null_deviance, m.aic, m.bic) == near((0.1468, 182.4, -5.8347, -4.6243), 1e-3)
    p = glm.fit_glm(df, "y", ["x1"], "poisson")
    fitted = p.predict(df).agg(F.sum("prediction")).first()[0]
    assert fitted == near(sum(y), 1e-4)
    for family in ("gamma", "inverse_gaussian", "negative_binomial"):
        r = glm.fit_glm(df, "y", ["x1"], family, "log")
        assert r.converged and all(math.isfinite(b) for b in r.coefficients) and r.deviance < r.null_deviance
    assert glm.likelihood_ratio_test(glm.fit_glm(df, "y", ["x1"]), m)["p_value"] < 0.01
    assert sum(r["weight"] for r in glm.compare_models({"a": m, "b": glm.fit_glm(df, "y", ["x1"])})) == near(1)
    back = glm.GLMResult.load(m.save())
    assert back.coefficients == m.coefficients
    low = m.predict(df, interval=True).first()
    assert low["prediction_lower"] < low["prediction"] < low["prediction_upper"]
    probit = glm.fit_glm(df.withColumn("b", F.when(F.col("x1") % 3 > 0, 1.0).otherwise(0.0)), "b", ["x2"], "binomial", "probit")
    assert all(math.isfinite(b) for b in probit.coefficients)


def test_mixed_and_multinomial(spark):
    rows = [(float(x), 2.0 * x + d + e, g) for g, d in (("A", 0.0), ("B", 3.0), ("C", -3.0)) for x, e in ((1, 0.1), (2, -0.1), (3, 0.05), (4, -0.05))]
    df = spark.createDataFrame(rows, ["x", "y", "g"])
    m = glm.fit_glmm(df, "y", ["x"], "g", max_iter=8)
    u = {r["g"]: r["effect"] for r in m.effects.collect()}
    assert m.fixed.coefficients[1] == near(2, 0.05) and u["B"] > 2 and u["C"] < -2
    assert m.predict(spark.createDataFrame([(1.0, "Z")], ["x", "g"])).first()["prediction"] is not None
    c = spark.createDataFrame([(float(k % 10), "lo" if k % 10 < 4 else "mid" if k % 10 < 7 else "hi") for k in range(40)] + [(5.0, "lo"), (2.0, "hi"), (8.0, "mid")], ["x", "y"])
    mm = glm.fit_multinomial(c, "y", ["x"])
    p = mm.predict(c, "probabilities").first()
    assert sum(p[f"prediction_{k}"] for k in mm.classes) == near(1)


def test_imputation(spark):
    nan = float("nan")
    df = frame(spark, a=[1.0, 4, 7, nan], b=[2.0, nan, 8, 11], c=[3.0, 6, nan, 12])
    got = impute.simple_impute(df, ["a", "b", "c"]).orderBy("row_id").collect()
    assert [tuple(r[1:]) for r in got] == [(1, 2, 3), (4, 7, 6), (7, 8, 7), (4, 11, 12)]
    line = frame(spark, a=[1.0, 2, 3, 4, 5, 6], b=[2.0, 4, 6, nan, 10, 12])
    assert impute.iterative_impute(line, ["a", "b"]).orderBy("row_id").collect()[3]["b"] == near(8)
    knn = impute.knn_impute(df, ["a", "b", "c"], "row_id", k=1).orderBy("row_id").collect()
    assert all(v is not None for r in knn for v in r)


def test_outliers(spark):
    pts = [(0.1 * (k % 5), 0.1 * (k % 3)) for k in range(10)] + [(100.0, 100.0), (-100.0, -100.0)]
    df = frame(spark, x=[p[0] for p in pts], y=[p[1] for p in pts])
    for out in (outliers.isolation_forest(df, ["x", "y"], "row_id", contamination=0.17), outliers.local_outlier_factor(df, ["x", "y"], "row_id", n_neighbors=3, contamination=0.17)):
        assert {r["row_id"] for r in out.where("label = -1").collect()} >= {10, 11} and out.where("label = -1").count() <= 3


def test_clusters(spark):
    df = frame(spark, x=[1.0, 2, 3, 10, 11, 12])
    m = cluster.KMeans(2).fit(df, ["x"], "row_id", [[1.0], [12.0]])
    assert sorted(c[0] for c in m.centroids) == near([2, 11]) and m.inertia == near(4)
    assert m.silhouette(df, "row_id") > 0.7
    sq = [(x + i, y + j) for x, y in ((0, 0), (10, 10)) for i in (0, 0.5) for j in (0, 0.5)] + [(5.0, 5.0)]
    d = frame(spark, x=[float(p[0]) for p in sq], y=[float(p[1]) for p in sq])
    db = cluster.DBSCAN(1.0, 3)
    assert [r["cluster"] for r in db.fit_predict(d, ["x", "y"], "row_id").orderBy("row_id").collect()] == [1] * 4 + [2] * 4 + [-1]
    assert [r["cluster"] for r in db.predict(d).orderBy("row_id").collect()] == [1] * 4 + [2] * 4 + [-1]
    h = cluster.HCA("average").fit(frame(spark, x=[0.0, 0, 10, 10], y=[0.0, 1, 10, 11]), ["x", "y"], "row_id")
    assert len(h.merges) == 3 and h.cut(2) == {0: 0, 1: 0, 2: 1, 3: 1} and h.cut_height(1.5) == h.cut(2)
    c = cluster.ConsensusCluster().fit(frame(spark, a=[0, 0, 1, 1], b=[1, 1, 0, 0], c=[0, 0, 0, 1]), "row_id", ["a", "b", "c"])
    lab = {r["row_id"]: r["cluster"] for r in c.labels.collect()}
    assert lab[0] == lab[1] != lab[2] == lab[3] and 0 < c.agreement() < 1 and c.strength().count() == 2


def test_trees_and_forest(spark):
    df = frame(spark, x=[float(k) for k in range(20)], z=[float(k % 4) for k in range(20)], y=["a" if k < 8 else "b" for k in range(20)], v=[1.0 if k < 8 else 5.0 for k in range(20)])
    t = trees.DecisionTree().fit(df, ["x", "z"], "y")
    assert t.predict(df).where("prediction != y").count() == 0 and t.nodes[1]["threshold"] == 7.5
    assert [r["path"] for r in t.decision_path(df).orderBy("row_id").limit(1).collect()] == [[1, 2]]
    assert "x <= 7.5" in t.export_text() and "digraph" in t.export_dot()
    r = trees.DecisionTree("regression").fit(df, ["x", "z"], "v")
    assert r.predict(df).where("abs(prediction - v) > 1e-9").count() == 0
    f = trees.RandomForest(n_estimators=5, max_depth=3, max_features=2, oob=True).fit(df, ["x", "z"], "y", "row_id")
    assert f.predict(df).where("prediction = y").count() >= 15 and f.oob_score > 0.7 and sum(f.feature_importances().values()) == near(1)


def test_smoothers(spark):
    xs = [-2 + 4 * i / 79 for i in range(80)]
    df = frame(spark, x=xs, y=[math.sin(x) for x in xs], c=["B" if x > 0.5 else "A" for x in xs])
    for basis in ("tp", "bs"):
        g = smooth.GAMRegressor(basis=basis).fit(df, ["x"], "y")
        assert g.predict(df).agg(metrics.r2("y", "prediction")).first()[0] > 0.99 and g.smooth_tests()[0]["p_value"] < 0.01
    assert smooth.GAMClassifier().fit(df, ["x"], "c").predict(df).where("prediction = c").count() >= 76
    q = smooth.PolynomialRegressor(2).fit(frame(spark, x=[0.0, 1, 2, 3], y=[1.0, 2, 5, 10]), "x", "y")
    assert q.coefficients == near([1, 0, 1]) and q.r2 == near(1)
    gp = smooth.GaussianProcessRegressor(smooth.RBF(1.0), 1e-6).fit(df, ["x"], "y")
    assert gp.predict(df).where("abs(prediction - y) > 0.01").count() == 0
    xor = frame(spark, a=[0.0, 0, 1, 1], b=[0.0, 1, 0, 1], y=[0.0, 1, 1, 0])
    m = smooth.MLPRegressor((8,), "tanh", 2000, 0.1, 4).fit(xor, ["a", "b"], "y", "row_id")
    assert m.evaluate(xor, "y")["mse"] < 0.05


def test_optimizers():
    f = lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3))
    for name, o in (("gd", {"rate": 0.1}), ("momentum", {"rate": 0.02}), ("rmsprop", {"rate": 0.05}), ("adam", {"rate": 0.1})):
        assert np.allclose(optimize.create_optimizer(name, max_iter=3000, **o).minimize(f, np.zeros(2))["x"], 3, atol=0.05)
    assert optimize.GradientDescent(line_search=True).minimize(f, np.zeros(2))["converged"]
    stop, best = optimize.EarlyStopping(3), optimize.ModelCheckpoint()
    out = optimize.train_function(f, np.full(2, 3.0), "gd", 100, (stop, best))
    assert out["epochs"] < 10 and np.allclose(best.params, 3)


def test_ordination(spark):
    x = np.random.default_rng(1).normal(size=(60, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.3]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["row_id", "a", "b", "c"])
    p = ordination.PCA(scaling=1).fit(df, ["a", "b", "c"])
    assert np.allclose(p.eigenvalues, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    s = np.array([tuple(r) for r in p.transform(df).orderBy("row_id").select("pc1", "pc2", "pc3").collect()])
    assert np.allclose(np.cov(s.T), np.diag(p.eigenvalues), atol=1e-8)
    l = ordination.LDA().fit(spark.createDataFrame([(0.0, 0.0, 0), (0.0, 1.0, 0), (5.0, 5.0, 1), (5.0, 6.0, 1), (10.0, 10.0, 2), (10.0, 11.0, 2)], ["x", "y", "c"]), ["x", "y"], "c")
    assert len(l.axes[0]) <= 2
    exact = frame(spark, y1=[1.0, 2, 3, 4], y2=[2.0, 4, 6, 8], x=[1.0, 2, 3, 4])
    r = ordination.RDA().fit(exact, ["y1", "y2"], ["x"])
    assert r.explained == near(1) and len(r.eigenvalues) == 1 and "rda1" in r.transform(exact).columns
    c = ordination.CCA().fit(df.withColumn("d", F.col("a") * 2 + F.col("b")), ["a", "b"], ["c", "d"])
    assert c.correlations[0] == near(1, 1e-6)


def test_composition(spark):
    df = frame(spark, a=[1.0, 2, 0], b=[2.0, 3, 5], c=[7.0, 5, 5])
    cols = ["a", "b", "c"]
    first = df.where("a > 0")
    closed = composition.closure(first, cols).orderBy("row_id").collect()
    for back in (composition.clr_inverse(composition.clr(first, cols), cols), composition.alr_inverse(composition.alr(first, cols), ["a", "b"], "c"), composition.ilr_inverse(composition.ilr(first, cols), ["ilr1", "ilr2"], cols)):
        assert np.allclose([tuple(r[k] for k in cols) for r in back.orderBy("row_id").collect()], [tuple(r[k] for k in cols) for r in closed])
    z = composition.multiplicative_replacement(df, cols).where("row_id = 2").first()
    assert z["a"] > 0 and z["a"] + z["b"] + z["c"] == near(1)
    b = composition.default_basis(4)
    assert np.allclose(b @ b.T, np.eye(3))
    with pytest.raises(Exception, match="negative"):
        composition.closure(frame(spark, a=[-1.0], b=[2.0]), ["a", "b"]).collect()


def test_splits_and_search(spark):
    df = frame(spark, x=[float(k) for k in range(23)], y=["p" if k % 3 else "q" for k in range(23)])
    a, b = splits.train_test_split(df, "row_id", 0.7)
    assert (a.count(), b.count()) == (16, 7) and not {r["row_id"] for r in a.collect()} & {r["row_id"] for r in b.collect()}
    assert [r["count"] for r in splits.k_fold(df, "row_id", 5).groupBy("fold").count().orderBy("fold").collect()] == [4, 4, 4, 4, 7]
    g = splits.group_k_fold(df, "y", 2)
    assert g.groupBy("y").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    up = {r["y"]: r["count"] for r in splits.upsample(df, "y", "row_id").groupBy("y").count().collect()}
    down = {r["y"]: r["count"] for r in splits.downsample(df, "y", "row_id").groupBy("y").count().collect()}
    assert set(up.values()) == {15} and set(down.values()) == {8}
    line = df.withColumn("t", F.col("x") * 2 + 1)

    def fit(d, ridge):
        return glm.fit_lm(d, "t", ["x"], ridge=ridge)

    found = grid_search_cv(fit, lambda m, d: -m.predict(d).agg(metrics.mse("t", "prediction")).first()[0], line, "row_id", {"ridge": [0.0, 10.0]}, cv=3)
    assert found["best_params"] == {"ridge": 0.0} and len(parameter_grid({"a": [1, 2], "b": [3]})) == 2
    rng = np.random.default_rng(0)
    assert 1e-3 <= sample_from(distributions.loguniform(1e-3, 1), rng) <= 1 and sample_from(distributions.choice(["z"]), rng) == "z"


def test_metrics_edges(spark):
    assert metrics.roc_auc(frame(spark, y=[1, 1], p=[0.1, 0.2]), "y", "p") == 0.5
    assert metrics.roc_auc(frame(spark, y=[0, 1, 0, 1], p=[0.5, 0.5, 0.1, 0.9]), "y", "p") == near(0.875)
    assert frame(spark, y=[0, 0], p=[0, 0]).agg(metrics.f1("y", "p")).first()[0] == 0
    assert metrics.information_gain([0, 1], [], [0, 1], len) == 0 and metrics.gini([0.5, 0.5]) == 0.5
    assert "actual" in metrics.confusion_text(frame(spark, y=["a", "b"], p=["a", "a"]), "y", "p")


def test_recipe(spark):
    df = frame(spark, a=[1.0, 2, None, 4, 5, 100], b=[2.0, 4, 6, 8, 10, 200], s=["u", "v", "u", "w", "v", "u"], y=[0, 1, 0, 1, 0, 1])
    r = recipe(df, ["a", "b", "s"], "y", "row_id").impute_median(["a"]).clip_outliers(["a"]).one_hot(["s"]).scale(["a", "b"]).split(0.67)
    p = r.prep()
    assert p.train.count() == 4 and p.test.count() == 2 and p.features[:2] == ["a", "b"] and len(p.features) >= 3
    assert r.bake(p, df).count() == 6 and "impute_median" in r.summary()
    q = recipe(df.drop("s"), ["a", "b"], "y", "row_id").impute_mean(["a"]).pca(n_components=1).prep()
    assert q.features == ["PC1"]
    o = recipe(df.drop("s").dropna(), ["a", "b"], "y", "row_id").remove_outliers(["a", "b"], contamination=0.2).prep()
    assert o.train.count() < 5


def test_branches_and_interpretation(spark):
    df = frame(spark, x=[float(k) for k in range(10)], z=[1.0] * 10)

    class Fixed:
        def __init__(self, c):
            self.c = c

        def fit(self, d):
            return self

        def predict(self, d):
            return d.withColumn("prediction", self.c)

    br = BranchPipeline({"a": Fixed(F.lit(1)), "b": Fixed(F.lit(1)), "c": Fixed(F.lit(2))}).fit(df)
    row = br.predict(df).first()
    assert row["prediction"] == 1 and row["confidence"] == near(2 / 3) and br.agreement_score(df) == near(1 / 3)
    line = df.withColumn("y", F.col("x") * 3)
    m = glm.fit_lm(line, "y", ["x"])
    imp = interpret.permutation_importance(lambda d: -m.predict(d).agg(metrics.mse("y", "prediction")).first()[0], line, ["x", "z"], "row_id", 2)
    assert imp[0]["feature"] == "x"
    pd_ = interpret.partial_dependence(m.predict, line, "x", 3, (0, 1)).collect()
    assert [r["mean_prediction"] for r in pd_] == near([0, 13.5, 27])


def test_persistence():
    text = persistence.save_model({"a": float("nan"), "b": [math.inf, -math.inf], "c": np.arange(3)})
    back = persistence.load_model(text)
    assert math.isnan(back["a"]) and back["b"] == [math.inf, -math.inf] and back["c"].tolist() == [0, 1, 2]
