"""Registered queries of the statistics operators over whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as ex
from .functions.formula import apply_formula
from .operators import cluster, composition, describe, glm, impute, kernels, metrics, neighbours, ordination, outliers, prepare, smooth, splits, tests, trees
from .operators.linalg import covariance_matrix
from .plans.recipe import recipe
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 6):
    """Rounded, without negative zeros."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), n) + F.lit(0.0)


def _row(spark: SparkSession, values: dict) -> DataFrame:
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def _round(values: dict, n: int = 6) -> dict:
    return {k: round(v, n) + 0.0 if isinstance(v, float) else v for k, v in values.items()}


# Tables and preparation


@query("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'")
def table_filter_select(spark, sf_dir):
    rows = tables.filter_rows(_t(spark, sf_dir, "lineitem"), (F.col("l_quantity") > 40) & (F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_partkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS k, CAST(o_custkey AS DOUBLE) AS c, o_totalprice FROM orders")
def table_to_matrix(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), "o_totalprice")
    return tables.to_matrix(rows, ["k", "c", "o_totalprice"], "o_orderkey")


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 0")
def table_na_omit(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    return tables.na_omit(rows, ["c_acctbal", "c_mktsegment"])


@query("""WITH f AS (SELECT c_mktsegment AS s, min(c_custkey) AS o FROM customer GROUP BY 1), e AS (SELECT s, CAST(row_number() OVER (ORDER BY o) - 1 AS DOUBLE) AS code FROM f)
SELECT c_custkey, code AS c_mktsegment FROM customer JOIN e ON c_mktsegment = s""")
def encode_label_first_seen(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer")
    return prepare.LabelEncoder().fit(rows, "c_mktsegment", "c_custkey").transform(rows, "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("""WITH e AS (SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT o_orderpriority AS s FROM orders))
SELECT o_orderkey, o_orderpriority, code AS o_orderpriority_idx FROM orders JOIN e ON o_orderpriority = s""")
def encode_label_sorted(spark, sf_dir):
    return prepare.label_encode(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS s_f, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS s_o, CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS s_p FROM orders")
def encode_one_hot(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    out = prepare.OneHotEncoder().fit(rows, ["o_orderstatus"]).transform(rows)
    return out.select("o_orderkey", *(F.col(f"o_orderstatus_{s}").alias(f"s_{s.lower()}") for s in "FOP"))


@query("""WITH f AS (SELECT event_type AS s, row_number() OVER (ORDER BY min(event_id)) AS k FROM events GROUP BY 1)
SELECT e.event_id, a.n AS dummy, CASE WHEN e.event_type = a.s THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM events e CROSS JOIN (SELECT s, 'event_type_' || s AS n FROM f WHERE k > 1) a""")
def encode_one_hot_drop_first(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "event_type")
    wide = prepare.one_hot_table(rows, ["event_type"], "event_id")
    names = [c for c in wide.columns if c != "event_id"]
    return wide.select("event_id", F.explode(F.array(*(F.struct(F.lit(n).alias("dummy"), F.col(n).alias("v")) for n in names))).alias("x")).select("event_id", "x.dummy", "x.v")


@query("""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS d2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 6) + 0.0 AS q, round((l_extendedprice - m2) / d2, 6) + 0.0 AS p FROM lineitem, s""")
def scale_standard(spark, sf_dir):
    out = prepare.StandardScaler().fit_transform(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", _r("l_quantity").alias("q"), _r("l_extendedprice").alias("p"))


@query("WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT o_orderkey, round((o_totalprice - a) / (b - a), 8) + 0.0 AS price FROM orders, s")
def scale_min_max(spark, sf_dir):
    out = prepare.MinMaxScaler().fit_transform(_t(spark, sf_dir, "orders"), ["o_totalprice"])
    return out.select("o_orderkey", _r("o_totalprice", 8).alias("price"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, round(p_size * p_size, 4)::DOUBLE AS a2, round(p_size * p_retailprice, 4) AS ab, round(p_retailprice * p_retailprice, 4) AS b2 FROM part")
def polynomial_features(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    out = prepare.polynomial_features(rows, ["a", "b"])
    return out.select("p_partkey", "a", "b", _r(F.col("`a^2`"), 4).alias("a2"), _r(F.col("`a*b`"), 4).alias("ab"), _r(F.col("`b^2`"), 4).alias("b2"))


@query("SELECT o_orderkey, TRY_CAST(regexp_extract(o_orderpriority, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE) AS level FROM orders WHERE o_orderstatus IN ('F', 'O')")
def parse_and_clean(spark, sf_dir):
    rows = prepare.clean_categorical(_t(spark, sf_dir, "orders"), {"o_orderstatus": ["F", "O"]})
    return prepare.parse_numeric(rows, ["o_orderpriority"]).select("o_orderkey", F.col("o_orderpriority").alias("level"))


# Descriptive statistics


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 8) AS m, round(var_samp(l_quantity), 6) AS v, round(stddev_pop(l_quantity), 6) AS sd,
round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(median(l_extendedprice), 4) AS med, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(CASE WHEN l_quantity <= 10 THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS ecdf FROM lineitem GROUP BY 1, 2""")
def describe_groups(spark, sf_dir):
    q, p = "l_quantity", "l_extendedprice"
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        _r(describe.sum_of(q), 2).alias("s"), _r(describe.mean(q), 8).alias("m"), _r(describe.variance(q)).alias("v"), _r(describe.stddev(q, False)).alias("sd"), _r(describe.quantile(q, 0.25)).alias("q1"), _r(describe.median(p), 4).alias("med"), describe.minimum(p).alias("low"), describe.maximum(p).alias("high"), _r(describe.percentile_of(q, 10), 8).alias("ecdf")
    )


@query("SELECT event_type, unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS p, round(unnest(quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0])), 6) + 0.0 AS q FROM events GROUP BY 1")
def summary_quantiles(spark, sf_dir):
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = _t(spark, sf_dir, "events").groupBy("event_type").agg(describe.summary_quantiles("value").alias("q"))
    return got.select("event_type", F.explode(F.arrays_zip(F.array(*(F.lit(p) for p in probs)).alias("p"), "q")).alias("x")).select("event_type", F.col("x.p").alias("p"), _r("x.q").alias("q"))


@query("SELECT round(range * 0.25, 6)::DOUBLE AS value FROM range(0, 41)")
def value_range(spark, sf_dir):
    return describe.value_range(spark, 0, 10, 0.25).select(_r("value").alias("value"))


@query("""SELECT 'quantity' AS a, 'price' AS b, round(covar_samp(l_quantity, l_extendedprice), 3) AS c FROM lineitem UNION ALL SELECT 'quantity', 'quantity', round(var_samp(l_quantity), 3) FROM lineitem
UNION ALL SELECT 'price', 'discount', round(covar_samp(l_extendedprice, l_discount), 3) + 0.0 FROM lineitem""")
def covariance_pairs(spark, sf_dir):
    c = covariance_matrix(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    rows = [("quantity", "price", float(round(c[0, 1], 3))), ("quantity", "quantity", float(round(c[0, 0], 3))), ("price", "discount", float(round(c[1, 2], 3)) + 0.0)]
    return spark.createDataFrame(rows, "a string, b string, c double")


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS r1, round(corr(l_quantity, l_discount), 8) + 0.0 AS r2, round(corr(l_discount, l_tax), 8) + 0.0 AS r3 FROM lineitem")
def correlation_matrix(spark, sf_dir):
    r = ordination.correlation_matrix(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return _row(spark, _round({"r1": float(r[0, 1]), "r2": float(r[0, 2]), "r3": float(r[2, 3])}, 8))


# Distances, neighbours and clusters


@query("""WITH p AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, a.s_acctbal AS x1, CAST(a.s_nationkey AS DOUBLE) AS x2, b.s_acctbal AS y1, CAST(b.s_nationkey AS DOUBLE) AS y2 FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey = b.s_nationkey)
SELECT i, j, round(sqrt((x1 - y1) ** 2 + (x2 - y2) ** 2), 6) AS euclidean, round(abs(x1 - y1) + abs(x2 - y2), 6) AS manhattan, round(greatest(abs(x1 - y1), abs(x2 - y2)), 6) AS chebyshev,
CAST((CASE WHEN x1 = y1 THEN 0 ELSE 1 END + CASE WHEN x2 = y2 THEN 0 ELSE 1 END) AS INTEGER) AS hamming,
round(CASE WHEN x1 = 0 AND y1 = 0 THEN 0 ELSE abs(x1 - y1) / (abs(x1) + abs(y1)) END + CASE WHEN x2 = 0 AND y2 = 0 THEN 0 ELSE abs(x2 - y2) / (abs(x2) + abs(y2)) END, 8) AS canberra,
round(1 - (x1 * y1 + x2 * y2) / (sqrt(x1 * x1 + x2 * x2) * sqrt(y1 * y1 + y2 * y2)), 8) + 0.0 AS cosine FROM p""")
def distance_metrics(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    side = lambda i, x: s.select(F.col("s_suppkey").alias(i), F.col("s_acctbal").alias(f"{x}1"), F.col("s_nationkey").cast("double").alias(f"{x}2"))
    p = side("i", "x").join(side("j", "y"), (F.col("x2") == F.col("y2")) & (F.col("i") < F.col("j")))
    a, b = ["x1", "x2"], ["y1", "y2"]
    return p.select("i", "j", _r(ex.euclidean(a, b)).alias("euclidean"), _r(ex.manhattan(a, b)).alias("manhattan"), _r(ex.chebyshev(a, b)).alias("chebyshev"), ex.hamming(a, b).alias("hamming"), _r(ex.canberra(a, b), 8).alias("canberra"), _r(ex.cosine(a, b), 8).alias("cosine"))


@query("""WITH d AS (SELECT a.s_suppkey AS id_l, b.s_suppkey AS id_r, sqrt((a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey - b.s_nationkey) ** 2) AS distance FROM supplier a, supplier b WHERE a.s_suppkey != b.s_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY id_l ORDER BY distance, id_r) AS place FROM d) SELECT id_l, id_r, round(distance, 6) AS distance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def knn_search(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    return neighbours.nearest(s, s, ["s_acctbal", "s_nationkey"], 5, "s_suppkey", "s_suppkey", skip_self=True).select("id_l", "id_r", _r("distance").alias("distance"), "place")


@query("SELECT a.c_custkey AS id_l, b.c_custkey AS id_r, round(abs(a.c_acctbal - b.c_acctbal), 6) + 0.0 AS distance FROM customer a JOIN customer b ON abs(a.c_acctbal - b.c_acctbal) <= 2.5")
def radius_search(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return kernels.near_pairs(c, c, ["c_acctbal"], 2.5, "c_custkey", "c_custkey").select("id_l", "id_r", _r("distance").alias("distance"))


@query("""WITH d AS (SELECT c.c_custkey AS id, s.s_nationkey AS y, row_number() OVER (PARTITION BY c.c_custkey ORDER BY abs(c.c_acctbal - s.s_acctbal), s.s_suppkey) AS k FROM customer c, supplier s)
SELECT id, round(avg(y), 6) AS prediction FROM d WHERE k <= 5 GROUP BY 1""")
def knn_regression(spark, sf_dir):
    train = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y"))
    ask = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return cluster.KNN(5, task="regression").fit(train, ["x"], "y", "id").predict(ask).select("id", _r("prediction").alias("prediction"))


@query("""WITH d AS (SELECT c.c_custkey AS id, s.s_nationkey % 3 AS y, row_number() OVER (PARTITION BY c.c_custkey ORDER BY abs(c.c_acctbal - s.s_acctbal), s.s_suppkey) AS k FROM customer c, supplier s),
v AS (SELECT id, y, count(*) AS n, min(k) AS first FROM d WHERE k <= 7 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS o FROM v) SELECT id, CAST(y AS INTEGER) AS prediction FROM w WHERE o = 1""")
def knn_classification(spark, sf_dir):
    train = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") % 3).alias("y"))
    ask = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return cluster.KNN(7).fit(train, ["x"], "y", "id").predict(ask)


@query("""WITH RECURSIVE v AS (SELECT l_quantity AS q FROM lineitem), t(k, a, b, c) AS (SELECT 0, 10.0::DOUBLE, 25.0::DOUBLE, 45.0::DOUBLE UNION ALL SELECT k + 1, (SELECT avg(CASE WHEN abs(q - a) <= abs(q - b) AND abs(q - a) <= abs(q - c) THEN q END) FROM v), (SELECT avg(CASE WHEN abs(q - b) < abs(q - a) AND abs(q - b) <= abs(q - c) THEN q END) FROM v), (SELECT avg(CASE WHEN abs(q - c) < abs(q - a) AND abs(q - c) < abs(q - b) THEN q END) FROM v) FROM t WHERE k < 40), f AS (SELECT * FROM t WHERE k = 40)
SELECT cluster, count(*) AS n FROM (SELECT CAST(CASE WHEN abs(q - a) <= abs(q - b) AND abs(q - a) <= abs(q - c) THEN 0 WHEN abs(q - b) <= abs(q - c) THEN 1 ELSE 2 END AS INTEGER) AS cluster FROM v, f) GROUP BY 1""")
def kmeans_fit(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    model = cluster.KMeans(3, max_iter=60, tol=1e-9).fit(rows, ["l_quantity"], "l_orderkey", [[10.0], [25.0], [45.0]])
    return model.predict(rows).groupBy("cluster").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT s_suppkey AS id, s_acctbal AS v, s_nationkey % 3 AS l FROM supplier), m AS (SELECT a.id, a.l, b.l AS o, avg(abs(a.v - b.v)) AS d FROM x a JOIN x b ON a.id != b.id GROUP BY 1, 2, 3),
s AS (SELECT id, CAST(l AS INTEGER) AS label, coalesce(max(CASE WHEN o = l THEN d END), 0.0) AS a, min(CASE WHEN o != l THEN d END) AS b FROM m GROUP BY 1, 2) SELECT id, label, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / greatest(a, b), 6) + 0.0 AS s FROM s""")
def silhouettes(spark, sf_dir):
    x = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") % 3).alias("l"))
    return cluster.silhouette_samples(x, ["s_acctbal"], "l", "s_suppkey").select("id", "label", _r("a").alias("a"), _r("b").alias("b"), _r("s").alias("s"))


@query("""WITH x AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer), n AS (SELECT a.id, a.v, count(*) AS k FROM x a JOIN x b ON abs(a.v - b.v) <= 6 GROUP BY 1, 2), c AS (SELECT id, v, CASE WHEN v - lag(v) OVER (ORDER BY v, id) <= 6 THEN 0 ELSE 1 END AS s FROM n WHERE k >= 4),
g AS (SELECT id, v, sum(s) OVER (ORDER BY v, id) AS g FROM c), m AS (SELECT g, min(id) AS r FROM g GROUP BY 1), r AS (SELECT g, row_number() OVER (ORDER BY r) AS cluster FROM m), l AS (SELECT g.id, g.v, r.cluster FROM g JOIN r USING (g))
SELECT x.id AS c_custkey, CAST(coalesce((SELECT max(cluster) FROM l WHERE l.id = x.id), (SELECT min(cluster) FROM l WHERE abs(l.v - x.v) <= 6), -1) AS INTEGER) AS cluster FROM x""")
def dbscan(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return cluster.DBSCAN(6.0, 4).fit_predict(rows, ["c_acctbal"], "c_custkey").select("c_custkey", "cluster")


# Imputation and outliers


def _gaps(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))


_GAPS = "g AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 != 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 != 0 THEN o_orderpriority END AS priority FROM orders)"


@query(f"WITH {_GAPS} SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM g)), 4) AS price FROM g")
def impute_mean(spark, sf_dir):
    return impute.simple_impute(_gaps(spark, sf_dir), ["price"]).select("o_orderkey", _r("price", 4).alias("price"))


@query(f"WITH {_GAPS} SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM g)), 4) AS price FROM g")
def impute_median(spark, sf_dir):
    return impute.simple_impute(_gaps(spark, sf_dir), ["price"], strategy="median").select("o_orderkey", _r("price", 4).alias("price"))


@query(f"WITH {_GAPS}, m AS (SELECT priority, count(*) AS n FROM g WHERE priority IS NOT NULL GROUP BY 1 ORDER BY n DESC, priority LIMIT 1) SELECT o_orderkey, coalesce(priority, (SELECT priority FROM m)) AS priority FROM g")
def impute_mode(spark, sf_dir):
    return impute.simple_impute(_gaps(spark, sf_dir), ["priority"], strategy="most_frequent").select("o_orderkey", "priority")


@query(f"WITH {_GAPS}, m AS (SELECT o_orderstatus, avg(price) AS a FROM g GROUP BY 1) SELECT o_orderkey, round(coalesce(price, a), 4) AS price FROM g JOIN m USING (o_orderstatus)")
def impute_by_group(spark, sf_dir):
    return impute.SimpleImputer().fit_transform(_gaps(spark, sf_dir), ["price"], "o_orderstatus").select("o_orderkey", _r("price", 4).alias("price"))


@query("""WITH x AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 != 0 THEN s_acctbal END AS a, CAST(s_nationkey AS DOUBLE) AS b, CAST(s_suppkey % 13 AS DOUBLE) AS c FROM supplier),
d AS (SELECT q.id, t.a, sqrt((q.b - t.b) ** 2 + (q.c - t.c) ** 2) AS d, t.id AS o FROM x q JOIN x t ON q.id != t.id WHERE q.a IS NULL), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS k FROM d WHERE d >= 1e-10),
f AS (SELECT id, avg(a) AS a FROM n WHERE k <= 5 GROUP BY 1) SELECT x.id, round(coalesce(x.a, f.a, (SELECT avg(a) FROM x)), 6) AS a FROM x LEFT JOIN f USING (id)""")
def impute_knn(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    x = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("a"), F.col("s_nationkey").cast("double").alias("b"), (F.col("s_suppkey") % 13).cast("double").alias("c"))
    return impute.knn_impute(x, ["a", "b", "c"], "id").select("id", _r("a").alias("a"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, CASE WHEN l_orderkey % 6 != 0 THEN l_extendedprice END AS p FROM lineitem), m AS (SELECT regr_slope(p, q) AS b, regr_intercept(p, q) AS a FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(p, a + b * q), 3) AS p FROM x, m""")
def impute_iterative(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), F.when(F.col("l_orderkey") % 6 != 0, F.col("l_extendedprice")).alias("p"))
    return impute.iterative_impute(x, ["q", "p"]).select("l_orderkey", "l_linenumber", "l_partkey", _r("p", 3).alias("p"))


@query("""WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS a, var_samp(l_extendedprice) AS b, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt((b * (l_quantity - mx) ** 2 - 2 * c * (l_quantity - mx) * (l_extendedprice - my) + a * (l_extendedprice - my) ** 2) / (a * b - c * c)), 5) AS distance FROM lineitem, m""")
def outliers_mahalanobis(spark, sf_dir):
    out = outliers.mahalanobis_distance(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", _r("distance", 5).alias("distance"))


@query("""WITH x AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier), d AS (SELECT a.id AS i, b.id AS j, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.v - b.v), b.id) AS k FROM x a JOIN x b ON a.id != b.id), n AS (SELECT * FROM d WHERE k <= 10), kd AS (SELECT i, max(d) AS kd FROM n GROUP BY 1),
l AS (SELECT n.i, 1 / greatest(avg(greatest(kd.kd, n.d)), 1e-10) AS lrd FROM n JOIN kd ON kd.i = n.j GROUP BY 1) SELECT n.i AS s_suppkey, round(avg(o.lrd) / max(s.lrd), 6) AS lof FROM n JOIN l o ON o.i = n.j JOIN l s ON s.i = n.i GROUP BY 1""")
def outliers_lof(spark, sf_dir):
    out = outliers.local_outlier_factor(_t(spark, sf_dir, "supplier"), ["s_acctbal"], "s_suppkey", n_neighbors=10)
    return out.select("s_suppkey", _r("lof").alias("lof"))


@query()
def outliers_isolation_forest(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return outliers.isolation_forest(rows, ["c_acctbal", "c_nationkey"], "c_custkey").select("c_custkey", "score", "label")


# Splits


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM r")
def split_train_test(spark, sf_dir):
    a, b = splits.train_test_split(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.8, seed=7)
    return a.withColumn("part", F.lit("train")).union(b.withColumn("part", F.lit("test")))


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () // 7 AS s FROM customer) SELECT c_custkey, CAST(least(k // s, 6) AS INTEGER) AS fold FROM r")
def split_k_fold(spark, sf_dir):
    return splits.k_fold(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7)


@query("WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3:' || c_custkey), c_custkey) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY c_mktsegment) // 5) AS s FROM customer) SELECT c_custkey, c_mktsegment, CAST(least(k // s, 4) AS INTEGER) AS fold FROM r")
def split_stratified(spark, sf_dir):
    return splits.stratified_k_fold(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 5, 3).select("c_custkey", "c_mktsegment", "fold")


@query("WITH g AS (SELECT c_nationkey, CAST((row_number() OVER (ORDER BY md5('1:' || c_nationkey), c_nationkey) - 1) % 4 AS INTEGER) AS fold FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey, fold FROM customer JOIN g USING (c_nationkey)")
def split_groups(spark, sf_dir):
    return splits.group_k_fold(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 4, 1).select("c_custkey", "fold")


@query("WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, (SELECT min(n) FROM n) AS down, (SELECT max(n) FROM n) AS up FROM n")
def resample_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    down = splits.downsample(rows, "c_mktsegment", "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("down"))
    return down.join(splits.upsample(rows, "c_mktsegment", "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("up")), "c_mktsegment")


# Metrics


def _scored(spark, sf_dir):
    e = _t(spark, sf_dir, "lineitem")
    return e.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), (F.col("l_quantity") / 51).alias("p"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("c"))


_SCORED = "s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity / 51 AS p, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS c FROM lineitem)"


@query(f"""WITH {_SCORED}, t AS (SELECT sum(CASE WHEN y = 1 AND c = 1 THEN 1.0 ELSE 0 END) AS tp, sum(c) AS pp, sum(y) AS ap FROM s)
SELECT round(avg((y - p) ** 2), 8) AS mse, round(sqrt(avg((y - p) ** 2)), 8) AS rmse, round(avg(abs(y - p)), 8) AS mae, round(1 - avg((y - p) ** 2) / var_pop(y), 8) AS r2, round(avg(CASE WHEN y = c THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS accuracy, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 8) AS log_loss,
round((SELECT tp / pp FROM t)::DOUBLE, 8) AS precision, round((SELECT tp / ap FROM t)::DOUBLE, 8) AS recall, round((SELECT 2 * tp / (pp + ap) FROM t)::DOUBLE, 8) AS f1 FROM s""")
def metrics_basic(spark, sf_dir):
    m = metrics
    return _scored(spark, sf_dir).agg(_r(m.mse("y", "p"), 8).alias("mse"), _r(m.rmse("y", "p"), 8).alias("rmse"), _r(m.mae("y", "p"), 8).alias("mae"), _r(m.r2("y", "p"), 8).alias("r2"), _r(m.accuracy("y", "c"), 8).alias("accuracy"), _r(m.log_loss("y", "p"), 8).alias("log_loss"), _r(m.precision("y", "c"), 8).alias("precision"), _r(m.recall("y", "c"), 8).alias("recall"), _r(m.f1("y", "c"), 8).alias("f1"))


@query(f"WITH {_SCORED} SELECT y AS actual, c AS predicted, count(*) AS n FROM s GROUP BY 1, 2")
def metrics_confusion(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), "y", "c")


@query(f"""WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM s), n AS (SELECT sum(y) AS a, count(*) - sum(y) AS b FROM s), po AS (SELECT avg(CASE WHEN y = c THEN 1.0 ELSE 0.0 END) AS po, avg(y) * avg(c) + (1 - avg(y)) * (1 - avg(c)) AS pe FROM s),
cells AS (SELECT y, c, count(*)::DOUBLE AS n FROM s GROUP BY 1, 2), ij AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) AS t FROM cells), a AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM cells GROUP BY y)), b AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM cells GROUP BY c))
SELECT round((SELECT (sum(CASE WHEN y = 1 THEN k ELSE 0 END) - max(n.a) * (max(n.a) + 1) / 2.0) / (max(n.a) * max(n.b)) FROM r, n)::DOUBLE, 8) AS auc, round((SELECT (po - pe) / (1 - pe) FROM po)::DOUBLE, 8) + 0.0 AS kappa,
round((SELECT (ij.v - a.v * b.v / (t * (t - 1) / 2)) / ((a.v + b.v) / 2 - a.v * b.v / (t * (t - 1) / 2)) FROM ij, a, b), 8) + 0.0 AS ari""")
def metrics_ranked(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return _row(spark, _round({"auc": metrics.roc_auc(rows, "y", "p"), "kappa": metrics.cohen_kappa(rows, "y", "c"), "ari": metrics.adjusted_rand_index(rows, "y", "c")}, 8))


@query(f"""WITH {_SCORED}, g AS (SELECT p, sum(y) AS a, count(*) AS n FROM s GROUP BY 1), c AS (SELECT p, sum(a) OVER w AS tp, sum(n) OVER w AS u FROM g WINDOW w AS (ORDER BY p DESC)), t AS (SELECT sum(y) AS a, count(*) - sum(y) AS b FROM s)
SELECT round(p, 8) AS threshold, round((u - tp)::DOUBLE / b, 8) AS fpr, round(tp::DOUBLE / a, 8) AS tpr FROM c, t""")
def roc_points(spark, sf_dir):
    out = metrics.roc_points(_scored(spark, sf_dir), "y", "p")
    return out.select(_r("threshold", 8).alias("threshold"), _r("fpr", 8).alias("fpr"), _r("tpr", 8).alias("tpr"))


@query(f"""WITH {_SCORED}, g AS (SELECT p, sum(y) AS a, count(*) AS n FROM s GROUP BY 1), c AS (SELECT p, sum(a) OVER w AS tp, sum(n) OVER w AS u FROM g WINDOW w AS (ORDER BY p DESC)), t AS (SELECT sum(y) AS a FROM s)
SELECT round(p, 8) AS threshold, round(tp::DOUBLE / u, 8) AS precision, round(tp::DOUBLE / a, 8) AS recall FROM c, t""")
def precision_recall_points(spark, sf_dir):
    out = metrics.precision_recall_points(_scored(spark, sf_dir), "y", "p")
    return out.select(_r("threshold", 8).alias("threshold"), _r("precision", 8).alias("precision"), _r("recall", 8).alias("recall"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_totalprice / 600000 AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY o_totalprice / 600000, o_orderkey) AS k, count(*) OVER () AS n FROM orders)
SELECT CAST(ceil(k / ceil(n / 10.0)) AS INTEGER) AS bin, round(avg(p), 8) AS mean_predicted, round(avg(y)::DOUBLE, 8) AS fraction_positive, count(*) AS n FROM s GROUP BY 1""")
def calibration_bins(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 600000).alias("p"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    return metrics.calibration(rows, "y", "p", "id").select("bin", _r("mean_predicted", 8).alias("mean_predicted"), _r("fraction_positive", 8).alias("fraction_positive"), "n")


@query("""WITH s AS (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_returnflag) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, round(1 - sum(s * s), 8) AS gini, round(-sum(s * log2(s)), 8) AS entropy, round(1 - max(s), 8) AS error FROM s GROUP BY 1""")
def impurity_groups(spark, sf_dir):
    out = metrics.group_impurity(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select("l_returnflag", *(_r(c, 8).alias(c) for c in ("gini", "entropy", "error")))


@query(f"WITH {_SCORED} SELECT round(avg(greatest(0, 1 - (2 * y - 1) * p)), 8)::DOUBLE AS hinge, round(avg(CASE WHEN abs(p - y) <= 0.5 THEN (p - y) ** 2 / 2 ELSE 0.5 * (abs(p - y) - 0.25) END), 8) AS huber FROM s")
def losses(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return rows.agg(_r(metrics.hinge_loss(2 * F.col("y") - 1, "p")[0], 8).alias("hinge"), _r(metrics.huber_loss("y", "p", 0.5)[0], 8).alias("huber"))


# Tests


@query("SELECT round((avg(value) - 50) / sqrt(var_samp(value) / count(*)), 6) + 0.0 AS statistic, count(*) - 1 AS df FROM events")
def t_test_one_sample(spark, sf_dir):
    r = tests.one_sample_t_test(_t(spark, sf_dir, "events"), "value", 50.0)
    return _row(spark, _round({"statistic": r["statistic"], "df": r["df"]}))


@query("""WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g WHERE g = 'F'), b AS (SELECT * FROM g WHERE g = 'O')
SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) + 0.0 AS statistic, a.n + b.n - 2 AS df FROM a, b""")
def t_test_two_sample(spark, sf_dir):
    r = tests.two_sample_t_test(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus")
    return _row(spark, _round({"statistic": r["statistic"], "df": r["df"]}))


@query("SELECT round(avg(l_discount - l_tax) / sqrt(var_samp(l_discount - l_tax) / count(*)), 6) AS statistic, count(*) - 1 AS df FROM lineitem")
def t_test_paired(spark, sf_dir):
    r = tests.paired_t_test(_t(spark, sf_dir, "lineitem"), "l_discount", "l_tax")
    return _row(spark, _round({"statistic": r["statistic"], "df": r["df"]}))


_ANOVA = """g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS gm, count(*) AS k, sum(n) AS n FROM g), s AS (SELECT sum(g.n * (m - gm) ** 2) AS b, sum((g.n - 1) * v) AS w, max(k) AS k, max(t.n) AS n FROM g, t)"""


@query(f"WITH {_ANOVA} SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS statistic, CAST(k - 1 AS BIGINT) AS df1, CAST(n - k AS BIGINT) AS df2, round(b / (b + w), 8) AS eta2, round((b - (k - 1) * w / (n - k)) / (b + w + w / (n - k)), 8) + 0.0 AS omega2 FROM s")
def anova_one_way(spark, sf_dir):
    r = tests.one_way_anova(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return _row(spark, {"statistic": round(r["statistic"], 6), "df1": r["df_between"], "df2": r["df_within"], "eta2": round(tests.eta_squared(r), 8), "omega2": round(tests.omega_squared(r), 8) + 0.0})


@query(f"WITH {_ANOVA}, w AS (SELECT w / (n - k) AS ms FROM s) SELECT a.g AS group1, b.g AS group2, round(b.m - a.m, 4) AS diff, round(abs(b.m - a.m) / sqrt(ms / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS q_statistic FROM g a JOIN g b ON a.g < b.g, w")
def tukey_hsd(spark, sf_dir):
    r = tests.tukey_hsd(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return spark.createDataFrame([(c["group1"], c["group2"], round(c["diff"], 4), round(c["q_statistic"], 6)) for c in r["comparisons"]], "group1 string, group2 string, diff double, q_statistic double")


@query("""WITH c AS (SELECT event_type, count(*) AS o FROM events GROUP BY 1) SELECT round(sum((o - e) ** 2 / e)::DOUBLE, 6) AS statistic, count(*) - 1 AS df FROM (SELECT o, sum(o) OVER () / count(*) OVER () AS e FROM c)""")
def chi_square_goodness(spark, sf_dir):
    from pyspark.sql import Window

    c = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("o")).withColumn("e", F.avg("o").over(Window.partitionBy(F.lit(1))))
    r = tests.chi_square_test(c, "o", "e")
    return _row(spark, _round({"statistic": float(r["statistic"]), "df": r["df"]}))


_RANKS = "r AS (SELECT {g} AS g, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS k FROM {t}), s AS (SELECT g, count(*)::DOUBLE AS n, sum(k)::DOUBLE AS r FROM r GROUP BY 1)"


@query(f"WITH {_RANKS.format(g='l_linestatus', v='l_extendedprice', t='lineitem')}, u AS (SELECT a.r - a.n * (a.n + 1) / 2 AS u1, a.n * b.n AS nn, a.n + b.n AS n FROM s a JOIN s b ON a.g < b.g) SELECT round(least(u1, nn - u1), 2) AS statistic, round((u1 - nn / 2) / sqrt(nn * (n + 1) / 12), 6) + 0.0 AS z FROM u")
def mann_whitney(spark, sf_dir):
    r = tests.mann_whitney_u(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus")
    return _row(spark, {"statistic": round(float(r["statistic"]), 2), "z": round(r["z"], 6) + 0.0})


@query(f"WITH {_RANKS.format(g='event_type', v='value', t='events')}, n AS (SELECT sum(n) AS n FROM s) SELECT round(12 / (max(n.n) * (max(n.n) + 1)) * sum(s.r ** 2 / s.n) - 3 * (max(n.n) + 1), 5) AS statistic, count(*) - 1 AS df FROM s, n")
def kruskal_wallis(spark, sf_dir):
    r = tests.kruskal_wallis(_t(spark, sf_dir, "events"), "value", "event_type")
    return _row(spark, {"statistic": round(float(r["statistic"]), 5), "df": r["df"]})


@query("""WITH m AS (SELECT c_mktsegment AS g, median(c_acctbal) AS c FROM customer GROUP BY 1), x AS (SELECT c_mktsegment AS g, abs(c_acctbal - c) AS v FROM customer JOIN m ON c_mktsegment = g), g AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS v FROM x GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS gm, count(*) AS k, sum(n) AS n FROM g)
SELECT round((sum(g.n * (m - gm) ** 2) / (max(k) - 1)) / (sum((g.n - 1) * v) / (max(t.n) - max(k))), 6) AS statistic FROM g, t""")
def levene(spark, sf_dir):
    return _row(spark, {"statistic": round(tests.levene_test(_t(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment")["statistic"], 6)})


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) - 2 AS df FROM lineitem")
def pearson(spark, sf_dir):
    r = tests.pearson_correlation(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return _row(spark, _round({"r": r["r"], "df": r["df"]}, 8))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a::DOUBLE, b::DOUBLE), 8) AS r FROM r")
def spearman(spark, sf_dir):
    return _row(spark, {"r": round(tests.spearman_correlation(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")["r"], 8)})


@query("""WITH p AS (SELECT event_id, value / 1000 + 0.00001 AS p FROM events), r AS (SELECT event_id, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p)
SELECT event_id, round(least(p * m, 1.0), 8)::DOUBLE AS bonferroni, round(max(least(p * (m - k + 1), 1.0)) OVER (ORDER BY k), 8)::DOUBLE AS holm, round(min(least(p * m / k, 1.0)) OVER (ORDER BY k DESC), 8)::DOUBLE AS fdr FROM r""")
def p_adjustments(spark, sf_dir):
    p = _t(spark, sf_dir, "events").select("event_id", (F.col("value") / 1000 + 0.00001).alias("p"))
    one = lambda f, n: f(p).select("event_id", _r("adjusted", 8).alias(n))
    return one(tests.bonferroni, "bonferroni").join(one(tests.holm_bonferroni, "holm"), "event_id").join(one(tests.fdr, "fdr"), "event_id")


# Models


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, count(*) AS n FROM lineitem")
def linear_model(spark, sf_dir):
    m = glm.fit_lm(_t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return _row(spark, {"intercept": round(m.coefficients[0], 4), "slope": round(m.coefficients[1], 6), "r2": round(m.pseudo_r2, 8), "n": m.n})


@query("""WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS o FROM lineitem), p AS (SELECT avg(CASE WHEN o = 0 THEN y END) AS a, avg(CASE WHEN o = 1 THEN y END) AS b FROM x)
SELECT round(ln(a / (1 - a)), 5) + 0.0 AS intercept, round(ln(b / (1 - b)) - ln(a / (1 - a)), 5) + 0.0 AS slope FROM p""")
def logistic_model(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("o"))
    m = glm.fit_logit(rows, "y", ["o"])
    return _row(spark, _round({"intercept": m.coefficients[0], "slope": m.coefficients[1]}, 5))


@query("WITH x AS (SELECT CAST(p_size AS DOUBLE) AS y, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS h FROM part), m AS (SELECT avg(CASE WHEN h = 0 THEN y END) AS a, avg(CASE WHEN h = 1 THEN y END) AS b FROM x) SELECT round(ln(a), 5) AS intercept, round(ln(b) - ln(a), 5) + 0.0 AS slope FROM m")
def poisson_model(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("y"), F.when(F.col("p_partkey") % 3 == 0, 1.0).otherwise(0.0).alias("h"))
    m = glm.fit_glm(rows, "y", ["h"], "poisson")
    return _row(spark, _round({"intercept": m.coefficients[0], "slope": m.coefficients[1]}, 5))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS y, 1.0::DOUBLE AS x0, round(ln(l_quantity), 8) AS x1, round(l_discount * l_tax, 8) AS x2, round(l_quantity ** 2, 6) AS x3 FROM lineitem")
def formula_design(spark, sf_dir):
    out, _, _ = apply_formula(_t(spark, sf_dir, "lineitem"), "l_extendedprice ~ log(l_quantity) + l_discount:l_tax + I(l_quantity^2)", ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "y", "x0", _r("x1", 8).alias("x1"), _r("x2", 8).alias("x2"), _r("x3").alias("x3"))


@query("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(a + b * l_quantity, 3) AS fitted, round(l_extendedprice - a - b * l_quantity, 3) + 0.0 AS residual FROM lineitem, m""")
def model_residuals(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    out = glm.fit_formula(rows, "l_extendedprice ~ l_quantity").residuals(rows, "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", _r("fitted", 3).alias("fitted"), _r("residual", 3).alias("residual"))


@query()
def mixed_model(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("y"), (F.col("c_custkey") % 10).cast("double").alias("x"), "c_nationkey")
    m = glm.fit_glmm(rows, "y", ["x"], "c_nationkey", max_iter=3)
    return m.effects.select("c_nationkey", _r("effect", 3).alias("effect"))


@query()
def multinomial_model(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 1e5).alias("x"))
    return glm.fit_multinomial(rows, "o_orderstatus", ["x"]).predict(rows).select("o_orderkey", "prediction")


@query("SELECT round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 4) AS intercept FROM (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)")
def polynomial_regression(spark, sf_dir):
    m = smooth.PolynomialRegressor(1).fit(_t(spark, sf_dir, "part"), "p_size", "p_retailprice")
    return _row(spark, {"slope": round(m.coefficients[1], 6) + 0.0, "intercept": round(m.coefficients[0], 4)})


@query()
def gam_fit(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return smooth.GAMRegressor().fit(rows, ["l_quantity"], "l_extendedprice").predict(rows).select("l_orderkey", _r("prediction", 2).alias("prediction"))


@query("""WITH x AS (SELECT l_quantity AS v, l_extendedprice AS y FROM lineitem), t AS (SELECT DISTINCT v FROM x), c AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS t FROM t), g AS (SELECT c.t, count(*) FILTER (v <= t) AS nl, sum(y) FILTER (v <= t) AS sl, count(*) FILTER (v > t) AS nr, sum(y) FILTER (v > t) AS sr FROM x, c WHERE c.t IS NOT NULL GROUP BY 1), b AS (SELECT t FROM g ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1)
SELECT CASE WHEN v <= t THEN 'left' ELSE 'right' END AS side, count(*) AS n, round(avg(y), 4) AS mean FROM x, b GROUP BY 1""")
def regression_stump(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    m = trees.DecisionTree("regression", max_depth=1).fit(rows, ["l_quantity"], "l_extendedprice")
    side = F.when(m.leaf() == 2, "left").otherwise("right")
    return m.predict(rows).groupBy(side.alias("side")).agg(F.count("*").alias("n"), _r(F.max("prediction"), 4).alias("mean"))


@query()
def random_forest(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_custkey") % 17).alias("c"))
    m = trees.RandomForest(n_estimators=10, max_depth=4).fit(rows, ["o_totalprice", "c"], "o_orderstatus", "o_orderkey")
    return m.predict(rows).select("o_orderkey", "prediction")


# Multivariate analysis


@query("""WITH m AS (SELECT avg(l_discount) AS mx, avg(l_tax) AS my, var_samp(l_discount) AS a, var_samp(l_tax) AS b, covar_samp(l_discount, l_tax) AS c FROM lineitem) SELECT round((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c), 9) AS e1, round((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c), 9) AS e2 FROM m""")
def pca_eigenvalues(spark, sf_dir):
    m = ordination.PCA().fit(_t(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"])
    return _row(spark, _round({"e1": m.eigenvalues[0], "e2": m.eigenvalues[1]}, 9))


@query()
def pca_scores(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = ordination.PCA(scale=True, scaling=1).fit(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).transform(rows, 2)
    return out.select("l_orderkey", "l_linenumber", _r("pc1", 4).alias("pc1"), _r("pc2", 4).alias("pc2"))


@query()
def lda_predictions(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(64)))
    return ordination.LDA().fit(rows, [f"e{k}" for k in range(64)], "label").predict(rows).select("vec_id", "prediction")


@query("SELECT round(abs(corr(l_quantity, l_extendedprice)), 8) AS correlation FROM lineitem")
def canonical_correlation(spark, sf_dir):
    return _row(spark, {"correlation": round(ordination.CCA().fit(_t(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_extendedprice"]).correlations[0], 8)})


@query("SELECT round(regr_r2(l_extendedprice, l_quantity), 8) AS explained FROM lineitem")
def redundancy_analysis(spark, sf_dir):
    return _row(spark, {"explained": round(ordination.RDA().fit(_t(spark, sf_dir, "lineitem"), ["l_extendedprice"], ["l_quantity"]).explained, 8)})


_PARTS = ["q", "d", "t"]


def _composition(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), (F.col("l_discount") + 0.5).alias("d"), (F.col("l_tax") + 1).alias("t"))


_COMP = "x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_discount + 0.5 AS d, l_tax + 1 AS t FROM lineitem)"


@query(f"WITH {_COMP} SELECT l_orderkey, l_linenumber, l_partkey, q / (q + d + t) AS q, d / (q + d + t) AS d, t / (q + d + t) AS t FROM x")
def composition_closure(spark, sf_dir):
    return composition.closure(_composition(spark, sf_dir), _PARTS)


@query(f"WITH {_COMP} SELECT l_orderkey, l_linenumber, l_partkey, round(ln(q) - (ln(q) + ln(d) + ln(t)) / 3, 8) + 0.0 AS q, round(ln(d) - (ln(q) + ln(d) + ln(t)) / 3, 8) + 0.0 AS d, round(ln(t) - (ln(q) + ln(d) + ln(t)) / 3, 8) + 0.0 AS t FROM x")
def composition_clr(spark, sf_dir):
    return composition.clr(_composition(spark, sf_dir), _PARTS).select("l_orderkey", "l_linenumber", "l_partkey", *(_r(c, 8).alias(c) for c in _PARTS))


@query(f"WITH {_COMP} SELECT l_orderkey, l_linenumber, l_partkey, round((ln(q) - ln(d)) * sqrt(0.5), 8) + 0.0 AS ilr1, round((ln(q) + ln(d)) * sqrt(1.0 / 6) - ln(t) * sqrt(2.0 / 3), 8) + 0.0 AS ilr2 FROM x")
def composition_ilr(spark, sf_dir):
    return composition.ilr(_composition(spark, sf_dir), _PARTS).select("l_orderkey", "l_linenumber", "l_partkey", _r("ilr1", 8).alias("ilr1"), _r("ilr2", 8).alias("ilr2"))


# Recipes


@query("""WITH x AS (SELECT o_orderkey, o_orderstatus, o_custkey, CASE WHEN o_orderkey % 7 != 0 THEN o_totalprice END AS price FROM orders), f AS (SELECT *, coalesce(price, (SELECT median(price) FROM x)) AS p FROM x),
o AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k, count(*) OVER () AS n FROM f), q AS (SELECT max(CASE WHEN k = floor(n * 0.25) THEN p END) AS a, max(CASE WHEN k = floor(n * 0.75) THEN p END) AS b FROM o), c AS (SELECT o_orderkey, o_orderstatus, least(b + 1.5 * (b - a), greatest(a - 1.5 * (b - a), p)) AS p FROM f, q), s AS (SELECT avg(p) AS m, stddev_pop(p) AS d FROM c)
SELECT o_orderkey, round((p - m) / d, 6) + 0.0 AS price, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_o, CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_p FROM c, s""")
def recipe_steps(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"))
    out = recipe(rows, ["price", "o_orderstatus"], None, "o_orderkey").impute_median(["price"]).clip_outliers(["price"]).scale(["price"]).one_hot(["o_orderstatus"], drop_first=False).prep().train
    return out.select("o_orderkey", _r("price").alias("price"), F.col("o_orderstatus_O").alias("is_o"), F.col("o_orderstatus_P").alias("is_p"))


@query("""WITH r AS (SELECT min(p_size) AS a, max(p_size) AS b FROM part) SELECT p_partkey, CAST(least(4, greatest(0, floor((p_size - a) / ((b - a) / 5.0)))) + 1 AS INTEGER) AS p_size_bin, round(p_size * p_retailprice, 4) AS product, round(CAST(p_size AS DOUBLE) ** 2, 4) AS square FROM part, r""")
def recipe_features(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    out = recipe(rows, ["p_size", "p_retailprice"], None, "p_partkey").bin_continuous("p_size").create_interactions(["p_size", "p_retailprice"]).create_polynomial(["p_size"]).prep().train
    return out.select("p_partkey", "p_size_bin", _r("p_size_x_p_retailprice", 4).alias("product"), _r(F.col("`p_size^2`"), 4).alias("square"))


FLAGSHIP = "describe_groups"
