"""Outliers: Mahalanobis distance, local outlier factor, isolation forest. Labels are 1 and -1 (outlier)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import total
from .kernels import covariance, pick_sorted
from .neighbours import nearest


def _label(flag: Column) -> Column:
    return F.when(flag, -1).otherwise(1)


@dataclass
class MahalanobisDistance:
    """Distances by the sample covariance; the threshold is the empirical quantile, or that of chi-square with use_chi2."""

    contamination: float = 0.1
    use_chi2: bool = False
    mean: list[float] = field(default_factory=list)
    inverse: list[list[float]] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    threshold: float = math.nan

    def distance(self) -> Column:
        d = [F.col(c).cast("double") - F.lit(m) for c, m in zip(self.columns, self.mean, strict=True)]
        return F.sqrt(F.greatest(F.lit(0.0), total([d[i] * d[j] * F.lit(float(self.inverse[i][j])) for i in range(len(d)) for j in range(len(d))])))

    def fit(self, df: DataFrame, columns: list[str]) -> MahalanobisDistance:
        self.columns = columns
        n, mu, c = covariance(df, columns)
        self.mean, self.inverse = mu.tolist(), np.linalg.pinv(c).tolist()
        if self.use_chi2:
            from ..functions.distributions import qchisq

            self.threshold = math.sqrt(qchisq(1 - self.contamination, len(columns)))
        else:
            self.threshold = pick_sorted(df.select(self.distance().alias("d")), "d", [min(n - 1, math.floor(n * (1 - self.contamination)))])[0]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("distance", self.distance()).withColumn("label", _label(F.col("distance") >= F.lit(self.threshold)))


def mahalanobis_distance(df: DataFrame, columns: list[str], **options) -> DataFrame:
    return MahalanobisDistance(**options).fit(df, columns).predict(df)


@dataclass
class LocalOutlierFactor:
    n_neighbors: int = 20
    contamination: float = 0.1
    columns: list[str] = field(default_factory=list)
    id_col: str = "row_id"
    train: DataFrame | None = None
    density: DataFrame | None = None
    threshold: float = math.nan

    def _densities(self, near: DataFrame, k_distance: DataFrame) -> DataFrame:
        reach = near.join(k_distance.select(F.col("id").alias("id_r"), "kd"), "id_r").withColumn("reach", F.greatest("kd", "distance"))
        return reach.groupBy(F.col("id_l").alias("id")).agg((1 / F.greatest(F.avg("reach"), F.lit(1e-10))).alias("lrd"))

    def _factors(self, near: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
        m = near.join(other.select(F.col("id").alias("id_r"), F.col("lrd").alias("r")), "id_r").join(own.select(F.col("id").alias("id_l"), F.col("lrd").alias("l")), "id_l")
        return m.groupBy(F.col("id_l").alias("id")).agg((F.avg("r") / F.first("l")).alias("lof"))

    def fit(self, df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
        """df with lof and label."""
        from ..session import cut

        self.columns, self.id_col, self.train = columns, id_col, df
        near = cut(nearest(df, df, columns, self.n_neighbors, id_col, id_col, skip_self=True))
        self.k_distance = near.groupBy(F.col("id_l").alias("id")).agg(F.max("distance").alias("kd"))
        self.density = cut(self._densities(near, self.k_distance))
        factors = cut(self._factors(near, self.density, self.density))
        n = factors.count()
        self.threshold = pick_sorted(factors, "lof", [min(n - 1, math.floor(n * (1 - self.contamination)))])[0]
        return self._marked(df, factors)

    def _marked(self, df: DataFrame, factors: DataFrame) -> DataFrame:
        return df.join(factors.withColumnRenamed("id", "__i"), F.col(self.id_col) == F.col("__i")).drop("__i").withColumn("label", _label(F.col("lof") >= F.lit(self.threshold)))

    def predict(self, df: DataFrame) -> DataFrame:
        """New rows against the fitted ones."""
        near = nearest(df, self.train, self.columns, self.n_neighbors, self.id_col, self.id_col)
        return self._marked(df, self._factors(near, self._densities(near, self.k_distance), self.density))


def local_outlier_factor(df: DataFrame, columns: list[str], id_col: str, **options) -> DataFrame:
    return LocalOutlierFactor(**options).fit(df, columns, id_col)


def average_path_length(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list:
    """A tree as nested lists: [size] or [feature, cut, left, right]."""
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and limit else np.zeros(0, int)
    if not len(spread):
        return [len(x)]
    f = int(rng.choice(spread))
    c = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < c
    return [f, c, _grow(x[left], limit - 1, rng), _grow(x[~left], limit - 1, rng)]


def _depths(tree: list, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += depth + average_path_length(tree[0])
        return
    left = x[rows, tree[0]] < tree[1]
    _depths(tree[2], x, rows[left], depth + 1, out)
    _depths(tree[3], x, rows[~left], depth + 1, out)


@dataclass
class IsolationForest:
    """Each tree is grown from max_samples rows of its own, drawn from all rows (a bounded sample by its nature); rows are scored in
    Arrow batches by the broadcast trees."""

    n_estimators: int = 100
    max_samples: int = 256
    contamination: float = 0.1
    seed: int = 0
    columns: list[str] = field(default_factory=list)
    trees: list = field(default_factory=list)
    size: int = 0
    threshold: float = math.nan

    def fit(self, df: DataFrame, columns: list[str], id_col: str) -> IsolationForest:
        self.columns, rng = columns, np.random.default_rng(self.seed)
        held = df.select(F.xxhash64(F.lit(self.seed), F.col(id_col)).alias("h"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns))).dropna()
        total_rows, asked = held.count(), self.max_samples * self.n_estimators
        self.size = min(self.max_samples, total_rows)
        if total_rows > 2 * asked:  # disjoint draws: a hash picks rows, and of these deals each to one tree
            held = held.where(F.pmod("h", F.lit(1 << 40)) < math.ceil(1.25 * asked / total_rows * (1 << 40)))
        pool = np.array([tuple(r) for r in held.orderBy("h", *held.columns[1:]).collect()], object)
        x = pool[:, 1:].astype(float) if len(pool) else np.zeros((0, len(columns)))
        if total_rows > 2 * asked:
            order = rng.permutation(len(x))
            draws = [order[k :: self.n_estimators][: self.size] for k in range(self.n_estimators)]
        else:
            draws = [rng.choice(len(x), self.size, replace=False) for _ in range(self.n_estimators)]
        limit = math.ceil(math.log2(max(2, self.size)))
        self.trees = [_grow(x[d], limit, rng) for d in draws]
        n = df.count()
        self.threshold = pick_sorted(self.score_samples(df).select("score"), "score", [min(n - 1, math.floor(self.contamination * n))])[0]
        return self

    def score_samples(self, df: DataFrame) -> DataFrame:
        """df with score: minus the anomaly score."""
        shared, c = df.sparkSession.sparkContext.broadcast(self.trees), average_path_length(self.size) or 1.0

        @F.pandas_udf("double")
        def score(*series: pd.Series) -> pd.Series:
            x = np.stack([s.to_numpy(float) for s in series], 1)
            total_ = np.zeros(len(x))
            for t in shared.value:
                _depths(t, x, np.arange(len(x)), 0, total_)
            return pd.Series(-np.power(2.0, -total_ / len(shared.value) / c))

        return df.withColumn("score", score(*(F.col(k).cast("double") for k in self.columns)))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.score_samples(df).withColumn("label", _label(F.col("score") < F.lit(self.threshold)))


def isolation_forest(df: DataFrame, columns: list[str], id_col: str, **options) -> DataFrame:
    return IsolationForest(**options).fit(df, columns, id_col).predict(df)
