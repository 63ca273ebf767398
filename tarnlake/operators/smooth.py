"""Polynomial, spline, kernel and neural regression."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.expressions import total
from .glm import linear
from .kernels import gram, pick_sorted, solve


@dataclass
class PolynomialRegressor:
    degree: int = 2
    intercept: bool = True
    coefficients: list[float] = field(default_factory=list)
    r2: float = math.nan
    adjusted_r2: float = math.nan

    def _powers(self, x: str) -> list[Column]:
        return ([F.lit(1.0)] if self.intercept else []) + [F.pow(F.col(x).cast("double"), F.lit(float(k))) for k in range(1, self.degree + 1)]

    def fit(self, df: DataFrame, x: str, y: str) -> PolynomialRegressor:
        rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
        mid, scale = rows.agg(F.avg("x"), F.stddev_pop("x")).first()
        scale = scale or 1.0
        z = (F.col("x") - F.lit(mid)) / F.lit(scale) if self.intercept else F.col("x") / F.lit(scale)
        shift = mid if self.intercept else 0.0
        powers = ([F.lit(1.0)] if self.intercept else []) + [F.pow(z, F.lit(float(k))) for k in range(1, self.degree + 1)]
        n, s, c = gram(rows, [*powers, "y"])
        b = solve(c[:-1, :-1], c[:-1, -1])
        # Back from the shifted and scaled variable.
        poly = np.polynomial.Polynomial(b if self.intercept else [0, *b])(np.polynomial.Polynomial([-shift / scale, 1 / scale])).coef
        self.coefficients = (poly if self.intercept else poly[1:]).tolist()
        rss = c[-1, -1] - b @ c[:-1, -1]
        tss = c[-1, -1] - s[-1] ** 2 / n
        self.r2 = 1 - rss / tss if tss else 0.0
        self.adjusted_r2 = 1 - (1 - self.r2) * (n - 1) / max(1, n - self.degree - 1)
        self.x = x
        return self

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, linear(self.coefficients, self._powers(self.x)))


def compute_knots(df: DataFrame, x: str, n: int, placement: str = "quantile") -> list[float]:
    """Inner knots: order statistics at floor places, or evenly spaced."""
    if placement == "uniform":
        low, high = df.agg(F.min(x), F.max(x)).first()
        return [low + (high - low) * k / (n + 1) for k in range(1, n + 1)]
    count = df.where(F.col(x).isNotNull()).count()
    return pick_sorted(df, x, [min(count - 1, count * k // (n + 1)) for k in range(1, n + 1)])


def truncated_power_basis(x: Column, knots: list[float]) -> list[Column]:
    return [x, *(F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)), F.lit(3.0)) for k in knots)]


def cubic_basis(x: Column, knots: list[float]) -> list[Column]:
    return [F.lit(1.0), *truncated_power_basis(x, knots)]


def bspline_basis(x: Column, knots: list[float], degree: int = 3, low: float = 0.0, high: float = 1.0) -> list[Column]:
    """Cox-de Boor on clamped knots; the last basis includes the upper end."""
    t = [low] * (degree + 1) + list(knots) + [high] * (degree + 1)
    n = len(t) - 1
    inside = [(x >= F.lit(float(t[i]))) & ((x < F.lit(float(t[i + 1]))) | (F.lit(t[i + 1] == high) & (x == F.lit(float(high))) & F.lit(t[i] < t[i + 1]))) for i in range(n)]
    b = [F.when(c, 1.0).otherwise(0.0) if t[i] < t[i + 1] else F.lit(0.0) for i, c in enumerate(inside)]
    for d in range(1, degree + 1):
        b = [total([*([(x - F.lit(float(t[i]))) / F.lit(float(t[i + d] - t[i])) * b[i]] if t[i + d] > t[i] else []), *([(F.lit(float(t[i + d + 1])) - x) / F.lit(float(t[i + d + 1] - t[i + 1])) * b[i + 1]] if t[i + d + 1] > t[i + 1] else []), F.lit(0.0)]) for i in range(n - d)]
    return b


def penalty_matrix(n: int, order: int = 2) -> np.ndarray:
    d = np.diff(np.eye(n), order, axis=0) if n > order else np.zeros((1, n))
    return d.T @ d


def block_penalty(sizes: list[int], intercept: bool = True, order: int = 2) -> np.ndarray:
    p = sum(sizes) + intercept
    out, at = np.zeros((p, p)), int(intercept)
    for s in sizes:
        out[at : at + s, at : at + s] = penalty_matrix(s, order)
        at += s
    return out


def penalized_fit(c: np.ndarray, xy: np.ndarray, penalty: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, inverse of the penalised cross products, and effective degrees of freedom."""
    inv = np.linalg.pinv(c + lam * penalty)
    return inv @ xy, inv, float(np.trace(inv @ c))


def gcv(n: float, rss: float, edf: float) -> float:
    return n * rss / max(1e-12, (n - edf)) ** 2


def reml(n: float, rss: float, c: np.ndarray, penalty: np.ndarray, lam: float) -> float:
    """Restricted likelihood of the penalised fit, up to a constant."""
    sign, det = np.linalg.slogdet(c + lam * penalty + 1e-10 * np.eye(len(c)))
    rank = np.linalg.matrix_rank(penalty)
    return (n - (len(c) - rank)) * math.log(max(rss, 1e-300)) + det - rank * math.log(max(lam, 1e-300))


@dataclass
class GAMRegressor:
    """Additive splines (tp: truncated powers, cr: the same with knots inside, bs: B-splines), one cross-product aggregation; the
    smoothing parameter is searched on it without reading rows again."""

    n_splines: int = 4
    basis: str = "tp"
    lam: float | None = None
    method: str = "gcv"
    columns: list[str] = field(default_factory=list)
    knots: dict[str, list[float]] = field(default_factory=dict)
    ends: dict[str, tuple[float, float]] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=list)
    inverse: np.ndarray | None = None
    edf: float = math.nan
    sigma2: float = math.nan

    def _terms(self, c: str) -> list[Column]:
        low, high = self.ends[c]
        x = F.col(c).cast("double")
        if self.basis == "bs":
            return bspline_basis(F.greatest(F.lit(low), F.least(F.lit(high), x)), self.knots[c], 3, low, high)[1:]
        scale = (high - low) or 1.0
        return truncated_power_basis((x - F.lit(low)) / F.lit(scale), [(k - low) / scale for k in self.knots[c]])

    def _design(self) -> list[Column]:
        return [F.lit(1.0), *(t for c in self.columns for t in self._terms(c))]

    def prepare(self, df: DataFrame, columns: list[str]) -> list[int]:
        self.columns = columns
        for c in columns:
            self.knots[c] = compute_knots(df, c, self.n_splines)
            self.ends[c] = tuple(map(float, df.agg(F.min(c), F.max(c)).first()))
        return [len(self._terms(c)) for c in columns]

    def fit(self, df: DataFrame, columns: list[str], y: str) -> GAMRegressor:
        rows = df.select(*columns, F.col(y).cast("double").alias("__y")).dropna()
        sizes = self.prepare(rows, columns)
        n, _, c = gram(rows, [*self._design(), "__y"])
        x, xy, yy, pen = c[:-1, :-1], c[:-1, -1], c[-1, -1], block_penalty(sizes)

        def of(lam: float):
            b, inv, edf = penalized_fit(x, xy, pen, lam)
            rss = max(0.0, yy - 2 * b @ xy + b @ x @ b)
            return (gcv(n, rss, edf) if self.method == "gcv" else reml(n, rss, x, pen, lam)), b, inv, edf, rss

        grid = [self.lam] if self.lam is not None else [10 ** (-6 + 12 * k / 20) for k in range(21)]
        self.lam = min(grid, key=lambda v: of(v)[0])
        _, b, self.inverse, self.edf, rss = of(self.lam)
        self.coefficients, self.sigma2, self.sizes = b.tolist(), rss / max(1e-12, n - self.edf), sizes
        self.coefficient_edf = np.diag(self.inverse @ x)
        return self

    def predict(self, df: DataFrame, output: str = "prediction", interval: bool = False, level: float = 0.95) -> DataFrame:
        x = self._design()
        fit = linear(self.coefficients, x)
        if not interval:
            return df.withColumn(output, fit)
        cov = self.inverse * self.sigma2
        se = F.sqrt(F.greatest(F.lit(0.0), total([x[i] * x[j] * F.lit(float(cov[i, j])) for i in range(len(x)) for j in range(len(x))])))
        z = F.lit(sp.normal_quantile(1 - (1 - level) / 2))
        return df.withColumns({output: fit, f"{output}_lower": fit - z * se, f"{output}_upper": fit + z * se})

    def smooth(self, column: str, df: DataFrame) -> DataFrame:
        """df with the term of one column and its standard error."""
        at = 1 + sum(self.sizes[: self.columns.index(column)])
        t = self._terms(column)
        cov = self.inverse[at : at + len(t), at : at + len(t)] * self.sigma2
        se = F.sqrt(F.greatest(F.lit(0.0), total([t[i] * t[j] * F.lit(float(cov[i, j])) for i in range(len(t)) for j in range(len(t))])))
        return df.withColumns({"smooth": linear(self.coefficients[at : at + len(t)], t), "se": se})

    def smooth_tests(self) -> list[dict]:
        """Effective degrees of freedom and a Wald test of each smooth."""
        out, at = [], 1
        for c, s in zip(self.columns, self.sizes, strict=True):
            b, cov = np.array(self.coefficients[at : at + s]), self.inverse[at : at + s, at : at + s] * self.sigma2
            x = float(b @ np.linalg.pinv(cov) @ b)
            out.append({"term": c, "edf": float(self.coefficient_edf[at : at + s].sum()), "chi2": x, "p_value": sp.chi2_sf(x, s)})
            at += s
        return out

    def summary(self) -> str:
        return "\n".join([f"GAM: lambda {self.lam:.4g}, edf {self.edf:.4g}, sigma2 {self.sigma2:.4g}", *(f"s({t['term']}): edf {t['edf']:.3g}, chi2 {t['chi2']:.4g}, p {t['p_value']:.3g}" for t in self.smooth_tests())])


@dataclass
class GAMClassifier:
    """One penalised logistic fit for each class but the first, then a softmax."""

    n_splines: int = 4
    basis: str = "tp"
    lam: float = 0.1
    max_iter: int = 25
    classes: list = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str], y: str) -> GAMClassifier:
        rows = df.select(*columns, y).dropna().persist()
        self.shape = GAMRegressor(self.n_splines, self.basis)
        pen = block_penalty(self.shape.prepare(rows, columns))
        self.classes = [r[0] for r in rows.select(y).distinct().orderBy(y).collect()]
        x, self.coefficients = self.shape._design(), []
        for c in self.classes[1:]:
            b, t = np.zeros(len(x)), F.when(F.col(y) == F.lit(c), 1.0).otherwise(0.0)
            for _ in range(self.max_iter):
                eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear(b, x)))
                m = 1 / (1 + F.exp(-eta))
                w = F.greatest(m * (1 - m), F.lit(1e-8))
                made = rows.select(*(v.alias(f"c{i}") for i, v in enumerate(x)), (eta + (t - m) / w).alias("z"), w.alias("w"))
                _, _, g = gram(made, [*(f"c{i}" for i in range(len(x))), "z"], "w")
                new = penalized_fit(g[:-1, :-1], g[:-1, -1], pen + 1e-8 * np.eye(len(x)), self.lam)[0]
                moved, b = np.abs(new - b).max(), new
                if moved < 1e-6:
                    break
            self.coefficients.append(b.tolist())
        rows.unpersist()
        return self

    def _shares(self) -> list[Column]:
        x = self.shape._design()
        e = [F.lit(1.0), *(F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear(b, x)))) for b in self.coefficients)]
        return [v / total(e) for v in e]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"p_{c}": s for c, s in zip(self.classes, self._shares(), strict=True)})

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        from .trees import _winner

        return df.withColumn(output, _winner(self._shares(), self.classes))

    def summary(self) -> str:
        return f"GAM classifier: classes {self.classes}, {len(self.coefficients)} fits of {len(self.coefficients[0])} coefficients"


class Kernel:
    """call(a, b) gives the matrix of covariances."""

    def call(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def params(self) -> dict:
        return dict(vars(self))

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


class RBF(Kernel):
    def __init__(self, length: float = 1.0, variance: float = 1.0):
        self.length, self.variance = length, variance

    def call(self, a, b):
        return self.variance * np.exp(-(self.distances(a, b) ** 2) / (2 * self.length**2))


class Periodic(Kernel):
    def __init__(self, length: float = 1.0, period: float = 1.0, variance: float = 1.0):
        self.length, self.period, self.variance = length, period, variance

    def call(self, a, b):
        return self.variance * np.exp(-2 * np.sin(np.pi * self.distances(a, b) / self.period) ** 2 / self.length**2)


class RationalQuadratic(Kernel):
    def __init__(self, length: float = 1.0, alpha: float = 1.0, variance: float = 1.0):
        self.length, self.alpha, self.variance = length, alpha, variance

    def call(self, a, b):
        return self.variance * (1 + self.distances(a, b) ** 2 / (2 * self.alpha * self.length**2)) ** -self.alpha


@dataclass
class GaussianProcessRegressor:
    """Exact inference on at most max_rows training rows (more raise); rows are predicted in Arrow batches."""

    kernel: Kernel = field(default_factory=RBF)
    alpha: float = 1e-10
    max_rows: int = 5000

    def fit(self, df: DataFrame, columns: list[str], y: str) -> GaussianProcessRegressor:
        rows = df.select(*columns, y).dropna().limit(self.max_rows + 1).collect()
        if len(rows) > self.max_rows:
            raise ValueError(f"at most {self.max_rows} training rows")
        data = np.array([tuple(map(float, r)) for r in rows])
        self.columns, self.x, target = columns, data[:, :-1], data[:, -1]
        k = self.kernel.call(self.x, self.x) + self.alpha * np.eye(len(data))
        self.root = np.linalg.cholesky(k + 1e-12 * np.eye(len(data)))
        self.weights = np.linalg.solve(self.root.T, np.linalg.solve(self.root, target))
        return self

    def _moments(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ks = self.kernel.call(q, self.x)
        v = np.linalg.solve(self.root, ks.T)
        prior = np.array([self.kernel.call(r[None], r[None])[0, 0] for r in q])
        return ks @ self.weights, np.sqrt(np.maximum(0, prior - (v * v).sum(0)))

    def predict(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("mean double, std double")
        def each(*series: pd.Series) -> pd.DataFrame:
            m, s = shared.value._moments(np.stack([v.to_numpy(float) for v in series], 1))
            return pd.DataFrame({"mean": m, "std": s})

        return df.withColumn("__p", each(*(F.col(c).cast("double") for c in self.columns))).select(*df.columns, F.col("__p.mean").alias("prediction"), F.col("__p.std").alias("std"))

    def sample_prior(self, x: np.ndarray, n: int = 1, seed: int = 0) -> np.ndarray:
        k = self.kernel.call(x, x) + 1e-8 * np.eye(len(x))
        return np.linalg.cholesky(k) @ np.random.default_rng(seed).standard_normal((len(x), n))

    def sample(self, x: np.ndarray, n: int = 1, seed: int = 0) -> np.ndarray:
        """Independent marginals."""
        m, s = self._moments(x)
        return m[:, None] + s[:, None] * np.random.default_rng(seed).standard_normal((len(x), n))


ACTIVATIONS = {"relu": (lambda z: np.maximum(0, z), lambda a: (a > 0).astype(float)), "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30))), lambda a: a * (1 - a)), "tanh": (np.tanh, lambda a: 1 - a * a), "linear": (lambda z: z, np.ones_like)}


@dataclass
class MLPRegressor:
    """Mini-batch descent on all rows; a linear output layer. In a round each task takes a number of epochs over every Arrow batch of
    its rows, from the weights of the round's start, and the tasks' weights are averaged by their rows. One task with one
    batch is plain descent."""

    layers: tuple[int, ...] = (16,)
    activation: str = "relu"
    epochs: int = 200
    rate: float = 0.05
    batch: int = 32
    round_epochs: int = 25
    task_rows: int = 4096
    seed: int = 0
    weights: list = field(default_factory=list)

    def create(self, sizes: list[int]) -> None:
        rng = np.random.default_rng(self.seed)
        self.weights = [(rng.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(self.weights):
            f = ACTIVATIONS["linear" if k == len(self.weights) - 1 else self.activation][0]
            out.append(f(out[-1] @ w + b))
        return out

    def fit(self, df: DataFrame, columns: list[str], y: str, id_col: str) -> MLPRegressor:
        self.columns, self.losses = columns, []
        rows = df.select(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate([*columns, y]))).dropna()
        rows = rows.coalesce(max(1, rows.count() // self.task_rows)).persist()  # small tables: few tasks, each with enough rows
        self.create([len(columns), *self.layers, 1])
        shapes = [v.shape for pair in self.weights for v in pair]
        for k in range(0, self.epochs, self.round_epochs):
            epochs = min(self.round_epochs, self.epochs - k)
            got = rows.mapInPandas(self._round(epochs, k), "n long, s double, w array<double>").collect()  # one row a partition
            n = np.array([r["n"] for r in got], float)
            if not n.sum():
                raise ValueError("no row has all columns")
            self.losses.append(sum(r["s"] for r in got) / n.sum())  # at the round's start
            flat, at, parts = np.average(np.array([r["w"] for r in got]), axis=0, weights=n), 0, []
            for s in shapes:
                size = int(np.prod(s))
                parts.append(flat[at : at + size].reshape(s))
                at += size
            self.weights = list(zip(parts[::2], parts[1::2], strict=True))
        rows.unpersist()
        return self

    def _round(self, epochs: int, salt: int):
        model = self

        def run(frames):
            from pyspark import TaskContext

            weights = [(w.copy(), b.copy()) for w, b in model.weights]
            own = MLPRegressor(model.layers, model.activation, weights=weights)
            rng, n, s = np.random.default_rng([model.seed, salt, TaskContext.get().partitionId()]), 0, 0.0
            for f in frames:
                data = f.to_numpy(float)
                n, s = n + len(data), s + float(((model._forward(data[:, :-1])[-1] - data[:, -1:]) ** 2).sum())
                for _ in range(epochs):
                    own._epoch(data[:, :-1], data[:, -1:], rng, model.batch, model.rate)
            if n:
                yield pd.DataFrame({"n": [n], "s": [s], "w": [np.concatenate([v.reshape(-1) for pair in own.weights for v in pair])]})

        return run

    def _epoch(self, x: np.ndarray, t: np.ndarray, rng: np.random.Generator, batch: int, rate: float) -> None:
        slope, order = ACTIVATIONS[self.activation][1], rng.permutation(len(x))
        for k in range(0, len(x), batch):
            own = order[k : k + batch]
            a = self._forward(x[own])
            d = 2 * (a[-1] - t[own]) / len(own)
            for j in range(len(self.weights) - 1, -1, -1):
                w, b = self.weights[j]
                back = d @ w.T
                self.weights[j] = (w - rate * a[j].T @ d, b - rate * d.sum(0))
                d = back * slope(a[j]) if j else back

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def each(*series: pd.Series) -> pd.Series:
            return pd.Series(shared.value._forward(np.stack([v.to_numpy(float) for v in series], 1))[-1][:, 0])

        return df.withColumn(output, each(*(F.col(c).cast("double") for c in self.columns)))

    def evaluate(self, df: DataFrame, y: str) -> dict:
        from .metrics import mae, mse, r2, rmse

        row = self.predict(df, "__p").agg(mse(y, "__p"), rmse(y, "__p"), mae(y, "__p"), r2(y, "__p")).first()
        return dict(zip(("mse", "rmse", "mae", "r2"), row, strict=True))
