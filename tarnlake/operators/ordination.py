"""Multivariate analysis: each method needs one or two aggregations of cross products; scores are projected as expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import total
from ..sources.persistence import Saveable
from .kernels import covariance, solve
from .linalg import project


def normalize_scaling(value) -> int:
    """1 or 2; 2 unless 1 is asked for."""
    return 1 if value == 1 else 2


def eigenvalue_powers(values, power: float) -> np.ndarray:
    v = np.asarray(values, float)
    return np.where(v > 0, np.power(np.where(v > 0, v, 1.0), power), 0.0)


def scale_ordination(scores: np.ndarray, loadings: np.ndarray, eigenvalues, scaling: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit-norm scores and loadings: the first scaling stretches the rows, the second the variables."""
    root = eigenvalue_powers(eigenvalues, 0.5)
    return (scores * root, loadings) if normalize_scaling(scaling) == 1 else (scores, loadings * root)


def scale_constraint_scores(scores: np.ndarray, eigenvalues, scaling: int) -> np.ndarray:
    return scores * eigenvalue_powers(eigenvalues, 0.5) if normalize_scaling(scaling) == 2 else scores


def fix_signs(v: np.ndarray) -> np.ndarray:
    """Columns whose largest entry is positive."""
    at = np.abs(v).argmax(0)
    return v * np.where(v[at, np.arange(v.shape[1])] < 0, -1, 1)


def loading_rows(matrix, names: list[str], prefix: str = "pc") -> list[dict]:
    return [{"variable": n} | {f"{prefix}{k + 1}": float(v) for k, v in enumerate(row)} for n, row in zip(names, np.asarray(matrix), strict=True)]


def score_rows(matrix, prefix: str = "pc", extra: list[dict] | None = None) -> list[dict]:
    return [{f"{prefix}{k + 1}": float(v) for k, v in enumerate(row)} | (extra[i] if extra else {}) for i, row in enumerate(np.asarray(matrix))]


def columns_to_rows(columns) -> list[list[float]]:
    return np.asarray(columns).T.tolist()


@dataclass
class PCA(Saveable):
    """Eigenvalues are variances (n - 1). scaling 1: scores U s, loadings V; scaling 2 (default): scores U, loadings V sqrt(eigenvalue)."""

    center: bool = True
    scale: bool = False
    scaling: int = 2
    columns: list[str] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    sd: list[float] = field(default_factory=list)
    eigenvalues: list[float] = field(default_factory=list)
    vectors: list[list[float]] = field(default_factory=list)
    n: int = 0

    def fit(self, df: DataFrame, columns: list[str]) -> PCA:
        self.columns, self.scaling = columns, normalize_scaling(self.scaling)
        n, mu, c = covariance(df, columns)
        if not self.center:
            c = (c * (n - 1) + n * np.outer(mu, mu)) / (n - 1)
            mu = np.zeros(len(columns))
        sd = np.sqrt(np.diag(c) * (n - 1) / n) if self.scale and self.center else np.ones(len(columns))
        sd = np.where(sd > 0, sd, 1.0)
        c = c / np.outer(sd, sd)
        if self.scale and self.center:  # equal by definition: where columns hardly correlate, their last bits would turn the axes
            np.fill_diagonal(c, np.where(np.diag(c) > 0, n / max(n - 1, 1), 0.0))
        values, v = np.linalg.eigh(c)
        order = np.argsort(values)[::-1]
        self.n, self.mean, self.sd = n, mu.tolist(), sd.tolist()
        self.eigenvalues, self.vectors = np.maximum(0, values[order]).tolist(), fix_signs(v[:, order]).tolist()
        return self

    @property
    def loadings(self) -> np.ndarray:
        v = np.array(self.vectors)
        return v if self.scaling == 1 else v * np.sqrt(self.eigenvalues)

    def variance_explained(self) -> list[float]:
        whole = sum(self.eigenvalues) or 1.0
        return [e / whole for e in self.eigenvalues]

    def cumulative_variance(self) -> list[float]:
        return np.cumsum(self.variance_explained()).tolist()

    def transform(self, df: DataFrame, k: int | None = None, prefix: str = "pc") -> DataFrame:
        v = np.array(self.vectors)
        if self.scaling == 2:
            v = v * eigenvalue_powers(np.array(self.eigenvalues) * (self.n - 1), -0.5)
        return df.withColumns({f"{prefix}{i + 1}": c for i, c in enumerate(project(self.columns, v[:, :k], self.mean, self.sd))})

    def summary(self) -> str:
        return "\n".join(f"PC{k + 1}: {e:.6g} ({s:.1%})" for k, (e, s) in enumerate(zip(self.eigenvalues, self.variance_explained(), strict=True)))


@dataclass
class LDA(Saveable):
    """Axes of Sw^-1 Sb with unit within-class variance; classes by the nearest mean on the axes."""

    scale: bool = False
    columns: list[str] = field(default_factory=list)
    classes: list = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    axes: list[list[float]] = field(default_factory=list)
    eigenvalues: list[float] = field(default_factory=list)
    class_scores: list[list[float]] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str], y: str) -> LDA:
        self.columns = columns
        rows = df.select(*columns, y).dropna()
        n, mu, cov = covariance(rows, columns)
        got = rows.groupBy(y).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{k}") for k, c in enumerate(columns))).orderBy(y).collect()
        self.classes = [r[y] for r in got]
        size, m = np.array([r["n"] for r in got]), np.array([[r[f"m{k}"] for k in range(len(columns))] for r in got])
        sb = (m - mu).T @ ((m - mu) * size[:, None])
        sw = (cov * (n - 1) - sb) / max(1, n - len(size))
        values, u = np.linalg.eigh(sw)
        keep = values > 1e-10 * max(values.max(), 1e-300)
        white = u[:, keep] / np.sqrt(values[keep])
        b, v = np.linalg.eigh(white.T @ (sb / max(1, len(size) - 1)) @ white)
        order = np.argsort(b)[::-1][: min(len(size) - 1, int(keep.sum()))]
        axes = white @ v[:, order]
        axes = axes * np.where(axes.sum(0) < 0, -1, 1)
        self.mean, self.axes, self.eigenvalues = mu.tolist(), axes.tolist(), b[order].tolist()
        self.class_scores = ((m - mu) @ axes).tolist()
        return self

    def transform(self, df: DataFrame, k: int | None = None, prefix: str = "ld") -> DataFrame:
        return df.withColumns({f"{prefix}{i + 1}": c for i, c in enumerate(project(self.columns, np.array(self.axes)[:, :k], self.mean))})

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        s = project(self.columns, np.array(self.axes), self.mean)
        near = F.array_min(F.array(*(F.struct(total([(c - F.lit(float(m))) ** 2 for c, m in zip(s, center, strict=True)]).alias("d"), F.lit(k).alias("k")) for k, center in enumerate(self.class_scores))))
        return df.withColumn(output, F.array(*(F.lit(c) for c in self.classes))[near["k"]])


@dataclass
class RDA(Saveable):
    """Principal components of the responses fitted by the predictors (or of the residuals, with constrained=False)."""

    constrained: bool = True
    scale: bool = False
    scaling: int = 2
    y: list[str] = field(default_factory=list)
    x: list[str] = field(default_factory=list)
    mean_y: list[float] = field(default_factory=list)
    mean_x: list[float] = field(default_factory=list)
    sd_y: list[float] = field(default_factory=list)
    coefficients: list[list[float]] = field(default_factory=list)
    eigenvalues: list[float] = field(default_factory=list)
    vectors: list[list[float]] = field(default_factory=list)
    explained: float = 0.0
    total_inertia: float = 0.0

    def fit(self, df: DataFrame, responses: list[str], predictors: list[str]) -> RDA:
        self.y, self.x, q = responses, predictors, len(responses)
        n, mu, c = covariance(df.select(*responses, *predictors).dropna(), [*responses, *predictors], ddof=0)
        sd = np.sqrt(np.diag(c)[:q]) if self.scale else np.ones(q)
        sd = np.where(sd > 0, sd, 1.0)
        syy, sxy, sxx = c[:q, :q] / np.outer(sd, sd), c[q:, :q] / sd, c[q:, q:]
        b = solve(sxx, sxy)
        fitted = sxy.T @ b
        values, v = np.linalg.eigh(fitted if self.constrained else syy - fitted)
        order = np.argsort(values)[::-1]
        order = order[values[order] > 1e-12 * max(1e-300, float(np.trace(syy)))]
        self.mean_y, self.mean_x, self.sd_y = mu[:q].tolist(), mu[q:].tolist(), sd.tolist()
        self.coefficients, self.eigenvalues, self.vectors = b.tolist(), values[order].tolist(), fix_signs(v[:, order]).tolist()
        self.total_inertia = float(np.trace(syy))
        self.explained = float(np.trace(fitted)) / (self.total_inertia or 1.0)
        return self

    def transform(self, df: DataFrame, prefix: str = "rda") -> DataFrame:
        """Scores of the fitted (or residual) responses."""
        w = np.array(self.coefficients) @ np.array(self.vectors)
        fitted = project(self.x, w, self.mean_x)
        if not self.constrained:
            own = project(self.y, np.array(self.vectors), self.mean_y, self.sd_y)
            fitted = [o - f for o, f in zip(own, fitted, strict=True)]
        power = eigenvalue_powers(self.eigenvalues, -0.5) if self.scaling == 2 else np.ones(len(self.eigenvalues))
        return df.withColumns({f"{prefix}{k + 1}": c * F.lit(float(p)) for k, (c, p) in enumerate(zip(fitted, power, strict=True))})


@dataclass
class CCA(Saveable):
    """Canonical correlations of two sets of columns."""

    x: list[str] = field(default_factory=list)
    y: list[str] = field(default_factory=list)
    correlations: list[float] = field(default_factory=list)
    weights_x: list[list[float]] = field(default_factory=list)
    weights_y: list[list[float]] = field(default_factory=list)
    mean_x: list[float] = field(default_factory=list)
    mean_y: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, x: list[str], y: list[str]) -> CCA:
        self.x, self.y, p = x, y, len(x)
        n, mu, c = covariance(df.select(*x, *y).dropna(), [*x, *y])
        if n <= max(len(x), len(y)):
            raise ValueError("more rows than columns are needed")

        def root(a: np.ndarray) -> np.ndarray:
            v, u = np.linalg.eigh(a)
            return u @ np.diag(eigenvalue_powers(np.where(v > 1e-12 * v.max(), v, 0), -0.5)) @ u.T

        rx, ry = root(c[:p, :p]), root(c[p:, p:])
        u, s, vt = np.linalg.svd(rx @ c[:p, p:] @ ry)
        k = min(p, len(y))
        self.correlations = np.clip(s[:k], 0, 1).tolist()
        self.weights_x, self.weights_y = (rx @ u[:, :k]).tolist(), (ry @ vt.T[:, :k]).tolist()
        self.mean_x, self.mean_y = mu[:p].tolist(), mu[p:].tolist()
        return self

    def transform_x(self, df: DataFrame, prefix: str = "ccx") -> DataFrame:
        return df.withColumns({f"{prefix}{k + 1}": c for k, c in enumerate(project(self.x, np.array(self.weights_x), self.mean_x))})

    def transform_y(self, df: DataFrame, prefix: str = "ccy") -> DataFrame:
        return df.withColumns({f"{prefix}{k + 1}": c for k, c in enumerate(project(self.y, np.array(self.weights_y), self.mean_y))})


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlations; 0 with constant columns, 1 on the diagonal."""
    _, _, c = covariance(df, columns)
    s = np.sqrt(np.diag(c))
    out = np.divide(c, np.outer(s, s), out=np.zeros_like(c), where=np.outer(s, s) > 0)
    np.fill_diagonal(out, 1.0)
    return out
