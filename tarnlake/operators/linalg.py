"""Linear algebra on tall tables: small factors are solved on the driver, tall ones stay columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import total
from .kernels import covariance, gram, solve


def solve_least_squares(df: DataFrame, columns: list[str], target: str) -> np.ndarray:
    """Coefficients of target on columns (no intercept added), by normal equations."""
    _, _, c = gram(df, [*columns, target])
    return solve(c[:-1, :-1], c[:-1, -1])


def covariance_matrix(df: DataFrame, columns: list[str], center: bool = True) -> np.ndarray:
    if center:
        return covariance(df, columns)[2]
    n, _, c = gram(df, columns)
    return c / (n - 1)


def project(columns: list[str | Column], weights: np.ndarray, shift=None, scale=None) -> list[Column]:
    """Columns times a small matrix, as expressions: one for each column of weights."""
    x = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    if shift is not None:
        x = [c - F.lit(float(s)) for c, s in zip(x, shift, strict=True)]
    if scale is not None:
        x = [c / F.lit(float(s)) for c, s in zip(x, scale, strict=True)]
    return [total([c * F.lit(float(w)) for c, w in zip(x, weights[:, k], strict=True)]) for k in range(weights.shape[1])]


def mmul(df: DataFrame, columns: list[str], b: np.ndarray, prefix: str = "m") -> DataFrame:
    """df with the product of its columns and b as new columns."""
    return df.withColumns({f"{prefix}{k + 1}": c for k, c in enumerate(project(columns, np.asarray(b)))})


def svd(df: DataFrame, columns: list[str], prefix: str = "u") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """U as columns, singular values descending, V."""
    _, _, c = gram(df, columns)
    values, v = np.linalg.eigh(c)
    order = np.argsort(values)[::-1]
    s, v = np.sqrt(np.maximum(0, values[order])), v[:, order]
    u = v / np.where(s > 1e-12, s, np.inf)
    return mmul(df, columns, u, prefix), s, v


def eig(a) -> tuple[np.ndarray, np.ndarray]:
    """Real parts of eigenvalues and eigenvectors of a small matrix."""
    values, vectors = np.linalg.eig(np.asarray(a, float))
    return values.real, vectors.real


def transpose(a) -> np.ndarray:
    return np.asarray(a).T


def inverse(a) -> np.ndarray:
    return np.linalg.inv(np.asarray(a, float))


def pseudo_inverse(a) -> np.ndarray:
    return np.linalg.pinv(np.asarray(a, float))
