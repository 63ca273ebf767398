"""Column expressions: missing and numeric values, guards, losses, and distances between two lists of columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON, PI, E = 1e-10, math.pi, math.e


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: str | Column, numeric: bool = True) -> Column:
    """Null, or NaN where the column is a number."""
    c = col(c)
    return c.isNull() | F.isnan(c) if numeric else c.isNull()


def is_numeric(c: str | Column) -> Column:
    """A finite number."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def approx_equal(a: str | Column, b: str | Column, tol: float = EPSILON) -> Column:
    return F.abs(col(a) - col(b)) < F.lit(tol)


def guard(c: str | Column, ok: Column, message: str) -> Column:
    """The column, raising where ok doesn't hold."""
    return F.when(ok, col(c)).otherwise(F.raise_error(F.lit(message)).cast("double"))


def guard_finite(c, name: str = "value") -> Column:
    return guard(c, is_numeric(c), f"{name} must be finite")


def guard_positive(c, name: str = "value") -> Column:
    return guard(c, is_numeric(c) & (col(c) > 0), f"{name} must be positive")


def guard_probability(c, name: str = "value") -> Column:
    return guard(c, is_numeric(c) & col(c).between(0, 1), f"{name} must lie in [0, 1]")


def clean(c: str | Column) -> Column:
    """The number, null where it is missing or not finite."""
    return F.when(is_numeric(c), col(c).cast("double"))


def total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows that have both; null where one of them is constant."""
    a = F.when(col(y).isNotNull(), col(x).cast("double"))
    b = F.when(col(x).isNotNull(), col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


Columns = list[str | Column]


def _pairs(a: Columns, b: Columns) -> list[tuple[Column, Column]]:
    if len(a) != len(b):
        raise ValueError("both sides must have as many columns")
    return [(col(x).cast("double"), col(y).cast("double")) for x, y in zip(a, b, strict=True)]


def euclidean(a: Columns, b: Columns) -> Column:
    return F.sqrt(total([(x - y) * (x - y) for x, y in _pairs(a, b)]))


def manhattan(a: Columns, b: Columns) -> Column:
    return total([F.abs(x - y) for x, y in _pairs(a, b)])


def chebyshev(a: Columns, b: Columns) -> Column:
    gaps = [F.abs(x - y) for x, y in _pairs(a, b)]
    return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]


def minkowski(a: Columns, b: Columns, p: float = 2) -> Column:
    if math.isinf(p):
        return chebyshev(a, b)
    return F.pow(total([F.pow(F.abs(x - y), F.lit(float(p))) for x, y in _pairs(a, b)]), F.lit(1.0 / p))


def cosine(a: Columns, b: Columns) -> Column:
    """1 - similarity; 1 where a norm is zero."""
    pairs = _pairs(a, b)
    na, nb = (F.sqrt(total([p[k] * p[k] for p in pairs])) for k in (0, 1))
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - F.try_divide(total([x * y for x, y in pairs]), na * nb))


def hamming(a: Columns, b: Columns) -> Column:
    """Number of unequal positions."""
    if len(a) != len(b):
        raise ValueError("both sides must have as many columns")
    return total([F.when(col(x).eqNullSafe(col(y)), 0).otherwise(1) for x, y in zip(a, b, strict=True)])


def canberra(a: Columns, b: Columns) -> Column:
    """Positions where both are zero count nothing."""
    return total([F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y))) for x, y in _pairs(a, b)])


def gower(a: Columns, b: Columns, types: list[str], ranges: list[float | None]) -> Column:
    """Mean over the positions where both sides are present: range-scaled gaps of numbers, inequality of categories; 0 where none is."""
    if not len(a) == len(b) == len(types) == len(ranges):
        raise ValueError("all lists must be as long")
    gaps, valid = [], []
    for x, y, kind, width in zip(a, b, types, ranges, strict=True):
        number = kind == "numeric"
        there = ~is_missing(x, number) & ~is_missing(y, number)
        gap = F.abs(col(x) - col(y)) / F.lit(float(width or 1.0)) if number else F.when(col(x) == col(y), 0.0).otherwise(1.0)
        gaps.append(F.when(there, gap).otherwise(0.0))
        valid.append(F.when(there, 1.0).otherwise(0.0))
    return F.coalesce(F.try_divide(total(gaps), total(valid)), F.lit(0.0))


def create_gower(df: DataFrame, columns: list[str], types: list[str]) -> Callable[[Columns, Columns], Column]:
    """gower() with the columns' ranges in df (1 for constant columns)."""
    numbers = [c for c, t in zip(columns, types, strict=True) if t == "numeric"]
    seen = df.agg(*(F.max(clean(c)) - F.min(clean(c)) for c in numbers)).first() if numbers else []
    width = dict(zip(numbers, seen, strict=True))
    return lambda a, b: gower(a, b, types, [width.get(c) or 1.0 for c in columns])


DISTANCES: dict[str, Callable[..., Column]] = {"euclidean": euclidean, "manhattan": manhattan, "minkowski": minkowski, "chebyshev": chebyshev, "cosine": cosine, "hamming": hamming, "canberra": canberra}


def distance_function(metric: str | Callable[..., Column]) -> Callable[..., Column]:
    if callable(metric):
        return metric
    if metric not in DISTANCES:
        raise ValueError(f"no metric {metric}; known: {', '.join(DISTANCES)}")
    return DISTANCES[metric]
