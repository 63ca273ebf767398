"""Compositional data: each function replaces columns by expressions of the row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import total


def _d(columns: list[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in columns]


def _log(c: Column) -> Column:
    """Zero gives -Infinity."""
    return F.when(c == 0, F.lit(float("-inf"))).otherwise(F.ln(c))


def closure(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parts of each row's sum; a negative part or a sum of zero raises."""
    x = _d(columns)
    whole = total(x)
    bad = F.greatest(*(F.when(c < 0, 1).otherwise(0) for c in x), F.when(whole == 0, 1).otherwise(0)) == 1
    return df.withColumns({n: F.when(bad, F.raise_error(F.lit("parts must not be negative, nor all zero")).cast("double")).otherwise(F.try_divide(c, whole)) for n, c in zip(columns, x, strict=True)})


def multiplicative_replacement(df: DataFrame, columns: list[str], delta: float = 1e-6) -> DataFrame:
    """Zeros become delta; what this adds is taken from the other parts in equal shares, and the row is closed."""
    closed = closure(df, columns)
    x = _d(columns)
    zeros = total([F.when(c == 0, 1.0).otherwise(0.0) for c in x])
    share = F.coalesce(F.try_divide(zeros * delta, F.lit(float(len(x))) - zeros), F.lit(0.0))
    return closure(closed.withColumns({n: F.when(c == 0, F.lit(delta)).otherwise(c - share) for n, c in zip(columns, x, strict=True)}), columns)


def power(df: DataFrame, columns: list[str], exponent: float) -> DataFrame:
    return closure(df.withColumns({c: F.pow(F.col(c).cast("double"), F.lit(float(exponent))) for c in columns}), columns)


def perturb(df: DataFrame, columns: list[str], by: list[float]) -> DataFrame:
    return closure(df.withColumns({c: F.col(c) * F.lit(float(b)) for c, b in zip(columns, by, strict=True)}), columns)


def center(df: DataFrame, columns: list[str]) -> DataFrame:
    """Division by a common geometric mean cancels on closing."""
    return closure(df, columns)


centralize = center


def clr(df: DataFrame, columns: list[str], handle_zeros: bool = False, delta: float = 1e-6) -> DataFrame:
    """Log ratios to the row's geometric mean."""
    data = multiplicative_replacement(df, columns, delta) if handle_zeros else df
    logs = [_log(c) for c in _d(columns)]
    mean = total(logs) / F.lit(float(len(columns)))
    return data.withColumns({n: v - mean for n, v in zip(columns, logs, strict=True)})


def clr_inverse(df: DataFrame, columns: list[str]) -> DataFrame:
    return closure(df.withColumns({c: F.exp(c) for c in columns}), columns)


def alr(df: DataFrame, columns: list[str], denominator: int = -1, handle_zeros: bool = False, delta: float = 1e-6) -> DataFrame:
    """Log ratios to one part (the last, unless named), which goes."""
    data = multiplicative_replacement(df, columns, delta) if handle_zeros else df
    base = columns[denominator]
    return data.withColumns({c: _log(F.col(c).cast("double")) - _log(F.col(base).cast("double")) for c in columns if c != base}).drop(base)


def alr_inverse(df: DataFrame, columns: list[str], output: str) -> DataFrame:
    return closure(df.withColumns({c: F.exp(c) for c in columns} | {output: F.lit(1.0)}), [*columns, output])


def sbp_basis(partition: list[list[int]]) -> np.ndarray:
    """Orthonormal rows of a sequential binary partition (1, -1 and 0 by part)."""
    out = []
    for row in np.asarray(partition, float):
        r, s = (row > 0).sum(), (row < 0).sum()
        out.append(np.where(row > 0, np.sqrt(s / (r * (r + s))), np.where(row < 0, -np.sqrt(r / (s * (r + s))), 0.0)))
    return np.array(out)


def default_basis(parts: int) -> np.ndarray:
    """Each part against the geometric mean of those before it."""
    return sbp_basis([[1] * k + [-1] + [0] * (parts - k - 1) for k in range(1, parts)])


def ilr(df: DataFrame, columns: list[str], basis: np.ndarray | None = None, prefix: str = "ilr", handle_zeros: bool = False, delta: float = 1e-6) -> DataFrame:
    """Isometric log ratios in place of the columns."""
    data = multiplicative_replacement(df, columns, delta) if handle_zeros else df
    b = default_basis(len(columns)) if basis is None else np.asarray(basis)
    logs = [_log(c) for c in _d(columns)]
    return data.withColumns({f"{prefix}{k + 1}": total([v * F.lit(float(w)) for v, w in zip(logs, row, strict=True)]) for k, row in enumerate(b)}).drop(*columns)


def ilr_inverse(df: DataFrame, columns: list[str], outputs: list[str], basis: np.ndarray | None = None) -> DataFrame:
    b = default_basis(len(outputs)) if basis is None else np.asarray(basis)
    data = df.withColumns({o: F.exp(total([F.col(c) * F.lit(float(b[k, j])) for k, c in enumerate(columns)])) for j, o in enumerate(outputs)})
    return closure(data, outputs).drop(*columns)


def aitchison_inner(a: list[str], b: list[str]) -> Column:
    """Inner product of two compositions of a row."""
    la, lb = ([_log(c) for c in _d(x)] for x in (a, b))
    ma, mb = (total(v) / F.lit(float(len(a))) for v in (la, lb))
    return total([(x - ma) * (y - mb) for x, y in zip(la, lb, strict=True)])
