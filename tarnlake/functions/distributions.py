"""Distributions: pdf, cdf and quantile of numbers, and of columns (closed forms as expressions, the rest in Arrow batches)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special as sp


class Distribution:
    """Common part; subclasses give pdf, cdf and quantile of numbers."""

    def pdf(self, x: float) -> float:
        raise NotImplementedError

    def cdf(self, x: float) -> float:
        raise NotImplementedError

    def quantile(self, p: float) -> float:
        raise NotImplementedError

    def column(self, kind: str, x: Column) -> Column:
        """kind (pdf, cdf or quantile) of a column."""
        f = getattr(self, kind)

        @F.pandas_udf("double")
        def each(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if pd.isna(v) else f(float(v))).astype("float64")

        return each(x.cast("double"))


class Normal(Distribution):
    def __init__(self, mean: float = 0.0, sd: float = 1.0):
        if sd <= 0:
            raise ValueError("sd must be positive")
        self.mean, self.sd = mean, sd

    def pdf(self, x):
        z = (x - self.mean) / self.sd
        return math.exp(-z * z / 2) / (self.sd * math.sqrt(2 * math.pi))

    def cdf(self, x):
        return sp.normal_cdf((x - self.mean) / self.sd)

    def quantile(self, p):
        return self.mean + self.sd * sp.normal_quantile(p)

    def column(self, kind, x):
        if kind == "pdf":
            z = (x - F.lit(self.mean)) / F.lit(self.sd)
            return F.exp(-z * z / 2) / F.lit(self.sd * math.sqrt(2 * math.pi))
        return super().column(kind, x)


class Uniform(Distribution):
    def __init__(self, low: float = 0.0, high: float = 1.0):
        if high <= low:
            raise ValueError("high must be above low")
        self.low, self.high = low, high

    def pdf(self, x):
        return 1 / (self.high - self.low) if self.low <= x <= self.high else 0.0

    def cdf(self, x):
        return min(1.0, max(0.0, (x - self.low) / (self.high - self.low)))

    def quantile(self, p):
        return self.low + p * (self.high - self.low)

    def column(self, kind, x):
        if kind == "pdf":
            return F.when(x.between(self.low, self.high), F.lit(1 / (self.high - self.low))).otherwise(0.0)
        if kind == "cdf":
            return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - self.low) / (self.high - self.low)))
        return F.lit(self.low) + x * (self.high - self.low)


class Gamma(Distribution):
    def __init__(self, shape: float, scale: float = 1.0):
        if shape <= 0 or scale <= 0:
            raise ValueError("shape and scale must be positive")
        self.shape, self.scale = shape, scale

    def pdf(self, x):
        if x < 0:
            return 0.0
        if x == 0:
            return math.inf if self.shape < 1 else 1 / self.scale if self.shape == 1 else 0.0
        y = x / self.scale
        return math.exp((self.shape - 1) * math.log(y) - y - math.lgamma(self.shape)) / self.scale

    def cdf(self, x):
        return sp.gamma_p(self.shape, x / self.scale)

    def quantile(self, p):
        return 0.0 if p <= 0 else math.inf if p >= 1 else sp.invert(self.cdf, p, 0.0, self.shape * self.scale + 1)


class ChiSquare(Gamma):
    def __init__(self, df: float):
        super().__init__(df / 2, 2.0)


class Beta(Distribution):
    def __init__(self, alpha: float, beta: float):
        if alpha <= 0 or beta <= 0:
            raise ValueError("alpha and beta must be positive")
        self.alpha, self.beta = alpha, beta

    def pdf(self, x):
        if not 0 < x < 1:
            return 0.0
        front = math.lgamma(self.alpha + self.beta) - math.lgamma(self.alpha) - math.lgamma(self.beta)
        return math.exp(front + (self.alpha - 1) * math.log(x) + (self.beta - 1) * math.log1p(-x))

    def cdf(self, x):
        return sp.beta_i(self.alpha, self.beta, x)

    def quantile(self, p):
        return 0.0 if p <= 0 else 1.0 if p >= 1 else sp.invert(self.cdf, p, 0.0, 1.0)


def qchisq(p: float, df: float) -> float:
    return ChiSquare(df).quantile(p)
