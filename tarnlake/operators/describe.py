"""Descriptive statistics as aggregates; every function gives a Column to be used in agg() of whole tables or of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import clean, col

NAN = float("nan")


def _value(c, omit: bool) -> Column:
    """Missing and non-finite values are left out with omit, and raise without."""
    if omit:
        return clean(c)
    return F.when(clean(c).isNotNull(), clean(c)).otherwise(F.raise_error(F.lit("missing or non-finite value")).cast("double"))


def sum_of(c, omit: bool = True) -> Column:
    return F.coalesce(F.sum(_value(c, omit)), F.lit(0.0))


def mean(c, omit: bool = True) -> Column:
    return F.coalesce(F.avg(_value(c, omit)), F.lit(NAN))


def variance(c, sample: bool = True, omit: bool = True) -> Column:
    v = _value(c, omit)
    return F.coalesce(F.var_samp(v) if sample else F.var_pop(v), F.lit(NAN))


def stddev(c, sample: bool = True, omit: bool = True) -> Column:
    return F.sqrt(variance(c, sample, omit))


std = sd = stddev


def quantile(c, p: float | list[float], omit: bool = True) -> Column:
    """Linear interpolation between order statistics (type 7)."""
    return F.percentile(_value(c, omit), F.array(*(F.lit(float(x)) for x in p)) if isinstance(p, list) else F.lit(float(p)))


def median(c, omit: bool = True) -> Column:
    return quantile(c, 0.5, omit)


def percentile_of(c, value: float, omit: bool = True) -> Column:
    """Share of values at or below value."""
    return F.avg(F.when(_value(c, omit).isNotNull(), F.when(_value(c, omit) <= F.lit(float(value)), 1.0).otherwise(0.0)))


def summary_quantiles(c, probs: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> Column:
    return quantile(c, list(probs))


def minimum(c, omit: bool = True) -> Column:
    return F.coalesce(F.min(_value(c, omit)), F.lit(NAN))


def maximum(c, omit: bool = True) -> Column:
    return F.coalesce(F.max(_value(c, omit)), F.lit(NAN))


def nearest_quantile(df: DataFrame, c: str, p: float) -> float:
    """The order statistic nearest to place p (n - 1); beyond the middle the upper one."""
    import math

    from .kernels import pick_sorted

    rows = df.select(clean(c).alias("v")).where("v is not null")
    n = rows.count()
    if not n:
        return NAN
    place = p * (n - 1)
    return pick_sorted(rows, "v", [math.floor(place) + (place - math.floor(place) > 0.5)])[0]


def value_range(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> DataFrame:
    """value from start to stop, inclusive."""
    if not step or (stop - start) * step < 0:
        raise ValueError("step must lead from start to stop")
    n = int((stop - start) / step + 1e-9) + 1
    return spark.range(n).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("value"))


def mode(df: DataFrame, c: str, order: str) -> object:
    """Most frequent value; of equally frequent ones that with the smallest order value."""
    row = df.where(col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"), F.min(order).alias("o")).orderBy(F.desc("n"), "o").first()
    return row[c] if row else None
