"""Tables: accepting, checking and reading columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import is_missing, is_numeric


def normalize(spark: SparkSession, data) -> DataFrame:
    """A DataFrame from a DataFrame, a list of dicts, a pandas frame, an object with objects(), or a Parquet path."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return spark.read.parquet(data)
    if callable(getattr(data, "objects", None)):
        data = data.objects()
    return spark.createDataFrame(data)


def get_columns(df: DataFrame) -> list[str]:
    return df.columns


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def filter_rows(df: DataFrame, predicate: Column | str | Callable[[DataFrame], Column]) -> DataFrame:
    return df.where(predicate(df) if callable(predicate) else predicate)


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    """Projection; a column that df lacks is null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns))


def to_matrix(df: DataFrame, columns: list[str], id_col: str | None = None) -> DataFrame:
    """Columns as doubles; a value that is no finite number raises when rows are read."""
    checked = [F.when(is_numeric(F.col(c).try_cast("double")), F.col(c).try_cast("double")).otherwise(F.raise_error(F.lit(f"{c} has a value that is no number")).cast("double")).alias(c) for c in columns]
    return df.select(*([id_col] if id_col else []), *checked)


def to_vector(df: DataFrame, column: str, id_col: str | None = None) -> DataFrame:
    return to_matrix(df, [column], id_col)


def to_columns(df: DataFrame, columns: list[str], id_col: str) -> dict[str, list]:
    """Columns as lists in the order of id_col; for small tables."""
    rows = df.orderBy(id_col).select(*columns).collect()
    return {c: [r[c] for r in rows] for c in columns}


def apply_columns(df: DataFrame, values: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """df with columns overwritten from values, matched by id_col; the tables must have the same ids."""
    new = values.select(id_col, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__has"))
    joined = df.join(new, id_col, "left")
    ok = F.when(F.col("__has"), F.lit(True)).otherwise(F.raise_error(F.lit("a row has no new values")).cast("boolean"))
    return joined.where(ok).select(*(F.col(f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns), *(F.col(f"__{c}").alias(c) for c in columns if c not in df.columns))


def na_omit_flag(na_omit: bool | None = None, omit_missing: bool | None = None) -> bool:
    """na_omit wins over omit_missing; true by default."""
    return next((x for x in (na_omit, omit_missing) if x is not None), True)


def na_omit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all the columns are present (neither null nor NaN)."""
    numbers = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    keep = F.lit(True)
    for c in columns:
        keep = keep & ~is_missing(c, c in numbers)
    return df.where(keep)
