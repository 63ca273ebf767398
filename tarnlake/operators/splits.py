"""Splits and cross-validation. Order is that of a salted hash of the id, so that splits repeat; counts are exact."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import positions


def shuffled(id_col: str, seed: int = 0) -> list[Column]:
    """Sort keys of a repeatable shuffle."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), F.col(id_col)]


def random_numbers(id_col: str, seed: int = 0) -> Column:
    """Uniform numbers in [0, 1) that a seed and the id fix, whatever the partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def random_integers(id_col: str, low: int, high: int, seed: int = 0) -> Column:
    """Whole numbers from low to high - 1."""
    return (F.lit(low) + F.floor(random_numbers(id_col, seed) * (high - low))).cast("long")


def train_test_split(df: DataFrame, id_col: str, ratio: float = 0.8, shuffle: bool = True, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first floor(n ratio) rows of the order, and the rest."""
    marked = positions(df, shuffled(id_col, seed) if shuffle else [F.col(id_col)], "__at")
    n = math.floor(df.count() * ratio)
    return marked.where(F.col("__at") <= n).drop("__at"), marked.where(F.col("__at") > n).drop("__at")


def k_fold(df: DataFrame, id_col: str, k: int = 5, shuffle: bool = False, seed: int = 0, name: str = "fold") -> DataFrame:
    """df with fold 0 .. k - 1: runs of floor(n / k) rows, the last fold takes the rest."""
    marked = positions(df, shuffled(id_col, seed) if shuffle else [F.col(id_col)], "__at")
    size = max(1, df.count() // k)
    return marked.withColumn(name, F.least(F.floor((F.col("__at") - 1) / F.lit(size)), F.lit(k - 1)).cast("int")).drop("__at")


def stratified_k_fold(df: DataFrame, id_col: str, y: str, k: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """k folds of each class on its own; positions of all classes are found in one pass."""
    keys = shuffled(id_col, seed)
    marked = positions(df, [F.col(y), *keys], "__at")
    sizes = df.groupBy(y).agg(F.count("*").alias("__n"))
    start = marked.groupBy(y).agg(F.min("__at").alias("__first"))
    out = marked.join(sizes.join(start, y), y)
    size = F.greatest(F.lit(1), F.floor(F.col("__n") / k))
    return out.withColumn(name, F.least(F.floor((F.col("__at") - F.col("__first")) / size), F.lit(k - 1)).cast("int")).drop("__at", "__n", "__first")


def group_k_fold(df: DataFrame, group: str, k: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """Whole groups in folds whose numbers of groups differ by one at most."""
    groups = positions(df.select(group).distinct(), shuffled(group, seed), "__at")
    return df.join(groups.select(group, F.pmod(F.col("__at") - 1, F.lit(k)).cast("int").alias(name)), group)


def leave_one_out(df: DataFrame, id_col: str, name: str = "fold") -> DataFrame:
    return positions(df, [F.col(id_col)], name).withColumn(name, F.col(name) - 1)


def shuffle_split(df: DataFrame, id_col: str, n_splits: int = 5, test_ratio: float = 0.2, seed: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) of repeated splits; a test part has max(1, floor(n ratio)) rows."""
    n = max(1, math.floor(df.count() * test_ratio))
    out = []
    for s in range(n_splits):
        marked = positions(df, shuffled(id_col, seed + s), "__at")
        out.append((marked.where(F.col("__at") > n).drop("__at"), marked.where(F.col("__at") <= n).drop("__at")))
    return out


def cross_validate(fit: Callable, score: Callable, df: DataFrame, fold: str = "fold") -> dict:
    """fit(train) gives a model, score(model, test) a number; mean and population deviation of the folds' scores."""
    scores = []
    for f in [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:
        scores.append(score(fit(df.where(F.col(fold) != f).drop(fold)), df.where(F.col(fold) == f).drop(fold)))
    mean = sum(scores) / len(scores)
    return {"scores": scores, "mean": mean, "std": math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))}


def cross_validate_models(fits: dict[str, Callable], score: Callable, df: DataFrame, fold: str = "fold") -> list[dict]:
    """cross_validate() of several models on the same folds, the best mean first."""
    rows = [{"model": name} | cross_validate(fit, score, df, fold) for name, fit in fits.items()]
    return sorted(rows, key=lambda r: -r["mean"])


def sample_rows(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of the shuffled order: each task keeps its first k, and these are merged."""
    return df.orderBy(*shuffled(id_col, seed)).limit(k)


def upsample(df: DataFrame, y: str, id_col: str, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Random repeats are added to each class until it has floor(majority ratio) rows; larger classes stay as they are."""
    counts = df.groupBy(y).agg(F.count("*").alias("__n"))
    goal = math.floor((counts.agg(F.max("__n")).first()[0] or 0) * ratio)
    first = positions(df, [F.col(y), *shuffled(id_col, seed)], "__at")
    start = first.groupBy(y).agg(F.min("__at").alias("__first"))
    need = counts.join(start, y).where(F.col("__n") < goal).withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(goal) - F.col("__n"))))
    pick = need.select(F.col(y).alias("__y"), (F.col("__first") + F.pmod(F.xxhash64(F.lit(seed), y, "__draw"), F.col("__n"))).alias("__at"))
    more = first.join(pick, "__at").drop("__y")
    return df.unionByName(more.select(df.columns))


def downsample(df: DataFrame, y: str, id_col: str, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """At most floor(minority * ratio) rows of each class, in the shuffled order."""
    counts = df.groupBy(y).agg(F.count("*").alias("__n"))
    goal = math.floor((counts.agg(F.min("__n")).first()[0] or 0) * ratio)
    first = positions(df, [F.col(y), *shuffled(id_col, seed)], "__at")
    start = first.groupBy(y).agg(F.min("__at").alias("__first"))
    return first.join(start, y).where(F.col("__at") - F.col("__first") < goal).select(df.columns)


def fold_frames(df: DataFrame, fold: str = "fold") -> list[tuple[DataFrame, DataFrame]]:
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    return [(df.where(F.col(fold) != f), df.where(F.col(fold) == f)) for f in folds]
