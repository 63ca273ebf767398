"""Interpretation of fitted models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import pick_sorted, positions
from .splits import shuffled


def permutation_importance(score: Callable[[DataFrame], float], df: DataFrame, columns: list[str], id_col: str, repeats: int = 10, seed: int = 0) -> list[dict]:
    """Drop of score(df) when a column's values are dealt anew among the rows (joined by position)."""
    base, out = score(df), []
    fixed = positions(df, [F.col(id_col)], "__at").persist()
    for k, c in enumerate(columns):
        drops = []
        for r in range(repeats):
            other = positions(df.select(id_col, F.col(c).alias("__v")), shuffled(id_col, seed + 1000 * k + r), "__at").select("__at", "__v")
            drops.append(base - score(fixed.join(other, "__at").withColumn(c, F.col("__v")).drop("__v", "__at")))
        out.append({"feature": c, "importance": float(np.mean(drops)), "std": float(np.std(drops))})
    fixed.unpersist()
    return sorted(out, key=lambda d: -d["importance"])


def coefficient_importance(coefficients: list[float], names: list[str]) -> list[dict]:
    return sorted(({"feature": n, "coefficient": b, "importance": abs(b)} for n, b in zip(names, coefficients, strict=True)), key=lambda d: -d["importance"])


def partial_dependence(predict: Callable[[DataFrame], DataFrame], df: DataFrame, column: str, grid_size: int = 20, percentiles: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """value, mean prediction: the table with the column held at each of grid_size values (a fixed number, so no join of rows)."""
    n = df.where(F.col(column).isNotNull()).count()
    low, high = pick_sorted(df, column, [min(n - 1, int(p * n)) for p in percentiles])
    grid = [low + (high - low) * k / max(1, grid_size - 1) for k in range(grid_size)]
    spread = df.withColumn("__g", F.explode(F.array(*(F.lit(float(g)) for g in grid)))).withColumn(column, F.col("__g"))
    return predict(spread).groupBy(F.col("__g").alias("value")).agg(F.avg("prediction").alias("mean_prediction")).orderBy("value")


def residual_table(df: DataFrame, y: str, prediction: str = "prediction") -> DataFrame:
    """fitted, residual, standardized (by the population deviation)."""
    r = F.col(y) - F.col(prediction)
    mean, sd = df.agg(F.avg(r), F.stddev_pop(r)).first()
    return df.withColumns({"fitted": F.col(prediction), "residual": r, "standardized": (r - F.lit(mean)) / F.lit(sd or 1.0)})


def learning_curve(fit: Callable, score: Callable, df: DataFrame, id_col: str, train_sizes: tuple[float, ...] = (0.1, 0.33, 0.55, 0.78, 1.0), cv: int = 5) -> list[dict]:
    """Scores of models fitted on prefixes of the training folds."""
    from .splits import fold_frames, k_fold

    out = []
    folds = fold_frames(k_fold(df, id_col, cv))
    for share in train_sizes:
        train_scores, test_scores = [], []
        for train, test in folds:
            marked = positions(train, [F.col(id_col)], "__at")
            part = marked.where(F.col("__at") <= max(1, int(share * train.count()))).drop("__at")
            model = fit(part)
            train_scores.append(score(model, part))
            test_scores.append(score(model, test))
        out.append({"share": share, "train_mean": float(np.mean(train_scores)), "train_std": float(np.std(train_scores)), "test_mean": float(np.mean(test_scores)), "test_std": float(np.std(test_scores))})
    return out
