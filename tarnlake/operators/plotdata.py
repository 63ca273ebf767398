"""Tables and settings for plots; nothing is drawn here."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import Normal
from . import metrics
from .kernels import positions
from .ordination import loading_rows


def _plot(kind: str, data, **axes) -> dict:
    return {"type": kind, "data": data, "axes": axes}


def plot_roc(df: DataFrame, y: str, p: str) -> dict:
    return _plot("roc", metrics.roc_points(df, y, p), x="fpr", y="tpr") | {"auc": metrics.roc_auc(df, y, p)}


def plot_precision_recall(df: DataFrame, y: str, p: str) -> dict:
    return _plot("precision_recall", metrics.precision_recall_points(df, y, p), x="recall", y="precision")


def plot_confusion_matrix(df: DataFrame, y: str, p: str, normalize: bool = False) -> dict:
    return _plot("confusion", metrics.confusion(df, y, p, normalize), x="predicted", y="actual")


def plot_calibration(df: DataFrame, y: str, p: str, id_col: str, bins: int = 10) -> dict:
    return _plot("calibration", metrics.calibration(df, y, p, id_col, bins), x="mean_predicted", y="fraction_positive")


def plot_silhouette(samples: DataFrame) -> dict:
    """Samples in the order of cluster and falling silhouette."""
    return _plot("silhouette", positions(samples, [F.col("label"), F.desc("s"), F.col("id")], "place"), x="s", y="place")


def plot_scree(eigenvalues: list[float], cumulative: bool = True) -> dict:
    whole = sum(eigenvalues) or 1.0
    rows = [{"component": k + 1, "percent": 100 * e / whole} for k, e in enumerate(eigenvalues)]
    if cumulative:
        for r, c in zip(rows, np.cumsum([r["percent"] for r in rows]), strict=True):
            r["cumulative"] = float(c)
    return _plot("scree", rows, x="component", y="percent")


def dendrogram_layout(merges: list[tuple[int, int, float, int]], n: int) -> list[dict]:
    """Segments of a dendrogram: leaves stand in merge order."""
    children = {n + k: (a, b) for k, (a, b, _, _) in enumerate(merges)}
    order, stack = [], [n + len(merges) - 1] if merges else list(range(n))
    while stack:
        i = stack.pop()
        if i in children:
            stack += reversed(children[i])
        else:
            order.append(i)
    x, h = {i: float(k) for k, i in enumerate(order)}, dict.fromkeys(range(n), 0.0)
    out = []
    for k, (a, b, height, _) in enumerate(merges):
        x[n + k], h[n + k] = (x[a] + x[b]) / 2, height
        out.append({"x1": x[a], "y1": h[a], "x2": x[b], "y2": h[b], "height": height})
    return out


def plot_hca(model) -> dict:
    return _plot("dendrogram", dendrogram_layout(model.merges, len(model.ids)), x="x", y="height")


def plot_feature_importance(rows: list[dict], top: int = 20) -> dict:
    return _plot("bar", sorted(rows, key=lambda r: -r["importance"])[:top], x="importance", y="feature")


def plot_partial_dependence(df: DataFrame) -> dict:
    return _plot("line", df, x="value", y="mean_prediction")


def plot_correlation_matrix(matrix, names: list[str]) -> dict:
    return _plot("heatmap", [{"row": a, "column": b, "correlation": float(v)} for a, r in zip(names, matrix, strict=True) for b, v in zip(names, r, strict=True)], x="column", y="row")


def plot_residuals(df: DataFrame) -> dict:
    return _plot("scatter", df.select("fitted", "residual"), x="fitted", y="residual")


def qq_table(df: DataFrame, value: str, id_col: str, scale: float = 1.0) -> DataFrame:
    """value / scale in order, with normal quantiles at (place - 0.5) / n."""
    n = df.where(F.col(value).isNotNull()).count()
    ranked = positions(df.where(F.col(value).isNotNull()).select(id_col, (F.col(value) / F.lit(float(scale))).alias("sample")), [F.col("sample"), F.col(id_col)], "place")
    return ranked.withColumn("theoretical", Normal().column("quantile", (F.col("place") - F.lit(0.5)) / F.lit(float(max(1, n)))))


def plot_qq(df: DataFrame, value: str, id_col: str, scale: float = 1.0) -> dict:
    return _plot("qq", qq_table(df, value, id_col, scale), x="theoretical", y="sample")


def plot_learning_curve(rows: list[dict]) -> dict:
    return _plot("lines", rows, x="share", y=["train_mean", "test_mean"])


def scale_location(df: DataFrame) -> dict:
    return _plot("scatter", df.select("fitted", F.sqrt(F.abs("standardized")).alias("root")), x="fitted", y="root")


def residuals_by_index(df: DataFrame, id_col: str, top: int = 5) -> dict:
    labels = df.orderBy(F.desc(F.abs("standardized")), id_col).limit(top).select(id_col, "standardized")
    return _plot("scatter", df.select(id_col, "standardized"), x=id_col, y="standardized") | {"labels": labels}


def diagnostic_dashboard(df: DataFrame, id_col: str) -> list[dict]:
    """df as residual_table() gives it."""
    return [plot_residuals(df), plot_qq(df, "standardized", id_col), scale_location(df), residuals_by_index(df, id_col)]


def effect_plot(model, df: DataFrame, variable: str, points: int = 50) -> dict:
    """Predictions on a grid of one variable, the others at their means."""
    names = [n for n in model.names if n != "(Intercept)"]
    row = df.agg(F.min(variable), F.max(variable), *(F.avg(n) for n in names)).first()
    low, high = float(row[0]), float(row[1])
    grid = df.sparkSession.range(points).select((F.lit(low) + F.col("id") * F.lit((high - low) / max(1, points - 1))).alias(variable), *(F.lit(float(m)).alias(n) for n, m in zip(names, row[2:], strict=True) if n != variable))
    return _plot("line", model.predict(grid, interval=True), x=variable, y="prediction")


def partial_residuals(model, df: DataFrame, y: str, variable: str) -> dict:
    b = model.coefficients[model.names.index(variable)]
    rows = model.predict(df).select(F.col(variable).alias("x"), (F.col(y) - F.col("prediction") + F.lit(float(b)) * F.col(variable)).alias("partial"))
    return _plot("scatter", rows, x="x", y="partial")


def model_selection(rows: list[dict], criterion: str = "aic") -> dict:
    return _plot("bar", rows, x="model", y=criterion)


def akaike_weights(rows: list[dict]) -> dict:
    return _plot("bar", [{"model": r["model"], "weight": r["weight"]} for r in rows], x="model", y="weight")


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners counter-clockwise, by a monotone chain."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(points_):
        out = []
        for q in points_:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def group_hulls(points: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """group, and the corners of its convex hull: tasks send the corners of their own rows only, and these are put together."""
    kind = dict(points.dtypes)[group]
    schema = f"g {kind}, corners array<struct<x:double,y:double>>"

    def corners(frame) -> list[dict]:
        hull = convex_hull(list(zip(frame["x"].tolist(), frame["y"].tolist(), strict=True)))
        return [{"x": a, "y": b} for a, b in hull]

    def partial(frames):
        import pandas as pd

        for f in frames:
            own = [(g, corners(part)) for g, part in f.groupby("g")]
            yield pd.DataFrame({"g": [g for g, _ in own], "corners": [c for _, c in own]})

    def whole(frame):
        import pandas as pd

        every = pd.DataFrame([(p["x"], p["y"]) for c in frame["corners"] for p in c], columns=["x", "y"])
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "corners": [corners(every)]})

    rows = points.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return rows.mapInPandas(partial, schema).groupBy("g").applyInPandas(whole, schema)


def ordiplot(scores: DataFrame, loadings, names: list[str], axes: tuple[str, str] = ("pc1", "pc2"), group: str | None = None) -> dict:
    """Points, arrows, and for groups their convex hulls (the corners are collected: a plot draws them all)."""
    out = _plot("biplot", scores.select(*axes, *([group] if group else [])), x=axes[0], y=axes[1]) | {"arrows": loading_rows(np.asarray(loadings)[:, :2], names)}
    if group:
        out["hulls"] = {r["g"]: [(p["x"], p["y"]) for p in r["corners"]] for r in group_hulls(scores, *axes, group).collect()}
    return out
