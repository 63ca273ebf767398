"""Metrics, losses and impurity criteria: Columns for agg(), or small results of counted tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col
from .kernels import running_totals, value_ranks


def mse(y, p) -> Column:
    return F.avg((col(y) - col(p)) * (col(y) - col(p)))


def rmse(y, p) -> Column:
    return F.sqrt(mse(y, p))


def mae(y, p) -> Column:
    return F.avg(F.abs(col(y) - col(p)))


def r2(y, p) -> Column:
    return 1 - F.try_divide(mse(y, p), F.var_pop(col(y)))


def accuracy(y, p) -> Column:
    return F.avg(F.when(col(y) == col(p), 1.0).otherwise(0.0))


def _hits(y, p, positive) -> tuple[Column, Column, Column]:
    t, q = col(y) == F.lit(positive), col(p) == F.lit(positive)
    return tuple(F.sum(F.when(c, 1.0).otherwise(0.0)) for c in (t & q, q, t))


def precision(y, p, positive=1) -> Column:
    tp, predicted, _ = _hits(y, p, positive)
    return F.coalesce(F.try_divide(tp, predicted), F.lit(0.0))


def recall(y, p, positive=1) -> Column:
    tp, _, actual = _hits(y, p, positive)
    return F.coalesce(F.try_divide(tp, actual), F.lit(0.0))


def f1(y, p, positive=1) -> Column:
    tp, predicted, actual = _hits(y, p, positive)
    return F.coalesce(F.try_divide(2 * tp, predicted + actual), F.lit(0.0))


def log_loss(y, p, eps: float = 1e-15) -> Column:
    q = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), col(p)))
    return -F.avg(col(y) * F.ln(q) + (1 - col(y)) * F.ln(1 - q))


def confusion(df: DataFrame, y: str, p: str, normalize: bool = False) -> DataFrame:
    """actual, predicted, n (and share of the actual class) for all pairs of the labels that occur."""
    n = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))
    labels = n.select(F.col("actual").alias("l")).union(n.select("predicted")).distinct()  # of classes, not of rows
    grid = labels.withColumnRenamed("l", "actual").crossJoin(labels.withColumnRenamed("l", "predicted"))
    out = grid.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    if not normalize:
        return out
    whole = out.groupBy("actual").agg(F.sum("n").alias("t"))
    return out.join(whole, "actual").select("actual", "predicted", "n", F.coalesce(F.try_divide(F.col("n"), F.col("t")), F.lit(0.0)).alias("share"))


def confusion_text(df: DataFrame, y: str, p: str) -> str:
    rows = confusion(df, y, p).collect()
    labels = sorted({r["actual"] for r in rows})
    n = {(r["actual"], r["predicted"]): r["n"] for r in rows}
    width = max(len(str(x)) for x in [*labels, *n.values(), "actual"]) + 2
    line = lambda head, cells: f"{head:>{width}}" + "".join(f"{c:>{width}}" for c in cells)
    return "\n".join([line("actual", map(str, labels)), *(line(str(a), [n[a, b] for b in labels]) for a in labels)])


def roc_auc(df: DataFrame, y: str, p: str) -> float:
    """Area by average ranks; 0.5 where one class is absent."""
    n = df.groupBy(p).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"))
    got = n.join(value_ranks(df, p), p).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("pos"), F.sum("n").alias("n")).first()
    pos, neg = got["pos"] or 0, (got["n"] or 0) - (got["pos"] or 0)
    return (got["r"] - pos * (pos + 1) / 2) / (pos * neg) if pos and neg else 0.5


def roc_points(df: DataFrame, y: str, p: str) -> DataFrame:
    """threshold, fpr, tpr for each distinct score, from high to low, without the start at (0, 0)."""
    n = df.groupBy(p).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    whole = n.agg(F.sum("pos"), F.sum("n")).first()
    run = running_totals(n, [F.desc(p)], {"tp": "pos", "upto": "n"})
    pos, neg = float(whole[0] or 0), float((whole[1] or 0) - (whole[0] or 0))
    rate = lambda c, t: c / F.lit(t) if t else F.lit(0.0)
    return run.select(F.col(p).alias("threshold"), rate(F.col("upto") - F.col("tp"), neg).alias("fpr"), rate(F.col("tp"), pos).alias("tpr"))


def precision_recall_points(df: DataFrame, y: str, p: str) -> DataFrame:
    """threshold, precision, recall for each distinct score, from high to low."""
    n = df.groupBy(p).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    pos = float(n.agg(F.sum("pos")).first()[0] or 0)
    run = running_totals(n, [F.desc(p)], {"tp": "pos", "upto": "n"})
    return run.select(F.col(p).alias("threshold"), (F.col("tp") / F.col("upto")).alias("precision"), (F.col("tp") / F.lit(pos or 1.0)).alias("recall"))


def calibration(df: DataFrame, y: str, p: str, id_col: str, bins: int = 10) -> DataFrame:
    """bin, mean_predicted, fraction_positive, n of bins of ceil(n / bins) rows in the order of p."""
    from .kernels import positions

    n = df.count()
    size = -(-n // bins) or 1
    ranked = positions(df.select(id_col, p, y), [F.col(p), F.col(id_col)])
    return ranked.groupBy(F.ceil(F.col("position") / F.lit(size)).cast("int").alias("bin")).agg(F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("fraction_positive"), F.count("*").alias("n"))


def cohen_kappa(df: DataFrame, y: str, p: str) -> float:
    """From three sums; no table of labels reaches the driver."""
    cells = df.groupBy(F.col(y).alias("a"), F.col(p).alias("b")).agg(F.count("*").alias("n"))
    n, same = cells.agg(F.sum("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0))).first()
    if not n:
        return 1.0
    row, column = cells.groupBy("a").agg(F.sum("n").alias("r")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("c"))
    chance = row.join(column, "a").agg(F.sum(F.col("r").cast("double") * F.col("c"))).first()[0] or 0.0
    po, pe = same / n, chance / n / n
    return (po - pe) / (1 - pe) if pe < 1 else 1.0


def adjusted_rand_index(df: DataFrame, y: str, p: str) -> float:
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(F.col(y).alias("a"), F.col(p).alias("b")).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(pairs("n"), F.sum("n")).first()
    a = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs("n")).first()[0]
    b = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs("n")).first()[0]
    n = both[1]
    expected, most = a * b / (n * (n - 1) / 2), (a + b) / 2
    return (both[0] - expected) / (most - expected) if most != expected else 1.0


# Losses: mean loss, and the gradient of each row's prediction.


def mse_loss(y, p):
    return mse(y, p), 2 * (col(p) - col(y))


def mae_loss(y, p):
    return mae(y, p), F.signum(col(p) - col(y))


def log_loss_with_gradient(y, p, eps: float = 1e-15):
    q = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), col(p)))
    return log_loss(y, p, eps), (q - col(y)) / (q * (1 - q))


def hinge_loss(y, p):
    margin = col(y) * col(p)
    return F.avg(F.greatest(F.lit(0.0), 1 - margin)), F.when(margin < 1, -col(y)).otherwise(0.0)


def huber_loss(y, p, delta: float = 1.0):
    e = col(p) - col(y)
    return F.avg(F.when(F.abs(e) <= delta, e * e / 2).otherwise(F.lit(delta) * (F.abs(e) - delta / 2))), F.when(F.abs(e) <= delta, e).otherwise(F.lit(delta) * F.signum(e))


def cross_entropy(y: list, p: list, eps: float = 1e-15):
    """Over lists of columns of true and predicted shares."""
    from ..functions.expressions import total

    q = [F.least(F.lit(1 - eps), F.greatest(F.lit(eps), col(c))) for c in p]
    return -F.avg(total([col(a) * F.ln(b) for a, b in zip(y, q, strict=True)])), [-col(a) / b for a, b in zip(y, q, strict=True)]


LOSSES = {"mse": mse_loss, "squared": mse_loss, "mae": mae_loss, "absolute": mae_loss, "log": log_loss_with_gradient, "logloss": log_loss_with_gradient, "hinge": hinge_loss, "huber": huber_loss, "crossentropy": cross_entropy}


def loss_function(name: str):
    key = name.lower().replace("_", "").replace("-", "")
    if key not in LOSSES:
        raise ValueError(f"no loss {name}; known: {', '.join(LOSSES)}")
    return LOSSES[key]


# Impurity of a list of class shares, or of values.


def gini(shares: list[float]) -> float:
    return 1 - sum(s * s for s in shares) if shares else 0.0


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log2(s) for s in shares if s > 0)


def classification_error(shares: list[float]) -> float:
    return 1 - max(shares) if shares else 0.0


def variance_criterion(values: list[float]) -> float:
    m = sum(values) / len(values) if values else 0.0
    return sum((v - m) ** 2 for v in values) / len(values) if values else 0.0


def mae_criterion(values: list[float]) -> float:
    """About the upper median."""
    m = sorted(values)[len(values) // 2] if values else 0.0
    return sum(abs(v - m) for v in values) / len(values) if values else 0.0


CRITERIA = {"gini": gini, "entropy": entropy, "classification_error": classification_error, "mse": variance_criterion, "variance": variance_criterion, "mae": mae_criterion}


def criterion_function(criterion):
    if callable(criterion):
        return criterion
    if criterion not in CRITERIA:
        raise ValueError(f"no criterion {criterion}; known: {', '.join(CRITERIA)}")
    return CRITERIA[criterion]


def information_gain(parent: list, left: list, right: list, f) -> float:
    """Drop of an impurity over items; 0 if a side is empty."""
    if not left or not right:
        return 0.0
    n = len(parent)
    return f(parent) - len(left) / n * f(left) - len(right) / n * f(right)


def group_impurity(df: DataFrame, group: str, label: str) -> DataFrame:
    """gini, entropy and classification error of label in each group."""
    from pyspark.sql import Window

    n = df.groupBy(group, label).agg(F.count("*").alias("n"))
    s = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return n.withColumn("s", s).groupBy(group).agg((1 - F.sum(F.col("s") * F.col("s"))).alias("gini"), (-F.sum(F.col("s") * F.log2("s"))).alias("entropy"), (1 - F.max("s")).alias("error"))
