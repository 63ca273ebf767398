"""Kernels that most operators share: cross products, running totals and ranks, and pairwise distances.

Only sums of fixed size (the square of the number of columns) or one row a partition reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..session import cut


def gram(df: DataFrame, columns: list[str | Column], weight: str | Column | None = None, shift: list[float] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of weights, weighted sums and weighted cross products of the columns (less shift), in one aggregation."""
    p = len(columns)
    shift = shift or [0.0] * p
    x = [col(c).cast("double") - F.lit(float(s)) for c, s in zip(columns, shift, strict=True)]
    w = col(weight).cast("double") if weight is not None else F.lit(1.0)
    named = df.select(w.alias("w"), *(c.alias(f"x{i}") for i, c in enumerate(x)))
    if p <= 24:
        sums = [F.sum("w")] + [F.sum(F.col("w") * F.col(f"x{i}")) for i in range(p)] + [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)]
        row = [v or 0.0 for v in named.agg(*sums).first()]
    else:  # many columns: partitions' partial sums as arrays, added position by position
        def partial(frames):
            acc = np.zeros(1 + p + p * (p + 1) // 2)
            upper = np.triu_indices(p)
            for f in frames:
                v, m = f["w"].to_numpy(), f.drop(columns="w").to_numpy()
                acc += np.concatenate([[v.sum()], v @ m, ((m * v[:, None]).T @ m)[upper]])
            yield pd.DataFrame({"k": np.arange(len(acc)), "v": acc})

        got = named.mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        row = [0.0] * (1 + p + p * (p + 1) // 2)
        for r in got:
            row[r["k"]] = r["v"]
    cross = np.zeros((p, p))
    cross[np.triu_indices(p)] = row[1 + p :]
    return row[0], np.array(row[1 : 1 + p]), cross + np.triu(cross, 1).T


def means(df: DataFrame, columns: list[str]) -> list[float]:
    return [v if v is not None else 0.0 for v in df.agg(*(F.avg(c) for c in columns)).first()]


def covariance(df: DataFrame, columns: list[str], ddof: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means and covariance; columns are shifted by their means first, against cancellation."""
    mu = means(df, columns)
    n, s, c = gram(df, columns, shift=mu)
    m = s / max(n, 1)
    return int(n), np.array(mu) + m, (c - n * np.outer(m, m)) / max(n - ddof, 1)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def running(df: DataFrame, order: list[Column], values: dict[str, tuple[str | Column, str]], n: int | None = None) -> DataFrame:
    """df with running sums, maxima or minima (this row included) of values in the given order, over all rows, and no task that sees
    all rows: rows are range-partitioned by the order, and results of whole partitions are added to those within each. Rows
    should have distinct order values; equal ones stand next to each other in no fixed order."""
    parts = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    made = {"sum": F.sum, "max": F.max, "min": F.min}
    new = {f"__{k}": col(v) if isinstance(v, str) else v for k, (v, _) in values.items()}
    dealt = cut(df.withColumns(new).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    whole = dealt.groupBy("__part").agg(*(made[kind](f"__{k}").alias(k) for k, (_, kind) in values.items())).orderBy("__part").collect()
    join = {"sum": lambda a, b: a + b, "max": max, "min": min}
    w = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt
    for k, (_, kind) in values.items():
        before, acc = [], 0 if kind == "sum" else None
        for r in whole:
            if acc is not None:
                before += [F.lit(r["__part"]), F.lit(acc)]
            if r[k] is not None:
                acc = r[k] if acc is None else join[kind](acc, r[k])
        own = made[kind](f"__{k}").over(w)
        start = F.create_map(*before)[F.col("__part")] if before else None
        if start is not None:
            own = own + F.coalesce(start, F.lit(0)) if kind == "sum" else (F.greatest if kind == "max" else F.least)(own, start)
        out = out.withColumn(k, own)
    return out.drop("__part", "__row", *new)


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str | Column], n: int | None = None) -> DataFrame:
    """running() of sums."""
    return running(df, order, {k: (v, "sum") for k, v in sums.items()}, n)


def previous(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the value of the row before it in the given order (null for the first), with no task that sees all rows, as running()."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    before, last = [], None
    for r in dealt.groupBy("__part").agg(F.max_by(F.struct(F.col(value).alias("v")), "__row").alias("end")).orderBy("__part").collect():
        if last is not None:
            before += [F.lit(r["__part"]), F.lit(last)]
        last = r["end"]["v"]
    w = Window.partitionBy("__part").orderBy("__row")
    start = F.create_map(*before)[F.col("__part")] if before else F.lit(None)
    return dealt.withColumn(name, F.when(F.row_number().over(w) == 1, start).otherwise(F.lag(value).over(w))).drop("__part", "__row")


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with the position of each row (from 1) in the order."""
    return running_totals(df, order, {name: F.lit(1).cast("long")})


def value_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """value, n (its rows) and name (the average rank of these rows): one row a distinct value."""
    n = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return running_totals(n, [F.col(value)], {"upto": "n"}).select(value, "n", (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias(name))


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """df with average ranks, ties sharing theirs."""
    return df.join(value_ranks(df, value, name).drop("n"), value)


def pick_sorted(df: DataFrame, value: str, places: list[int]) -> list[float]:
    """Values at 0-based places of the ascending order."""
    got = running_totals(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), [F.col(value)], {"upto": "n"})
    picks = got.agg(*(F.min(F.when(F.col("upto") > F.lit(k), F.col(value))) for k in places)).first()
    return list(picks)


def near_pairs(left: DataFrame, right: DataFrame, columns: list[str], radius: float, left_id: str, right_id: str, metric: str = "euclidean") -> DataFrame:
    """Pairs within radius, inclusive, by an equi-join on grid cells of the first columns: no pair beyond neighbouring cells is formed."""
    from ..functions.expressions import distance_function

    keys = columns[:3]
    width = F.lit(float(radius) or 1.0)
    cell = lambda c: F.floor(F.col(c).cast("double") / width)
    a = left.select(F.col(left_id).alias("id_l"), *(F.col(c).cast("double").alias(f"l_{c}") for c in columns), *(cell(c).alias(f"k{i}") for i, c in enumerate(keys)))
    b = right.select(F.col(right_id).alias("id_r"), *(F.col(c).cast("double").alias(f"r_{c}") for c in columns), *(cell(c).alias(f"g{i}") for i, c in enumerate(keys)))
    for i in range(len(keys)):
        b = b.withColumn(f"k{i}", F.explode(F.array(*(F.col(f"g{i}") + d for d in (-1, 0, 1)))))
    joined = a.join(b, [f"k{i}" for i in range(len(keys))])
    d = distance_function(metric)([f"l_{c}" for c in columns], [f"r_{c}" for c in columns])
    return joined.select("id_l", "id_r", d.alias("distance")).where(F.col("distance") <= F.lit(float(radius)))


def is_stars(edges: DataFrame) -> bool:
    """Whether every node of edges (u > v) is either a root or tied to one root only; one aggregation tells."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.node", "e.up")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("root")).where("ups > 1 or (ups = 1 and root = 0)").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: list[int] | None = None) -> DataFrame:
    """node, component (smallest node reached), by alternating star contractions: the number of rounds grows with the logarithm of
    the number of nodes and not with the width of a component. Nodes without an edge to another node (a loop counts as none)
    are their own components. rounds, if given, receives the number of rounds."""
    every = edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
    tidy = lambda df: df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    loops = cut(every.where("u = v").select(F.col("u").alias("node")).distinct())
    now, k = cut(tidy(every)), 0
    while not is_stars(now):
        k += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Every larger neighbour is tied to the smallest of the neighbourhood.
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        middle = cut(tidy(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))))
        # Every node and its smaller neighbours are tied to the smallest of these.
        stars = middle.join(middle.groupBy("u").agg(F.min("v").alias("least")), "u")
        now = cut(tidy(stars.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")))
    if rounds is not None:
        rounds.append(k)
    label = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    alone = loops.join(label, "node", "left_anti").select("node", F.col("node").alias("component"))
    return cut(label.union(alone))
