"""Exact nearest neighbours and sums of distances without a product of two tables.

The searched rows are dealt into cells of a k-d tree, whose cuts come from a bounded sample and whose boxes are measured over
all rows. A row's k nearest in its own cell give a bound; it is then sent only to cells whose box is not beyond that bound.
Large cells and cells with many queries are cut into blocks, so that no task has to hold a cell. Of equal points only as many
copies are kept as an answer can name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import distance_function
from ..session import cut

#: Rows of a block, cells at most (their boxes are broadcast), rows of the sample for each cell, and queries of a block.
BLOCK_ROWS, MAX_CELLS, SAMPLE_ROWS, QUERY_ROWS = 2048, 16384, 16, 8192
#: Metrics for which the distance to a box bounds the distance to its rows.
BOUNDED = ("euclidean", "manhattan", "chebyshev", "minkowski")


def distances(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all rows of y; terms are added column by column."""
    each = [(x[:, j, None], y[None, :, j]) for j in range(x.shape[1])]
    add = lambda parts: sum(parts[1:], parts[0])
    if metric == "euclidean":
        return np.sqrt(add([(a - b) * (a - b) for a, b in each]))
    if metric == "minkowski":
        return np.power(add([np.power(np.abs(a - b), 2.0) for a, b in each]), 0.5)
    if metric == "manhattan":
        return add([np.abs(a - b) for a, b in each])
    if metric == "chebyshev":
        return np.maximum.reduce([np.abs(a - b) for a, b in each])
    if metric == "hamming":
        return add([(a != b).astype(float) for a, b in each])
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "canberra":
            return add([np.where((a == 0) & (b == 0), 0.0, np.abs(a - b) / (np.abs(a) + np.abs(b))) for a, b in each])
        if metric == "cosine":
            na, nb = (np.sqrt((v * v).sum(1)) for v in (x, y))
            norm = na[:, None] * nb[None]
            return np.where(norm == 0, 1.0, 1 - add([a * b for a, b in each]) / norm)
    raise ValueError(f"no metric {metric}")


def box_distances(metric: str, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A lower bound of the distance of each row of x from the rows of each box."""
    if metric not in BOUNDED:
        return np.zeros((len(x), len(low)))
    gaps = [np.maximum(0, np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j])) for j in range(x.shape[1])]
    if metric == "manhattan":
        out = sum(gaps[1:], gaps[0])
    elif metric == "chebyshev":
        out = np.maximum.reduce(gaps)
    else:
        out = np.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))
    return out * (1 - 1e-9)


class CellTree:
    """A k-d tree of at most the given number of leaves, cut at medians of the widest column."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
        self.leaves, open_ = 1, [(0, sample)]
        while open_ and self.leaves < leaves:
            at, rows = open_.pop(0)
            spread = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(1)
            j = int(spread.argmax())
            if not spread[j] > 0:
                continue
            values = np.sort(rows[:, j])
            cut_at = values[(len(values) - 1) // 2]
            if cut_at == values[-1]:
                cut_at = values[values < values[-1]][-1]
            left = rows[:, j] <= cut_at
            k = len(self.nodes)
            self.nodes[at] = (j, float(cut_at), k, k + 1)
            self.nodes += [(-1, 0.0, 0, 0), (-1, 0.0, 0, 0)]
            open_ += [(k, rows[left]), (k + 1, rows[~left])]
            self.leaves += 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        column, value, left, right = (np.array(v) for v in zip(*self.nodes, strict=True))
        at = np.zeros(len(x), np.int64)
        while len(who := np.flatnonzero(column[at] >= 0)):
            n = at[who]
            at[who] = np.where(x[who, column[n]] <= value[n], left[n], right[n])
        return at


def k_least(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k least finite entries of each row; ties by id."""
    k = min(k, d.shape[1])
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    r, c = np.nonzero((d <= edge) & np.isfinite(d))
    order = np.lexsort((ids[c], d[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _frame(df: DataFrame, id_col: str, columns: list[str], name: str) -> DataFrame:
    """name, x0, x1 ... of the rows that have an id and all columns."""
    x = df.select(F.col(id_col).alias(name), *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)))
    for c in x.columns[1:]:
        x = x.where(F.col(c).isNotNull() & ~F.isnan(c))
    return x.where(F.col(name).isNotNull())


def _search(metric: str, k: int, names: list[str], skip_self: bool, least: float):
    def run(_, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            y, ids = held[names].to_numpy(), held["id_r"].to_numpy()
            rank = np.unique(ids, return_inverse=True)[1]
            for at in range(0, len(asked), 256):
                own = asked.iloc[at : at + 256]
                d = distances(metric, own[names].to_numpy(), y)
                if skip_self:
                    d[own["id_l"].to_numpy()[:, None] == ids[None]] = np.inf
                if least > 0:
                    d[d < least] = np.inf
                d[np.isnan(d)] = np.inf
                r, c = k_least(d, rank, k)
                out.append(pd.DataFrame({"id_l": own["id_l"].to_numpy()[r], "id_r": ids[c], "distance": d[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"id_l": [], "id_r": [], "distance": []})

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id_l").orderBy("distance", "id_r")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(left: DataFrame, right: DataFrame, columns: list[str], k: int, left_id: str, right_id: str, metric="euclidean", skip_self: bool = False, least: float = 0.0) -> DataFrame:
    """id_l, id_r, distance, place (1 .. k) of the k nearest rows of right for each row of left; ties by id_r. Rows without an id or
    with a missing column neither ask nor answer; answers at a distance below least are passed over. Metrics without a bound
    for boxes, and metrics given as functions, meet all rows, block by block."""
    if callable(metric):
        return _nearest_by_function(left, right, columns, k, left_id, right_id, metric, skip_self, least)
    spark, names = left.sparkSession, [f"x{j}" for j in range(len(columns))]
    asked, held = _frame(left, left_id, columns, "id_l"), _frame(right, right_id, columns, "id_r")
    copies = Window.partitionBy(*names).orderBy("id_r")
    held = cut(held.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + skip_self).drop("copy"))
    n = held.count()
    leaves = min(MAX_CELLS, -(-n // BLOCK_ROWS)) if metric in BOUNDED else 1
    sample = np.zeros((0, len(names)))
    if leaves > 1:
        share = min(1.0, leaves * SAMPLE_ROWS * 4 / n)
        picked = held.where(F.pmod(F.xxhash64("id_r"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select(*names)
        sample = np.array([tuple(r) for r in picked.limit(leaves * SAMPLE_ROWS * 8).collect()], float).reshape(-1, len(names))
    tree = spark.sparkContext.broadcast(CellTree(sample, leaves))
    kinds = {c: t for c, t in held.dtypes + asked.dtypes}
    schema = lambda who: ", ".join([f"{who} {kinds[who]}", *(f"{c} double" for c in names), "cell int"])

    def placed(frames):
        for f in frames:
            yield f.assign(cell=tree.value.cells(f[names].to_numpy(float)).astype(np.int32))

    held = cut(held.mapInPandas(placed, schema("id_r")))
    asked = cut(asked.mapInPandas(placed, schema("id_l")))
    boxes = held.groupBy("cell").agg(F.count("*").alias("n"), *(f(c).alias(f"{a}{c}") for c in names for a, f in (("l", F.min), ("h", F.max)))).collect()  # at most MAX_CELLS rows
    parts = spark.createDataFrame([(b["cell"], -(-b["n"] // BLOCK_ROWS)) for b in boxes] or [(-1, 1)], "cell int, blocks int")
    search = _search(metric, k, names, skip_self, least)
    found_schema = f"id_l {kinds['id_l']}, id_r {kinds['id_r']}, distance double"

    def within(rows: DataFrame) -> DataFrame:
        """Each row against the cell that it is sent to."""
        load = rows.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
        plan = F.broadcast(cut(load.join(F.broadcast(parts), "cell")))
        a = rows.join(plan, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("ask", F.pmod(F.xxhash64("id_l"), F.col("groups")).cast("int"))
        b = held.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("id_r"), F.col("blocks")).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        key = ["cell", "block", "ask"]
        return a.select(*key, "id_l", *names).groupBy(*key).cogroup(b.select(*key, "id_r", *names).groupBy(*key)).applyInPandas(search, found_schema)

    own = _first(within(asked), k)
    if len(boxes) < 2:
        return own
    own = cut(own)
    bound = own.groupBy("id_l").agg(F.count("*").alias("got"), F.max("distance").alias("far"))
    low, high = (np.array([[b[f"{s}{c}"] for c in names] for b in boxes]) for s in "lh")
    numbers = np.array([b["cell"] for b in boxes], np.int32)
    shared = spark.sparkContext.broadcast((low, high, numbers))

    def spread(frames):
        lo, hi, cell = shared.value
        for f in frames:
            x, home = f[names].to_numpy(float), f["cell"].to_numpy()
            far = np.where(f["got"].fillna(0).to_numpy() >= k, f["far"].to_numpy(float), np.inf)
            for at in range(0, len(f), 64):
                here = slice(at, at + 64)
                r, c = np.nonzero((box_distances(metric, x[here], lo, hi) <= far[here, None]) & (cell[None] != home[here, None]))
                if len(r):
                    yield f.iloc[at + r][["id_l", *names]].assign(cell=cell[c])

    others = cut(asked.join(bound, "id_l", "left").mapInPandas(spread, schema("id_l")))
    return _first(own.drop("place").union(within(others)), k)


def _nearest_by_function(left, right, columns, k, left_id, right_id, metric, skip_self, least) -> DataFrame:
    a = left.select(F.col(left_id).alias("id_l"), *(F.col(c).alias(f"l_{c}") for c in columns))
    b = right.select(F.col(right_id).alias("id_r"), *(F.col(c).alias(f"r_{c}") for c in columns))
    blocks = max(1, min(64, -(-right.count() // BLOCK_ROWS)))
    a = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = b.withColumn("block", F.pmod(F.xxhash64("id_r"), F.lit(blocks)).cast("int"))
    d = distance_function(metric)([f"l_{c}" for c in columns], [f"r_{c}" for c in columns])
    met = a.join(b.hint("shuffle_hash"), "block").select("id_l", "id_r", "block", d.alias("distance")).where(F.col("distance").isNotNull() & (F.col("distance") >= least))
    if skip_self:
        met = met.where("id_l != id_r")
    order = Window.partitionBy("id_l", "block").orderBy("distance", "id_r")
    return _first(met.withColumn("own", F.row_number().over(order)).where(F.col("own") <= k).select("id_l", "id_r", "distance"), k)


def distance_matrix(df: DataFrame, columns: list[str], id_col: str, metric: str = "euclidean") -> DataFrame:
    """id_l, id_r, distance of all pairs of rows, each once (id_l < id_r), block by block: the result is quadratic by its nature."""
    names = [f"x{j}" for j in range(len(columns))]
    rows = cut(_frame(df, id_col, columns, "id"))
    kind = dict(rows.dtypes)["id"]
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a, b = dealt.withColumnRenamed("b", "i").withColumn("j", every), dealt.withColumnRenamed("b", "j").withColumn("i", every)

    def run(_, mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(other):
            return pd.DataFrame({"id_l": [], "id_r": [], "distance": []})
        p, q = mine["id"].to_numpy(), other["id"].to_numpy()
        d = distances(metric, mine[names].to_numpy(), other[names].to_numpy())
        r, c = np.nonzero(p[:, None] < q[None])
        return pd.DataFrame({"id_l": p[r], "id_r": q[c], "distance": d[r, c]})

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, f"id_l {kind}, id_r {kind}, distance double")


def distance_sums(df: DataFrame, columns: list[str], label: str, id_col: str, metric: str = "euclidean") -> DataFrame:
    """id, other, total: the sum of the distances of each row from all rows of each label, in blocks of rows against blocks of rows;
    only sums leave a task."""
    names = [f"x{j}" for j in range(len(columns))]
    kinds = dict(df.dtypes)
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True))))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a, b = dealt.withColumnRenamed("b", "i").withColumn("j", every), dealt.withColumnRenamed("b", "j").withColumn("i", every)

    def run(_, mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(other):
            return pd.DataFrame({"id": [], "other": [], "total": []})
        groups, code = np.unique(other["label"].to_numpy(), return_inverse=True)
        member = np.eye(len(groups))[code]
        y, out = other[names].to_numpy(), []
        for at in range(0, len(mine), 512):
            own = mine.iloc[at : at + 512]
            s = distances(metric, own[names].to_numpy(), y) @ member
            out.append(pd.DataFrame({"id": np.repeat(own["id"].to_numpy(), len(groups)), "other": np.tile(groups, len(own)), "total": s.reshape(-1)}))
        return pd.concat(out)

    sums = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, f"id {kinds[id_col]}, other {kinds[label]}, total double")
    return sums.groupBy("id", "other").agg(F.sum("total").alias("total"))


def distance_sums_on_a_line(df: DataFrame, column: str, label: str, id_col: str, labels: list) -> DataFrame:
    """distance_sums() of one column, from running counts and sums of each label in the order of the column."""
    from .kernels import means, running_totals

    middle = means(df, [column])[0]
    rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), (F.col(column).cast("double") - F.lit(middle)).alias("x"))
    is_one = [F.col("label") == F.lit(v) for v in labels]
    sums = {f"n{k}": F.when(one, 1).otherwise(0).cast("long") for k, one in enumerate(is_one)} | {f"s{k}": F.when(one, F.col("x")).otherwise(0.0) for k, one in enumerate(is_one)}
    whole = rows.agg(*(F.sum(v).alias(k) for k, v in sums.items())).first()
    got = running_totals(rows, [F.col("x"), F.col("id")], sums)
    x = F.col("x")
    each = [F.struct(F.lit(v).alias("other"), (x * F.col(f"n{k}") - F.col(f"s{k}") + (F.lit(whole[f"s{k}"]) - F.col(f"s{k}")) - x * (F.lit(whole[f"n{k}"]) - F.col(f"n{k}"))).alias("total")) for k, v in enumerate(labels)]
    return got.select("id", F.explode(F.array(*each)).alias("e")).select("id", "e.other", "e.total")
