"""Decision trees and forests.

All trees of a forest grow together, level by level: rows stay where they are and only look up the node they are in. A level takes one
aggregation by (tree, node, feature, value) and running totals over it, of no task that sees all values of a feature; these
give the gain of every cut between two values. Thresholds are midpoints of neighbouring values; with max_bins, values are first
put into that many quantiles, and thresholds are their edges.

A forest on few columns is grown from rows that are sorted by each column once, in chunks of arrays (_SortedRows): a level then takes two
passes over them that shuffle nothing, one for sums of each chunk and node, one for the best cut given the sums of the chunks before.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import total
from ..session import cut
from .kernels import running_totals
from .metrics import classification_error, entropy, gini


#: Columns up to which a forest's rows are kept sorted by each of them, and rows of a chunk.
SORTED_COLUMNS, CHUNK_ROWS = 4, 1 << 18


def _binned(df: DataFrame, columns: list[str], max_bins: int | None) -> list[Column]:
    """The columns as doubles, or as the least quantile that is not below them."""
    x = [F.col(c).cast("double") for c in columns]
    if max_bins is None:
        return x
    places = F.array(*(F.lit(k / max_bins) for k in range(max_bins + 1)))
    edges = df.agg(*(F.percentile_approx(c, places, F.lit(100 * max_bins)) for c in x)).first()

    def up(c: Column, own: list[float]) -> Column:
        return F.array_min(F.filter(F.array(*(F.lit(float(e)) for e in sorted(set(own)))), lambda e: e >= c))

    return [up(c, own) for c, own in zip(x, edges, strict=True)]


def _compact(t: DecisionTree, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1 in a leaf), threshold and left child of each node, by its place in t.nodes; a right child follows its left one."""
    number = {i: k for k, i in enumerate(t.nodes)}
    inner = [("feature" in d) for d in t.nodes.values()]
    return (
        np.array([columns.index(d["feature"]) if x else -1 for d, x in zip(t.nodes.values(), inner, strict=True)]), np.array([d.get("threshold", 0.0) for d in t.nodes.values()]),
        np.array([number[2 * i] if x else k for k, (i, x) in enumerate(zip(t.nodes, inner, strict=True))]),
    )


def _fall(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of the leaves that the rows of x fall into."""
    at = np.zeros(len(x), np.int64)
    while len(who := np.flatnonzero(feature[at] >= 0)):
        n = at[who]
        at[who] = left[n] + ~(x[who, feature[n]] <= threshold[n])
    return at


class _SortedRows:
    """The rows of a forest sorted by each column, in chunks: their values, classes (or targets) and weights in each tree. Chunks end
    anywhere, also between equal values; whether a cut may follow a chunk's last row shows in the next value of that node."""

    def __init__(self, trees: list[DecisionTree], df: DataFrame, columns: list[str], y: str, draws: Column, weigh) -> None:
        one, p, count = trees[0], len(columns), len(trees)
        self.trees, self.columns, self.classes = trees, columns, len(one.classes) if one.task == "classification" else 0
        classes = self.classes
        target = F.coalesce(*(F.when(F.col(y) == F.lit(c), F.lit(float(k))) for k, c in enumerate(one.classes))) if classes else F.col(y).cast("double")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

        def packed(f: int) -> DataFrame:
            def pack(batches):
                held, number = [], 0

                def flush():
                    x, t, w, part = (np.concatenate(v) for v in zip(*held, strict=True))
                    w = weigh(w)
                    small = w.astype(np.uint8)
                    data = pickle.dumps((x, t.astype(np.int16) if classes else t, small if (small == w).all() else w), 5)
                    return pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([(int(part[0]) << 32) + number], pa.int64()), pa.array([data], pa.binary())], ["f", "chunk", "rows"])

                for b in batches:
                    if n := b.num_rows:
                        flat = [b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("x", "w")]
                        held.append((flat[0], b.column("t").to_numpy(zero_copy_only=False), flat[1], b.column("part").to_numpy(zero_copy_only=False)))
                        if sum(len(h[1]) for h in held) >= CHUNK_ROWS:
                            yield flush()
                            held, number = [], number + 1
                if held:
                    yield flush()

            order = ["__x", "__m"]
            dealt = df.withColumn("__x", F.col(columns[f]).cast("double")).withColumn("__m", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
            x = F.array(*(F.col(c).cast("double") for c in columns))
            return dealt.select(x.alias("x"), target.alias("t"), draws.cast("array<double>").alias("w"), F.spark_partition_id().alias("part")).where("t is not null").mapInArrow(pack, "f int, chunk long, rows binary")

        self.chunks = cut(reduce(DataFrame.union, [packed(f) for f in range(p)]))
        self.count = count

    def _each(self, asked: list[tuple[int, int, int]], work, schema: str, offsets: dict | None = None) -> list:
        """Rows of work(f, chunk, tree, node, values of the column, classes or targets, weights, offsets) for each asked (tree, node, column) and
        chunk with rows of that node."""
        slots: dict = {}
        for k, i, f in asked:
            slots.setdefault(f, {}).setdefault(k, []).append(i)
        place = {k: {i: n for n, i in enumerate(self.trees[k].nodes)} for k, _, _ in asked}
        shared = self.chunks.sparkSession.sparkContext.broadcast(({k: _compact(self.trees[k], self.columns) for k in place}, slots, place, offsets or {}))
        names = [c.split()[0] for c in schema.split(", ")]

        def run(frames):
            tables, slots, place, offsets = shared.value
            for frame in frames:
                out = []
                for f, chunk, data in zip(frame["f"], frame["chunk"], frame["rows"], strict=True):
                    if f not in slots:
                        continue
                    x, t, w = pickle.loads(data)
                    for k, nodes in slots[f].items():
                        who = np.flatnonzero(w[:, k])
                        at = _fall(x[who], *tables[k])
                        for i in nodes:
                            own = who[at == place[k][i]]
                            if len(own):
                                out += work(f, chunk, k, i, x[own, f], t[own], w[own, k].astype(float), offsets.get((f, chunk, k, i)))
                yield pd.DataFrame(out, columns=names)

        got = self.chunks.mapInPandas(run, schema).collect()
        shared.destroy()
        return got

    def roots(self) -> dict[int, list[float]]:
        got, classes = {}, self.classes
        for t in self.trees:
            t.nodes = {1: {"stats": []}}
        for r in self._each([(k, 1, 0) for k in range(self.count)], lambda f, chunk, k, i, v, t, w, _: [(k, _sums(t, w, classes).tolist())], "tree int, s array<double>"):
            got[r["tree"]] = got.get(r["tree"], 0.0) + np.array(r["s"])
        return {k: v.tolist() for k, v in got.items()}

    def best(self, plan: list[tuple]) -> list[tuple]:
        """(tree, node, column, value, next value, sums to the left, gain) of the best cut of each open node that has one."""
        asked, one, classes = [(k, i, f) for k, i, f, *_ in plan], self.trees[0], self.classes
        ends = self._each(asked, lambda f, chunk, k, i, v, t, w, _: [(f, chunk, k, i, _sums(t, w, classes).tolist(), float(v[0]))], "f int, chunk long, tree int, node long, s array<double>, first double")
        by: dict = {}
        for r in ends:
            by.setdefault((r["f"], r["tree"], r["node"]), []).append(r)
        whole, offsets = {(k, i): np.array(self.trees[k].nodes[i]["stats"]) for k, i, _ in asked}, {}
        for (f, k, i), rows in by.items():
            rows.sort(key=lambda r: r["chunk"])
            acc = np.zeros(len(whole[k, i]))
            for r, after in zip(rows, [*rows[1:], None], strict=True):
                offsets[f, r["chunk"], k, i] = (acc, whole[k, i], after["first"] if after else math.nan)
                acc = acc + np.array(r["s"])

        def cuts(f, chunk, k, i, v, t, w, given):
            before, whole, after = given
            upto = np.append(v[1:], after)
            at = np.flatnonzero(v < upto)
            if not len(at):
                return []
            own = [np.where(t == c, w, 0.0) for c in range(classes)] if classes else [w, w * t, w * t * t]
            left = np.stack([np.cumsum(s)[at] for s in own], 1) + before
            right = whole - left
            n, nl, nr = (one._sizes(s) for s in (whole[None], left, right))
            gain = np.round(one._impurities(whole[None]) - nl / n * one._impurities(left) - nr / n * one._impurities(right), 12)
            fit = np.flatnonzero((nl >= one.min_samples_leaf) & (nr >= one.min_samples_leaf) & (nr > 1e-9) & (gain >= one.min_gain))
            if not len(fit):
                return []
            j = fit[gain[fit].argmax()]  # the first of equal ones
            return [(k, i, f, float(v[at[j]]), float(upto[at[j]]), left[j].tolist(), float(gain[j]))]

        best: dict = {}
        for r in self._each(asked, cuts, "tree int, node long, f int, v double, next double, left array<double>, gain double", offsets):
            key = (r["tree"], r["node"])
            if key not in best or (r["gain"], -r["f"], -r["v"]) > (best[key]["gain"], -best[key]["f"], -best[key]["v"]):
                best[key] = r
        return [tuple(best[key]) for key in sorted(best)]


def _sums(t: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    return np.bincount(t, w, classes) if classes else np.array([w.sum(), w @ t, w @ (t * t)])


def grow(trees: list[DecisionTree], df: DataFrame, columns: list[str], y: str, weights: Column, max_bins: int | None, draws: tuple | None = None) -> None:
    """Grows trees of one kind on the rows of df; weights is an array with a row's weight in each tree, and rows of no weight take no part.
    draws may name a shorter array, and a function from rows of these to rows of weights."""
    spark, one = df.sparkSession, trees[0]
    rng = [np.random.default_rng(t.seed) for t in trees]
    width = len(one.classes) if one.task == "classification" else 3
    held = _SortedRows(trees, df, columns, y, *(draws or (weights, np.asarray))) if len(trees) > 1 and len(columns) <= SORTED_COLUMNS and max_bins is None else None
    target = F.col(y).cast("double")
    own = [F.when(F.col(y) == F.lit(c), 1.0).otherwise(0.0) for c in one.classes] if one.task == "classification" else [F.lit(1.0), target, target * target]
    rows = df.select(F.array(*_binned(df, columns, max_bins)).alias("x"), F.array(*own).alias("s"), F.posexplode(weights).alias("tree", "w")).where("w > 0")
    at = rows.select("tree", F.lit(1).cast("long").alias("node"), "x", F.transform("s", lambda v: v * F.col("w")).alias("s"))
    roots = held.roots() if held else {r["tree"]: [r[f"s{k}"] for k in range(width)] for r in at.groupBy("tree").agg(*(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width))).collect()}
    for k, t in enumerate(trees):
        t.columns, t.nodes = columns, {1: {"stats": [float(v) for v in roots.get(k, [0.0] * width)]}}
    level = [(k, 1) for k in range(len(trees))]
    names, left = [f"s{k}" for k in range(width)], [f"l{k}" for k in range(width)]
    for _ in range(one.max_depth):
        plan, offset = [], np.zeros(width)
        for k, i in sorted(level):
            whole = np.array(trees[k].nodes[i]["stats"])
            if one._size(whole) < one.min_samples_split or one._impurity(whole) <= 0:
                continue
            chosen = range(len(columns)) if not one.max_features else sorted(rng[k].choice(len(columns), min(one.max_features, len(columns)), replace=False).tolist())
            for f in chosen:
                plan.append((k, i, f, offset.tolist(), whole.tolist()))
                offset = offset + whole
        if not plan:
            return
        if held:
            level = []
            for k, i, f, v, after, below, gain in held.best(plan):
                _split(trees[k], i, columns[f], (v + after) / 2, below, gain)
                level += [(k, 2 * i), (k, 2 * i + 1)]
            if not level:
                return
            continue
        asked = spark.createDataFrame(plan, "tree int, node long, f int, before array<double>, whole array<double>")  # a row for each open node and feature
        spread = at.join(F.broadcast(asked.select("tree", "node", "f")), ["tree", "node"])
        sums = cut(spread.groupBy("tree", "node", "f", F.col("x")[F.col("f")].alias("v")).agg(*(F.sum(F.col("s")[k]).alias(n) for k, n in enumerate(names))))
        order = [F.col(c) for c in ("tree", "node", "f", "v")]
        upto = running_totals(sums, order, {n: s for n, s in zip(left, names, strict=True)}).join(F.broadcast(asked), ["tree", "node", "f"])
        before, rest = [F.col(n) - F.col("before")[k] for k, n in enumerate(left)], [F.col("whole")[k] + F.col("before")[k] - F.col(n) for k, n in enumerate(left)]
        whole = [F.col("whole")[k] for k in range(width)]
        n, nl, nr = (one._size_column(p) for p in (whole, before, rest))
        gain = F.round(one._impurity_column(whole) - nl / n * one._impurity_column(before) - nr / n * one._impurity_column(rest), 12)
        fit = upto.where((nl >= one.min_samples_leaf) & (nr >= one.min_samples_leaf) & (nr > 1e-9)).select("tree", "node", "f", "v", F.array(*before).alias("left"), gain.alias("gain")).where(F.col("gain") >= one.min_gain)
        best = fit.groupBy("tree", "node").agg(F.max_by(F.struct("f", "v", "left", "gain"), F.struct("gain", -F.col("f"), -F.col("v"))).alias("b")).select("tree", "node", "b.*")
        best = cut(best)  # a row for each open node
        after = sums.join(F.broadcast(best.select("tree", "node", "f", F.col("v").alias("at"))), ["tree", "node", "f"]).where("v > at").groupBy("tree", "node").agg(F.min("v").alias("next"))
        splits, level = [], []
        for r in best.join(after, ["tree", "node"]).collect():
            k, i, t = r["tree"], r["node"], trees[r["tree"]]
            threshold = (r["v"] + r["next"]) / 2 if max_bins is None else r["v"]
            _split(t, i, columns[r["f"]], threshold, r["left"], r["gain"])
            level += [(k, 2 * i), (k, 2 * i + 1)]
            splits.append((k, i, r["f"], threshold))
        if not splits:
            return
        goes = spark.createDataFrame(splits, "tree int, node long, f int, threshold double")
        at = at.join(F.broadcast(goes), ["tree", "node"]).select("tree", (F.col("node") * 2 + F.when(F.col("x")[F.col("f")] <= F.col("threshold"), 0).otherwise(1)).alias("node"), "x", "s")


def _split(t: DecisionTree, i: int, feature: str, threshold: float, left: list[float], gain: float) -> None:
    stats = np.array(t.nodes[i]["stats"])
    t.nodes[i] |= {"feature": feature, "threshold": threshold, "gain": gain}
    t.nodes[2 * i], t.nodes[2 * i + 1] = {"stats": list(left)}, {"stats": (stats - np.array(left)).tolist()}


@dataclass
class DecisionTree:
    """CART for classes (gini, entropy, classification_error) or numbers (mse); `<=` goes left; of equal gains the first feature and threshold."""

    task: str = "classification"
    criterion: str = "gini"
    max_depth: int = 10
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_gain: float = 1e-7
    max_bins: int | None = None
    max_features: int | None = None
    seed: int = 0
    columns: list[str] = field(default_factory=list)
    classes: list = field(default_factory=list)
    nodes: dict[int, dict] = field(default_factory=dict)

    def _size_column(self, s: list[Column]) -> Column:
        return s[0] if self.task == "regression" else total(s)

    def _impurity_column(self, s: list[Column]) -> Column:
        n = self._size_column(s)
        if self.task == "regression":
            return F.greatest(F.lit(0.0), F.try_divide(s[2], n) - F.try_divide(s[1], n) * F.try_divide(s[1], n))
        shares = [F.greatest(F.lit(0.0), F.try_divide(v, n)) for v in s]
        if self.criterion == "gini":
            return 1 - total([p * p for p in shares])
        if self.criterion == "entropy":
            return -total([F.when(p > 0, p * F.log2(p)).otherwise(0.0) for p in shares])
        return 1 - (F.greatest(*shares) if len(shares) > 1 else shares[0])

    def _impurity(self, s: np.ndarray) -> float:
        n = self._size(s)
        if n <= 0:
            return 0.0
        if self.task == "regression":
            return max(0.0, s[2] / n - (s[1] / n) ** 2)
        shares = [v / n for v in s]
        return {"gini": gini, "entropy": entropy, "classification_error": classification_error}[self.criterion](shares)

    def _size(self, s: np.ndarray) -> float:
        return float(s[0] if self.task == "regression" else s.sum())

    def _sizes(self, s: np.ndarray) -> np.ndarray:
        return s[:, 0] if self.task == "regression" else s.sum(1)

    def _impurities(self, s: np.ndarray) -> np.ndarray:
        """As _impurity_column, of rows of sums; those of no size are not asked for."""
        n = np.maximum(self._sizes(s), 1e-300)
        if self.task == "regression":
            return np.maximum(0.0, s[:, 2] / n - (s[:, 1] / n) ** 2)
        p = np.maximum(0.0, s / n[:, None])
        if self.criterion == "gini":
            return 1 - (p * p).sum(1)
        if self.criterion == "entropy":
            return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(1)
        return 1 - p.max(1)

    def fit(self, df: DataFrame, columns: list[str], y: str, weight: str | None = None, classes: list | None = None) -> DecisionTree:
        rows = df.dropna(subset=[*columns, y])
        if self.task == "classification":
            self.classes = classes or [r[0] for r in rows.select(y).distinct().orderBy(y).collect()]
        grow([self], rows, columns, y, F.array(F.col(weight).cast("double") if weight else F.lit(1.0)), self.max_bins)
        return self

    def _route(self, goes_left, i: int = 1) -> Column:
        d = self.nodes[i]
        if "feature" not in d:
            return F.lit(i)
        return F.when(goes_left(d), self._route(goes_left, 2 * i)).otherwise(self._route(goes_left, 2 * i + 1))

    def leaf(self) -> Column:
        return self._route(lambda d: F.col(d["feature"]).cast("double") <= F.lit(d["threshold"]))

    def apply(self, df: DataFrame, output: str = "leaf") -> DataFrame:
        return df.withColumn(output, self.leaf())

    def decision_path(self, df: DataFrame, output: str = "path") -> DataFrame:
        leaf = self.leaf()
        deep = max(i.bit_length() for i in self.nodes)
        steps = F.transform(F.sequence(F.lit(deep - 1), F.lit(0), F.lit(-1)), lambda k: F.floor(leaf / F.pow(F.lit(2.0), k)).cast("int"))
        return df.withColumn(output, F.filter(steps, lambda v: v > 0))

    def _value(self, i: int) -> list[float] | float:
        s = self.nodes[i]["stats"]
        return s[1] / s[0] if self.task == "regression" else [v / (sum(s) or 1.0) for v in s]

    def _map(self, value) -> Column:
        leaves = [i for i, d in self.nodes.items() if "feature" not in d]
        return F.create_map(*(F.lit(x) if not isinstance(x, Column) else x for i in leaves for x in (i, value(i))))[self.leaf()]

    def shares(self) -> list[Column]:
        arrays = self._map(lambda i: F.array(*(F.lit(float(v)) for v in self._value(i))))
        return [arrays[k] for k in range(len(self.classes))]

    def prediction(self) -> Column:
        if self.task == "regression":
            return self._map(lambda i: float(self._value(i)))
        return self._map(lambda i: self.classes[int(np.argmax(self._value(i)))])

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.prediction())

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"p_{c}": s for c, s in zip(self.classes, self.shares(), strict=True)})

    def export_text(self, i: int = 1, depth: int = 0) -> str:
        d = self.nodes[i]
        pad = "|   " * depth
        if "feature" not in d:
            return f"{pad}value {self._value(i)}\n"
        return f"{pad}{d['feature']} <= {d['threshold']:.6g}\n{self.export_text(2 * i, depth + 1)}{pad}{d['feature']} > {d['threshold']:.6g}\n{self.export_text(2 * i + 1, depth + 1)}"

    def export_dot(self) -> str:
        lines = ["digraph tree {"]
        for i, d in self.nodes.items():
            lines.append(f'  n{i} [label="{d["feature"]} <= {d["threshold"]:.6g}"];' if "feature" in d else f'  n{i} [label="{self._value(i)}"];')
            if "feature" in d:
                lines += [f"  n{i} -> n{2 * i};", f"  n{i} -> n{2 * i + 1};"]
        return "\n".join([*lines, "}"])

    def split_counts(self) -> dict[str, int]:
        return {c: sum(d.get("feature") == c for d in self.nodes.values()) for c in self.columns}


@dataclass
class RandomForest:
    """Trees on Poisson-weighted rows (a bootstrap that needs no resampled table), with feature bagging by node."""

    task: str = "classification"
    n_estimators: int = 50
    max_depth: int = 6
    max_features: int | None = None
    class_weight: str | None = None
    warm_start: bool = False
    oob: bool = False
    seed: int = 0
    max_bins: int | None = None
    trees: list[DecisionTree] = field(default_factory=list)
    oob_score: float | None = None

    def _weight(self, k: int | Column, id_col: str) -> Column:
        """Poisson(1) counts from a hash of the id: number of Poisson quantiles below a uniform number."""
        u = self._uniform(k, id_col)
        return total([F.when(u > F.lit(acc), 1.0).otherwise(0.0) for acc in self._quantiles()])

    def _uniform(self, k: int | Column, id_col: str) -> Column:
        return (F.pmod(F.xxhash64(F.lit(self.seed), k if isinstance(k, Column) else F.lit(k), id_col), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))

    @staticmethod
    def _quantiles() -> list[float]:
        steps, p, acc = [], math.exp(-1), 0.0
        for j in range(1, 9):
            acc += p
            steps.append(acc)
            p /= j
        return steps

    def fit(self, df: DataFrame, columns: list[str], y: str, id_col: str) -> RandomForest:
        rows = df.select(*dict.fromkeys([id_col, *columns, y])).dropna(subset=[*columns, y]).persist()
        classes = [r[0] for r in rows.select(y).distinct().orderBy(y).collect()] if self.task == "classification" else None
        balance = F.lit(1.0)
        if self.class_weight == "balanced":
            n = {r[y]: r["count"] for r in rows.groupBy(y).count().collect()}
            balance = F.create_map(*(F.lit(x) for c, v in n.items() for x in (c, sum(n.values()) / (len(n) * v))))[F.col(y)]
        p = len(columns)
        features = self.max_features or max(1, int(math.sqrt(p)) if self.task == "classification" else p // 3)
        if not self.warm_start:
            self.trees = []
        new = range(len(self.trees), self.n_estimators)
        made = [DecisionTree(self.task, "gini", self.max_depth, max_features=features, seed=self.seed * 1000 + k, classes=classes or []) for k in new]
        if made:
            steps = self._quantiles()
            draws = F.array(*(self._uniform(k, id_col) for k in new), balance), lambda u: np.searchsorted(steps, u[:, :-1]) * u[:, -1:]
            grow(made, rows, columns, y, F.transform(F.array(*(F.lit(k) for k in new)), lambda k: self._weight(k, id_col) * balance), self.max_bins, draws)
        self.trees += made
        if self.oob:
            self.oob_score = self._oob(rows, y, id_col)
        rows.unpersist()
        return self

    def _oob(self, rows: DataFrame, y: str, id_col: str) -> float:
        out = [self._weight(k, id_col) == 0 for k in range(len(self.trees))]
        n = total([F.when(o, 1.0).otherwise(0.0) for o in out])
        if self.task == "regression":
            from .metrics import r2

            p = total([F.when(o, t.prediction()).otherwise(0.0) for o, t in zip(out, self.trees, strict=True)]) / n
            return rows.where(n > 0).withColumn("__p", p).agg(r2(y, "__p")).first()[0]
        votes = [total([F.when(o & (t.prediction() == F.lit(c)), 1.0).otherwise(0.0) for o, t in zip(out, self.trees, strict=True)]) for c in self.trees[0].classes]
        return rows.where(n > 0).withColumn("__p", _winner(votes, self.trees[0].classes)).agg(F.avg(F.when(F.col("__p") == F.col(y), 1.0).otherwise(0.0))).first()[0]

    def _each(self, df: DataFrame, of_leaf, kind: str) -> Column:
        """Mean over the trees of what of_leaf(tree, node) gives (an array of numbers), in Arrow batches: the trees are broadcast, as
        an expression of all of them would be beyond what can be compiled."""
        columns, tables = self.trees[0].columns, []
        for t in self.trees:
            tables.append((*_compact(t, columns), np.array([of_leaf(t, i) for i in t.nodes], float)))
        shared = df.sparkSession.sparkContext.broadcast(tables)

        @F.pandas_udf(kind)
        def mean(*series: pd.Series) -> pd.Series:
            x, out = np.stack([v.to_numpy(float) for v in series], 1), 0.0
            for *table, value in shared.value:
                out = out + value[_fall(x, *table)]
            return pd.Series(list(out / len(shared.value)))

        return mean(*(F.col(c).cast("double") for c in columns))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        if self.task == "regression":
            return df.withColumn(output, self._each(df, lambda t, i: t._value(i), "double"))
        votes = self._each(df, lambda t, i: np.eye(len(t.classes))[int(np.argmax(t._value(i)))], "array<double>")
        classes = self.trees[0].classes
        held = df.withColumn("__votes", votes)
        return held.withColumn(output, _winner([F.col("__votes")[k] for k in range(len(classes))], classes)).drop("__votes")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        classes = self.trees[0].classes
        held = df.withColumn("__shares", self._each(df, lambda t, i: t._value(i), "array<double>"))
        return held.withColumns({f"p_{c}": F.col("__shares")[k] for k, c in enumerate(classes)}).drop("__shares")

    def feature_importances(self) -> dict[str, float]:
        """Shares of the numbers of splits."""
        counts = [t.split_counts() for t in self.trees]
        n = {c: sum(k[c] for k in counts) for c in self.trees[0].columns}
        whole = sum(n.values()) or 1
        return {c: v / whole for c, v in n.items()}


def _winner(votes: list[Column], classes: list) -> Column:
    best = F.array_max(F.array(*(F.struct(v.alias("v"), F.lit(-k).alias("k")) for k, v in enumerate(votes))))
    return F.array(*(F.lit(c) for c in classes))[-best["k"]]
