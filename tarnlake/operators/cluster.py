"""Clustering: k-means, silhouettes, DBSCAN, hierarchical and consensus clustering."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import total
from ..session import cut
from .kernels import components, near_pairs, positions, previous, running_totals
from .neighbours import BLOCK_ROWS, distance_sums, distance_sums_on_a_line, distances, nearest
from .splits import sample_rows


def _nearest_center(columns: list[str], centers: list[list[float]]) -> Column:
    """(squared distance, number) of the nearest centre; ties go to the lowest number."""
    return F.array_min(F.array(*(F.struct(total([(F.col(c) - F.lit(float(m))) ** 2 for c, m in zip(columns, center, strict=True)]).alias("d"), F.lit(k).alias("k")) for k, center in enumerate(centers))))


@dataclass
class KMeans:
    """Lloyd's steps, one aggregation each; an empty cluster keeps its centre. Start: given centres, or k-means++ on a bounded sample."""

    k: int = 3
    max_iter: int = 300
    tol: float = 1e-4
    seed: int = 0
    sample: int = 4096
    columns: list[str] = field(default_factory=list)
    centroids: list[list[float]] = field(default_factory=list)
    inertia: float = math.nan
    iterations: int = 0

    def _start(self, df: DataFrame, id_col: str) -> list[list[float]]:
        rows = sample_rows(df.select(id_col, *self.columns), id_col, self.sample, self.seed).select(*self.columns).collect()
        x, rng = np.array([tuple(map(float, r)) for r in rows]), np.random.default_rng(self.seed)
        picked = [x[rng.integers(len(x))]]
        while len(picked) < min(self.k, len(x)):
            d = np.min([((x - p) ** 2).sum(1) for p in picked], 0)
            picked.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
        return [p.tolist() for p in picked]

    def fit(self, df: DataFrame, columns: list[str], id_col: str, initial: list[list[float]] | None = None) -> KMeans:
        self.columns = columns
        rows = df.select(id_col, *(F.col(c).cast("double").alias(c) for c in columns)).dropna().persist()
        self.centroids, old = initial or self._start(rows, id_col), math.inf
        for self.iterations in range(1, self.max_iter + 1):
            near = rows.withColumn("__n", _nearest_center(columns, self.centroids))
            got = near.groupBy("__n.k").agg(F.sum("__n.d").alias("d"), *(F.avg(c).alias(c) for c in columns)).collect()
            self.inertia = sum(r["d"] for r in got)
            if abs(old - self.inertia) < self.tol:
                break
            moved = [list(c) for c in self.centroids]
            for r in got:
                moved[r["k"]] = [r[c] for c in columns]
            self.centroids, old = moved, self.inertia
        rows.unpersist()
        return self

    def predict(self, df: DataFrame, output: str = "cluster") -> DataFrame:
        return df.withColumn(output, _nearest_center(self.columns, self.centroids)["k"])

    def silhouette(self, df: DataFrame, id_col: str) -> float:
        return silhouette_score(self.predict(df), self.columns, "cluster", id_col)

    def summary(self) -> str:
        return f"k-means: k = {self.k}, inertia {self.inertia:.6g}, {self.iterations} steps"


#: Labels up to which sums on a line are found from running totals, two for each label.
LINE_LABELS = 64


def silhouette_samples(df: DataFrame, columns: list[str], label: str, id_col: str) -> DataFrame:
    """id, label, a, b, s of each row, from the sums of its distances from each cluster: by running totals if there is one column
    and more rows than one block has, else block by block. A cluster of one row has s = 0."""
    sizes = df.groupBy(F.col(label).alias("other")).agg(F.count("*").alias("n"))
    few = [r[0] for r in sizes.select("other").orderBy("other").limit(LINE_LABELS + 1).collect()]
    if len(columns) == 1 and len(few) <= LINE_LABELS and sizes.agg(F.sum("n")).first()[0] > BLOCK_ROWS:
        sums = distance_sums_on_a_line(df, columns[0], label, id_col, few)
    else:
        sums = distance_sums(df, columns, label, id_col)
    own = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    mine = F.col("other") == F.col("label")
    mean = F.try_divide(F.col("total"), F.when(mine, F.col("n") - 1).otherwise(F.col("n")))
    met = sums.join(F.broadcast(sizes) if len(few) <= LINE_LABELS else sizes, "other").join(own, "id")
    both = met.groupBy("id", "label").agg(F.coalesce(F.max(F.when(mine, mean)), F.lit(0.0)).alias("a"), F.coalesce(F.min(F.when(~mine, mean)), F.lit(0.0)).alias("b"))
    return both.select("id", "label", "a", "b", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("s"))


def silhouette_score(df: DataFrame, columns: list[str], label: str, id_col: str) -> float:
    return silhouette_samples(df, columns, label, id_col).agg(F.avg("s")).first()[0]


def silhouette_by_cluster(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.avg("s").alias("average"), F.count("*").alias("n")).orderBy(F.desc("average"))


@dataclass
class DBSCAN:
    """Clusters from 1, noise -1. Core points have min_samples rows (themselves too) within eps; clusters are numbered by their
    smallest core id; a border point goes to the lowest cluster in reach."""

    eps: float = 0.5
    min_samples: int = 5
    columns: list[str] = field(default_factory=list)
    id_col: str = "row_id"
    core: DataFrame | None = None

    def fit_predict(self, df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
        """df with cluster. Up to three columns are gridded so finely that rows of one cell are neighbours: a cell of min_samples rows
        is core as a whole and one node of the graph, so only rows of thin cells are held against others row by row. With more columns
        all pairs within eps are formed. Rows with a missing value are noise."""
        self.columns, self.id_col, self.rounds = columns, id_col, []
        rows = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)))
        near, core, edges = self._grid(rows) if len(columns) <= 3 else self._pairs(rows)
        label = components(edges.union(core.select(F.col("node").alias("u"), F.col("node").alias("v")).distinct()), rounds=self.rounds)
        roots = label.select("component").distinct()
        number = positions(roots, [F.col("component")], "cluster").withColumn("cluster", F.col("cluster").cast("int"))
        cores = cut(core.join(label.join(number, "component").select("node", "cluster"), "node").select("id", "cluster"))
        reached = near.join(cores.withColumnRenamed("id", "id_r"), "id_r").groupBy(F.col("id_l").alias("id")).agg(F.min("cluster").alias("reach"))
        self.core = df.select(id_col, *columns).join(cores.withColumnRenamed("id", "__i"), F.col(id_col) == F.col("__i")).drop("__i")
        every = rows.select("id").join(cores, "id", "left").join(reached, "id", "left").select(F.col("id").alias("__id"), F.coalesce("cluster", "reach").alias("__c"))
        return df.join(every, F.col(id_col) == F.col("__id"), "left").withColumn("cluster", F.coalesce("__c", F.lit(-1))).drop("__id", "__c")

    def _pairs(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pairs within eps, core rows with their node (themselves), and edges between nodes."""
        near = cut(near_pairs(rows, rows, rows.columns[1:], self.eps, "id", "id"))
        core = cut(near.groupBy(F.col("id_l").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= self.min_samples).select("id", F.col("id").alias("node")))
        linked = near.join(core.select(F.col("id").alias("id_l")), "id_l").join(core.select(F.col("id").alias("id_r")), "id_r")
        return near, core, linked.select(F.col("id_l").alias("u"), F.col("id_r").alias("v"))

    def _grid(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """As _pairs(); near has pairs of rows of thin cells with rows of any cell, and a cell of core rows is one node."""
        x = rows.columns[1:]
        d, side = len(x), self.eps / math.sqrt(len(x)) * (1 - 1e-9) or 1.0
        reach = range(-2, 3)  # eps is less than two sides
        keys = [f"g{j}" for j in range(d)]
        gridded = rows.where(F.lit(True) if not x else ~F.isnan(total([F.col(c) for c in x]))).withColumns({g: F.floor(F.col(c) / F.lit(side)) for g, c in zip(keys, x, strict=True)})
        cells = gridded.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("rep"), *(f(c).alias(f"{a}{c}") for c in x for a, f in (("l", F.min), ("h", F.max))))
        cells = cut(cells.where(F.col(keys[0]).isNotNull()))
        placed = cut(gridded.join(cells.select(*keys, "n", "rep"), keys))
        around = lambda df: self._around(df, keys, reach)
        thin = around(placed.where(F.col("n") < self.min_samples).select(F.col("id").alias("id_l"), *(F.col(c).alias(f"a{c}") for c in x), *keys))
        gap = F.sqrt(total([(F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in x]))
        near = cut(thin.join(placed, keys).where(gap <= F.lit(float(self.eps))).select("id_l", F.col("id").alias("id_r")))
        busy = near.groupBy(F.col("id_l").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= self.min_samples).select("id", F.col("id").alias("node"))
        core = cut(placed.where(F.col("n") >= self.min_samples).select("id", F.col("rep").alias("node")).union(busy))
        ends = near.join(core.select(F.col("id").alias("id_l"), F.col("node").alias("u")), "id_l").join(core.select(F.col("id").alias("id_r"), F.col("node").alias("v")), "id_r").select("u", "v")
        return near, core, ends.union(self._dense_edges(placed, cells.where(F.col("n") >= self.min_samples), keys, x, around))

    @staticmethod
    def _around(df: DataFrame, keys: list[str], reach: range) -> DataFrame:
        """df once for each neighbouring cell, whose keys replace its own."""
        for g in keys:
            df = df.withColumn(g, F.explode(F.array(*(F.col(g) + F.lit(k) for k in reach))))
        return df

    def _dense_edges(self, placed: DataFrame, dense: DataFrame, keys: list[str], x: list[str], around) -> DataFrame:
        """Edges between core cells that hold two rows within eps of each other. Boxes decide where they can."""
        eps = F.lit(float(self.eps))
        sides = ["rep", "n", *(f"{a}{c}" for c in x for a in "lh")]
        met = around(dense.select(*(F.col(c).alias(f"a_{c}") for c in sides), *keys)).join(dense.select(*sides, *keys), keys).where("a_rep < rep")
        gaps = [F.greatest(F.lit(0.0), F.col(f"l{c}") - F.col(f"a_h{c}"), F.col(f"a_l{c}") - F.col(f"h{c}")) for c in x]
        width = [F.greatest(F.col(f"h{c}") - F.col(f"a_l{c}"), F.col(f"a_h{c}") - F.col(f"l{c}")) for c in x]
        norm = lambda parts: F.sqrt(total([p * p for p in parts]))
        met = met.withColumn("gap", norm(gaps)).withColumn("width", norm(width)).where(F.col("gap") <= eps)
        if len(x) == 1:  # two cells' nearest rows are their ends
            return met.select(F.col("a_rep").alias("u"), F.col("rep").alias("v"))
        met = cut(met.select("a_rep", "a_n", "rep", "n", "width"))
        sure = met.where(F.col("width") <= eps).select(F.col("a_rep").alias("u"), F.col("rep").alias("v"))
        open_ = met.where(F.col("width") > eps).withColumn("bi", F.explode(F.sequence(F.lit(0), F.floor(F.col("a_n") / BLOCK_ROWS).cast("int")))).withColumn("bj", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / BLOCK_ROWS).cast("int"))))
        block = F.pmod(F.xxhash64("id"), F.floor(F.col("n") / BLOCK_ROWS).cast("int") + 1).cast("int")
        dealt = placed.where(F.col("n") >= self.min_samples).select("id", "rep", *x, block.alias("b"))
        pairs = open_.select(F.col("a_rep").alias("u"), F.col("rep").alias("v"), "bi", "bj")
        left = pairs.join(dealt.select(F.col("rep").alias("u"), F.col("b").alias("bi"), *x), ["u", "bi"])
        right = pairs.join(dealt.select(F.col("rep").alias("v"), F.col("b").alias("bj"), *x), ["v", "bj"])
        right = right.select(*(F.col(c).alias(f"r_{c}") for c in ["u", "v", "bi", "bj", *x]))
        kind, limit, key = dict(placed.dtypes)["rep"], float(self.eps), ["u", "v", "bi", "bj"]

        def touch(_, a, b):
            hit = len(a) and len(b) and any((distances("euclidean", a[x].to_numpy()[k : k + 512], b[[f"r_{c}" for c in x]].to_numpy()) <= limit).any() for k in range(0, len(a), 512))
            return (a if hit else a.iloc[:0])[["u", "v"]].head(1)

        touched = left.select(*key, *x).groupBy(*key).cogroup(right.groupBy(*(f"r_{c}" for c in key))).applyInPandas(touch, f"u {kind}, v {kind}")
        return sure.union(touched)

    def predict(self, df: DataFrame) -> DataFrame:
        """Cluster of the nearest core point within eps, else -1."""
        first = nearest(df, self.core, self.columns, 1, self.id_col, self.id_col).where(F.col("distance") <= F.lit(float(self.eps)))
        hit = first.join(self.core.select(F.col(self.id_col).alias("id_r"), "cluster"), "id_r").select(F.col("id_l").alias("__id"), F.col("cluster").alias("__c"))
        return df.drop("cluster").join(hit, F.col(self.id_col) == F.col("__id"), "left").withColumn("cluster", F.coalesce("__c", F.lit(-1))).drop("__id", "__c")


@dataclass
class HCA:
    """Agglomeration on the driver, of at most max_rows rows: the algorithm holds all distances. Ward's height is the growth of the sum of squares."""

    linkage: str = "average"
    max_rows: int = 5000
    ids: list = field(default_factory=list)
    merges: list[tuple[int, int, float, int]] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str], id_col: str) -> HCA:
        rows = df.select(id_col, *columns).orderBy(id_col).limit(self.max_rows + 1).collect()
        if len(rows) > self.max_rows:
            raise ValueError(f"hierarchical clustering takes at most {self.max_rows} rows")
        self.ids = [r[0] for r in rows]
        x = np.array([tuple(map(float, r[1:])) for r in rows])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        n = len(x)
        if self.linkage == "ward":
            d = d * d / 2
        np.fill_diagonal(d, np.inf)
        size, name, alive = np.ones(n), list(range(n)), np.ones(n, bool)
        for step in range(n - 1):
            i, j = sorted(divmod(int(d.argmin()), n))
            h = float(d[i, j])
            others = np.flatnonzero(alive)
            others = others[(others != i) & (others != j)]
            a, b = d[i, others], d[j, others]
            if self.linkage == "single":
                new = np.minimum(a, b)
            elif self.linkage == "complete":
                new = np.maximum(a, b)
            elif self.linkage == "average":
                new = (size[i] * a + size[j] * b) / (size[i] + size[j])
            elif self.linkage == "ward":
                s = size[others]
                new = ((size[i] + s) * a + (size[j] + s) * b - s * h) / (size[i] + size[j] + s)
            else:
                raise ValueError("linkage is single, complete, average or ward")
            size[i] += size[j]
            self.merges.append((name[i], name[j], h, int(size[i])))
            name[i], alive[j] = n + step, False
            d[i, others] = d[others, i] = new
            d[j, :] = d[:, j] = np.inf
        return self

    def _labels(self, merges: list) -> dict:
        n, up = len(self.ids), {}
        for k, (a, b, _, _) in enumerate(merges):
            up[a] = up[b] = n + k

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        number: dict[int, int] = {}
        return {i: number.setdefault(top(k), len(number)) for k, i in enumerate(self.ids)}

    def cut(self, k: int) -> dict:
        """Labels by id for k clusters."""
        return self._labels(self.merges[: max(0, len(self.ids) - k)])

    def cut_height(self, height: float) -> dict:
        return self._labels([m for m in self.merges if m[2] <= height])

    def summary(self) -> str:
        return f"{self.linkage} linkage of {len(self.ids)} rows, {len(self.merges)} merges"


@dataclass
class LineLinkage:
    """Single linkage of one column, of any number of rows: neighbours in the order of value and id merge at the gap between them, so
    the heights are the sorted gaps, and a cluster is what lies between two larger gaps. Missing values stand last, with no gap."""

    rows: DataFrame | None = None

    def fit(self, df: DataFrame, column: str, id_col: str) -> LineLinkage:
        rows = df.select(F.col(id_col).alias("id"), F.col(column).cast("double").alias("v"))
        gap = F.when(F.col("v").isNull(), 0.0).otherwise(F.col("v") - F.col("before"))
        self.rows = cut(previous(rows, self._order(), "v", "before").select("id", "v", gap.alias("gap")))  # null for the first
        return self

    @staticmethod
    def _order() -> list[Column]:
        return [F.col("v").asc_nulls_last(), F.col("id")]

    def heights(self) -> DataFrame:
        """id, v and gap of each row but the first, and step: the place of its merge."""
        return positions(self.rows.where(F.col("gap").isNotNull()), [F.col("gap"), F.col("id")], "step")

    def _labels(self, rows: DataFrame, opens: Column) -> DataFrame:
        parted = cut(running_totals(rows, self._order(), {"c": F.when(opens, 1).otherwise(0)}).select("id", "c"))
        return parted.join(parted.groupBy("c").agg(F.min("id").alias("cluster")), "c").select("id", "cluster")

    def cut(self, k: int) -> DataFrame:
        """id, cluster (its least id) for k clusters."""
        steps = self.heights().select("id", "v", "step").union(self.rows.where(F.col("gap").isNull()).select("id", "v", F.lit(None)))
        return self._labels(steps, F.col("step") > self.rows.count() - k)

    def cut_height(self, height: float) -> DataFrame:
        """id, cluster (its least id) of merges up to height."""
        return self._labels(self.rows, F.col("gap") > F.lit(float(height)))


@dataclass
class ConsensusCluster:
    """Rows that at least threshold of several labelings put together, and components of these ties. Noise (-1) is not counted."""

    threshold: float = 0.5

    def fit(self, labels: DataFrame, id_col: str, columns: list[str]) -> ConsensusCluster:
        long = labels.select(F.col(id_col).alias("id"), F.explode(F.array(*(F.struct(F.lit(c).alias("m"), F.col(c).cast("string").alias("l")) for c in columns))).alias("x")).select("id", "x.m", "x.l").where("l != '-1'")
        seen = long.groupBy("id").agg(F.collect_set("m").alias("ms"))
        joint = long.alias("a").join(long.alias("b"), (F.col("a.m") == F.col("b.m")) & (F.col("a.l") == F.col("b.l")) & (F.col("a.id") < F.col("b.id"))).groupBy(F.col("a.id").alias("u"), F.col("b.id").alias("v")).agg(F.count("*").alias("n"))
        with_counts = joint.join(seen.withColumnsRenamed({"id": "u", "ms": "mu"}), "u").join(seen.withColumnsRenamed({"id": "v", "ms": "mv"}), "v")
        self.coassociation = cut(with_counts.select("u", "v", (F.col("n") / F.size(F.array_intersect("mu", "mv"))).alias("share")))
        label = components(self.coassociation.where(F.col("share") >= self.threshold))
        every = labels.select(F.col(id_col).alias("node"))
        self.labels = cut(every.join(label, "node", "left").select(F.col("node").alias(id_col), F.coalesce("component", "node").alias("cluster")))
        self.id_col, self.n = id_col, labels.count()
        return self

    def strength(self) -> DataFrame:
        """Mean co-association within each cluster; pairs never put together count 0."""
        a, b = (self.labels.select(F.col(self.id_col).alias(x), F.col("cluster").alias(f"c{x}")) for x in "uv")
        inner = self.coassociation.join(a, "u").join(b, "v").where("cu = cv").groupBy(F.col("cu").alias("cluster")).agg(F.sum("share").alias("s"))
        size = self.labels.groupBy("cluster").agg(F.count("*").alias("n"))
        return size.join(inner, "cluster", "left").select("cluster", "n", F.coalesce(F.try_divide(F.col("s") * 2, F.col("n") * (F.col("n") - 1)), F.when(F.col("n") == 1, 1.0).otherwise(0.0)).alias("strength"))

    def agreement(self) -> float:
        s = self.coassociation.agg(F.sum("share")).first()[0] or 0.0
        return s / (self.n * (self.n - 1) / 2) if self.n > 1 else 1.0


@dataclass
class KNN:
    """k nearest neighbours as classifier (vote) or regressor (mean); weights uniform or distance (1 / d, 1e9 at 0)."""

    k: int = 5
    weights: str = "uniform"
    metric: str = "euclidean"
    task: str = "classification"
    train: DataFrame | None = None
    columns: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str], y: str, id_col: str) -> KNN:
        self.train, self.columns, self.y, self.id_col = df, columns, y, id_col
        return self

    def kneighbors(self, df: DataFrame, k: int | None = None) -> DataFrame:
        return nearest(df, self.train, self.columns, k or self.k, self.id_col, self.id_col, self.metric)

    def radius_neighbors(self, df: DataFrame, radius: float) -> DataFrame:
        return near_pairs(df, self.train, self.columns, radius, self.id_col, self.id_col, self.metric)

    def _weighted(self, df: DataFrame) -> DataFrame:
        w = F.lit(1.0) if self.weights == "uniform" else F.when(F.col("distance") == 0, 1e9).otherwise(1 / F.col("distance"))
        return self.kneighbors(df).join(self.train.select(F.col(self.id_col).alias("id_r"), F.col(self.y).alias("y")), "id_r").withColumn("w", w)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """id, label, share."""
        votes = self._weighted(df).groupBy("id_l", "y").agg(F.sum("w").alias("v"), F.min("place").alias("first"))
        return votes.select(F.col("id_l").alias("id"), F.col("y").alias("label"), (F.col("v") / F.sum("v").over(Window.partitionBy("id_l"))).alias("share"), "first")

    def predict(self, df: DataFrame) -> DataFrame:
        """id, prediction; votes that tie go to the nearer label."""
        if self.task == "regression":
            return self._weighted(df).groupBy(F.col("id_l").alias("id")).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))
        p = self.predict_proba(df)
        best = p.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("share"), "first")))
        return best.where("k = 1").select("id", F.col("label").alias("prediction"))
