"""Near-duplicates among embeddings: an exact metric range join.

Unit vectors at a cosine of t or more are at a Euclidean distance of r = sqrt(2 - 2t) or less. Pivots are dense places of a
bounded sample, then members of it that lie far from the earlier pivots. Every vector's cell is that of its nearest pivot. By the
triangle inequality a vector of another cell can link into a cell only if it lies within r of the plane between the two pivots: it
is a guest of that cell (of the two cells of a pair, the later one's vectors are guests of the earlier). Cells are joined
independently, in pairs of blocks of bounded size, so that no cell has to fit in a task. Blocks are written once under the shared
folder; what is dealt among tasks are the names of two blocks that may meet, and a task leaves out those of the second block
that are no guests. Vectors within r / 2 of their pivot all link with each other: they need no comparison, only counts.

Equal vectors are one class with a count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import pack_arrays, unpack_arrays
from .common import Stash, open_folder, partitions, put_file, small_batches
from .components import connected_components, min_labels

#: Vectors that pivots are sought among; vectors of a cell, about; pivots at most.
SAMPLE, CELL, PIVOTS = 4096, 1024, 256
#: Vectors of a block at least and at most, its bytes at most, and blocks of all vectors at least.
LEAST_BLOCK, BLOCK, BLOCK_BYTES, BLOCKS = 64, 4096, 8 << 20, 64
#: Pairs of blocks of a task, about.
TASK_PAIRS = 64
#: How far a single-precision product may be off; nearer to the threshold, double precision decides.
SINGLE_MARGIN = 1e-4


def _unit(raw: list[bytes] | np.ndarray) -> np.ndarray:
    """Unit vectors; components are scaled by the largest first, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _to_bytes(batches):
    """Valid vectors as bytes of doubles, null for those that link with nothing."""
    for batch in batches:
        out = []
        for v in batch.column("v"):
            v = v.values
            if v is None or len(v) == 0 or v.null_count:
                out.append(None)
                continue
            x = np.asarray(v, np.float64)
            out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "vec"])


def choose_pivots(sample: list[bytes], radius: float, most: int) -> np.ndarray:
    """Sample members with most others in their ball, each outside of the earlier balls; then those farthest from all earlier pivots."""
    if not sample:
        return np.zeros((0, 0))
    x = _unit(sample)
    near = np.zeros((len(x), len(x)), bool)
    for k in range(0, len(x), 256):
        near[k : k + 256] = x[k : k + 256] @ x.T >= 1 - radius * radius / 2
    left, picked = np.ones(len(x), bool), []
    while len(picked) < most:
        n = (near & left).sum(1) * left
        best = int(n.argmax())
        if n[best] < 3:
            break
        picked.append(best)
        left &= ~near[best]
    closest = (x @ x[picked].T).max(1) if picked else np.full(len(x), -2.0)
    while len(picked) < min(most, len(x)):
        best = int(closest.argmin())
        if closest[best] > 1 - 1e-9:
            break
        picked.append(best)
        closest = np.maximum(closest, x @ x[best])
    return x[picked]


def _assign(pivots, radius: float):
    """Cell and role (0: in the pivot's ball, 1: not) of each class; vectors of other lengths than the pivots' have cell -1."""

    def run(batches):
        p: np.ndarray = pivots.value
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            size = np.array([len(v) // 8 for v in raw], np.int64)
            cell, role = np.full(len(raw), -1, np.int64), np.ones(len(raw), np.int64)
            own = np.flatnonzero(size == p.shape[1]) if len(p) else np.zeros(0, np.int64)
            if len(own):
                dot = _unit([raw[k] for k in own]) @ p.T
                cell[own] = dot.argmax(1)
                role[own] = np.sqrt(np.maximum(0, 2 - 2 * dot.max(1))) > radius
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "vec")), *(pa.array(x, pa.int32()) for x in (size, cell, role))], ["rep", "copies", "vec", "dim", "cell", "role"])

    return run


def _margins(x: np.ndarray, p: np.ndarray, home: int) -> np.ndarray:
    """Distances of a cell's vectors from the planes between its pivot and the earlier pivots."""
    away = p[home] - p[:home]
    return (x @ away.T) / np.maximum(np.sqrt((away * away).sum(1)), 1e-12)


def _write_block(folder: str, pivots, reach: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        one = pdf.iloc[0]
        dim, cell, role, block = (int(one[c]) for c in ("dim", "cell", "role", "block"))
        name, x = f"{dim}.{cell}.{role}.{block}", _unit(list(pdf["vec"]))
        put_file(folder, name, [pack_arrays(pdf["rep"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), x.reshape(-1))])
        near = _margins(x, pivots.value, cell) <= reach + 1e-9 if cell > 0 else np.zeros((len(x), 0), bool)
        return pd.DataFrame({"dim": [dim], "cell": [cell], "role": [role], "block": [block], "name": [name], "n": [len(pdf)], "guests": [int(near.sum())], "copies": [int(pdf["copies"].sum())], "low": [int(one["rep"])], "visits": [np.flatnonzero(near.any(0)).tolist()]})

    return run


BLOCK_SCHEMA = "dim int, cell int, role int, block int, name string, n long, guests long, copies long, low long, visits array<int>"


def _join_blocks(folder: str, pivots, threshold: float, reach: float):
    """Links between two blocks (or within one): numbers of links, weighted by copies, and a forest of links."""

    def load(name: str):
        fs, at = open_folder(folder)
        with fs.open_input_file(f"{at}/{name}") as f:
            reps, copies, x = unpack_arrays(f.read())
        return reps, copies, x.reshape(len(reps), -1)

    def join(a: tuple, b: tuple, inner: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (ra, ca, xa), (rb, cb, xb) = a, b
        sb = xb.astype(np.float32)
        na, nb, ea, eb = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64), [], []
        for k in range(0, len(ra), 512):
            s = xa[k : k + 512].astype(np.float32) @ sb.T
            hit = s >= threshold
            i, j = np.nonzero(np.abs(s - threshold) < SINGLE_MARGIN)
            for m in range(0, len(i), 1 << 14):
                r, c = i[m : m + (1 << 14)], j[m : m + (1 << 14)]
                hit[r, c] = np.einsum("ij,ij->i", xa[k + r], xb[c]) >= threshold
            if inner:
                hit[np.arange(len(hit)), k + np.arange(len(hit))] = False
            i, j = np.nonzero(hit)
            na[k : k + 512] += hit @ cb
            if not inner:
                nb += ca[k : k + 512] @ hit
            if len(i):
                ea.append(k + i)
                eb.append(j)
                if sum(map(len, ea)) > 1 << 21:
                    ea, eb = _thin(ea, eb, len(ra), len(rb), inner)
        if not ea:
            return (np.zeros(0, np.int64),) * 3
        a, b = np.concatenate(ea), np.concatenate(eb)
        every = ra if inner else np.concatenate([ra, rb])
        label = min_labels(len(every), a, b if inner else b + len(ra))
        n = na if inner else np.concatenate([na, nb])
        keep = n > 0
        return every[keep], n[keep], every[label][keep]

    def run(batches):
        held: tuple[str, tuple] | None = None
        for batch in batches:
            for first, second, i, j in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "i", "j")), strict=True):
                if held is None or held[0] != first:
                    held = first, load(first)
                other = held[1] if second == first else load(second)
                if i != j:
                    away = pivots.value[j] - pivots.value[i]
                    guest = other[2] @ (away / max(float(np.sqrt(away @ away)), 1e-12)) <= reach + 1e-9
                    other = tuple(v[guest] for v in other)
                rep, n, root = join(held[1], other, second == first)
                if len(rep):
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n), pa.array(root)], ["rep", "n", "root"])

    return run


def _thin(ea, eb, la, lb, inner):
    """The same components with fewer edges."""
    a, b = np.concatenate(ea), np.concatenate(eb)
    label = min_labels(la if inner else la + lb, a, b if inner else b + la)
    node = np.flatnonzero(label != np.arange(len(label)))
    if inner:
        return [node], [label[node]]
    # Roots are of side a wherever an edge exists, as these come first.
    side_b = node[node >= la]
    side_a = node[node < la]
    # An a-a tie goes through any b of the component.
    some_b = np.full(la + lb, -1)
    some_b[label[side_b]] = side_b
    return [label[side_b], side_a], [side_b - la, some_b[label[side_a]] - la]


def vector_blocks(classes: DataFrame, stash: Stash, threshold: float) -> tuple[DataFrame, DataFrame, object, float]:
    """Classes with their cells, the blocks written of them, the pivots (broadcast) and the distance of a link."""
    spark = classes.sparkSession
    reach = math.sqrt(2 - 2 * threshold)
    total = classes.count()
    by_hash = F.pmod(F.xxhash64("rep", "vec"), F.lit(1 << 20)) < math.ceil(min(1.0, 2 * SAMPLE / max(1, total)) * (1 << 20))
    sample = [bytes(r["vec"]) for r in classes.where(by_hash).orderBy(F.xxhash64("rep"), "vec").limit(SAMPLE).select("vec").collect()]
    lengths = [len(v) for v in sample]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    pivots = spark.sparkContext.broadcast(choose_pivots([v for v in sample if len(v) == size], reach / 2 - 1e-9, max(1, min(PIVOTS, total // CELL))))
    placed = stash.save(classes.mapInArrow(_assign(pivots, reach / 2 - 1e-9), "rep long, copies long, vec binary, dim int, cell int, role int"), "placed")
    rows = F.greatest(F.lit(16), F.least(F.lit(max(LEAST_BLOCK, min(BLOCK, total // BLOCKS))), F.floor(BLOCK_BYTES / 8 / F.col("dim")))).cast("int")
    sizes = placed.groupBy("dim", "cell", "role").agg(F.count("*").alias("n")).select("dim", "cell", "role", F.ceil(F.col("n") / rows).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["dim", "cell", "role"]).withColumn("block", F.pmod(F.xxhash64("rep", "vec"), F.col("blocks")).cast("int")).drop("blocks")
    blocks = stash.save(dealt.groupBy("dim", "cell", "role", "block").applyInPandas(_write_block(f"{stash.path}/vectors", pivots, reach), BLOCK_SCHEMA), "blocks")
    return placed, blocks, pivots, reach


def replication(blocks: DataFrame) -> float:
    """Cells that a vector is compared in, on average: its own and those that it is a guest of."""
    n, guests = blocks.agg(F.sum("n"), F.sum("guests")).first()
    return 1 + (guests or 0) / (n or 1)


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.9, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row per vector: id_col, n_links (other vectors at a cosine of threshold or more), component_id (smallest id reachable), kept.

    Null, empty and zero vectors, those with null or non-finite components, and rows without an id link with nothing: they are
    their own components and kept. Vectors of other lengths don't link; those of another length than the commonest are compared
    block by block. Finite components may be as large or small as they like. Equal vectors link (repeated rows too, once for
    each). Ids are numbers; rows that share one are one node of the graph. Other columns of df, whatever their names, have no part in
    this. An empty table gives no row."""
    spark = df.sparkSession
    small_batches(spark)
    stash = Stash(spark, "embed-dedup")
    rows = stash.save(df.select(F.col(id_col).cast("long").alias("key"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(_to_bytes, "key long, vec binary"), "rows")
    valid = rows.where("vec is not null and key is not null")
    classes = stash.save(valid.groupBy("vec").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "classes")
    cells, blocks, pivots, reach = vector_blocks(classes, stash, threshold)
    a, b = (blocks.select("dim", "cell", "role", "block", "visits", "name").toDF(*(f"{x}_{c}" for c in ("dim", "cell", "role", "block", "visits", "name"))) for x in "ab")
    same = (F.col("a_dim") == F.col("b_dim")) & (F.col("a_cell") == F.col("b_cell"))
    within = a.join(b, same).where("(a_role = 0 and b_role = 1) or (a_role = 1 and b_role = 1 and a_block <= b_block)")
    guests = b.withColumn("visit", F.explode("b_visits"))
    across = a.join(guests, (F.col("a_dim") == F.col("b_dim")) & (F.col("a_cell") == F.col("visit")))
    named = [F.col("a_name").alias("a"), F.col("b_name").alias("b"), F.col("a_cell").alias("i"), F.col("b_cell").alias("j")]
    meet = stash.save(within.select(*named).union(across.select(*named)), "meet")
    tasks = max(1, min(-(-meet.count() // TASK_PAIRS), 64 * partitions(spark)))
    dealt = meet.repartition(tasks, "a", F.pmod(F.xxhash64("b"), F.lit(16))).sortWithinPartitions("a", "b")
    links = stash.save(dealt.mapInArrow(_join_blocks(f"{stash.path}/vectors", pivots, threshold, reach), "rep long, n long, root long"), "links")
    stash.drop("vectors", "meet")
    # Inside a ball all link.
    balls = blocks.where("role = 0").groupBy("dim", "cell").agg(F.sum("copies").alias("all_copies"), F.min("low").alias("low"))
    inside = cells.where("role = 0").join(balls, ["dim", "cell"]).select("rep", (F.col("all_copies") - 1).alias("n"), F.col("low").alias("root"))
    alone = cells.where("role = 1").select("rep", (F.col("copies") - 1).alias("n"), F.col("rep").alias("root"))
    counted = links.union(inside).union(alone)
    n_links = stash.save(counted.groupBy("rep").agg(F.sum("n").alias("n_links")), "n_links")
    component = connected_components(counted.select(F.col("rep").alias("u"), F.col("root").alias("v")), stash)
    by_class = classes.select("vec", "rep").join(n_links, "rep").join(component.withColumnRenamed("node", "rep"), "rep", "left").select("vec", "n_links", F.coalesce("component", "rep").alias("component_id"))
    by_class = stash.save(by_class, "by_class")
    # Copies are matched by vector; a vector's many copies are split among tasks as a skewed join.
    out = rows.join(by_class, (rows["vec"] == by_class["vec"]) & rows["key"].isNotNull(), "left").select(rows["key"], F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", rows["key"]).alias("component_id"))
    kind = df.schema[id_col].dataType.simpleString()
    return out.select(F.col("key").cast(kind).alias(id_col), "n_links", F.col("component_id").cast(kind).alias("component_id"), F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))
