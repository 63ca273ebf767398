"""Exact Jaccard join of documents on word shingles, with components of the links.

Equal sets are one class. Classes meet through a prefix index: of each set the rarest shingles (by a sketch of fixed size,
ties by hash, so that any sketch gives one order) are sent to buckets of the hash space, as arrays. Prefixes are so long that
linked sets meet in many lists (least_hits), while sets that share a few shingles by chance, of which there are the more the
larger the table and the fuller the sketch, do not: a class that meets others in fewer lists is dropped, and then those that
met too few of the rest. Two classes are tied if they meet often enough in short lists; those of a long list are tied by size,
in linear work. Components of these ties are candidate groups: links never leave a group.

Groups are joined by T-occurrence search: a set needs 75 % of its shingles in common, so its longest inverted lists are set
aside (DivideSkip), the short ones are merged on a heap that skips ahead (or counted in one pass if they are so long that there is
little to skip), and what reaches the reduced count is probed in the long lists. A large group is cut into blocks; each block is searched within itself and against a few
pivots of the group. If that ties the whole group together, nothing is left to do, whatever its size. Otherwise pairs of
blocks that hold different parts are searched too, so that no link is missed. Pairs already tied are not probed.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkern as tk
from .blobs import cut_points, from_five, from_short, pack_arrays, sum_by, to_five, to_short, unpack_arrays
from .common import Stash, partitions, small_batches
from .components import connected_components, min_labels
from .idfilter import id_filter, members, rows_by_filter

U64 = np.uint64
SHINGLE = 5
#: Counters of the sketch (4 bytes each), and parts that it is merged in.
SKETCH_BITS, SKETCH_PARTS = 22, 64
#: Postings of a bucket, about; postings that a map task gathers before it sends them.
BUCKET_POSTINGS, FLUSH_POSTINGS = 1 << 20, 1 << 20
#: Documents and shingles of a group that one task searches; pivots of a larger group.
GROUP_DOCS, GROUP_SHINGLES, PIVOTS = 96, 2_000_000, 4
#: Documents and shingles of a block that meets other blocks of its group: what is read grows with the square of their number.
CROSS_DOCS, CROSS_SHINGLES = 768, 1_000_000
#: Entries of a set's short lists from which they are counted in one pass instead of merged on the heap.
SCAN_ENTRIES = 512
#: Bytes of a shingle's hash in a group: 48 bits tell the shingles of one task apart.
SHINGLE_BYTES = 6
#: DivideSkip's weight of the logarithm of the longest list: the larger, the fewer lists are set aside.
SKIP_WEIGHT = 0.0085
#: Copies from which a class sends only its representative's prefix, at least; classes of that kind at most (a filter of fixed size
#: knows them), by which the number of copies goes up in a table with more.
HOT_COPIES, HOT_CLASSES = 64, 1 << 22
#: A prefix has one shingle more for each so many of its set; how often classes that meet too few others are dropped; classes
#: whose meetings a task gathers before it sends them.
HIT_SHARE, HIT_ROUNDS, FLUSH_CLASSES = 12, 2, 1 << 20
#: Postings of a list up to which its pairs are counted (longer ones tie their classes at the first meeting), and postings of lists that
#: are counted at once, about.
PAIR_LIST, PAIR_POSTINGS = 32, 1 << 17


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a chunk in ascending order, and the documents' first ones."""
    low = tk.LOWER[buf]
    s, e, first = tk.words(low, off)
    h = tk.span_hash(low, s, e)
    w, at = tk.windows(h, first, SHINGLE)
    begin = np.searchsorted(at, first)
    out = []
    count = np.diff(first)
    for k in range(len(count)):
        if count[k] >= SHINGLE:
            own = np.sort(w[begin[k] : begin[k + 1]])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif count[k]:
            x = np.full(1, count[k], U64)
            for word in h[first[k] : first[k + 1]]:
                x = tk.mix(x * U64(0xA24BAED4963EE407) + word)
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def class_hashes(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, as signed numbers; 0 for empty sets."""
    out = []
    for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(tk.mix(sets + U64(c)))])
        out.append((total[first[1:]] - total[first[:-1]]).astype(np.int64))
    return out[0], out[1]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end the partition's sketch of shingle frequencies in parts."""
    names = ["key", "n", "c1", "c2", "part", "blob"]
    sketch, kind = np.zeros(1 << SKETCH_BITS, np.uint32), None
    for batch in batches:
        kind = batch.schema.field("key").type
        for rows, buf, off in tk.text_chunks(batch, "text"):
            own = batch.slice(rows.start, rows.stop - rows.start)
            sets, first = shingle_sets(buf, off)
            place, n_place = np.unique((sets >> U64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
            sketch[place] += np.minimum(n_place, np.uint32(2**32 - 1) - sketch[place]).astype(np.uint32)
            c1, c2 = class_hashes(sets, first)
            n = len(off) - 1
            yield pa.RecordBatch.from_arrays([own.column("key"), pa.array(np.diff(first)), pa.array(c1), pa.array(c2), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    if kind is not None:
        press = zstandard.ZstdCompressor(level=1)
        blobs = [press.compress(x.tobytes()) for x in np.split(sketch, SKETCH_PARTS)]
        k = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(blobs, pa.binary())], names)


def _merge_sketch(pdf: pd.DataFrame) -> pd.DataFrame:
    un = zstandard.ZstdDecompressor()
    total = sum(np.frombuffer(un.decompress(x), np.uint32).astype(np.int64) for x in pdf["blob"])
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "blob": [zstandard.ZstdCompressor(level=1).compress(np.minimum(total, (1 << 24) - 1).astype(np.uint32).tobytes())]})


def prefix_sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles by which a set of size n finds smaller or equal ones, and those by which it is found by larger or equal ones. Linked
    sets of which the smaller has size b share 1 + b // HIT_SHARE of these at least: so many more than a common one needs are taken."""
    return np.minimum(n, n - (3 * n + 3) // 4 + 1 + n // HIT_SHARE), np.minimum(n, n - (6 * n + 6) // 7 + 1 + n // HIT_SHARE)


def least_hits(n):
    """Lists in which a set of size n meets others, at least, if it has a link: the smaller set of a link has 3/4 of n or more."""
    return 1 + (3 * n + 3) // 4 // HIT_SHARE


def hot_classes(classes: DataFrame) -> DataFrame:
    """The classes of so many copies that there are at most HOT_CLASSES of them."""
    by_size = classes.where(F.col("copies") > HOT_COPIES).groupBy(F.floor(F.log2("copies")).alias("k")).agg(F.count("*").alias("n")).collect()  # a row for each power of two
    least, total = HOT_COPIES, 0
    for r in sorted(by_size, key=lambda r: -r["k"]):
        total += r["n"]
        if total > HOT_CLASSES:
            least = max(least, 2 ** (r["k"] + 1) - 1)
            break
    return classes.where(F.col("copies") > least)


def _postings(sketch, bits: int, hot, reps):
    """Prefixes of the sets, by bucket. Of a hot class only the representative's (and what the filters take for it) is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare: np.ndarray = sketch.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def send():
            h, c, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.argsort(h)
            h, c, n = h[order], c[order], n[order]
            bucket = (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            inner = (h << U64(bits)) >> U64(24)
            rows = [(k, pack_arrays(to_five(inner[a:b]), c[a:b], n[a:b])) for k, a, b in cut_points(bucket)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for rows, buf, off in tk.text_chunks(batch, "text"):
                sets, first = shingle_sets(buf, off)
                c1, _ = class_hashes(sets, first)
                size = np.diff(first)
                key = batch.column("key").slice(rows.start, len(size)).to_numpy()
                size[members(hot.value, c1) & ~members(reps.value, key)] = 0
                # Copies within a chunk are sent once.
                alive = np.flatnonzero(size > 1)  # a set of one links with equal sets only
                one = alive[np.unique(c1[alive], return_index=True)[1]]
                order = np.minimum(rare[(sets >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64), U64((1 << 24) - 1)) << U64(40) | sets >> U64(24)
                probe, index = prefix_sizes(size)
                for k in one:
                    a = first[k]
                    pick = np.argsort(order[a : first[k + 1]], kind="stable")[: probe[k]]
                    mark = np.full(len(pick), size[k] << 1, np.uint32)
                    mark[: index[k]] |= 1
                    held.append((sets[a + pick], np.full(len(pick), c1[k]), mark))
                if sum(len(x[0]) for x in held) > FLUSH_POSTINGS:
                    yield send()
                    held = []
        if held:
            yield send()

    return run


def sorted_lists(h: np.ndarray, c: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the lists of two and more, each class once, by list, size and class."""
    order = np.argsort(h, kind="stable")
    h, c, mark = h[order], c[order], mark[order]
    same = h[1:] == h[:-1]
    multi = np.append(same, False) | np.append(False, same) if len(h) else np.zeros(0, bool)
    h, c, mark = h[multi], c[multi], mark[multi]
    order = np.lexsort((mark & 1 ^ 1, c, mark >> 1, h))
    h, c, mark = h[order], c[order], mark[order].astype(np.int64)
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], c[new], mark[new]


def _found_by(h: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted_lists whose list has a smaller set that may be found by them, and the place of the next smaller one. All pairs
    of a list that may link are connected by these ties."""
    size = mark >> 1
    found = np.where(mark & 1, np.arange(len(h)), -1)
    before = np.append(-1, np.maximum.accumulate(found)[:-1]) if len(h) else found
    ok = np.flatnonzero(before >= 0)
    ok = ok[(h[before[ok]] == h[ok]) & (4 * size[before[ok]] >= 3 * size[ok])]
    return ok, before[ok]


def hit_postings(h: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Which postings of sorted_lists meet a set that they may find or be found by."""
    hit = np.zeros(len(h), bool)
    hit[_found_by(h, mark)[0]] = True
    size = mark >> 1
    hit[:-1] |= (mark[:-1] & 1).astype(bool) & (h[1:] == h[:-1]) & (4 * size[:-1] >= 3 * size[1:])
    return hit


def _meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The postings of a bucket that meet others."""
    parts = [unpack_arrays(x) for x in pdf["blob"]]
    h, c, mark = sorted_lists(np.concatenate([from_five(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
    hit = hit_postings(h, mark)
    return pd.DataFrame({"blob": [pack_arrays(to_five(h[hit]), c[hit], mark[hit].astype(np.uint32))]})


def _alive(blob: bytes, filters: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the classes that all filters take for members."""
    h, c, mark = unpack_arrays(blob)
    keep = np.ones(len(c), bool)
    for each in filters:
        keep &= members(each.value, c)
    return from_five(h)[keep], c[keep], mark[keep]


def _hits(filters: list):
    """How many postings of each class meet others that are left, and the class's size; a class may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def send():
            c, hits, size = sum_by(*(np.concatenate([x[k] for x in held]) for k in range(3)))
            return c, hits, size

        for batch in batches:
            for blob in batch.column("blob"):
                h, c, mark = sorted_lists(*_alive(blob.as_py(), filters))
                hit = hit_postings(h, mark)
                c, n = c[hit], mark[hit] >> 1
                held.append((c, np.ones(len(c), np.int64), n))
                if sum(len(x[0]) for x in held) > FLUSH_CLASSES:
                    yield _hit_rows(*send())
                    held = []
        if held:
            yield _hit_rows(*send())

    return run


def _hit_rows(c: np.ndarray, hits: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c), pa.array(hits), pa.array(sizes // np.maximum(hits, 1))], ["c1", "hits", "n"])


def list_pairs(h: np.ndarray, c: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of classes that stand in one of these sorted_lists and may link: in how many lists they meet, and in how many they meet at
    least if they do link."""
    size, low, high = mark >> 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(PAIR_LIST, len(h))):
        at = np.flatnonzero((h[d:] == h[:-d]) & (mark[:-d] & 1).astype(bool) & (4 * size[:-d] >= 3 * size[d:]))
        low.append(at)
        high.append(at + d)
    low, high = np.concatenate(low), np.concatenate(high)
    nodes, which = np.unique(c, return_inverse=True)
    _, one, times = np.unique(which[low] * len(nodes) + which[high], return_index=True, return_counts=True)
    low, high = low[one], high[one]
    return np.minimum(c[low], c[high]), np.maximum(c[low], c[high]), times, 1 + size[low] // HIT_SHARE


def _tie(filters: list):
    """Ties of the classes that are left. Pairs of short lists come with their meetings; long lists give a forest, as pairs that need none."""

    def rows(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["u", "v", "times", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                h, c, mark = sorted_lists(*_alive(blob.as_py(), filters))
                if not len(h):
                    continue
                begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                count = np.diff(np.append(begin, len(h)))
                long = np.repeat(count > PAIR_LIST, count)
                short = np.flatnonzero(~long)
                cut = np.searchsorted(short, np.append(begin, len(h)))  # the lists' first short postings
                pieces = np.unique(cut[np.searchsorted(cut, np.append(np.arange(0, len(short), PAIR_POSTINGS), len(short)))])
                for a, b in zip(pieces[:-1], pieces[1:], strict=True):
                    yield rows(*list_pairs(h[short[a:b]], c[short[a:b]], mark[short[a:b]]))
                ok, before = _found_by(h[long], mark[long])
                u, v = c[long][before], c[long][ok]
                nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
                label = min_labels(len(nodes), at[: len(u)], at[len(u) :])
                away = np.flatnonzero(label != np.arange(len(nodes)))
                yield rows(nodes[label[away]], nodes[away], np.zeros(len(away), np.int64), np.zeros(len(away), np.int64))

    return run


class Ties:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def merge_skip(lists: list[list[int]], starts: list[int], least: int) -> dict[int, int]:
    """Numbers that stand in at least least of the ascending lists (from starts on), with their counts: a heap of list heads; when too
    few heads are equal, least - 1 lists skip to the next head by binary search."""
    heap = [(x[s], k, s) for k, (x, s) in enumerate(zip(lists, starts, strict=True)) if s < len(x)]
    heapq.heapify(heap)
    out = {}
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            out[top] = len(popped)
            for _, k, s in popped:
                if s + 1 < len(lists[k]):
                    heapq.heappush(heap, (lists[k][s + 1], k, s + 1))
            continue
        while len(popped) < least - 1 and heap:
            popped.append(heapq.heappop(heap))
        if not heap:
            break
        goal = heap[0][0]
        for _, k, s in popped:
            s = bisect_left(lists[k], goal, s)
            if s < len(lists[k]):
                heapq.heappush(heap, (lists[k][s], k, s))
    return out


def long_lists(need: int, longest: int) -> int:
    """How many lists DivideSkip sets aside: merging costs as much as probing at about need / (weight * log longest + 1)."""
    return int(need / (SKIP_WEIGHT * math.log2(max(2, longest)) + 1))


def t_occurrence_links(sets: list[np.ndarray], part: list[int] | None = None) -> list[tuple[int, int]]:
    """A forest of links (numbers of sets, as given) with the components of all pairs whose Jaccard similarity is 0.75 or more.
    Sets with equal part are known to be tied already."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = [len(sets[k]) for k in order]
    size = np.array(sizes, np.int64)
    flat = np.concatenate([sets[k] for k in order]) if sets else np.zeros(0, U64)
    tokens, ids, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times > 1
    # All lists in one array; of each, the entries up to fill are those of the sets before x.
    lists = np.repeat(np.arange(len(order)), size)[np.argsort(ids, kind="stable")]
    first, fill = np.cumsum(times) - times, np.zeros(len(tokens), np.int64)
    entries = lambda some: lists[tk.repeat_index(first[some], fill[some])]
    ties, links = Ties(len(order)), []
    if part is not None:
        seen: dict[int, int] = {}
        for x, k in enumerate(order):
            ties.tie(seen.setdefault(part[k], x), x)
    at = 0
    for x, n in enumerate(sizes):
        own = ids[at : at + n]
        at += n
        own = own[common[own]]
        need = (3 * n + 3) // 4
        low = bisect_left(sizes, -(-3 * n // 4))
        if len(own) >= need > 0:
            mine = own[fill[own] > 0]
            mine = mine[lists[first[mine] + fill[mine] - 1] >= low]
            if len(mine) >= need:
                mine = mine[np.argsort(fill[mine], kind="stable")]
                # DivideSkip: the longest lists are only probed; how many these are follows from their lengths.
                aside = min(need - 1, long_lists(need, int(fill[mine[-1]])))
                short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
                if fill[short].sum() > SCAN_ENTRIES:
                    # Lists this long have most sets in common and leave little to skip: they are counted as they stand.
                    count = np.bincount(entries(short), minlength=x)
                    maybe = low + np.flatnonzero(count[low:] >= need - aside)
                    count = count[maybe]
                else:
                    ours = [lists[f : f + k].tolist() for f, k in zip(first[short].tolist(), fill[short].tolist(), strict=True)]
                    merged = merge_skip(ours, [bisect_left(s, low) for s in ours], need - aside)
                    maybe, count = np.array(list(merged), np.int64), np.array(list(merged.values()), np.int64)
                root = ties.root(x)
                apart = np.array([ties.root(y) != root for y in maybe.tolist()], bool)
                maybe, count = maybe[apart], count[apart]
                # 100 * overlap >= 75 * union
                goal = -(-3 * (n + size[maybe]) // 7)
                able = count + len(long) >= goal
                maybe, count, goal = maybe[able], count[able], goal[able]
                if len(maybe) * 8 > x:
                    count = count + np.bincount(entries(long), minlength=x)[maybe]
                elif len(maybe):
                    for f, k in zip(first[long].tolist(), fill[long].tolist(), strict=True):
                        p = f + np.minimum(np.searchsorted(lists[f : f + k], maybe), k - 1)
                        count = count + (lists[p] == maybe)
                for y in maybe[count >= goal].tolist():
                    if ties.root(x) != ties.root(y):
                        ties.tie(x, y)
                        links.append((order[x], order[y]))
        fill[own] += 1
    return links


def _search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one task's sets."""
    pdf = pdf.drop_duplicates("rep").sort_values("rep")
    reps = pdf["rep"].tolist()
    links = t_occurrence_links([from_short(np.frombuffer(x, np.uint8), SHINGLE_BYTES) for x in pdf["shingles"]], pdf["part"].tolist() if "part" in pdf else None)
    return pd.DataFrame({"u": [reps[a] for a, _ in links], "v": [reps[b] for _, b in links]})


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the classes' representatives; rows whose text is of another class (of a repeated id) go."""
    for batch in batches:
        for rows, buf, off in tk.text_chunks(batch, "text"):
            own = batch.slice(rows.start, rows.stop - rows.start)
            sets, first = shingle_sets(buf, off)
            c1, c2 = class_hashes(sets, first)
            keep = np.flatnonzero((c1 == own.column("c1").to_numpy()) & (c2 == own.column("c2").to_numpy()))
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(own.column(c).take(at) for c in ("g", "blocks", "rep", "n")), pa.array([to_short(sets[first[k] : first[k + 1]], SHINGLE_BYTES).tobytes() for k in keep], pa.binary())], ["g", "blocks", "rep", "n", "shingles"])


def jaccard_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (smallest id that links reach).

    Words are lower-cased in A-Z; a text of fewer than five words is one shingle; null texts and texts without words have none
    and link with nothing. Texts of any length are read whole. Ids are whole numbers; rows without one have no component. Repeated
    rows are copies like others, and rows that share an id are tied. Other columns of df, whatever their names, have no part in
    this. An empty table gives no row."""
    spark = df.sparkSession
    small_batches(spark)
    stash = Stash(spark, "jaccard")
    rows = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    described = stash.save(rows.mapInArrow(_describe, "key long, n long, c1 long, c2 long, part int, blob binary"), "described")
    docs = described.where("part is null").select("key", "n", "c1", "c2")
    classes = stash.save(docs.where("n > 0 and key is not null").groupBy("c1", "c2").agg(F.min("key").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")

    parts = described.where("part is not null").select("part", "blob").groupBy("part").applyInPandas(_merge_sketch, "part int, blob binary").collect()
    un = zstandard.ZstdDecompressor()
    sketch = np.concatenate([np.frombuffer(un.decompress(bytes(p["blob"])), np.uint32) for p in sorted(parts, key=lambda p: p["part"])]) if parts else np.zeros(1 << SKETCH_BITS, np.uint32)
    shared = spark.sparkContext.broadcast(sketch)  # of fixed size

    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = min(30, (max(2 * partitions(spark), total // 3 // BUCKET_POSTINGS) - 1).bit_length())  # 2^50 postings and more
    hot = hot_classes(classes)
    filters = id_filter(hot, "c1"), id_filter(hot, "rep")
    postings = rows.where("key is not null").mapInArrow(_postings(shared, bits, *filters), "bucket int, blob binary")
    meet = stash.save(postings.groupBy("bucket").applyInPandas(_meet, "blob binary"), "meet")
    alive: list = []
    for k in range(HIT_ROUNDS):
        hits = meet.mapInArrow(_hits(alive), "c1 long, hits long, n long").groupBy("c1").agg(F.sum("hits").alias("hits"), F.max("n").alias("n"))
        # least_hits() of a column, by whole numbers
        least = F.expr(f"1 + ((3 * n + 3) div 4) div {HIT_SHARE}")
        alive.append(id_filter(stash.save(hits.where(F.col("hits") >= least).select("c1"), f"alive-{k}"), "c1"))
    pairs = meet.mapInArrow(_tie(alive), "u long, v long, times long, least long").groupBy("u", "v").agg(F.sum("times").alias("times"), F.min("least").alias("least"))
    groups = connected_components(pairs.where("times >= least").select("u", "v"), stash, "ties").select(F.col("node").alias("c1"), F.col("component").alias("g"))
    stash.drop("meet", *(f"alive-{k}" for k in range(HIT_ROUNDS)))
    for each in (shared, *filters, *alive):  # what they served is written
        each.unpersist()
    members = stash.save(classes.drop("copies").join(groups, "c1"), "members")
    sizes = members.groupBy("g").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("docs") / GROUP_DOCS), F.ceil(F.col("total") / GROUP_SHINGLES)).cast("int")
    placed = stash.save(members.join(sizes.select("g", blocks.alias("blocks")), "g").select("rep", "c1", "c2", "g", "n", "blocks"), "placed_members")
    # Texts of members only are shuffled; the filter is of fixed size.
    likely = rows.where("key is not null").mapInArrow(rows_by_filter(id_filter(placed, "rep"), "key", True), "key long, text string")
    found = placed.join(likely.hint("merge"), F.col("rep") == F.col("key")).select("g", "blocks", "rep", "c1", "c2", "n", "text")
    sets = stash.save(found.mapInArrow(_sets_of, "g long, blocks int, rep long, n long, shingles binary"), "sets")

    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    inner = sets.select("g", block.alias("block"), "rep", "shingles")
    large = sets.where("blocks > 1")
    # A few members of each large group go to all its blocks.
    picks = large.groupBy("g").agg(*(F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)))
    picks = stash.save(picks.select("g", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("rep")), "picks")
    if picks.isEmpty():
        return _finish(docs, classes, stash.save(inner.groupBy("g", "block").applyInPandas(_search, "u long, v long"), "links"), stash, df, id_col)
    pivots = large.join(picks, ["g", "rep"]).select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "shingles")
    links = stash.save(inner.union(pivots).groupBy("g", "block").applyInPandas(_search, "u long, v long"), "links")

    # Large groups that are not tied together yet: blocks of their parts meet.
    known = connected_components(links, stash, "known")
    state = large.select("g", "rep", "n").join(known.withColumnRenamed("node", "rep"), "rep", "left").select("g", "rep", "n", F.coalesce("component", "rep").alias("part"))
    state = stash.save(state, "state")
    mixed = state.groupBy("g").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a != b").select("g")
    state = stash.save(state.join(mixed, "g", "left_semi"), "mixed")
    if not state.isEmpty():
        part_size = state.groupBy("g", "part").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
        cut = F.greatest(F.ceil(F.col("docs") / CROSS_DOCS), F.ceil(F.col("total") / CROSS_SHINGLES))
        # Small parts share blocks, by bands of sizes; a large part has blocks of its own.
        part_size = stash.save(part_size.select("g", "part", cut.alias("own"), "docs", "total"), "part_size")
        pool = part_size.where("own <= 1").groupBy("g").agg(F.greatest(F.ceil(F.sum("docs") / CROSS_DOCS), F.ceil(F.sum("total") / CROSS_SHINGLES)).alias("pool"))
        placed = state.join(part_size.select("g", "part", "own"), ["g", "part"]).join(pool, "g", "left")
        one = F.when(F.col("own") > 1, F.struct(F.col("part").alias("p"), F.pmod(F.xxhash64("rep"), F.col("own")).alias("b"))).otherwise(F.struct(F.lit(None).cast("long").alias("p"), F.pmod(F.xxhash64("part"), F.col("pool")).alias("b")))
        placed = stash.save(placed.select("g", "rep", "n", "part", one.alias("block")), "placed")
        spread = stash.save(placed.groupBy("g", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "spread")
        a, b = (spread.select("g", F.col("block").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ab")
        fit = (4 * F.col("high_a") >= 3 * F.col("low_b")) & (4 * F.col("high_b") >= 3 * F.col("low_a"))
        apart = F.coalesce(F.col("a.p") != F.col("b.p"), F.lit(True))
        meet = a.join(b, "g").where((F.col("a") <= F.col("b")) & apart & fit).select("g", F.struct("a", "b").alias("pair"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
        both = placed.join(meet, ["g", "block"]).join(sets.select("g", "rep", "shingles"), ["g", "rep"]).select("g", "pair", "rep", "part", "shingles")
        links = links.union(stash.save(both.groupBy("g", "pair").applyInPandas(_search, "u long, v long"), "cross"))
    return _finish(docs, classes, links, stash, df, id_col)


def _finish(docs: DataFrame, classes: DataFrame, links: DataFrame, stash: Stash, df: DataFrame, id_col: str) -> DataFrame:
    parts = connected_components(links, stash, "links").withColumnRenamed("node", "rep")
    labels = stash.save(classes.join(parts, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id")), "labels")
    kind = df.schema[id_col].dataType.simpleString()
    filled, empty = docs.where("n > 0"), docs.where("n = 0")
    out = filled.join(labels, ["c1", "c2"], "left").select("key", "n", F.when(F.col("key").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.union(empty.select("key", "n", F.col("key")))
    return out.select(F.col("key").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))
