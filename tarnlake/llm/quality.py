"""Quality rules: counted rules first, then robust multivariate outliers.

Statistics of every whole text are counted by vectorised kernels. Texts that pass the counted rules are compared with
their peers of one language and source by a minimum-covariance-determinant estimate of the transformed statistic vectors; a text
whose squared Mahalanobis distance is beyond a cutoff is rejected.

Each group starts from six robust scatter estimates that need no random draw (correlations of bounded transforms of the
standardised components, spatial signs, and none at all). Each is improved by concentration steps; that with the least determinant is
kept and improved further. A step bins rows by distance, finds the bin in which the nearest share of a group ends, and sums the
moments of the rows up to it: only one row a group, start and bin is shuffled, so a hot group is reduced before the shuffle.

A group of fewer rows than an estimate needs leans on its language's estimate, and a language's on that of all rows: means and
scatters are weighed by the number of rows that the wider estimate keeps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkern as tk
from .common import Stash, small_batches

# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Names of the statistic vector's components, and the standard deviation that is added to each one's own (variances add up). The greatest value of
#: each (1 for a share; 0.548 for repeat_rate, as the counted rules end at 30 %) is beyond the cutoff from 0 at this deviation.
FEATURES = ("log_word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "long_word_rate")
FLOOR = (0.08, 0.08, 0.10, 0.07, 0.06)
#: Bins of a unit of log distance, and of a unit of a component.
DISTANCE_BINS, VALUE_BINS = 64, 2048
#: Rows that an estimate of its own needs: five for each component.
LEAST_ROWS = 5 * len(FEATURES)
#: Starts, and concentration steps that all of them take before the best is chosen.
STARTS, FIRST_STEPS = 6, 2

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True


def _per_doc(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def text_stats(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document of a chunk."""
    n = len(off) - 1
    s, e, first = tk.words(buf, off)
    n_words = np.diff(first)
    space, lead = tk.IS_SPACE[buf], (buf & 0xC0) != 0x80
    ls, le = tk.spans(buf != 0x0A, off)
    inked = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    has = inked[le] > inked[ls]
    ls, le = ls[has], le[has]
    doc = np.searchsorted(off, ls, "right") - 1
    _, line = tk.distinct(buf, ls, le)
    key = doc * (len(line) + 1) + line
    order = np.argsort(key)
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    dup_lines = np.bincount(doc[order][again], minlength=n)

    # Windows of a document that share a hash are held against each other word by word.
    _, word = tk.distinct(buf, s, e)
    w, at = tk.windows(tk.mix(word.astype(np.uint64)), first, 8)
    wdoc = np.searchsorted(first, at, "right") - 1
    w = tk.mix(w + wdoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(w)
    near = np.flatnonzero(w[order][1:] == w[order][:-1])
    a, b = at[order][near], at[order][near + 1]
    near = near[(wdoc[order][near] == wdoc[order][near + 1]) & (word[a[:, None] + np.arange(8)] == word[b[:, None] + np.arange(8)]).all(1)]
    same = np.zeros(len(w) + 1, bool)
    same[near + 1] = True
    found = at[order][same[:-1] | same[1:]]
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + 8, -1)
    covered = np.cumsum(cover)[:-1] > 0

    chars = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    return {
        "n_words": n_words, "word_chars": _per_doc(lead & ~space, off), "n_symbols": _per_doc(IS_SYMBOL[buf], off), "n_dup_lines": dup_lines, "n_repeat_words": _per_doc(covered, first),
        "n_lines": np.bincount(doc, minlength=n), "n_long_words": _per_doc(chars[e] - chars[s] > 24, first),
    }


def vectors(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics; variances of shares are evened out by square roots."""
    words, lines = np.maximum(1, c["n_words"]), np.maximum(1, c["n_lines"])
    return np.stack([np.log(np.maximum(1, c["word_chars"]) / words), np.sqrt(c["n_symbols"] / words), np.sqrt(c["n_dup_lines"] / lines), np.sqrt(c["n_repeat_words"] / words), np.sqrt(c["n_long_words"] / words)], 1)


def _judge(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts the counted rules reject, and the statistic vectors."""
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"]), vectors(c)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, off in tk.text_chunks(batch, "text"):
            part = batch.slice(rows.start, rows.stop - rows.start)
            c = text_stats(buf, off)
            failed, x = _judge(c)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("lang"), part.column("source"), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(failed), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1]))], ["key", "lang", "source", *COUNTS, "base_failed", *FEATURES])


def chi2_quantile(p: float, df: int) -> float:
    """Quantile of the chi-square distribution, by bisection on the incomplete gamma series."""

    def cdf(x: float) -> float:
        a, x = df / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return low


P = len(FEATURES)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SUMS = [f"s{i}" for i in range(P)] + [f"q{i}_{j}" for i, j in _PAIRS]
_ESTIMATE = "g string, k int, rows long, mu array<double>, cov array<double>, inv array<double>, det double"


def _start(pdf: pd.DataFrame) -> pd.DataFrame:
    """First estimate of a group from histograms of its components: medians and median absolute deviations."""
    centre, spread = [], []
    for k in range(P):
        own = pdf[pdf["dim"] == k].sort_values("bin")
        value, n = own["bin"].to_numpy() / VALUE_BINS, own["n"].to_numpy().cumsum()
        middle = value[np.searchsorted(n, n[-1] / 2)]
        away = np.abs(value - middle)
        order = np.argsort(away, kind="stable")
        m = own["n"].to_numpy()[order].cumsum()
        centre.append(middle)
        spread.append(max(FLOOR[k], 1.4826 * away[order][np.searchsorted(m, m[-1] / 2)]))
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "mu": [centre], "spread": [spread]})


def eased(cov: np.ndarray) -> np.ndarray:
    """A scatter with the least variances added, so that no direction is narrower than these and determinants of groups with
    constant or tied components can be compared."""
    return cov + np.diag(np.square(FLOOR))


def start_scatter(cross: np.ndarray | None, spread: np.ndarray) -> np.ndarray:
    """Scatter from the cross products of a bounded transform: its correlations, with the group's spreads."""
    r = np.eye(P)
    if cross is not None:
        size = np.sqrt(np.diag(cross))
        there = size > 0
        both = np.outer(there, there)
        r[both] = (cross / np.outer(np.where(there, size, 1), np.where(there, size, 1)))[both]
        value, vector = np.linalg.eigh(r)
        r = vector @ np.diag(np.maximum(value, 0.05)) @ vector.T
    return r * np.outer(spread, spread)


def _square(row: dict) -> np.ndarray:
    out = np.zeros((P, P))
    for i, j in _PAIRS:
        out[i, j] = out[j, i] = row[f"q{i}_{j}"]
    return out


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["g", "k", "rows", "mu", "cov", "inv", "det"])


def _estimate(g: str, k: int, n: int, mu: np.ndarray, cov: np.ndarray) -> tuple:
    return g, k, n, mu.tolist(), cov.reshape(-1).tolist(), np.linalg.inv(eased(cov)).reshape(-1).tolist(), float(np.linalg.det(eased(cov)))


def _scatters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The start of each group and transform; the last one has no cross products."""
    for f in frames:
        yield _rows([_estimate(r["g"], r["k"], 0, np.array(r["mu"]), start_scatter(_square(r) if r["k"] < STARTS - 1 else None, np.array(r["spread"]))) for r in f.to_dict("records")])


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and scatter of each group and start."""
    for f in frames:
        out = []
        for r in f.to_dict("records"):
            mu = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
            out.append(_estimate(r["g"], r["k"], r["n"], mu, _square(r) / r["n"] - np.outer(mu, mu)))
        yield _rows(out)


def _lean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates of small groups: the rows that the wider estimate keeps, weighed against that."""
    for f in frames:
        out = []
        for r in f.to_dict("records"):
            mu, cov, n = np.array(r["mu"]), np.array(r["cov"]).reshape(P, P), int(r["n"])
            if n:
                own = np.array([r[f"s{i}"] for i in range(P)]) / n
                a = min(1.0, n / LEAST_ROWS)
                cov = a * (_square(r) / n - np.outer(own, own)) + (1 - a) * cov
                mu = a * own + (1 - a) * mu
            out.append(_estimate(r["g"], 0, n, mu, cov))
        yield _rows(out)


def _distance() -> F.Column:
    away = [F.col(c) - F.col("mu")[i] for i, c in enumerate(FEATURES)]
    return sum((away[i] * away[j] * F.col("inv")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))


def _sums(values: list[F.Column]) -> list[F.Column]:
    return [F.sum(v).alias(f"s{i}") for i, v in enumerate(values)] + [F.sum(values[i] * values[j]).alias(f"q{i}_{j}") for i, j in _PAIRS]


def _transforms() -> F.Column:
    """Bounded transforms of the standardised components, one array each; the last stands for none."""
    z = [(F.col(c) - F.col("mu")[i]) / F.col("spread")[i] for i, c in enumerate(FEATURES)]
    square = sum((v * v for v in z), F.lit(0.0))
    near = F.sqrt(square + 1e-12)
    made = [[F.tanh(v) for v in z], [F.signum(v) for v in z], [F.greatest(F.lit(-1.5), F.least(F.lit(1.5), v)) for v in z], [v / near for v in z], [v / (1 + square / P) for v in z], [F.lit(0.0)] * P]
    return F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.array(*m).alias("y")) for k, m in enumerate(made))))


def _step(grouped: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """One concentration step of every group and start."""
    far = grouped.join(params.select("g", "k", "mu", "inv"), "g").withColumn("bin", F.floor(F.log(_distance() + 1e-6) * DISTANCE_BINS)).select("g", "k", "bin", *FEATURES)
    counts = far.groupBy("g", "k", "bin").agg(F.count("*").alias("n"))
    upto, whole = F.sum("n").over(Window.partitionBy("g", "k").orderBy("bin")), F.sum("n").over(Window.partitionBy("g", "k"))
    edge = counts.select("g", "k", "bin", (upto - F.col("n") < F.ceil(F.lit(share) * whole)).alias("in")).where("in").groupBy("g", "k").agg(F.max("bin").alias("edge"))
    return far.join(edge, ["g", "k"]).where("bin <= edge").groupBy("g", "k").agg(F.count("*").alias("n"), *_sums([F.col(c) for c in FEATURES])).mapInPandas(_moments, _ESTIMATE)


def quality_verdicts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, tail: float = 1e-9, steps: int = 3) -> DataFrame:
    """One row per document: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. Null languages and sources are values like others. Texts of any length are read
    whole. Ties in distance share a bin and are taken together. Repeated rows count each time and get equal verdicts; other
    columns of df, whatever their names, have no part in this; an empty table gives no row."""
    stash = Stash(df.sparkSession, "quality")
    kind = df.schema[id_col].dataType.simpleString()
    counted = _counted(df, stash, kind, text_col, id_col, lang_col, source_col)
    params = estimates(counted, stash, share, tail, steps)
    out = counted.join(params, "peer", "left")
    kept = ~F.col("base_failed") & F.coalesce(_distance() <= chi2_quantile(1 - tail, P), F.lit(False))
    return out.select(F.col("key").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"))


def keep_quality(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, tail: float = 1e-9, steps: int = 3) -> DataFrame:
    """The rows of df, with all columns, that quality_verdicts() keeps. Texts are counted again beside their rows and judged by the
    estimates of their group, so that no text is shuffled while the table of estimates is small enough to be broadcast."""
    stash = Stash(df.sparkSession, "quality")
    counted = _counted(df, stash, df.schema[id_col].dataType.simpleString(), text_col, id_col, lang_col, source_col)
    params = estimates(counted, stash, share, tail, steps)
    names, at = df.columns, df.columns.index(text_col)
    own = "__"  # no column of df begins with it
    while any(c.startswith(own) for c in names):
        own += "_"

    def run(batches):
        for batch in batches:
            for rows, buf, off in tk.text_chunks(pa.RecordBatch.from_arrays([batch.column(at)], ["text"]), "text"):
                part = batch.slice(rows.start, rows.stop - rows.start)
                failed, x = _judge(text_stats(buf, off))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(failed), pa.array(list(x), pa.list_(pa.float64()))], names=[*part.schema.names, f"{own}failed", f"{own}x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {own}peer string, {own}failed boolean, {own}x array<double>"
    beside = df.withColumn(f"{own}peer", _peer(lang_col, source_col)).mapInArrow(run, schema)
    renamed = params.select(F.col("peer").alias(f"{own}peer"), F.struct("mu", "inv").alias(f"{own}params"))
    joined = beside.where(~F.col(f"{own}failed")).join(renamed, f"{own}peer", "left")
    away = [F.col(f"{own}x")[i] - F.col(f"{own}params.mu")[i] for i in range(P)]
    d = sum((away[i] * away[j] * F.col(f"{own}params.inv")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))
    return joined.where(d <= chi2_quantile(1 - tail, P)).select(names)


def _peer(lang_col: str, source_col: str) -> F.Column:
    return F.to_json(F.struct(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")))


def _counted(df, stash, kind, text_col, id_col, lang_col, source_col) -> DataFrame:
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    schema = f"key {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{c} double" for c in FEATURES)
    return stash.save(rows.mapInArrow(_count, schema).withColumn("peer", _peer("lang", "source")), "counted")


def _members(passed: DataFrame) -> DataFrame:
    """peer, n, wide (the group of its language), n_wide, and groups: those whose estimates its rows go into. A language is estimated
    only if a peer of it is small, all rows only if such a language is small."""
    n = passed.groupBy("peer", "lang").agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang")
    n = n.withColumns({"n_wide": F.sum("n").over(own), "least": F.min("n").over(own), "wide": F.concat(F.lit("l:"), F.coalesce("lang", F.lit("\0")))})
    small = n.agg(F.min(F.when(F.col("least") < LEAST_ROWS, F.col("n_wide"))).alias("m")).first()["m"]
    every = F.lit("*") if small is not None and small < LEAST_ROWS else F.lit(None).cast("string")
    wide = F.when((F.col("least") < LEAST_ROWS) & (F.col("n_wide") >= LEAST_ROWS), F.col("wide"))
    groups = F.filter(F.array(F.when(F.col("n") >= LEAST_ROWS, F.concat(F.lit("p:"), "peer")), wide, every), lambda g: g.isNotNull())
    return n.select("peer", "n", "wide", "n_wide", groups.alias("groups"))


def estimates(counted: DataFrame, stash: Stash, share: float, tail: float, steps: int) -> DataFrame:
    """peer, mu, inv, own (whether the estimate is of the (lang, source) alone) for each (lang, source) with a row that passes the counted rules."""
    passed = counted.where(~F.col("base_failed"))
    members = stash.save(_members(passed), "members")
    grouped = passed.select("peer", *FEATURES).join(members.select("peer", F.explode("groups").alias("g")), "peer").select("g", *FEATURES)
    dims = F.explode(F.array(*(F.struct(F.lit(k).alias("dim"), F.floor(F.col(c) * VALUE_BINS).alias("bin")) for k, c in enumerate(FEATURES)))).alias("d")
    first = grouped.select("g", dims).groupBy("g", "d.dim", "d.bin").agg(F.count("*").alias("n"))
    medians = stash.save(first.groupBy("g").applyInPandas(_start, "g string, mu array<double>, spread array<double>"), "medians")
    made = grouped.join(medians, "g").select("g", _transforms().alias("t")).groupBy("g", "t.k").agg(*_sums([F.col("t.y")[i] for i in range(P)]))
    params = stash.save(made.join(medians, "g").mapInPandas(_scatters, _ESTIMATE), "starts")
    for k in range(FIRST_STEPS):
        params = stash.save(_step(grouped, params, share), f"first{k}")
    fields = [x.strip().split(" ")[0] for x in _ESTIMATE.split(",")]
    best = params.groupBy("g").agg(F.min_by(F.struct(*fields[1:]), F.struct("det", "k")).alias("x")).select("g", *(f"x.{c}" for c in fields[1:]))
    params = stash.save(best, "best")
    for k in range(steps):
        params = stash.save(_step(grouped, params, share), f"step{k}")
    # The share's covariance is too small by this factor if the rest is normal.
    factor = share / (1 - _upper(chi2_quantile(share, P), P + 2))
    params = stash.save(params.withColumn("cov", F.transform("cov", lambda v: v * factor)).mapInPandas(_restate, _ESTIMATE), "raw")
    cutoff = chi2_quantile(1 - tail, P)

    def lean(label: str, g: F.Column, rows: DataFrame, wider: DataFrame) -> DataFrame:
        """Estimates of the small groups of rows (peer, name, wide) by the wider ones (g, mu, cov, inv)."""
        of = rows.select("peer", "name", "wide").join(wider.select(F.col("g").alias("wide"), "mu", "cov", "inv"), "wide")
        own = passed.select("peer", *FEATURES).join(of.select("peer", "name", "mu", "inv"), "peer").where(_distance() <= cutoff)
        sums = own.groupBy("name").agg(F.count("*").alias("n"), *_sums([F.col(c) for c in FEATURES]))
        base = of.select("name", "mu", "cov").dropDuplicates(["name"]).join(sums, "name", "left").withColumnRenamed("name", "g").withColumn("k", F.lit(0))
        return stash.save(base.fillna(0, ["n", *_SUMS]).mapInPandas(_lean, _ESTIMATE), label)

    small = members.where(F.col("n") < LEAST_ROWS)
    few = small.where(F.col("n_wide") < LEAST_ROWS).select("peer", F.col("wide").alias("name"), F.lit("*").alias("wide"))
    every = members.where(F.col("n_wide") < LEAST_ROWS).select("peer", F.col("wide").alias("name"), F.lit("*").alias("wide"))
    languages = params.where("g like 'l:%'")
    if not few.isEmpty():
        languages = languages.union(lean("languages", F.col("wide"), every, params.where("g = '*'")))
    peers = params.where("g like 'p:%'").withColumn("own", F.lit(True))
    if not small.isEmpty():
        peers = peers.union(lean("peers", F.col("peer"), small.select("peer", F.concat(F.lit("p:"), "peer").alias("name"), "wide"), languages).withColumn("own", F.lit(False)))
    return stash.save(peers.select(F.expr("substr(g, 3)").alias("peer"), "mu", "inv", "own"), "by_peer")


def _restate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Inverses and determinants of corrected scatters."""
    for f in frames:
        yield _rows([_estimate(r["g"], r["k"], r["rows"], np.array(r["mu"]), np.array(r["cov"]).reshape(P, P)) for r in f.to_dict("records")])


def _upper(x: float, df: int) -> float:
    """Share of the chi-square distribution above x, by its series."""
    a, y = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= y / k
        total += term
    return 1 - total * math.exp(-y + a * math.log(y) - math.lgamma(a))
