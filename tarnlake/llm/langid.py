"""Language identification: scripts narrow the candidates, a Viterbi pass with a switching penalty labels the words.

A language is known by the frequencies of hashed byte n-grams of its words. The counts are made where the labelled rows
lie; only one table of fixed size for each language reaches the driver. A word's script (by the ranges of its lead bytes)
leaves those languages that use the script; the best path through a text's word scores pays for each change of language,
so that spans and not single words are labelled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkern as tk
from .common import Stash, small_batches

#: Slots of a language's table, lengths of n-grams, bytes of the parts that longer words are taken in.
TABLE_BITS, GRAMS, WORD_BYTES = 16, (1, 2, 3, 4), 32
#: Labelled rows that a model is fitted on at most (about; rows are chosen by hash), in equal shares of the languages; and the share
#: that each language has at least, however many languages there are.
FIT_ROWS, LANGUAGE_ROWS = 20_000, 500
#: Log odds that a change of language costs, and the least share of a language's letters that makes a script its own.
SWITCH, OWN_SCRIPT = 6.0, 1e-3

# Scripts by the first code point of their ranges (0: no letters).
SCRIPT_RANGES = ((0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00C0, 1), (0x0250, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 7), (0x0900, 8), (0x0980, 9), (0x0A00, 10), (0x0A80, 11), (0x0B00, 12), (0x0B80, 13), (0x0C00, 14), (0x0C80, 15), (0x0D00, 16), (0x0E00, 17), (0x0E80, 18), (0x0F00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x1780, 24), (0x1800, 25), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2DE0, 3), (0x2E00, 0), (0x3040, 26), (0x3100, 0), (0x3130, 22), (0x3190, 0), (0x3400, 27), (0xA000, 0), (0xA720, 1), (0xA800, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 27), (0xFB00, 0), (0xFB50, 6), (0xFE00, 0), (0x20000, 27), (0x30000, 0))
#: Letters of any other range; no language has them for its own, so all stay candidates.
OTHER_SCRIPT, N_SCRIPTS = 28, 29

_SLOT = np.uint64((1 << TABLE_BITS) - 1)


@lru_cache(1 << 16)
def _script(code: int, listed: int) -> int:
    """Script of a code point whose range has the script listed."""
    return (listed or OTHER_SCRIPT) if chr(code).isalpha() else 0


def word_scripts(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Script of each word: that of its first letter, 0 if it has none."""
    n = len(buf)
    b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
    script = np.zeros(n, np.uint8)
    begin, own = (np.array(x) for x in zip(*SCRIPT_RANGES, strict=True))
    script[:] = own[np.searchsorted(begin, np.arange(128), "right") - 1][np.minimum(buf, 127)]
    script[buf >= 128] = 0
    lead = np.flatnonzero(buf >= 0xC2)
    if len(lead):
        x, y, z, u = (b[lead + k] & (63 if k else 255) for k in range(4))
        code = np.where(x < 0xE0, (x & 31) << 6 | y, np.where(x < 0xF0, (x & 15) << 12 | y << 6 | z, (x & 7) << 18 | y << 12 | z << 6 | u))
        codes, which = np.unique(np.minimum(code, 0x10FFFF), return_inverse=True)
        listed = own[np.searchsorted(begin, codes, "right") - 1]
        script[lead] = np.array([_script(c, k) for c, k in zip(codes.tolist(), listed.tolist(), strict=True)], np.uint8)[which]
    letters = np.flatnonzero(script)
    first = np.searchsorted(letters, s)
    at = letters[np.minimum(first, max(0, len(letters) - 1))] if len(letters) else np.zeros(len(s), np.int64)
    return np.where((first < len(letters)) & (at < e), script[at] if len(letters) else 0, 0) if len(s) else np.zeros(0, np.uint8)


def gram_slots(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of the words' n-grams, and the number of each one's word. A word is lower-cased and stands between blanks; words beyond
    WORD_BYTES bytes (scripts without blanks, names of files) are taken in parts of that size, all of them."""
    parts = np.maximum(1, -(-(e - s) // WORD_BYTES))
    parent = np.repeat(np.arange(len(s)), parts)
    s = s[parent] + WORD_BYTES * tk.repeat_index(np.zeros(len(parts), np.int64), parts)
    keep = np.minimum(s + WORD_BYTES, e[parent]) - s
    width = int(keep.max(initial=0)) + 2
    grid = np.full((len(s), width), 0x20, np.uint64)
    for k in range(width - 2):
        who = np.flatnonzero(keep > k)
        grid[who, k + 1] = tk.LOWER[buf[s[who] + k]]
    for n in GRAMS:
        if width < n:
            continue
        h = np.full((len(s), width - n + 1), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0xC6A4A7935BD1E995) + grid[:, k : width - n + 1 + k]
        row, place = np.nonzero(np.arange(width - n + 1) <= (keep + 2 - n)[:, None])
        yield (tk.mix(h[row, place]) & _SLOT).astype(np.int64), parent[row]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language of a partition: its n-gram counts and its words by script."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows, buf, off in tk.text_chunks(batch, "text"):
            lang = np.array(batch.column("lang").slice(rows.start, rows.stop - rows.start).to_pylist(), object)
            s, e, first = tk.words(buf, off)
            script = word_scripts(buf, s, e)
            per_doc = np.diff(first)
            for name in set(lang.tolist()):
                mine = np.repeat(lang == name, per_doc) & (script > 0)
                own_s, own_e = s[mine], e[mine]
                table = counts.setdefault(name, np.zeros((1 << TABLE_BITS) + N_SCRIPTS, np.int64))
                table[1 << TABLE_BITS :] += np.bincount(script[mine], minlength=N_SCRIPTS)
                if len(own_s):
                    one, which = tk.distinct(buf, own_s, own_e)
                    times = np.bincount(which, minlength=len(one))
                    for slot, row in gram_slots(buf, own_s[one], own_e[one]):
                        table[: 1 << TABLE_BITS] += np.bincount(slot, weights=times[row], minlength=1 << TABLE_BITS).astype(np.int64)
    press = zstandard.ZstdCompressor(level=1)
    if counts:
        yield pa.RecordBatch.from_pydict({"lang": list(counts), "table": [press.compress(t.tobytes()) for t in counts.values()]})


def _add_tables(pdf: pd.DataFrame) -> pd.DataFrame:
    un = zstandard.ZstdDecompressor()
    total = sum(np.frombuffer(un.decompress(t), np.int64) for t in pdf["table"])
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "table": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})


class LanguageModel:
    """Log probabilities of n-gram slots by language, and the languages of each script."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.names = sorted(tables)
        grams = np.array([tables[k][: 1 << TABLE_BITS] for k in self.names], float).reshape(len(self.names), 1 << TABLE_BITS) + 0.5
        self.score = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32).copy()
        scripts = np.array([tables[k][1 << TABLE_BITS :] for k in self.names], float).reshape(len(self.names), N_SCRIPTS)
        self.uses = (scripts / np.maximum(1, scripts.sum(1, keepdims=True)) >= OWN_SCRIPT).T.copy()
        self.uses[~self.uses.any(1)] = True  # a script that no language has: all stay

    def word_scores(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, script: np.ndarray) -> np.ndarray:
        """Log score of each word in each language, 0 for the best; languages of other scripts are out of reach, words without letters tell nothing."""
        out = np.zeros((len(s), len(self.names)))
        for slot, row in gram_slots(buf, s, e):
            for k in range(len(self.names)):
                out[:, k] += np.bincount(row, weights=self.score[slot, k], minlength=len(s))
        out /= len(GRAMS)  # n-grams of one word overlap: their logs must not count in full
        out[~self.uses[script]] -= 50.0
        out -= out.max(1, keepdims=True)
        out[script == 0] = 0
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word, by document (first: their first words). Documents go in step, the longest first."""
    n_docs, k = len(first) - 1, scores.shape[1]
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    label = np.zeros(len(scores), np.int64)
    steps = int(length[0]) if n_docs else 0
    if k < 2 or not steps:
        return label
    alive = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
    best = scores[start[: alive[0]]].copy()
    came = np.empty((len(scores), k), np.int16)
    own = np.arange(k)
    for t in range(1, steps):
        n = alive[t]
        now = best[:n]
        top = now.argmax(1)
        jump = now[np.arange(n), top] - switch
        stay = now >= jump[:, None]
        at = start[:n] + t
        came[at] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, now, jump[:, None]) + scores[at]
    state = np.zeros(n_docs, np.int64)
    state[: alive[0]] = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = start[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return label


def label_words(model: LanguageModel, buf: np.ndarray, off: np.ndarray, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and scripts of a chunk's words, the documents' first words, and the words' languages."""
    s, e, first = tk.words(buf, off)
    script = word_scripts(buf, s, e)
    one, which = tk.distinct(buf, s, e)
    scores = model.word_scores(buf, s[one], e[one], script[one])
    return s, e, script, first, viterbi(scores[which], first, switch)


def _predict(model, switch: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        k = len(m.names)
        for batch in batches:
            if not k:  # nothing was learned
                columns = [batch.column("key"), pa.array(["und"] * batch.num_rows, pa.string()), pa.array(np.zeros(batch.num_rows)), pa.array([[]] * batch.num_rows, SPAN_TYPE)]
                yield pa.RecordBatch.from_arrays(columns[: 3 + spans], ["key", "lang_pred", "score", "spans"][: 3 + spans])
                continue
            for rows, buf, off in tk.text_chunks(batch, "text"):
                part = batch.slice(rows.start, rows.stop - rows.start)
                n = rows.stop - rows.start
                s, e, script, first, label = label_words(m, buf, off, switch)
                doc = np.repeat(np.arange(n), np.diff(first))
                weight = np.where(script > 0, e - s, 0)
                share = np.bincount(doc * k + label, weights=weight, minlength=n * k).reshape(n, k)
                total = share.sum(1)
                top = share.argmax(1)
                names = [m.names[i] if letters else "und" for i, letters in zip(top, total, strict=True)]
                score = np.where(total > 0, share[np.arange(n), top] / np.maximum(1, total), 0.0)
                columns = [part.column("key"), pa.array(names, pa.string()), pa.array(score)]
                if spans:
                    columns.append(pa.array([_spans_of(m, s, e, label, buf, off[i], a, b) for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))], SPAN_TYPE))
                yield pa.RecordBatch.from_arrays(columns, ["key", "lang_pred", "score", "spans"][: len(columns)])

    return run


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _spans_of(m, s, e, label, buf, base, a, b) -> list[dict]:
    """Runs of one language as code point ranges."""
    if a == b:
        return []
    cut = np.flatnonzero(np.diff(label[a:b])) + 1
    lead = (buf & 0xC0) != 0x80
    place = lambda x: int(lead[base:x].sum())
    return [{"start": place(s[a + i]), "end": place(e[a + j - 1]), "lang": m.names[label[a + i]]} for i, j in zip([0, *cut], [*cut, b - a], strict=True)]


def keep_languages(df: DataFrame, least_share: float, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", folds: int = 3, held: int = 1, switch: float = SWITCH, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of df, with all columns, whose text has a language with a score of least_share or more. Rows are judged where they
    lie: nothing is joined or shuffled."""
    spark = df.sparkSession
    small_batches(spark)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds == held
    model = spark.sparkContext.broadcast(fit_language_model(df.where(~held_out), text_col, lang_col, id_col, fit_rows))
    predict, at = _predict(model, switch, False), df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["key", "text"])
            keep = np.zeros(batch.num_rows, bool)
            for part in predict(iter([own])):
                good = np.array([x != "und" for x in part.column("lang_pred").to_pylist()], bool) & (part.column("score").to_numpy() >= least_share)
                keep[part.column("key").to_numpy()] = good
            if keep.any():
                yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def fit_language_model(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fits on rows with a text and a language: of each language all rows, or a share of about fit_rows / languages (LANGUAGE_ROWS at
    least) chosen by a hash of the id, so that a rare language is learned from all its rows in a table of any size."""
    small_batches(df.sparkSession)
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("mark"))
    n = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language, as the model has
    share = max(LANGUAGE_ROWS, fit_rows // max(1, len(n)))
    rare = F.pmod("mark", F.lit(1 << 20))
    for r in n:
        if r["n"] > share:
            rows = rows.where((F.col("lang") != r["lang"]) | (rare < math.ceil(share / r["n"] * (1 << 20))))
    counted = rows.select("text", "lang").mapInArrow(_count_grams, "lang string, table binary")
    un = zstandard.ZstdDecompressor()
    merged = counted.groupBy("lang").applyInPandas(_add_tables, "lang string, table binary")
    return LanguageModel({r["lang"]: np.frombuffer(un.decompress(bytes(r["table"])), np.int64) for r in merged.collect()})


def identify_languages(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", folds: int = 3, held: int = 1, switch: float = SWITCH, fit_rows: int = FIT_ROWS, spans: bool = False) -> DataFrame:
    """One row per document: id_col, held_out boolean, lang_pred string, score double (and spans, if asked for).

    Rows whose crc32(id as text) mod folds is held are never learned from. Null texts and texts without a letter are und with
    score 0; without any labelled row all texts are und. Letters of a script that no language uses are scored by their n-grams in
    all languages. The score is the share of the letters' bytes in words of lang_pred. Texts of any length are read whole. Ties go
    to the first language by name; repeated rows get equal results; other columns of df, whatever their names, have no part in
    this; an empty table gives no row."""
    spark = df.sparkSession
    small_batches(spark)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds == held
    model = spark.sparkContext.broadcast(fit_language_model(df.where(~held_out), text_col, lang_col, id_col, fit_rows))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_predict(model, switch, spans), f"key {kind}, lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans)
    held_key = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(0)) % folds == held
    return out.select(F.col("key").alias(id_col), held_key.alias("held_out"), "lang_pred", "score", *(["spans"] if spans else []))
