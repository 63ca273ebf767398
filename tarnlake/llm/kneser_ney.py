"""Interpolated modified Kneser-Ney language model of order 2, counted in Spark and memory-mapped by the scoring workers.

Words are known by 64-bit hashes. Counts are postings in buckets of the hash space, combined in the map tasks, summed in
one reduce task a bucket and written as sorted arrays under the shared folder. A bucket of bigrams is chosen by the
context's hash; the few contexts that alone would fill a good part of a bucket are dealt by the hash of the whole bigram,
and their sums are put together afterwards. Scoring looks up each chunk's distinct tokens and bigrams by binary search in
mapped files, one for each bucket and kind, so a worker holds no more of the model than the pages it touches.

In bigrams, words count as equal if the upper 40 bits of their hashes are; single counts use all 64 bits.
"""

from __future__ import annotations

import json
import mmap
import struct
import sys
import tempfile
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkern as tk
from .blobs import cut_points, from_five, narrow, pack_arrays, sum_by, to_five, unpack_arrays, widen
from .common import Stash, open_folder, partitions, put_file, small_batches

U64 = np.uint64
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: Bytes of training text for each bucket, about; tokens that a map task gathers before it sends them; hot contexts at most.
BUCKET_BYTES, FLUSH_TOKENS, HOT_WORDS = 16 << 20, 1_500_000, 1024
#: Files that a worker holds mapped at once (Linux lets a process have 65,530 maps); those used last stay.
MAPPED_FILES = 16_384


def token_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a chunk, an end after each document, and the documents' first tokens."""
    low = tk.LOWER[buf]
    s, e, first = tk.words(low, off)
    h = tk.span_hash(low, s, e)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[first[:-1]] = START
    return out


def pair_keys(context: np.ndarray, word: np.ndarray, bits: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of bigrams of 40-bit hashes, whose upper bits are the bucket, and the bucket."""
    g = tk.mix(context * U64(0x9E3779B97F4A7C15) + word)
    if not bits:
        return g, np.zeros(len(g), np.int64)
    place = np.searchsorted(hot, context)
    is_hot = hot[np.minimum(place, max(0, len(hot) - 1))] == context if len(hot) else np.zeros(len(g), bool)
    bucket = np.where(is_hot, g >> U64(64 - bits), context >> U64(40 - bits))
    return (g >> U64(bits)) | (bucket << U64(64 - bits)), bucket.astype(np.int64)


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send():
            key, n = sum_by(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            return _rows([(k, pack_arrays(key[a:b], *narrow(n[a:b]))) for k, a, b in cut_points(bucket_of(key, bits))])

        for batch in batches:
            for _, buf, off in tk.text_chunks(batch, "text"):
                h, _ = token_hashes(buf, off)
                held.append(sum_by(h, np.ones(len(h), np.int64)))
                if sum(len(x[0]) for x in held) > FLUSH_TOKENS:
                    yield send()
                    held = []
        if held:
            yield send()

    return run


def _store(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays as one file: the length of a head, the head with their kinds and lengths, and each from a multiple of eight bytes on."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    parts = [struct.pack("<Q", len(head)), head, bytes(-len(head) % 8)]
    for a in arrays:
        data = np.ascontiguousarray(a).tobytes()
        parts += [data, bytes(-len(data) % 8)]
    put_file(folder, name, parts)


def _stored(held: mmap.mmap) -> list[np.ndarray]:
    """The arrays of a file of _store(), as views."""
    size = struct.unpack_from("<Q", held)[0]
    at, out = 8 + size + -size % 8, []
    for kind, n in json.loads(held[8 : 8 + size]):
        out.append(np.frombuffer(held, np.dtype(kind), n, at))
        at += out[-1].nbytes + -out[-1].nbytes % 8
    return out


def _mapped(f) -> mmap.mmap:
    """A file's bytes; where Python can, without holding a descriptor."""
    return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))


def _sum_words(folder: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_arrays(x) for x in pdf["blob"]]
        word, n = sum_by(np.concatenate([p[0] for p in parts]), np.concatenate([widen(*p[1:4]) for p in parts]))
        _store(folder, f"words-{int(key[0])}", word, n)
        total = int(n.sum())
        hot = n * 8 > total
        return pd.DataFrame({"tokens": [total], "distinct": [len(word)], "hot": [word[hot].astype(np.int64).tolist()], "hot_n": [n[hot].tolist()]})

    return run


def _count_pairs(bits: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send():
            context, word = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            g, bucket = pair_keys(context, word, bits, hot)
            order = np.argsort(g)
            g = g[order]
            begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            n = np.diff(np.append(begin, len(g)))
            one = order[begin]
            context, word, bucket = context[one], word[one], bucket[one]
            # By bucket and context: a context is sent once with the number of its words. (40 bits of context leave room for 24 of bucket.)
            order = np.argsort(context | bucket.astype(U64) << U64(40))
            context, word, bucket, n = context[order], word[order], bucket[order], n[order]
            out = []
            for k, a, b in cut_points(bucket):
                runs = np.flatnonzero(np.append(True, context[a + 1 : b] != context[a : b - 1]))
                out.append((k, pack_arrays(to_five(context[a:b][runs]), *narrow(np.diff(np.append(runs, b - a))), to_five(word[a:b]), *narrow(n[a:b]))))
            return _rows(out)

        for batch in batches:
            for _, buf, off in tk.text_chunks(batch, "text"):
                h, first = token_hashes(buf, off)
                held.append((contexts(h, first) >> U64(24), h >> U64(24)))
                if sum(len(x[0]) for x in held) > FLUSH_TOKENS:
                    yield send()
                    held = []
        if held:
            yield send()

    return run


def _tally(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


def _sum_pairs(folder: str, bits: int, hot: np.ndarray):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        context, word, n = [], [], []
        for x in pdf["blob"]:
            p = unpack_arrays(x)
            context.append(np.repeat(from_five(p[0]), widen(*p[1:4])))
            word.append(from_five(p[4]))
            n.append(widen(*p[5:8]))
        context, word, n = (np.concatenate(x) for x in (context, word, n))
        g, _ = pair_keys(context, word, bits, hot)
        order = np.argsort(g)
        g = g[order]
        begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        n, context, word = np.add.reduceat(n[order], begin), context[order[begin]], word[order[begin]]
        _store(folder, f"pairs-{int(key[0])}", g[begin], *narrow(n))
        each, total, n1, n2, n3, _ = sum_by(context, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64), np.ones(len(n), np.int64))
        is_hot = np.isin(each, hot)
        _store(folder, f"contexts-{int(key[0])}", each[~is_hot], *(y for c in (total, n1, n2, n3) for y in narrow(c[~is_hot])))
        rows = [("hot", -1, b"", [int(c), *map(int, v)]) for c, v in zip(each[is_hot].astype(np.int64), np.stack([total, n1, n2, n3], 1)[is_hot], strict=True)]
        rows.append(("tally", -1, b"", _tally(n)))
        ends, left = sum_by(word, np.ones(len(word), np.int64))
        for k, a, b in cut_points((ends >> U64(40 - bits)).astype(np.int64) if bits else np.zeros(len(ends), np.int64)):
            rows.append(("ends", k, pack_arrays(to_five(ends[a:b]), *narrow(left[a:b])), []))
        return pd.DataFrame(rows, columns=["kind", "bucket", "blob", "nums"])

    return run


def _sum_ends(folder: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_arrays(x) for x in pdf["blob"]]
        word, n = sum_by(np.concatenate([from_five(p[0]) for p in parts]), np.concatenate([widen(*p[1:4]) for p in parts]))
        _store(folder, f"ends-{int(key[0])}", word, *narrow(n))
        return pd.DataFrame({"distinct": [len(word)], "total": [int(n.sum())], "nums": [_tally(n)], "more": [int((n > 2).sum())]})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more from the numbers of counts 1 to 4; 0.5, 1 and 1.5 where these are too few to tell."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.01, np.array([0, 0.99, 1.99, 2.99]))


@dataclass
class KneserNey:
    """What a worker needs besides the mapped files: their folder and sums of fixed size."""

    folder: str
    bits: int
    tokens: int
    distinct: int
    pair_discount: np.ndarray
    end_discount: np.ndarray
    end_total: int
    end_rest: float
    hot: np.ndarray
    hot_sums: np.ndarray
    maps: OrderedDict = field(default_factory=OrderedDict)

    def __getstate__(self):
        return self.__dict__ | {"maps": OrderedDict()}

    def _map(self, name: str) -> list[np.ndarray] | None:
        """Arrays of a file, mapped from the shared folder (copied first if that is no mounted folder); None if there is none."""
        if name in self.maps:
            self.maps.move_to_end(name)
            return self.maps[name]
        fs, folder = open_folder(self.folder)
        path, out = f"{folder}/{name}", None
        if fs.get_file_info(path).type.name != "NotFound":
            if fs.type_name == "local":
                with open(path, "rb") as f:
                    out = _stored(_mapped(f))
            else:
                with fs.open_input_stream(path) as f, tempfile.TemporaryFile() as copy:
                    while block := f.read(1 << 22):
                        copy.write(block)
                    copy.flush()
                    out = _stored(_mapped(copy))
        self.maps[name] = out
        if len(self.maps) > MAPPED_FILES:
            self.maps.popitem(last=False)
        return out

    def _look(self, group: str, key: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
        """Counts of sorted keys, 0 where there are none. Single-byte counts have their large values apart."""
        out = np.zeros((len(key), width), np.int64)
        for k, a, b in cut_points(bucket):
            held = self._map(f"{group}-{k}")
            if not held or not len(held[0]):
                continue
            at = np.minimum(np.searchsorted(held[0], key[a:b]), len(held[0]) - 1)
            hit = np.flatnonzero(held[0][at] == key[a:b])
            at = at[hit]
            if len(held) == 2:
                out[a + hit, 0] = held[1][at]
                continue
            for c in range(width):
                small, far, value = held[1 + 3 * c : 4 + 3 * c]
                own = small[at].astype(np.int64)
                big = np.flatnonzero(own == 255)
                if len(big):
                    own[big] = value[np.searchsorted(far, at[big])]
                out[a + hit, c] = own
        return out

    def word_counts(self, h: np.ndarray) -> np.ndarray:
        return self._look("words", h, bucket_of(h, self.bits), 1)[:, 0]

    def _short(self, group: str, h: np.ndarray, width: int) -> np.ndarray:
        return self._look(group, h, (h >> U64(40 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64), width)

    def word_probabilities(self, word: np.ndarray) -> np.ndarray:
        """Lower order: of sorted 40-bit words, by the number of words they follow."""
        n = self._short("ends", word, 1)[:, 0]
        floor = 1 / (self.distinct + 1)
        if not self.end_total:
            return np.full(len(word), floor)
        return (np.maximum(0, n - self.end_discount[np.minimum(n, 3)])) / self.end_total + self.end_rest / self.end_total * floor

    def context_sums(self, context: np.ndarray) -> np.ndarray:
        out = self._short("contexts", context, 4)
        if len(self.hot):
            place = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            own = self.hot[place] == context
            out[own] = self.hot_sums[place[own]]
        return out

    def score(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token of a chunk."""
        word, context = h >> U64(24), contexts(h, first) >> U64(24)
        g, bucket = pair_keys(context, word, self.bits, self.hot)
        order = np.argsort(g)
        g = g[order]
        new = np.append(True, g[1:] != g[:-1])
        one = order[new]
        n = self._look("pairs", g[new], bucket[one], 1)[:, 0]
        words, w_at = np.unique(word[one], return_inverse=True)
        ctx, c_at = np.unique(context[one], return_inverse=True)
        low = self.word_probabilities(words)[w_at]
        sums = self.context_sums(ctx)
        total = np.maximum(1, sums[:, 0])
        rest = np.where(sums[:, 0] > 0, (sums[:, 1:] * self.pair_discount[1:]).sum(1) / total, 1.0)
        p = np.maximum(0, n - self.pair_discount[np.minimum(n, 3)]) / total[c_at] + rest[c_at] * low
        out = np.empty(len(h))
        out[order] = np.log10(p)[np.cumsum(new) - 1]
        return out


def fit_kneser_ney(texts: DataFrame, stash: Stash) -> KneserNey:
    """Counts the column text of a table and writes the model under stash."""
    spark, folder = texts.sparkSession, f"{stash.path}/model"
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, (max(partitions(spark), -(-size // BUCKET_BYTES)) - 1).bit_length())  # 24 bits: 256 TB of text
    words = texts.mapInArrow(_count_words(bits), "bucket int, blob binary").groupBy("bucket").applyInPandas(_sum_words(folder), "tokens long, distinct long, hot array<long>, hot_n array<long>")
    words = stash.save(words, "words")
    tokens, distinct = (x or 0 for x in words.select(F.sum("tokens"), F.sum("distinct")).first())
    hot_rows = words.select(F.explode(F.arrays_zip("hot", "hot_n")).alias("x")).select("x.hot", "x.hot_n").where(F.col("hot_n") > tokens / (4 << bits)).orderBy(F.desc("hot_n")).limit(HOT_WORDS).collect()
    hot = np.unique(np.array([r["hot"] for r in hot_rows] + [int(START) - (1 << 64), int(END)], np.int64).astype(U64) >> U64(24))
    pairs = texts.mapInArrow(_count_pairs(bits, hot), "bucket int, blob binary").groupBy("bucket").applyInPandas(_sum_pairs(folder, bits, hot), "kind string, bucket int, blob binary, nums array<long>")
    pairs = stash.save(pairs, "pairs")
    add = lambda df, n: [x or 0 for x in df.select(*(F.sum(F.col("nums")[k]) for k in range(n))).first()]
    pair_tally = add(pairs.where("kind = 'tally'"), 4)
    sums = pairs.where("kind = 'hot'").groupBy(F.col("nums")[0].alias("c")).agg(*(F.sum(F.col("nums")[k]).alias(f"s{k}") for k in range(1, 5))).orderBy("c").collect()
    ends = stash.save(pairs.where("kind = 'ends'").select("bucket", "blob").groupBy("bucket").applyInPandas(_sum_ends(folder), "distinct long, total long, nums array<long>, more long"), "ends")
    stash.drop("pairs")
    end_tally = add(ends, 4)
    end_total, more = (x or 0 for x in ends.select(F.sum("total"), F.sum("more")).first())
    d = discounts(end_tally)
    rest = float(d[1] * end_tally[0] + d[2] * end_tally[1] + d[3] * more)
    hot_sums = np.array([[r[f"s{k}"] for k in range(1, 5)] for r in sums], np.int64).reshape(-1, 4)
    # A hot context that no text has stays out.
    return KneserNey(folder, bits, int(tokens), int(distinct), discounts(pair_tally), d, int(end_total), rest, hot, _align(hot, np.array([r["c"] for r in sums], np.int64).astype(U64), hot_sums))


def _align(hot: np.ndarray, found: np.ndarray, sums: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hot), 4), np.int64)
    out[np.searchsorted(hot, found)] = sums
    return out


def score_documents(df: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    The model learns from rows where held_out is false. Null and empty texts are one end token; texts of any length are read whole.
    With nothing to learn from, every token has probability 1, and scores are 0. Repeated rows count each time; other columns of
    df, whatever their names, have no part in this; an empty table gives no row."""
    spark = df.sparkSession
    small_batches(spark)
    stash = Stash(spark, "kneser-ney")
    rows = df.select(F.col(id_col).alias("key"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = spark.sparkContext.broadcast(fit_kneser_ney(rows.where(~F.col("held_out")).select("text"), stash))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m: KneserNey = model.value
        for batch in batches:
            for part, buf, off in tk.text_chunks(batch, "text"):
                own = batch.slice(part.start, part.stop - part.start)
                h, first = token_hashes(buf, off)
                words, at = np.unique(h, return_inverse=True)
                n = m.word_counts(words)
                base = np.log10((n + 1) / (m.tokens + m.distinct + 1))
                each = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("held_out"), pa.array(np.diff(first)), pa.array(each((n > 0)[at].astype(np.int64))), pa.array(np.full(len(off) - 1, m.tokens)), pa.array(each(base[at])), pa.array(each(m.score(h, first)))], ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = rows.mapInArrow(run, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", id_col)
