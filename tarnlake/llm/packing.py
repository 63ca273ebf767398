"""Packing of documents into training windows by minimum bin slack.

A document's ids are cut at multiples of the window; whole windows are sequences of their own. The remainders are dealt
into buckets by hash. In a bucket a window takes the longest remainder that is left and then the multiset of other
remainders that fills it best: a subset-sum programme over bit sets, one shift for each length and power of two of its
count, with the counts found by going back through its steps. Where even the best multiset leaves more than a few places, the
window is closed by a piece of the next remainder, whose rest goes back to the others: so only the last window of a bucket can
stay short.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LibraryVocabulary, encode_batches
from .common import Stash, small_batches

#: Remainders of one bucket, about.
BUCKET_DOCS = 1024


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[length] of each, whose sum is largest without exceeding capacity."""
    reach, mask, steps = 1, (2 << capacity) - 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            grown = (reach | reach << (k * length)) & mask
            if grown != reach:
                steps.append((length, k, reach))
                reach = grown
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] += k
            total -= k * length
    return used


class Piece(NamedTuple):
    """Part of an item: its number, where the part begins, and its length."""

    item: int
    begin: int
    length: int


def pack_lengths(lengths: list[int], window: int, slack: int = 0) -> list[list[Piece]]:
    """Groups of pieces, each with a sum of at most window and, but for the last group, of at least window - slack. Every item
    (0 < length <= window) is in the groups as a whole; one item is cut for each window that no multiset closes."""
    of: dict[int, list[Piece]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        of[lengths[i]].append(Piece(i, 0, lengths[i]))
    counts = {k: len(v) for k, v in of.items()}
    longest, groups = [-k for k in counts], []
    heapq.heapify(longest)

    def take(length: int) -> Piece:
        counts[length] -= 1
        return of[length].pop()

    def top() -> int:
        """The longest length that is left, 0 if there is none."""
        while longest and not counts[-longest[0]]:
            del counts[-heapq.heappop(longest)]
        return -longest[0] if longest else 0

    while length := top():
        group = [take(length)]
        for other, k in best_fill(counts, window - length).items():
            group += [take(other) for _ in range(k)]
        free = window - sum(x.length for x in group)
        if free > slack and (length := top()):
            # Nothing that is left fits into the free places, so all of it is longer.
            item, begin, _ = take(length)
            group.append(Piece(item, begin, free))
            rest = length - free
            of[rest].append(Piece(item, begin + free, rest))
            if rest not in counts:
                heapq.heappush(longest, -rest)
            counts[rest] = counts.get(rest, 0) + 1
        groups.append(group)
    return groups


def _measure(tables, window: int, end_id: int):
    def run(batches):
        for rows, ids, first in encode_batches(batches, tables.value):
            raw = np.insert(ids, first[1:], end_id).astype("<u4")
            whole, tail, size = [], [], []
            for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                own = raw[a + k : b + k + 1]
                n = len(own) // window * window
                size.append(len(own))
                whole.append([zlib.crc32(own[i : i + window]) for i in range(0, n, window)])
                rest = own[n:]
                tail.append((rest if rest.max(initial=0) > 0xFFFF else rest.astype("<u2")).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(size, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(tail, pa.binary())], ["key", "doc_tokens", "whole", "tail"])

    return run


def _pack_bucket(window: int, slack: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_tokens", "tail"], kind="stable", na_position="first")  # ids come as strings: a null must not turn them into floats
        docs = list(zip(pdf["key"].tolist(), pdf["doc_tokens"].tolist(), pdf["whole"].tolist(), pdf["tail"].tolist(), strict=True))
        out, sequence = [], int(key[0]) << 32
        for doc, n, whole, _ in docs:
            for k, crc in enumerate(whole):
                out.append((doc, k * window, window, crc, n, sequence, 0))
                sequence += 1
        items = [(doc, n, tail) for doc, n, _, tail in docs if n % window]
        for group in pack_lengths([n % window for _, n, _ in items], window, slack):
            place = 0
            for i, begin, length in group:
                doc, n, tail = items[i]
                rest = np.frombuffer(tail, "<u2" if len(tail) == 2 * (n % window) else "<u4")
                out.append((doc, n - n % window + begin, length, zlib.crc32(rest[begin : begin + length].astype("<u4")), n, sequence, place))
                place += length
            sequence += 1
        return pd.DataFrame(out, columns=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(df: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, slack: int = 8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Packs all documents; one row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; null and empty texts are that one id; texts of any length are cut at multiples of the window.
    A sequence has at most slack free places, but for one in each bucket. Rows with one id are documents of their own, also if their
    texts are equal; other columns of df, whatever their names, have no part in this; an empty table gives no row."""
    spark = df.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(LibraryVocabulary.load(tokenizer_path))
    kind = df.schema[id_col].dataType.simpleString()
    stash = Stash(spark, "packing")
    sized = stash.save(df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(_measure(tables, window, end_id), f"key {kind}, doc_tokens long, whole array<long>, tail binary"), "sized")
    buckets = max(1, -(-sized.count() // BUCKET_DOCS))
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("key", "tail", "doc_tokens"), F.lit(buckets)))
    packed = dealt.withColumn("key", F.col("key").cast("string")).groupBy("bucket").applyInPandas(_pack_bucket(window, slack), "key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.select(F.col("key").cast(kind).alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
