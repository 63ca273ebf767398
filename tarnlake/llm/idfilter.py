"""A filter on whole-number ids, of fixed size: it may take an id for a member that is none, but never misses one.

It lets most rows go past a join: those that it rules out are no members, and only the rest has to be shuffled and compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkern import U64, mix

#: Bits (8 MB whatever the input), hash functions, and the parts that a filter is merged in.
FILTER_BITS, FILTER_HASHES, FILTER_PARTS = 26, 3, 64


def _places(key: np.ndarray) -> list[np.ndarray]:
    h = mix(key.astype(np.int64).view(U64))
    return [((h >> U64(20 * k)) * U64(0x9E3779B97F4A7C15 + 2 * k) >> U64(64 - FILTER_BITS)).astype(np.int64) for k in range(FILTER_HASHES)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = None
    for batch in batches:
        if bits is None:
            bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for at in _places(batch.column("id").to_numpy()):
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    if bits is not None:
        press = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(FILTER_PARTS), pa.int32()), pa.array([press.compress(x.tobytes()) for x in np.split(bits, FILTER_PARTS)], pa.binary())], ["part", "blob"])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    un = zstandard.ZstdDecompressor()
    whole = np.bitwise_or.reduce([np.frombuffer(un.decompress(x), np.uint8) for x in pdf["blob"]])
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "blob": [zstandard.ZstdCompressor(level=1).compress(whole.tobytes())]})


def id_filter(ids: DataFrame, column: str):
    """A broadcast filter of the column's values (whole numbers; nulls are left out)."""
    rows = ids.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("id"))
    parts = rows.mapInArrow(_parts, "part int, blob binary").groupBy("part").applyInPandas(_merge, "part int, blob binary").collect()
    un = zstandard.ZstdDecompressor()
    bits = np.concatenate([np.frombuffer(un.decompress(bytes(p["blob"])), np.uint8) for p in sorted(parts, key=lambda p: p["part"])]) if parts else np.zeros(1 << FILTER_BITS - 3, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits)


def members(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys may be members."""
    keep = np.ones(len(key), bool)
    for at in _places(key):
        keep &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


def rows_by_filter(shared, column: str, inside: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the rows that may be members (inside), or those that are none. Null ids are no members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = shared.value
        for batch in batches:
            ids = batch.column(column)
            keep = ids.is_valid().to_numpy(zero_copy_only=False)
            keep = keep & members(bits, ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
            if not inside:
                keep = ~keep
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def drop_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df without the rows whose id is in ids. Only rows that the filter takes for members go through the exact join."""
    shared = id_filter(ids, column)
    clear = df.mapInArrow(rows_by_filter(shared, column, False), df.schema)
    likely = df.mapInArrow(rows_by_filter(shared, column, True), df.schema)
    gone = ids.where(F.col(column).isNotNull()).select(column).distinct()
    return clear.unionByName(likely.join(gone.hint("merge"), column, "left_anti").select(df.columns))
