"""Postings as packed arrays: map tasks send one blob for each bucket, reduce tasks get a bucket's blobs as arrays again."""

from __future__ import annotations

import json
import struct

import numpy as np


def pack_arrays(*arrays: np.ndarray) -> bytes:
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    return struct.pack("<I", len(head)) + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    size = struct.unpack_from("<I", data)[0]
    at, out = 4 + size, []
    for kind, n in json.loads(data[4 : 4 + size]):
        out.append(np.frombuffer(data, np.dtype(kind), n, at))
        at += out[-1].nbytes
    return out


def to_short(x: np.ndarray, width: int) -> np.ndarray:
    """The lowest bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def from_short(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = x.reshape(-1, width)
    return out.reshape(-1).view("<u8")


def to_five(x: np.ndarray) -> np.ndarray:
    """The lowest 40 bits of each number as five bytes."""
    return to_short(x, 5)


def from_five(x: np.ndarray) -> np.ndarray:
    return from_short(x, 5)


def narrow(x: np.ndarray) -> list[np.ndarray]:
    """Small counts as single bytes; places and values of those beyond 254."""
    far = np.flatnonzero(x > 254)
    return [np.minimum(x, 255).astype(np.uint8), far.astype(np.int64), x[far].astype(np.int64)]


def widen(small: np.ndarray, far: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[far] = value
    return out


def sum_by(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order, and their sums."""
    if not len(key):
        return key, *counts
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[begin], *(np.add.reduceat(c[order], begin) for c in counts)


def cut_points(bucket_of_sorted: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run of equal bucket numbers."""
    if not len(bucket_of_sorted):
        return []
    cut = np.flatnonzero(np.diff(bucket_of_sorted)) + 1
    return [(int(bucket_of_sorted[a]), int(a), int(b)) for a, b in zip([0, *cut], [*cut, len(bucket_of_sorted)], strict=True)]
