"""Vectorised kernels over the UTF-8 bytes of whole Arrow batches: words, spans and their 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that a kernel works on at once (a longer document is a chunk of its own).
CHUNK_BYTES = (2 << 20) - 64

# Separators of words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Masks of the lowest 0 .. 8 bytes of a number.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and int64 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, bytes and offsets of each chunk of a batch."""
    buf, off = column_bytes(batch.column(column))
    for i, j in chunks(off, limit):
        yield slice(i, j), buf[off[i] : off[j]], off[i : j + 1] - off[i]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a document's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each document's first word (one more at the end)."""
    s, e = spans(~IS_SPACE[buf], off)
    return s, e, np.searchsorted(s, off)


#: Odd multipliers of the words of a window, without a rule between them.
_FACTORS = mix(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def span_blocks(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each span as numbers of eight bytes, the last one filled up with zeros; and each span's first number (one more at the end)."""
    n = (e - s + 7) >> 3
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(s, n) + 8 * repeat_index(np.zeros(len(n), np.int64), n)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    every = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    return every[at] & _LOW_BYTES[np.minimum(np.repeat(e, n) - at, 8)], first


def block_hash(blocks: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of spans from their span_blocks() and lengths: a sum of blocks mixed with their place, so that no arrangement of
    the same bytes is favoured. Unequal spans share a hash with odds of 2^-64 a pair."""
    n = np.diff(first)
    place = (repeat_index(np.zeros(len(n), np.int64), n) + 1).astype(U64)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(mix(blocks + U64(0x9E3779B97F4A7C15)) + place * U64(0xC2B2AE3D27D4EB4F)))])
    return mix(total[first[1:]] - total[first[:-1]] + length.astype(U64) * U64(0xD6E8FEB86659FD93))


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    return block_hash(*span_blocks(buf, s, e), e - s)


def unlike(blocks: np.ndarray, first: np.ndarray, length: np.ndarray, others: np.ndarray, other_first: np.ndarray, other_length: np.ndarray) -> np.ndarray:
    """Numbers of the spans whose bytes differ from those of their counterpart, given by its first place in others and its length."""
    n = np.diff(first)
    at = repeat_index(np.where(length == other_length, other_first, 0), np.where(length == other_length, n, 0))
    mine = blocks if len(at) == len(blocks) else blocks[np.repeat(length == other_length, n)]
    wrong = np.flatnonzero(mine != others[at])
    out = np.flatnonzero(length != other_length)
    if len(wrong):
        owner = np.repeat(np.arange(len(n)), np.where(length == other_length, n, 0))
        out = np.union1d(out, owner[wrong])
    return out


def distinct(buf: np.ndarray, s: np.ndarray, e: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of one span of each distinct content, and each span's number among those. Hashes find equals, bytes decide. known may
    have the spans' blocks, firsts and hashes."""
    length = e - s
    blocks, first = span_blocks(buf, s, e) if known is None else known[:2]
    h = block_hash(blocks, first, length) if known is None else known[2]
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(h) else np.zeros(0, bool)
    one, which = order[new], np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    odd = unlike(blocks, first, length, blocks, first[one[which]], length[one[which]])
    if len(odd):  # one hash, different bytes
        seen: dict[bytes, int] = {}
        for k in odd.tolist():
            which[k] = seen.setdefault(buf[s[k] : e[k]].tobytes(), len(one) + len(seen))
        extra = np.empty(len(seen), np.int64)
        extra[which[odd][::-1] - len(one)] = odd[::-1]
        one = np.concatenate([one, extra])
    return one, which


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size consecutive words within a document, and the index of each run's first word."""
    n = len(h)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    count = np.diff(first)
    room = np.repeat(first[1:], count)[: n - size + 1] - np.arange(n - size + 1) >= size
    at = np.flatnonzero(room)
    out = np.zeros(n - size + 1, U64)
    for k in range(size):
        out += (h * _FACTORS[k])[k : n - size + 1 + k]
    return mix(out[at] + U64(size)), at


def repeat_index(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + counts[i]."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)
