"""Byte-level BPE encoding and decoding on contiguous rank arrays.

A batch's texts are cut into words by a vectorised form of the tokenizer's split pattern. Each distinct word of the
batch is then encoded once: its parts and the ranks of adjacent pairs stand in contiguous arrays, the smallest rank is
found by a scan, the boundary it names is deleted and the two neighbouring ranks are looked up anew. Words of one byte
length are handled together, so that each of these steps is one array operation; words beyond LONG_WORD bytes keep
their ranks in a heap instead, because repeated scans are quadratic.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import textkern as tk
from .common import small_batches

#: Bytes beyond which a word's ranks are kept in a heap.
LONG_WORD = 64
NO_RANK = np.int32(2**31 - 1)

# Characters that the split pattern's \s takes.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that the split pattern takes with an apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L" or k == "N":
            out[c] = LETTER if k == "L" else NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself where printable in Latin-1, else the next from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Tables of one tokenizer, of fixed size: a two-choice hash table of ranks, merged ids by rank, and the bytes of all ids."""

    keys: np.ndarray
    ranks: np.ndarray
    bits: int
    merged: np.ndarray
    byte_ids: np.ndarray
    token_bytes: list[bytes]
    specials: dict[bytes, int] = field(default_factory=dict)
    mark: int = 0

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, symbols = spec["model"]["vocab"], spec["model"]["merges"], byte_symbols()
        raw = lambda t: bytes(symbols[c] for c in t)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        specials = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        tokens = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for t, i in vocab.items():
            tokens[i] = t.encode() if t.encode() in specials else raw(t)
        for t, i in specials.items():
            tokens[i] = t
        byte_ids = np.zeros(256, np.int32)
        for c, b in symbols.items():
            byte_ids[b] = vocab[c]
        bits = max(8, int(2.5 * len(key)).bit_length() - 1)
        keys, ranks = cls._table(key, bits)
        return cls(keys, ranks, bits, merged, byte_ids, tokens, specials, zlib.crc32(json.dumps(spec).encode()))

    def words(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return encode_words(self, buf, s, e)

    @staticmethod
    def slots(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        x = key.astype(np.uint64)
        shift = np.uint64(64 - bits)
        return (x * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64), ((x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) >> shift).astype(np.int64) + (1 << bits)

    @classmethod
    def _table(cls, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Cuckoo placement: every key stands in one of its two slots."""
        a, b = (x.tolist() for x in cls.slots(key, bits))
        at: list[int] = [-1] * (2 << bits)
        for i in range(len(key)):
            k, place = i, a[i]
            for _ in range(2000):
                k, at[place] = at[place], k
                if k < 0:
                    break
                place = b[k] if place == a[k] else a[k]
            else:
                raise ValueError("rank table is too small")
        held = np.array(at)
        return np.where(held >= 0, key[held], -1), np.where(held >= 0, held, NO_RANK).astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent pairs, NO_RANK where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        a, b = self.slots(key, self.bits)
        return np.where(self.keys[a] == key, self.ranks[a], np.where(self.keys[b] == key, self.ranks[b], NO_RANK))


def _encode_equal(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encodes words of one length. Returns word numbers, token counts and tokens, in the order in which words finish."""
    row = np.arange(len(ids))
    rank = v.rank(ids[:, :-1], ids[:, 1:])
    done: list[tuple[np.ndarray, int, np.ndarray]] = []
    while len(row):
        size = ids.shape[1]
        if size == 1:
            done.append((row, 1, ids))
            break
        k = rank.argmin(1)
        least = rank[np.arange(len(row)), k]
        live = least != NO_RANK
        if not live.all():
            done.append((row[~live], size, ids[~live]))
            row, ids, rank, k, least = row[live], ids[live], rank[live], k[live], least[live]
            if not len(row):
                break
        n, each = len(row), np.arange(len(row))
        ids[each, k] = v.merged[least]
        keep = np.arange(size) != (k + 1)[:, None]
        ids = ids[keep].reshape(n, size - 1)
        # The deleted pair's rank goes; those on either side of the new part are looked up again.
        rank = rank[np.arange(size - 1) != k[:, None]].reshape(n, size - 2)
        left = np.flatnonzero(k > 0)
        if len(left):
            rank[left, k[left] - 1] = v.rank(ids[left, k[left] - 1], ids[left, k[left]])
        right = np.flatnonzero(k < size - 2)
        if len(right):
            rank[right, k[right]] = v.rank(ids[right, k[right]], ids[right, k[right] + 1])
    return np.concatenate([d[0] for d in done]), np.concatenate([np.full(len(d[0]), d[1]) for d in done]), np.concatenate([d[2].reshape(-1) for d in done])


def _encode_long(v: Vocabulary, raw: np.ndarray) -> np.ndarray:
    """Encodes one long word: a heap of (rank, place) and links between the parts that are left."""
    ids = v.byte_ids[raw].tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    first = v.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
    none = int(NO_RANK)
    heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != none]
    heapq.heapify(heap)
    merged, gone = v.merged, bytearray(n)

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := int(v.rank(np.array([ids[i]]), np.array([ids[j]]))[0])) != none:
            heapq.heappush(heap, (r, i, ids[i], ids[j]))

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if not gone[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], gone[j] = int(merged[r]), 1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return np.array([x for x, g in zip(ids, gone, strict=True) if not g], np.int32)


def encode_words(v: Vocabulary, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the words buf[s:e]: the tokens, each word's first token and its number of tokens."""
    length = e - s
    order = np.argsort(length, kind="stable")
    sizes, begins = np.unique(length[order], return_index=True)
    counts, parts, at = np.zeros(len(s), np.int64), [], np.zeros(len(s), np.int64)
    total = 0
    specials: dict[int, list[tuple[np.ndarray, int]]] = {}
    for t, i in v.specials.items():
        specials.setdefault(len(t), []).append((np.frombuffer(t, np.uint8), i))
    for size, lo, hi in zip(sizes, begins, [*begins[1:], len(s)], strict=True):
        who = order[lo:hi]
        for special, token in specials.get(int(size), ()):
            hit = (buf[s[who][:, None] + np.arange(size)] == special).all(1)
            if hit.any():
                counts[who[hit]], at[who[hit]] = 1, total + np.arange(hit.sum())
                parts.append(np.full(hit.sum(), token, np.int32))
                total += int(hit.sum())
                who = who[~hit]
        if not len(who):
            continue
        if size <= LONG_WORD:
            row, n, ids = _encode_equal(v, v.byte_ids[buf[s[who][:, None] + np.arange(size)]])
            counts[who[row]] = n
            at[who[row]] = total + np.cumsum(n) - n
            parts.append(ids)
            total += len(ids)
        else:
            for w in who:
                ids = _encode_long(v, buf[s[w] : e[w]])
                counts[w], at[w] = len(ids), total
                parts.append(ids)
                total += len(ids)
    return np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32), at, counts


@dataclass
class LibraryVocabulary:
    """The tokenizers library as the encoder of words: an alternative to Vocabulary in encode_batches(). The split pattern takes a
    word of a text again as one word when it stands alone, so words can be given to the library one by one, each once."""

    #: Words of one call of the library.
    GROUP = 8192

    tokenizer: Tokenizer
    specials: dict[bytes, int]
    mark: int

    @classmethod
    def load(cls, path: str) -> LibraryVocabulary:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return cls(tokenizer, {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}, -1 - zlib.crc32(tokenizer.to_str().encode()))

    def words(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        raw, parts, counts = buf.tobytes(), [], []
        begins, ends = s.tolist(), e.tolist()
        for k in range(0, len(begins), self.GROUP):
            texts = [raw[a:b].decode() for a, b in zip(begins[k : k + self.GROUP], ends[k : k + self.GROUP], strict=True)]
            for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                own = found.ids
                parts += own
                counts.append(len(own))
        n = np.array(counts, np.int64)
        return np.array(parts, np.int32), np.cumsum(n) - n, n


class WordStore:
    """Tokens and bytes of words met before in this worker, in a direct-mapped table by hash: a word is taken for a known one only if
    their bytes are equal. It starts anew beyond a fixed number of words or blocks of bytes."""

    BITS = 20
    LIMIT, BLOCK_LIMIT = 1 << 20, 1 << 22

    def __init__(self):
        self.mark: int | None = None

    def _clear(self, mark: int) -> None:
        self.mark, self.used, self.filled, self.held = mark, 0, 0, 0
        self.key, self.word = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int32)
        self.at, self.counts, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.blocks, self.first, self.length = np.zeros(4096, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    @staticmethod
    def _append(old: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        if used + len(new) > len(old):
            old = np.concatenate([old, np.zeros(len(old) + len(new), old.dtype)])
        old[used : used + len(new)] = new
        return old

    def encode(self, v: Vocabulary | LibraryVocabulary, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens held, and for each word its first token and its number of tokens."""
        if self.mark != v.mark or self.used > self.LIMIT or self.held > self.BLOCK_LIMIT:
            self._clear(v.mark)
        blocks, first = tk.span_blocks(buf, s, e)
        length = e - s
        h = tk.block_hash(blocks, first, length)
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        which = self.word[slot].astype(np.int64)
        hit = (self.key[slot] == h) & (which != 0)
        hit &= self.length[which] == length
        own = np.flatnonzero(hit)
        size = np.diff(first)
        mine, theirs = tk.repeat_index(first[own], size[own]), tk.repeat_index(self.first[which[own]], size[own])
        wrong = np.flatnonzero(blocks[mine] != self.blocks[theirs])
        if len(wrong):
            hit[np.repeat(own, size[own])[wrong]] = False
        missed = np.flatnonzero(~hit)
        if len(missed):
            n = size[missed]
            mblocks, mfirst = blocks[tk.repeat_index(first[missed], n)], np.concatenate([[0], np.cumsum(n)])
            one, number = tk.distinct(buf, s[missed], e[missed], (mblocks, mfirst, h[missed]))
            fresh = missed[one]
            ids, at, counts = v.words(buf, s[fresh], e[fresh])
            new = self.used + 1 + np.arange(len(fresh))  # 0 marks an empty slot
            fblocks = blocks[tk.repeat_index(first[fresh], size[fresh])]
            self.ids = self._append(self.ids, self.filled, ids)
            self.blocks = self._append(self.blocks, self.held, fblocks)
            begin = self.held + np.cumsum(size[fresh]) - size[fresh]
            for name, values in (("at", at + self.filled), ("counts", counts), ("first", begin), ("length", length[fresh])):
                setattr(self, name, self._append(getattr(self, name), self.used + 1, values))
            self.word[slot[fresh]] = new
            # Of words that share a slot, one stays; its key must be its own.
            self.key[slot[fresh]] = h[fresh[self.word[slot[fresh]] - new[0]]]
            which[missed] = new[number]
            self.filled, self.used, self.held = self.filled + len(ids), self.used + len(fresh), self.held + len(fblocks)
        return self.ids, self.at[which], self.counts[which]


WORDS = WordStore()


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = char_classes()
    out = table[:256].copy()
    out[128:] = OTHER
    cls = out[buf]
    high = np.flatnonzero(buf >= 0xC0)
    if len(high):
        b = np.concatenate([buf, np.zeros(3, np.uint8)])
        lead, b1, b2, b3 = (b[high + k].astype(np.int64) & (0x3F if k else 0xFF) for k in range(4))
        two, three = lead < 0xE0, (lead >= 0xE0) & (lead < 0xF0)
        code = np.where(two, (lead & 0x1F) << 6 | b1, np.where(three, (lead & 0x0F) << 12 | b1 << 6 | b2, np.minimum((lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3, 0x10FFFF)))
        kind = table[code]
        for k in range(4):
            has = high[(two & (k < 2)) | (three & (k < 3)) | (~two & ~three)]
            cls[has + k] = kind[(two & (k < 2)) | (three & (k < 3)) | (~two & ~three)]
    return cls


def split(buf: np.ndarray, off: np.ndarray, specials: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the split pattern; no word crosses a document's end. Strings of special tokens are words of their own."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = byte_classes(buf)
    held: list[tuple[int, int]] = []
    if specials:
        raw = buf.tobytes()
        for t in specials:
            p = raw.find(t)
            while p >= 0:
                k = int(np.searchsorted(off, p, "right"))
                if p + len(t) <= off[k]:
                    held.append((p, p + len(t)))
                    p = raw.find(t, p + len(t))
                else:
                    p = raw.find(t, p + 1)
        if held:
            off = np.unique(np.concatenate([off, np.array(held).reshape(-1)]))
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = edge[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    at = np.flatnonzero(start)
    end = np.append(at[1:], n)
    kind = cls[at]
    # White space before a word: its last character stands apart, and a blank joins the word.
    gap = np.flatnonzero((kind == SPACE) & ~edge[end])
    last = end[gap] - 1
    while (c := (buf[last] & 0xC0) == 0x80).any():
        last = last - c
    start[last] = True
    start[end[gap][buf[last] == 0x20]] = False
    # An apostrophe alone, not joined to a blank, takes a short ending of the word after it.
    quote = np.flatnonzero((kind == OTHER) & (end - at == 1) & (buf[at] == 0x27) & start[at] & ~edge[end])
    if len(quote):
        p = at[quote]
        stop = off[np.searchsorted(off, p, "right")]
        b = np.concatenate([buf, np.zeros(2, np.uint8)])
        one = np.isin(b[p + 1], [x[0] for x in SHORT_ENDINGS])
        two = np.zeros(len(p), bool)
        for x in LONG_ENDINGS:
            two |= (b[p + 1] == x[0]) & (b[p + 2] == x[1])
        two &= (p + 3 <= stop) & ~one
        for hit, size in ((p[one], 2), (p[two], 3)):
            start[hit + 1] = False
            rest = hit + size
            rest = rest[rest < n]
            start[rest[(cls[rest] == LETTER)]] = True
    for lo, hi in held:
        start[lo], start[lo + 1 : hi] = True, False
    s = np.flatnonzero(start)
    return s, np.append(s[1:], n)


def encode_chunk(v: Vocabulary | LibraryVocabulary, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a chunk, and each document's first id (one more at the end)."""
    s, e = split(buf, off, v.specials)
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    ids, at, n = WORDS.encode(v, buf, s, e)
    before = np.concatenate([[0], np.cumsum(n)])
    return ids[tk.repeat_index(at, n)], before[np.searchsorted(s, off)]


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids; bytes that are no UTF-8 become the replacement character."""
    t = v.token_bytes
    return b"".join([t[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encode_batches(batches: Iterator[pa.RecordBatch], v: Vocabulary | LibraryVocabulary, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of each chunk with their ids and first ids."""
    for batch in batches:
        for rows, buf, off in tk.text_chunks(batch, column):
            ids, first = encode_chunk(v, buf, off)
            yield batch.slice(rows.start, rows.stop - rows.start), ids, first


def _rows(batches, tables, id_col, text_col, make):
    v = tables.value
    for rows, ids, first in encode_batches(batches, v, text_col):
        yield make(v, rows.column(id_col), ids, first)


def bpe_encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, ids array<int>, n_tokens long. Null and empty texts have no ids; other columns are left out,
    so a column of df called ids does no harm. Equal texts have equal ids; repeated rows stay repeated."""
    spark = df.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(Vocabulary.load(tokenizer_path))

    def make(v, key, ids, first):
        return pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(np.diff(first))], ["key", "ids", "n_tokens"])

    def run(batches):
        return _rows(batches, tables, "key", "text", make)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, n_tokens long").withColumnRenamed("key", id_col)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, text string. Null ids decode to an empty text; bytes that are no UTF-8 to the replacement character."""
    spark = df.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(Vocabulary.load(tokenizer_path))

    def run(batches):
        for batch in batches:
            texts = [decode_ids(tables.value, np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", id_col)


def round_trip_digests(df: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes and decodes every text; per document id_col, n_tokens, ids_sha256 (of the ids in decimal, joined by commas) and
    decoded_sha256 (of the decoded text). Null texts count as empty."""
    spark = df.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(Vocabulary.load(tokenizer_path))

    def make(v, key, ids, first):
        shown, back = [], []
        decimal = [b"%d," % i for i in range(len(v.token_bytes))]
        every = ids.tolist()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = every[a:b]
            shown.append(hashlib.sha256(b"".join([decimal[i] for i in own])[:-1]).hexdigest())
            back.append(hashlib.sha256(b"".join([v.token_bytes[i] for i in own]).decode("utf-8", "replace").encode()).hexdigest())
        return pa.RecordBatch.from_arrays([key, pa.array(np.diff(first)), pa.array(shown, pa.string()), pa.array(back, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches):
        return _rows(batches, tables, "key", "text", make)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", id_col)
