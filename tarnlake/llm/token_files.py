"""Token ids in binary files: fixed-size blocks, transposed into bit or byte planes, each compressed with zstandard.

File: MAGIC, the compressed planes of all blocks and the compressed parts of the document table, as they were filled, the
compressed footer, its length (8 bytes), MAGIC. The footer (JSON) holds the chunk index (for each block its place, number of ids and
the sizes of its planes) and the places and sizes of the document table's parts (ids and numbers of tokens, JSON). A plane that is
zero throughout takes no bytes. Writer and reader hold one block and one part of the table at a time.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LibraryVocabulary, encode_batches
from .common import Stash, open_folder, partitions, put_file, small_batches

MAGIC = b"TLTOKEN1"
#: Ids of one block.
BLOCK_IDS = 1 << 16
#: Bytes of text of one file, about: at most, and at least as long as that leaves a file for each shuffle partition.
FILE_BYTES, LEAST_FILE_BYTES = 64 << 20, 1 << 20
#: Documents of one part of a file's document table.
TABLE_ROWS = 4096


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[np.ndarray]:
    """Planes of a block of unsigned 32-bit ids, lowest first: 4 of bytes or 32 of bits."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(rows[:, k]) for k in range(4)]
    top = int(ids.max(initial=0)).bit_length()
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1) if k < top else np.zeros(0, np.uint8) for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        if p:
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


class TokenFileWriter:
    """Gathers ids into blocks; feed() and close() give the bytes to write."""

    def __init__(self, kind: str = "byte", level: int = 1, block: int = BLOCK_IDS):
        self.kind, self.block, self.press = kind, block, zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held, self.place, self.index, self.keys, self.counts, self.table = 0, len(MAGIC), [], [], [], []

    def _block(self, ids: np.ndarray) -> bytes:
        parts = [self.press.compress(p.tobytes()) if p.any() else b"" for p in to_planes(ids, self.kind)]
        self.index.append([self.place, len(ids), [len(p) for p in parts]])
        self.place += sum(map(len, parts))
        return b"".join(parts)

    def _part(self) -> bytes:
        """The next part of the document table."""
        data = self.press.compress(json.dumps([self.keys[:TABLE_ROWS], self.counts[:TABLE_ROWS]]).encode())
        self.table.append([self.place, len(data)])
        self.place += len(data)
        del self.keys[:TABLE_ROWS], self.counts[:TABLE_ROWS]
        return data

    def feed(self, keys: list, counts: list[int], ids: np.ndarray) -> Iterator[bytes]:
        self.keys += keys
        self.counts += counts
        while len(self.keys) >= TABLE_ROWS:
            yield self._part()
        self.held.append(ids.astype(np.uint32))
        self.n_held += len(ids)
        if self.n_held >= self.block:
            every = np.concatenate(self.held)
            whole = self.n_held // self.block * self.block
            for k in range(0, whole, self.block):
                yield self._block(every[k : k + self.block])
            self.held, self.n_held = [every[whole:]], self.n_held - whole

    def close(self) -> Iterator[bytes]:
        if self.n_held:
            yield self._block(np.concatenate(self.held))
        if self.keys:
            yield self._part()
        foot = self.press.compress(json.dumps({"kind": self.kind, "index": self.index, "table": self.table}).encode())
        yield foot + struct.pack("<Q", len(foot)) + MAGIC


class TokenFileReader:
    """Reads ranges of ids by the chunk index; holds one block at a time."""

    def __init__(self, uri: str, name: str):
        fs, folder = open_folder(uri)
        self.file = fs.open_input_file(f"{folder}/{name}")
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is no token file")
        length = struct.unpack("<Q", tail[:8])[0]
        foot = json.loads(zstandard.ZstdDecompressor().decompress(self.file.read_at(length, size - 16 - length)))
        self.kind, self.index, self.table = foot["kind"], foot["index"], foot["table"]
        self.unpress = zstandard.ZstdDecompressor()

    def blocks(self) -> Iterator[np.ndarray]:
        for place, n, sizes in self.index:
            raw, at, planes = self.file.read_at(sum(sizes), place), 0, []
            for k in sizes:
                planes.append(self.unpress.decompress(raw[at : at + k]) if k else b"")
                at += k
            yield from_planes(planes, n, self.kind)

    def rows(self) -> Iterator[tuple[object, int]]:
        """Key and number of tokens of each document, in file order."""
        for place, size in self.table:
            keys, counts = json.loads(self.unpress.decompress(self.file.read_at(size, place)))
            yield from zip(keys, counts, strict=True)

    def documents(self) -> Iterator[tuple[object, list[np.ndarray]]]:
        """Key and ids (in pieces) of each document, in file order."""
        blocks, now, at = self.blocks(), np.zeros(0, np.uint32), 0
        for key, n in self.rows():
            parts = []
            while n:
                if at == len(now):
                    now, at = next(blocks), 0
                take = min(n, len(now) - at)
                parts.append(now[at : at + take])
                at, n = at + take, n - take
            yield key, parts


def write_token_files(df: DataFrame, tokenizer_path: str, folder: str, end_id: int | None, text_col: str = "text", id_col: str = "doc_id", kind: str = "byte", n_files: int | None = None) -> DataFrame:
    """Encodes all texts and writes them in ascending order of id_col, one file a range of ids. Returns the manifest: file
    string, part int, n_docs long, n_ids long. Null texts are empty (with end_id they have one id); texts of any length are written
    whole; null ids come first; rows with equal ids follow each other by a hash of their texts (so that one id can have many files)
    and then by text, repeated rows stay. Other columns of df, whatever their names, have no part in this. An empty table gives no file."""
    spark = df.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(LibraryVocabulary.load(tokenizer_path))

    def run(batches):
        part = TaskContext.get().partitionId()
        writer, totals = TokenFileWriter(kind), [0, 0]

        def content(rest):
            yield MAGIC
            for rows, ids, first in rest:
                counts = np.diff(first)
                if end_id is not None:
                    ids = np.insert(ids, first[1:], end_id)
                    counts = counts + 1
                totals[0] += len(counts)
                totals[1] += len(ids)
                yield from writer.feed(rows.column("key").to_pylist(), counts.tolist(), ids)
            yield from writer.close()

        every = encode_batches(batches, tables.value)
        head = next(every, None)
        if head is not None:
            name = f"tokens-{part:06d}.bin"
            put_file(folder, name, content(x for group in ([head], every) for x in group))
            yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "n_docs": [totals[0]], "n_ids": [totals[1]]})

    if n_files is None:
        size = df.select(F.sum(F.octet_length(text_col))).first()[0] or 0
        n_files = max(1, -(-size // FILE_BYTES), min(partitions(spark), -(-size // LEAST_FILE_BYTES)))
    # Sorting the texts and not the ids keeps the shuffle small.
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = rows.repartitionByRange(n_files, "key", "mark").sortWithinPartitions("key", "mark", "text").select("key", "text")
    return rows.mapInArrow(run, "file string, part int, n_docs long, n_ids long")


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """Reads all files back: id_col, start long (ids of all documents before it), n_tokens long, ids_crc32 long."""
    spark = manifest.sparkSession
    files = manifest.orderBy("part").collect()  # one row a file
    starts = np.cumsum([0, *(f["n_ids"] for f in files)]).tolist()
    n = max(1, len(files))
    plan = spark.createDataFrame([(f["file"], s) for f, s in zip(files, starts[:-1], strict=True)], "file string, start long").repartitionByRange(n, "file")

    def run(batches):
        for batch in batches:
            for name, start in zip(*(batch.column(c).to_pylist() for c in ("file", "start")), strict=True):
                reader, out = TokenFileReader(folder, name), ([], [], [], [])

                def pack(out=out):
                    return pa.RecordBatch.from_arrays([pa.array(out[0], kind), *(pa.array(x, pa.int64()) for x in out[1:])], ["key", "start", "n_tokens", "ids_crc32"])

                for key, parts in reader.documents():
                    crc, size = 0, 0
                    for p in parts:
                        crc, size = zlib.crc32(p, crc), size + len(p)
                    for x, y in zip(out, (key, start, size, crc), strict=True):
                        x.append(y)
                    start += size
                    if len(out[0]) == 4096:
                        yield pack()
                        out = ([], [], [], [])
                yield pack(out)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(id_type))
    return plan.mapInArrow(run, f"key {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", id_col)


def token_file_round_trip(df: DataFrame, tokenizer_path: str, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id", kind: str = "byte") -> DataFrame:
    """Writes token files under the shared folder and reads them back; see write_token_files() for nulls, ties and empty tables."""
    stash = Stash(df.sparkSession, "tokens")
    manifest = stash.save(write_token_files(df, tokenizer_path, f"{stash.path}/files", end_id, text_col, id_col, kind), "manifest")
    return read_token_files(manifest, f"{stash.path}/files", id_col, df.schema[id_col].dataType.simpleString())
