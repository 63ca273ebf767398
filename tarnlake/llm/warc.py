"""WARC archives with a Zstandard dictionary.

A file starts with a skippable frame that holds a dictionary built from a bounded sample of all records, chosen by a hash; then each record is one frame, compressed with that dictionary. A reader takes the dictionary from the leading frame and
needs nothing else. Records with equal payloads are stored once: that of the largest id is a response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, open_folder, partitions, put_file, small_batches

# Frame numbers of the Zstandard format and of its WARC profile.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: Bytes of payloads that the dictionary is built from (about), of one payload in it, payloads in it at most, and bytes of the dictionary.
SAMPLE_BYTES, SAMPLE_PAYLOAD, SAMPLE_ROWS, DICTIONARY_BYTES = 4 << 20, 16 << 10, 2048, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value in one line."""
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in value)


def _urn(page_id) -> str:
    """A record's name; characters that would end it are escaped."""
    return f"<urn:page:{'' if page_id is None else quote(str(page_id), safe='')}>"


def _page(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) or None if urn else None


def make_record(page_id, url: str | None, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """One WARC record; a revisit has the digest and length of its payload, but no payload."""
    revisit = refers_to is not None
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": date, "WARC-Target-URI": _clean(url or ""),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "WARC-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        head |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": PROFILE}
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head.items(), ("Content-Length", len(body))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_archive(records: Iterator[bytes], raw: bytes, level: int = 3) -> Iterator[bytes]:
    """Bytes of an archive: the frame of the dictionary raw, then a frame for each record."""
    packed = zstandard.ZstdCompressor(level=19).compress(raw)
    yield struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    for r in records:
        yield press.compress(r)


def sample_dictionary(marked: DataFrame) -> bytes:
    """A dictionary from records of all parts of the table: those whose payloads' hashes are least, each payload once."""
    total = marked.agg(F.sum(F.length("payload"))).first()[0] or 0
    share = math.ceil(min(1.0, SAMPLE_BYTES / max(1, total)) * (1 << 30))
    picked = marked.where(F.pmod(F.xxhash64("payload"), F.lit(1 << 30)) < share).select("key", "url", F.substring("payload", 1, SAMPLE_PAYLOAD).alias("payload"))
    rows = picked.dropDuplicates(["payload"]).orderBy(F.xxhash64("payload")).limit(SAMPLE_ROWS).collect()
    return build_dictionary([make_record(r["key"], r["url"], bytes(r["payload"]), None) for r in rows])


def read_archive(uri: str, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record, one frame at a time."""
    fs, folder = open_folder(uri)
    with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{name} has no dictionary frame")
        packed = f.read(size)
        raw = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == ZSTD_FRAME else packed
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        rest = b""
        while rest or (rest := f.read(1 << 20)):
            frame, parts = unpress.decompressobj(), []
            while not frame.eof:
                if not rest and not (rest := f.read(1 << 20)):
                    raise ValueError(f"{name} ends within a record")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data
            yield parse_record(b"".join(parts))


def mark_revisits(df: DataFrame, stash: Stash, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """key, url, payload and refers_to (null for responses). Payloads are told apart by SHA-1 and length."""
    rows = df.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.concat_ws(":", F.sha1("payload"), F.length("payload")))
    # Only ids and digests are compared; partial maxima come before the shuffle. Payloads are shuffled at most once, and not at all
    # while the table of repeated payloads is small enough to be broadcast.
    last = rows.where(F.length("payload") >= least_bytes).groupBy("same").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1").select("same", "last")
    last = stash.save(last, "last")
    return rows.join(last, "same", "left").select("key", "url", "payload", F.when(F.col("last") != F.col("key"), F.col("last")).alias("refers_to"))


def archive_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Writes all pages to archives under the shared folder and reads them back: id_col, payload_bytes, payload_digest, record_type,
    refers_to. Null payloads are empty ones; rows that share the largest id of equal payloads are all responses, and so are
    rows without an id whose payload no row with an id has. Payloads of any length are one record each; ids may be strings of any
    characters. All records have the given date. Other columns of df, whatever their names, have no part in this; an empty table
    gives no row."""
    spark = df.sparkSession
    small_batches(spark)
    stash = Stash(spark, "warc")
    folder, kind = f"{stash.path}/files", df.schema[id_col].dataType.simpleString()

    def write(batches):
        part, n = TaskContext.get().partitionId(), [0]

        def records(group):
            for batch in group:
                for key, url, payload, refers in zip(*(batch.column(c) for c in ("key", "url", "payload", "refers_to")), strict=True):
                    n[0] += 1
                    yield make_record(key.as_py(), url.as_py(), payload.as_py(), refers.as_py(), date)

        every = (b for b in batches if b.num_rows)
        head = next(every, None)
        if head is not None:
            name = f"pages-{part:06d}.warc.zst"
            put_file(folder, name, write_archive(records(x for g in ([head], every) for x in g), dictionary.value))
            yield pa.RecordBatch.from_pydict({"file": [name], "n": [n[0]]})

    def read(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out = []
                for fields, payload in read_archive(folder, name):
                    page, target = _page(fields["WARC-Record-ID"]), _page(fields.get("WARC-Refers-To"))
                    if fields["WARC-Type"] == "response" and (len(payload) != int(fields["WARC-Payload-Length"]) or payload_digest(payload) != fields["WARC-Payload-Digest"][5:]):
                        raise ValueError(f"damaged record in {name}")
                    out.append((page, int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], target))
                    if len(out) == 4096:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    n_files = partitions(spark)
    marked = mark_revisits(df, stash, id_col, url_col, html_col, least_bytes)
    raw = sample_dictionary(df.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")))
    dictionary = spark.sparkContext.broadcast(raw)
    manifest = stash.save(marked.mapInArrow(write, "file string, n long"), "manifest")
    back = manifest.repartitionByRange(n_files, "file").mapInArrow(read, "key string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return back.select(F.col("key").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])
