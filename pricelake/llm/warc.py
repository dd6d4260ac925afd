"""WARC archives as seekable Zstandard bundles.

*Writing.* Every row is one WARC/1.1 record whose block is an HTTP response with the payload. Of
records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id is a
``response``, the others are ``revisit`` records (identical payload digest) without the payload.
Each Spark task groups its records into frames of about ``FRAME_BYTES`` bytes or ``FRAME_RECORDS``
records, compresses every frame on its own, and writes them to a bundle that ends in a seek table
(the Zstandard seekable format: a skippable frame with the sizes and checksum of each frame and a
footer of nine bytes), so any Zstandard reader can also read the bundle as one stream. A bundle of
``BUNDLE_BYTES`` is closed and the next begun. The task returns the map from record identifiers to
(bundle, frame, offset in the frame, length), which is written as a table, the index.

*Reading.* The index rows wanted are dealt out by frame. A task takes the footer and the seek table
of a bundle, reads the byte range of a frame alone, checks it and cuts the records out by offset.
``lookup`` reads only the frames that hold the wanted records.

*Plan.* Digests are JVM expressions. One aggregate by digest (pre-reduced map-side) gives the repeated
payloads and their smallest id; it is stored, so that the join with the rows, which AQE may split
at a hot digest, is one shuffle of the payloads. A task holds one frame at a time.

*Lost executors.* A bundle has a name of its own per attempt and is referred to by the index only if
its task succeeded; bundles of failed attempts stay in the folder without a reference.

Defined results: a null payload is empty; a null url leaves the header out and reads back as null;
rows with a null id are responses unless a row with an id has the same payload; rows that share the
smallest id and the payload are all responses; a record of any length is in one frame; an empty
table gives an empty index. The folder must be one that all executors share and pyarrow can open.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import col
from pricelake.session import freeze

#: Payload bytes from which an equal payload is a revisit.
MIN_REVISIT = 100
#: Uncompressed bytes and records of a frame, compressed bytes of a bundle.
FRAME_BYTES, FRAME_RECORDS, BUNDLE_BYTES = 1 << 20, 256, 256 << 20

#: Bytes of records that one task reads.
READ_BYTES = 64 << 20

# Fixed values of the Zstandard seekable format and of the WARC revisit profile.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame int, offset long, length long"
RECORD = ("record_id string, id string, url string, record_type string, payload_bytes long, "
          "payload_digest string, refers_to string, payload binary")


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The skippable frame with (compressed size, size, checksum) of every frame and the footer."""
    body = b"".join(struct.pack("<3I", *f) for f in frames)
    body += struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE_MAGIC)
    return struct.pack("<2I", SKIPPABLE_MAGIC, len(body)) + body


class Bundle:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(12 * n, end - 9 - 12 * n)
        self.frames, at = [], 0
        for compressed, size, check in struct.iter_unpack("<3I", table):
            self.frames.append((at, compressed, size, check))
            at += compressed

    def read(self, frame: int) -> bytes:
        at, compressed, size, check = self.frames[frame]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(compressed, at), max_output_size=size)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {frame} is damaged")
        return data


def _clean(value: str) -> str:
    """A header value: control characters and per cent signs as escapes, so it stays on its line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _plain(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record(key: str, url: str | None, digest: str, size: int, payload: bytes | None, first: str | None, date: str) -> bytes:
    """One WARC record; ``first`` is the record that a revisit refers to, else null."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{key}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first is not None:
        head += [f"WARC-Refers-To: <{first}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:])


def parse(data: bytes) -> tuple:
    """The ``RECORD`` columns of one record; the payload of a response is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[:int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["WARC-Payload-Digest"].removeprefix("sha256:")
    kind, size = warc["WARC-Type"], int(_headers(http)["Content-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {warc['WARC-Record-ID']} is damaged")
    key, first, url = warc["WARC-Record-ID"][1:-1], warc.get("WARC-Refers-To"), warc.get("WARC-Target-URI")
    return (key, _own(key), None if url is None else _plain(url), kind, size, digest,
            None if first is None else _own(first[1:-1]), payload if kind == "response" else None)


def _own(key: str) -> str | None:
    return key.removeprefix("urn:record:").rpartition(":")[0] or None


def _writer(folder: str, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task body: (key, url, digest, size, payload, first) rows into bundles; yields the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        pack = zstandard.ZstdCompressor(level=3)
        out, path, frames = None, "", []
        frame, places, at = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, path, frames, frame, places, at
            if out is None:
                path = f"bundle-{uuid.uuid4().hex}.warc.zst"
                out, frames = system.open_output_stream(f"{root}/{path}", compression=None), []
            data = b"".join(frame)
            small = pack.compress(data)
            out.write(small)
            frames.append((len(small), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            n = len(places)
            index = pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in places], pa.string()), pa.array([f"{folder}/{path}"] * n, pa.string()),
                 pa.array([len(frames) - 1] * n, pa.int32()), pa.array([p[1] for p in places], pa.int64()),
                 pa.array([p[2] for p in places], pa.int64())], ["record_id", "bundle", "frame", "offset", "length"])
            frame, places, at = [], [], 0
            if out.tell() >= BUNDLE_BYTES:
                close()
            return index

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(seek_table(frames))
                out.close()
                out = None

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(*row, date)
                if frame and (at + len(data) > FRAME_BYTES or len(frame) == FRAME_RECORDS):
                    yield flush()
                places.append((row[0], at, len(data)))
                frame.append(data)
                at += len(data)
        if frame:
            yield flush()
        close()
    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: index rows in order of bundle and frame into the ``RECORD`` columns."""
    names = ["record_id", "id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()]
    bundle = now = data = None
    for batch in batches:
        rows, size = [], 0
        for path, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
            if (path, frame) != now:
                if now is None or path != now[0]:
                    bundle = Bundle(path)
                now, data = (path, frame), bundle.read(frame)
            rows.append(parse(data[offset:offset + length]))
            size += length
            if size > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)


def write(rows: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html",
          date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``rows`` as bundles in ``folder`` and return the stored index (``INDEX``)."""
    base = (rows.select(col(id).alias("id"), col(url).cast("string").alias("url"), F.coalesce(col(payload).cast("binary"), F.lit(b"")).alias("payload"))
            .withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long")))
    firsts = freeze(base.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
                    .where("n > 1 AND first IS NOT NULL").drop("n"), "warc-firsts")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    key = lambda c: F.concat(F.lit("urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(":"), F.substring("digest", 1, 16))
    records = base.join(firsts, "digest", "left").select(
        key(F.col("id")).alias("key"), "url", "digest", "size", F.when(~again, F.col("payload")).alias("payload"),
        F.when(again, key(F.col("first"))).alias("first"))
    return freeze(records.mapInArrow(_writer(folder.rstrip("/"), date), INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """The records of the index rows, read from their bundles (``RECORD``). The index is small beside
    the records, so the number of tasks follows the bytes of these."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // READ_BYTES)
    return (index.select("bundle", "frame", "offset", "length").repartition(tasks, "bundle", "frame")
            .sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_reader, RECORD))


def lookup(index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records whose id is in the column ``record_id`` of ``record_ids``."""
    return read(index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi"))


#: DuckDB SQL for the digest columns.
ORACLE = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
