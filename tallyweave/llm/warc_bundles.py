"""WARC archives in seekable Zstandard bundles.

A bundle is one file image: independent Zstandard frames of whole WARC records, then a skippable
frame with the seek table (compressed and plain size of every frame) and its nine-byte footer,
as in the public seekable format; an ordinary decoder reads the records and skips the table. An
index row per record gives bundle, frame, and the record's offset and length inside the frame,
so one record costs one frame to read.

Records: every page is a response, or a revisit of the page with the largest id among those with
an equal payload of at least ``SMALLEST_SHARED`` bytes. Bundles are kept as rows of a Parquet
table, which any store that Spark writes can hold; ``export_bundles`` lays them out as files in
a folder that all executors mount. A bundle closes at about ``BUNDLE_BYTES``, a frame at about
``FRAME_BYTES``; only a single larger record goes beyond them. Memory holds one open bundle.

Defined results: a null payload is empty. Rows that repeat the largest page id are all
responses. A null page id is kept; such a page is a revisit if another page with an id has its
payload. A null url leaves out its header; line breaks in a url are percent-encoded. An empty
table gives no bundles. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALLEST_SHARED = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
LEVEL = 3

# fixed values of the public formats
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no date

_BUNDLE = "bundle string, data binary, index array<struct<page_id: bigint, frame: int, offset: bigint, length: bigint>>"
_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


# ---------------------------------------------------------------- records
def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(name: str) -> int | None:
    number = name.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; ``digest`` (hex SHA-1) and ``size`` are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:]), end + 4


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, int]]:
    """(offset, length, WARC headers, payload, full payload size) of the records in plain bytes."""
    at = 0
    while at < len(data):
        head, start = _headers(data, at)
        end = start + int(head["Content-Length"])
        http, body = _headers(data, start)
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")
        yield at, end + 4 - at, head, data[body:end], int(http["Content-Length"])
        at = end + 4


# ---------------------------------------------------------------- bundles
class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.index: list[dict] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.index.append({"page_id": page_id, "frame": len(self.frames), "offset": self.open_bytes, "length": len(record)})
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            self.frames.append(self.compressor.compress(b"".join(self.open)))
            self.sizes.append(self.open_bytes)
            self.bytes += len(self.frames[-1])
            self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        self._close_frame()
        entries = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes))
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        table = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        return b"".join(self.frames) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the footer."""
    frames, flags, magic = struct.unpack("<IBI", data[-9:])
    width = 12 if flags & 0x80 else 8
    start = len(data) - 9 - frames * width
    if magic != SEEKABLE or struct.unpack("<II", data[start - 8 : start]) != (SKIPPABLE, frames * width + 9):
        raise ValueError("no seek table")
    found, at = [], 0
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", data, start + i * width)
        found.append((at, packed, plain))
        at += packed
    return found


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=plain)


def read_record(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its index entry: only its frame is decoded."""
    return read_frame(data, seek_table(data)[frame])[offset : offset + length]


# ---------------------------------------------------------------- Spark
def with_record_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to, revisit).

    Only digests that occur more than once are joined back; a hot digest is one group of a
    combined maximum, and its rows are an ordinary skewed join.
    """
    body = F.coalesce(F.encode(F.col(f"`{payload}`"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )
    shared = (
        rows.where(F.col("payload_bytes") >= SMALLEST_SHARED)
        .groupBy(F.col("payload_digest").alias("d"))
        .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (F.col("payload_bytes") >= SMALLEST_SHARED)
    joined = rows.join(shared, F.col("payload_digest") == F.col("d"), "left").withColumn("revisit", revisit)
    return joined.select(
        "page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(F.col("revisit"), F.col("top")).alias("refers_to"), "revisit",
    )


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, number = TaskContext.get(), 0
    part = task.partitionId() if task else 0

    def closed(writer: BundleWriter) -> pa.RecordBatch:
        index = pa.array([writer.index], pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{part:06d}-{number:06d}"]), pa.array([writer.close()], pa.binary()), index], names=["bundle", "data", "index"]
        )

    writer = BundleWriter()
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            for r in batch.slice(at, 128).to_pylist():
                writer.add(
                    r["page_id"],
                    record_bytes(r["page_id"], r["url"], r["payload"] or b"", r["payload_digest"], r["payload_bytes"], r["refers_to"], r["revisit"]),
                )
                if writer.bytes >= BUNDLE_BYTES:
                    yield closed(writer)
                    writer, number = BundleWriter(), number + 1
    if writer.index:
        yield closed(writer)


def write_bundles(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Archive all pages as a table of bundles (bundle, data, index) under ``path``."""
    with_record_types(pages, page_id, url, payload).mapInArrow(_write, _BUNDLE).write.mode("overwrite").parquet(path)


def record_index(bundles: DataFrame) -> DataFrame:
    """(page_id, bundle, frame, offset, length) of every record."""
    return bundles.select("bundle", F.explode("index").alias("i")).select("i.page_id", "bundle", "i.frame", "i.offset", "i.length")


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of a table of bundles, payload digests of responses checked against their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                whole = data.as_py()
                for frame in seek_table(whole):
                    yield _frame_rows(read_frame(whole, frame), with_payload)

    return bundles.select("data").mapInArrow(run, _RECORD + (", payload binary" if with_payload else ""))


def _frame_rows(plain: bytes, with_payload: bool) -> pa.RecordBatch:
    rows = []
    for _, _, head, payload, size in parse_records(plain):
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
        url = head.get("WARC-Target-URI")
        rows.append(
            {
                "page_id": _id_of(head["WARC-Record-ID"]),
                "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                "payload_bytes": size,
                "payload_digest": digest,
                "record_type": head["WARC-Type"],
                "refers_to": _id_of(head["WARC-Refers-To"]) if revisit else None,
                "payload": None if revisit else payload,
            }
        )
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds + [("payload", pa.binary())] * with_payload))


def export_bundles(bundles: DataFrame, folder: str) -> None:
    """Write every bundle as ``<bundle>.warc.zst`` into a folder that all executors mount."""

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            final = os.path.join(folder, f"{r['bundle']}.warc.zst")
            with open(f"{final}.{os.getpid()}", "wb") as out:
                out.write(r["data"])
            os.replace(f"{final}.{os.getpid()}", final)  # a repeated task writes the same file again

    bundles.select("bundle", "data").foreachPartition(run)
