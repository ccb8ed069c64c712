"""WARC records in seekable Zstandard bundles (op 8).

A bundle: independent frames of some whole records each; a skippable frame with the record index (zstd of JSON lines
[record identifier, frame, offset in the frame, length]); a skippable frame with the seek table of the seekable format."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import files

# Fixed values of the seekable format: magic numbers of its skippable frame and its footer, and of the index's frame.
SEEK_TABLE, SEEK_FOOTER, INDEX = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 32 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit of the page refers_to, with the headers of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    def __init__(self, folder: str, name: str):
        import zstandard

        self.out, self.pack = files.Output(folder, name), zstandard.ZstdCompressor(level=3)
        self.frame, self.size, self.seek, self.index, self.total = [], 0, [], [], 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append((record_id(page_id), len(self.seek), self.size, len(data)))
        self.frame.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.frame:
            packed = self.pack.compress(b"".join(self.frame))
            self.out.write(packed)
            self.seek.append((len(packed), self.size))
            self.total += self.size
            self.frame, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.pack.compress("\n".join(map(json.dumps, self.index)).encode())
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        table = b"".join(struct.pack("<II", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)
        self.out.done()


class Reader:
    """Reads single frames and records of a bundle through its footer."""

    def __init__(self, content: bytes):
        import zstandard

        n, _, magic = struct.unpack_from("<IBI", content, len(content) - 9)
        if magic != SEEK_FOOTER:
            raise ValueError("no seek table")
        sizes = [struct.unpack_from("<II", content, len(content) - 9 - 8 * (n - k)) for k in range(n)]
        self.at = [0]
        for packed, _ in sizes:
            self.at.append(self.at[-1] + packed)
        self.sizes, self.content, self.unpack = sizes, content, zstandard.ZstdDecompressor()

    def index(self) -> list[list]:
        at = self.at[-1]
        magic, size = struct.unpack_from("<II", self.content, at)
        if magic != INDEX:
            raise ValueError("no record index")
        raw = self.unpack.decompressobj().decompress(self.content[at + 8 : at + 8 + size])
        return [json.loads(x) for x in raw.decode().split("\n") if x]

    def frame(self, k: int) -> bytes:
        return self.unpack.decompress(self.content[self.at[k] : self.at[k + 1]], max_output_size=self.sizes[k][1])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _page(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> list[tuple[int, int, int]]:
    """Writes bundle-PARTITION-ATTEMPT-NUMBER.warc.zst; returns (partition, attempt, records) of each task that wrote any.

    Of equal payloads (by SHA-1) of at least min_bytes, the rows with the largest id are responses, the others refer to
    it. Digests that occur once never meet another row: only those that occur again, counted with partial sums, are joined,
    and Spark splits a digest with very many rows. Null html: an empty payload. Null urls give no target. A null id never
    wins over another one; repeated rows of the largest id are all responses. Payloads of any length are whole records, a
    frame ends behind the record that fills it. An empty table writes nothing; further columns, of any name, are ignored.
    """
    C.session(pages)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    again = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1").select("digest", "first")
    joined = rows.join(C.stage(again), "digest", "left").select("page_id", "url", "digest", "first", F.when(F.col("first").isNull() | (F.col("page_id") == F.col("first")), F.col("html")).alias("html"), F.octet_length("html").alias("size"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (part, tried), bundle, number, n = files.attempt(), None, 0, 0
        for batch in batches:
            for page_id, url, digest, first, html, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    bundle = Bundle(folder, f"bundle-{part:06d}-{tried}-{number:04d}.warc.zst")
                    number += 1
                payload = (html or "").encode()
                bundle.add(page_id, record(page_id, url, payload, size, base64.b32encode(bytes.fromhex(digest)).decode(), None if first is None or first == page_id else first, date))
                n += 1
                if bundle.total >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
        if bundle is not None:
            bundle.close()
        if n:
            yield C.table_rows(pa.schema([("part", pa.int64()), ("attempt", pa.int64()), ("n", pa.int64())]), [(part, tried, n)])

    return [tuple(r) for r in joined.mapInArrow(write, "part long, attempt long, n long").collect()]


def read_warc(spark, folder: str, written: list[tuple[int, int, int]]) -> DataFrame:
    """Per record of what write_warc has returned: page_id, payload_bytes, payload_digest, record_type, refers_to. A response's payload is checked against its digest."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    taken = {x[:2] for x in written}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if files.wrote(path) not in taken:
                    continue
                reader, rows, held, frame = Reader(content.as_py()), [], -1, b""
                for _, k, at, size in reader.index():
                    if k != held:
                        held, frame = k, reader.frame(k)
                    headers, block = parse(frame[at : at + size])
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                    rows.append((_page(headers["WARC-Record-ID"]), length, digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To"))))
                yield C.table_rows(schema, rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "bundle-*.warc.zst").load(folder).select("path", "content").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_archive(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes the pages to a folder (a new shared one, if none is given) and reads the archives back; see write_warc and read_warc."""
    spark = C.session(pages)
    folder = folder or C.shared(spark)
    written = write_warc(pages, folder, min_bytes, **columns)
    if not written:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_warc(spark, folder, written)
