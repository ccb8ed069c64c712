"""What the operators of this subpackage share: shipping code, shared folders, byte-balanced batches, token hashes.

Every operator takes a DataFrame and the names of its columns, selects only these (so further columns, of any
name, never clash) and hands Arrow batches to functions of this package.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
BATCH_BYTES = 8 << 20
U64 = np.uint64


def session(df: DataFrame) -> SparkSession:
    """The DataFrame's session, with Arrow batches bounded in bytes and this package importable on the workers."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, unless their Python path has it."""
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and Path(p).resolve() == ROOT for p in paths) or getattr(spark.sparkContext, "_cartoquill", False):
        return
    to = Path(tempfile.mkdtemp()) / "cartoquill.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in (ROOT / "cartoquill").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(to))
    spark.sparkContext._cartoquill = True


def shared(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "local-cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.gettempdir() + "/cartoquill"
    return f"{top.rstrip('/')}/cq-{uuid.uuid4().hex}"


#: Ends an execution by removing its shuffle files, which else stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The rows, written once to the shared folder and read again: cuts lineage, survives lost executors, and frees the shuffle files of what made them."""
    spark = df.sparkSession
    to, before = shared(spark), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.mode("error")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(to)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(to)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)  # what is not dropped before goes with the driver
    out = spark.read.schema(df.schema).parquet(to)
    out._staged = to
    return out


def drop(*staged: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def deal(spark: SparkSession, times: int = 4) -> int:
    """Into how many buckets to deal rows that Python gathers: some for each shuffle partition, so that it follows the input as that setting does."""
    return max(8, times * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def buckets(total: int, each: int = 16 << 20) -> int:
    """Into how many buckets to deal what is made of so many bytes of text: one for each 16 MB up to 4,096, beyond that as many as keep a bucket within 64 MB."""
    return max(8, min(-(-total // each), 4096), -(-total // (64 << 20)))


_kept: list[dict] = []


def kept() -> dict:
    """A new dictionary of what an operator keeps in a worker from task to task, such as models and words they have encoded."""
    _kept.append({})
    return _kept[-1]


def only(own: dict | None = None) -> None:
    """Drops what other operators keep in this worker, which Spark uses again for the stages that follow, and hands freed memory back to the system."""
    for x in _kept:
        if x is not own and x:
            x.clear()
            gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library than GNU's
        pass


def texts_of(df: DataFrame, id_col: str, text_col: str, key_col: str | None = "") -> DataFrame:
    """doc_id, text, and doc_key where a column is named for it (None: nulls)."""
    key = [] if key_col == "" else [(F.col(key_col) if key_col else F.lit(None)).cast("long").alias("doc_key")]
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *key)


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of every text; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about `most` bytes; an item beyond that stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


# ---- words and their hashes -------------------------------------------------------------------------------------

#: White space that parts words: 0x20, 0x09-0x0D; the same bytes that bytes.split() parts at.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_STEP = U64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20
#: Words are hashed as polynomials in two fields of this many elements, at two bases (fixed values of a rule).
_PRIME = (1 << 31) - 1
_POINTS = (_BASE % _PRIME, pow(_BASE, 3, _PRIME))
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each base the powers upwards and, of its inverse, downwards; n at least."""
    if not _powers or len(_powers[0][0]) < n:
        n, made = max(n, _CHUNK + 4096), []
        for point in _POINTS:
            pair = []
            for base in (point, pow(point, -1, _PRIME)):
                x = np.ones(1, U64)
                while len(x) < n:
                    x = np.concatenate((x, x * U64(pow(base, len(x), _PRIME)) % U64(_PRIME)))
                pair.append(x[:n])
            made.append(tuple(pair))
        _powers[:] = made
    return _powers


def _hash_chunk(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[b], [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, U64), start
    fields, p = [], U64(_PRIME)
    for up, down in _power(len(b) + 1):
        sums = np.zeros(len(b) + 1, U64)  # bytes below 2**8, powers below 2**31: no overflow up to 2**25 bytes
        np.cumsum(b * up[: len(b)], out=sums[1:])
        fields.append((sums[end] - sums[start]) % p * down[start] % p)
    return mix((fields[0] << U64(31) | fields[1]) + (end - start).astype(U64) * _STEP), start


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where it starts. Long data is cut at white space, so that memory stays bounded."""
    whole, hashes, starts, at = np.frombuffer(data, np.uint8), [], [], 0
    while at < len(whole):
        to = min(len(whole), at + _CHUNK)
        if to < len(whole):
            gap = np.flatnonzero(_SPACE[whole[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:
                while to < len(whole) and not _SPACE[whole[to]]:
                    to += 1
        h, s = _hash_chunk(whole[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of every `width` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out *= _STEP
        out += words[k : k + n]
    return mix(out)


def unit_words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Of documents laid end to end: word hashes, the document (by place) of each word, the bytes, the word starts."""
    data = b"\n".join(docs)
    h, s = word_hashes(data)
    ends = np.cumsum([len(d) + 1 for d in docs]) if docs else np.zeros(0, np.int64)
    return h, np.searchsorted(ends, s, side="right").astype(np.int64), data, s


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def clean_bucket(*cols: str, n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def table_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


if sys.byteorder != "little":
    raise ImportError("little-endian machines only")
