"""Sparse Bloom filters: sorted bit ids of hashed tokens, and their exploded form (id, bit)."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES, BITS = 2, 8192


def md5_bits(token: Column, slices: int = SLICES, bits: int = BITS) -> Column:
    """One bit in each slice, from 16-bit parts of the token's MD5: an expression that SQL engines share. At most 8 slices."""
    return _slices(F.md5(token.cast("binary")), slices, bits)


def _slices(digest: Column, slices: int, bits: int) -> Column:
    return F.array(*[(F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int") % bits + i * bits).cast("int") for i in range(slices)])


def salted_bits(token: str, slices: int = SLICES, bits: int = BITS) -> list[int]:
    """One bit in each slice, from the salted digest's unsigned parts: xxh128 where 128 bits suffice, else the SHA that does."""
    import hashlib

    import xxhash

    width = 2 if bits < 1 << 15 else 4
    total = 8 * width * slices
    make = next(f for most, f in ((128, xxhash.xxh128), (160, hashlib.sha1), (256, hashlib.sha256), (384, hashlib.sha384), (512, hashlib.sha512)) if total <= most)
    salt = make(make(struct.pack("I", 0)).digest())
    salt.update(token.encode())
    digest = salt.digest()
    parts = struct.unpack(f"={len(digest) // width}{'H' if width == 2 else 'I'}", digest)
    return [parts[i] % bits + i * bits for i in range(slices)]


def salted_bits_udf(slices: int = SLICES, bits: int = BITS) -> Callable[[Column], Column]:
    """salted_bits of arrays of tokens, in Arrow batches: sorted and distinct. Each batch hashes a token once."""

    @F.pandas_udf("array<int>")
    def of(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in tokens:
            known: dict[str, list[int]] = {}
            out = []
            for row in batch:
                found: set[int] = set()
                for t in row if row is not None else ():
                    if t not in known:
                        known[t] = salted_bits(t, slices, bits)
                    found.update(known[t])
                out.append(sorted(found))
            yield pd.Series(out)

    return of


def bloom(tokens: Column, slices: int = SLICES, bits: int = BITS, hasher: Callable[..., Column] | None = None) -> Column:
    """Sorted, distinct bits of an array of tokens; the hash is a parameter (an anonymising one, say), MD5 by default."""
    if hasher is None:
        made = F.transform(F.transform(tokens, lambda t: F.md5(t.cast("binary"))), lambda d: _slices(d, slices, bits))
    else:
        made = F.transform(tokens, lambda t: hasher(t, slices, bits))
    return F.array_sort(F.array_distinct(F.flatten(made)))


def sequence(tokens: Column, slices: int = SLICES, bits: int = BITS, most: int = 40) -> Column:
    """The bits of each of the first `most` tokens, in order: filters that keep word order."""
    return F.transform(F.transform(F.slice(tokens, 1, most), lambda t: F.md5(t.cast("binary"))), lambda d: _slices(d, slices, bits))


def exploded(rows: DataFrame, id_col: str, text_col: str, tokenizer: Callable[[Column], Column], slices: int = SLICES, bits: int = BITS) -> DataFrame:
    """(id, bit), distinct, without a shuffle: bits are made distinct within their row."""
    return rows.select(id_col, F.explode(bloom(F.array_distinct(tokenizer(F.col(text_col))), slices, bits)).alias("bit"))


def union(rows: DataFrame, id_col: str, bit_col: str = "bit") -> DataFrame:
    """OR of the filters that share an id: the distinct pairs."""
    return rows.select(id_col, bit_col).distinct()


def united(rows: DataFrame, id_col: str) -> DataFrame:
    """OR of the filters (id, bits) that share an id."""
    return rows.groupBy(id_col).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bits")))).alias("bits"))


#: Words whose digests a worker remembers.
WORDS = 400_000


def filters(rows: DataFrame, text_col: str, slices: int = SLICES, bits: int = BITS) -> DataFrame:
    """The rows with `bits`, as bloom(array_distinct(words(text))) has them, in place of the text; in Arrow batches, each word hashed once while it is remembered."""
    columns = [c for c in rows.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema) + ", bits array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        class Known(dict):
            def __missing__(self, w: str) -> bytes:
                if len(self) >= WORDS:
                    self.clear()
                out = self[w] = md5(w.encode()).digest()
                return out

        known, of = Known(), np.arange(slices) * bits
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(len(columns)).to_pylist()
                found = [np.unique(np.frombuffer(b"".join([known[w] for w in set((t or "").split())]), ">u2").reshape(-1, 8)[:, :slices] % bits + of) for t in texts]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32()), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], made], names=[*columns, "bits"])

    return rows.select(*columns, F.lower(text_col)).mapInArrow(run, schema)


def sequences(rows: DataFrame, text_col: str, slices: int = SLICES, bits: int = BITS, most: int = 40) -> DataFrame:
    """The rows with `words`, as sequence(words(text)) has them, in place of the text; in Arrow batches, no more words than asked for are hashed."""
    columns = [c for c in rows.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema) + ", words array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(len(columns)).to_pylist()
                digests = [[md5(w.encode()).digest() for w in (t or "").split(None, most)[:most]] for t in texts]
                values = np.frombuffer(b"".join(d for ds in digests for d in ds), ">u2").reshape(-1, 8)[:, :slices] % bits + np.arange(slices) * bits
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * slices), pa.array(values.ravel(), pa.int32()))
                made = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, digests)], dtype=np.int32)), inner, mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], made], names=[*columns, "words"])

    return rows.select(*columns, F.lower(text_col)).mapInArrow(run, schema)


def xor(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def has_bit(bloom_bits: Column, bit: Column) -> Column:
    return F.array_contains(bloom_bits, bit)


def packed(rows: DataFrame, id_col: str, total_bits: int, bit_col: str = "bit") -> DataFrame:
    """Dense filters: bitmaps of at most 32768 bits, one for each id."""
    if total_bits > 32768:
        raise ValueError("a dense filter holds 32768 bits")
    return rows.groupBy(id_col).agg(F.expr(f"bitmap_construct_agg({bit_col})").alias("bitmap"))


def packed_bit(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of a dense filter is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1
