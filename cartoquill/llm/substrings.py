"""Substring dedup (op 3): Rabin-Karp hashes of every window of words, counted in Spark, merged into removal intervals.

Two rounds of the same kind: tasks send each unit of text's different keys, sorted and packed, to buckets of the key range;
buckets find what several documents share and send it back by unit. The first round's keys are 64-bit Rabin-Karp hashes of
all windows and only choose candidates; the second's are 128-bit BLAKE2b digests of the words of the candidates, which decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 13
UNIT_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20


def pack_hashes(h: np.ndarray) -> bytes:
    """Ascending 64-bit integers as differences, byte planes apart, so that their leading zeros compress."""
    import zstandard

    d = np.diff(h, prepend=C.U64(0))
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_hashes(b: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(C.U64).ravel(), dtype=C.U64)


def pack_places(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_places(b: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def doc_windows(docs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows that lie in one document, and the place of that document."""
    words, doc, _, _ = C.unit_words(docs)
    h = C.window_hashes(words, width)
    if not len(h):
        return h, doc[:0]
    inside = doc[: len(h)] == doc[width - 1 :]
    return h[inside], doc[: len(h)][inside]


def distinct_windows(docs: list[bytes], width: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes (their first bits) and places, each pair of hash and document once."""
    h, doc = doc_windows(docs, width)
    h = h >> C.U64(64 - bits) << C.U64(64 - bits)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def extremes(new: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest id of each entry's group; new: whether an entry begins a group."""
    first = np.flatnonzero(new)
    if not len(first):
        return ids, ids
    times = np.diff(np.append(first, len(ids)))
    return np.repeat(np.minimum.reduceat(ids, first), times), np.repeat(np.maximum.reduceat(ids, first), times)


def begins(*keys: np.ndarray) -> np.ndarray:
    """Whether an entry differs from the one before in any key."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def digests(text: bytes, candidates: np.ndarray, width: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows whose hashes are among the candidates (ascending): where they start, and both halves of the digests of their words."""
    h, _ = doc_windows([text], width)
    if not len(h) or not len(candidates):
        return np.zeros(0, np.int64), np.zeros(0, C.U64), np.zeros(0, C.U64)
    h = h >> C.U64(64 - bits) << C.U64(64 - bits)
    at = np.flatnonzero(candidates[np.minimum(np.searchsorted(candidates, h), len(candidates) - 1)] == h)
    words = text.split()
    joined, ends = memoryview(b" ".join(words)), np.cumsum([len(w) + 1 for w in words])
    start, end = np.concatenate(([0], ends[:-1]))[at], ends[at + width - 1] - 1
    made = b"".join([hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    halves = np.frombuffer(made, C.U64).reshape(-1, 2)
    return at, halves[:, 0], halves[:, 1]


_SENT = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("used", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary()), ("low", pa.binary()), ("places", pa.binary()), ("times", pa.binary()), ("at", pa.binary()), ("local", pa.binary())])
_SENT_DDL = "bucket int, unit long, used binary, ids binary, keys binary, low binary, places binary, times binary, at binary, local binary"
_BACK = pa.schema([("unit", pa.int64()), ("used", pa.binary()), ("found", pa.binary()), ("local", pa.binary())])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> C.U64(32)) * C.U64(n) >> C.U64(32)).astype(np.int64)


def pairs(place: np.ndarray, x: np.ndarray) -> bytes:
    """Packed pairs of a place and a number below 2**32."""
    return pack_hashes(np.sort(place.astype(np.uint64) << C.U64(32) | x.astype(np.uint64))) if len(place) else b""


def unpack_pairs(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = unpack_hashes(b) if b else np.zeros(0, np.uint64)
    return (x >> C.U64(32)).astype(np.int64), (x & C.U64(0xFFFFFFFF)).astype(np.int64)


def unit_of(ids: np.ndarray, keys: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(ids.tobytes() + keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def _roster(unit: int, keys: np.ndarray, n: int) -> tuple:
    """The row that tells a unit's documents; it goes through a bucket to where the unit is gathered."""
    return (unit % n, unit, b"", b"", keys.tobytes(), b"", b"", b"", b"", b"")


def _candidates(rows: DataFrame, width: int, n: int, bits: int) -> DataFrame:
    """(doc_key, hashes): of each document, the packed hashes of windows that some document with another id seems to hold too."""

    most_bytes = UNIT_BYTES

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only()
        for ids, keys, texts, _ in units(batches, most_bytes):
            h, place = distinct_windows(texts, width, bits)
            unit, doc = unit_of(ids, keys), ids[place]
            new = begins(h)
            least, most = extremes(new, doc)
            outer = new | np.append(new[1:], True)[: len(new)]  # of a hash that several documents of the unit share, only two are told
            inner = (least != most) & ~outer
            bucket, rows = bucket_of(h, n), [_roster(unit, keys, n)]
            begin = np.searchsorted(bucket, np.arange(n + 1))
            for b in np.flatnonzero(np.diff(begin)).tolist():
                s = slice(begin[b], begin[b + 1])
                told, kept = ~inner[s], inner[s]
                used, at = np.unique(place[s], return_inverse=True)  # a row names the documents it speaks of, ascending
                local = pack_hashes(h[s][kept]) + pack_places(at[kept]) if kept.any() else b""
                rows.append((b, unit, pack_places(used), pack_hashes(ids[used].view(C.U64)), pack_hashes(h[s][told]), b"", pack_places(at[told]), b"", b"", local))
                if len(rows) >= 64:
                    yield C.table_rows(_SENT, rows)
                    rows = []
            if rows:
                yield C.table_rows(_SENT, rows)

    def find(table: pa.Table) -> pa.Table:
        C.only()
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        out, real = [], []
        for k, used in enumerate(cols["used"]):
            real.append(k) if used else out.append((cols["unit"][k], b"", cols["keys"][k], b""))
        hashes, places = [unpack_hashes(cols["keys"][k]) for k in real], [unpack_places(cols["places"][k]) for k in real]
        h = np.concatenate([*hashes, np.zeros(0, C.U64)])
        doc = np.concatenate([*(unpack_hashes(cols["ids"][k]).view(np.int64)[p] for k, p in zip(real, places, strict=True)), np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        least, most = extremes(begins(h[order]), doc[order])
        back = np.empty(len(h), bool)
        back[order] = least != most
        edge = np.cumsum([0, *map(len, hashes)])
        for j, k in enumerate(real):
            s = slice(edge[j], edge[j + 1])
            if back[s].any() or cols["local"][k]:
                out.append((cols["unit"][k], cols["used"][k], pack_hashes(h[s][back[s]]) + pack_places(places[j][back[s]]), cols["local"][k]))
        return pa.Table.from_batches([C.table_rows(_BACK, out)])

    def gather(table: pa.Table) -> pa.Table:
        C.only()
        keys, place, h = _unit_parts(table, split_local)
        order = np.lexsort((h, place))
        place, h = place[order], h[order]
        keep = begins(place, h)
        return _by_document(keys, place[keep], h[keep], "hashes")

    return _round(rows.select("doc_id", "doc_key", "text").mapInArrow(send, _SENT_DDL), find, gather, "hashes")


def _decided(rows: DataFrame, width: int, n: int, bits: int) -> DataFrame:
    """(doc_key, hashes): of each document, packed, where the windows start whose words a document with a smaller id holds too. rows: doc_id, doc_key, text, hashes."""

    most_bytes = UNIT_BYTES

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only()
        for ids, keys, texts, hashes in units(batches, most_bytes):
            found = [digests(t, unpack_hashes(x), width, bits) for t, x in zip(texts, hashes, strict=True)]
            place = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            pos, high, low = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((pos, place, low, high))
            place, pos, high, low = place[order], pos[order], high[order], low[order]
            unit, doc = unit_of(ids, keys), ids[place]
            least, _ = extremes(begins(high, low), doc)
            again = doc > least  # known here; only the smallest documents are told
            bucket, rows = bucket_of(high, n), [_roster(unit, keys, n)]
            begin = np.searchsorted(bucket, np.arange(n + 1))
            for b in np.flatnonzero(np.diff(begin)).tolist():
                s = slice(begin[b], begin[b + 1])
                used, at = np.unique(place[s], return_inverse=True)
                told = np.flatnonzero(~again[s])
                first = told[begins(high[s][told], low[s][told], at[told])]
                times = np.diff(np.append(np.searchsorted(told, first), len(told)))
                rows.append((b, unit, pack_places(used), pack_hashes(ids[used].view(C.U64)), pack_hashes(high[s][first]), low[s][first].tobytes(), pack_places(at[first]), pack_places(times), pack_places(pos[s][told]), pairs(at[again[s]], pos[s][again[s]])))
                if len(rows) >= 64:
                    yield C.table_rows(_SENT, rows)
                    rows = []
            if rows:
                yield C.table_rows(_SENT, rows)

    def find(table: pa.Table) -> pa.Table:
        C.only()
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        out, real = [], []
        for k, used in enumerate(cols["used"]):
            real.append(k) if used else out.append((cols["unit"][k], b"", cols["keys"][k], b""))
        highs, places = [unpack_hashes(cols["keys"][k]) for k in real], [unpack_places(cols["places"][k]) for k in real]
        high = np.concatenate([*highs, np.zeros(0, C.U64)])
        low = np.frombuffer(b"".join(cols["low"][k] for k in real), C.U64)
        doc = np.concatenate([*(unpack_hashes(cols["ids"][k]).view(np.int64)[p] for k, p in zip(real, places, strict=True)), np.zeros(0, np.int64)])
        order = np.lexsort((low, high))
        least, _ = extremes(begins(high[order], low[order]), doc[order])
        back = np.empty(len(high), bool)
        back[order] = doc[order] > least
        edge = np.cumsum([0, *map(len, highs)])
        for j, k in enumerate(real):
            mine = back[edge[j] : edge[j + 1]]
            if mine.any() or cols["local"][k]:
                times, at = unpack_places(cols["times"][k]), unpack_places(cols["at"][k])
                out.append((cols["unit"][k], cols["used"][k], pairs(np.repeat(places[j], times)[np.repeat(mine, times)], at[np.repeat(mine, times)]), cols["local"][k]))
        return pa.Table.from_batches([C.table_rows(_BACK, out)])

    def gather(table: pa.Table) -> pa.Table:
        C.only()
        keys, place, at = _unit_parts(table, lambda b: unpack_pairs(b)[::-1])
        order = np.lexsort((at, place))
        return _by_document(keys, place[order], at[order].astype(C.U64), "hashes")

    return _round(rows.select("doc_id", "doc_key", "text", "hashes").mapInArrow(send, _SENT_DDL), find, gather, "hashes")


def _unit_parts(table: pa.Table, unpack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of what came back for one unit: the keys of its documents, and places and values of all that was found."""
    keys, place, value = np.zeros(0, np.int64), [np.zeros(0, np.int64)], []
    for used, found, local in zip(*(table.column(c).to_pylist() for c in ("used", "found", "local")), strict=True):
        if not used:
            keys = np.frombuffer(found, np.int64)
            continue
        names = unpack_places(used)
        for part in (found, local):
            x, p = unpack(part)
            place.append(names[p])
            value.append(x)
    return keys, np.concatenate(place), np.concatenate(value) if value else np.zeros(0, C.U64)


def _by_document(keys: np.ndarray, place: np.ndarray, value: np.ndarray, name: str) -> pa.Table:
    first = np.flatnonzero(begins(place)).tolist() if len(place) else []
    rows = [(int(keys[place[a]]), pack_hashes(value[a:b])) for a, b in zip(first, [*first[1:], len(place)], strict=False)]
    return pa.Table.from_batches([C.table_rows(pa.schema([("doc_key", pa.int64()), (name, pa.binary())]), rows)])


def _round(sent: DataFrame, find, gather, name: str) -> DataFrame:
    found = sent.groupBy("bucket").applyInArrow(find, "unit long, used binary, found binary, local binary")
    back = found.groupBy("unit").applyInArrow(gather, f"doc_key long, {name} binary")
    return C.stage(back.groupBy("doc_key").agg(F.min(name).alias(name)))  # rows alike in id and text have the same, from any unit


def split_local(local: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    if not local:
        return np.zeros(0, C.U64), np.zeros(0, np.int64)
    reader = zstandard.ZstdDecompressor().decompressobj()
    reader.decompress(local)
    size = len(local) - len(reader.unused_data)
    return unpack_hashes(local[:size]), unpack_places(local[size:])


def units(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], list]]:
    """Documents of a task in units of some MB, by ascending id and key within a unit: ids, keys, texts, and a fourth column if there is one; of rows alike in both, one."""
    held: dict[tuple[int, int], tuple] = {}
    size = 0

    def made():
        order = sorted(held)
        ids, keys = np.array(order, np.int64).T.copy()
        return ids, keys, [held[k][0] for k in order], [held[k][1] for k in order]

    for batch in batches:
        more = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
        for i, key, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), C.blobs(batch.column(2)), more, strict=True):
            if (i, key) in held:
                continue
            held[i, key] = t, x
            size += len(t)
            if size >= most_bytes:
                yield made()
                held, size = {}, 0
    if held:
        yield made()


def kept_words(text: bytes, removed: bytes | None, width: int) -> tuple[list[bytes], int, list[tuple[int, int]]]:
    """The words left, how many there were, and the maximal removal intervals [first, last + 1) in words."""
    words = text.split()
    if not removed:
        return words, len(words), []
    hit = unpack_hashes(removed).astype(np.int64)
    breaks = np.flatnonzero(np.diff(hit) > width)
    spans = list(zip(hit[np.append(0, breaks + 1)].tolist(), (hit[np.append(breaks, len(hit) - 1)] + width).tolist(), strict=True))
    kept, last = [], 0
    for a, b in spans:
        kept += words[last:a]
        last = b
    return kept + words[last:], len(words), spans


def dedup_substrings(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), untouched: bool = False, bits: int = 64) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256, removed (intervals of words), and the columns to carry.

    Carried columns travel beside the text, so that no further join is needed to have them again. untouched: kept_text is
    the text as it was, white space included, where nothing is removed.

    bits: how many bits of the Rabin-Karp hashes choose candidates; fewer choose more and change no result.

    Words are runs of other bytes than 0x20 and 0x09-0x0D. A word goes if a window of `width` words that covers it also
    starts in a document with a smaller id; windows are judged on the input, and equal if their words are (by 128-bit
    digests; Rabin-Karp hashes only choose candidates). Copies in the first document that has them stay, repeats within one
    document too. Null text: no words. A null id is compared with nothing and loses nothing; rows that share an id are one
    document here (their common windows don't remove each other). Fewer words than `width`: all stay. Very long texts are
    units of their own. An empty table gives an empty one; further columns, of any name, are ignored.
    """
    C.session(docs)
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("doc_key")
    beside = docs.select(key, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    rows = beside.select("doc_id", "doc_key", "text").where("doc_id is not null and text <> ''")
    n = C.buckets(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BUCKET_BYTES)
    candidates = _candidates(rows, width, n, bits)
    decided = _decided(rows.join(candidates, "doc_key"), width, n, bits)
    C.drop(candidates)
    joined = beside.join(decided, "doc_key", "left").select("doc_id", "text", "hashes", *[f"carried_{k}" for k in range(len(carry))])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only()
        for batch in batches:
            out = []
            for i, text, removed in zip(batch.column(0).to_pylist(), C.blobs(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words, n, spans = kept_words(text, removed, width)
                kept = b" ".join(words)
                out.append((i, n, n - len(words), (text if untouched and not spans else kept).decode(), hashlib.sha256(kept).hexdigest(), [{"first": a, "end": b} for a, b in spans]))
            made = C.table_rows(schema, out)
            yield pa.RecordBatch.from_arrays([*made.columns, *batch.columns[3:]], names=[*schema.names, *[f"carried_{k}" for k in range(len(carry))]])

    kinds = "".join(f", carried_{k} {docs.select(c).schema[0].dataType.simpleString()}" for k, c in enumerate(carry))
    out = joined.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, removed array<struct<first:long,end:long>>" + kinds)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "removed", *[F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)])
