"""Benchmark decontamination (op 10): greedy string tiling of benchmark items over documents by running Karp-Rabin matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .licenses import FOLD

#: Shortest tile in words, and the share of an item's words that tiles must cover.
SHORTEST, COVERAGE = 4, 0.5
#: Items of at most so many bytes are sent to the tasks; more are joined by their seeds.
SENT_BYTES = 8 << 20
_PRIME = (1 << 31) - 1


class Collision(Exception):
    """Two different windows have the same hash."""


class Rolling:
    """Karp-Rabin hashes of windows of any length of word numbers, in two prime fields at once."""

    def __init__(self, numbers: np.ndarray, seed: int, top: int):
        self.top, self.fields = top, []
        for k in (0, 1):
            base = 1 + int(C.mix(np.array([2 * seed + k + 1], np.uint64))[0]) % (_PRIME - 1)
            power = np.ones(1, np.uint64)
            while len(power) <= top:
                power = np.concatenate((power, power * C.U64(pow(base, len(power), _PRIME)) % C.U64(_PRIME)))
            terms = (numbers.astype(np.uint64) + C.U64(1)) * power[: len(numbers)] % C.U64(_PRIME)
            self.fields.append((power, np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))))

    def windows(self, starts: np.ndarray, length: int) -> np.ndarray:
        a, b = ((sums[starts + length] - sums[starts]) % C.U64(_PRIME) * power[self.top - starts] % C.U64(_PRIME) for power, sums in self.fields)
        return a << C.U64(31) | b


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Where windows of a length start that hold no marked word."""
    sums = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(sums[length:] == sums[:-length]) if length <= len(marked) else np.zeros(0, np.int64)


def _tiles(item: np.ndarray, doc: np.ndarray, shortest: int, seed: int) -> list[tuple[int, int, int]]:
    top = max(len(item), len(doc))
    of_item, of_doc = Rolling(item, seed, top), Rolling(np.maximum(doc, 0), seed, top)
    in_item, in_doc, out = np.zeros(len(item), bool), doc < 0, []

    def candidates(length: int):
        a, b = _free(in_item, length), _free(in_doc, length)
        ka, kb = of_item.windows(a, length), of_doc.windows(b, length)
        order = np.argsort(ka, kind="stable")
        at = np.minimum(np.searchsorted(ka[order], kb), max(len(ka) - 1, 0)) if len(ka) else np.zeros(0, np.int64)
        hit = np.flatnonzero(ka[order][at] == kb) if len(ka) else at
        if len(hit):
            same(int(a[order][at[hit[0]]]), int(b[hit[0]]), length)
        return a, ka, b[hit], kb[hit]

    def same(a: int, b: int, length: int) -> None:
        if not (item[a : a + length] == doc[b : b + length]).all():
            raise Collision

    most = min(len(item), len(doc))
    while most >= shortest and len(candidates(shortest)[2]):
        low = shortest  # the search length runs down: the longest one that still has a match
        while low < most:
            middle = (low + most + 1) // 2
            low, most = (middle, most) if len(candidates(middle)[2]) else (low, middle - 1)
        a, ka, b, kb = candidates(low)
        order = np.argsort(kb, kind="stable")
        b, kb = b[order], kb[order]
        begin, end = np.searchsorted(kb, ka), np.searchsorted(kb, ka, side="right")
        reached: dict[int, int] = {}
        for x, p, q in zip(a.tolist(), begin.tolist(), end.tolist(), strict=True):
            if p == q or in_item[x] or in_item[x + low - 1]:
                continue
            k = reached.get(p, p)
            while k < q and (in_doc[b[k]] or in_doc[b[k] + low - 1]):
                k += 1
            if k < q:
                y = int(b[k])
                same(x, y, low)
                in_item[x : x + low] = in_doc[y : y + low] = True
                out.append((x, y, low))
                k += 1
            reached[p] = k
        most = low - 1
    return out


def tiles(item: list[bytes], doc: list[bytes | None], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, length): again and again the longest match whose words are
    all unmarked on both sides (ties: the first place in the item, then in the document) is marked, down to the shortest.

    Words are numbered, so that matches are compared word by word. If two different windows ever share a hash, all is
    hashed anew with other bases. None in the document matches nothing.
    """
    number: dict[bytes, int] = {}
    own = np.array([number.setdefault(w, len(number)) for w in item], np.int64)
    other = np.array([number.get(w, -1) for w in doc], np.int64)
    seed = 0
    while True:
        try:
            return _tiles(own, other, shortest, seed)
        except Collision:
            seed += 1


class Items:
    """The words of items, and their seeds by width: hashes of all windows of the shortest tile (of all words, if an item has fewer), ascending, with item and place."""

    def __init__(self, rows: list[tuple[int, bytes]], shortest: int):
        self.ids = [i for i, _ in rows]
        self.words = [t.translate(FOLD).split() for _, t in rows]
        self.shortest = np.array([min(shortest, len(w)) for w in self.words], np.int64)
        self.n_words = np.array([len(w) for w in self.words], np.int64)
        hashes = [C.word_hashes(t.translate(FOLD))[0] for _, t in rows]
        self.seeds = {}
        for width in sorted({*self.shortest.tolist()} - {0}):
            which = np.flatnonzero(self.shortest == width)
            windows = [C.window_hashes(hashes[k], width) for k in which.tolist()]
            seed, item, place = np.concatenate(windows), np.repeat(which, [len(w) for w in windows]), np.concatenate([np.arange(len(w)) for w in windows])
            order = np.argsort(seed, kind="stable")
            self.seeds[width] = seed[order], item[order], place[order]


def reach(item: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Items, and how many of each one's words lie in its windows at these places."""
    order = np.lexsort((place, item))
    item, place = item[order], place[order]
    step = np.minimum(np.append(np.diff(place), width), width)
    step[np.append(item[1:] != item[:-1], True)] = width
    first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
    return item[first], np.add.reduceat(step, first)


def match(docs: list[bytes], items: Items, coverage: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(document's place, item's place, tiles, words covered, coverage) where tiles cover enough."""
    words, doc, _, _ = C.unit_words([d.translate(FOLD) for d in docs])
    begins = np.searchsorted(doc, np.arange(len(docs) + 1))
    split: dict[int, list[bytes]] = {}
    for width, (seeds, item, place) in items.seeds.items():
        h = C.window_hashes(words, width)
        if not len(h):
            continue
        low = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
        hit = np.flatnonzero((seeds[low] == h) & (doc[: len(h)] == doc[width - 1 :]))
        cuts = np.searchsorted(doc[hit], np.arange(len(docs) + 1))
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            at = hit[cuts[d] : cuts[d + 1]]
            left = np.unique(low[at])  # each seed once, however often the document has it
            times = np.searchsorted(seeds, seeds[left], side="right") - left
            entry = np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            who, most = reach(item[entry], place[entry], width)
            for k in who[most >= coverage * items.n_words[who]].tolist():
                if split.keys() != {d}:
                    split = {d: docs[d].translate(FOLD).split()}
                found = cover(items.words[k], split[d], at[np.isin(h[at], seeds[entry[item[entry] == k]])] - begins[d], width)
                covered = sum(x[2] for x in found)
                if covered >= coverage * items.n_words[k]:
                    yield d, k, len(found), covered, covered / int(items.n_words[k])


def cover(item: list[bytes], doc: list[bytes], at: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles of an item over a document, of which only the windows at these places can match. Places are those in the document."""
    change = np.zeros(len(doc) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    inside = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    gap = np.flatnonzero(np.diff(inside) > 1) + 1
    kept = np.insert(inside, gap, -1)
    return [(a, int(kept[b]), n) for a, b, n in tiles(item, [None if k < 0 else doc[k] for k in kept.tolist()], width)]


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """doc_id, item_id, n_tiles, n_covered, coverage (and the long key_col, if one is named): pairs whose tiles cover at least the share `coverage` of the item's words.

    Words are lower-cased runs of letters, digits and bytes above 0x7F. All items meet all documents, in one pass over these
    and without a shuffle where the items have at most SENT_BYTES; more items are joined with the documents by their seeds.
    Seeds only choose pairs, each once for a document and item, however often it recurs; the words decide. An item with
    fewer words than `shortest` is a tile as a whole; items without words, and null or empty texts, match nothing. Very
    long documents are tiled in the parts that share seeds. Ties go to the first place. Repeated rows each give their
    pairs; empty tables give none; further columns, clashing names too, are ignored.
    """
    spark = C.session(docs)
    rows = C.texts_of(docs, id_col, text_col, key_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).where("item is not null")
    size = items.agg(F.sum(F.octet_length("item") + 64)).first()[0] or 0
    out = _sent(spark, rows, items, shortest, coverage) if size <= SENT_BYTES else _joined(rows, items, shortest, coverage)
    return out.select("doc_id", "item_id", "n_tiles", "n_covered", "coverage", *([F.col("doc_key").alias(key_col)] if key_col else []))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("item_id", pa.int64()), ("n_tiles", pa.int64()), ("n_covered", pa.int64()), ("coverage", pa.float64())])
_DDL = "doc_id long, doc_key long, item_id long, n_tiles long, n_covered long, coverage double"


def _sent(spark, rows: DataFrame, items: DataFrame, shortest: int, coverage: float) -> DataFrame:
    held = spark.sparkContext.broadcast([(r["item_id"], r["item"].encode()) for r in items.orderBy("item_id", "item").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only()
        known = Items(held.value, shortest)
        for batch in batches:
            ids, texts, keys = batch.column(0).to_pylist(), C.blobs(batch.column(1)), batch.column(2).to_pylist()
            for a, b in C.parts([len(t) for t in texts], 2 << 20):
                yield C.table_rows(_SCHEMA, [(ids[a + d], keys[a + d], known.ids[i], x, y, z) for d, i, x, y, z in match(texts[a:b], known, coverage)])

    return rows.mapInArrow(run, _DDL)


def _joined(rows: DataFrame, items: DataFrame, shortest: int, coverage: float) -> DataFrame:
    """The same for items of any number: seeds of both sides are joined, pairs whose seeds reach far enough get their texts and are tiled."""
    items = C.stage(items.withColumn("item_key", F.xxhash64("item_id", "item", F.monotonically_increasing_id())))
    rows = C.stage(rows.withColumn("row", F.monotonically_increasing_id()))

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only()
        for batch in batches:
            known = Items(list(zip(batch.column(0).to_pylist(), C.blobs(batch.column(1)), strict=True)), shortest)
            for width, (seed, item, place) in known.seeds.items():
                keys = np.array(known.ids, np.int64)[item]
                yield pa.RecordBatch.from_arrays([pa.array(C.mix(seed + C.U64(width)).view(np.int64)), pa.array(keys), pa.array(place.astype(np.int32)), pa.array(known.n_words[item].astype(np.int32)), pa.array(np.full(len(seed), width, np.int32))], names=["seed", "item_key", "place", "n_words", "width"])

    seeds = C.stage(items.select("item_key", "item").mapInArrow(item_seeds, "seed long, item_key long, place int, n_words int, width int"))
    widths = [r[0] for r in seeds.select("width").distinct().collect()]

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only()
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), C.blobs(batch.column(1)), strict=True):
                words, _ = C.word_hashes(text.translate(FOLD))
                some = np.concatenate([np.zeros(0, np.uint64), *[C.mix(np.unique(C.window_hashes(words, w)) + C.U64(w)) for w in widths]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row)), pa.array(some.view(np.int64))], names=["row", "seed"])

    shared = rows.select("row", "text").mapInArrow(doc_seeds, "row long, seed long").join(seeds, "seed")
    pairs = shared.groupBy("row", "item_key").agg(F.count_distinct("place").alias("places"), F.first("n_words").alias("n_words"), F.first("width").alias("width")).where(F.col("places") * F.col("width") >= coverage * F.col("n_words"))
    both = C.stage(pairs.select("row", "item_key")).join(items, "item_key").join(rows, "row").select("doc_id", "doc_key", "text", "item_id", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only()
        for batch in batches:
            for doc_id, doc_key, text, item_id, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = Items([(item_id, item.encode())], shortest)
                yield C.table_rows(_SCHEMA, [(doc_id, doc_key, item_id, x, y, z) for _, _, x, y, z in match([(text or "").encode()], known, coverage)])

    return both.mapInArrow(run, _DDL)
