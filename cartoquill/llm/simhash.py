"""SimHash near-dedup (op 5): pivot distance tables within exact blocks, links contracted to components in Spark."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: The reference fingerprints to which distances are tabulated: fixed values of a rule.
PIVOTS = C.mix(np.arange(1, 13, dtype=np.uint64) * C.U64(C._BASE))
#: A block with more fingerprints than this is compared in square tiles by several tasks.
TILE = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The majority of the bits of XXH64 (seed 42) of all word shingles of the lower-cased text; no words: 0."""
    import xxhash

    words = text.translate(C.LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1]
    view = memoryview(joined)
    total, n = np.zeros(64, np.int64), len(starts)
    for a in range(0, n, 1 << 16):
        h = np.array([digest(view[s:e], SEED) for s, e in zip(starts[a : a + (1 << 16)].tolist(), (ends[shingle - 1 :][a : a + (1 << 16)] - 1).tolist(), strict=True)], np.uint64)
        for k in range(8):  # byte k of every hash, as eight bits
            total[8 * k : 8 * k + 8] += np.unpackbits(h.view(np.uint8)[k::8].reshape(-1, 1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in range(64) if 2 * total[k] > n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of each row; null text: as empty."""
    C.session(docs)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only()
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in C.blobs(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return C.texts_of(docs, id_col, text_col).mapInArrow(make, "doc_id long, fp long")


def masks(distance: int, spare: int = 2) -> list[int]:
    """64 bits fall into distance + spare blocks; two fingerprints within the distance agree on `spare` of them, so on one of these masks."""
    n = distance + spare
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(blocks, spare)]


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def forest(fp: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, smaller fingerprint) that span the same components as all links within the groups; rows ascend by group and fingerprint.

    side: 0 and 1 for the two halves of a tile between which links count, 2 where all do. Pairs are compared at growing
    places apart; the pivot table discards by the maximum coordinate difference, what is left is verified.
    """
    bits = fp.view(np.uint64)
    table = np.bitwise_count(bits[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    parent = np.arange(len(fp))
    left = np.searchsorted(group, group, side="right") - np.arange(len(fp)) - 1
    at = np.flatnonzero(left > 0)
    apart = 0
    while len(at):
        apart += 1
        at = at[left[at] >= apart]
        i, j = at, at + apart
        ok = (side[i] == 2) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        for p in range(len(PIVOTS)):
            near = np.abs(table[i, p] - table[j, p]) <= distance
            i, j = i[near], j[near]
            if len(i) < 64:
                break
        near = np.bitwise_count(bits[i] ^ bits[j]) <= distance
        i, j = i[near], j[near]
        new = parent[i] != parent[j]
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
        if new.any():
            parent = roots(parent)
    child = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[child], fp[parent[child]]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (child, root) between different fingerprints: in each block and tile a spanning forest of the links. distinct: fp."""
    C.session(distinct)
    keys = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("key")) for k, m in enumerate(masks(distance))])).alias("b")).select("fp", "b.k", "b.key")
    large = C.stage(keys.groupBy("k", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("t")).cast("int")
    dealt = keys.join(large, ["k", "key"], "left").withColumn("t", F.coalesce(tiles, F.lit(1))).withColumn("own", own)
    dealt = dealt.select("fp", "k", "key", "own", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("other"))
    dealt = dealt.select("fp", F.xxhash64("k", "key", F.least("own", "other"), F.greatest("own", "other")).alias("block"), F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).cast("int").alias("side"))

    def edges(fp: np.ndarray, block: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        run = np.diff(np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))))
        several = np.repeat(run, run) > 1
        child, root = forest(fp[several], block[several], side[several], distance)
        return pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(root, pa.int64())], names=["child", "root"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]  # a block that may go on in the next batch
        for batch in batches:
            held = [np.concatenate((a, batch.column(c).to_numpy())) for c, a in enumerate(held)]
            whole = int(np.flatnonzero(held[1] != held[1][-1])[-1]) + 1 if len(held[1]) and (held[1] != held[1][-1]).any() else 0
            if whole:
                yield edges(*(a[:whole] for a in held))
                held = [a[whole:] for a in held]
        if len(held[0]):
            yield edges(*held)

    return dealt.select("fp", "block", "side").repartition("block").sortWithinPartitions("block", "fp").mapInArrow(compare, "child long, root long")


#: Edges that one task of a round handles, about.
EDGES = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(child, root): the smallest number that each child reaches. edges: (child, root) with root < child.

    Each round keeps one edge from each child to its smallest root, follows that root's own edge, and ties the child's
    other roots to the smallest: all labels fall, until no child has two roots and no root is a child; as they only fall,
    that comes. Rounds are written to the shared folder, by as many tasks as their edges ask for, and the one before is
    removed; nothing is collected but counts.
    """
    edges = C.stage(edges.distinct())
    while True:
        tasks = 1 + edges.count() // EDGES
        least = C.stage(edges.groupBy("child").agg(F.min("root").alias("root")).coalesce(tasks))
        up = least.select(F.col("child").alias("root"), F.col("root").alias("up"))
        jumped = least.join(up, "root", "left").select("child", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        rest = edges.join(least.withColumnRenamed("root", "low"), "child").where("root > low").select(F.col("root").alias("child"), F.col("low").alias("root"), F.lit(True).alias("moved"))
        union = C.stage(jumped.unionByName(rest).groupBy("child", "root").agg(F.max("moved").alias("moved")).coalesce(tasks))
        C.drop(edges, least)
        edges = union
        if union.where("moved").isEmpty():
            return union.select("child", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links of at most `distance` bits).

    Equal fingerprints are one vertex. Links are found exactly: two fingerprints within the distance share one of the
    mask blocks, where pivot tables and then the bits themselves decide; blocks of any size are tiled over tasks and pass
    on spanning forests, never all pairs. Very long texts count whole; further columns, of any name, are ignored. Null and empty texts have fingerprint zero, linked like any other. A null id gets
    its component's smallest id (null if it has no other). Repeated rows each give a row; an empty table an empty one.
    """
    C.session(docs)
    fps = C.stage(fingerprints(docs, shingle, id_col, text_col))
    distinct = C.stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    settled = components(links(distinct.select("fp"), distance))
    members = settled.select(F.col("child").alias("fp"), "root").unionByName(settled.select(F.col("root").alias("fp"), "root").distinct())
    smallest = C.stage(members.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id")))
    linked = C.stage(members.join(smallest, "root").select("fp", "component_id"))
    found = C.stage(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return fps.join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
