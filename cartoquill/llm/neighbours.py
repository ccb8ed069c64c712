"""Approximate nearest neighbours (op 4): a block matrix join with int8 tiles, error bounds, exact recomputation, and heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

QUERY_BLOCK, ROW_BLOCK = 2048, 8192


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each vector (x is about code * scale), and a bound of each vector's error norm."""
    scale = np.abs(x).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1)
    code = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return code, scale, error


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed in the order of the components, so that equal vectors tie exactly."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def tile(q: np.ndarray, x: np.ndarray, uids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, the k rows with the largest inner products but for its own, ties to the first: (query's place, their places, their scores).

    The int8 product p has |p - exact| <= |q| e(x) + |x| e(q) + e(q) e(x); a pair survives if its upper bound reaches
    the k-th largest lower bound, so that none of the k best is lost."""
    qc, qs, qe = quantise(q)
    xc, xs, xe = quantise(x)
    qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    exactly = xc.astype(np.float32 if q.shape[1] <= 1000 else np.float64)  # sums of int8 products stay whole numbers
    for a in range(0, len(q), 128):
        some = slice(a, min(len(q), a + 128))
        p = (qc[some].astype(exactly.dtype) @ exactly.T) * qs[some, None] * xs[None, :]
        slack = (qn[some, None] * xe[None, :] + qe[some, None] * xn[None, :] + qe[some, None] * xe[None, :]) * 1.000001 + 1e-9 * qn[some, None] * xn[None, :]
        p[own[some, None] == uids[None, :]] = -np.inf
        low = p - slack
        n = min(k, low.shape[1])
        least = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n]
        rows, cols = np.nonzero((p + slack >= least[:, None]) & np.isfinite(p))
        score = exact(q[some][rows], x[cols])
        order = np.lexsort((cols, -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        begin = np.searchsorted(rows, np.arange(some.stop - a + 1))
        for i in range(some.stop - a):
            best = slice(begin[i], min(begin[i + 1], begin[i] + k))
            yield a + i, cols[best], score[best]


class Heap:
    """The k best of one query so far: a heap whose root is the worst, by score, then by id and row."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def merge(self, score: list[float], vec: list[int], uid: list[int]) -> None:
        for s, i, u in zip(score, vec, uid, strict=True):
            row = (s, -i, -u)
            if len(self.rows) < self.k:
                heapq.heappush(self.rows, row)
            elif row > self.rows[0]:
                heapq.heapreplace(self.rows, row)


def merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Lists of (query_uid, query_id, vec_id, uid, score) merged by a heap for each query; best first, with ranks."""
    heaps: dict[tuple[int, int], Heap] = {}
    for batch in batches:
        query, own, vec, uid, score = (batch.column(c).to_pylist() for c in range(5))
        edge = [0, *(i for i in range(1, len(query)) if query[i] != query[i - 1]), len(query)]
        for a, b in zip(edge, edge[1:], strict=False):
            if a < b:
                heaps.setdefault((query[a], own[a]), Heap(k)).merge(score[a:b], vec[a:b], uid[a:b])
    done = [(q, i, h.rows) for (q, i), h in heaps.items()]
    for a in range(0, len(done), 4096):
        rows = [(q, i, -v, -u, s, r) for q, i, held in done[a : a + 4096] for r, (s, v, u) in enumerate(sorted(held, reverse=True), 1)]
        yield C.table_rows(_MERGED, rows)


_MERGED = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())])
_DDL = "query_uid long, query_id long, vec_id long, uid long, score double, rank int"


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows.

    Nearness is the inner product in double precision, ties go to the smaller id. Queries and rows are dealt into blocks;
    each pair of blocks is a tile, whose k best per query (exact, see tile) are merged by heaps, in the tasks that made them
    and again by query. Null and zero vectors, and those with null or non-finite components, take no part, nor do null ids;
    a vector of another length than the others in its block only meets those of its own length. Rows that share an id are
    rows of their own, as queries (each with its ranks) and as neighbours, of each other too. With fewer candidates than k,
    all are returned; an empty table gives an empty one; further columns, of any name, are ignored.
    """
    spark = C.session(vectors)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    v = C.stage(v.withColumn("uid", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    queries = v.where(F.col("vec_id") % every == 0)
    n_q, n_x = queries.count(), v.count()
    if not n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    b_q, b_x = -(-n_q // QUERY_BLOCK), max(-(-n_x // ROW_BLOCK), min(C.deal(spark, 1), -(-n_x // 512)))
    dim = F.size("v").alias("dim")
    left = queries.select(F.lit(True).alias("is_query"), "uid", "vec_id", "v", dim, C.clean_bucket("uid", n=b_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(b_x - 1))).alias("xb"))
    right = v.select(F.lit(False).alias("is_query"), "uid", "vec_id", "v", dim, F.explode(F.sequence(F.lit(0), F.lit(b_q - 1))).alias("qb"), F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(b_x)).cast("int").alias("xb"))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        query = table.column("is_query").to_numpy(zero_copy_only=False)
        ids, uids = table.column("vec_id").to_numpy(), table.column("uid").to_numpy()
        flat = table.column("v").combine_chunks()
        at = flat.offsets.to_numpy()
        data = flat.values.to_numpy()[at[0] : at[-1]]
        m = data.reshape(-1, key[2].as_py())
        order = np.flatnonzero(~query)[np.lexsort((uids[~query], ids[~query]))]  # so that places stand for ids in ties
        found = list(tile(m[query], m[order], uids[order], uids[query], k)) if query.any() and len(order) else []
        sizes = [len(x[1]) for x in found]
        which, place = np.repeat([x[0] for x in found], sizes).astype(np.int64), np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        return pa.table({
            "query_uid": pa.array(uids[query][which]), "query_id": pa.array(ids[query][which]), "vec_id": pa.array(ids[order][place]), "uid": pa.array(uids[order][place]),
            "score": pa.array(np.concatenate([x[2] for x in found]) if found else [], pa.float64()),
        })

    heaps = lambda batches: merged(batches, k)
    tiles = left.unionByName(right).groupBy("qb", "xb", "dim").applyInArrow(search, "query_uid long, query_id long, vec_id long, uid long, score double")
    some = tiles.mapInArrow(heaps, _DDL).drop("rank")
    return some.repartition("query_uid").mapInArrow(heaps, _DDL).select("query_id", "rank", "vec_id", "score")
