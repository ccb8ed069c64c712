"""Training on slates that Spark makes, by gradient descent on the pair loss, summed on the executors: the fusion's four parameters, or the plain ranker with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import materialise
from .ranker import SLOPE, Ranker


def pair_sums(p: np.ndarray, z: np.ndarray, near: np.ndarray, positive: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Number of pairs of a query's positives and others, the sum of -log sigmoid(s_i - s_j) over them, and its gradient by (a, b, c, d)."""
    a, b, c, d = p
    g = 1 / (1 + np.exp(-(a * z + b)))
    s = (c - g) * (near - d)
    slope = np.stack([-g * (1 - g) * z * (near - d), -g * (1 - g) * (near - d), near - d, -(c - g)], axis=1)
    out = np.zeros(6)
    for q in np.unique(group):
        i, j = np.flatnonzero((group == q) & positive), np.flatnonzero((group == q) & ~positive)
        if len(i) and len(j):
            gap = np.clip(s[i][:, None] - s[j][None, :], -50, 50)
            wrong = 1 / (1 + np.exp(gap))
            out[0] += gap.size
            out[1] += np.log1p(np.exp(-gap)).sum()
            out[2:] += -(wrong.sum(axis=1) @ slope[i]) + wrong.sum(axis=0) @ slope[j]
    return out


def fit_fusion(slates: DataFrame, steps: int = 200, rate: float = 0.05) -> tuple[dict[str, float], list[float]]:
    """(a, b, c, d) and the loss at each step, by full-batch gradient descent (Adam). slates: query_id, z, near, label.

    Slates are written once, whole and side by side; each step sums losses and gradients of all queries on the executors and
    only the parameters and five sums travel. A query without a positive or without others counts nothing.
    """
    kept = materialise(slates.groupBy("query_id").agg(F.collect_list(F.struct("z", "near", "label")).alias("slate")))
    p, m, v, losses = np.array([1.0, 0.0, 1.0, 0.0]), np.zeros(4), np.zeros(4), []
    for t in range(1, steps + 1):
        loss, grad = _step(kept, p)
        losses.append(loss)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p[0] = max(p[0], 1e-3)
    return dict(zip("abcd", p.tolist(), strict=True)), losses


def _step(kept: DataFrame, p: np.ndarray) -> tuple[float, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(6)
        for batch in batches:
            lists = batch.column(0)
            group = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            z, near, y = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(3))
            total += pair_sums(p, z, near, y == 1, group)
        yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in total], names=["n", "loss", "a", "b", "c", "d"])

    sums = kept.select("slate").mapInArrow(run, "n double, loss double, a double, b double, c double, d double")
    n, loss, *grad = sums.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in sums.columns]).first()
    return loss / max(1.0, n), np.array(grad) / max(1.0, n)


# ---- the plain ranker

EPS = 1e-6


def parameters(ranker: Ranker, fusion: np.ndarray) -> list[np.ndarray]:
    return [ranker.encoder, ranker.bias, *(x for layer in ranker.layers for x in layer), ranker.bits, fusion]


def with_parameters(ranker: Ranker, values: list[np.ndarray]) -> tuple[Ranker, np.ndarray]:
    encoder, bias, w1, b1, w2, b2, bits, fusion = values
    return Ranker(encoder, bias, [(w1, b1), (w2, b2)], bits, [], ranker.length), fusion


def slate_gradient(ranker: Ranker, fusion: np.ndarray, query: np.ndarray, places: list[np.ndarray], near: np.ndarray, positive: np.ndarray) -> tuple[int, float, list[np.ndarray]]:
    """Pairs of positives and others of one query, the sum of -log sigmoid(s_i - s_j), and its gradient by all parameters.

    s is the fusion of closeness with the text scores, which are brought to mean 0 and deviation 1 within the slate.
    """
    grad = [np.zeros_like(x) for x in parameters(ranker, fusion)]
    i, j = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(i) or not len(j) or len(near) < 2:
        return 0, 0.0, grad
    a, b, c, d = fusion
    (w1, b1), (w2, b2) = ranker.layers
    q = ranker.embed(query)
    p = np.stack([ranker.embed(x) for x in places])
    joined = np.concatenate((np.broadcast_to(q, p.shape), p), axis=1)
    x0 = np.maximum(joined, 0)
    x1 = np.maximum(x0 @ w1.T + b1, 0)
    x2 = np.maximum(x1 @ w2.T + b2, 0)
    shared = [np.intersect1d(query, x, assume_unique=True) for x in places]
    which, flat = np.repeat(np.arange(len(places)), [len(x) for x in shared]), np.concatenate(shared).astype(int)
    v = (ranker.bits[flat] * x2[which]).sum(axis=1)
    text = np.bincount(which, np.where(v < 0, v * SLOPE, v) + 1, minlength=len(places)) / max(1, len(query))
    mean, dev = text.mean(), text.std(ddof=1)
    z = (text - mean) / (dev + EPS)
    g = 1 / (1 + np.exp(-(a * z + b)))
    s = (c - g) * (near - d)
    gap = np.clip(s[i][:, None] - s[j][None, :], -50, 50)
    wrong = 1 / (1 + np.exp(gap))
    ds = np.zeros(len(s))
    ds[i], ds[j] = -wrong.sum(axis=1), wrong.sum(axis=0)
    slope = -g * (1 - g) * (near - d)
    grad[-1][:] = (ds * slope * z).sum(), (ds * slope).sum(), (ds * (near - d)).sum(), (-ds * (c - g)).sum()
    dz = ds * slope * a
    dt = (dz - dz.mean()) / (dev + EPS)
    if dev > 0:
        dt -= (dz * (text - mean)).sum() / (dev + EPS) ** 2 * (text - mean) / ((len(text) - 1) * dev)
    dv = dt[which] / max(1, len(query)) * np.where(v < 0, SLOPE, 1.0)
    np.add.at(grad[6], flat, dv[:, None] * x2[which])
    dx2 = np.zeros_like(x2)
    np.add.at(dx2, which, dv[:, None] * ranker.bits[flat])
    dx2 *= x2 > 0
    grad[4][:], grad[5][:] = dx2.T @ x1, dx2.sum(axis=0)
    dx1 = dx2 @ w2 * (x1 > 0)
    grad[2][:], grad[3][:] = dx1.T @ x0, dx1.sum(axis=0)
    dx0 = dx1 @ w1 * (joined > 0)
    h = len(q)
    for bits, by in [(query, dx0[:, :h].sum(axis=0)), *zip(places, dx0[:, h:], strict=True)]:
        share = by / max(1, len(bits))
        grad[1] += share
        np.add.at(grad[0], bits, share[None, :])
    return gap.size, float(np.log1p(np.exp(-gap)).sum()), grad


def fit_ranker(slates: DataFrame, ranker: Ranker, steps: int = 50, rate: float = 0.01, most: float = 127 / 64) -> tuple[Ranker, dict[str, float], list[float]]:
    """The ranker (without convolutions), the fusion's a, b, c, d, and the loss at each step, by full-batch Adam; weights stay within `most`.

    slates: query_id, q_bits, p_bits (distinct, ascending), near, label. A task sums the gradients of its queries; sums as
    large as the model travel, one at a time to the driver.
    """
    kept = materialise(slates.groupBy("query_id").agg(F.first("q_bits").alias("q_bits"), F.collect_list(F.struct("p_bits", "near", "label")).alias("slate")))
    values = [x.astype(float).copy() for x in parameters(ranker, np.array([1.0, 0.0, 1.0, 0.0]))]
    m, v, losses = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values], []
    for t in range(1, steps + 1):
        held = kept.sparkSession.sparkContext.broadcast((ranker, values))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            now, fusion = with_parameters(*held.value)
            n, loss, total = 0, 0.0, None
            for batch in batches:
                for query, slate in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = slate_gradient(now, fusion, np.array(query, int), [np.array(x["p_bits"], int) for x in slate], np.array([x["near"] for x in slate], float), np.array([x["label"] == 1 for x in slate]))
                    n, loss = n + found[0], loss + found[1]
                    total = found[2] if total is None else [x + y for x, y in zip(total, found[2], strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([b"".join(x.astype("<f8").tobytes() for x in total)], pa.binary())], names=["n", "loss", "grad"])

        n, loss, flat = 0, 0.0, np.zeros(sum(x.size for x in values))
        for row in kept.select("q_bits", "slate").mapInArrow(run, "n long, loss double, grad binary").toLocalIterator():
            n, loss, flat = n + row["n"], loss + row["loss"], flat + np.frombuffer(bytes(row["grad"]), "<f8")
        held.unpersist()
        losses.append(loss / max(1, n))
        at = 0
        for k, x in enumerate(values):
            grad = flat[at : at + x.size].reshape(x.shape) / max(1, n)
            at += x.size
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
            step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            values[k] = x - step if k == len(values) - 1 else np.clip(x - step, -most, most)
        values[-1][0] = max(values[-1][0], 1e-3)
    done, fusion = with_parameters(ranker, values)
    return done, dict(zip("abcd", fusion.tolist(), strict=True)), losses
