"""Quality classifier (op 6): a regularised quadratic discriminant over transformed statistics of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FEATURES = ("word_length", "upper", "digits", "marks", "symbols", "stops", "wide", "breaks", "distinct", "stutter", "grams", "top", "long_words", "line_copies", "doubled")
#: Weight of the pooled diagonal in each class covariance (least errors in five folds of training rows alone, among .01 to .8), and what is added to each variance (features are standardised).
SHRINK, RIDGE = 0.03, 1e-3

# Byte classes (fixed values).
_CLASS = np.zeros((8, 256), bool)
_CLASS[0, 65:91] = True  # upper case
_CLASS[1, 48:58] = True  # digits
_CLASS[2, [33, 63]] = True  # ! ?
_CLASS[3, [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = True  # symbols
_CLASS[4, [39, 40, 41, 44, 45, 46, 58, 59, 34]] = True  # stops
_CLASS[5, 128:] = True
_CLASS[6, 10] = True
_CLASS[7, 97:123] = True


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text: logarithms of ratios, and square roots of shares that lean to usual ones where the text is short."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = _CLASS.astype(np.int64) @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    h, _ = C.word_hashes(text)
    m = len(h)
    if not m:
        return [0.0] * len(FEATURES)
    ordered = np.sort(h)
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    times = np.diff(np.append(np.flatnonzero(new), m))
    grams = np.sort(C.window_hashes(h, 3))
    lines = [x for x in text.split(b"\n") if x]
    share = lambda x, of, usual=0.0, weight=40: float(np.sqrt((max(0, x) + usual * weight) / (of + weight)))
    same = lambda x, y: int((x == y).sum())
    return [
        float(np.log1p((n - m + 31) / (m + 6))), share(count[0], count[0] + count[7] + count[5], 0.03), share(count[1], n), share(count[2], n), share(count[3], n), share(count[4], n, 0.03), share(count[5], n, 0.01), share(count[6], n, 0.005),
        float(np.log((new.sum() + 10) / (m + 10)) + 0.1 * np.log(m + 10)), share(same(h[1:], h[:-1]), m), share(same(grams[1:], grams[:-1]), m), share(times.max() - 1, m, 0.05), share(n - 16 * m, n), share(len(lines) - len(set(lines)), len(lines), weight=3), share(same(h[2:], h[:-2]), m),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """doc_id, doc_key (of key_col, else null), f0 ... of each row; null texts count as empty."""
    C.session(docs)
    names = [f"f{k}" for k in range(len(FEATURES))]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.only()
        for batch in batches:
            x = np.array([statistics(t) for t in C.blobs(batch.column(1))], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(x[:, k]) for k in range(x.shape[1])]], names=["doc_id", "doc_key", *names])

    return C.texts_of(docs, id_col, text_col, key_col).mapInArrow(make, "doc_id long, doc_key long, " + ", ".join(f"{x} double" for x in names))


@dataclass
class Discriminant:
    """Standardisation, and for each class its mean, the inverse Cholesky factor of its covariance, and its log weight."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    weights: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 from the difference of the log densities, through the cached factors."""
        z = (x - self.shift) / self.scale
        a, b = (w - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, w in zip(self.means, self.factors, self.weights, strict=True))
        return 1 / (1 + np.exp(np.clip(a - b, -700, 700)))


def fit(labelled: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """labelled: f0 ..., y (0 or 1). Spark sums counts, values and products by class in one aggregation of two rows; all rows count.

    With a class missing, its mean and covariance are those of the other one, and scores come from the smoothed weights."""
    k = len(FEATURES)
    names = [f"f{i}" for i in range(k)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    n, s, p = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for r in labelled.groupBy("y").agg(F.count("*").alias("n"), *sums).collect():
        c = int(r["y"])
        n[c], s[c] = r["n"], [r[f"s{i}"] for i in range(k)]
        for i in range(k):
            for j in range(i, k):
                p[c, i, j] = p[c, j, i] = r[f"p{i}_{j}"]
    if not n.sum():
        return Discriminant(np.zeros(k), np.ones(k), [np.zeros(k)] * 2, [np.eye(k)] * 2, [0.0, 0.0])
    shift = s.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(p.sum(axis=0)) / n.sum() - shift**2, 1e-12))
    scale = np.where(scale < 1e-5, 1, scale)
    means, covariances = [], []
    for c in (0, 1):
        use = c if n[c] else 1 - c
        m = s[use] / n[use]
        means.append((m - shift) / scale)
        covariances.append((p[use] / n[use] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = np.diag(sum(np.diag(v) * w for v, w in zip(covariances, n / n.sum(), strict=True)))
    factors, weights = [], []
    for c, v in enumerate(covariances):
        lower = np.linalg.cholesky((1 - shrink) * v + shrink * pooled + ridge * np.eye(k))
        factors.append(np.linalg.inv(lower))
        weights.append(float(np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(lower)).sum()))
    return Discriminant(shift, scale, means, factors, weights)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", key_col: str | None = None) -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id as text leaves 1 modulo 3), score (0 to 1), predicted (1 if score >= 0.5), and the long key_col, if one is named.

    Fitted on labelled rows that are not held out; every row is scored. Inputs of a score are statistics of the whole text
    alone, however long. Null text: as empty, which has a score like any other; repeated rows each give a row, further columns, of any name, are ignored; null or other labels than 0 and 1 are left out, a label that repeats counts
    again; a null id is not held out and never labelled. Without labels all scores are 0.5. An empty table gives an empty one.
    """
    C.session(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = C.stage(features(docs, id_col, text_col, key_col).withColumn("held_out", held))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    model = fit(rows.where("not held_out").join(known, "doc_id"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(k + 2).to_numpy() for k in range(len(FEATURES))])
            y = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(batch.num_columns - 1), pa.array(y), pa.array((y >= 0.5).astype(np.int32))], names=["doc_id", "doc_key", "held_out", "score", "predicted"])

    out = rows.mapInArrow(score, "doc_id long, doc_key long, held_out boolean, score double, predicted int")
    return out.select("doc_id", "held_out", "score", "predicted", *([F.col("doc_key").alias(key_col)] if key_col else []))
