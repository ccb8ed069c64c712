"""Activations, fusions, normalisations and fixed-point numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky(x: Column, slope: float = 1 / 16) -> Column:
    return F.when(x < 0, x * slope).otherwise(x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def closeness(dist: Column, radius: Column | float = 0.0) -> Column:
    """-ln(1 + what lies beyond the circle)."""
    return -F.ln(1 + F.greatest(F.lit(0.0), dist - radius))


def z_score(x: Column, mean: Column, deviation: Column) -> Column:
    """With a deviation of 0, or none as of one row, taken as 1."""
    d = F.coalesce(deviation, F.lit(0.0))
    return (x - mean) / F.when(d == 0, F.lit(1.0)).otherwise(d)


def fuse(z: Column, near: Column, a: float = 1.0, b: float = 0.0, c: float = 1.0, d: float = 1.0) -> Column:
    """(c - sigmoid(a z + b)) (near - d)."""
    return (c - sigmoid(a * z + b)) * (near - d)


def linear(alpha: float, dist: Column, dist_norm: Column, text: Column) -> Column:
    """(1 - alpha)(1 - dist / dist_norm) + alpha text."""
    return (1 - alpha) * (1 - dist / dist_norm) + alpha * text


def max_norm(x: Column, by: str) -> Column:
    return x / (F.max(x).over(Window.partitionBy(by)) + 1e-6)


def min_max(x: Column, by: str) -> Column:
    """0 where all values of a group are equal."""
    w = Window.partitionBy(by)
    return F.coalesce((x - F.min(x).over(w)) / F.nullif(F.max(x).over(w) - F.min(x).over(w), F.lit(0.0)), F.lit(0.0))


def quantise(x: Column, scale: float, low: int | None = None, high: int | None = None) -> Column:
    """x * scale, rounded half to even, within limits."""
    q = F.rint(x * scale).cast("int")
    if low is not None:
        q = F.greatest(q, F.lit(low))
    return q if high is None else F.least(q, F.lit(high))


def as_byte(x: Column) -> Column:
    """As a cast to an unsigned byte does: the whole part, modulo 256."""
    return F.pmod(x.cast("long"), F.lit(256)).cast("int")
