"""Planar geometry on relations: boxes, circles, range joins and nearest neighbours over a grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import materialise
from .numeric import distance


def boxes(rows: DataFrame, by: str, min_x: str = "x", max_x: str = "x", min_y: str = "y", max_y: str = "y") -> DataFrame:
    """Bounding box, its centre, and the radius of the circle around it, of each group."""
    b = rows.groupBy(by).agg(F.min(min_x).alias("min_x"), F.max(max_x).alias("max_x"), F.min(min_y).alias("min_y"), F.max(max_y).alias("max_y"))
    return circled(b)


def circled(b: DataFrame) -> DataFrame:
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return b.withColumns({"cx": (F.col("min_x") + F.col("max_x")) / 2, "cy": (F.col("min_y") + F.col("max_y")) / 2, "radius": F.sqrt(w * w + h * h) / 2})


def diagonal(rows: DataFrame) -> DataFrame:
    """One row: the bounding box of all points and its diagonal, which normalises distances."""
    b = rows.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return b.withColumn("d_norm", F.sqrt(w * w + h * h))


#: Ids of one location that are kept together, and locations of a cell that one group meets, about.
TOGETHER, MEET = 256, 128


def _spots(rows: DataFrame, name: str) -> DataFrame:
    """(x, y, ids): each location once for about TOGETHER of its ids."""
    n = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / TOGETHER)).alias("part")
    held = rows.join(n, ["x", "y"]).select("x", "y", "id", part).groupBy("x", "y", "part").agg(F.collect_list("id").alias(f"{name}_ids"))
    return held.select(F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y"), "part", f"{name}_ids")


def range_join(a: DataFrame, b: DataFrame, radius: float, digits: int | None = None) -> DataFrame:
    """(a_id, b_id, dist) of points at most `radius` apart: b goes to its grid cell, a to the nine around its own. digits: places of dist.

    Locations meet, not points: a distance is computed once for all points at its ends. Cells of many locations are dealt over
    groups, so that no task joins a whole city."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.sequence(F.lit(-1), F.lit(1))
    right = _spots(b, "b").withColumns({"gx": cell("bx"), "gy": cell("by")})
    right = materialise(right)
    groups = right.groupBy("gx", "gy").agg(F.ceil(F.count("*") / MEET).alias("groups"))
    right = right.join(F.broadcast(groups), ["gx", "gy"]).withColumn("group", F.pmod(F.xxhash64("bx", "by", "part"), F.col("groups")))
    left = _spots(a, "a").withColumn("i", F.explode(near)).withColumn("j", F.explode(near)).withColumns({"gx": cell("ax") + F.col("i"), "gy": cell("ay") + F.col("j")})
    left = left.join(F.broadcast(groups), ["gx", "gy"]).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    tasks = 8 * a.sparkSession.sparkContext.defaultParallelism
    left, right = (side.drop("groups", "part", "i", "j").repartition(tasks, "gx", "gy", "group") for side in (left, right))
    d = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    met = left.join(right.hint("shuffle_hash"), ["gx", "gy", "group"]).withColumn("dist", d).where(F.col("dist") <= radius)
    met = met.select("a_ids", "b_ids", "dist" if digits is None else F.round("dist", digits).alias("dist"))
    return met.select(F.explode("a_ids").alias("a_id"), "b_ids", "dist").select("a_id", F.explode("b_ids").alias("b_id"), "dist")


def knn_join(a: DataFrame, b: DataFrame, k: int, per_cell: int = 4) -> DataFrame:
    """(a_id, rank, b_id, dist): the k nearest points of b to each of a, ties to the smaller id; exact.

    b lies in grid cells of about per_cell * k points. Points of a search the cells up to r around their own; those whose
    k-th distance reaches no further than r cells are done, the others search twice as far, until r spans the grid.
    """
    box = b.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not box["n"]:
        return a.sparkSession.createDataFrame([], "a_id long, rank int, b_id long, dist double")
    extent = max(box["x1"] - box["x0"], box["y1"] - box["y0"]) or 1.0
    side = max(1, round((box["n"] / (per_cell * k)) ** 0.5))
    step = extent / side
    at = lambda c, low: F.least(F.greatest(F.floor((F.col(c) - low) / step), F.lit(0)), F.lit(side)).cast("long")
    right = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), at("x", box["x0"]).alias("gx"), at("y", box["y0"]).alias("gy"))
    left = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.floor((F.col("x") - box["x0"]) / step).alias("ux"), F.floor((F.col("y") - box["y0"]) / step).alias("uy"))
    # A point off the grid searches from its nearest cell; what lies between counts as reached.
    left = left.withColumns({"ux": F.least(F.greatest("ux", F.lit(0)), F.lit(side)), "uy": F.least(F.greatest("uy", F.lit(0)), F.lit(side))})
    w, done, r = Window.partitionBy("a_id").orderBy("dist", "b_id"), [], 1
    d = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    while True:
        last = r >= side
        near = F.sequence(F.lit(-r), F.lit(r))
        cells = left.withColumn("i", F.explode(near)).withColumn("gx", F.col("ux") + F.col("i")).where(F.col("gx").between(0, side))
        cells = cells.withColumn("j", F.explode(near)).withColumn("gy", F.col("uy") + F.col("j")).where(F.col("gy").between(0, side))
        ranked = cells.join(right, ["gx", "gy"]).select("a_id", "b_id", d.alias("dist")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if last:
            done.append(ranked)
            break
        ranked = materialise(ranked)
        # What lies outside of the cells searched is at least r steps off, also from a point off the grid.
        full = ranked.where((F.col("rank") == k) & (F.col("dist") <= r * step)).select("a_id")
        done.append(ranked.join(full, "a_id", "left_semi"))
        left = materialise(left.join(full, "a_id", "left_anti"))
        if left.isEmpty():
            break
        r = min(2 * r, side)
    return reduce(DataFrame.unionByName, done).select("a_id", F.col("rank").cast("int").alias("rank"), "b_id", "dist")


def locations(rows: DataFrame, fewer_than: int | None = None) -> DataFrame:
    """(x, y, n, ids): points that share a location, those of small locations only if asked for."""
    g = rows.groupBy("x", "y").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    return g if fewer_than is None else g.where(F.col("n") < fewer_than)


def snapped(rows: DataFrame, fewer_than: int) -> DataFrame:
    """(id, x, y): points of small locations move to the nearest large one."""
    count = rows.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    small, large = count.where(F.col("n") < fewer_than), count.where(F.col("n") >= fewer_than)
    to = knn_join(small, large, 1).select(F.col("a_id").alias("id"), F.col("b_id").alias("host"))
    moved = small.join(to, "id").join(large.select(F.col("id").alias("host"), F.col("x").alias("hx"), F.col("y").alias("hy")), "host").select("x", "y", "hx", "hy")
    return rows.join(moved, ["x", "y"], "left").select("id", F.coalesce("hx", "x").alias("x"), F.coalesce("hy", "y").alias("y"))
