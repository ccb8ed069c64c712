"""The spatial tree: nodes of a level share a grid cell or a cluster, in chunks of the tree's width; inner nodes hold union filters and circles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bloom
from ..functions.geo import circled, knn_join, snapped
from ..sources.stores import hinted, materialise, numbered, placed

WIDTH, KEEP = 8, 4
#: Each cell has room for so many chunks' numbers, or for all chunks of the level if those are more.
CELL = 1 << 20


def leaves(poi: DataFrame) -> DataFrame:
    """(node_id, cx, cy, radius, min_x, max_x, min_y, max_y): each place a point."""
    x, y = F.col("x"), F.col("y")
    return poi.select(F.col("poi_id").alias("node_id"), x.alias("cx"), y.alias("cy"), F.lit(0.0).alias("radius"), x.alias("min_x"), x.alias("max_x"), y.alias("min_y"), y.alias("max_y"))


def grouped(level: DataFrame, width: int = WIDTH) -> DataFrame:
    """(parent_id, child_pos, child_id) and the child's columns: one level of the tree.

    The bounding box is cut into about one cell for every two widths of nodes; a cell's nodes, in the order of their
    centres and ids, are cut into chunks; a cell of any number of nodes is spread over tasks.
    """
    box = level.agg(F.count("*").alias("n"), F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    g = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n") / (2.0 * width)))).cast("long")
    cell = lambda c, low, high: F.coalesce(F.least(F.floor((F.col(c) - F.col(low)) / F.nullif(F.col(high) - F.col(low), F.lit(0.0)) * F.col("g")), F.col("g") - 1), F.lit(0)).cast("long")
    rows = level.crossJoin(F.broadcast(box.withColumn("g", g))).withColumn("cell", cell("cx", "x0", "x1") * F.col("g") + cell("cy", "y0", "y1"))
    rows = placed(rows, "cell", ["cx", "cy", "node_id"])
    room = F.greatest(F.lit(CELL), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / width + 1)))).cast("long")
    return rows.select((F.col("cell") * room + F.floor(F.col("place") / width)).alias("parent_id"), (F.col("place") % width).cast("int").alias("child_pos"), F.col("node_id").alias("child_id"), "cx", "cy", "min_x", "max_x", "min_y", "max_y")


def lloyd(xy: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Labels of k-means from centres spread evenly over the points in their order; ties go to the first centre."""
    centre = xy[np.linspace(0, len(xy) - 1, k).astype(int)].astype(float)
    label = np.zeros(len(xy), int)
    for _ in range(rounds):
        new = ((xy[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == label).all() and _:
            break
        label = new
        n = np.bincount(label, minlength=k)
        for d in (0, 1):
            centre[:, d] = np.where(n > 0, np.bincount(label, xy[:, d], minlength=k) / np.maximum(n, 1), centre[:, d])
    return label


#: Locations that are clustered together, about; and locations for each cluster.
BLOCK, EACH = 1024, 6


def clustered(level: DataFrame, width: int = WIDTH) -> DataFrame:
    """As grouped, by k-means over the different locations, about six to a cluster.

    The box is cut into cells of about BLOCK locations, dense cells into runs of as many, so that clusters are found in
    groups of bounded size. A cluster's nodes go by location and id; ten or more are cut into chunks of the tree's width.
    """
    spots = level.select("cx", "cy").distinct()
    box = spots.agg(F.count("*").alias("n"), F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1")).withColumn("g", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("n") / BLOCK))).cast("long"))
    cell = lambda c, low, high: F.coalesce(F.least(F.floor((F.col(c) - F.col(low)) / F.nullif(F.col(high) - F.col(low), F.lit(0.0)) * F.col("g")), F.col("g") - 1), F.lit(0)).cast("long")
    spots = spots.crossJoin(F.broadcast(box)).withColumn("cell", cell("cx", "x0", "x1") * F.col("g") + cell("cy", "y0", "y1"))
    spots = placed(spots, "cell", ["cx", "cy"]).withColumn("run", F.floor(F.col("place") / (2 * BLOCK)))

    def label(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["cx", "cy"])
        return g[["cell", "run", "cx", "cy"]].assign(label=lloyd(g[["cx", "cy"]].to_numpy(), max(1, len(g) // EACH)))

    labels = spots.groupBy("cell", "run").applyInPandas(label, "cell long, run long, cx double, cy double, label long")
    rows = level.join(labels, ["cx", "cy"]).withColumn("cluster", F.struct("cell", "run", "label"))
    rows = placed(rows, "cluster", ["cx", "cy", "node_id"])
    chunk = F.when(F.col("n_group") >= width + 2, F.floor(F.col("place") / width)).otherwise(F.lit(0))
    rows = materialise(rows.withColumn("part", F.struct("cluster", chunk.alias("chunk"))))
    first = F.row_number().over(Window.partitionBy("part").orderBy("place")) - 1
    rows = rows.withColumn("child_pos", first.cast("int")).join(numbered(rows, "part", "parent_id"), "part")
    return rows.select("parent_id", "child_pos", F.col("node_id").alias("child_id"), "cx", "cy", "min_x", "max_x", "min_y", "max_y")


def merged_small(edges: DataFrame, smallest: int = 3, width: int = WIDTH) -> DataFrame:
    """Chunks of fewer than `smallest` members join the nearest other chunk of at most `width` (by first members); with none, they stay."""
    first = edges.groupBy("parent_id").agg(F.count("*").alias("n"), F.min_by(F.struct("cx", "cy"), "child_pos").alias("at"))
    p = first.select(F.col("parent_id").alias("id"), F.col("at.cx").alias("x"), F.col("at.cy").alias("y"), "n")
    hosts = knn_join(p.where(F.col("n") < smallest), p.where(F.col("n").between(smallest, width)), 1)
    to = hosts.select(F.col("a_id").alias("parent_id"), F.col("b_id").alias("host"))
    moved = edges.join(to, "parent_id", "left").withColumn("parent_id", F.coalesce("host", "parent_id")).withColumn("from_host", F.col("host").isNotNull())
    w = Window.partitionBy("parent_id").orderBy("from_host", "child_pos", "child_id")
    return moved.withColumn("child_pos", (F.row_number().over(w) - 1).cast("int")).drop("host", "from_host")


def build(poi: DataFrame, poi_bits: DataFrame | None, width: int = WIDTH, levels: int | None = None, merge_small: bool = False, keep: int = KEEP, by: str = "grid", snap: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(node, tree_edge, node_bit): depth 0 is the top level; without bits there are no filters. Filters given as (poi_id, bits) are kept so, a row for each node.

    Levels are added until the top has at most width**2 nodes (only that many counts are collected), or as many as asked
    for; each is written once. Of a deeper tree only the `keep` levels next to the leaves are kept. by: grid or kmeans. snap:
    places whose location has fewer members move to the nearest location with as many, as anonymised data asks for.
    """
    if snap:
        poi = poi.drop("x", "y").join(snapped(poi.select(F.col("poi_id").alias("id"), "x", "y"), snap).withColumnRenamed("id", "poi_id"), "poi_id")
    level = leaves(poi)
    whole = poi_bits is not None and "bits" in poi_bits.columns
    bits = poi_bits.select(F.col("poi_id").alias("node_id"), "bits" if whole else "bit") if poi_bits is not None else None
    nodes, edges, filters = [level], [], [bits]
    while (len(edges) < levels) if levels is not None else (len(nodes) < keep and level.count() > width**2):
        e = {"grid": grouped, "kmeans": clustered}[by](level, width)
        e = materialise(merged_small(e, width=width) if merge_small else e)
        up = circled(e.groupBy(F.col("parent_id").alias("node_id")).agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y")))
        level = materialise(up.select("node_id", "cx", "cy", "radius", "min_x", "max_x", "min_y", "max_y"))
        if bits is not None:
            under = bits.join(hinted(e.select(F.col("child_id").alias("node_id"), "parent_id")), "node_id").drop("node_id").withColumnRenamed("parent_id", "node_id")
            bits = materialise(bloom.united(under, "node_id") if whole else bloom.union(under, "node_id"))
        nodes.append(level)
        edges.append(e.select("parent_id", "child_pos", "child_id"))
        filters.append(bits)
    top = len(nodes) - 1
    of = lambda parts, shift: _stacked([p.select(F.lit(top - k - shift).alias("depth"), "*") for k, p in enumerate(parts)])
    empty = poi.sparkSession.createDataFrame([], "depth int, parent_id long, child_pos int, child_id long")
    return of(nodes, 0), of(edges, 1) if edges else empty, of(filters, 0) if bits is not None else None


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ancestors(edges: DataFrame, truths: DataFrame, depth: int) -> DataFrame:
    """(query_id, depth, node_id), distinct: each truth at the leaves' depth and the nodes above it. truths: (query_id, poi_id)."""
    at = truths.select("query_id", F.col("poi_id").alias("node_id")).distinct()
    out = [at.select("query_id", F.lit(depth).alias("depth"), "node_id")]
    for d in range(depth - 1, -1, -1):
        e = edges.where(F.col("depth") == d).select(F.col("child_id").alias("node_id"), "parent_id")
        at = at.join(e, "node_id").select("query_id", F.col("parent_id").alias("node_id")).distinct()
        out.append(at.select("query_id", F.lit(d).alias("depth"), "node_id"))
    return _stacked(out)


def density(node_bit: DataFrame, dim: int) -> DataFrame:
    """depth, n_nodes, max_bits, avg_bits, dense (more than a twentieth of the bits are set on average)."""
    per = node_bit.select("depth", "node_id", F.size("bits").alias("n")).where("n > 0") if "bits" in node_bit.columns else node_bit.groupBy("depth", "node_id").agg(F.count("*").alias("n"))
    return per.groupBy("depth").agg(F.count("*").alias("n_nodes"), F.max("n").alias("max_bits"), F.round(F.avg("n"), 6).alias("avg_bits"), (F.avg("n") / dim > 0.05).alias("dense"))
