"""Tab-separated places and queries, passages, logs."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


Address = Callable[[Column, Column], tuple[Column, Column]]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one text file, numbered from 0.

    A first pass counts the lines of each split; a line's number is its place in its split and the count of those before.
    One row for each split is collected.
    """
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.spark_partition_id().alias("part"), F.input_file_block_start().alias("block"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    counts = lines.groupBy("part").agg(F.min("block").alias("block"), F.count("*").alias("n")).collect()
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: r["block"]):
        starts.append((r["part"], total))
        total += r["n"]
    if not starts:
        return spark.createDataFrame([], "line_no long, line string")
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    return lines.join(offsets, "part").select((F.col("start") + F.col("at")).alias("line_no"), "line")


def fields_of(lines: DataFrame, n: int, strict: bool = False) -> DataFrame:
    """Lines with n tab-separated fields, as `f`; others are left out, or fail."""
    out = lines.withColumn("f", F.split("line", "\t"))
    return out.where(F.assert_true(F.size("f") == n).isNull()) if strict else out.where(F.size("f") == n)


def hook(name: str, otherwise: Callable) -> Callable:
    """The function that "module:function" names, as private hashes and location maps are kept; another where there is no such module or function."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError):
        return otherwise


def as_they_are(x: Column, y: Column) -> tuple[Column, Column]:
    return x, y


def _located(rows: DataFrame, address: Address) -> DataFrame:
    x, y = address(F.col("x"), F.col("y"))
    return rows.withColumns({"x": x.cast("double"), "y": y.cast("double")})


def read_poi(spark: SparkSession, path: str, strict: bool = False, address: Address = as_they_are) -> DataFrame:
    """poi_id, text, x, y; the id is the line number. address maps locations, to anonymise them say."""
    rows = fields_of(numbered_lines(spark, path), 3, strict)
    return _located(rows.select(F.col("line_no").alias("poi_id"), text.clean(F.col("f")[0]).alias("text"), F.col("f")[1].cast("double").alias("x"), F.col("f")[2].cast("double").alias("y")), address)


def read_queries(spark: SparkSession, path: str, strict: bool = False, address: Address = as_they_are) -> DataFrame:
    """query_id, text, x, y, truths."""
    rows = fields_of(numbered_lines(spark, path), 4, strict)
    return _located(rows.select(F.col("line_no").alias("query_id"), text.clean(F.col("f")[0]).alias("text"), F.col("f")[1].cast("double").alias("x"), F.col("f")[2].cast("double").alias("y"), text.truth_list(F.col("f")[3]).alias("truths")), address)


def write_queries(queries: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", "text", F.col("x").cast("string"), F.col("y").cast("string"), F.array_join(F.transform("truths", lambda t: t.cast("string")), ","))
    queries.orderBy("query_id").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """passage_id, text, title of a tab-separated file with a header; enclosing quotes go."""
    rows = spark.read.schema("id string, text string, title string").csv(path, sep="\t", header=True, quote="")
    strip = lambda c: F.regexp_replace(c, '^"|"$', "")
    return rows.select(F.col("id").cast("long").alias("passage_id"), strip("text").alias("text"), strip("title").alias("title"))
