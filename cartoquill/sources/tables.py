"""The driver's tables as relations of this library: coordinates are derived from keys, as no table has any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(rows: DataFrame, least: int = 1 << 20) -> DataFrame:
    """A scan of fewer files than there are cores is dealt over all of them, unless it is tiny: one file may be one task. Larger inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores and not small(rows, least) else rows


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("poi_id"), "text", ((F.col("doc_id") * 7919) % 10000).cast("double").alias("x"), ((F.col("doc_id") * 104729) % 10000).cast("double").alias("y"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), "text", ((F.col("item_id") * 6101 + 17) % 10000).cast("double").alias("x"), ((F.col("item_id") * 3571 + 29) % 10000).cast("double").alias("y"))


def thinned(q: DataFrame) -> DataFrame:
    """About one word in eight of each query, chosen by hash: what is left discriminates."""
    keep = lambda w: F.conv(F.substring(F.md5(F.concat(w, F.col("query_id").cast("string")).cast("binary")), 9, 4), 16, 10).cast("int") % 8 == 0
    return q.withColumn("text", F.array_join(F.filter(F.split(F.lower("text"), r"\s+"), keep), " "))


def points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("id"), ((k * 7919) % 10000).cast("double").alias("x"), ((k * 104729) % 10000).cast("double").alias("y"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
