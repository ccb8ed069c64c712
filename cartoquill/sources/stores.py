"""Materialised relations: build or load, append, partitioned cases, configuration, resources."""

from __future__ import annotations

import gzip
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def shared_path(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir, the folder that driver and executors share; a temporary one only for local masters."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"file://{tempfile.gettempdir()}/cartoquill"
    return f"{top.rstrip('/')}/cq-{uuid.uuid4().hex}"


#: Ends an execution by removing its shuffle files, which else stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: later steps neither recompute it nor carry its lineage. The files go when the driver ends."""
    spark = df.sparkSession
    path, before = shared_path(spark), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, key: str, number: str = "number") -> DataFrame:
    """(key, number) of the different keys, ascending from 0: numbered within ranges, of which only the sizes are collected."""
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place in the lower 33
    held = materialise(rows.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("at", at))
    sizes = sorted(tuple(r) for r in held.groupBy(F.shiftright("at", 33).alias("p")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    begin = rows.sparkSession.createDataFrame(starts, "p long, begin long")
    return held.join(F.broadcast(begin), F.shiftright("at", 33) == F.col("p")).select(key, (F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).alias(number))


def placed(rows: DataFrame, by: str, order: list[str], place: str = "place", total: str = "n_group") -> DataFrame:
    """The rows with their places from 0 in the order within their group, and the group's size; written.

    Rows are sorted by ranges of group and order, so that a group of any size is spread over tasks; a small table of groups
    and ranges tells how many rows of a group lie in the ranges before."""
    at = F.monotonically_increasing_id()
    held = materialise(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_at", at).withColumn("_range", F.shiftright("_at", 33)))
    w = Window.partitionBy("_by")
    ranges = held.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = materialise(ranges.select("_by", "_of", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("_total")))
    joined = held.join(hinted(ranges), (F.col(by) == F.col("_by")) & (F.col("_range") == F.col("_of")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(place), F.col("_total").alias(total))


def small(rows: DataFrame, most: int = 8 << 20) -> bool:
    """Whether Spark's own estimate of a relation is below a bound, so that it may be sent to every task."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def hinted(rows: DataFrame) -> DataFrame:
    """The relation, marked for broadcast only if it is small; Spark chooses the join of others."""
    return F.broadcast(rows) if small(rows) else rows


def build_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The relation at a path; built and written there if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows of one string column to a text log."""
    df.write.mode("append").text(path)


def write_cases(df: DataFrame, path: str, case_col: str = "case") -> None:
    df.write.mode("overwrite").partitionBy(case_col).parquet(path)


def split_path(folder: str, split: str, portion: float | None = None) -> str:
    """The path of a split; a training portion other than the whole has it as a suffix."""
    return f"{folder}/{split}" + (f"_{portion:g}" if split == "train" and portion not in (None, 1, 1.0) else "")


def settings(defaults: Mapping[str, object], *layers: Mapping[str, object]) -> dict[str, object]:
    """Defaults overlaid by layers (a file's values, then arguments); None does not overlay, unknown names fail."""
    out = dict(defaults)
    for layer in layers:
        for k, v in layer.items():
            if k not in out:
                raise KeyError(k)
            if v is not None:
                out[k] = v
    return out


def resources(folder: str, key: str, to: str) -> list[Path]:
    """Unpacks local archives by key or prefix: dots part folders; .gz and .zip are unpacked, other files copied. Nothing is downloaded."""
    top, found = Path(folder), []
    for p in sorted(top.rglob("*")):
        name = ".".join(p.relative_to(top).with_suffix("").parts)
        if p.is_file() and (name == key or name.startswith(key + ".")):
            out = Path(to) / p.relative_to(top)
            out.parent.mkdir(parents=True, exist_ok=True)
            if p.suffix == ".gz":
                out = out.with_suffix("")
                with gzip.open(p, "rb") as a, open(out, "wb") as b:
                    shutil.copyfileobj(a, b)
            elif p.suffix == ".zip":
                out = out.with_suffix("")
                with zipfile.ZipFile(p) as z:
                    z.extractall(out)
            else:
                shutil.copyfile(p, out)
            found.append(out)
    if not found:
        raise KeyError(key)
    return found
