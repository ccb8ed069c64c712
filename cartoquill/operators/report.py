"""Reports: cases of a result, logs of runs, their summaries, and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def cases(queries: DataFrame, result: DataFrame, truths: DataFrame, top: int = 20, item: str = "poi_id") -> DataFrame:
    """(query_id, case, truth_rank, ahead): success if a truth comes first, top20 if later among the first `top`, fail else; how many wrong results come before it."""
    hits = result.where(F.col("rank") <= top).join(truths.select("query_id", item).distinct(), ["query_id", item], "left_semi").groupBy("query_id").agg(F.min("rank").alias("truth_rank"))
    rows = queries.select("query_id").join(hits, "query_id", "left")
    case = F.when(F.col("truth_rank") == 1, "success").when(F.col("truth_rank").isNotNull(), f"top{top}").otherwise("fail")
    return rows.select("query_id", case.alias("case"), F.col("truth_rank").cast("int").alias("truth_rank"), F.coalesce(F.col("truth_rank") - 1, F.lit(top)).cast("int").alias("ahead"))


def case_lines(cases_: DataFrame, queries: DataFrame, result: DataFrame, poi: DataFrame, top: int = 20) -> DataFrame:
    """(case, query_id, lines): each query and the results ahead of its truth, with distances, as text."""
    p = poi.select("poi_id", F.col("text").alias("place"), F.col("x").alias("px"), F.col("y").alias("py"))
    rows = result.where(F.col("rank") <= top).join(p, "poi_id").join(queries.select("query_id", "text", "x", "y"), "query_id").join(cases_, "query_id")
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    line = F.format_string("  %2d. %s (%.1f away)", "rank", "place", F.sqrt(dx * dx + dy * dy))
    shown = rows.where(F.col("truth_rank").isNull() | (F.col("rank") <= F.col("truth_rank")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n")
    return shown.groupBy("case", "query_id", "text").agg(body.alias("body")).select("case", "query_id", F.concat_ws("\n", "text", "body").alias("lines"))


def metric(line: Column, name: str) -> Column:
    """The number after "name: " in a log line."""
    return F.regexp_extract(line, f"{name}: *([0-9.eE+-]+)", 1).try_cast("double")


def result_log(lines: DataFrame, names: tuple[str, ...] = ("Recall@20", "Recall@10", "NDCG@5", "NDCG@1")) -> DataFrame:
    """A row for each result line (value of each metric), numbered as runs in line order, with the best dev time that follows in seconds. lines: line_no, line."""
    cols = [metric(F.col("line"), n).alias(n.lower().replace("@", "_")) for n in names]
    is_result = F.col("line").contains(f"{names[0]}:")
    seconds = F.regexp_extract("line", r"Best dev time:.*\(([0-9.]+) *\(?s", 1).try_cast("double")
    rows = lines.select("line_no", "line", is_result.alias("is_result"), seconds.alias("seconds"))
    run = F.sum(F.col("is_result").cast("int")).over(Window.orderBy("line_no"))
    rows = rows.where("is_result or seconds is not null").withColumn("run", run)
    first = rows.where("is_result").select("run", *cols)
    times = rows.where("seconds is not null").groupBy("run").agg(F.min("seconds").alias("seconds"))
    return first.join(times, "run", "left")


def run_summary(runs: DataFrame, values: list[str], by: str | None = None) -> DataFrame:
    """Mean and population deviation of each value over runs."""
    aggs = [a for v in values for a in (F.round(F.avg(v), 6).alias(f"{v}_mean"), F.round(F.stddev_pop(v), 6).alias(f"{v}_std"))]
    return runs.groupBy(*([by] if by else [])).agg(*aggs, F.count("*").alias("runs"))


def with_duration(rows: DataFrame, seconds: str) -> DataFrame:
    return rows.withColumn("duration", text.duration(F.col(seconds)))


def segments(lines: DataFrame, marker: Column, epoch: Column, by: str | None = None, order: str = "line_no") -> DataFrame:
    """Lines with `run` (the count of marker lines so far) and `epoch` (the last one seen in the run)."""
    w = Window.partitionBy(by).orderBy(order) if by else Window.orderBy(order)
    rows = lines.withColumn("run", F.sum(F.when(marker, 1).otherwise(0)).over(w))
    inner = Window.partitionBy(*([by] if by else []), "run").orderBy(order)
    return rows.withColumn("epoch", F.last(epoch, ignorenulls=True).over(inner))


def training_log(lines: DataFrame, marker: str = "ninja: no work to do.") -> DataFrame:
    """(run, epoch, name, value) of retrieve and rank losses and dev NDCG@5 in a training log. lines: line_no, line."""
    line = F.col("line")
    rows = segments(lines, line.contains(marker), F.regexp_extract(line, r"Epoch=(\d+)", 1).try_cast("int"))
    kinds = [("retrieve_loss", r"retrieve loss=([0-9.eE+-]+)"), ("rank_loss", r"rank loss=([0-9.eE+-]+)"), ("dev_ndcg_5", r"Dev NDCG @ 5: *([0-9.eE+-]+)")]
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract(line, p, 1).try_cast("double").alias("value")) for n, p in kinds])
    return rows.select("run", "epoch", "line_no", F.explode(found).alias("m")).select("run", "epoch", "line_no", "m.*").where("value is not null")


def curves(log: DataFrame) -> DataFrame:
    """(epoch, name, mean, std, runs): the last value of each run's epoch, averaged over runs."""
    last = log.groupBy("run", "epoch", "name").agg(F.max_by("value", "line_no").alias("value"))
    return last.groupBy("epoch", "name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("runs"))


def sizes(node_bit: DataFrame, width: int = 2) -> DataFrame:
    """(depth, n_bits, megabytes) that sparse filters of so many bytes for each bit take."""
    n = F.sum(F.size("bits")) if "bits" in node_bit.columns else F.count("*")
    return node_bit.groupBy("depth").agg(n.alias("n_bits"), F.round(n * width / 1e6, 6).alias("megabytes"))


def throughput(seconds: DataFrame, n: int) -> DataFrame:
    """(cpu_s, qps): queries over the summed seconds of all workers."""
    return seconds.agg(F.sum("seconds").alias("cpu_s")).withColumn("qps", n / F.col("cpu_s"))
