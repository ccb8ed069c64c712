"""Ranking metrics and losses over relations of results and truths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = "poi_id"


def _ideal(n: Column, k: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))


def recall(k: int) -> Column:
    """Hits among the first k over the fewer of truths and k."""
    return F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)) / F.least(F.max("n_truth"), F.lit(k))


def ndcg(k: int) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)) / _ideal(F.max("n_truth").cast("int"), k)


def mrr(k: int) -> Column:
    return 1 / F.min(F.when((F.col("rank") <= k) & (F.col("hit") == 1), F.col("rank")))


METRICS: dict[str, Callable[[int], Column]] = {"recall": recall, "ndcg": ndcg, "mrr": mrr}


def per_query(queries: DataFrame, result: DataFrame, truths: DataFrame, names: dict[str, tuple[str, int]], item: str = ITEM) -> DataFrame:
    """query_id and a column for each name (metric, k); 0 for queries without truths or results.

    result: query_id, rank, item, with an item once in a query's list; truths: query_id, item."""
    t = truths.select("query_id", item).distinct()
    n = t.groupBy("query_id").agg(F.count("*").alias("n_truth"))
    rows = result.select("query_id", "rank", item).join(t.withColumn("hit", F.lit(1)), ["query_id", item], "left").na.fill(0, ["hit"]).join(n, "query_id")
    return of_hits(queries, rows, names)


def of_hits(queries: DataFrame, rows: DataFrame, names: dict[str, tuple[str, int]]) -> DataFrame:
    """As per_query, of results that tell hits: query_id, rank, hit (0 or 1), n_truth."""
    out = rows.groupBy("query_id").agg(*[METRICS[m](k).alias(name) for name, (m, k) in names.items()])
    return queries.select("query_id").join(out, "query_id", "left").na.fill(0.0, list(names))


def mean(per: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """One row: the mean of each metric over all queries, and their number."""
    return per.agg(*[F.round(F.avg(c), digits).alias(c) for c in names], F.count("*").alias("n_queries"))


def intermediate_recall(beam: DataFrame, paths: DataFrame, queries: DataFrame) -> DataFrame:
    """depth, recall: the share of each query's truth ancestors in its beam, averaged over all queries; 0 without truths."""
    n = paths.groupBy("query_id", "depth").agg(F.count("*").alias("n"))
    hits = beam.join(paths, ["query_id", "depth", "node_id"], "left_semi").groupBy("query_id", "depth").agg(F.count("*").alias("hits"))
    every = queries.select("query_id").crossJoin(F.broadcast(beam.select("depth").distinct()))
    rows = every.join(n, ["query_id", "depth"], "left").join(hits, ["query_id", "depth"], "left")
    return rows.groupBy("depth").agg(F.round(F.avg(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))), 6).alias("recall"))


# ---- losses

EPS = 1e-10


def _gain(y: str) -> Column:
    return F.pow(F.lit(2.0), F.col(y)) - 1


def _discount(r: str) -> Column:
    return F.log2(F.lit(1.0) + F.col(r))


def _delta(mu: float | None) -> Column:
    gap = F.abs(F.col("ri") - F.col("rj"))
    d = F.abs(1 / _discount_of(gap) - 1 / _discount_of(gap + 1))
    gains = F.abs(F.col("gi") - F.col("gj"))
    rank = F.abs(1 / _discount("ri") - 1 / _discount("rj"))
    return d * gains if mu is None else (mu * d + rank) * gains


def _discount_of(c: Column) -> Column:
    return F.log2(F.lit(1.0) + c)


#: Weights of a pair from places ri, rj, labels yi, yj and gains gi, gj (normalised by the ideal).
SCHEMES: dict[str, Callable[[], Column]] = {
    "none": lambda: F.lit(1.0),
    "ndcgLoss1": lambda: F.col("gi") / _discount("ri"),
    "ndcgLoss2": lambda: _delta(None),
    "lambdaRank": lambda: F.abs(1 / _discount("ri") - 1 / _discount("rj")) * F.abs(F.col("gi") - F.col("gj")),
    "ndcgLoss2PP": lambda: _delta(10.0),
    "rankNet": lambda: F.lit(1.0),
    "rankNetWeightedByGTDiff": lambda: F.abs(F.col("yi") - F.col("yj")),
    "rankNetWeightedByGTDiffPowed": lambda: F.abs(F.pow(F.col("yi"), F.lit(2.0)) - F.pow(F.col("yj"), F.lit(2.0))),
}


def lambda_loss(slates: DataFrame, k: int | None = None, scheme: str = "none", sigma: float = 1.0, natural: bool = False) -> DataFrame:
    """(query_id, loss, pairs): sums over pairs among the k best-scored of -log(max(sigmoid(si - sj), eps) ** weight, eps).

    Pairs are those with yi > yj; ndcgLoss1, whose weights ask for the first place alone, takes all pairs, an item with itself
    too. slates: query_id, item, score, label. Ties of scores go to the smaller item. Queries without a pair have no row.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    ranked = slates.select("query_id", "item", F.col("score").cast("double").alias("score"), F.col("label").cast("double").alias("label")).withColumn("rank", F.row_number().over(w))
    ideal = Window.partitionBy("query_id").orderBy(F.desc("label"), "item")
    if k:
        best = F.when(F.row_number().over(ideal) <= k, _gain("label") / _discount_of(F.row_number().over(ideal)))
    else:
        best = _gain("label") / _discount_of(F.row_number().over(ideal))
    ranked = ranked.withColumn("best", best).withColumn("gain", _gain("label") / F.greatest(F.sum("best").over(Window.partitionBy("query_id")), F.lit(EPS)))
    if k:
        ranked = ranked.where(F.col("rank") <= k)
    side = lambda s: ranked.select("query_id", F.col("rank").alias(f"r{s}"), F.col("score").alias(f"s{s}"), F.col("label").alias(f"y{s}"), F.col("gain").alias(f"g{s}"))
    pairs = side("i").join(side("j"), "query_id").where("true" if scheme == "ndcgLoss1" else "yi > yj")
    p = F.greatest(1 / (1 + F.exp(-sigma * (F.col("si") - F.col("sj")))), F.lit(EPS))
    term = F.greatest(F.pow(p, SCHEMES[scheme]()), F.lit(EPS))
    return pairs.groupBy("query_id").agg(F.sum(-(F.ln(term) if natural else F.log2(term))).alias("loss"), F.count("*").alias("pairs"))


def by_depth(slates: DataFrame, weights: list[float], scheme: str = "none", k: int | None = None) -> DataFrame:
    """(depth, loss, pairs, weighted): the loss of each depth's slates, and that times the depth's weight; depths beyond the weights weigh 1. slates: depth, query_id, item, score, label."""
    keyed = slates.withColumn("of", F.struct("depth", "query_id")).select("depth", F.col("of").alias("query_id"), "item", "score", "label")
    per = lambda_loss(keyed.drop("depth"), k, scheme).withColumn("depth", F.col("query_id")["depth"])
    weight = F.coalesce(F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("depth")), F.lit(1.0)) if weights else F.lit(1.0)
    return per.groupBy("depth").agg(F.sum("loss").alias("loss"), F.sum("pairs").alias("pairs")).select("depth", F.round("loss", 6).alias("loss"), "pairs", F.round(F.col("loss") * weight, 6).alias("weighted"))


def reduced(losses: DataFrame, how: str = "sum") -> DataFrame:
    total = F.sum("loss")
    return losses.agg(F.round(total if how == "sum" else total / F.sum("pairs"), 6).alias("loss"), F.sum("pairs").alias("pairs"))


def positive_ranks(scores: DataFrame) -> DataFrame:
    """(query_id, nll, rank, hit): of each query's positive, -log softmax of its score over all scores, and its place (ties count before). scores: query_id, item, score, positive."""
    w = Window.partitionBy("query_id")
    top = F.max("score").over(w)
    rows = scores.withColumns({"lse": F.ln(F.sum(F.exp(F.col("score") - F.max("score").over(w))).over(w)) + top, "rank": F.rank().over(w.orderBy(F.desc(F.round("score", 9))))})
    return rows.where("positive").select("query_id", "item", (F.col("lse") - F.col("score")).alias("nll"), "rank", (F.col("rank") == 1).cast("int").alias("hit"))


def best_so_far(epochs: DataFrame, value: str, run: str = "run", epoch: str = "epoch") -> DataFrame:
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return epochs.withColumn("best", F.max(value).over(w)).withColumn("improved", F.coalesce(F.col(value) > F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
