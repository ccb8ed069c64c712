"""An extension: queries that arrive as a stream, searched against the static index batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import bloom, text
from ..operators import search


def query_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of queries as they arrive in a folder: query_id, text, x, y."""
    return spark.readStream.schema("query_id long, text string, x double, y double").parquet(path)


def searched(queries: DataFrame, poi: DataFrame, poi_bits: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 20, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a query that hands (result, batch id) to the sink for each micro-batch; a batch that is run again has its old id, so that the sink can replace it."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            bits = bloom.exploded(batch, "query_id", "text", text.words)
            sink(search.exhaustive(poi, batch, poi_bits, bits, k), number)

    writer = queries.writeStream.foreachBatch(one).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
