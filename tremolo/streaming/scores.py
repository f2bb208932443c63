"""Agreement over a growing log of judgments (an extension: batch and stream give the same table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.functions import decisions as D


def running_jss(log: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_pairs, n_matches over a stream or table with a, b and error."""
    rows = log.where(D.no_error(F.col("error")) & D.clear(F.col("a"), F.col("b")))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.sum(D.same(F.col("a"), F.col("b")).cast("long")).alias("n_matches"))


def finish(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and gives its complete table."""
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
