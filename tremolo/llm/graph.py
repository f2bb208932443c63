"""Connected components by star contraction over DataFrames; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.textkit import cut, sweep


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node that it reaches.

    edges: columns a, b (any order, repeats allowed). Each round hangs every neighbour of a node on
    the least one of its neighbourhood (large star, then small star), so stars merge along paths in
    a logarithmic number of rounds; edges stay at most as many as there were. A round's table and
    shuffle files go when the next is written.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = cut(pairs)
    for _ in range(rounds):
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
            .where("a <> b").distinct()
        )
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, pairs = pairs, cut(small.where("a <> b").distinct())
        sweep(edges.sparkSession, last)
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():  # all stars
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
