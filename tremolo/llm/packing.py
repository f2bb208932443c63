"""Best-fit packing under conflicts.

Documents (their pieces, where one is longer than a bin) are dealt into blocks of about BLOCK by a
hash; each block is packed on its own, longest piece first. The open bins of a block stand in the
order of their residual capacity and carry two bitmaps: the sources and the duplicate clusters that
they hold. A piece goes to the tightest compatible bin: the search starts at the first bin with
room enough and moves to the successor until neither bitmap conflicts; if none is left, a bin opens.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.llm.textkit import cut, quoted

#: Pieces packed together. More would pack little tighter: a block leaves a few bins part empty.
BLOCK = 4096
#: Copies of one row that are dealt from one array.
COPIES = 1 << 14


def best_fit(size: np.ndarray, source: list, cluster: list, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each piece, in the given order; -1 for a piece of no size.

    A bin never holds two pieces of one source or of one cluster; None conflicts with nothing.
    """
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(x for x in source if x is not None))}
    cluster_bit = {c: 1 << k for k, c in enumerate(dict.fromkeys(x for x in cluster if x is not None))}
    by_room: list[tuple[int, int]] = []
    sources, clusters, held = [], [], []
    bins, places = np.full(len(size), -1, np.int64), np.full(len(size), -1, np.int64)
    for k, n in enumerate(size.tolist()):
        if not n:
            continue
        s, c = source_bit.get(source[k], 0), cluster_bit.get(cluster[k], 0)
        at = bisect_left(by_room, (n, -1))
        while at < len(by_room) and (sources[by_room[at][1]] & s or clusters[by_room[at][1]] & c):
            at += 1
        if at < len(by_room):
            room, b = by_room.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
            held.append(0)
        sources[b] |= s
        clusters[b] |= c
        bins[k], places[k] = b, held[b]
        held[b] += 1
        if room > n:
            insort(by_room, (room - n, b))
    return bins, places


def pack(df: DataFrame, n_tokens: Column, cluster: Column, capacity: int = 2048, id_col: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """(id_col, piece, start, n_tokens, bin_id, place) for each piece of each row of df.

    A row of more than capacity tokens is cut into pieces of capacity tokens and a rest, however
    long it is. A row without tokens (null and empty texts) has one piece of no tokens, whose bin_id
    and place are null. Rows of a null source conflict by cluster only, rows of a null cluster by
    source only. Repeated rows are counted first and then dealt one by one, each to a block of its
    own hash, so no block fills up with them; they are packed as often as they stand. Pieces of one
    size are taken in the order of their identifiers. bin_id names the block in its upper bits. An
    empty table gives an empty result; other columns of df play no part.
    """
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(source).cast("string").alias("source"), cluster.cast("long").alias("cluster"), F.coalesce(n_tokens, F.lit(0)).cast("long").alias("total"))
    counted = cut(rows.groupBy("id", "source", "cluster", "total").agg(F.count("*").alias("copies")))  # the texts are read once
    upto = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    count, most = counted.agg(F.sum(F.col("copies") * F.greatest(F.lit(1), F.ceil(F.col("total") / capacity))), F.max("copies")).first()
    blocks = max(1, -(-int(count or 0) // block))
    dozen = counted.withColumn("dozen", upto(F.ceil(F.col("copies") / COPIES)))
    if (most or 0) > COPIES:  # then many tasks deal one row's copies
        dozen = dozen.repartition("id", "total", "dozen")
    single = F.explode(F.sequence(F.col("dozen").cast("long") * COPIES, F.least("copies", (F.col("dozen").cast("long") + 1) * COPIES) - 1))
    pieces = dozen.withColumn("copy", single).withColumn("piece", upto(F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)))).withColumn("start", F.col("piece").cast("long") * capacity)
    pieces = pieces.withColumn("n", F.least(F.lit(capacity), F.col("total") - F.col("start")))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece", "total", "source", "cluster", "copy"), F.lit(blocks)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        bins, places = best_fit(pdf["n"].to_numpy(), [None if x is None else x for x in pdf["source"]], [None if pd.isna(x) else int(x) for x in pdf["cluster"]], capacity)
        empty = bins < 0
        return pd.DataFrame({
            "id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "n": pdf["n"],
            "bin_id": pd.Series((pdf["block"].to_numpy() << 32) + bins, dtype="Int64").mask(empty), "place": pd.Series(places, dtype="Int64").mask(empty),
        })

    packed = dealt.select("block", "id", "source", F.col("cluster").cast("string").alias("cluster"), "piece", "start", "n").groupBy("block").applyInPandas(run, "id long, piece int, start long, n long, bin_id long, place long")
    return packed.select(F.col("id").alias(id_col), "piece", "start", F.col("n").alias("n_tokens"), "bin_id", "place")
