"""Replicates of a share, drawn in parallel from one generator's stream.

The published intervals draw all replicates of a group one after the other from one seeded PCG64
generator. Its stream can be entered at any place, and whether a 32-bit value of it is used (the
bounded draw rejects a few) depends on that value alone. So tasks take stretches of the stream: first
they count the values used in each, then, knowing how many came before, they draw. The result is that of
one generator, draw by draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.sources import shared

#: Draws that are worth a task of their own, and tasks of one group at most: each holds a byte a row of its group.
STRETCH, MOST = 1 << 24, 64
#: Rows of a packed block, and stream values that are drawn at a time.
BLOCK, STEP = 1 << 20, 1 << 18


def threshold(n: int) -> int:
    """A value x of the stream is used if the lower 32 bits of x * n are not below this."""
    return (2**32 - n) % n


def used(seed: int, n: int, begin: int, end: int) -> Iterator[np.ndarray]:
    """The indices below n that the 64-bit outputs begin to end of the stream give, in order: each has two values, the lower half first."""
    stream = np.random.PCG64(seed).advance(begin)
    least = np.uint64(threshold(n))
    for at in range(begin, end, STEP):
        raw = stream.random_raw(min(STEP, end - at))
        values = np.empty(2 * len(raw), np.uint64)
        values[::2], values[1::2] = raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)
        values *= np.uint64(n)
        yield (values[(values & np.uint64(0xFFFFFFFF)) >= least] >> np.uint64(32)).astype(np.int64)


def stretches(n: int, draws: int) -> list[tuple[int, int]]:
    """Stretches of 64-bit outputs that surely hold so many used values: more by ten standard deviations than are expected."""
    share = 1 - (2**32 % n) / 2**32
    need = draws / share
    length = int(np.ceil((need + 10 * np.sqrt(need * (1 - share)) + 64) / 2))
    parts = max(1, min(MOST, -(-draws // STRETCH)))
    ends = np.linspace(0, length, parts + 1).astype(np.int64).tolist()
    return list(zip(ends[:-1], ends[1:], strict=True))


def blocks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, part, number, n, bits: the group's matches (__bit) in order, packed; a group is sorted in many tasks."""
    rest = [c for c in order if c not in keys]
    placed = rows.repartitionByRange(*keys, *rest).sortWithinPartitions(*keys, *rest) if rest or keys else rows.coalesce(1)
    tagged = placed.select(*keys, F.xxhash64(*keys).alias("__group"), F.spark_partition_id().alias("__part"), "__bit")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group, part, number, names = [], None, 0, 0, None

        def flush() -> pd.DataFrame:
            bits = np.concatenate(held)
            return pd.DataFrame({**{k: [v] for k, v in names.items()}, "part": [part], "number": [number], "n": [len(bits)], "bits": [np.packbits(bits).tobytes()]}, dtype=object)

        for pdf in batches:
            if not len(pdf):
                continue
            part, of, bit = int(pdf["__part"].iloc[0]), pdf["__group"].to_numpy(), pdf["__bit"].to_numpy(bool)
            begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for lo, hi in zip(begins, [*begins[1:], len(of)], strict=True):
                if held and (of[lo] != group or sum(map(len, held)) >= BLOCK):
                    yield flush()
                    held, number = [], number + 1
                group, names = of[lo], {k: pdf[k].iloc[lo] for k in keys}
                held.append(bit[lo:hi])
        if held:
            yield flush()

    return tagged.mapInPandas(pack, f"{_kinds(tagged, keys)}part int, number int, n long, bits binary")


def _placed(groups: DataFrame, keys: list[str], seed: int, replicates: int) -> DataFrame:
    """groups with a row a stretch: begin, end, and how many used values come ahead of it."""
    parts = F.udf(lambda n: stretches(n, n * replicates), "array<struct<begin:long,end:long>>")  # a row a group
    dealt = groups.withColumn("stretch", F.explode(parts("n"))).select(*keys, "n", "sizes", "bits", "stretch.begin", "stretch.end")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [sum(len(x) for x in used(seed, int(n), b, e)) if threshold(int(n)) else 2 * (e - b) for n, b, e in zip(pdf["n"], pdf["begin"], pdf["end"], strict=True)]
            yield pdf[[*keys, "begin"]].assign(found=found)

    counted = dealt.select(*keys, "n", "begin", "end").repartition(*keys, "begin").mapInPandas(count, f"{_kinds(groups, keys)}begin long, found long")
    ahead = F.coalesce(F.sum("found").over(Window.partitionBy(*keys).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a stretch
    ahead = counted.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("begin").alias("__begin"), ahead.alias("ahead"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return dealt.join(ahead, same & (F.col("begin") == F.col("__begin"))).select(*keys, "n", "sizes", "bits", "begin", "end", "ahead").repartition(*keys, "begin")


def shares(df: DataFrame, match: str, keys: list[str], order: list[str], replicates: int, seed: int, confidence: float) -> DataFrame:
    """keys, ci_lower, ci_upper of the share of rows that match, from the replicates of one generator a group; at most 2^32 rows a group."""
    rows = df.select(*keys, *[c for c in order if c not in keys], F.coalesce(match, F.lit(False)).alias("__bit"))
    largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest * replicates <= STRETCH:
        return _alone(rows, keys, order, replicates, seed, confidence)
    return _dealt(rows, keys, order, replicates, seed, confidence)


def _ends(found: np.ndarray, confidence: float) -> list[float]:
    tail = 100 * (1 - confidence) / 2
    return np.percentile(found, [tail, 100 - tail]).tolist()


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _alone(rows: DataFrame, keys: list[str], order: list[str], replicates: int, seed: int, confidence: float) -> DataFrame:
    """shares where each group is a task: no group has more draws than one stretch."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m, rng = pdf.sort_values(order, kind="stable")["__bit"].to_numpy(float), np.random.default_rng(seed)
        low, high = _ends([m[rng.integers(0, len(m), size=len(m))].mean() for _ in range(replicates)], confidence)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ci_lower": [low], "ci_upper": [high]})

    return rows.groupBy(*keys).applyInPandas(one, f"{_kinds(rows, keys)}ci_lower double, ci_upper double")


def _dealt(rows: DataFrame, keys: list[str], order: list[str], replicates: int, seed: int, confidence: float) -> DataFrame:
    """shares where a group's draws are dealt to many tasks."""
    packed = F.array_sort(F.collect_list(F.struct("part", "number", "n", "bits")))
    groups = blocks(rows, keys, order).groupBy(*keys).agg(F.sum("n").alias("n"), packed.alias("packed"))
    shared.shared_dir(rows.sparkSession)
    groups = groups.select(*keys, "n", F.col("packed.n").alias("sizes"), F.col("packed.bits").alias("bits")).checkpoint()  # an eighth of a byte a row, read twice
    kinds = _kinds(rows, keys)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n, rank = int(row["n"]), int(row["ahead"])
                m = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(k)) for x, k in zip(row["bits"], row["sizes"], strict=True)])
                sums = np.zeros(replicates, np.int64)
                for at in used(seed, n, int(row["begin"]), int(row["end"])):
                    of = (rank + np.arange(len(at))) // n
                    rank += len(at)
                    inside = of < replicates
                    sums += np.bincount(of[inside], weights=m[at[inside]], minlength=replicates).astype(np.int64)
                some = np.union1d(np.flatnonzero(sums), [0])  # a group without a match has a row too
                yield pd.DataFrame({**{k: [row[k]] * len(some) for k in keys}, "n": n, "replicate": some, "hits": sums[some]})

    hits = _placed(groups, keys, seed, replicates).mapInPandas(draw, f"{kinds}n long, replicate int, hits long")
    by_replicate = hits.groupBy(*keys, "n", "replicate").agg(F.sum("hits").alias("hits"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.zeros((len(pdf), replicates))  # a replicate without a match may have no row
            for k, (n, some) in enumerate(zip(pdf["n"], pdf["hits"], strict=True)):
                found[k, : len(some)] = np.asarray(some, float) / n
            rows = [_ends(x, confidence) for x in found]
            yield pdf[keys].assign(ci_lower=[r[0] for r in rows], ci_upper=[r[1] for r in rows])

    found = by_replicate.groupBy(*keys).agg(F.first("n").alias("n"), F.collect_list("hits").alias("hits"))  # at most a number a replicate
    return found.mapInPandas(ends, f"{kinds}ci_lower double, ci_upper double")
