"""Agreement statistics over rows with the decision columns a and b."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.functions import decisions as D
from tremolo.operators import drawing

#: Tasks of a group's digest draws at most, and draws that are listed at a time.
SHARES, DRAWN = 64, 8192


def jss(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """keys, n_pairs, n_matches, n_flips, jss, flip_rate: share of rows whose decisions agree, by group of at least ``least`` rows."""
    match = D.same(F.col("a"), F.col("b")).cast("long")
    out = df.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.sum(match).alias("n_matches")).where(F.col("n_pairs") >= least)
    share = F.col("n_matches") / F.col("n_pairs")
    return out.select(*keys, "n_pairs", "n_matches", (F.col("n_pairs") - F.col("n_matches")).alias("n_flips"), share.alias("jss"), (1 - share).alias("flip_rate"))


def cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cells (a, b, n): how often each pair of decisions occurs, by group; the rows are read once."""
    counted = df.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "n")).alias("cells"))


def kappa(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_pairs, n_matches, p_o, p_e, cohens_kappa (1 where agreement by chance is certain).

    Chance agreement needs how often each label is the first and how often the second decision. A row
    counts for its two labels, sums by group and label are made before the first shuffle, and a
    second sums their products: linear in the rows, at any number of labels, in any task a few sums.
    """
    a, b = F.col("a"), F.col("b")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    sides = F.array(
        F.struct(a.alias("label"), one.alias("n_a"), zero.alias("n_b"), D.same(a, b).cast("long").alias("n_equal")),
        F.struct(b.alias("label"), zero.alias("n_a"), one.alias("n_b"), zero.alias("n_equal")),
    )
    label = "__label"
    by_label = df.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, F.col("s.label").alias(label)).agg(*[F.sum(f"s.{n}").alias(n) for n in ("n_a", "n_b", "n_equal")])
    both = F.sum(F.col("n_a").cast("double") * F.col("n_b"))
    counted = by_label.groupBy(*keys).agg(F.sum("n_a").alias("n_pairs"), F.sum("n_equal").alias("n_matches"), both.alias("both"))
    p_o, p_e = F.col("n_matches") / F.col("n_pairs"), F.col("both") / (F.col("n_pairs").cast("double") * F.col("n_pairs"))
    out = counted.select(*keys, "n_pairs", "n_matches", p_o.alias("p_o"), p_e.alias("p_e"))
    return out.withColumn("cohens_kappa", F.when(F.abs(1 - F.col("p_e")) < 1e-12, 1.0).otherwise(F.try_divide(F.col("p_o") - F.col("p_e"), 1 - F.col("p_e"))))


def bootstrap_hash(df: DataFrame, keys: list[str], order: list[str], replicates: int = 1000) -> DataFrame:
    """keys, ci_lower, ci_upper of the agreement share; resampled indices come from digests, so that SQL can repeat them.

    Costs replicates times the rows, each a digest and a look at a packed bit; order must be a total
    order within a group. A group's decisions are packed, an eighth of a byte a row, and go to at most
    SHARES tasks, each of which draws some of its replicates; draws are never joined or shuffled.
    """
    bit = D.same(F.col("a"), F.col("b")).cast("long")
    match = df.select(*keys, *[c for c in order if c not in keys], bit.alias("__bit"))
    for k in keys:  # SQL joins draws to rows by the keys, so a group without one has no interval
        match = match.where(F.col(k).isNotNull())
    placed = match.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    mask = F.expr("shiftleft(__bit, cast(__rn % 64 AS int))")
    words = placed.groupBy(*keys, F.floor(F.col("__rn") / 64).alias("__word")).agg(F.bit_or(mask).alias("__bits"), F.count("*").alias("__n"))
    packed = F.array_sort(F.collect_list(F.struct("__word", "__bits")))
    groups = words.groupBy(*keys).agg(F.sum("__n").alias("__n"), packed.alias("__packed")).select(*keys, "__n", F.col("__packed.__bits").alias("__bits"))
    shares = min(replicates, SHARES)
    parts = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(4 * SHARES, *keys, "__part")  # a number, so that these few bytes stay many tasks
    drawn = parts.withColumn("__r", F.explode(F.sequence(F.col("__part") + 1, F.lit(replicates), F.lit(shares))))
    drawn = drawn.withColumn("__at", F.explode(F.expr(f"sequence(0L, __n - 1, {DRAWN}L)")))  # so that no long array is made
    drawn = drawn.withColumn("__rn", F.explode(F.expr(f"sequence(__at, least(__at + {DRAWN - 1}L, __n - 1))")))
    index = F.conv(F.substring(F.md5(F.concat_ws("-", "__r", "__rn").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("__n")
    hit = F.expr("shiftrightunsigned(__bits[cast(__index div 64 AS int)], cast(__index % 64 AS int)) & 1L")
    hits = drawn.select(*keys, "__r", "__n", "__bits", index.alias("__index")).select(*keys, "__r", "__n", hit.alias("__hit"))
    means = hits.groupBy(*keys, "__r").agg((F.sum("__hit") / F.first("__n")).alias("mean"))
    return means.groupBy(*keys).agg(F.percentile("mean", F.lit(0.025)).alias("ci_lower"), F.percentile("mean", F.lit(0.975)).alias("ci_upper"))


Metric = Callable[[Sequence, Sequence], float]


def bootstrap_exact(
    df: DataFrame, keys: list[str], order: list[str], replicates: int = 1000, seed: int = 42, confidence: float = 0.95, metric_fn: Metric | None = None,
) -> DataFrame:
    """keys, ci_lower, ci_upper by a seeded generator per group, of metric_fn(decisions_a, decisions_b), by default of the share of equal ones.

    order: the order that the generator's indices refer to, such as the file and line of a log. The
    default metric draws a group's replicates in many tasks (``drawing``); any other metric needs the
    decisions of a replicate together, so there a group is one task.
    """
    if metric_fn is None:
        return drawing.shares(df.withColumn("__m", D.same(F.col("a"), F.col("b"))), "__m", keys, order, replicates, seed, confidence)
    tail = 100 * (1 - confidence) / 2

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        rng, n = np.random.default_rng(seed), len(pdf)
        a, b = pdf["a"].to_numpy(object), pdf["b"].to_numpy(object)
        found = [metric_fn(list(a[at]), list(b[at])) for at in (rng.integers(0, n, size=n) for _ in range(replicates))]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ci_lower": [np.percentile(found, tail)], "ci_upper": [np.percentile(found, 100 - tail)]})

    source = df.select(*keys, *[c for c in order if c not in keys], "a", "b")
    return source.groupBy(*keys).applyInPandas(one, _interval_schema(source, keys))


def bootstrap_cells(df: DataFrame, keys: list[str], metric_fn: Callable[[list, list, np.ndarray], float], replicates: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """keys, ci_lower, ci_upper of metric_fn(a, b, n) over the counted pairs of decisions, at any group size: a resample's counts are multinomial."""
    tail = 100 * (1 - confidence) / 2

    def draw(batches):
        for pdf in batches:
            rows = []
            for c in pdf["cells"]:
                c = sorted(c, key=lambda x: (str(x["a"]), str(x["b"])))
                a, b, n = [x["a"] for x in c], [x["b"] for x in c], np.array([x["n"] for x in c], float)
                found = [metric_fn(a, b, k) for k in np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), replicates)]
                rows.append(np.percentile(found, [tail, 100 - tail]))
            yield pdf[keys].assign(ci_lower=[r[0] for r in rows], ci_upper=[r[1] for r in rows])

    counted = cells(df, keys)
    return counted.mapInPandas(draw, _interval_schema(counted, keys))


def _interval_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "ci_lower double, ci_upper double"])


def binomial_quantiles(n: int, matches: int, tail: float) -> tuple[float, float]:
    """The least shares k / n at which the binomial distribution reaches tail and 1 - tail."""
    if matches in (0, n):
        return matches / n, matches / n
    p = matches / n
    sd = np.sqrt(n * p * (1 - p))
    k = np.arange(max(0, int(matches - 12 * sd - 12)), min(n, int(matches + 12 * sd + 12)) + 1)
    step = np.log((n - k[:-1]) / (k[:-1] + 1.0)) + np.log(p / (1 - p))
    logs = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.exp(logs - logs.max())
    reached = np.cumsum(mass) / mass.sum()
    return tuple(float(k[np.searchsorted(reached, t - 1e-12)]) / n for t in (tail, 1 - tail))


def bootstrap_limit(df: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    """keys, ci_lower, ci_upper of the agreement share: what percentiles of resamples tend to as their number grows. No draws, so the counts suffice."""
    return limits(kappa(df, keys), keys, confidence).select(*keys, "ci_lower", "ci_upper")


def limits(counted: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    """counted, which has n_pairs and n_matches, with ci_lower and ci_upper."""
    tail = (1 - confidence) / 2

    def add(batches):
        for pdf in batches:
            both = [binomial_quantiles(int(n), int(m), tail) for n, m in zip(pdf["n_pairs"], pdf["n_matches"], strict=True)]
            yield pdf.assign(ci_lower=[x[0] for x in both], ci_upper=[x[1] for x in both])

    fields = [*counted.schema.fields, T.StructField("ci_lower", T.DoubleType()), T.StructField("ci_upper", T.DoubleType())]
    return counted.mapInPandas(add, T.StructType(fields))


def bootstrap_binomial(df: DataFrame, keys: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """keys, ci_lower, ci_upper by binomial draws: a resample's matches are exactly binomial, so a group costs replicates draws at any size."""

    def draw(batches):
        for pdf in batches:
            rows = []
            for n, matches in zip(pdf["n_pairs"], pdf["n_matches"], strict=True):
                means = np.random.default_rng(seed).binomial(int(n), matches / n, replicates) / n
                rows.append(np.percentile(means, [2.5, 97.5]))
            yield pdf[keys].assign(ci_lower=[r[0] for r in rows], ci_upper=[r[1] for r in rows])

    counted = jss(df, keys, 1).select(*keys, "n_pairs", "n_matches")
    return counted.mapInPandas(draw, _interval_schema(counted, keys))


def metric_suite(df: DataFrame, keys: list[str], intervals: DataFrame | None = None) -> DataFrame:
    """All seven metrics by group of at least two rows, to four places of the exact value; one pass over the rows.

    intervals: keys, ci_lower, ci_upper of a bootstrap; without it the limit of many replicates.
    """
    counted = kappa(df, keys).where("n_pairs >= 2")
    counted = limits(counted, keys) if intervals is None else counted.join(intervals, keys)
    share = F.col("n_matches") / F.col("n_pairs")
    made = {"jss": share, "flip_rate": 1 - share, "cohens_kappa": F.col("cohens_kappa"), "ci_lower": F.col("ci_lower"), "ci_upper": F.col("ci_upper")}
    return counted.select(*keys, *[D.python_round(v, 4).alias(k) for k, v in made.items()], "n_pairs", (F.col("n_pairs") - F.col("n_matches")).alias("n_flips"))


def checked(a: list, b: list) -> tuple[list, list]:
    """The two decision lists, if they are of one length and not empty."""
    if len(a) != len(b):
        raise ValueError(f"decision lists differ in length: {len(a)} and {len(b)}")
    if not a:
        raise ValueError("decision lists are empty")
    return a, b


def judge_sensitivity_score(spark, a: list, b: list) -> float:
    """The share of equal decisions of two lists."""
    rows = spark.createDataFrame(list(zip(*checked(a, b), strict=True)), "a string, b string")
    return jss(rows.withColumn("g", F.lit(1)), ["g"], 1).first()["jss"]


def decision_flip_rate(spark, a: list, b: list) -> float:
    return 1 - judge_sensitivity_score(spark, a, b)


def cohens_kappa(spark, a: list, b: list) -> float:
    rows = spark.createDataFrame(list(zip(*checked(a, b), strict=True)), "a string, b string")
    return kappa(rows.withColumn("g", F.lit(1)), ["g"]).first()["cohens_kappa"]


compute_jss = judge_sensitivity_score


def last_write(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """For each key the row that stands last by sequence: one exchange and one sort; the limit of a row a key is applied before the exchange as well."""
    rest = [c for c in df.columns if c not in keys and c not in sequence]
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in [*sequence, *rest]])
    return df.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")
