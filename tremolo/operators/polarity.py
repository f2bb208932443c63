"""Statistics by prompt template; columns pair_id, run, model, ta, tb (templates), a, b (decisions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions import decisions as D
from tremolo.operators.agreement import last_write

#: A pair dimension of at most this many rows is broadcast.
FEW_PAIRS = 1 << 20


def pair_dimension(pairs: DataFrame, sequence: list[str] | None = None) -> DataFrame:
    """pair_id, ta, tb: of rows that share a pair_id the last by sequence (such as a log's file and line), then by the largest templates."""
    return last_write(pairs.select("pair_id", "ta", "tb", *(sequence or [])), ["pair_id"], sequence or []).select("pair_id", "ta", "tb")


def with_templates(log: DataFrame, pairs: DataFrame, known_only: bool = False, sequence: list[str] | None = None) -> DataFrame:
    """log with the templates ta and tb of its pair, UNKNOWN for a pair that the dimension (pair_id, ta, tb) lacks; such rows go if known_only. A repeated pair counts as in pair_dimension."""
    side = pair_dimension(pairs, sequence)
    side = F.broadcast(side) if pairs.select("pair_id").limit(FEW_PAIRS + 1).count() <= FEW_PAIRS else side
    joined = log.drop("ta", "tb").join(side, "pair_id", "inner" if known_only else "left")
    return joined.withColumns({t: F.coalesce(t, F.lit("UNKNOWN")) for t in ("ta", "tb")})


def _fixed_match() -> Column:
    return D.same(D.invert_if(F.col("a"), F.col("ta")), D.invert_if(F.col("b"), F.col("tb")))


def _share(match: Column) -> Column:
    return F.avg(match.cast("double"))


def corrected_jss(df: DataFrame) -> DataFrame:
    """model, jss_fixed, jss_original, delta, n: agreement with and without the inverted template's answers turned round."""
    raw = D.same(F.col("a"), F.col("b"))
    out = df.groupBy("model").agg(_share(_fixed_match()).alias("fixed"), _share(raw).alias("original"), F.count("*").alias("n"))
    four = lambda c, n: D.python_round(c, 4).alias(n)
    return out.select("model", four(F.col("fixed"), "jss_fixed"), four(F.col("original"), "jss_original"), four(F.col("fixed") - F.col("original"), "delta"), "n")


def pair_jss(df: DataFrame) -> DataFrame:
    """model, template_pair, jss, n, by unordered pair of templates that occurs."""
    known = df.where((F.col("ta") != "UNKNOWN") & (F.col("tb") != "UNKNOWN") & (F.col("ta") != F.col("tb")) & F.col("run").isin(1, 2, 3))
    return known.groupBy("model", D.template_pair(F.col("ta"), F.col("tb")).alias("template_pair")).agg(_share(_fixed_match()).alias("jss"), F.count("*").alias("n"))


def macro_delta(pairs: DataFrame) -> DataFrame:
    """model, jss_no_t4, jss_with_t4, delta, n_no_t4, n_with_t4: unweighted means over template pairs; a mean of zero counts as missing."""
    with_t4 = F.col("template_pair").contains("T4")
    out = pairs.groupBy("model").agg(
        F.nullif(F.avg(F.when(~with_t4, F.col("jss"))), F.lit(0.0)).alias("without"), F.nullif(F.avg(F.when(with_t4, F.col("jss"))), F.lit(0.0)).alias("with"),
        F.coalesce(F.sum(F.when(~with_t4, F.col("n"))), F.lit(0)).alias("n_no_t4"), F.coalesce(F.sum(F.when(with_t4, F.col("n"))), F.lit(0)).alias("n_with_t4"),
    )
    four = lambda c, n: D.python_round(F.col(c) if isinstance(c, str) else c, 4).alias(n)
    return out.select("model", four("without", "jss_no_t4"), four("with", "jss_with_t4"), four(F.col("without") - F.col("with"), "delta"), "n_no_t4", "n_with_t4")


def inverted_audit(df: DataFrame, first: str = "T3", second: str = "T4") -> DataFrame:
    """One row: over all judges and runs 1 to 3 of that template pair, raw disagreement and agreement raw and turned round; nulls are skipped, errors are not."""
    pair = D.template_pair(F.col("ta"), F.col("tb")) == f"{min(first, second)}-{max(first, second)}"
    rows = df.where(pair & F.col("run").isin(1, 2, 3) & F.col("a").isNotNull() & F.col("b").isNotNull())
    x, y = F.when(F.col("ta") == first, F.col("a")).otherwise(F.col("b")), F.when(F.col("ta") == first, F.col("b")).otherwise(F.col("a"))
    return rows.agg(
        F.count("*").alias("n"), F.round(_share(~D.same(x, y)), 6).alias("raw_disagreement"), F.round(_share(D.same(x, y)), 6).alias("raw_agreement"),
        F.round(_share(D.same(x, D.invert(y))), 6).alias("inverted_agreement"),
    )


def ordered_pair_jss(df: DataFrame) -> DataFrame:
    """pair_jss by template pair, best score first, then by judge."""
    return pair_jss(df).orderBy("template_pair", F.desc("jss"), "model")


def flip_overlap(df: DataFrame, order: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """pair_id, has_t4, flip_count, flipping_models: judges that flip in any run, in the order of the dimension (model, ord; a row a judge), else by name.

    pairs: the pair dimension (pair_id, ta, tb). With it every pair of it has a row, one without usable judgments counts 0 flips.
    """
    per = df.groupBy("pair_id", "model").agg(F.max(D.flipped(F.col("a"), F.col("b"))).alias("flips"), F.max(D.has_inverted(F.col("ta"), F.col("tb"))).alias("has_t4"))
    per = per.withColumn("ord", F.lit(0)) if order is None else per.join(order, "model", "left")
    names = F.array_sort(F.collect_list(F.when(F.col("flips"), F.struct("ord", "model"))))
    out = per.groupBy("pair_id").agg(
        F.max("has_t4").alias("has_t4"), F.count_if("flips").alias("flip_count"), F.array_join(F.transform(names, lambda s: s["model"]), ",").alias("flipping_models"),
    )
    if pairs is None:
        return out
    every = pair_dimension(pairs).select("pair_id", D.has_inverted(F.col("ta"), F.col("tb")).alias("has_t4"))
    found = every.join(out.drop("has_t4"), "pair_id", "left")
    return found.select("pair_id", "has_t4", F.coalesce("flip_count", F.lit(0)).alias("flip_count"), F.coalesce("flipping_models", F.lit("")).alias("flipping_models"))


def overlap_extremes(overlap: DataFrame, n_models: int, t4_least: float = 8, other_most: float = 1) -> DataFrame:
    """One row: pairs on which all n_models judges flip, none, any; the most flips; mean flips with and without the inverted template, and the verdict on them."""
    flips = F.col("flip_count")
    out = overlap.agg(
        F.count_if(flips == n_models).alias("n_all"), F.count_if(flips == 0).alias("n_none"), F.count_if(flips >= 1).alias("n_any"), F.max(flips).alias("most"),
        F.round(F.avg(F.when(F.col("has_t4"), flips)), 6).alias("t4_mean"), F.round(F.avg(F.when(~F.col("has_t4"), flips)), 6).alias("other_mean"),
    )
    return out.withColumn("verdict", F.when((F.col("t4_mean") >= t4_least) & (F.col("other_mean") <= other_most), "YES").otherwise("NO"))


def overlap_verdict(overlap: DataFrame, top: int = 10, most: int = 6) -> DataFrame:
    """One row: how many of the top pairs by flips (ties by pair_id) hold the inverted template, and the verdict."""
    head = overlap.orderBy(F.desc("flip_count"), "pair_id").limit(top)
    return head.agg(F.count_if("has_t4").alias("t4_in_top"), F.count("*").alias("n_top")).withColumn("verdict", F.when(F.col("t4_in_top") >= most, "YES").otherwise("NO"))
