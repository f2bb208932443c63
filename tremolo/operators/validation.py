"""Summaries of automatic and manual labels, and their agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions import decisions as D
from tremolo.operators.agreement import last_write


def automatic_summary(auto: DataFrame) -> DataFrame:
    """task_type (null: all), n, n_yes, n_no, yes_pct, over rows decided YES or NO."""
    rows = auto.where(F.col("validation_decision").isin("YES", "NO"))
    out = rows.rollup("task_type").agg(F.count("*").alias("n"), F.count_if(F.col("validation_decision") == "YES").alias("n_yes"), F.count_if(F.col("validation_decision") == "NO").alias("n_no"), F.grouping("task_type").alias("g"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("task_type")).alias("task_type"), "n", "n_yes", "n_no", F.round(100 * F.col("n_yes") / F.col("n"), 6).alias("yes_pct"))


def run_counters(auto: DataFrame) -> DataFrame:
    """task_type, yes, no, err: whatever is neither YES nor NO is an error."""
    d = F.col("validation_decision")
    return auto.groupBy("task_type").agg(F.count_if(d == "YES").alias("yes"), F.count_if(d == "NO").alias("no"), F.count_if(~F.coalesce(d.isin("YES", "NO"), F.lit(False))).alias("err"))


def flagged(auto: DataFrame) -> DataFrame:
    """pair_id, task_type of the pairs decided NO, in the order of pair_id."""
    return auto.where(F.col("validation_decision") == "NO").select("pair_id", "task_type").orderBy("pair_id", "task_type")


def manual_counts(manual: DataFrame) -> DataFrame:
    """task_type (TOTAL: all), yes, no, unsure."""
    label = F.col("manual_label")
    out = manual.where(label.isNotNull()).rollup("task_type").agg(*[F.count_if(label == x).alias(x.lower()) for x in ("YES", "NO", "UNSURE")], F.grouping("task_type").alias("g"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("task_type")).alias("task_type"), "yes", "no", "unsure")


def classifier_label(*columns: Column) -> Column:
    """The first filled of several columns, without white space, in upper case; true is YES, false is NO."""
    found = F.upper(F.btrim(D.first_filled(*[c.cast("string") for c in columns]), F.lit(D.SPACE)))
    return F.when(found == "TRUE", "YES").when(found == "FALSE", "NO").otherwise(found)


def manual_agreement(manual: DataFrame, auto: DataFrame, sequence: list[str] | None = None) -> DataFrame:
    """task_type, compared, agree, agreement (per cent, 0 if none was compared); UNSURE counts as NO."""
    if sequence:
        manual, auto = last_write(manual, ["pair_id"], sequence), last_write(auto, ["pair_id"], sequence)
    machine = auto.select("pair_id", classifier_label(F.col("validation_decision")).alias("machine")).where(F.col("machine").isin("YES", "NO"))
    human = manual.select("pair_id", "task_type", F.when(F.col("manual_label") == "UNSURE", "NO").otherwise(F.col("manual_label")).alias("human"))
    met = human.join(machine, "pair_id", "left")
    out = met.groupBy("task_type").agg(F.count("machine").alias("compared"), F.count_if(F.col("machine") == F.col("human")).alias("agree"))
    return out.withColumn("agreement", F.round(F.coalesce(F.try_divide(100.0 * F.col("agree"), F.col("compared")), F.lit(0.0)), 6))
