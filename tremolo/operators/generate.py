"""Prompt pairs from templates and items, by position in a round robin."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.functions import fixed


def _filled(template: Column, **parts: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), parts.items(), template)


#: Likeness from which two prompts are meant to count as equivalent; stored beside the pairs, and never applied to them.
EQUIVALENT = 0.85

Encoder = Callable[[list[str]], np.ndarray]


def items(spark: SparkSession, lettered: bool = True) -> DataFrame:
    """task_type, item, q, ra, rb, judged, label: a dimension of 25 rows. lettered: whether the two judged responses are marked A: and B:."""
    mark_a, mark_b = ("A: ", "B: ") if lettered else ("", "")
    rows = [("factuality", k, r, None, None, r, label) for k, (r, label) in enumerate(fixed.FACTUALITY_ITEMS)]
    rows += [("coherence", k, s, None, None, s, f"score_{k + 1}") for k, s in enumerate(fixed.COHERENCE_ITEMS)]
    for task, samples in (("relevance", fixed.RELEVANCE_ITEMS), ("preference", fixed.PREFERENCE_ITEMS)):
        rows += [(task, k, q, ra, rb, f"{mark_a}{ra} | {mark_b}{rb}", "A") for k, (q, ra, rb) in enumerate(samples)]
    return spark.createDataFrame(rows, "task_type string, item int, q string, ra string, rb string, judged string, label string")


def templates(spark: SparkSession) -> DataFrame:
    """task_type, t (from 0), template: a dimension of 20 rows."""
    by_task = {"factuality": fixed.FACTUALITY_TEMPLATES, "coherence": fixed.COHERENCE_TEMPLATES, "relevance": fixed.RELEVANCE_TEMPLATES, "preference": fixed.PREFERENCE_TEMPLATES}
    return spark.createDataFrame([(task, k, t) for task, ts in by_task.items() for k, t in enumerate(ts)], "task_type string, t int, template string")


def likeness(make_encoder: Callable[[], Encoder] | None, a: Column, b: Column) -> Column:
    """Cosine of the encodings of two texts, to four places; 1.0 without an encoder.

    make_encoder loads a model, once a task; the encoder gets the texts of a batch, each distinct one
    once, and gives a row for each. A null text, or an encoding of zeros, gives null.
    """
    if make_encoder is None:
        return F.lit(1.0)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for left, right in batches:
            both = pd.concat([left, right], ignore_index=True)
            code, texts = pd.factorize(both)
            vectors = np.asarray(encode(list(texts)), float) if len(texts) else np.zeros((0, 1))
            unit = vectors / np.where(norm := np.linalg.norm(vectors, axis=1, keepdims=True), norm, np.nan)
            unit = np.vstack([unit, np.full((1, unit.shape[1]), np.nan)])  # for nulls, whose code is -1
            found = np.einsum("ij,ij->i", unit[code[: len(left)]], unit[code[len(left) :]])
            yield pd.Series(found).round(4).astype(object).where(~np.isnan(found), None)

    return score(a, b)


def generate_pairs(spark: SparkSession, score: Column | None = None, lettered: bool = True, make_encoder: Callable[[], Encoder] | None = None) -> DataFrame:
    """All prompt pairs of all tasks. score: an expression over prompt_a and prompt_b; without it their likeness by make_encoder, 1.0 if there is neither. lettered: as in items."""
    tasks = spark.createDataFrame(fixed.TASKS, "task_type string, prefix string, source_benchmark string")
    pid = F.col("pid")
    per = F.when(F.col("task_type") == "factuality", F.when(pid < 65, F.floor(pid / 13)).otherwise(5 + F.floor((pid - 65) / 12))).otherwise(F.floor(pid / 25)).cast("int")
    slots = (
        tasks.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(fixed.PAIRS_PER_TASK - 1))))
        .withColumns({"item": per, "t_a": F.pmod(pid * 2, F.lit(5)), "t_b": F.pmod(pid * 2 + 1, F.lit(5))})
    )
    known = templates(spark)  # both dimensions are fixed and tiny
    joined = slots.join(F.broadcast(items(spark, lettered)), ["task_type", "item"])
    for side in ("a", "b"):
        joined = joined.join(F.broadcast(known.select("task_type", F.col("t").alias(f"t_{side}"), F.col("template").alias(f"template_{side}"))), ["task_type", f"t_{side}"])
    prompt = lambda side: _filled(F.col(f"template_{side}"), r=F.col("q"), s=F.col("q"), q=F.col("q"), ra=F.coalesce("ra", F.lit("")), rb=F.coalesce("rb", F.lit("")))
    made = joined.withColumns({"prompt_a": prompt("a"), "prompt_b": prompt("b")})
    return made.select(
        F.format_string("%s_%03d", "prefix", F.col("pid") + 1).alias("pair_id"), "task_type", "source_benchmark", "prompt_a", "prompt_b",
        F.col("judged").alias("response_being_judged"), F.col("label").alias("ground_truth_label"),
        (likeness(make_encoder, F.col("prompt_a"), F.col("prompt_b")) if score is None else F.round(score, 4)).alias("semantic_equivalence_score"),
    )
