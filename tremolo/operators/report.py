"""Frames behind figures and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.functions import decisions as D


def task_jss(df: DataFrame) -> DataFrame:
    """model, task_type, jss, n: only errors and missing decisions go; UNCLEAR counts as a decision."""
    rows = df.where(D.no_error(F.col("error")) & D.filled(F.col("a"), F.col("b")))
    return rows.groupBy("model", "task_type").agg(F.avg(D.same(F.col("a"), F.col("b")).cast("double")).alias("jss"), F.count("*").alias("n"))


def heatmap(scores: DataFrame, tasks: list[str], models: DataFrame) -> DataFrame:
    """One row a model of the dimension, one column a task; null where nothing was judged. scores has a row a judge and task, so its pivot is broadcast."""
    wide = scores.groupBy("model").pivot("task_type", tasks).agg(F.first("jss"))
    return models.select("model").join(F.broadcast(wide), "model", "left").select("model", *[F.round(F.col(f"`{t}`"), 6).alias(f"jss_{t.lower()}") for t in tasks])


def bars(scores: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Score, interval, the two widths of its error bar, and band; lowest score first."""
    j = scores.join(intervals, keys)
    return j.select(*keys, F.round("jss", 6).alias("jss"), F.round(F.col("jss") - F.col("ci_lower"), 6).alias("err_lo"), F.round(F.col("ci_upper") - F.col("jss"), 6).alias("err_hi"), D.band(F.col("jss")).alias("band")).orderBy("jss", *keys)


def paper_rows(corrected: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """place, name, line: LaTeX rows, best corrected score first, then raw score, then name."""
    named = corrected.withColumn("name", F.col("model")) if names is None else corrected.join(names, "model", "left").withColumn("name", F.coalesce("name", "model"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("jss_fixed"), F.desc("jss_original"), "name"))  # a row a judge
    three = [D.python_round(F.col(c), 3).alias(c) for c in ("jss_original", "jss_fixed", "delta")]
    line = F.format_string("%-22s & %.3f & %.3f & %+.3f \\\\", "name", *three)
    return named.select(place.alias("place"), "name", line.alias("line"))


def raw_and_corrected(corrected: DataFrame, models: DataFrame) -> DataFrame:
    """Both scores of every model of the dimension with the label of the change and the height it stands at."""
    j = models.select("model").join(F.broadcast(corrected), "model", "left")  # corrected has a row a judge
    return j.select("model", "jss_original", "jss_fixed", F.when(F.col("delta").isNull(), "N/A").otherwise(F.format_string("%+.2f", D.python_round(F.col("delta"), 2))).alias("label"), F.round(F.greatest("jss_original", "jss_fixed") + 0.02, 6).alias("height"), D.significance(F.col("delta")).alias("mark"))


def interval_text(lower, upper, digits: int = 3):
    """[lower,upper], N/A where there is none."""
    text = F.format_string(f"[%.{digits}f,%.{digits}f]", D.python_round(lower, digits), D.python_round(upper, digits))
    return F.when(lower.isNull() | F.isnan(lower), "N/A").otherwise(text)


#: The printed table: heading, width and column of each field.
CONSOLE = (("judge", 22, "model"), ("task", 13, "task_type"), ("pairs", 8, "n_pairs"), ("score", 8, "jss"), ("95 % interval", 16, None), ("flips", 8, "flip_rate"), ("kappa", 8, "cohens_kappa"))


def console_head() -> str:
    """The headings over console_rows."""
    return " ".join(f"{name:{'<' if width > 12 and column else '>'}{width}}" for name, width, column in CONSOLE)


def console_rows(suite: DataFrame) -> DataFrame:
    """model, task_type, line: the suite as lines of a fixed-width table, in the order of model and task."""
    interval = interval_text(F.col("ci_lower"), F.col("ci_upper"))
    kinds = {"n_pairs": "d", "model": "s", "task_type": "s"}
    cells = [interval if c is None else F.col(c) if c in kinds else D.python_round(F.col(c), 3) for _, _, c in CONSOLE]
    shape = " ".join(f"%{'-' if width > 12 and c else ''}{width}{kinds.get(c, 's' if c is None else '.3f')}" for _, width, c in CONSOLE)
    return suite.select("model", "task_type", F.format_string(shape, *cells).alias("line")).orderBy("model", "task_type")
