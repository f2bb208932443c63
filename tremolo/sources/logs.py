"""Logs of JSON lines: a log is a name, whatever holds its lines.

A log ``x.jsonl`` is a plain file, a folder of parts, or a plain file with a folder ``x.jsonl.parts``
beside it. Its lines stand in the order of the paths of its parts (a plain file comes first), and are
numbered through all of them, blank ones too. Parts that Spark still writes, or has given up, begin
with _ or . and aren't read.

Large files are read in splits. A line's place is its split and its place in the split; the numbers of
lines of the splits, one row each, are summed to tell its number. The lines are parsed once into a
table in the shared folder, from which all else is read: two reads of a file may be split in two ways
when executors come and go.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.sources import shared

CORRUPT = "_corrupt_record"
SUFFIX, PARTS = ".jsonl", ".parts"
#: Splits of which the sums are broadcast, with at most some 200 bytes each; beyond, they are joined.
FEW_SPLITS = 1 << 17
_BLANKS = " \t\r\f\v"


class Log(NamedTuple):
    """rows: the fields, file and line of each record. malformed: file, line, text of each line that is no JSON object. at: the table behind both."""

    rows: DataFrame
    malformed: DataFrame
    at: str

    def close(self) -> None:
        """Deletes the table; neither frame can be used after."""
        shared.remove(self.rows.sparkSession, self.at)


def paths(spark: SparkSession, where: str, pattern: str = f"*{SUFFIX}") -> list[str]:
    """Patterns of what there is of a log (a path that ends with .jsonl), or of all logs in a folder."""
    heads = [where] if where.endswith(SUFFIX) else [f"{where}/{pattern}"]
    return [p for h in heads for p in (h, h + PARTS) if shared.exists(spark, p)]


def folder(spark: SparkSession, log: str) -> str:
    """Where parts of a log are written: the log itself, or beside it where it is a plain file."""
    return log + PARTS if shared.is_file(spark, log) else log


def lines(spark: SparkSession, where: str, pattern: str = f"*{SUFFIX}") -> DataFrame:
    """file, path, block, row, text: every line with the log's name, and its place: part, start of the split, rising number in the split."""
    found = paths(spark, where, pattern)
    if not found:
        return spark.createDataFrame([], "file string, path string, block long, row long, text string")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    raw = spark.read.option("recursiveFileLookup", True).text(found)
    placed = raw.select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.btrim("value", F.lit(_BLANKS)).alias("text"))
    return placed.select(F.regexp_extract("path", r"([^/]+\.jsonl)(?:\.parts)?(?:/.*)?$", 1).alias("file"), "path", "block", "row", "text")


def parsed(df: DataFrame, schema: T.StructType, text: str = "text") -> DataFrame:
    """df with r: the text as a record, with the text itself in its field _corrupt_record if it is no JSON object.

    Whether a text is JSON is one question, whether a field fits its type another: a field that doesn't
    is null, and a text field takes any value as text. What follows an object, an array around it,
    or single quotes make a text malformed. Of a name that occurs twice the last value counts.
    """
    inner = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    outer = T.StructType([T.StructField("r", T.ArrayType(inner), True), T.StructField(CORRUPT, T.StringType(), True)])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    whole = F.from_json(F.concat(F.lit('{"r":['), F.col(text), F.lit("]}")), outer, how)
    fine = whole[CORRUPT].isNull() & (F.size(whole["r"]) == 1) & F.startswith(F.col(text), F.lit("{")) & F.endswith(F.col(text), F.lit("}"))
    record = F.col("__record")
    typed = [(_typed(record[f.name], f.dataType)).alias(f.name) for f in schema.fields]
    made = df.withColumn("__record", F.when(fine, whole["r"][0]))
    return made.withColumn("r", F.struct(*typed, F.when(record.isNull(), F.col(text)).alias(CORRUPT))).drop("__record")


def _typed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return value
    return F.from_json(value, kind) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else value.try_cast(kind)


def records(spark: SparkSession, where: str, schema: T.StructType) -> DataFrame:
    """The records of a log, or of all logs in a folder, in no order; malformed lines are left out, no log is an empty table."""
    found = parsed(lines(spark, where).where("text <> ''"), schema)
    return found.where(F.col(f"r.{CORRUPT}").isNull()).select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields])


def read(spark: SparkSession, where: str, schema: T.StructType, pattern: str = f"*{SUFFIX}") -> Log:
    """A log, or all logs in a folder, with numbered lines."""
    at = shared.fresh(spark, "log")
    found = shared.stored(parsed(lines(spark, where, pattern), schema).withColumn("text", F.col(f"r.{CORRUPT}")), at)
    splits = found.groupBy("file", "path", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    order = Window.partitionBy("file").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    before = splits.select("path", "block", (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("first") + 1).alias("shift"))
    before = F.broadcast(before) if splits.count() <= FEW_SPLITS else before
    numbered = found.where("text is null or text <> ''").join(before, ["path", "block"]).withColumn("line", F.col("row") + F.col("shift"))
    rows = numbered.where("text is null").select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields], "file", "line")
    return Log(rows, numbered.where("text is not null").select("file", "line", "text"), at)
