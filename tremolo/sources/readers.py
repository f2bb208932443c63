"""Readers of JSON lines, JSON and CSV with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.sources import logs
from tremolo.sources.logs import CORRUPT, parsed  # noqa: F401
from tremolo.sources.shared import exists


def jsonl(spark: SparkSession, path: str, schema: T.StructType, bad: str = "keep", pattern: str | None = None, missing_ok: bool = False) -> DataFrame:
    """A file or folder of JSON lines; blank lines are skipped.

    bad: ``keep`` adds _corrupt_record with each malformed line, ``drop`` leaves them out, ``fail``
    raises. missing_ok: no file is an empty table. pattern: of file names.
    """
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("recursiveFileLookup", True).option("mode", {"keep": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}[bad])
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if bad == "keep":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).json(path)


def json_by_suffix(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """.jsonl is read line by line, any other file as one document."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not path.endswith(".jsonl")).json(path)


def with_file_key(df: DataFrame, suffix: str, name: str = "file_key") -> DataFrame:
    """Adds the file's name without the suffix."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), f"^(.*){suffix}$", 1))


def judgments(spark: SparkSession, path: str, schema: T.StructType, model: str, task: str, missing_ok: bool = True) -> DataFrame:
    """One judge's rows for one task, out of a folder of logs."""
    if not missing_ok and not logs.paths(spark, path):
        raise FileNotFoundError(path)
    return logs.records(spark, path, schema).where((F.col("model") == model) & (F.col("task_type") == task))


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of literals; small by construction, to be broadcast."""
    return spark.createDataFrame(rows, schema)


def judges(spark: SparkSession) -> DataFrame:
    """The registry: model, ord, provider, model_id, max_tokens, cost_per_1k, display."""
    from tremolo.functions.fixed import JUDGES

    rows = [(m, k, p, i, t, c, d) for k, (m, p, i, _, t, c, d) in enumerate(JUDGES)]
    return dimension(spark, rows, "model string, ord int, provider string, model_id string, max_tokens int, cost_per_1k double, display string")


def jsonl_in_order(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of a log or a folder of logs: rows with the columns file and line added; file, line and text of the lines that are no JSON object. ``logs.read`` also tells where the table behind them is."""
    return logs.read(spark, path, schema, pattern)[:2]


def warn_malformed(malformed: DataFrame, most: int = 100) -> list[str]:
    """A warning for each malformed line, in order, at most ``most`` and then their number; they are also printed."""
    import warnings

    found = malformed.orderBy("file", "line").limit(most + 1).collect()
    said = [f"skipping malformed line {r.line} in {r.file}" for r in found[:most]]
    if len(found) > most:
        said.append(f"{malformed.count()} malformed lines in all")
    for text in said:
        warnings.warn(text, stacklevel=2)
    return said


def judgments_by_file(spark: SparkSession, folder: str, schema: T.StructType, model: str, task: str, missing_ok: bool = True) -> DataFrame:
    """The log that is named after its judge and task; if there is none, an empty table or FileNotFoundError."""
    path = f"{folder}/{model}_{task}.jsonl"
    if not missing_ok and not logs.paths(spark, path):
        raise FileNotFoundError(path)
    return logs.records(spark, path, schema)


def columns_of(df: DataFrame) -> list[str]:
    """Names of the columns, sorted: what a look at a log's first record would show."""
    return sorted(df.columns)


def env_values(text: str) -> dict[str, str]:
    """key=value lines of an environment file: the first = parts, # starts a comment line, blanks at the ends go."""
    pairs = (line.strip().split("=", 1) for line in text.splitlines() if "=" in line and not line.strip().startswith("#"))
    return {k.strip(): v.strip() for k, v in pairs}


def load_env(path: str = ".env", override: bool = False) -> dict[str, str]:
    """Adds an environment file's values to the driver's environment, where they aren't set unless override; no file, no values."""
    import os
    from pathlib import Path

    found = env_values(Path(path).read_text()) if Path(path).is_file() else {}
    for k, v in found.items():
        if override or k not in os.environ:
            os.environ[k] = v
    return found
