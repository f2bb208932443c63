"""The last row of each key over a growing log: a stream with keyed state, its journal, and the journal's compaction.

The state of a key is its last row so far, so late and repeated rows change nothing that a batch over
all rows would not. Each micro-batch adds the keys that changed to a journal, a folder of Parquet by
batch number; a batch that is run again replaces itself. The table is the journal's last row of each
key. Compaction folds the journal into one batch and may be broken off at any moment: until the folded
batches are deleted they only repeat what it holds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.operators.agreement import last_write
from tremolo.sources import shared

#: Rows of a log's file, about.
FILE_ROWS = 1 << 19


def latest(log: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """The row of each key that stands last by sequence, then by its other columns; log may be a table or a stream. An aggregate, combined before its one shuffle."""
    rest = [c for c in log.columns if c not in keys and c not in sequence]
    row = F.struct(*sequence, *rest)
    return log.groupBy(*keys).agg(F.max(row).alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in [*sequence, *rest]]).select(*log.columns)


def write_log(rows: DataFrame, at: str, by: list[str], parts: int) -> int:
    """Writes rows as a log that grows in ``parts`` parts; the files of a part. They are as many as the rows need, so that no task gathers a part."""
    files = max(1, -(-rows.count() // (parts * FILE_ROWS)))
    rows.repartition(parts * files, *by).write.parquet(at)
    return files


def follow(stream: DataFrame, keys: list[str], sequence: list[str], journal: str, checkpoint: str) -> int:
    """Runs the stream over all that is there, from where the checkpoint stands, and writes what changed to the journal; the batches written."""
    n = 0

    def add(batch: DataFrame, number: int) -> None:
        nonlocal n
        batch.write.mode("overwrite").parquet(_at(journal, number))
        n += 1

    query = latest(stream, keys, sequence).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return n


def current(spark: SparkSession, journal: str, schema: T.StructType, keys: list[str], sequence: list[str]) -> DataFrame:
    """The table that the journal holds; empty before its first batch."""
    if not batches(spark, journal):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", journal).parquet(journal)
    return last_write(rows.drop("batch"), keys, sequence)


def batches(spark: SparkSession, journal: str) -> list[int]:
    """Numbers of the journal's whole batches, rising."""
    files, at = shared.path_of(spark, journal)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(m[1]) for m in (re.fullmatch(r"batch=(-?\d+)", n) for n in names) if m and shared.exists(spark, f"{journal}/{m[0]}/_SUCCESS"))


def _at(journal: str, number: int) -> str:
    return f"{journal}/batch={number:012d}"


def compact(spark: SparkSession, journal: str, schema: T.StructType, keys: list[str], sequence: list[str]) -> int:
    """Folds all batches but the newest into one with a negative number, and deletes them; the batches left.

    The newest batch stays, as the stream may run it again. The fold is written beside the journal,
    moved in when it is whole, and only then are the folded batches deleted.
    """
    old = batches(spark, journal)[:-1]
    if len(old) > 1:
        fold, number = f"{journal}/_fold", min(old[0], 0) - 1  # readers pass over names that begin with _
        rows = spark.read.schema(schema).parquet(*[_at(journal, b) for b in old])
        last_write(rows, keys, sequence).write.mode("overwrite").parquet(fold)
        files, at = shared.path_of(spark, fold)
        files.rename(at, shared.path_of(spark, _at(journal, number))[1])
        for b in old:
            shared.remove(spark, _at(journal, b))
    return len(batches(spark, journal))
