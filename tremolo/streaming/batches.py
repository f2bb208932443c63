"""Work in small batches, each whole before the next begins."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from tremolo.sources import shared


def in_batches(work: DataFrame, each: Callable[[DataFrame, str], None], rows: int) -> int:
    """Calls each(batch, name) for batches of 1 to ``rows`` rows of work, one after the other; how many there were.

    work is written once, in files of at most ``rows`` rows; a checkpointed stream reads a file a
    batch. Names rise with the batches and from call to call. A batch that fails ends the stream, and
    the error is raised; what earlier batches wrote stands.
    """
    spark, n, began = work.sparkSession, 0, time.time_ns()
    at = shared.fresh(spark, "batches")

    def run(batch: DataFrame, number: int) -> None:
        nonlocal n
        if batch.isEmpty():
            return
        each(batch, f"{began:020d}-{number:08d}")
        n += 1

    try:
        work.write.option("maxRecordsPerFile", rows).parquet(f"{at}/work")
        stream = spark.readStream.schema(work.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/work")
        stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        shared.remove(spark, at)
    return n
