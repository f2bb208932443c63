"""Writers of JSON lines, JSON, CSV and Parquet."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame

from tremolo.sources import logs


def append_jsonl(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds rows to a log; null fields are written. A log that is a plain file stays as it is, its further rows stand in a folder beside it.

    Each write is a folder of its own in the log, named by the time or by ``batch``, so that logs are read in the order in which they
    were written; a batch that is written again replaces itself.
    """
    at = f"{logs.folder(df.sparkSession, path)}/{batch or f'{time.time_ns():020d}'}"
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(at)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    """Replaces a folder of JSON lines. path must not be one that df reads."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def by_task(df: DataFrame, path: str) -> None:
    """A folder a task; a read of path gives them all."""
    df.write.mode("overwrite").partitionBy("task_type").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """One CSV part with a header; for small result tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary_json(metrics: DataFrame, path: str) -> dict:
    """The nested document model -> task -> metrics; a row a judge and task reaches the driver."""
    out: dict = {}
    for r in metrics.orderBy("model", "task_type").collect():
        d = r.asDict()
        out.setdefault(d.pop("model"), {})[d.pop("task_type")] = d
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2))
    return out


def by_task_jsonl(df: DataFrame, path: str, tasks: list[str], combined: str = "combined") -> None:
    """JSON lines: a folder {task}.jsonl for each task, one part each as tasks are small dimensions, and one of them all, by task and pair_id."""
    for task in tasks:
        overwrite_jsonl(df.where(df["task_type"] == task).orderBy("pair_id").coalesce(1), f"{path}/{task}.jsonl")
    overwrite_jsonl(df.where(df["task_type"].isin(tasks)).orderBy("task_type", "pair_id").coalesce(1), f"{path}/{combined}.jsonl")
