"""Makes this package importable on executors whose Python path lacks it."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources along with the session's jobs, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tremolo-src-")) / "tremolo_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query, whose first argument is the session, after ``ship``."""

    @wraps(query)
    def run(spark: SparkSession, *rest, **named) -> DataFrame:
        ship(spark)
        return query(spark, *rest, **named)

    return run
