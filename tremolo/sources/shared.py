"""The folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder made here where a local session has none."""
    context = spark.sparkContext
    at, known = context.getConf().get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if at is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="tremolo-")
        context.setCheckpointDir(at)
    return at or known.get()


def path_of(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as a URI that other libraries read."""
    files, where = path_of(spark, path)
    found = files.makeQualified(where).toString()
    return "file://" + found[len("file:") :] if found.startswith("file:/") and not found.startswith("file://") else found


def exists(spark: SparkSession, pattern: str) -> bool:
    files, where = path_of(spark, pattern)
    found = files.globStatus(where)
    return found is not None and len(found) > 0


def is_file(spark: SparkSession, path: str) -> bool:
    files, where = path_of(spark, path)
    return files.exists(where) and files.getFileStatus(where).isFile()


def remove(spark: SparkSession, path: str) -> None:
    files, where = path_of(spark, path)
    files.delete(where, True)


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str) -> DataFrame:
    """df written once, and read from there with its own schema."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
