"""The corpus pipeline: quality rules, toxicity, near duplicates, mixing, packing.

Each stage takes the documents that the stage before it kept, whole; all but the last return the
columns of documents, with their values, whatever their names. In every stage a very long text is
read whole and an empty table gives an empty table. A stage may be called by itself: it brings its
code to the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm import mixing, neardup, packing, quality_rules, toxicity
from tremolo.llm.textkit import cut, quoted, read_table, release, remove, shared_dir
from tremolo.shipping import shipped


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """docs with columns named by their place, these names, and those of doc_id and text, so that no column is taken for an operator's."""
    names = [f"column_{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; null, empty and short texts go, repeated rows stay or go together."""
    rows, names, name, text = _numbered(docs)
    marked = quality_rules.quality_rules(rows, quality_rules.trusted_documents(read_table(spark, sf_dir, "labels")).withColumnRenamed("doc_id", name), text, name)
    return marked.where("kept").select(*names).toDF(*docs.columns)


@shipped
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. Learns from the labelled documents of the corpus. Null and empty texts stay; repeated rows stay or go together."""
    examples = toxicity.labelled_texts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "toxic", 5, 0)
    rows, names, _, text = _numbered(docs)
    marked = toxicity.toxicity(rows, toxicity.train(examples), text)
    release()  # the executors have the index; later stages need the driver's memory
    return marked.where("predicted = 0").select(*names).toDF(*docs.columns)


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five-word shingles, the least doc_id.

    Of rows that share a doc_id one stays, that of the least text. Rows without a doc_id, and texts without a word, link with nothing and stay.
    """
    groups = neardup.near_duplicates(docs.select("doc_id", "text"), width=5, similarity=0.8)
    marked = cut(groups.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    every = [quoted(c) for c in docs.columns]
    rest = docs.join(marked.select("doc_id"), "doc_id", "left_anti").select(*every)
    twice = marked.where("kept").select("doc_id")
    if twice.isEmpty():
        return rest
    rows, names, name, text = _numbered(docs)
    row = F.struct(*names)
    one = rows.join(twice.withColumnRenamed("doc_id", name), name, "left_semi").groupBy(name).agg(F.min_by(row, F.struct(text, F.xxhash64(row))).alias("row"))
    return rest.unionByName(one.select("row.*").toDF(*docs.columns))


@shipped
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture reads it: no source more than 1.25 times, in all as many tokens as before, to within a document a source.

    A null source is a source of its own; texts without a word follow their source. Documents of one doc_id are read alike.
    """
    return mixing.mixed_documents(docs)


@shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words: one row a piece of a document. Texts without a word have a piece without a bin; copies made by the mixture lie in different bins."""
    return packing.pack(docs, mixing.tokens("text"), F.xxhash64("text"), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("toxicity", toxic), ("near duplicates", near_duplicates), ("mixing", mix), ("packing", pack),
]
#: SQL can't express the trained stages and the packing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again."""
    docs, out = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        if k:  # no later stage reads it again
            remove(spark, f"{out}/{k - 1}")
    return docs
