"""Views of the driver's tables as judgment records, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order numbers that stand for the pairs left out.
EXCLUDED = [40, 45, 50, 90, 95, 100]
YES_NO = {"O": "YES", "F": "NO", "P": "UNCLEAR"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as judgments of order priorities; a full quantity is a failed call, an order in progress is UNCLEAR."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    li = table(spark, sf_dir, "lineitem")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("run"), F.col("o_orderpriority").alias("model"), F.col("l_returnflag").alias("task_type"),
        F.when(F.col("o_orderstatus") == "P", "UNCLEAR").otherwise(F.col("o_orderstatus")).alias("a"), F.col("l_linestatus").alias("b"),
        F.when(F.col("l_quantity") == 50, "ERROR: timeout").alias("error"),
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    )


SEQUENCE = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
JUDGMENTS = """j AS (SELECT l_orderkey AS pair_id, l_linenumber AS run, o_orderpriority AS model, l_returnflag AS task_type,
  CASE WHEN o_orderstatus = 'P' THEN 'UNCLEAR' ELSE o_orderstatus END AS a, l_linestatus AS b,
  CASE WHEN l_quantity = 50 THEN 'ERROR: timeout' END AS error,
  l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgments with decisions YES and NO and the templates that the round robin gives to an order; usable rows only."""
    from tremolo.functions import decisions as D

    word = lambda c: F.when(F.col(c) == "O", "YES").when(F.col(c) == "F", "NO").otherwise(F.col(c))
    j = judgments(spark, sf_dir).select("pair_id", "run", "model", "error", word("a").alias("a"), word("b").alias("b"))
    j = j.withColumns({"ta": D.cycle_template(F.col("pair_id"), False), "tb": D.cycle_template(F.col("pair_id"), True)})
    return j.where(D.not_excluded(F.col("pair_id"), EXCLUDED) & D.no_error(F.col("error")) & D.filled_and_clear(F.col("a"), F.col("b")))


BY_TEMPLATE = JUDGMENTS + """, t AS (SELECT pair_id, run, model, a, b, ta, tb,
  CASE WHEN ta = 'T4' THEN CASE WHEN a = 'YES' THEN 'NO' ELSE 'YES' END ELSE a END AS fa,
  CASE WHEN tb = 'T4' THEN CASE WHEN b = 'YES' THEN 'NO' ELSE 'YES' END ELSE b END AS fb,
  least(ta, tb) || '-' || greatest(ta, tb) AS template_pair
  FROM (SELECT pair_id, run, model, error, CASE a WHEN 'O' THEN 'YES' WHEN 'F' THEN 'NO' ELSE a END AS a, CASE b WHEN 'O' THEN 'YES' WHEN 'F' THEN 'NO' ELSE b END AS b,
        'T' || ((pair_id * 2) % 5 + 1)::VARCHAR AS ta, 'T' || ((pair_id * 2 + 1) % 5 + 1)::VARCHAR AS tb FROM j)
  WHERE pair_id NOT IN (40, 45, 50, 90, 95, 100) AND error IS NULL AND a <> 'UNCLEAR' AND b <> 'UNCLEAR')"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as decisions on documents: quality as asked plainly, toxicity as asked inversely."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    word = lambda c: F.when(F.col(c) == 1, "YES").otherwise("NO")
    return j.select(F.col("doc_id").alias("pair_id"), F.col("source").alias("model"), F.col("lang").alias("task_type"), word("quality").alias("a"), word("toxic").alias("b"), "n_chars")


LABELLED = """j2 AS (SELECT doc_id AS pair_id, source AS model, lang AS task_type, CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END AS a,
  CASE WHEN toxic = 1 THEN 'YES' ELSE 'NO' END AS b, n_chars FROM labels JOIN documents USING (doc_id))"""


def validations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(manual, automatic): labels of documents, and a rule on their length that leaves some unclear."""
    j = labelled(spark, sf_dir)
    manual = j.select("pair_id", "task_type", F.when((F.col("a") == "NO") & (F.col("b") == "YES"), "UNSURE").otherwise(F.col("a")).alias("manual_label"))
    d = table(spark, sf_dir, "documents")
    auto = d.select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("task_type"), F.when(F.col("n_chars") > 500, "YES").when(F.col("n_chars") > 100, "NO").otherwise("UNCLEAR").alias("validation_decision"))
    return manual, auto


VALIDATIONS = LABELLED + """, m AS (SELECT pair_id, task_type, CASE WHEN a = 'NO' AND b = 'YES' THEN 'UNSURE' ELSE a END AS manual_label FROM j2),
v AS (SELECT doc_id AS pair_id, lang AS task_type, CASE WHEN n_chars > 500 THEN 'YES' WHEN n_chars > 100 THEN 'NO' ELSE 'UNCLEAR' END AS validation_decision FROM documents)"""
