"""The operators as queries over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm import context_tree, language, licences, mixing, neardup, packing, quality_crf, quality_rules, repair, sstable, topk, toxicity, trie
from tremolo.llm.sql import ORACLES
from tremolo.llm.textkit import held_out, labelled_sample, read_table, release, shared_dir


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; texts that are alike to the byte are one duplicate cluster. Null and empty texts have one piece without a bin. One row a piece."""
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, mixing.tokens("text"), F.xxhash64("text"), 2048)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows outside the fold; null texts and texts without a letter are und. One row a row of documents."""
    docs = read_table(spark, sf_dir, "documents")
    apart = held_out("doc_id", 4, 2)
    model = language.train(language.sample(docs, ~apart))
    return language.identify_language(docs.select("doc_id", apart.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op3_token_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token ids of every whole text with an end of their own, written as sorted shards and read back; a null text is empty. tokenizer: path of the tokenizer's file, on all executors. One row a row of documents."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = read_table(spark, sf_dir, "documents")
    out = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    manifest = sstable.write_shards(docs, out, tokenizer, 2, sstable.shards_for(docs.select("doc_id", "text"), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return sstable.read_shards(spark, manifest)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every whole text; all documents labelled good are the trusted ones. One row a row of documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs, quality_rules.trusted_documents(read_table(spark, sf_dir, "labels")), keep=["doc_id"])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is read: a budget of all tokens, no source read more than 1.25 times. One row a row of documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixing.read_times(mixing.mixture(docs), docs)
    return rows.select("doc_id", "source", mixing.tokens("text").alias("n_tokens"), F.round("__mix.exponent", 6).alias("exponent"), F.round("__mix.weight", 6).alias("weight"), F.col("__mix.copies").alias("copies"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from labelled rows outside the fold; texts without a word score the share of good examples. One row a row of documents."""
    docs = read_table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, read_table(spark, sf_dir, "labels"), "quality", quality_crf.TRAIN_ROWS, 3, 1)
    model = quality_crf.train([s[1] for s in sample], [s[2] for s in sample])
    return quality_crf.quality_crf(docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add-one word scores and context-tree scores of every whole text, learned from the rows outside the fold; null counts as empty. One row a row of documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "text")
    scored = context_tree.language_model(docs.withColumn("trains", ~F.col("held_out")), "trains", keep=["held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose two-word shingle sets are alike by 0.8; texts without a word link with nothing. One row a row of documents."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, similarity=0.8)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector, by the inner product of quantised components. Vectors that are null or hold a null or non-finite component take no part. One row a query and rank."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by its nearest labelled examples outside the fold, with the examples as evidence. Null and empty texts have no evidence and score below one half. One row a row of documents."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.labelled_texts(docs, read_table(spark, sf_dir, "labels"), "toxic", 5, 0))
    scored = toxicity.toxicity(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    del model
    release()
    return scored


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: each begins with up to eight turns of its family's lead. Null role or text is empty; rows without a conv_id belong to no conversation, repeated rows are turns of their own, turns that tie go by a digest. No conversations, no nodes. One row a node."""
    nodes, ends = trie.prefix_trie(trie.steps(trie.digests(read_table(spark, sf_dir, "conversations")), family=5, borrowed=8))
    found = nodes.join(trie.joined_ids(ends), "key", "left")
    return found.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of each damaged conversation. Nulls are one blank; a null conv_id is a conversation of its own. One row a conv_id of the table, also where damage left no turn."""
    conversations = read_table(spark, sf_dir, "conversations")
    rows = repair.damaged(conversations)
    at = f"{shared_dir(spark)}/repair-{uuid.uuid4().hex}"
    repair.plans(rows).write.parquet(at)  # read twice
    planned = spark.read.parquet(at)
    whole = repair.text_digests(repair.repaired(rows, planned))
    out = conversations.select(F.col("conv_id").cast("long").alias("c")).distinct()
    out = out.join(planned, F.col("c").eqNullSafe(planned["conv_id"]), "left").drop("conv_id")
    out = out.join(whole, F.col("c").eqNullSafe(whole["conv_id"]), "left").drop("conv_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col("c").alias("conv_id"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every whole text; null counts as empty. One row a row of documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.licences(docs, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_language_id, op3_token_shards, op4_quality_rules, op5_mix_sources, op6_quality_classifier,
        op7_lm_scoring, op8_near_duplicates, op9_exact_top_k, op10_toxicity, op11_prefix_trie, op12_conversation_repair, op13_licence_scan,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
