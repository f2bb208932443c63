"""Bounds of samples, and columns of any name."""

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import PROSE, SF, docs_of, examples_of
from tremolo.llm import language, licences, mixing, neardup, packing, quality_crf, quality_rules, textkit, toxicity

STRANGE = ("__text", "__plan", "__mix", "__copy", "a.b", "a`b", "kept", "score", "key")


def strange(docs):
    """docs with columns that bear operators' names, whose values tell the row."""
    return docs.select("*", *[F.concat(F.col("doc_id").cast("string"), F.lit(f"/{k}")).alias(c) for k, c in enumerate(STRANGE)])


def unchanged(rows, names=STRANGE):
    found = rows.collect()
    assert found
    for r in found:
        for c in names:
            assert r[c] == f"{r.doc_id}/{STRANGE.index(c)}", c


def test_repeated_labelled_rows_stay_within_the_bounds(spark):
    docs = spark.range(50000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionByName(spark.range(2, 40).select(F.col("id").alias("doc_id"), F.lit("other").alias("text")))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"), (F.col("id") % 2).alias("quality"))
    labels = labels.unionByName(labels)
    assert 0 < len(textkit.labelled_sample(docs, labels, "quality", 10, 3, 1)) <= 10
    found = textkit.labelled_sample(docs, labels, "quality", 1000, 3, 1)
    assert len({x[0] for x in found}) == len(found) <= 40
    assert toxicity.labelled_texts(docs, labels, "toxic", 5, 0, most=10).count() <= 10
    small = textkit.labelled_sample(docs, labels, "quality", 1000, 3, 1, most_bytes=40)
    assert 0 < sum(len(x[1]) for x in small) <= 40


def test_repeated_rows_of_a_language_stay_within_the_bound(spark):
    docs = spark.range(50000).select((F.col("id") % 5).alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    more = spark.range(10, 2000).select(F.col("id").alias("doc_id"), F.lit("de").alias("lang"), F.lit("wort").alias("text"))
    found = language.sample(docs.unionByName(more), F.lit(True), per_language=300)
    assert sum(x[1] == "en" for x in found) <= 5
    assert 200 <= sum(x[1] == "de" for x in found) <= 300
    assert sum(len(x[2]) for x in language.sample(more, F.lit(True), per_language=300, most_bytes=400)) <= 400
    assert language.sample(more.where("false"), F.lit(True)) == []


def test_columns_of_any_name_pass_operators(spark):
    docs = strange(docs_of(spark).limit(60))
    unchanged(quality_rules.quality_rules(docs, docs.select("doc_id").limit(5)), [c for c in STRANGE if c not in ("kept",)])
    examples = examples_of(spark, [(k, ("you idiot " if k % 2 else "kind word ") + PROSE, k % 2) for k in range(20)])
    unchanged(toxicity.toxicity(docs, toxicity.train(examples)), [c for c in STRANGE if c != "score"])
    unchanged(language.identify_language(docs, language.train([(1, "en", PROSE), (2, "de", "der die und das ist nicht")])), [c for c in STRANGE if c != "score"])
    unchanged(quality_crf.quality_crf(docs, quality_crf.train(["good line", "*** |||"], [1, 0])), [c for c in STRANGE if c != "score"])
    unchanged(licences.licences(docs), [c for c in STRANGE if c != "score"])
    unchanged(mixing.mixed_documents(docs))
    assert packing.pack(docs, mixing.tokens("text"), F.xxhash64("text"), 2048).count() >= 60
    assert neardup.near_duplicates(docs, width=5).count() == 60


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_columns_of_any_name_pass_stages(spark, stage):
    import corpus_pipeline as P

    docs = strange(docs_of(spark))
    docs = docs.unionByName(docs.limit(5)) if stage == 2 else docs
    out = P.STAGES[stage][1](spark, docs, SF)
    assert out.columns == docs.columns
    unchanged(out)


def test_copies_of_one_row_are_dealt_from_bounded_arrays(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    df = spark.range(100).select(F.lit(1).alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    got = packing.pack(df, mixing.tokens("text"), F.xxhash64("text"), 2048)
    assert got.count() == 100 and got.select("bin_id").distinct().count() == 100
