"""Predictions, features and the contents of the pipeline's stages against plain Python."""

import math
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import PROSE, SF, brute_cosines, brute_near, docs_of, tokens
from tests.oracle import same
from tremolo.llm import language, mixing, packing, quality_crf, quality_rules, textkit, toxicity
from tremolo.llm.sql import ORACLES


def test_language_against_plain_ridge_regression(spark):
    rows = sorted((r.doc_id, r.lang, r.text) for r in docs_of(spark).where("doc_id < 60 and lang is not null and text is not null").collect())
    asked = [r.text or "" for r in docs_of(spark).where("doc_id >= 60 and doc_id < 90").collect()] + ["", "123", PROSE]
    grams = lambda t: set(np.flatnonzero(language.presence(*language._texts([t]))[0]).tolist())  # noqa: E731  the places of its n-grams
    kernel = lambda a, b: len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    names, known = sorted({r[1] for r in rows}), [grams(r[2]) for r in rows]
    marks = []
    for name in names:
        own = sorted((k for k in range(len(rows)) if rows[k][1] == name), key=lambda k: crc32(str(rows[k][0]).encode()))
        marks += sorted(own[: language.LANDMARKS_PER_LANGUAGE])
    k_nm = np.array([[kernel(a, known[j]) for j in marks] for a in known])
    k_mm = np.array([[kernel(known[i], known[j]) for j in marks] for i in marks])
    count = Counter(r[1] for r in rows)
    left, right = language.RIDGE * k_mm / len(rows) + 1e-8 * np.eye(len(marks)), np.zeros((len(marks), len(names)))
    for k, r in enumerate(rows):  # one equation a row, each language with the same weight in all
        left += np.outer(k_nm[k], k_nm[k]) / count[r[1]]
        right += np.outer(k_nm[k], [1.0 if n == r[1] else -1.0 for n in names]) / count[r[1]]
    weights = np.linalg.solve(left, right)
    model = language.train(rows)
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string")
    for r in language.identify_language(df, model).collect():
        f = np.array([kernel(grams(asked[r.doc_id]), known[j]) for j in marks]) @ weights
        if not any(map(str.isalpha, asked[r.doc_id])):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        best = np.sort(f)[::-1]
        assert r.lang_pred == names[int(f.argmax())] or best[0] - best[1] < 1e-2
        p = np.exp(4 * (f - f.max()))
        assert r.score == pytest.approx(p.max() / p.sum(), abs=2e-2)  # the operator's kernels have single precision


def test_languages_that_tie_go_by_the_alphabet(spark):
    model = language.train([(1, "xx", PROSE), (2, "aa", PROSE), (3, "mm", PROSE), (4, "aa", PROSE)])
    df = spark.createDataFrame([(k, PROSE) for k in range(3)], "doc_id int, text string")
    rows = language.identify_language(df, model).collect()
    assert len({(r.lang_pred, r.score) for r in rows}) == 1
    even = language.train([(1, "xx", PROSE), (2, "aa", PROSE)])
    assert {r.lang_pred for r in language.identify_language(df, even).collect()} == {"aa"}


def brute_features(text):
    """A row of measures for each line with a word, with its neighbours' and its place."""
    every = text.encode().split(b"\n")
    split = lambda line: [w for w in line.translate(bytes(32 if c in b"\t\x0b\x0c\r" else c for c in range(256))).split(b" ") if w]
    real = [x for x in every if split(x)]
    count = Counter(real)
    rows = []
    for x in real:
        w, n = split(x), len(x)
        share = lambda some, x=x, n=n: sum(c in some for c in x) / n
        rows.append([
            math.log1p(n) / 5, share(range(65, 91)), min(1, 4 * share(b"#*$%&<>")), min(1, 5 * share(b"!")), min(1, 5 * share(b"|")), share(range(48, 58)), share(range(128, 256)),
            n / len(w) / 10, 1 - len(set(w)) / len(w), float(count[x] > 1), share(b"\t\n\x0b\x0c\r "),
        ])
    none = [0.0] * 9
    out = [[*r, *(rows[k - 1][1:10] if k else none), *(rows[k + 1][1:10] if k + 1 < len(rows) else none), 1.0, float(k == 0), float(k + 1 == len(rows))] for k, r in enumerate(rows)]
    return out, [len(x) for x in real]


def test_line_features_against_plain_python(spark):
    texts = [r.text or "" for r in docs_of(spark).limit(80).collect()] + ["", "\n\n", "one", "a a\na a\n\n b!|", "É 12 ###\r\n\té\nÉ 12 ###", " x "]
    data, off = language._texts(texts)
    f, size, first = quality_crf.features(data, off)
    for k, text in enumerate(texts):
        want, lengths = brute_features(text)
        got = f[first[k] : first[k + 1]]
        assert size[first[k] : first[k + 1]].tolist() == lengths
        np.testing.assert_allclose(got, np.array(want).reshape(len(lengths), quality_crf.WIDTH), atol=1e-12)


def test_the_stage_of_toxicity_against_dense_cosines(spark):
    import corpus_pipeline as P

    docs = docs_of(spark)
    every = [(r.doc_id, r.text) for r in docs.collect()]
    label = {r.doc_id: r.toxic for r in textkit.read_table(spark, SF, "labels").collect() if r.toxic is not None}
    learnt = [(k, t, label[k]) for k, t in every if t is not None and k in label and crc32(str(k).encode()) % 5]
    some = every[:60]
    df = spark.createDataFrame(some, "doc_id long, text string")
    kept = {r.doc_id for r in P.toxic(spark, df, SF).collect()}
    prior = np.mean([x[2] for x in learnt])
    for k, text in some:  # frequencies are those of the stage's documents
        cosines = np.round(brute_cosines([x[1] for x in learnt], [x[2] for x in learnt], [t or "" for _, t in some], text or ""), 5)
        near = sorted(((c, -learnt[j][0], learnt[j][2]) for j, c in enumerate(cosines) if c > 0), reverse=True)[:15]
        score = (sum(c * y for c, _, y in near) + 0.1 * prior) / (sum(c for c, _, _ in near) + 0.1) if near else 0
        if abs(score - 0.5) > 1e-3:
            assert (k in kept) == (score < 0.5), k


def view_of(docs):
    db = duckdb.connect()
    frame = docs.select("doc_id", "source", "text").toPandas()
    db.register("documents", frame)
    return db


def test_the_stage_of_mixing_against_sql(spark):
    import corpus_pipeline as P

    docs = docs_of(spark).where("doc_id % 3 <> 1")
    got = P.mix(spark, docs, SF).groupBy("doc_id").count().toPandas().rename(columns={"count": "copies"})
    want = view_of(docs).execute(f"SELECT doc_id, copies FROM ({ORACLES['op5_mix_sources']}) WHERE copies > 0").df()
    same(got, want)


def test_the_stage_of_packing_keeps_every_token_apart(spark):
    import corpus_pipeline as P

    docs = docs_of(spark)
    docs = docs.unionByName(docs.where("doc_id < 20"))
    known = {r.doc_id: (len(tokens(r.text)), r.source, r.text) for r in docs.collect()}
    times = Counter(r.doc_id for r in docs.collect())
    rows = P.pack(spark, docs, SF).collect()
    words = Counter()
    bins = {}
    for r in rows:
        words[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    assert words == Counter({k: n * times[k] for k, (n, _, _) in known.items()})
    for own in bins.values():
        assert sum(r.n_tokens for r in own) <= 2048
        sources = [known[r.doc_id][1] for r in own if known[r.doc_id][1] is not None]
        assert len(sources) == len(set(sources))
        texts = [known[r.doc_id][2] for r in own]
        assert len(texts) == len(set(texts))


def test_stages_on_ties_and_very_long_texts(spark):
    import corpus_pipeline as P

    long = "\n".join(f"{PROSE} {k} {k * 7}." for k in range(20000))
    rows = [(k, long if k < 2 else f"{PROSE} {PROSE} {PROSE} with {k % 4} tail {k % 4}", "en", f"s{k % 3}", 1) for k in range(24)]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, lang string, source string, n_chars long")
    good = P.quality(spark, docs, SF)
    by_text = {}
    for r in good.collect():
        by_text.setdefault(r.text, set()).add(r.doc_id)
    assert all(ids in ({0, 1}, *({x for x in range(2, 24) if x % 4 == m} for m in range(4))) for ids in by_text.values())  # equal texts stay or go together
    assert sum(1 for _ in P.toxic(spark, docs, SF).where("doc_id < 2").collect()) in (0, 4)
    near = sorted(r.doc_id for r in P.near_duplicates(spark, docs, SF).collect())
    want = {k for k, v in brute_near([(r[0], r[1]) for r in rows], 5, 0.8).items() if v[2]}
    assert near == sorted(want)
    mixed = P.mix(spark, docs, SF)
    assert {r.text == long for r in mixed.where("doc_id = 0").collect()} <= {True}
    packed = P.pack(spark, docs, SF)
    n = len(tokens(long))
    assert packed.where("doc_id = 0").agg(F.sum("n_tokens")).first()[0] == 2 * n
    assert packed.where("doc_id = 1").groupBy("piece").count().where("count <> 2").isEmpty()


def test_repeated_labelled_rows_teach_once(spark):
    docs = spark.createDataFrame([(k, ("you idiot " if k % 2 else "kind word ") + PROSE) for k in range(1, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 40)], "doc_id long, toxic int, quality int")
    once = toxicity.train(toxicity.labelled_texts(docs, labels, "toxic", 5, 0))
    twice = toxicity.train(toxicity.labelled_texts(docs.unionByName(docs), labels.unionByName(labels), "toxic", 5, 0))
    assert all(np.array_equal(once[k], twice[k]) for k in once)
    args = ("quality", 4000, 3, 1)
    assert textkit.labelled_sample(docs, labels, *args) == textkit.labelled_sample(docs.unionByName(docs), labels.unionByName(labels), *args)
    assert quality_rules.trusted_documents(labels.unionByName(labels)).count() == 20
    assert packing.COPIES > 1 and mixing.FEW_SOURCES > 1


@pytest.mark.parametrize("part", [1, 37, 500])
def test_an_index_built_in_parts_is_the_same(monkeypatch, part):
    rng = np.random.default_rng(part)
    dense = (rng.random((300, 60)) * (rng.random((300, 60)) < rng.choice([0.0, 0.01, 0.04, 0.3], 60))).astype(np.float32)
    example, term = (x.astype(np.int32) for x in np.nonzero(dense))
    build = lambda: toxicity.BlockMaxIndex(example, term, dense[example, term], 60, 300)
    whole = build()
    monkeypatch.setattr(toxicity, "PART", part)
    parts = build()
    for name in ("example", "weight", "begin", "block", "top", "pairs", "layout"):
        np.testing.assert_array_equal(getattr(whole, name), getattr(parts, name))
