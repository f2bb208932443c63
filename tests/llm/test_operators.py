"""Each operator on awkward inputs, and against a brute-force version."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremolo.llm import byte_contexts, context_tree, graph, language, mixing, neardup, packing, quality_crf, quality_rules, sstable, textkit, topk, toxicity
from tremolo.llm import queries as Q
from tests.oracle import duck, same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, place string"
PROSE = "the quick brown fox jumps over a lazy dog while rain falls on the old town and nobody looks up from work today"


def awkward(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", None, 3), (5, "ÀÉ ß́ 日本 \U0001f600", "fr", "s", 9),
        (6, PROSE, "en", "s", 100), (6, PROSE, "en", "s", 100), (7, PROSE + " and", "en", "t", 104), (None, PROSE, "en", "s", 100), (8, (PROSE + "\n") * 400, "en", "t", 44000),
        (9, "<|endoftext|> it's 12", "en", "t", 20), (10, "a b", "en", "t", 3),
    ]
    return spark.createDataFrame([(*r, 9.5, "mine", "here") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ")


def tokens(text):
    return [w for w in words(text) if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark):
    return textkit.read_table(spark, SF, "documents")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té日A", max_size=30), min_size=1, max_size=5))
def test_words_and_lines(texts):
    import pyarrow as pa

    data, off = textkit.buffers(pa.array([None, *texts])[1:])
    s, e, first = textkit.words(data, off)
    got = [[bytes(data[a:b]).decode() for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [tokens(t) for t in texts]
    h, _ = textkit.word_hashes(data, off)
    flat = [w for ws in got for w in ws]
    assert len(set(h.tolist())) == len(set(flat))
    ls, le, lf = textkit.lines(data, off)
    assert [[bytes(data[a:b]).decode() for a, b in zip(ls[i:j], le[i:j], strict=True)] for i, j in zip(lf[:-1], lf[1:], strict=True)] == [t.split("\n") for t in texts]


def test_held_out_fold(spark):
    rows = spark.range(50).select("id", textkit.held_out("id", 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def brute_fit(size, source, cluster, capacity):
    bins = []
    out = []
    for n, s, c in zip(size, source, cluster, strict=True):
        if not n:
            out.append(-1)
            continue
        fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n and not (s is not None and s in b["s"]) and not (c is not None and c in b["c"])]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[k]["room"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        out.append(k)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3, 4])), max_size=40))
def test_best_fit_is_the_tightest_compatible(pieces):
    size = np.array([p[0] for p in pieces], np.int64)
    got, _ = packing.best_fit(size, [p[1] for p in pieces], [p[2] for p in pieces], 20)
    assert got.tolist() == brute_fit(size, [p[1] for p in pieces], [p[2] for p in pieces], 20)


def test_packing_keeps_every_token(spark):
    for df in (awkward(spark), empty(spark), docs_of(spark)):
        rows = packing.pack(df, mixing.tokens("text"), F.xxhash64("text"), 100).toPandas()
        want = Counter()
        for r in df.collect():
            want[r.doc_id] += len(tokens(r.text))
        assert Counter({k: int(v) for k, v in rows.groupby(rows.doc_id.astype(object).where(rows.doc_id.notna(), None), dropna=False).n_tokens.sum().items()} if len(rows) else {}).total() == want.total()
        full = rows[rows.n_tokens > 0]
        assert (full.groupby("bin_id").n_tokens.sum() <= 100).all()
        assert rows[rows.n_tokens == 0].bin_id.isna().all()
        assert not full.duplicated(["bin_id", "place"]).any()


def test_equal_rows_are_dealt_into_many_blocks(spark):
    df = spark.range(1).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(50000))).alias("k"))
    rows = packing.pack(df, mixing.tokens("text"), F.xxhash64("text"), 2048)
    per = [r["count"] for r in rows.groupBy(F.shiftright("bin_id", 32).alias("b")).count().collect()]
    assert sum(per) == 50000
    assert len(per) == 13
    assert max(per) < 5000


def test_packing_conflicts(spark):
    docs = docs_of(spark)
    rows = packing.pack(docs, mixing.tokens("text"), F.xxhash64("text"), 2048).join(docs.select("doc_id", "source", F.xxhash64("text").alias("c")), "doc_id").where("n_tokens > 0").toPandas()
    assert not rows.duplicated(["bin_id", "source"]).any()
    assert not rows.duplicated(["bin_id", "c"]).any()


def test_language(spark):
    docs = docs_of(spark)
    got = Q.op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.95
    model = language.train(language.sample(docs, F.lit(True)))
    rows = language.identify_language(awkward(spark), model).toPandas()
    assert set(rows[rows.text.fillna("").str.strip().isin(["", "one"])].lang_pred) >= {"und"}
    assert (rows[rows.text.isna()].lang_pred == "und").all()
    assert rows.score.between(0, 1).all()
    assert "kept" in rows.columns
    assert language.identify_language(empty(spark), model).count() == 0
    assert set(language.identify_language(awkward(spark), None).toPandas().lang_pred) == {"und"}
    dirty = spark.range(300).selectExpr("id AS doc_id", "'a word' AS text", "concat('l', id) AS lang")
    assert len(language.sample(dirty.where("doc_id < 200"), F.lit(True))) == 200
    with pytest.raises(ValueError, match="languages"):
        language.sample(dirty, F.lit(True))


def test_kernel_is_the_blended_spectrum_on_ascii():
    raw = ["abcab", "bcab", "zz"]
    x = language.presence(*language._texts(raw))
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in raw]
    assert (x @ x.T).tolist() == [[len(a & b) for b in grams] for a in grams]


def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_shards_read_back(spark, tmp_path):
    for k, df in enumerate((awkward(spark), empty(spark), docs_of(spark))):
        manifest = sstable.write_shards(df, str(tmp_path / str(k)), tokenizer(), 2, 3)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.read_shards(spark, manifest).collect())
        want = sorted(((r.doc_id is not None, r.doc_id or 0, whole(r.text)) for r in df.collect()), key=lambda r: r[:2])
        crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
        assert Counter((g[1], g[2], g[3]) for g in got) == Counter((w[1] if w[0] else None, len(w[2]), crc(w[2])) for w in want)
        assert [g[1] for g in got] == [w[1] if w[0] else None for w in want]
        assert [g[0] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist() if got else True
    shard = sstable.Reader(manifest[0][1])
    inside = {d for d, _ in shard.scan()}
    some = next(iter(inside))
    text = docs_of(spark).where(F.col("doc_id") == some).first().text
    assert shard.get(some)[0].tolist() == whole(text)
    assert shard.get(10**12) == []


def test_token_shards_of_the_query(spark, monkeypatch):
    docs = docs_of(spark)
    got = sorted((r.doc_id, r.n_tokens) for r in Q.op3_token_shards(spark, SF, tokenizer()).collect())
    assert got == sorted((r.doc_id, len(whole(r.text))) for r in docs.collect())
    assert sstable.shards_for(docs, 3) == 3
    monkeypatch.setattr(sstable, "SHARD_BYTES", 1000)
    assert sstable.shards_for(docs, 3) > 30


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abAB é'É,.|!* \n\t3ß́ \x1c…<|>", max_size=40))
def test_encoder_equals_the_library(text):
    encode = sstable.Encoder(tokenizer(), 2)
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == whole(text)


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    texts = ["One  two,\n three's", "", " a\tB "]
    encode = sstable.Encoder(path, 7)
    assert not encode.piecewise
    assert sstable.Encoder(tokenizer(), 7).piecewise
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [[*library.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def brute_measures(text):
    w = tokens(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if tokens(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_rules(spark):
    labels = textkit.read_table(spark, SF, "labels")
    for df in (awkward(spark), docs_of(spark)):
        for r in quality_rules.quality_rules(df, quality_rules.trusted_documents(labels)).collect():
            want = brute_measures(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert r.kept is (not r.base_failed and r.log_ratio >= -0.5)
    assert quality_rules.quality_rules(empty(spark), quality_rules.trusted_documents(labels)).count() == 0
    judged = Q.op4_quality_rules(spark, SF).join(labels, "doc_id").where("not base_failed").toPandas()
    assert (judged.kept == (judged.quality == 1)).mean() > 0.95
    same(Q.op4_quality_rules(spark, SF).toPandas(), duck(SF).execute(Q.oracle_sql()["op4_quality_rules"]).df())


def test_log_ratio_by_hand(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "abcx")], "doc_id long, text string")
    every, good = quality_rules.counts(df.withColumn("g", F.col("doc_id") == 1), "text", "g")
    assert (every.sum(), good.sum()) == (4, 2)
    r = {x.doc_id: x.log_ratio for x in quality_rules.quality_rules(df, df.where("doc_id = 1").select("doc_id")).collect()}
    b = quality_rules.BUCKETS
    assert r[2] == pytest.approx(np.mean([np.log(2 / (2 + b)) - np.log(3 / (4 + b)), np.log(1 / (2 + b)) - np.log(2 / (4 + b))]), abs=1e-6)


def test_mixing_matches_sql_and_keeps_budget(spark):
    same(Q.op5_mix_sources(spark, SF).toPandas(), duck(SF).execute(Q.oracle_sql()["op5_mix_sources"]).df())
    for df in (awkward(spark), empty(spark)):
        rows = mixing.read_times(mixing.mixture(df), df)
        assert rows.count() == df.count()
        assert mixing.mixed_documents(df).columns == df.columns
    docs = docs_of(spark)
    planned = mixing.mixture(docs, repetition=None, entropy_share=0.5)
    p = planned.toPandas()
    w, share = p.weight.to_numpy(), (p.source_tokens / p.source_tokens.sum()).to_numpy()
    entropy = lambda x: -(x * np.log(x)).sum()
    assert entropy(w) == pytest.approx((entropy(share) + np.log(len(p))) / 2, abs=1e-6)
    n = mixing.tokens("text")
    used = mixing.read_times(planned, docs).groupBy("source").agg(F.sum(F.col("__mix.copies") * n).alias("n"), F.max(n).alias("most")).toPandas().set_index("source")
    for r in p.itertuples():  # within the one document that meets the budget
        assert r.target_tokens <= used.n[r.source] < r.target_tokens + used.most[r.source]


def test_mixing_reads_every_source(spark):
    rows = [(k, "w " * 50, "big") for k in range(40)] + [(100, "w " * 400, "one long document")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_documents(df, repetition=None, entropy_share=0.0, budget_share=0.1)
    assert {r.source for r in got.collect()} == {"big", "one long document"}


def test_mixing_reads_block_after_block(spark):
    rows = [(k, "w " * (1 + k % 7), "ab"[k % 3 == 0]) for k in range(60)] + [(90, None, "b"), (91, "w", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = {"repetition": None, "entropy_share": 0.0, "budget_share": 2.4}
    planned = mixing.mixture(df, **how)
    plan = {r.source: r for r in planned.collect()}
    found = {}
    for r in mixing.readings(planned, df).collect():
        found.setdefault((r.source or "", r["__mix"].block), []).append(r)
    words = {k: len((t or "").split()) for k, t, _ in rows}
    for name, p in plan.items():
        own = {k for k, _, s in rows if (s or "") == name}
        assert p.passes == 2
        for b in range(p.passes):  # a whole pass holds every document once
            assert sorted(r.doc_id for r in found[name, b]) == sorted(own)
        everyone = sorted(found[name, 0], key=lambda r: r["__mix"].place)
        head = sorted(found.get((name, p.passes), []), key=lambda r: r["__mix"].place)
        assert [r.doc_id for r in head] == [r.doc_id for r in everyone[: len(head)]]
        assert sum(words[r.doc_id] for r in head) >= p.rest >= sum(words[r.doc_id] for r in head[:-1])
        assert (name, p.passes + 1) not in found
    order = [r.doc_id for r in mixing.mixed_documents(df, ordered=True, **how).collect()]
    n = len(rows)
    assert order[:n] == order[n : 2 * n] and sorted(order[:n]) == sorted(r[0] for r in rows)  # no document comes again before its pass ends
    again = Counter(order)
    assert again == Counter(r.doc_id for r in mixing.mixed_documents(df, **how).collect())
    assert again == {r.doc_id: r["__mix"].copies for r in mixing.read_times(planned, df).collect()}


def test_mixing_leaves_columns_of_any_name_alone(spark):
    names = ["weight", "exponent", "passes", "last_key", "place", "n_tokens", "copies", "source_key", "rest", "sizes", "piece"]
    df = docs_of(spark).select("doc_id", "text", "source", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    plain = mixing.mixed_documents(df.select("doc_id", "text", "source"))
    count = lambda d: Counter(r.doc_id for r in d.select("doc_id").collect())
    assert count(got) == count(plain)
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)


def brute_chain(potential, change):
    import itertools

    total, good = 0.0, np.zeros(len(potential))
    for y in itertools.product((0, 1), repeat=len(potential)):
        v = np.exp(sum(potential[i] * y[i] for i in range(len(y))) + sum(change[a][b] for a, b in itertools.pairwise(y)))
        total += v
        good += v * np.array(y)
    return good / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    sizes = [3, 1, 0, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    potential, change = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    p, _ = quality_crf.marginals(potential, first, change)
    for a, b in zip(first[:-1], first[1:], strict=True):
        np.testing.assert_allclose(p[a:b], brute_chain(potential[a:b], change) if b > a else [], atol=1e-9)


def test_quality_classifier(spark):
    labels = textkit.read_table(spark, "/root/testdata/sf0.01", "labels")
    got = Q.op6_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    model = quality_crf.train(["good line\nmore of it", "*** $$$ |||"], [1, 0])
    rows = quality_crf.quality_crf(awkward(spark), model).toPandas()
    assert len(rows) == 12
    assert (rows[rows.text.isna()].score == 0.5).all()
    assert quality_crf.quality_crf(empty(spark), model).count() == 0
    assert quality_crf.quality_crf(awkward(spark), quality_crf.train([], [])).count() == 12


def brute_bytes(train, text):
    """Context-tree probabilities over whole bytes by recursion, and how many decisions met the full depth."""
    from math import exp, lgamma, log, log1p, pi

    depth = byte_contexts.DEPTH

    def walk(t):
        data = [255] * depth + [*lower(t).encode(), 255]
        for i in range(depth, len(data)):
            for k in range(8):
                yield tuple(data[i - depth : i]), (1 << k) | data[i] >> (8 - k), data[i] >> (7 - k) & 1

    counts, kids = {}, {}
    for t in train:
        for ctx, node, bit in walk(t):
            for d in range(depth + 1):
                counts.setdefault((ctx[depth - d :], node), [0, 0])[bit] += 1
                if d:
                    kids.setdefault((ctx[depth - d + 1 :], node), set()).add(ctx[depth - d :])
    block = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)

    def weighted(ctx, node):
        p = block(*counts[ctx, node])
        if len(ctx) < depth:
            deep = sum(weighted(c, node) for c in kids[ctx, node])
            p = log(0.5) + max(p, deep) + log1p(exp(-abs(p - deep)))
        return p

    def one(ctx, node, d):
        here = ctx[depth - d :]
        if (here, node) not in counts:
            return None
        c = counts[here, node]
        kt = (c[1] + 0.5) / (sum(c) + 1)
        q = one(ctx, node, d + 1) if d < depth else None
        if q is None:
            return kt
        w = exp(log(0.5) + block(*c) - weighted(here, node))
        return w * kt + (1 - w) * q

    total = 0.0
    for ctx, node, bit in walk(text):
        q = one(ctx, node, 0)
        q = 0.5 if q is None else q
        total += log10(q if bit else 1 - q)
    return total


def test_byte_contexts_against_recursion(spark, monkeypatch):
    texts = ["абв где абв гда", "Abab\n", None, "абв xyz 12", "日本語 日本人", "日本語 abab", ""]
    df = spark.createDataFrame([(k, t, k not in (3, 5)) for k, t in enumerate(texts)], "doc_id long, text string, t boolean")
    monkeypatch.setattr(byte_contexts, "CHUNK", 16)
    train = [t or "" for k, t in enumerate(texts) if k not in (3, 5)]
    counts = Counter(w for t in train for w in [*tokens(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    for r in context_tree.language_model(df, "t").collect():
        words_ = [*tokens(lower(texts[r.doc_id])), None]
        assert r.score == pytest.approx(brute_bytes(train, texts[r.doc_id] or ""), rel=1e-5)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words_), sum(counts[w] > 0 for w in words_), n)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in words_), rel=1e-9)
    for rows, n in ((empty(spark), 0), (awkward(spark), 12)):
        for taught in (True, False):
            assert context_tree.language_model(rows.withColumn("t", F.lit(taught)), "t").count() == n


def test_byte_contexts_of_the_query_grow_with_the_corpus(spark):
    docs = docs_of(spark).select(F.col("text").alias("t"))
    some, every = (sum(r.n for r in byte_contexts.gather(d, 4).collect()) for d in (docs.limit(20), docs))
    assert every > 2 * some
    texts = [r.t or "" for r in docs.collect()]
    assert every == len({k for t in texts for k in byte_contexts.keys(*textkit.buffers(__import__("pyarrow").array([t])))[0].tolist()})


def test_values_are_found_by_hash():
    rng = np.random.default_rng(5)
    for n in (1, 2, 300, 70000):
        key = np.unique(rng.integers(0, 1 << 56, n))
        value = rng.random(len(key)).astype("<f4")
        asked = rng.integers(0, len(key), 3 * n)
        np.testing.assert_array_equal(byte_contexts.Values(key, value).of(key[asked]), value[asked])
        np.testing.assert_array_equal(byte_contexts.unpack_logs(byte_contexts.pack_logs(value), len(value)), value)
    assert len(byte_contexts.Values(np.zeros(0, np.int64), np.zeros(0, "<f4")).of(np.zeros(0, np.int64))) == 0


def test_distinct_keys_of_slices(monkeypatch):
    rng = np.random.default_rng(6)
    found = [rng.integers(0, 500, n) for n in (0, 1, 400, 3000, 20)]
    for held in (1, 100, 1 << 22):
        monkeypatch.setattr(byte_contexts, "HELD", held)
        np.testing.assert_array_equal(byte_contexts.distinct_of_all(iter(found)), np.unique(np.concatenate(found)))


def test_values_take_less_time_than_a_sort_of_the_places():
    import time

    rng = np.random.default_rng(7)
    key = np.unique(rng.integers(0, 1 << 56, 1 << 18))
    value, asked = rng.random(len(key)).astype("<f4"), key[rng.integers(0, len(key), 1 << 20)]
    told = byte_contexts.Values(key, value)

    def least(work):
        times = []
        for _ in range(5):
            start = time.process_time()
            work()
            times.append(time.process_time() - start)
        return min(times)

    def by_sort():
        one, place = np.unique(asked, return_inverse=True)
        return value[np.searchsorted(key, one)][place]

    np.testing.assert_array_equal(told.of(asked), by_sort())
    assert least(lambda: told.of(asked)) < least(by_sort)


def test_a_large_corpus_asks_less_for_a_byte_of_text(spark):
    chunk, large = byte_contexts.CHUNK, byte_contexts.LARGE
    assert [byte_contexts.chunks_of(n) for n in (0, 1, chunk, chunk + 1, byte_contexts.ENOUGH * chunk)] == [1, 1, 1, 2, byte_contexts.ENOUGH]
    sizes = [n / byte_contexts.chunks_of(n) for n in range(chunk, 1 << 31, 12345678)]
    assert max(sizes) <= large and sizes[-1] > 0.9 * large
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").toArrow().column(0)
    data, off = textkit.buffers(texts)
    asked = []
    for size in (chunk, large):
        n = int(np.searchsorted(off, size))
        asked.append(len(byte_contexts.distinct_of(byte_contexts.keys(data[: off[n]], off[: n + 1])[0])) / off[n])
    assert asked[1] < 0.85 * asked[0]


def test_finished_steps_of_the_language_model_leave_the_disk(spark):
    import time
    from pathlib import Path

    context = spark.sparkContext._jsc.sc()
    textkit.shared_dir(spark)
    written = Path(context.getCheckpointDir().get().removeprefix("file:"))
    shuffles = lambda: context.env().mapOutputTracker().shuffleStatuses().size()
    textkit.sweep(spark)
    time.sleep(3)
    files, before = set(written.glob("rdd-*")), shuffles()
    got = context_tree.language_model(docs_of(spark).select("doc_id", "text", F.lit(True).alias("t")), "t")
    until = time.time() + 20
    while time.time() < until and shuffles() > before + 4:
        time.sleep(0.5)
    assert shuffles() <= before + 4  # those of the last step, which Python may let go just after the sweep
    assert len(set(written.glob("rdd-*")) - files) <= 2  # word counts and scores, which got reads; the model is gone
    assert got.count() == docs_of(spark).count()


def test_rare_words_are_joined(spark, monkeypatch):
    docs = docs_of(spark).select("doc_id", "text").withColumn("t", F.col("doc_id") % 3 != 0).cache()
    plain = context_tree.language_model(docs, "t").toPandas()
    monkeypatch.setattr(context_tree, "HEAD_WORDS", 50)
    same(plain.round(6), context_tree.language_model(docs, "t").toPandas().round(6))
    assert context_tree.language_model(empty(spark).withColumn("t", F.lit(True)), "t").count() == 0
    assert context_tree.language_model(awkward(spark).withColumn("t", F.lit(True)), "t", keep=["kept"]).count() == 12


def brute_near(rows, width, similarity):
    sets = {}
    for k, t in rows:
        w = tokens(lower(t))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= round(100 * similarity) * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 500, 60)]
    rows = []
    for k in range(150):  # a crowd at and around the threshold, with chains
        words_ = list(base)
        for at in rng.integers(0, 60, int(rng.integers(0, 9))):
            words_[at] = f"x{rng.integers(0, 40)}"
        rows.append((k, " ".join(words_)))
    rows += [(1000 + k, t) for k, t in enumerate([None, "", "one", "ONE", "a b", "b a", PROSE, PROSE.upper()])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK", 16)
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=width).collect()}
        assert got == brute_near(rows, width, 0.8)
        monkeypatch.setattr(neardup, "BLOCK", 512)  # the second width: blocks by their shingles
        monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1000)


def test_near_duplicates_awkward(spark):
    rows = neardup.near_duplicates(awkward(spark), width=5).collect()
    assert len(rows) == 12
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert neardup.near_duplicates(empty(spark)).count() == 0
    same(Q.op8_near_duplicates(spark, SF).toPandas(), duck(SF).execute(Q.oracle_sql()["op8_near_duplicates"]).df())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=25))
def test_components(spark, edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(20):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert graph.components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == []


def test_sweep_deletes_what_is_done_and_nothing_else(spark):
    def files(df):
        at = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
        where = spark._jvm.org.apache.hadoop.fs.Path(at)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    first = textkit.cut(spark.range(100).repartition(3, "id"))
    second = textkit.cut(first.groupBy((F.col("id") % 7).alias("k")).count())
    assert files(first) and files(second)
    textkit.sweep(spark, first)
    assert not files(first) and files(second)
    assert second.agg(F.sum("count")).first()[0] == 100
    textkit.sweep(spark, first)  # once more does no harm
    assert second.count() == 7


def test_exact_top_k(spark):
    same(Q.op9_exact_top_k(spark, SF).toPandas(), duck(SF).execute(Q.oracle_sql()["op9_exact_top_k"]).df())
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.5, -0.5]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0]), (8, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 65536), (0, 2, 3, 65536), (0, 3, 50, 32768), (50, 1, 0, 32768), (50, 2, 2, 32768), (50, 3, 3, 32768)]
    assert topk.top_k(df.limit(0), df).count() == 0
    with pytest.raises(Exception, match="beyond the range"):
        topk.top_k(df.unionByName(df.selectExpr("9L AS vec_id", "array(3e30f) AS embedding", "'x' AS score")), df).count()


def test_top_k_streams_rows_past_held_queries(spark, monkeypatch):
    """No side of a join, however small it looks to the planner, is sent whole to the driver; every cell's best are merged."""
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (700, 4)).astype(float) / 256
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for name, value in (("BLOCK", 50), ("QUERIES", 8), ("HELD", 400), ("STREAMED", 4000)):
        monkeypatch.setattr(topk, name, value)
    found = topk.top_k(df, df.where("vec_id % 10 = 0"), k=120)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    v = np.floor(x * 256).astype(int)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(got) == 70
    for q, rows in got.items():
        score = v @ v[q]
        assert rows == [(r, score[r]) for r in np.lexsort((np.arange(700), -score)) if r != q][:120]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 7))
def test_bounds_never_exclude_a_winner(seed, k):
    rng = np.random.default_rng(seed)
    block, queries = rng.integers(-9, 9, (300, 6)), rng.integers(-9, 9, (8, 6))
    own = rng.random((8, 300)) < 0.01
    pairs = {tuple(p) for p in topk.candidates(queries, block, own, k).tolist()}
    for q in range(8):
        score = np.where(own[q], -(10**9), block @ queries[q])
        assert all((q, r) in pairs for r in np.lexsort((np.arange(300), -score))[:k])


def examples_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_toxicity_on_held_out_rows_of_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs = textkit.read_table(spark, sf, "documents").select("doc_id", "lang")
    got = Q.op10_toxicity(spark, sf).where("held_out").join(textkit.read_table(spark, sf, "labels"), "doc_id").join(docs, "doc_id").toPandas()
    assert (got[got.toxic == 0].predicted == 0).mean() >= 0.98
    found = got[got.toxic == 1].groupby("lang").predicted.mean()
    assert set(found.index) == {"de", "en", "es", "fr"}
    assert (found >= 0.9).all(), found
    sure = got.score.lt(0.1) | got.score.ge(0.9)  # calibrated: sure scores are right, few rows are unsure
    assert sure.mean() > 0.95
    assert got[got.score < 0.1].toxic.mean() < 0.1
    assert got[got.score >= 0.9].toxic.mean() > 0.9


def test_toxicity_awkward(spark):
    model = toxicity.train(examples_of(spark, [(k, ("you idiot " if k % 2 else "kind word ") + PROSE, k % 2) for k in range(60)]))
    rows = toxicity.toxicity(awkward(spark).withColumn("evidence", F.lit(1)), model).toPandas()
    assert len(rows) == 12
    assert rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    assert (rows[rows.text.isna()].score < 0.5).all()
    assert rows[rows.doc_id == 6].score.nunique() == 1
    assert toxicity.toxicity(empty(spark), model).count() == 0
    nothing = toxicity.toxicity(awkward(spark), toxicity.train(examples_of(spark, []))).toPandas()
    assert len(nothing) == 12
    assert (nothing.score == 0).all()


def test_toxicity_with_mostly_toxic_labels(spark):
    examples = [(k, ("kind word " if k % 4 == 0 else "you idiot ") + PROSE, int(k % 4 > 0)) for k in range(80)]
    df = spark.createDataFrame([(1, "kind word " + PROSE), (2, "you idiot " + PROSE), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(df, toxicity.train(examples_of(spark, examples))).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_toxicity_searches_twelve_thousand_examples(spark):
    docs = spark.range(14000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), (F.col("id") % 9 == 0).cast("int").alias("toxic"))
    able = docs.where(~textkit.held_out("doc_id", 5, 0)).count()
    assert toxicity.labelled_texts(docs, docs, "toxic", 5, 0).count() == min(able, 12000) > 8000


def brute_cosines(examples, labels, corpus, text):
    """TF-IDF cosines with relevance, by dictionaries of terms."""
    import re
    from math import log, sqrt

    def bag(t):
        out = Counter()
        for w in re.findall(r"[a-z0-9\x80-\xff]+", lower(t).encode().decode("latin-1")):
            out[w] += 1
            if len(w) > 6:
                out["<" + w[:6]] += 1
        return out

    bags = [bag(t) for t in examples]
    df, held, toxic = Counter(), Counter(), Counter()
    for t in corpus:
        df.update(set(bag(t or "")))
    for b, y in zip(bags, labels, strict=True):
        held.update(set(b))
        toxic.update(set(b) if y else ())
    n, p = len(bags), sum(labels) / len(labels)
    factor = {}
    for t, k in held.items():
        z = max(toxic[t] - k * p, 0) / sqrt(max(k * p * (1 - p) * (1 - k / n), 1e-9)) if k < n else 0
        factor[t] = (log((1 + len(corpus)) / (1 + df[t])) + 1) * (1 + z)
    vector = lambda b: {t: c * factor[t] for t, c in b.items() if t in factor}
    size = lambda v: sqrt(sum(x * x for x in v.values())) or 1
    q = vector(bag(text or ""))
    return [sum(x * v.get(t, 0) for t, x in q.items()) / size(q) / size(v) for v in map(vector, bags)]


def test_toxicity_equals_dense_cosines(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    docs = docs_of(spark).where("text is not null").select("doc_id", "text").orderBy("doc_id").limit(90).collect()
    rows = [(r.doc_id, r.text, r.doc_id % 3 % 2) for r in docs[:70]]
    corpus = [r.text for r in docs[60:]]
    df = spark.createDataFrame(docs[60:])
    model = toxicity.train(examples_of(spark, rows))
    for r in toxicity.toxicity(df, model).collect():
        want = np.array(brute_cosines([x[1] for x in rows], [x[2] for x in rows], corpus, r.text))
        best = np.sort(want)[::-1][:15]
        got = [(e["doc_id"], e["similarity"]) for e in r.evidence]
        np.testing.assert_allclose([s for _, s in got], best[best > 5e-6][: len(got)], atol=2e-5)
        assert len(got) >= (best > 2e-5).sum()
        by_id = dict(zip([x[0] for x in rows], want, strict=True))
        np.testing.assert_allclose([s for _, s in got], [by_id[x] for x, _ in got], atol=2e-5)
        label = {x[0]: x[2] for x in rows}
        mass = sum(s for _, s in got)
        assert r.score == pytest.approx((sum(s * label[x] for x, s in got) + 0.1 * model["prior"]) / (mass + 0.1) if got else min(model["prior"], 0.499), abs=1e-4)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20))
def test_block_max_search_is_exact(seed, k):
    rng = np.random.default_rng(seed)
    dense = np.round(rng.random((700, 40)) * (rng.random((700, 40)) < rng.choice([0.01, 0.03, 0.3], 40)), 1).astype(np.float32)
    example, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(example.astype(np.int32), term.astype(np.int32), dense[example, term], 40, 700)
    asked = np.round(rng.random((5, 40)) * (rng.random((5, 40)) < 0.5), 1).astype(np.float32)
    text, t = np.nonzero(asked)
    for q, (name, value) in zip(asked, index.nearest(text, t, asked[text, t], 5, k), strict=True):
        score = np.round((dense @ q).astype(float), toxicity.DECIMALS)
        want = [x for x in np.lexsort((np.arange(700), -score))[:k] if score[x] > 0]
        assert name.tolist() == want
        np.testing.assert_allclose(value, score[want], atol=2e-5)


def test_a_first_block_is_read_by_its_own_terms(monkeypatch):
    """A product over all rows of a block is made for the texts that share it, in the second reading only; results don't depend on the group."""
    rng = np.random.default_rng(8)
    dense = (rng.random((700, 40)) * (rng.random((700, 40)) < 0.3)).astype(np.float32)
    dense[:256, :20], dense[256:, 20:] = dense[:256, :20] * 9, 0
    example, term = (x.astype(np.int32) for x in np.nonzero(dense))
    index = toxicity.BlockMaxIndex(example, term, dense[example, term], 40, 700)
    asked = (rng.random((9, 40)) * (rng.random((9, 40)) < 0.5)).astype(np.float32)
    text, t = np.nonzero(asked)
    whole = index.nearest(text, t, asked[text, t], 9, 3)
    assert index.posting.nbytes == 8 * index.begin[-1] and index.example is None  # a list is one array
    for q in range(9):
        t = np.flatnonzero(asked[q])
        ((name, value),) = index.nearest(np.zeros(len(t), np.int64), t, asked[q, t], 1, 3)
        score = dense @ asked[q]
        np.testing.assert_allclose(value, np.sort(score)[::-1][:3], atol=2e-5)
        np.testing.assert_allclose(value, whole[q][1], atol=2e-5)
        np.testing.assert_allclose(score[name], score[whole[q][0]], atol=2e-5)


def test_texts_beyond_one_slice_are_read_whole(spark):
    long = " ".join(f"{PROSE} {k}" for k in range(25000))
    assert len(long) > 2 * textkit.SLICE_BYTES
    df = spark.createDataFrame([(1, long, "s"), (2, PROSE, "t"), (3, long, "u")], "doc_id long, text string, source string")
    n = len(tokens(long))
    packed = packing.pack(df, mixing.tokens("text"), F.xxhash64("text"), 2048).where("doc_id = 1").agg(F.sum("n_tokens")).first()[0]
    assert packed == n
    assert {r["__mix"].copies for r in mixing.read_times(mixing.mixture(df), df).collect()} <= {0, 1, 2}
    rules = {r.doc_id: r for r in quality_rules.quality_rules(df, df.where("doc_id = 2").select("doc_id")).collect()}
    assert (rules[1].n_words, rules[1].log_ratio) == (n, rules[3].log_ratio)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, width=5).collect()}
    w = tokens(long)
    assert near[1] == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}), 1)
    assert near[3] == near[1]
    crf = quality_crf.quality_crf(df, quality_crf.train(["good line", "*** |||"], [1, 0])).collect()
    lang = language.identify_language(df, language.train([(1, "en", PROSE), (2, "de", "der die und das ist nicht")])).collect()
    tox = toxicity.toxicity(df, toxicity.train(examples_of(spark, [(k, ("you idiot " if k % 2 else "kind word ") + PROSE, k % 2) for k in range(20)]))).collect()
    for rows in (crf, lang, tox):  # equal texts are answered alike
        a, b = (next(r for r in rows if r.doc_id == k) for k in (1, 3))
        assert a.score == b.score
    model = {r.doc_id: r for r in context_tree.language_model(df.withColumn("t", F.lit(True)), "t").collect()}
    assert (model[1].n_tokens, model[1].score) == (n + 1, model[3].score)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = docs_of(spark)
    labels = textkit.read_table(spark, SF, "labels")
    kept = P.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in quality_rules.quality_rules(docs, quality_rules.trusted_documents(labels)).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == ids
    clean = P.toxic(spark, kept, SF)
    assert clean.columns == docs.columns
    one = P.near_duplicates(spark, clean, SF)
    want = {k for k, v in brute_near([(r.doc_id, r.text) for r in clean.collect()], 5, 0.8).items() if v[2]}
    assert {r.doc_id for r in one.collect()} == want
    assert P.mix(spark, one, SF).columns == docs.columns
    got = P.run(spark, SF)
    twice = clean.unionByName(clean).unionByName(clean.limit(3).withColumn("text", F.lit("another text " + PROSE)))
    again = P.near_duplicates(spark, twice, SF)
    assert again.columns == docs.columns
    ids_ = [r.doc_id for r in again.collect()]
    assert len(ids_) == len(set(ids_))
    for _, stage in P.STAGES:
        for df in (awkward(spark), empty(spark)):
            stage(spark, df, SF).count()
    assert got.count() > 0
    assert {r.doc_id for r in got.collect()} <= want
