"""Forms that hold as groups and logs grow: kappa over many labels, intervals in many tasks, last rows of a stream."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.operators import agreement, drawing, polarity
from tremolo.streaming import latest


def test_kappa_of_a_million_different_pairs(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1).cast("string").alias("b"))
    began = time.time()
    r = agreement.kappa(rows, ["g"]).first()
    assert time.time() - began < 120
    chance = (500_000 * 2 - 1) / 1e12  # even labels but 0 stand twice among the second, odd ones never, and 10^6 has no first
    assert r.n_pairs == 1_000_000 and r.p_o == 0.5
    assert r.p_e == pytest.approx(chance, rel=1e-9)


@pytest.mark.parametrize("keys", [["g"], ["g", "h"], []])
def test_kappa_counts_null_labels_and_groups(spark, keys):
    rows = [(None, 1, None, None), (None, 1, "A", None), (1, 1, "A", "A"), (1, 2, "B", "A"), (1, 2, "A", "B")]
    got = agreement.kappa(spark.createDataFrame(rows, "g int, h int, a string, b string"), keys).collect()
    assert sum(r.n_pairs for r in got) == 5
    for r in got:
        own = [x for x in rows if all(x["gh".index(k)] == r[k] for k in keys)]
        assert r.n_matches == sum(x[2] == x[3] for x in own)
        labels = {x for y in own for x in y[2:]}
        assert r.p_e == pytest.approx(sum(sum(y[2] == x for y in own) * sum(y[3] == x for y in own) for x in labels) / len(own) ** 2)


@pytest.mark.parametrize("n", [2, 3, 16, 1000, 65537, 3_000_000_000])
def test_the_stream_can_be_entered_anywhere(n):
    rng = np.random.default_rng(42)
    want = np.concatenate([rng.integers(0, n, size=4001) for _ in range(3)])
    whole = np.concatenate(list(drawing.used(42, n, 0, 20000)))[: len(want)]
    assert (whole == want).all()
    parts = np.concatenate([x for at in range(0, 20000, 777) for x in drawing.used(42, n, at, min(at + 777, 20000))])[: len(want)]
    assert (parts == want).all()
    assert sum(len(x) for b, e in drawing.stretches(n, len(want)) for x in drawing.used(42, n, b, e)) >= len(want)


def test_parallel_intervals_equal_one_generator(spark, monkeypatch):
    monkeypatch.setattr(drawing, "STRETCH", 4000)
    monkeypatch.setattr(drawing, "BLOCK", 300)
    assert len(drawing.stretches(1500, 1500 * 60)) > 20
    rows = [(g, k, "A", "A" if (k * 7 + k // 5) % (g + 2) else "B") for g, n in enumerate((40, 333, 1, 1500)) for k in range(n)]
    rows += [(None, k, "A", "B") for k in range(20)] + [(9, k, None, None) for k in range(5)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, k int, a string, b string").repartition(5)
    read = lambda: {r.g: (r.ci_lower, r.ci_upper) for r in agreement.bootstrap_exact(df, ["g"], ["k"], 60).collect()}
    got = read()
    monkeypatch.setattr(drawing, "STRETCH", 1 << 24)
    assert read() == got  # a group a task
    assert len(got) == 6
    tail = 100 * (1 - 0.95) / 2  # not quite 2.5, as published
    for g in got:
        m, rng = np.array([x[2] == x[3] for x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])], float), np.random.default_rng(42)
        assert got[g] == tuple(np.percentile([m[rng.integers(0, len(m), size=len(m))].mean() for _ in range(60)], [tail, 100 - tail]))


SCHEMA = "k int, seq int, v string"


def test_the_stream_of_last_rows_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(30), rng.choice([None, *range(50)]), rng.choice([None, "x", "y", "z"])) for _ in range(400)]
    journal, check = str(tmp_path / "journal"), str(tmp_path / "check")
    read = lambda: latest.current(spark, journal, schema, ["k"], ["seq"])
    schema = spark.createDataFrame([], SCHEMA).schema
    assert read().count() == 0
    (tmp_path / "log").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    for part in range(4):  # late rows come in any part
        spark.createDataFrame(rows[part::4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        assert latest.follow(stream, ["k"], ["seq"], journal, check) >= 1
        some = [r for p in range(part + 1) for r in rows[p::4]]
        want = agreement.last_write(spark.createDataFrame(some, SCHEMA), ["k"], ["seq"]).collect()
        assert sorted(map(str, read().collect())) == sorted(map(str, want))
        assert sorted(map(str, latest.latest(spark.createDataFrame(some, SCHEMA), ["k"], ["seq"]).collect())) == sorted(map(str, want))
        if part == 2:
            assert latest.compact(spark, journal, schema, ["k"], ["seq"]) == 2
            assert sorted(map(str, read().collect())) == sorted(map(str, want))
    assert latest.compact(spark, journal, schema, ["k"], ["seq"]) == 2
    assert sorted(map(str, read().collect())) == sorted(map(str, want))


def test_a_broken_fold_changes_nothing(spark, tmp_path):
    journal, schema = str(tmp_path / "journal"), spark.createDataFrame([], SCHEMA).schema
    for b in range(3):
        spark.createDataFrame([(1, b, "x"), (b + 5, b, "y")], SCHEMA).write.parquet(f"{journal}/batch={b:012d}")
    before = sorted(map(str, latest.current(spark, journal, schema, ["k"], ["seq"]).collect()))
    spark.createDataFrame([(1, 1, "x")], SCHEMA).write.parquet(f"{journal}/batch=-00000000001")  # moved in, the folded ones not yet deleted
    spark.createDataFrame([(77, 1, "x")], SCHEMA).write.parquet(f"{journal}/_fold")
    assert sorted(map(str, latest.current(spark, journal, schema, ["k"], ["seq"]).collect())) == before


def test_a_repeated_pair_counts_as_its_last_row(spark):
    pairs = spark.createDataFrame([("p", "T1", "T2", 1), ("p", "T3", "T4", 9), ("p", "T5", "T1", 4)], "pair_id string, ta string, tb string, line int")
    log = spark.createDataFrame([("p", "YES", "NO")], "pair_id string, a string, b string")
    r = polarity.with_templates(log, pairs, sequence=["line"]).first()
    assert (r.ta, r.tb) == ("T3", "T4")
    assert polarity.with_templates(log, pairs).first().ta == "T5"


def test_parts_of_a_written_log_have_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(latest, "FILE_ROWS", 100)
    rows = spark.range(3000).select("id", (F.col("id") % 700).alias("k"))
    at = str(tmp_path / "log")
    assert latest.write_log(rows, at, ["k"], 4) == 8
    sizes = [r["count"] for r in spark.read.parquet(at).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300  # a part has 750
    assert latest.write_log(rows.limit(0), str(tmp_path / "none"), ["k"], 4) == 1


def test_digest_intervals_join_no_draws(spark, monkeypatch):
    """Draws meet their rows in packed bits; a group larger than a word, or than the draws listed at a time, has the same interval as by brute force."""
    monkeypatch.setattr(agreement, "DRAWN", 50)
    monkeypatch.setattr(agreement, "SHARES", 7)
    rng = random.Random(5)
    rows = [(g, k, "A", rng.choice("AB")) for g, n in (("x", 1), ("y", 64), ("z", 201)) for k in range(n)]
    df = spark.createDataFrame([*rows, (None, 0, "A", "B")], "g string, k int, a string, b string")
    found = agreement.bootstrap_hash(df, ["g"], ["k"], 40)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: (r.ci_lower, r.ci_upper) for r in found.collect()}
    assert set(got) == {"x", "y", "z"}
    for g, interval in got.items():
        m = [a == b for of, _, a, b in rows if of == g]
        means = [np.mean([m[int(hashlib.md5(f"{r}-{k}".encode()).hexdigest()[:8], 16) % len(m)] for k in range(len(m))]) for r in range(1, 41)]
        assert interval == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-12)
