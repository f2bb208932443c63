"""Judging that survives a lost job, keeps a provider's limit, and asks several pairs at once; likeness by a model."""

import json
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo import cli, schemas
from tremolo.operators import generate, runs
from tremolo.sources import judges, logs
from tremolo.streaming import batches


def pairs_at(tmp_path, n):
    (tmp_path / "factuality.jsonl").write_text("".join(json.dumps({"pair_id": f"p{k:03d}", "task_type": "factuality", "prompt_a": f"a{k}", "prompt_b": f"b{k}"}) + "\n" for k in range(n)))


def test_a_lost_job_keeps_its_answers_and_the_next_asks_the_rest(spark, tmp_path):
    pairs_at(tmp_path, 40)
    asked, broken, out = str(tmp_path / "asked"), tmp_path / "broken", str(tmp_path / "out")
    (tmp_path / "asked").mkdir()
    broken.touch()

    def make():
        import os
        import uuid

        def judge(prompt):
            if os.path.exists(str(broken)) and len(os.listdir(asked)) >= 36:
                raise SystemExit("the worker is gone")  # no error of a call: the task fails, and with it the job
            open(f"{asked}/{prompt}-{uuid.uuid4().hex}", "w").close()
            return "yes"

        return judge

    run = lambda: cli.evaluate(spark, ["gpt-4o"], ["factuality"], 1, str(tmp_path), out, make=lambda name: make, wait=0, paced=False, permits=1, batch_rows=8)
    with pytest.raises(Exception, match="(?i)worker|stage|failed|terminated"):
        run()
    kept = {r.pair_id for r in logs.records(spark, f"{out}/gpt-4o_factuality.jsonl", schemas.JUDGMENT).collect()}
    assert len(kept) == 16  # two whole batches; two pairs more stand in the journal
    broken.unlink()
    run()
    rows = logs.records(spark, f"{out}/gpt-4o_factuality.jsonl", schemas.JUDGMENT).collect()
    assert sorted(r.pair_id for r in rows) == [f"p{k:03d}" for k in range(40)]
    assert all((r.normalized_a, r.normalized_b, r.flipped, r.run, r.error) == ("YES", "YES", False, 1, None) and r.timestamp for r in rows)
    calls = Counter(p.name.split("-")[0] for p in (tmp_path / "asked").iterdir())
    assert calls == {f"{s}{k}": 1 for k in range(40) for s in "ab"}  # nothing is asked twice
    assert not (tmp_path / "out" / "_answers").exists() or not any((tmp_path / "out" / "_answers").iterdir())


def test_a_task_that_runs_again_asks_nothing_twice(spark, tmp_path):
    asked = str(tmp_path / "asked")
    (tmp_path / "asked").mkdir()

    def make():
        import uuid

        def judge(prompt):
            open(f"{asked}/{prompt}-{uuid.uuid4().hex}", "w").close()
            if prompt == "a3":
                raise RuntimeError("down")
            return f"yes {prompt}"

        return judge

    work = spark.range(8).select(F.col("id").cast("string").alias("pair_id"), F.lit("factuality").alias("task_type"), F.lit("m").alias("model"), F.lit(1).alias("run"), F.concat(F.lit("a"), "id").alias("prompt_a"), F.concat(F.lit("b"), "id").alias("prompt_b"))
    judged = runs.run_judge(work, make, wait=0, stamp=True, permits=2, at_once=3, journal=f"file://{tmp_path}/book")
    first, again = (sorted(map(str, judged.where("pair_id <> '3'").collect())) for _ in range(2))
    assert first == again
    calls = Counter(p.name.split("-")[0] for p in (tmp_path / "asked").iterdir())
    assert calls.pop("a3") == 4 and calls.pop("b3") == 2  # a failed pair is asked again
    assert set(calls.values()) == {1}
    (tmp_path / "book" / "0-torn.jsonl").write_text('{"pair_id": "9", "ru')
    saved = []
    assert runs.recover(spark, str(tmp_path / "book"), lambda rows, m, t, name: saved.append((m, t, sorted(r.pair_id for r in rows.collect())))) == 7
    assert saved == [("m", "factuality", ["0", "1", "2", "4", "5", "6", "7"])]
    assert runs.recover(spark, str(tmp_path / "book"), None) == 0


def test_batches_are_bounded_and_named_in_order(spark):
    seen = []
    n = batches.in_batches(spark.range(95).repartition(2), lambda df, name: seen.append((name, sorted(r.id for r in df.collect()))), 20)
    assert n == len(seen) >= 5
    assert [x[0] for x in seen] == sorted(x[0] for x in seen)
    assert all(len(ids) <= 20 for _, ids in seen)
    assert sorted(i for _, ids in seen for i in ids) == list(range(95))
    assert batches.in_batches(spark.range(0), lambda df, name: None, 20) == 0


def test_a_pace_parts_the_calls_of_all_threads():
    now, lock, begun = [0.0], threading.Lock(), []

    def sleep(s):
        with lock:
            now[0] = max(now[0], now[0] + s)

    pace = judges.Pace(0.5, lambda: now[0], sleep)
    ask = pace.judge(lambda p: begun.append(now[0]) or p)
    assert [ask(str(k)) for k in range(4)] == list("0123")
    assert begun == [0.0, 0.5, 1.0, 1.5]
    assert judges.Pace(0).judge(str.upper)("x") == "X"


@pytest.mark.parametrize("partitions", [1, 7])
def test_permits_keep_the_limit_at_any_number_of_partitions(spark, tmp_path, partitions):
    asked = str(tmp_path)

    def make():
        import time
        import uuid

        def judge(prompt):
            with open(f"{asked}/{uuid.uuid4().hex}", "w") as f:
                f.write(repr(time.time()))
            return "yes"

        return judge

    work = spark.range(24).repartition(partitions).select(F.concat(F.lit("p"), "id").alias("pair_id"), F.lit("factuality").alias("task_type"), F.lit("m").alias("model"), F.lit(1).alias("run"), F.lit("a").alias("prompt_a"), F.lit("b").alias("prompt_b"))
    judged = runs.run_judge(work, make, wait=0, pause=0.05, permits=3, at_once=2)
    assert judged.count() == 24
    assert judged.rdd.getNumPartitions() == 3
    for p in tmp_path.iterdir():
        p.unlink()
    judged.collect()
    times = np.sort([float(p.read_text()) for p in tmp_path.iterdir()])
    assert len(times) == 48
    most = max(np.searchsorted(times, t + 0.5) - k for k, t in enumerate(times))  # calls in any half second
    assert most <= 0.5 / 0.05 + 3 + 1


def test_judges_together_share_their_providers_limits(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    pairs_at(tmp_path, 12)

    def make_for(name):
        def make():
            import time
            import uuid

            def judge(prompt):
                with open(f"{asked}/{name}-{uuid.uuid4().hex}", "w") as f:
                    f.write(repr(time.time()))
                if name == "mistral-7b" and prompt == "a3":
                    raise RuntimeError("down")
                return "yes"

            return judge

        if name == "claude-haiku":
            raise RuntimeError("no key")
        return make

    models = ["gpt-4o", "gpt-4o-mini", "mistral-7b", "claude-haiku"]
    run = lambda: cli.evaluate(spark, models, ["factuality", "coherence"], 1, str(tmp_path), str(tmp_path / "out"), make=make_for, wait=0, paced=False, permits=2, batch_rows=100, together=True)
    run()
    for m in models[:3]:
        rows = logs.records(spark, f"{tmp_path}/out/{m}_factuality.jsonl", schemas.JUDGMENT).collect()
        assert sorted(r.pair_id for r in rows) == [f"p{k:03d}" for k in range(12)]
        assert {r.model for r in rows} == {m}
    assert not (tmp_path / "out" / "claude-haiku_factuality.jsonl").exists()
    before = Counter(p.name.rsplit("-", 1)[0] for p in asked.iterdir())
    assert before == {"gpt-4o": 24, "gpt-4o-mini": 24, "mistral-7b": 25}
    run()  # the failed pair alone is asked again
    assert Counter(p.name.rsplit("-", 1)[0] for p in asked.iterdir()) == before + Counter({"mistral-7b": 3})


def test_a_provider_has_one_limit_for_all_its_judges(spark, tmp_path):
    def make_for(name):
        def make():
            import time
            import uuid

            def judge(prompt):
                with open(f"{tmp_path}/{name}-{uuid.uuid4().hex}", "w") as f:
                    f.write(repr(time.time()))
                return "yes"

            return judge

        return make

    access = {"x": runs.Access(make_for("x"), "one", 0.05), "y": runs.Access(make_for("y"), "one", 0.05), "z": runs.Access(make_for("z"), "other", 0.02)}
    model = F.element_at(F.array(*[F.lit(m) for m in access]), (F.col("id") % 3 + 1).cast("int"))
    work = spark.range(45).select(F.col("id").cast("string").alias("pair_id"), F.lit("factuality").alias("task_type"), model.alias("model"), F.lit(1).alias("run"), F.lit("a").alias("prompt_a"), F.lit("b").alias("prompt_b"))
    judged = runs.run_judges(work, access, wait=0, permits=2)
    assert judged.rdd.getNumPartitions() == 4
    for p in tmp_path.iterdir():
        p.unlink()
    rows = judged.collect()
    assert len(rows) == 45
    read = lambda names: np.sort([float(p.read_text()) for p in tmp_path.iterdir() if p.name[0] in names])
    for names, pause, n in (("xy", 0.05, 60), ("z", 0.02, 30)):
        times = read(names)
        assert len(times) == n
        assert max(np.searchsorted(times, t + 0.5) - k for k, t in enumerate(times)) <= 0.5 / pause + 2 + 1
    with pytest.raises(Exception, match="no access"):
        runs.run_judges(work.withColumn("model", F.lit("nobody")), access, wait=0).collect()


def test_calls_in_flight_are_bounded_and_come_in_order():
    state, lock, most = [0], threading.Lock(), [0]

    def work(k):
        with lock:
            state[0] += 1
            most[0] = max(most[0], state[0])
        time.sleep(0.01 * (k % 3))
        with lock:
            state[0] -= 1
        return k * k

    assert list(judges.in_flight(range(40), work, 5)) == [k * k for k in range(40)]
    assert 2 <= most[0] <= 5
    with pytest.raises(ZeroDivisionError):
        list(judges.in_flight([1, 0, 2], lambda k: 1 / k, 2))


def test_retries_are_kept_with_calls_in_flight(spark):
    def make():
        seen = Counter()
        lock = threading.Lock()

        def judge(prompt):
            with lock:
                seen[prompt] += 1
                again = seen[prompt] > 1
            if prompt.endswith("3") or (prompt.endswith("5") and not again):
                raise RuntimeError("down")
            return "yes"

        return judge

    work = spark.range(20).coalesce(1).select(F.col("id").cast("string").alias("pair_id"), F.lit("factuality").alias("task_type"), F.lit("m").alias("model"), F.lit(1).alias("run"), F.concat(F.lit("a"), "id").alias("prompt_a"), F.lit("b").alias("prompt_b"))
    rows = runs.run_judge(work, make, wait=0, at_once=6).collect()
    assert [r.pair_id for r in rows] == [str(k) for k in range(20)]
    assert {r.pair_id for r in rows if r.error} == {"3", "13"}
    asked = runs.run_validation(work.select("pair_id", "task_type", "prompt_a", "prompt_b"), make, "{prompt_a}", wait=0, permits=2, at_once=3)
    assert {r.pair_id: r.validation_decision for r in asked.collect()} == {str(k): "ERROR" if k % 10 == 3 else "YES" for k in range(20)}


def encoder():
    loads.append(1)
    return lambda texts: np.array([[len(t), t.count("e"), 1.0] if t else [0.0, 0.0, 0.0] for t in texts])


loads: list = []


def test_likeness_by_a_model(spark):
    df = spark.createDataFrame([("abc", "abc"), ("see", "a"), (None, "x"), ("", "x")], "a string, b string").coalesce(1)
    got = [r.x for r in df.select(generate.likeness(encoder, F.col("a"), F.col("b")).alias("x")).collect()]
    u, v = np.array([3, 2, 1.0]), np.array([1, 0, 1.0])
    assert got == [1.0, round(float(u @ v / np.sqrt(u @ u) / np.sqrt(v @ v)), 4), None, None]
    assert {r.x for r in df.select(generate.likeness(None, F.col("a"), F.col("b")).alias("x")).collect()} == {1.0}
    scored = generate.generate_pairs(spark, make_encoder=encoder)
    assert scored.where("semantic_equivalence_score < 1").count() > 0
    assert scored.count() == 500 and generate.EQUIVALENT == 0.85  # the threshold leaves no pair out
    assert generate.generate_pairs(spark).where("semantic_equivalence_score <> 1").isEmpty()


def test_judged_responses_without_letters(spark):
    with_, without = (generate.generate_pairs(spark, lettered=x).where("task_type in ('relevance', 'preference')").select("pair_id", "prompt_a", "response_being_judged") for x in (True, False))
    both = with_.alias("x").join(without.alias("y"), "pair_id").collect()
    assert len(both) == 250
    for _, prompt_x, x, prompt_y, y in both:
        assert prompt_x == prompt_y
        left, right = x.split(" | ")
        assert y == f"{left.removeprefix('A: ')} | {right.removeprefix('B: ')}"
