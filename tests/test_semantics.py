"""Hand-computed cases and the study's traps."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremolo import cli, schemas
from tremolo.functions import decisions as D
from tremolo.functions import fixed
from tremolo.operators import agreement, generate, polarity, report, runs, validation
from tremolo.sources import judges, readers, sinks


def value(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("Yes.", "YES"), ("I do NOT know", "NO"), ("known", "NO"), ("eyes", "YES"), ("\n maybe", "UNCLEAR"), ("", "UNCLEAR")])
def test_yes_no(spark, raw, want):
    assert value(spark, D.yes_no(F.col("r")), r=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("**A**", "A"), ("_B_.", "B"), ("Answer: b", "B"), ("BA", "UNCLEAR"), ("éA", "UNCLEAR"), ("C or A?", "A")])
def test_a_or_b(spark, raw, want):
    assert value(spark, D.a_or_b(F.col("r")), r=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("10", "1"), ("0.5", "5"), ("score 4/5", "4"), ("none", "UNCLEAR")])
def test_one_to_five(spark, raw, want):
    assert value(spark, D.one_to_five(F.col("r")), r=raw) == want


def test_other_task_keeps_ten_characters(spark):
    assert value(spark, D.normalize(F.col("r"), F.lit("x")), r="\n abcdefghijkl") == "ABCDEFGHIJ"


def test_errors_and_flips(spark):
    rows = spark.createDataFrame([("ERROR: a", "yes"), ("yes", "ERROR: b"), ("yes", "no"), ("?", "!")], "prompt_a_raw string, prompt_b_raw string").withColumn("task_type", F.lit("factuality"))
    got = [(r.normalized_a, r.normalized_b, r.error, r.flipped) for r in runs.decided(rows).collect()]
    assert got == [("UNCLEAR", "YES", "ERROR: a", True), ("YES", "UNCLEAR", "ERROR: b", True), ("YES", "NO", None, True), ("UNCLEAR", "UNCLEAR", None, False)]


def test_null_equals_null(spark):
    rows = spark.createDataFrame([("g", None, None), ("g", "A", None)], "g string, a string, b string")
    assert agreement.jss(rows, ["g"]).first()["n_matches"] == 1


def test_inversion_makes_yes_of_anything_else(spark):
    assert [value(spark, D.invert(F.col("d")), d=x) for x in ("YES", "NO", "UNCLEAR")] == ["NO", "YES", "YES"]


def test_error_filters_differ(spark):
    rows = spark.createDataFrame([("",), (None,), ("x",)], "error string")
    assert rows.where(D.no_error(F.col("error"))).count() == 1
    assert rows.where(D.no_error_text(F.col("error"))).count() == 2


def test_template_identification(spark):
    for k, t in enumerate(fixed.FACTUALITY_TEMPLATES):
        assert value(spark, D.template_of(F.col("p")), p=t.replace("{r}", "x\n\nResponse: y")) == f"T{k + 1}"
    assert value(spark, D.template_of(F.col("p")), p=fixed.FACTUALITY_TEMPLATES[0].split("\n\n")[0]) == "T1"
    assert value(spark, D.template_of(F.col("p")), p="What?") == "UNKNOWN"


SCENARIOS = [
    (["YES", "YES", "YES", "YES", "YES", "YES", "NO", "NO", "NO", "NO"], ["YES", "YES", "YES", "YES", "YES", "NO", "YES", "NO", "NO", "NO"], 0.8, 0.583333),
    (["YES"] * 5, ["YES", "YES", "NO", "NO", "NO"], 0.4, 0.0), (["YES"] * 10, ["YES"] * 10, 1.0, 1.0), (["YES"] * 6, ["NO"] * 6, 0.0, 0.0),
]


@pytest.mark.parametrize(("a", "b", "jss", "kappa"), SCENARIOS)
def test_metric_scenarios(spark, a, b, jss, kappa):
    assert agreement.judge_sensitivity_score(spark, a, b) == pytest.approx(jss)
    assert agreement.decision_flip_rate(spark, a, b) == pytest.approx(1 - jss)
    assert agreement.cohens_kappa(spark, a, b) == pytest.approx(kappa, abs=1e-6)


def test_bad_inputs_raise(spark):
    with pytest.raises(ValueError, match="empty"):
        agreement.compute_jss(spark, [], [])
    with pytest.raises(ValueError, match="length"):
        agreement.compute_jss(spark, ["A"], [])


def plain_kappa(pairs):
    n = len(pairs)
    labels = {x for p in pairs for x in p}
    p_e = sum(sum(a == x for a, _ in pairs) * sum(b == x for _, b in pairs) for x in labels) / n**2
    p_o = sum(a == b for a, b in pairs) / n
    return 1.0 if abs(1 - p_e) < 1e-12 else (p_o - p_e) / (1 - p_e)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from("ABC")), min_size=2, max_size=30))
def test_kappa_property(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("g", F.lit("g"))
    assert agreement.kappa(rows, ["g"]).first()["cohens_kappa"] == pytest.approx(plain_kappa(pairs), abs=1e-9)


def test_bootstraps(spark):
    rows = [("g", k, "A", "A" if k % 10 else "B") for k in range(400)]
    df = spark.createDataFrame(rows, "g string, pair_id long, a string, b string")
    m, rng = np.array([r[2] == r[3] for r in rows], float), np.random.default_rng(42)
    means = [m[rng.integers(0, 400, size=400)].mean() for _ in range(1000)]
    exact = agreement.bootstrap_exact(df, ["g"], ["pair_id"]).first()
    assert (exact.ci_lower, exact.ci_upper) == tuple(np.percentile(means, [2.5, 97.5]))
    for other in (agreement.bootstrap_binomial(df, ["g"]).first(), agreement.bootstrap_limit(df, ["g"]).first(), agreement.bootstrap_hash(df, ["g"], ["pair_id"]).first()):
        assert other.ci_lower == pytest.approx(exact.ci_lower, abs=0.02)
        assert other.ci_upper == pytest.approx(exact.ci_upper, abs=0.02)


def test_bootstrap_of_any_metric(spark):
    rows = [("g", k, "A" if k % 3 else "B", "A" if k % 10 else "B") for k in range(200)]
    df = spark.createDataFrame(rows, "g string, pair_id long, a string, b string")
    rng = np.random.default_rng(42)
    found = [plain_kappa([rows[i][2:] for i in rng.integers(0, 200, size=200)]) for _ in range(50)]
    exact = agreement.bootstrap_exact(df, ["g"], ["pair_id"], 50, metric_fn=kappa_of).first()
    assert (exact.ci_lower, exact.ci_upper) == pytest.approx(tuple(np.percentile(found, [2.5, 97.5])), abs=1e-12)
    counts = agreement.bootstrap_cells(df, ["g"], kappa_of_counts).first()
    many = agreement.bootstrap_exact(df, ["g"], ["pair_id"], 400, metric_fn=kappa_of).first()
    assert (counts.ci_lower, counts.ci_upper) == pytest.approx((many.ci_lower, many.ci_upper), abs=0.06)


def kappa_of(a, b):
    return plain_kappa(list(zip(a, b, strict=True)))


def kappa_of_counts(a, b, n):
    return plain_kappa([(x, y) for x, y, k in zip(a, b, n, strict=True) for _ in range(k)])


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 60), st.integers(0, 60))
def test_binomial_quantiles(n, matches):
    matches = min(matches, n)
    p, reached, want = matches / n, 0.0, []
    for k in range(n + 1):
        reached += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        want += [k / n] * sum(reached >= t - 1e-12 for t in (0.025, 0.975)[len(want) :])
    assert agreement.binomial_quantiles(n, matches, 0.025) == tuple(want[:2])


def test_suite_rounds_ties_to_even_of_the_binary_value(spark):
    rows = [("m", "A", "A" if k < 25 else "B") for k in range(32)]
    r = agreement.metric_suite(spark.createDataFrame(rows, "model string, a string, b string"), ["model"]).first()
    assert (r.jss, r.flip_rate, r.n_pairs, r.n_flips) == (round(25 / 32, 4), round(7 / 32, 4), 32, 7)
    assert r.jss == 0.7812


def test_last_write_wins_and_raw_counts_differ(spark):
    rows = spark.createDataFrame([(1, 1, 1, "A", "A"), (1, 1, 2, "A", "B"), (2, 1, 1, "B", "B")], "pair_id long, run int, seq int, a string, b string")
    assert sorted((r.pair_id, r.b) for r in agreement.last_write(rows, ["pair_id", "run"], ["seq"]).collect()) == [(1, "B"), (2, "B")]


def test_macro_mean_is_unweighted_and_zero_is_missing(spark):
    pairs = spark.createDataFrame([("m", "T3-T4", 0.72, 75), ("m", "T4-T5", 42 / 57, 57), ("m", "T1-T2", 0.0, 10)], "model string, template_pair string, jss double, n long")
    r = polarity.macro_delta(pairs).first()
    assert r.jss_with_t4 == pytest.approx(0.7284)
    assert r.jss_no_t4 is None
    assert r.delta is None
    assert (r.n_no_t4, r.n_with_t4) == (10, 132)


def test_correction_turns_the_inverted_template_round(spark):
    rows = spark.createDataFrame([(1, 1, "m", "T3", "T4", "YES", "NO"), (2, 1, "m", "T1", "T2", "YES", "YES")], "pair_id long, run int, model string, ta string, tb string, a string, b string")
    r = polarity.corrected_jss(rows).first()
    assert (r.jss_fixed, r.jss_original, r.delta, r.n) == (1.0, 0.5, 0.5, 2)
    audit = polarity.inverted_audit(rows).first()
    assert (audit.n, audit.raw_disagreement, audit.inverted_agreement) == (1, 1.0, 1.0)


def test_overlap_lists_in_the_order_of_the_dimension(spark):
    rows = spark.createDataFrame([("p", "x", "T3", "T4", "YES", "NO"), ("p", "a", "T3", "T4", "YES", "NO"), ("p", "z", "T3", "T4", "NO", "NO")], "pair_id string, model string, ta string, tb string, a string, b string")
    order = spark.createDataFrame([("x", 0), ("a", 1), ("z", 2)], "model string, ord int")
    r = polarity.flip_overlap(rows, order).first()
    assert (r.flip_count, r.flipping_models, r.has_t4) == (2, "x,a", True)


def test_generated_pairs(spark):
    pairs = generate.generate_pairs(spark).cache()
    assert pairs.count() == 500
    assert pairs.schema.names == schemas.PROMPT_PAIR.names
    fact = pairs.where("task_type = 'factuality'").withColumns({"ta": D.template_of(F.col("prompt_a")), "tb": D.template_of(F.col("prompt_b"))})
    assert {(r.ta, r.tb) for r in fact.limit(125).select("ta", "tb").distinct().collect()} == {("T1", "T2"), ("T3", "T4"), ("T5", "T1"), ("T2", "T3"), ("T4", "T5")}
    assert fact.where(D.has_inverted(F.col("ta"), F.col("tb"))).count() == 50
    assert fact.where(D.not_excluded(F.col("pair_id"))).count() == 119
    first = fact.groupBy("response_being_judged").count().collect()
    assert sorted(r["count"] for r in first) == [12] * 5 + [13] * 5


def test_readers_and_sinks(spark, tmp_path):
    good = {"pair_id": "p", "task_type": "t", "manual_label": "YES"}
    (tmp_path / "t_manual.jsonl").write_text(json.dumps(good) + "\n\n{bad\n" + json.dumps(good | {"pair_id": "q"}) + "\n")
    read = lambda **how: readers.jsonl(spark, str(tmp_path / "t_manual.jsonl"), schemas.MANUAL_VALIDATION, **how)
    assert read().where(F.col(readers.CORRUPT).isNotNull()).cache().count() == 1
    assert read(bad="drop").count() == 2
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        read(bad="fail").collect()
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), schemas.MANUAL_VALIDATION, missing_ok=True).count() == 0
    keyed = readers.with_file_key(read(bad="drop"), "_manual.jsonl")
    assert {r.file_key for r in keyed.collect()} == {"t"}
    (tmp_path / "one.json").write_text(json.dumps([good], indent=1))
    assert readers.json_by_suffix(spark, str(tmp_path / "one.json"), schemas.MANUAL_VALIDATION).count() == 1
    out = str(tmp_path / "log")
    sinks.append_jsonl(read(bad="drop"), out)
    sinks.append_jsonl(read(bad="drop"), out)
    assert readers.jsonl(spark, out, schemas.MANUAL_VALIDATION, bad="fail").count() == 4
    sinks.overwrite_jsonl(read(bad="drop").limit(1), out)
    assert readers.jsonl(spark, out, schemas.MANUAL_VALIDATION, bad="fail").count() == 1
    sinks.csv(read(bad="drop"), str(tmp_path / "csv"))
    assert readers.csv(spark, str(tmp_path / "csv"), schemas.MANUAL_VALIDATION).count() == 2
    sinks.by_task(generate.generate_pairs(spark), str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).where("task_type = 'coherence'").count() == 125


def test_summary_of_a_folder_of_logs(spark, tmp_path):
    logs = tmp_path / "raw"
    logs.mkdir()
    rows = [{"pair_id": f"fact_{k:03d}", "task_type": "factuality", "model": "m", "run": 1, "normalized_a": "YES", "normalized_b": "YES" if k % 4 else "NO", "timestamp": str(k)} for k in range(1, 41)]
    rows += [rows[0] | {"error": ""}, rows[1] | {"normalized_a": "UNCLEAR"}, rows[2] | {"model": "lonely"}]
    (logs / "m_factuality.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    got = cli.summarize(spark, str(logs), str(tmp_path / "out" / "s.json"))
    assert set(got) == {"m"}
    assert (got["m"]["factuality"]["n_pairs"], got["m"]["factuality"]["n_flips"]) == (39, 9)
    assert json.loads((tmp_path / "out" / "s.json").read_text()) == got


def test_judge_is_asked_twice(spark):
    asked, waits = [], []

    def judge(p):
        asked.append(p)
        if len(asked) == 1:
            raise RuntimeError("busy")
        return "YES"

    assert runs.call(judge, "q", 5, waits.append) == "YES"
    assert waits == [5]
    assert runs.call(lambda p: 1 / 0, "q", 5, waits.append) == "ERROR:division by zero"


def test_pending_asks_repeated_work_once(spark):
    work = spark.createDataFrame([("p", 1), ("p", 1), ("q", 1), ("r", 1)], "pair_id string, run int")
    log = spark.createDataFrame([("q", 1, None), ("r", 1, "ERROR: x"), (None, 1, None)], "pair_id string, run int, error string")
    assert sorted(r.pair_id for r in runs.pending(work, log, ["pair_id", "run"], D.no_error(F.col("error"))).collect()) == ["p", "r"]


def test_migration_is_idempotent(spark):
    old = [("p", "factuality", "m", None, None, None, None, None, None, None, None, None, None, "Yes", "ERROR: x", 3)]
    log = spark.createDataFrame(old, schemas.LEGACY_JUDGMENT)
    once = runs.migrate(log)
    r = once.first()
    assert (r.run, r.normalized_a, r.normalized_b, r.flipped, r.error, r.changed) == (3, "YES", "UNCLEAR", True, "ERROR: x", True)
    assert not runs.migrate(once.drop("changed")).first().changed


def test_agreement_of_labels(spark):
    manual = spark.createDataFrame([("p", "t", "UNSURE"), ("q", "t", "YES"), ("r", "u", "YES")], "pair_id string, task_type string, manual_label string")
    auto = spark.createDataFrame([("p", " no"), ("q", "true"), ("r", "UNCLEAR")], "pair_id string, validation_decision string")
    got = {r.task_type: (r.compared, r.agree, r.agreement) for r in validation.manual_agreement(manual, auto).collect()}
    assert got == {"t": (2, 2, 100.0), "u": (0, 0, 0.0)}


def test_cosine(spark):
    r = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>").select(D.cosine(F.col("a"), F.col("b")).alias("x")).collect()
    assert r[0].x == round(1 / math.sqrt(2), 4)
    assert r[1].x is None


def test_rounding_is_of_the_binary_value(spark):
    values = [0.5075, 0.5025, -0.0625, 0.0005, 0.12345, 1.0, 2.0625, -78.0125, 1234.5675, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(D.python_round(F.col("v"), 3).alias("x"))
    assert [r.x for r in df.collect()] == [round(v, 3) for v in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (None,)], "v double").select(D.python_round(F.col("v"), 3).alias("x")).collect()
    assert math.isnan(odd[0].x)
    assert [r.x for r in odd[1:]] == [float("inf"), 1e300, None]


@pytest.mark.parametrize("blank", ["\u00a0", "\u3000", "\x1c", "\x85", "\u2003"])
def test_all_white_space_is_stripped(spark, blank):
    raw = f"{blank}hello world{blank}"
    assert value(spark, D.normalize(F.col("r"), F.lit("x")), r=raw) == raw.strip().upper()[:10]


def test_templates_join_from_the_pair_dimension(spark):
    pairs = spark.createDataFrame([("p", "T3", "T4"), ("q", "T1", "T2"), ("r", "T4", "T5")], "pair_id string, ta string, tb string")
    log = spark.createDataFrame([("p", "m", 1, "YES", "NO"), ("x", "m", 1, "YES", "NO"), ("q", "m", 1, "NO", "NO")], "pair_id string, model string, run int, a string, b string")
    assert {(r.pair_id, r.ta, r.tb) for r in polarity.with_templates(log, pairs).collect()} == {("p", "T3", "T4"), ("x", "UNKNOWN", "UNKNOWN"), ("q", "T1", "T2")}
    known = polarity.with_templates(log, pairs, known_only=True)
    assert known.count() == 2
    overlap = polarity.flip_overlap(known, pairs=pairs)
    assert sorted(tuple(r) for r in overlap.collect()) == [("p", True, 1, "m"), ("q", False, 0, ""), ("r", True, 0, "")]
    r = polarity.overlap_extremes(overlap, n_models=1).first()
    assert (r.n_all, r.n_none, r.n_any, r.most) == (1, 2, 1, 1)


def test_study_has_119_pairs_and_all_of_them_are_listed(spark):
    pairs = generate.generate_pairs(spark).where("task_type = 'factuality'").where(D.not_excluded(F.col("pair_id")))
    pairs = pairs.select("pair_id", D.template_of(F.col("prompt_a")).alias("ta"), D.template_of(F.col("prompt_b")).alias("tb"))
    log = spark.createDataFrame([("fact_004", "m", "YES", "NO")], "pair_id string, model string, a string, b string")
    rows = polarity.flip_overlap(polarity.with_templates(log, pairs), pairs=pairs).collect()
    assert (len(rows), sum(r.flip_count for r in rows)) == (119, 1)
    assert pairs.where("ta = 'UNKNOWN' or tb = 'UNKNOWN'").isEmpty()


def test_defined_orders(spark):
    rows = [(k, 1, m, "T1", t, "YES", "YES" if (k + j) % 3 else "NO") for k in range(9) for j, (m, t) in enumerate([("x", "T2"), ("y", "T2"), ("x", "T3")])]
    df = spark.createDataFrame(rows, "pair_id long, run int, model string, ta string, tb string, a string, b string")
    got = [(r.template_pair, -r.jss, r.model) for r in polarity.ordered_pair_jss(df).collect()]
    assert got == sorted(got)
    scores = spark.createDataFrame([("u", 0.9), ("v", 0.5)], "model string, jss double")
    ends = spark.createDataFrame([("u", 0.8, 1.0), ("v", 0.4, 0.6)], "model string, ci_lower double, ci_upper double")
    assert [r.model for r in report.bars(scores, ends, ["model"]).collect()] == ["v", "u"]
    auto = spark.createDataFrame([("q", "t", "NO"), ("p", "t", "NO"), ("r", "t", "YES")], "pair_id string, task_type string, validation_decision string")
    assert [r.pair_id for r in validation.flagged(auto).collect()] == ["p", "q"]


def test_malformed_lines_are_reported_by_number(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"pair_id": "p"}\n\n{bad\n{"pair_id": "q"}\n')
    rows, bad = readers.jsonl_in_order(spark, str(tmp_path), schemas.JUDGMENT)
    assert [(r.pair_id, r.file, r.line) for r in rows.orderBy("line").collect()] == [("p", "a.jsonl", 1), ("q", "a.jsonl", 4)]
    with pytest.warns(UserWarning, match="line 3 in a.jsonl"):
        assert readers.warn_malformed(bad) == ["skipping malformed line 3 in a.jsonl"]
    assert readers.columns_of(rows)[:2] == ["error", "file"]


def test_logs_by_file_name(spark, tmp_path):
    (tmp_path / "m_coherence.jsonl").write_text('{"pair_id": "p", "model": "m"}\n')
    assert readers.judgments_by_file(spark, str(tmp_path), schemas.JUDGMENT, "m", "coherence").count() == 1
    assert readers.judgments_by_file(spark, str(tmp_path), schemas.JUDGMENT, "m", "relevance").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.judgments_by_file(spark, str(tmp_path), schemas.JUDGMENT, "m", "relevance", missing_ok=False)


def test_environment_files(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# A=1\n B = x=y \nnone\nC=3\n")
    monkeypatch.setenv("C", "kept")
    monkeypatch.delenv("B", raising=False)
    import os

    assert readers.load_env(str(tmp_path / ".env")) == {"B": "x=y", "C": "3"}
    assert (os.environ["B"], os.environ["C"]) == ("x=y", "kept")
    readers.load_env(str(tmp_path / ".env"), override=True)
    assert os.environ["C"] == "3"
    assert readers.load_env(str(tmp_path / "none")) == {}


def test_a_later_file_replaces_a_judge_and_task(spark, tmp_path):
    line = lambda k, b: json.dumps({"pair_id": f"p{k}", "task_type": "coherence", "model": "m", "run": 1, "normalized_a": "1", "normalized_b": b, "error": None})
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.jsonl").write_text("\n".join(line(k, "1") for k in range(5)))
    (tmp_path / "raw" / "b.jsonl").write_text("\n".join(line(k, "1" if k else "2") for k in range(4)))
    for exact in (True, False):
        got = cli.summarize(spark, str(tmp_path / "raw"), str(tmp_path / "s.json"), exact)["m"]["coherence"]
        assert (got["n_pairs"], got["n_flips"], got["jss"]) == (4, 1, 0.75)


def test_intervals_follow_the_order_of_lines(spark, tmp_path, capsys):
    rows = [{"pair_id": f"p{k:03d}", "task_type": "coherence", "model": "m", "run": 1, "normalized_a": "1", "normalized_b": "1" if k % 3 else "2"} for k in range(40)][::-1]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = cli.summarize(spark, str(tmp_path / "raw"), str(tmp_path / "s.json"))["m"]["coherence"]
    m, rng = np.array([r["normalized_a"] == r["normalized_b"] for r in rows], float), np.random.default_rng(42)
    ends = np.percentile([m[rng.integers(0, 40, size=40)].mean() for _ in range(1000)], [2.5, 97.5])
    assert (got["ci_lower"], got["ci_upper"]) == tuple(round(float(x), 4) for x in ends)
    assert f"[{ends[0]:.3f},{ends[1]:.3f}]" in capsys.readouterr().out


def test_evaluation_appends_and_resumes(spark, tmp_path, capsys):
    pairs = [{"pair_id": f"p{k}", "task_type": "factuality", "prompt_a": f"a{k}", "prompt_b": f"b{k}"} for k in range(7)]
    (tmp_path / "factuality.jsonl").write_text("\n".join(map(json.dumps, pairs)))
    make = lambda name: answering if name != "gpt-4o" else judges.maker(name)
    run = lambda **how: cli.evaluate(spark, ["gpt-4o-mini"], ["factuality", "coherence"], 2, str(tmp_path), str(tmp_path / "out"), make=make, wait=0, paced=False, **how)
    first = run(dry_run=True)
    log = lambda: readers.jsonl(spark, str(tmp_path / "out" / "gpt-4o-mini_factuality.jsonl"), schemas.JUDGMENT, bad="fail")
    assert log().count() == 10
    assert first == pytest.approx(8 * (50 + 20) * 2 / 1000 * 0.00015)  # p3 fails in both runs
    run()
    rows = log().collect()
    assert len(rows) == 10 + 2 * 2 + 2  # two pairs more in each run, and the failed pair again
    assert {r.error for r in rows if r.pair_id == "p3"} == {"ERROR:down"}
    assert all(r.prompt_a_decision == r.normalized_a and r.timestamp.endswith("+00:00") for r in rows)
    assert "no pairs at" in capsys.readouterr().out


def answering():
    def judge(prompt):
        if prompt == "a3":
            raise RuntimeError("down")
        return " yes " if prompt[0] == "a" else "NO"

    return judge


def test_judges_of_the_registry(monkeypatch):
    assert judges.token_argument("GPT-5.5") == judges.token_argument("o3-mini") == "max_completion_tokens"
    assert judges.token_argument("gpt-4o") == "max_tokens"
    assert "temperature" not in judges.chat_arguments("gpt-5.5", "p", 9)
    assert judges.chat_arguments("gpt-4o", "p", 9)["temperature"] == 0.0
    assert judges.spec("openai").name == "gpt-4o-mini"
    assert judges.spec("gemini-flash").pause == 1.0
    with pytest.raises(ValueError, match="unknown judge"):
        judges.spec("nobody")
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(RuntimeError, match="OPENAI_API_KEY"):
        judges.maker("gpt-4o")
    waits = []
    assert judges.stripped(lambda p: f" {p}\n", 0.5, waits.append)("x") == "x"
    with pytest.raises(ZeroDivisionError):
        judges.stripped(lambda p: 1 / 0, 0.5, waits.append)("x")
    assert waits == [0.5, 0.5]


def test_judge_asks_its_client(monkeypatch):
    from types import SimpleNamespace as N

    seen = {}

    class Client:
        def __init__(self, **how):
            seen["client"] = how
            self.chat = N(completions=N(create=lambda **a: seen.update(call=a) or N(choices=[N(message=N(content=" B "))])))

    monkeypatch.setitem(__import__("sys").modules, "openai", N(OpenAI=Client))
    monkeypatch.setenv("NOVITA_API_KEY", "k")
    assert judges.maker("deepseek", paced=False)()("q") == "B"
    assert seen["client"] == {"api_key": "k", "base_url": fixed.NOVITA_URL}
    assert (seen["call"]["max_tokens"], seen["call"]["messages"][1]) == (1024, {"role": "user", "content": "q"})


def test_validation_answers(spark):
    waits = []
    assert runs.validate(lambda p: "well, yes", "q", 3, waits.append) == ("YES", "WELL, YES", None)
    assert runs.validate(lambda p: 1 / 0, "q", 3, waits.append) == ("ERROR", "", "division by zero")
    assert waits == [3]
    pairs = spark.createDataFrame([("p", None, "a", "b")], "pair_id string, task_type string, prompt_a string, prompt_b string")
    r = runs.run_validation(pairs, lambda: lambda p: "no: " + p, "{prompt_a}|{prompt_b}").first()
    assert (r.task_type, r.validation_decision, r.raw_response, r.error) == ("unknown", "NO", "NO: A|B", None)


def test_prompt_pairs_as_json_lines(spark, tmp_path):
    cli.main(["generate", str(tmp_path)])
    read = lambda name: readers.jsonl(spark, str(tmp_path / f"{name}.jsonl"), schemas.PROMPT_PAIR, bad="fail")
    assert [read(t).count() for t in (*cli.TASKS, "combined")] == [125, 125, 125, 125, 500]


def test_interval_text(spark):
    r = spark.createDataFrame([(0.1235, 0.5), (None, None)], "lo double, hi double").select(report.interval_text(F.col("lo"), F.col("hi")).alias("t")).collect()
    assert [x.t for x in r] == [f"[{0.1235:.3f},0.500]", "N/A"]


def test_report_rows(spark):
    corrected = spark.createDataFrame([("a", 0.9, 0.5, 0.4, 3), ("b", 0.9, 0.6, 0.3, 3)], "model string, jss_fixed double, jss_original double, delta double, n long")
    assert [r.name for r in report.paper_rows(corrected).orderBy("place").collect()] == ["b", "a"]
    assert report.paper_rows(corrected).where("name = 'a'").first().line == "a                      & 0.500 & 0.900 & +0.400 \\\\"


def test_stream_and_table_agree(spark, tmp_path):
    from tremolo.streaming import scores

    rows = spark.createDataFrame([("m", "A", "A", None), ("m", "A", "B", None), ("m", "A", "A", "x")], "model string, a string, b string, error string")
    rows.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
    got = scores.finish(scores.running_jss(stream, ["model"]), "running", str(tmp_path / "cp")).collect()
    assert got == scores.running_jss(rows, ["model"]).collect()
