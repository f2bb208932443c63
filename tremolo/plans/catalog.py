"""All queries of the package with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from tremolo import schemas
from tremolo.functions import decisions as D
from tremolo.functions import fixed
from tremolo.operators import agreement, generate, polarity, report, runs, validation
from tremolo.plans import bindings as B
from tremolo.sources import logs, readers, shared, sinks
from tremolo.streaming import latest, scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GROUP = ["model", "task_type"]
_six = lambda c: F.round(c, 6).alias(c)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = B.judgments(spark, sf_dir)
    return j.where(D.not_excluded(F.col("pair_id"), B.EXCLUDED) & D.no_error(F.col("error")) & D.clear(F.col("a"), F.col("b")))


_USABLE = B.JUDGMENTS + ", u AS (SELECT * FROM j WHERE pair_id NOT IN (40, 45, 50, 90, 95, 100) AND error IS NULL AND a <> 'UNCLEAR' AND b <> 'UNCLEAR')"
_SCORES = """count(*) AS n_pairs, count(*) FILTER (a = b) AS n_matches, count(*) FILTER (a <> b) AS n_flips,
  round(avg((a = b)::INT::DOUBLE), 6) AS jss, round(1 - avg((a = b)::INT::DOUBLE), 6) AS flip_rate"""


@query(f"WITH {_USABLE} SELECT model, task_type, {_SCORES} FROM u GROUP BY ALL HAVING count(*) >= 2")
def jss_by_group(spark, sf_dir):
    return agreement.jss(_usable(spark, sf_dir), GROUP).select(*GROUP, "n_pairs", "n_matches", "n_flips", _six("jss"), _six("flip_rate"))


_KAPPA = """c AS (SELECT {k}, a, b, count(*)::DOUBLE AS n FROM {t} GROUP BY ALL),
  ra AS (SELECT {k}, a AS label, sum(n) AS n FROM c GROUP BY ALL), rb AS (SELECT {k}, b AS label, sum(n) AS n FROM c GROUP BY ALL),
  ch AS (SELECT {k}, sum(ra.n * rb.n) AS both_n FROM ra JOIN rb USING ({k}, label) GROUP BY ALL),
  s AS (SELECT {k}, sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS agree FROM c GROUP BY ALL),
  kp AS (SELECT {k}, n::BIGINT AS n_pairs, agree / n AS p_o, coalesce(both_n, 0) / (n * n) AS p_e FROM s LEFT JOIN ch USING ({k})),
  kk AS (SELECT *, CASE WHEN abs(1 - p_e) < 1e-12 THEN 1.0 ELSE (p_o - p_e) / (1 - p_e) END AS kappa FROM kp)"""


@query(f"WITH {_USABLE}, {_KAPPA.format(k='model, task_type', t='u')} SELECT model, task_type, n_pairs, round(p_o, 6) AS p_o, round(p_e, 6) AS p_e, round(kappa, 6) AS cohens_kappa FROM kk")
def kappa_by_group(spark, sf_dir):
    return agreement.kappa(_usable(spark, sf_dir), GROUP).select(*GROUP, "n_pairs", _six("p_o"), _six("p_e"), _six("cohens_kappa"))


_TIDY = f"replace(upper(trim(text, '{D.SPACE}')), 'ẞ', 'SS')"


def _normal(name: str, task: str, sql: str) -> None:
    def run(spark, sf_dir):
        d = B.table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
        c = B.table(spark, sf_dir, "conversations").select(F.lit("c"), "conv_id", "turn", "text")
        rows = d.union(c)
        return rows.select("kind", "id", "turn", D.normalize(F.col("text"), F.lit(task)).alias("decision"))

    run.__name__ = name
    query(f"""WITH r AS (SELECT 'd' AS kind, doc_id AS id, 0::BIGINT AS turn, text FROM documents UNION ALL SELECT 'c', conv_id, turn, text FROM conversations),
      x AS (SELECT kind, id, turn, {_TIDY} AS u FROM r) SELECT kind, id, turn, {sql} AS decision FROM x""")(run)


_normal("normalize_factuality", "factuality", "CASE WHEN contains(u, 'YES') THEN 'YES' WHEN contains(u, 'NO') THEN 'NO' ELSE 'UNCLEAR' END")
_normal("normalize_pairwise", "relevance", r"coalesce(nullif(regexp_extract(regexp_replace(u, '[*_]+', '', 'g'), '(^|[^\p{L}\p{N}_])([AB])($|[^\p{L}\p{N}_])', 2), ''), 'UNCLEAR')")
_normal("normalize_coherence", "coherence", "coalesce(nullif(regexp_extract(u, '[1-5]'), ''), 'UNCLEAR')")
_normal("normalize_other", "other", "substring(u, 1, 10)")

_RAW = B.JUDGMENTS + """, r AS (SELECT pair_id, run, model, task_type, CASE WHEN l_quantity = 50 THEN 'ERROR: timeout' WHEN a = 'O' THEN ' Yes, it is' WHEN a = 'F' THEN 'no.' ELSE 'perhaps' END AS raw_a,
  CASE WHEN l_quantity = 49 THEN 'ERROR: refused' WHEN b = 'O' THEN '**YES**' ELSE 'NO' END AS raw_b FROM j),
  n AS (SELECT *, CASE WHEN starts_with(raw_a, 'ERROR:') THEN 'UNCLEAR' WHEN contains(upper(raw_a), 'YES') THEN 'YES' WHEN contains(upper(raw_a), 'NO') THEN 'NO' ELSE 'UNCLEAR' END AS na,
  CASE WHEN starts_with(raw_b, 'ERROR:') THEN 'UNCLEAR' WHEN contains(upper(raw_b), 'YES') THEN 'YES' ELSE 'NO' END AS nb,
  CASE WHEN starts_with(raw_a, 'ERROR:') THEN raw_a WHEN starts_with(raw_b, 'ERROR:') THEN raw_b END AS error FROM r)"""


def _raw(spark, sf_dir):
    j = B.judgments(spark, sf_dir)
    a = F.when(F.col("l_quantity") == 50, "ERROR: timeout").when(F.col("a") == "O", " Yes, it is").when(F.col("a") == "F", "no.").otherwise("perhaps")
    b = F.when(F.col("l_quantity") == 49, "ERROR: refused").when(F.col("b") == "O", "**YES**").otherwise("NO")
    return j.select("pair_id", "run", "model", F.lit("factuality").alias("task_type"), a.alias("prompt_a_raw"), b.alias("prompt_b_raw"), *B.SEQUENCE)


@query(f"WITH {_RAW} SELECT model, na AS normalized_a, nb AS normalized_b, error, na <> nb AS flipped, count(*) AS n FROM n GROUP BY ALL")
def flip_flag_error(spark, sf_dir):
    return runs.decided(_raw(spark, sf_dir)).groupBy("model", "normalized_a", "normalized_b", "error", "flipped").agg(F.count("*").alias("n"))


@query(f"WITH {B.JUDGMENTS}, f AS (SELECT model, coalesce(nullif(CASE run WHEN 1 THEN '' WHEN 2 THEN NULL ELSE a END, ''), nullif(CASE run WHEN 2 THEN '' ELSE b END, ''), '') AS a, b FROM j) SELECT model, a, b, a = b AS matches, count(*) AS n FROM f GROUP BY ALL")
def falsy_coalesce(spark, sf_dir):
    j = B.judgments(spark, sf_dir)
    normalized = F.when(F.col("run") == 1, "").when(F.col("run") == 2, None).otherwise(F.col("a"))
    a = D.first_filled(normalized, F.when(F.col("run") == 2, "").otherwise(F.col("b")))
    return j.select("model", a.alias("a"), "b").groupBy("model", "a", "b", D.same(F.col("a"), F.col("b")).alias("matches")).agg(F.count("*").alias("n"))


@query(f"""WITH {B.JUDGMENTS} SELECT model, count(*) AS n, count(*) FILTER (error IS NULL) AS strict_ok, count(*) FILTER (coalesce(error, '') = '') AS loose_ok,
  count(*) FILTER (coalesce(a, '') <> '' AND coalesce(b, '') <> '') AS filled FROM j WHERE pair_id NOT IN (40, 45, 50, 90, 95, 100) GROUP BY model""")
def excluded_anti_join(spark, sf_dir):
    out = readers.dimension(spark, [(x,) for x in B.EXCLUDED], "pair_id long")
    j = B.judgments(spark, sf_dir).join(F.broadcast(out), "pair_id", "left_anti")
    return j.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(D.no_error(F.col("error"))).alias("strict_ok"), F.count_if(D.no_error_text(F.col("error"))).alias("loose_ok"), F.count_if(D.filled(F.col("a"), F.col("b"))).alias("filled"),
    )


@query(f"WITH {B.JUDGMENTS}, d AS (SELECT DISTINCT pair_id, run FROM j WHERE error IS NULL) SELECT o_orderkey AS pair_id, run::INTEGER AS run FROM orders, unnest([1, 2, 3]) AS x(run) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.pair_id = o_orderkey AND d.run = x.run)")
def resume_anti_join(spark, sf_dir):
    work = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run"))
    return runs.pending(work, B.judgments(spark, sf_dir), ["pair_id", "run"], D.no_error(F.col("error")))


@query(f"WITH {B.VALIDATIONS} SELECT doc_id AS pair_id, 'automatic' AS log FROM documents WHERE doc_id NOT IN (SELECT pair_id FROM v WHERE validation_decision IN ('YES', 'NO')) UNION ALL SELECT doc_id, 'manual' FROM documents WHERE doc_id NOT IN (SELECT pair_id FROM m)")
def validation_resume(spark, sf_dir):
    manual, auto = B.validations(spark, sf_dir)
    work = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"))
    one = runs.pending(work, auto, ["pair_id"], F.col("validation_decision").isin("YES", "NO")).withColumn("log", F.lit("automatic"))
    return one.unionByName(runs.pending(work, manual, ["pair_id"], F.lit(True)).withColumn("log", F.lit("manual")))


_LAST = "w AS (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY pair_id, run ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) = 1)"


@query(f"WITH {B.JUDGMENTS}, {_LAST.format(t='j')} SELECT pair_id, run, a, b, l_partkey FROM w")
def dedup_last_write(spark, sf_dir):
    return agreement.last_write(B.judgments(spark, sf_dir), ["pair_id", "run"], B.SEQUENCE).select("pair_id", "run", "a", "b", "l_partkey")


@query(f"""WITH {_USABLE}, {_LAST.format(t='u')}, x AS (SELECT model, count(*) AS n_raw, round(avg((a = b)::INT::DOUBLE), 6) AS jss_raw FROM u GROUP BY model),
  y AS (SELECT model, count(*) AS n_dedup, round(avg((a = b)::INT::DOUBLE), 6) AS jss_dedup FROM w GROUP BY model) SELECT * FROM x JOIN y USING (model)""")
def jss_dedup_vs_raw(spark, sf_dir):
    u = _usable(spark, sf_dir)
    raw = agreement.jss(u, ["model"], 1).select("model", F.col("n_pairs").alias("n_raw"), F.round("jss", 6).alias("jss_raw"))
    one = agreement.jss(agreement.last_write(u, ["pair_id", "run"], B.SEQUENCE), ["model"], 1)
    return raw.join(one.select("model", F.col("n_pairs").alias("n_dedup"), F.round("jss", 6).alias("jss_dedup")), "model")


def _values(rows: list[tuple]) -> str:
    put = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(put, r)) + ")" for r in rows)


_ITEMS = [("factuality", k, r, "", "", r, la) for k, (r, la) in enumerate(fixed.FACTUALITY_ITEMS)]
_ITEMS += [("coherence", k, s, "", "", s, f"score_{k + 1}") for k, s in enumerate(fixed.COHERENCE_ITEMS)]
_ITEMS += [(t, k, q, x, y, f"A: {x} | B: {y}", "A") for t, ss in (("relevance", fixed.RELEVANCE_ITEMS), ("preference", fixed.PREFERENCE_ITEMS)) for k, (q, x, y) in enumerate(ss)]
_TEMPLATES = [(t, k, x) for t, ts in (("factuality", fixed.FACTUALITY_TEMPLATES), ("coherence", fixed.COHERENCE_TEMPLATES), ("relevance", fixed.RELEVANCE_TEMPLATES), ("preference", fixed.PREFERENCE_TEMPLATES)) for k, x in enumerate(ts)]
_FILL = "replace(replace(replace(replace(replace({0}, '{{r}}', q), '{{s}}', q), '{{q}}', q), '{{ra}}', ra), '{{rb}}', rb)"
_PAIRS = f"""items(task_type, item, q, ra, rb, judged, label) AS (VALUES {_values(_ITEMS)}), tm(task_type, t, template) AS (VALUES {_values(_TEMPLATES)}),
  ta(task_type, prefix, source_benchmark) AS (VALUES {_values(fixed.TASKS)}),
  sl AS (SELECT *, CASE WHEN task_type <> 'factuality' THEN pid // 25 WHEN pid < 65 THEN pid // 13 ELSE 5 + (pid - 65) // 12 END AS item FROM ta, range(125) AS r(pid)),
  pp AS (SELECT prefix || '_' || lpad((pid + 1)::VARCHAR, 3, '0') AS pair_id, sl.task_type, source_benchmark, {_FILL.format('x.template')} AS prompt_a, {_FILL.format('y.template')} AS prompt_b,
    judged AS response_being_judged, label AS ground_truth_label, 1.0::DOUBLE AS semantic_equivalence_score
    FROM sl JOIN items USING (task_type, item) JOIN tm x ON x.task_type = sl.task_type AND x.t = (pid * 2) % 5 JOIN tm y ON y.task_type = sl.task_type AND y.t = (pid * 2 + 1) % 5)"""


@query(f"WITH {_PAIRS} SELECT * FROM pp")
def generate_pairs(spark, sf_dir):
    return generate.generate_pairs(spark)


@query(f"WITH {_PAIRS} SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY pair_id) <= 5")
def dry_run_limit(spark, sf_dir):
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("task_type").orderBy("pair_id"))  # 125 rows a task
    return generate.generate_pairs(spark).withColumn("n", first).where("n <= 5").drop("n")


@query(f"WITH tm(task_type, t, template) AS (VALUES {_values(_TEMPLATES)}) SELECT item_id, 'T' || (t + 1)::VARCHAR AS template, 'T' || (t + 1)::VARCHAR AS found FROM benchmark, tm WHERE task_type = 'factuality' UNION ALL SELECT item_id, 'none', 'UNKNOWN' FROM benchmark")
def identify_template(spark, sf_dir):
    items = B.table(spark, sf_dir, "benchmark").where("text is not null")
    prompts = F.array(*[F.struct(F.lit(f"T{k + 1}").alias("template"), F.replace(F.lit(t), F.lit("{r}"), F.col("text")).alias("prompt")) for k, t in enumerate(fixed.FACTUALITY_TEMPLATES)], F.struct(F.lit("none").alias("template"), F.col("text").alias("prompt")))
    return items.select("item_id", F.explode(prompts).alias("p")).select("item_id", "p.template", D.template_of(F.col("p.prompt")).alias("found"))


@query(f"WITH {B.BY_TEMPLATE} SELECT template_pair, count(DISTINCT pair_id) AS n_pairs, count(*) AS n_rows FROM t GROUP BY 1")
def template_pair_histogram(spark, sf_dir):
    return B.by_template(spark, sf_dir).groupBy(D.template_pair(F.col("ta"), F.col("tb")).alias("template_pair")).agg(F.countDistinct("pair_id").alias("n_pairs"), F.count("*").alias("n_rows"))


_four = lambda x: D.sql_round(x, 4)
_CORRECTED = f"""cu AS (SELECT model, avg((fa = fb)::INT::DOUBLE) AS x, avg((a = b)::INT::DOUBLE) AS y, count(*) AS n FROM t GROUP BY model),
  cj AS (SELECT model, {_four('x')} AS jss_fixed, {_four('y')} AS jss_original, {_four('(x - y)')} AS delta, n FROM cu)"""


@query(f"WITH {B.BY_TEMPLATE}, {_CORRECTED} SELECT * FROM cj")
def polarity_corrected_jss(spark, sf_dir):
    return polarity.corrected_jss(B.by_template(spark, sf_dir))


_PAIR_JSS = "pj AS (SELECT model, template_pair, avg((fa = fb)::INT::DOUBLE) AS jss, count(*) AS n FROM t WHERE run IN (1, 2, 3) GROUP BY ALL)"


@query(f"WITH {B.BY_TEMPLATE}, {_PAIR_JSS} SELECT model, template_pair, round(jss, 6) AS jss, n FROM pj")
def template_pair_jss(spark, sf_dir):
    return polarity.pair_jss(B.by_template(spark, sf_dir)).select("model", "template_pair", _six("jss"), "n")


@query(f"""WITH {B.BY_TEMPLATE}, {_PAIR_JSS}, g AS (SELECT model, nullif(avg(jss) FILTER (NOT contains(template_pair, 'T4')), 0) AS x, nullif(avg(jss) FILTER (contains(template_pair, 'T4')), 0) AS y,
  coalesce(sum(n) FILTER (NOT contains(template_pair, 'T4')), 0)::BIGINT AS n_no_t4, coalesce(sum(n) FILTER (contains(template_pair, 'T4')), 0)::BIGINT AS n_with_t4 FROM pj GROUP BY model)
  SELECT model, {_four('x')} AS jss_no_t4, {_four('y')} AS jss_with_t4, {_four('(x - y)')} AS delta, n_no_t4, n_with_t4 FROM g""")
def t4_macro_delta(spark, sf_dir):
    return polarity.macro_delta(polarity.pair_jss(B.by_template(spark, sf_dir)))


@query(f"""WITH {B.BY_TEMPLATE} SELECT count(*) AS n, round(avg((a <> b)::INT::DOUBLE), 6) AS raw_disagreement, round(avg((a = b)::INT::DOUBLE), 6) AS raw_agreement,
  round(avg((a = CASE WHEN b = 'YES' THEN 'NO' ELSE 'YES' END)::INT::DOUBLE), 6) AS inverted_agreement FROM t WHERE template_pair = 'T3-T4' AND run IN (1, 2, 3)""")
def t3t4_audit(spark, sf_dir):
    return polarity.inverted_audit(B.by_template(spark, sf_dir))


_OVERLAP = """pm AS (SELECT pair_id, model, bool_or(a <> b) AS flips, bool_or(ta = 'T4' OR tb = 'T4') AS has_t4 FROM t GROUP BY ALL),
  ov AS (SELECT pair_id, bool_or(has_t4) AS has_t4, count(*) FILTER (flips) AS flip_count, coalesce(string_agg(model, ',' ORDER BY model) FILTER (flips), '') AS flipping_models FROM pm GROUP BY pair_id)"""


@query(f"WITH {B.BY_TEMPLATE}, {_OVERLAP} SELECT * FROM ov")
def pair_flip_overlap(spark, sf_dir):
    return polarity.flip_overlap(B.by_template(spark, sf_dir))


@query(f"WITH {B.BY_TEMPLATE}, {_OVERLAP} SELECT has_t4, round(avg(flip_count), 6) AS mean_flips, count(*) AS n FROM ov GROUP BY has_t4")
def flip_mean_by_t4(spark, sf_dir):
    return polarity.flip_overlap(B.by_template(spark, sf_dir)).groupBy("has_t4").agg(F.round(F.avg("flip_count"), 6).alias("mean_flips"), F.count("*").alias("n"))


@query(f"""WITH {B.BY_TEMPLATE}, {_OVERLAP}, x AS (SELECT count(*) FILTER (flip_count = (SELECT count(DISTINCT model) FROM t)) AS n_all, count(*) FILTER (flip_count = 0) AS n_none, count(*) FILTER (flip_count >= 1) AS n_any, max(flip_count) AS most,
  round(avg(flip_count) FILTER (has_t4), 6) AS t4_mean, round(avg(flip_count) FILTER (NOT has_t4), 6) AS other_mean FROM ov)
  SELECT *, CASE WHEN t4_mean >= 8 AND other_mean <= 1 THEN 'YES' ELSE 'NO' END AS verdict FROM x""")
def flip_extremes(spark, sf_dir):
    return polarity.overlap_extremes(polarity.flip_overlap(B.by_template(spark, sf_dir)), n_models=5)


_PAIR_DIMENSION = """pd AS (SELECT o_orderkey AS pair_id, 'T' || ((o_orderkey * 2) % 5 + 1)::VARCHAR AS ta, 'T' || ((o_orderkey * 2 + 1) % 5 + 1)::VARCHAR AS tb
  FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (40, 45, 50, 90, 95, 100))"""


def _pair_dimension(spark, sf_dir):
    """The orders that are done, as pairs with their templates."""
    o = B.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("pair_id"))
    return o.where(D.not_excluded(F.col("pair_id"), B.EXCLUDED)).withColumns({"ta": D.cycle_template(F.col("pair_id"), False), "tb": D.cycle_template(F.col("pair_id"), True)})


@query(f"WITH {B.JUDGMENTS}, {_PAIR_DIMENSION} SELECT coalesce(ta, 'UNKNOWN') AS ta, coalesce(tb, 'UNKNOWN') AS tb, count(*) AS n, count(*) FILTER (error IS NULL) AS n_ok FROM j LEFT JOIN pd USING (pair_id) GROUP BY 1, 2")
def template_join(spark, sf_dir):
    """Judgments by the templates of their pair; pairs that the dimension lacks are UNKNOWN."""
    joined = polarity.with_templates(B.judgments(spark, sf_dir), _pair_dimension(spark, sf_dir))
    return joined.groupBy("ta", "tb").agg(F.count("*").alias("n"), F.count_if(D.no_error(F.col("error"))).alias("n_ok"))


@query(f"WITH {B.JUDGMENTS}, {_PAIR_DIMENSION} SELECT ta, tb, count(*) AS n, count(*) FILTER (a = b) AS n_matches FROM j JOIN pd USING (pair_id) GROUP BY 1, 2")
def template_inner_join(spark, sf_dir):
    """Judgments of known pairs by template."""
    joined = polarity.with_templates(B.judgments(spark, sf_dir), _pair_dimension(spark, sf_dir), known_only=True)
    return joined.groupBy("ta", "tb").agg(F.count("*").alias("n"), F.count_if(D.same(F.col("a"), F.col("b"))).alias("n_matches"))


@query(f"""WITH {B.BY_TEMPLATE}, {_OVERLAP}, {_PAIR_DIMENSION} SELECT pd.pair_id, pd.ta = 'T4' OR pd.tb = 'T4' AS has_t4, coalesce(flip_count, 0) AS flip_count, coalesce(flipping_models, '') AS flipping_models
  FROM pd LEFT JOIN ov USING (pair_id)""")
def pair_dimension_overlap(spark, sf_dir):
    """Flips of every pair of the dimension; pairs without usable judgments count none."""
    return polarity.flip_overlap(B.by_template(spark, sf_dir), pairs=_pair_dimension(spark, sf_dir))


@query(f"WITH {B.BY_TEMPLATE}, {_OVERLAP}, h AS (SELECT * FROM ov ORDER BY flip_count DESC, pair_id LIMIT 10) SELECT count(*) FILTER (has_t4) AS t4_in_top, count(*) AS n_top, CASE WHEN count(*) FILTER (has_t4) >= 6 THEN 'YES' ELSE 'NO' END AS verdict FROM h")
def top10_concentration(spark, sf_dir):
    return polarity.overlap_verdict(polarity.flip_overlap(B.by_template(spark, sf_dir)))


_BOOT = """rk AS (SELECT task_type, (a = b)::INT::DOUBLE AS m, row_number() OVER (PARTITION BY task_type ORDER BY pair_id) - 1 AS rn, count(*) OVER (PARTITION BY task_type) AS n FROM j2),
  dr AS (SELECT task_type, r, ('0x' || substr(md5(r::VARCHAR || '-' || rn::VARCHAR), 1, 8))::BIGINT % n AS at FROM rk, range(1, 1001) AS x(r)),
  me AS (SELECT dr.task_type, r, avg(m) AS mean FROM dr JOIN rk ON rk.task_type = dr.task_type AND rk.rn = dr.at GROUP BY ALL),
  ci AS (SELECT task_type, quantile_cont(mean, 0.025) AS ci_lower, quantile_cont(mean, 0.975) AS ci_upper FROM me GROUP BY task_type)"""


def _boot(spark, sf_dir):
    rows = B.labelled(spark, sf_dir)
    return rows, agreement.bootstrap_hash(rows, ["task_type"], ["pair_id"])


@query(f"WITH {B.LABELLED}, {_BOOT} SELECT task_type, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper FROM ci")
def bootstrap_ci_hash(spark, sf_dir):
    return _boot(spark, sf_dir)[1].select("task_type", _six("ci_lower"), _six("ci_upper"))


@query()
def bootstrap_ci_exact(spark, sf_dir):
    return agreement.bootstrap_exact(B.labelled(spark, sf_dir), ["task_type"], ["pair_id"])


_LIMIT = """g AS (SELECT {k}, count(*) AS n, count(*) FILTER (a = b) AS m FROM {t} GROUP BY ALL),
  pk AS (SELECT *, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(m / n) + (n - k) * ln(1 - m / n)) AS p FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM g WHERE m > 0 AND m < n)),
  ck AS (SELECT *, sum(p) OVER (PARTITION BY {k} ORDER BY pk.k) AS reached FROM pk),
  li AS (SELECT {k}, min(ck.k) FILTER (reached >= 0.025 - 1e-12) / any_value(n) AS ci_lower, min(ck.k) FILTER (reached >= 0.975 - 1e-12) / any_value(n) AS ci_upper FROM ck GROUP BY {k}
    UNION ALL SELECT {k}, m / n, m / n FROM g WHERE m = 0 OR m = n)"""


@query(f"WITH {_USABLE}, {_LIMIT.format(k='model, task_type', t='u')} SELECT model, task_type, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper FROM li")
def bootstrap_ci_limit(spark, sf_dir):
    return agreement.bootstrap_limit(_usable(spark, sf_dir), GROUP).select(*GROUP, _six("ci_lower"), _six("ci_upper"))


@query(f"""WITH {B.LABELLED}, {_LIMIT.format(k='task_type', t='j2')}, {_KAPPA.format(k='task_type', t='j2')}, sc AS (SELECT task_type, count(*) AS n_pairs, count(*) FILTER (a <> b) AS n_flips, count(*) FILTER (a = b) / count(*) AS jss FROM j2 GROUP BY 1 HAVING count(*) >= 2)
  SELECT task_type, {_four('jss')} AS jss, {_four('(1 - jss)')} AS flip_rate, {_four('kappa')} AS cohens_kappa, {_four('ci_lower')} AS ci_lower, {_four('ci_upper')} AS ci_upper, sc.n_pairs, n_flips FROM sc JOIN kk USING (task_type) JOIN li USING (task_type)""")
def metric_suite(spark, sf_dir):
    return agreement.metric_suite(B.labelled(spark, sf_dir), ["task_type"])


@query(f"""WITH {B.VALIDATIONS} SELECT coalesce(task_type, 'ALL') AS task_type, count(*) AS n, count(*) FILTER (validation_decision = 'YES') AS n_yes, count(*) FILTER (validation_decision = 'NO') AS n_no,
  round(100.0 * count(*) FILTER (validation_decision = 'YES') / count(*), 6) AS yes_pct FROM v WHERE validation_decision IN ('YES', 'NO') GROUP BY ROLLUP (v.task_type)""")
def validation_summary(spark, sf_dir):
    return validation.automatic_summary(B.validations(spark, sf_dir)[1])


@query(f"WITH {B.VALIDATIONS} SELECT task_type, count(*) FILTER (validation_decision = 'YES') AS yes, count(*) FILTER (validation_decision = 'NO') AS no, count(*) FILTER (validation_decision NOT IN ('YES', 'NO')) AS err FROM v GROUP BY 1")
def validation_counters(spark, sf_dir):
    return validation.run_counters(B.validations(spark, sf_dir)[1])


@query(f"WITH {B.VALIDATIONS} SELECT pair_id, task_type FROM v WHERE validation_decision = 'NO'")
def flagged_pairs(spark, sf_dir):
    return validation.flagged(B.validations(spark, sf_dir)[1])


@query(f"WITH {B.VALIDATIONS} SELECT coalesce(task_type, 'TOTAL') AS task_type, count(*) FILTER (manual_label = 'YES') AS yes, count(*) FILTER (manual_label = 'NO') AS no, count(*) FILTER (manual_label = 'UNSURE') AS unsure FROM m GROUP BY ROLLUP (m.task_type)")
def manual_counts(spark, sf_dir):
    return validation.manual_counts(B.validations(spark, sf_dir)[0])


@query(f"""WITH {B.VALIDATIONS}, x AS (SELECT m.task_type, CASE manual_label WHEN 'UNSURE' THEN 'NO' ELSE manual_label END AS h, v.validation_decision AS d FROM m LEFT JOIN v ON m.pair_id = v.pair_id AND v.validation_decision IN ('YES', 'NO'))
  SELECT task_type, count(d) AS compared, count(*) FILTER (d = h) AS agree, round(coalesce(100.0 * count(*) FILTER (d = h) / nullif(count(d), 0), 0), 6) AS agreement FROM x GROUP BY 1""")
def manual_agreement(spark, sf_dir):
    return validation.manual_agreement(*B.validations(spark, sf_dir))


@query(f"WITH {B.JUDGMENTS} SELECT count(*) AS n_rows, count(DISTINCT pair_id) AS n_pairs, count(DISTINCT run) AS n_runs, count(DISTINCT pair_id) * count(DISTINCT run) AS expected FROM j")
def log_profile(spark, sf_dir):
    return runs.log_profile(B.judgments(spark, sf_dir))


@query(f"WITH {B.JUDGMENTS} SELECT coalesce(model, 'ALL') AS model, count(*) AS n_rows FROM j GROUP BY ROLLUP (j.model)")
def rows_per_model(spark, sf_dir):
    return runs.rows_per_model(B.judgments(spark, sf_dir))


_PRICES = [("1-URGENT", 20, 0.00015), ("2-HIGH", 1024, 0.005), ("3-MEDIUM", 20, 0.0025)]


@query(f"WITH {B.JUDGMENTS}, p(model, max_tokens, cost) AS (VALUES {', '.join(f'({m!r}, {t}, {c}::DOUBLE)' for m, t, c in _PRICES)}), s AS (SELECT model, count(*) AS n_rows, count(*) FILTER (error IS NULL) AS n_ok FROM j GROUP BY 1) SELECT model, n_rows, n_ok, round(n_ok * (50 + coalesce(max_tokens, 20)) * 2 / 1000.0::DOUBLE * coalesce(cost, 0), 6) AS cost FROM s LEFT JOIN p USING (model)")
def run_cost(spark, sf_dir):
    return runs.run_cost(B.judgments(spark, sf_dir), readers.dimension(spark, _PRICES, "model string, max_tokens int, cost_per_1k double"))


@query(f"""WITH {_RAW}, g AS (SELECT *, run % 2 = 0 AS old, run = 1 AS right_before FROM n)
  SELECT model, count(*) AS n_rows, count(*) FILTER (old OR NOT right_before) AS n_changed, count(*) FILTER (na <> nb) AS n_flipped FROM g GROUP BY model""")
def backfill_changes(spark, sf_dir):
    """Even runs stand in the old form; of the others only the first runs were decided before."""
    new = runs.decided(_raw(spark, sf_dir))
    old, done = F.col("run") % 2 == 0, F.col("run") == 1
    log = new.select(
        "pair_id", "task_type", "model", F.when(~old, F.col("run")).alias("run"), *[F.when(~old, F.col(f"prompt_{s}_raw")).alias(f"prompt_{s}_raw") for s in "ab"],
        *[F.when(done, F.col(f"normalized_{s}")).alias(f"normalized_{s}") for s in "ab"], F.when(done, F.col("flipped")).alias("flipped"), F.when(done, F.col("error")).alias("error"),
        *[F.when(old, F.col(f"prompt_{s}_raw")).alias(f"prompt_{s}_decision_raw") for s in "ab"], F.when(old, F.col("run")).alias("run_number"),
    )
    return runs.migrate(log).groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if("changed").alias("n_changed"), F.count_if("flipped").alias("n_flipped"))


@query("""WITH p AS (SELECT x.vec_id // 2 AS pair, list_transform(x.embedding, lambda v: v::DOUBLE) AS u, list_transform(y.embedding, lambda v: v::DOUBLE) AS w FROM embeddings x JOIN embeddings y ON x.vec_id % 2 = 0 AND y.vec_id = x.vec_id + 1)
  SELECT pair, """ + D.sql_round("(list_inner_product(u, w) / (sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(w, w))))", 4) + " AS similarity FROM p")
def cosine_pairs(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    first = e.where("vec_id % 2 = 0").select(F.floor(F.col("vec_id") / 2).alias("pair"), F.col("embedding").alias("u"))
    second = e.where("vec_id % 2 = 1").select(F.floor(F.col("vec_id") / 2).alias("pair"), F.col("embedding").alias("w"))
    return first.join(second, "pair").select("pair", D.cosine(F.col("u"), F.col("w")).alias("similarity"))


_MODELS = [("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("4-NOT SPECIFIED",), ("5-LOW",), ("6-ABSENT",)]
_MV = "mo(model) AS (VALUES " + ", ".join(f"('{m[0]}')" for m in _MODELS) + ")"
_TASK_JSS = "tj AS (SELECT model, task_type, avg((a = b)::INT::DOUBLE) AS jss FROM j WHERE error IS NULL GROUP BY ALL)"


@query(f"WITH {B.JUDGMENTS}, {_MV}, {_TASK_JSS} SELECT mo.model, " + ", ".join(f"round(max(jss) FILTER (task_type = '{t}'), 6) AS jss_{t.lower()}" for t in "ANR") + " FROM mo LEFT JOIN tj USING (model) GROUP BY mo.model")
def heatmap_pivot(spark, sf_dir):
    return report.heatmap(report.task_jss(B.judgments(spark, sf_dir)), ["A", "N", "R"], readers.dimension(spark, _MODELS, "model string"))


@query(f"WITH {B.LABELLED}, {_LIMIT.format(k='task_type', t='j2')}, sc AS (SELECT task_type, avg((a = b)::INT::DOUBLE) AS jss FROM j2 GROUP BY 1) SELECT task_type, round(jss, 6) AS jss, round(jss - ci_lower, 6) AS err_lo, round(ci_upper - jss, 6) AS err_hi, CASE WHEN jss > 0.9 THEN 'high' WHEN jss >= 0.65 THEN 'mid' ELSE 'low' END AS band FROM sc JOIN li USING (task_type)")
def bar_feed(spark, sf_dir):
    rows = B.labelled(spark, sf_dir)
    return report.bars(agreement.jss(rows, ["task_type"], 1), agreement.bootstrap_limit(rows, ["task_type"]), ["task_type"])


_NAMES = [("1-URGENT", "Urgent"), ("5-LOW", "Low")]
_three = lambda x: D.sql_round(x, 3)


@query(f"WITH {B.BY_TEMPLATE}, {_CORRECTED}, nm(model, name) AS (VALUES {', '.join(map(str, _NAMES))}), cn AS (SELECT cj.*, coalesce(name, model) AS name FROM cj LEFT JOIN nm USING (model)) SELECT row_number() OVER (ORDER BY jss_fixed DESC, jss_original DESC, name)::INTEGER AS place, name, printf('%-22s & %.3f & %.3f & %+.3f \\\\', name, {_three('jss_original')}, {_three('jss_fixed')}, {_three('delta')}) AS line FROM cn")
def paper_table(spark, sf_dir):
    """Two judges have names of their own, the others keep their keys."""
    return report.paper_rows(polarity.corrected_jss(B.by_template(spark, sf_dir)), readers.dimension(spark, _NAMES, "model string, name string"))


@query(f"WITH {B.BY_TEMPLATE}, {_CORRECTED}, {_MV} SELECT mo.model, jss_original, jss_fixed, CASE WHEN delta IS NULL THEN 'N/A' ELSE printf('%+.2f', delta) END AS label, round(greatest(jss_original, jss_fixed) + 0.02, 6) AS height, CASE WHEN abs(delta) > 0.05 THEN '***' ELSE '' END AS mark FROM mo LEFT JOIN cj USING (model)")
def raw_vs_corrected_feed(spark, sf_dir):
    return report.raw_and_corrected(polarity.corrected_jss(B.by_template(spark, sf_dir)), readers.dimension(spark, _MODELS, "model string"))


@query(f"""WITH {B.BY_TEMPLATE}, e AS (SELECT DISTINCT template_pair FROM t), k(template_pair) AS (VALUES ('T1-T2'), ('T1-T5'), ('T2-T3'), ('T3-T4'))
  SELECT 'unexpected' AS kind, template_pair AS item FROM (SELECT * FROM e EXCEPT SELECT * FROM k) UNION ALL SELECT 'expected', template_pair FROM (SELECT * FROM e INTERSECT SELECT * FROM k)
  UNION ALL SELECT 'excluded present', pair_id::VARCHAR FROM (SELECT DISTINCT pair_id FROM j WHERE pair_id IN (40, 45, 50, 90, 95, 100))""")
def set_ops_pairs(spark, sf_dir):
    have = B.by_template(spark, sf_dir).select(D.template_pair(F.col("ta"), F.col("tb")).alias("item")).distinct()
    want = readers.dimension(spark, [("T1-T2",), ("T1-T5",), ("T2-T3",), ("T3-T4",)], "item string")
    out = readers.dimension(spark, [(x,) for x in B.EXCLUDED], "pair_id long")
    present = out.join(B.judgments(spark, sf_dir), "pair_id", "left_semi").select(F.lit("excluded present").alias("kind"), F.col("pair_id").cast("string").alias("item"))
    return have.exceptAll(want).select(F.lit("unexpected").alias("kind"), "item").union(have.intersect(want).select(F.lit("expected"), "item")).union(present)


@query("""WITH w AS (SELECT conv_id AS pair_id, turn::INTEGER AS run, text FROM conversations), r AS (SELECT pair_id, run, CASE WHEN length(text) % 7 = 0 THEN 'ERROR:stub' WHEN contains(text, 'e') THEN 'Yes' ELSE 'No' END AS x, CASE WHEN length(text) % 3 = 0 THEN 'Yes' ELSE 'No' END AS y FROM w),
  n AS (SELECT *, CASE WHEN x = 'ERROR:stub' THEN 'UNCLEAR' ELSE upper(x) END AS na, upper(y) AS nb FROM r)
  SELECT pair_id, run, na AS normalized_a, nb AS normalized_b, na <> nb AS flipped, CASE WHEN x = 'ERROR:stub' THEN x END AS error FROM n""")
def judge_offline(spark, sf_dir):
    work = B.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("pair_id"), F.lit("factuality").alias("task_type"), F.lit("stub").alias("model"), F.col("turn").cast("int").alias("run"),
        F.concat(F.lit("A"), F.col("text")).alias("prompt_a"), F.concat(F.lit("B"), F.col("text")).alias("prompt_b"),
    )
    return runs.run_judge(work, _stub, wait=0).select("pair_id", "run", "normalized_a", "normalized_b", "flipped", "error")


def _stub() -> runs.Judge:
    def judge(prompt: str) -> str:
        text = prompt[1:]
        if prompt[0] == "A":
            if len(text) % 7 == 0:
                raise RuntimeError("stub")
            return "Yes" if "e" in text else "No"
        return "Yes" if len(text) % 3 == 0 else "No"

    return judge


@query()
def jsonl_permissive_scan(spark, sf_dir):
    """Event properties as JSON lines, every tenth malformed, as many with a field of another type: rows by state."""
    from pyspark.sql import types as T

    events = B.table(spark, sf_dir, "events")
    digit = F.col("event_id") % 10
    other = F.concat(F.lit('{"k": "word", "was": '), F.col("props"), F.lit("}"))
    line = F.when(digit == 0, F.concat(F.lit("{bad "), F.col("props"))).when(digit == 1, F.concat("props", F.lit(" more"))).when(digit == 5, other).otherwise(F.col("props"))
    records = readers.parsed(events.select(line.alias("text")), T.StructType([T.StructField("k", T.LongType())]))
    return records.groupBy(F.col(f"r.{readers.CORRUPT}").isNotNull().alias("corrupt")).agg(F.count("*").alias("n"), F.sum("r.k").alias("k"))


ORACLES["jsonl_permissive_scan"] = "SELECT event_id % 10 < 2 AS corrupt, count(*) AS n, sum(CASE WHEN event_id % 10 NOT IN (0, 1, 5) THEN (props->>'k')::BIGINT END)::BIGINT AS k FROM events GROUP BY 1"


@query(f"WITH {B.LABELLED} SELECT task_type, count(*) AS n_pairs, count(*) FILTER (a = b) AS n_matches FROM j2 GROUP BY 1")
def incremental_jss(spark, sf_dir):
    """The aggregate that the stream keeps, over a table."""
    return scores.running_jss(B.labelled(spark, sf_dir).withColumn("error", F.lit(None).cast("string")), ["task_type"])


@query(f"""WITH u AS (SELECT l_returnflag AS task_type, l_partkey::VARCHAR AS a, (l_partkey + l_suppkey % 2)::VARCHAR AS b FROM lineitem), {_KAPPA.format(k='task_type', t='u')}
  SELECT task_type, n_pairs, round(p_o, 6) AS p_o, round(p_e, 9) AS p_e, round(kappa, 6) AS cohens_kappa FROM kk""")
def kappa_open_labels(spark, sf_dir):
    """Chance-corrected agreement where labels are as many as parts."""
    li = B.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("task_type"), F.col("l_partkey").cast("string").alias("a"), (F.col("l_partkey") + F.col("l_suppkey") % 2).cast("string").alias("b"))
    return agreement.kappa(li, ["task_type"]).select("task_type", "n_pairs", _six("p_o"), F.round("p_e", 9).alias("p_e"), _six("cohens_kappa"))


@query("""WITH l AS (SELECT *, row_number() OVER (ORDER BY event_id) AS line FROM events)
  SELECT 'malformed' AS kind, line, NULL::BIGINT AS k FROM l WHERE event_id % 10 = 0 UNION ALL SELECT 'record', line, CASE WHEN event_id % 10 = 5 THEN NULL ELSE (props->>'k')::BIGINT END FROM l WHERE event_id % 10 <> 0""")
def numbered_log_lines(spark, sf_dir):
    """Events as a log in parts, by event_id, every tenth line malformed and as many with a field of another type, read back with the numbers of its lines."""
    from pyspark.sql import types as T

    digit = F.col("event_id") % 10
    line = F.when(digit == 0, F.concat(F.lit("{bad "), F.col("props"))).when(digit == 5, F.lit('{"k": "word"}')).otherwise(F.col("props"))
    at = shared.fresh(spark, "events")
    B.table(spark, sf_dir, "events").repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(f"{at}/events.jsonl")
    log = logs.read(spark, f"{at}/events.jsonl", T.StructType([T.StructField("k", T.LongType())]))
    shared.remove(spark, at)  # the lines are in the log's table
    bad = log.malformed.select(F.lit("malformed").alias("kind"), "line", F.lit(None).cast("long").alias("k"))
    return log.rows.select(F.lit("record").alias("kind"), "line", "k").unionByName(bad)


@query("""WITH w AS (SELECT conv_id AS pair_id, turn::INTEGER AS run, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
  r AS (SELECT run, CASE WHEN length(text) % 7 = 0 THEN NULL WHEN contains(text, 'e') THEN 'YES' ELSE 'NO' END AS a, CASE WHEN length(text) % 3 = 0 THEN 'YES' ELSE 'NO' END AS b FROM w)
  SELECT run, count(*) AS n_rows, count(*) FILTER (a IS NULL) AS n_failed, count(*) FILTER (a = b) AS n_matches FROM r GROUP BY run""")
def judged_log(spark, sf_dir):
    """Conversations judged in batches into a log, and the log's totals by run."""
    work = B.table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    one = work.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    pairs = one.select(F.concat_ws("/", "conv_id", "turn").alias("pair_id"), F.lit("factuality").alias("task_type"), F.concat(F.lit("A"), "text").alias("prompt_a"), F.concat(F.lit("B"), "text").alias("prompt_b"))
    at = f"{shared.fresh(spark, 'judged')}/stub_factuality.jsonl"
    runs.evaluate(pairs, "stub", "factuality", 1, _stub, logs.records(spark, at, schemas.JUDGMENT), lambda rows, batch: sinks.append_jsonl(rows, at, batch), 20, 0.0, wait=0, batch_rows=5000)
    log = logs.records(spark, at, schemas.JUDGMENT).withColumn("turn", F.substring_index("pair_id", "/", -1).cast("int"))
    return log.groupBy(F.col("turn").alias("run")).agg(
        F.count("*").alias("n_rows"), F.count_if(~D.no_error(F.col("error"))).alias("n_failed"), F.count_if(D.no_error(F.col("error")) & D.same(F.col("normalized_a"), F.col("normalized_b"))).alias("n_matches"),
    )


_LATEST = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query(f"""SELECT l_orderkey, l_linenumber, {', '.join(_LATEST)}, l_returnflag, l_linestatus FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(f'{c} DESC' for c in [*_LATEST, 'l_returnflag', 'l_linestatus'])}) = 1""")
def latest_rows_stream(spark, sf_dir):
    """The last write of each key over lineitem as a log that grows in four parts: the stream's journal, folded."""
    keys, at = ["l_orderkey", "l_linenumber"], shared.fresh(spark, "latest")
    rows = B.table(spark, sf_dir, "lineitem").select(*keys, *_LATEST, "l_returnflag", "l_linestatus")
    files = latest.write_log(rows, f"{at}/log", ["l_partkey"], 4)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/log")
    latest.follow(stream, keys, _LATEST, f"{at}/journal", f"{at}/checkpoint")
    latest.compact(spark, f"{at}/journal", rows.schema, keys, _LATEST)
    return latest.current(spark, f"{at}/journal", rows.schema, keys, _LATEST)
