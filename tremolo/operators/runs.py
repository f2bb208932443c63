"""Collecting judgments: what is left to do, the call of a judge, totals, and the upkeep of logs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tremolo import schemas
from tremolo.functions import decisions as D
from tremolo.functions import fixed
from tremolo.sources import judges, shared
from tremolo.sources.journal import Journal
from tremolo.streaming.batches import in_batches

Judge = Callable[[str], str]
_ANSWERS = ("prompt_a_raw", "prompt_b_raw", "timestamp")


def pending(work: DataFrame, log: DataFrame, keys: list[str], done: Column) -> DataFrame:
    """Each key of work once, unless the log holds it with done."""
    finished = log.where(done & F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))).select(*keys).distinct()
    return work.dropDuplicates(keys).join(finished, keys, "left_anti")


def call(judge: Judge, prompt: str, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep, failed: Callable[[Exception], object] = lambda e: f"ERROR:{e}"):
    """The judge's answer; after one failure and a wait it is asked again, after two comes failed(the second error), a text that says so."""
    try:
        return judge(prompt)
    except Exception:
        sleep(wait)
        try:
            return judge(prompt)
        except Exception as e:
            return failed(e)


@dataclass(frozen=True)
class Access:
    """How a judge is reached: what makes its client in a task, and whose limit it shares: a call every ``pause`` seconds for all judges of the provider."""

    make: Callable[[], Judge]
    provider: str = ""
    pause: float = 0.0


def permitted(work: DataFrame, permits: int, by: list[str], provider: Column | None = None, providers: int = 1) -> DataFrame:
    """work with a partition for each provider (a number) and permit, by a hash of ``by``: a partition is one task at a time, so a permit is never used twice at once."""
    permit = F.pmod(F.xxhash64(*by), F.lit(permits)).cast("int")
    return work.repartitionById(providers * permits, permit if provider is None else provider * permits + permit)


def _asked(batches: Iterator[pd.DataFrame], access: dict[str, Access], permits: int, at_once: int, one: Callable[[Judge, object], tuple]) -> Iterator[tuple[pd.DataFrame, list[tuple]]]:
    """Each batch with what ``one`` makes of its rows: a client a judge and task, a provider's calls at the task's part of its pace, at_once rows in flight, rows in order."""
    paces: dict[str, judges.Pace] = {}
    made: dict[str, Judge] = {}

    def judge_of(row) -> Judge:
        name = getattr(row, "model", "") if len(access) > 1 or "" not in access else ""
        if name not in access:
            raise ValueError(f"no access to a judge named {name}")
        if name not in made:
            own = access[name]
            made[name] = paces.setdefault(own.provider, judges.Pace(own.pause * permits)).judge(own.make())
        return made[name]

    for pdf in batches:
        yield pdf, list(judges.in_flight(((judge_of(row), row) for row in pdf.itertuples(index=False)), lambda pair: one(*pair), at_once))


def run_judges(work: DataFrame, access: dict[str, Access], wait: float = 5.0, stamp: bool = False, permits: int | None = None, at_once: int = 1, journal: str | None = None) -> DataFrame:
    """work (pair_id, task_type, model, run, prompt_a, prompt_b) with both answers, decisions, flip and error; stamp adds the time of the calls, UTC as text.

    access: by name (column model), or one under "" for all rows. permits: work is dealt to so many
    tasks a provider, whatever its partitions, and each begins a call every pause * permits seconds at
    most, so that a provider's tasks together keep its pause, and providers don't wait for each other;
    speculative copies of tasks would break that. Without permits the partitions of work are the tasks,
    and each keeps the pause alone. at_once: rows of a task that are asked at the same time; the clients
    must allow it. A judge without access is an error. journal: a folder where each row's answers are kept
    as soon as both are there, unless one failed; rows whose answers it has aren't asked again.
    """
    keep = work.select("pair_id", "task_type", "model", "run", "prompt_a", "prompt_b")
    journal = shared.qualified(work.sparkSession, journal) if journal else None
    providers = sorted({a.provider for a in access.values()})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Journal(journal, TaskContext.get().partitionId(), ["pair_id", "run", "model"]) if journal else None

        def one(judge: Judge, row) -> tuple:
            kept = book.recall(row.pair_id, row.run, row.model) if book else None
            if kept:
                return tuple(kept[c] for c in _ANSWERS)
            found = call(judge, row.prompt_a, wait), call(judge, row.prompt_b, wait), datetime.now(UTC).isoformat()
            if book and not any(str(x).startswith("ERROR:") for x in found[:2]):
                book.keep({"pair_id": row.pair_id, "task_type": row.task_type, "model": row.model, "run": int(row.run), **dict(zip(_ANSWERS, found, strict=True))})
            return found

        for pdf, rows in _asked(batches, access, permits or 1, at_once, one):
            yield pdf.assign(prompt_a_raw=[r[0] for r in rows], prompt_b_raw=[r[1] for r in rows], timestamp=[r[2] for r in rows])

    if permits:
        number = F.create_map(*[F.lit(x) for name, a in access.items() for x in (name, providers.index(a.provider))])  # a judge of the registry each
        provider = F.lit(0) if len(providers) == 1 else F.coalesce(F.element_at(number, F.col("model")), F.lit(0))
        keep = permitted(keep, permits, ["pair_id", "run"], provider, len(providers))
    raw = keep.mapInPandas(ask, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep.schema) + ", prompt_a_raw string, prompt_b_raw string, timestamp string")
    out = decided(raw).drop("prompt_a", "prompt_b")
    return out if stamp else out.drop("timestamp")


def run_judge(
    work: DataFrame, make_judge: Callable[[], Judge], wait: float = 5.0, stamp: bool = False, pause: float = 0.0, permits: int | None = None, at_once: int = 1, journal: str | None = None,
) -> DataFrame:
    """run_judges with one judge, that answers all rows."""
    return run_judges(work, {"": Access(make_judge, "", pause)}, wait, stamp, permits, at_once, journal)


def recover(spark: SparkSession, journal: str, append: Callable[[DataFrame, str, str, str], None]) -> int:
    """Gives the answers that a lost job left in its journal to the logs, by append(rows, judge, task, name of a batch), and deletes the journal; how many there were."""
    if not shared.exists(spark, journal):
        return 0
    left = spark.read.option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").schema(f"pair_id string, task_type string, model string, run int, {', '.join(f'{c} string' for c in _ANSWERS)}").json(journal)
    rows = log_rows(decided(left.dropDuplicates(["pair_id", "run", "model", "task_type"])))
    counts = rows.groupBy("model", "task_type").count().collect()  # a row a log
    for r in counts:
        append(rows.where(F.col("model").eqNullSafe(r.model) & F.col("task_type").eqNullSafe(r.task_type)), r.model, r.task_type, f"{time.time_ns():020d}-recovered")
    shared.remove(spark, journal)
    return sum(r["count"] for r in counts)


def work_left(pairs: DataFrame, model: str, task: str, runs: int, log: DataFrame) -> DataFrame:
    """pair_id, task_type, model, run, prompt_a, prompt_b of what the log (pair_id, run, error) lacks of ``runs`` runs of a judge. A missing task is the given one."""
    asked = pairs.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumns({"model": F.lit(model), "task_type": F.coalesce("task_type", F.lit(task))})
    return pending(asked.select("pair_id", "task_type", "model", "run", "prompt_a", "prompt_b"), log, ["pair_id", "run"], D.no_error(F.col("error")))


def log_rows(judged: DataFrame) -> DataFrame:
    """Stamped judgments as rows of a log."""
    return judged.withColumns({"prompt_a_decision": F.col("normalized_a"), "prompt_b_decision": F.col("normalized_b")}).select(*schemas.JUDGMENT.names)


def price(n_ok: int, max_tokens: int, cost_per_1k: float) -> float:
    """Estimated cost of successful pairs, two calls each."""
    return n_ok * (fixed.PROMPT_TOKENS + max_tokens) * 2 / 1000.0 * cost_per_1k


def evaluate(
    pairs: DataFrame, model: str, task: str, runs: int, make_judge: Callable[[], Judge], log: DataFrame, append: Callable[[DataFrame, str], None], max_tokens: int, cost_per_1k: float, wait: float = 5.0,
    pause: float = 0.0, permits: int = 4, at_once: int = 1, batch_rows: int = 200, journal: str | None = None,
) -> tuple[int, float]:
    """Judges what the log (pair_id, run, error) lacks, appends full log rows, and returns (successful pairs, estimated cost).

    The work goes in batches of at most batch_rows rows, each written by append(rows, name of the
    batch) before the next is asked: of a run that dies, all batches but the one at hand are in the
    log, and the next run asks what is left. With a journal the answers of the batch at hand are kept as
    well, for ``recover``.
    """
    n_ok, spark = 0, pairs.sparkSession

    def judged(batch: DataFrame, name: str) -> None:
        nonlocal n_ok
        book = f"{journal}/{name}" if journal else None
        rows, seen = log_rows(run_judge(batch, make_judge, wait, True, pause, permits, at_once, book)), Observation()
        append(rows.observe(seen, F.count_if(D.no_error(F.col("error"))).alias("n_ok")), name)
        n_ok += seen.get["n_ok"]
        if book:
            shared.remove(spark, book)

    in_batches(work_left(pairs, model, task, runs, log), judged, batch_rows)
    return n_ok, price(n_ok, max_tokens, cost_per_1k)


def evaluate_together(todo: DataFrame, access: dict[str, Access], append: Callable[[DataFrame, str, str, str], None], wait: float = 5.0, permits: int = 4, at_once: int = 1, batch_rows: int = 2000, journal: str | None = None) -> dict[tuple[str, str], int]:
    """Judges ``work_left`` of many judges in the same jobs, each provider at its own limit; successful pairs by judge and task.

    A batch holds rows of all judges. Its answers are kept in the shared folder, then given out by
    append(rows, judge, task, name of the batch), before the next batch is asked. journal: as in evaluate.
    """
    spark, ok = todo.sparkSession, {}

    def judged(batch: DataFrame, name: str) -> None:
        at, book = shared.fresh(spark, "answers"), f"{journal}/{name}" if journal else None
        rows = shared.stored(log_rows(run_judges(batch, access, wait, True, permits, at_once, book)), at)
        for r in rows.groupBy("model", "task_type").agg(F.count_if(D.no_error(F.col("error"))).alias("n")).collect():  # a row a log
            append(rows.where((F.col("model") == r.model) & (F.col("task_type") == r.task_type)), r.model, r.task_type, name)
            ok[r.model, r.task_type] = ok.get((r.model, r.task_type), 0) + r.n
        for path in (at, book) if book else (at,):
            shared.remove(spark, path)

    in_batches(todo.repartition("pair_id", "run"), judged, batch_rows)
    return ok


def validate(judge: Judge, prompt: str, wait: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str, str | None]:
    """(decision, raw answer, error): YES, NO or UNCLEAR by what the answer holds; ERROR after two failures."""
    answer = call(judge, prompt, wait, sleep, failed=lambda e: e)
    if isinstance(answer, Exception):
        return "ERROR", "", str(answer)
    raw = answer.strip().upper()
    return ("YES" if "YES" in raw else "NO" if "NO" in raw else "UNCLEAR"), raw, None


def run_validation(pairs: DataFrame, make_judge: Callable[[], Judge], question: str, wait: float = 3.0, pause: float = 0.0, permits: int | None = None, at_once: int = 1) -> DataFrame:
    """pair_id, task_type, validation_decision, raw_response, error of each pair. question: a text with {prompt_a} and {prompt_b}. pause, permits, at_once: as in run_judge."""
    keep = pairs.select("pair_id", F.coalesce("task_type", F.lit("unknown")).alias("task_type"), "prompt_a", "prompt_b")

    def one(judge: Judge, row) -> tuple:
        return validate(judge, question.replace("{prompt_a}", row.prompt_a or "").replace("{prompt_b}", row.prompt_b or ""), wait)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, rows in _asked(batches, {"": Access(make_judge, "", pause)}, permits or 1, at_once, one):
            yield pdf[["pair_id", "task_type"]].assign(validation_decision=[r[0] for r in rows], raw_response=[r[1] for r in rows], error=[r[2] for r in rows])

    source = permitted(keep, permits, ["pair_id"]) if permits else keep
    return source.mapInPandas(ask, f"pair_id {keep.schema['pair_id'].dataType.simpleString()}, task_type string, validation_decision string, raw_response string, error string")


def decided(raw: DataFrame) -> DataFrame:
    """Adds normalized_a, normalized_b, flipped and error to answers."""
    a, b, task = F.col("prompt_a_raw"), F.col("prompt_b_raw"), F.col("task_type")
    out = raw.withColumns({"normalized_a": D.normalize_or_unclear(a, task), "normalized_b": D.normalize_or_unclear(b, task), "error": D.error_of(a, b)})
    return out.withColumn("flipped", D.flipped(F.col("normalized_a"), F.col("normalized_b")))


def migrate(log: DataFrame) -> DataFrame:
    """A log in the old or the new form, in the new form, decided anew from the raw answers; changed says whether the row differs.

    An empty or missing raw answer comes from the old column, a missing run from run_number or is 1.
    """
    old = lambda side: D.first_filled(F.col(f"prompt_{side}_raw"), F.col(f"prompt_{side}_decision_raw"))
    filled = log.withColumns({"__a": old("a"), "__b": old("b"), "__run": F.coalesce("run", "run_number", F.lit(1))})
    task = F.coalesce("task_type", F.lit(""))
    new = filled.withColumns({
        "__na": D.normalize_or_unclear(F.col("__a"), task), "__nb": D.normalize_or_unclear(F.col("__b"), task), "__error": D.error_of(F.col("__a"), F.col("__b")),
    }).withColumn("__flip", D.flipped(F.col("__na"), F.col("__nb")))
    pairs = {"prompt_a_raw": "__a", "prompt_b_raw": "__b", "run": "__run", "normalized_a": "__na", "normalized_b": "__nb", "flipped": "__flip", "error": "__error"}
    changed = F.lit(False)
    for was, now in pairs.items():
        changed = changed | ~F.col(was).eqNullSafe(F.col(now))
    return new.withColumn("changed", changed).select(*[F.col(pairs.get(c, c)).alias(c) for c in log.columns], "changed")


def run_cost(log: DataFrame, judges: DataFrame) -> DataFrame:
    """model, n_rows, n_ok, cost: successful pairs and their estimated price. judges: model, max_tokens, cost_per_1k, a small dimension."""
    totals = log.groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if(D.no_error(F.col("error"))).alias("n_ok"))
    joined = totals.join(judges, "model", "left")  # a row a judge on both sides; the planner sees their sizes
    price = D.cost(F.col("n_ok"), F.coalesce("max_tokens", F.lit(20)), F.coalesce("cost_per_1k", F.lit(0.0)))
    return joined.select("model", "n_rows", "n_ok", F.round(price, 6).alias("cost"))


def log_profile(log: DataFrame) -> DataFrame:
    """One row: rows, distinct pairs and runs, and the rows that their product makes expect."""
    out = log.agg(F.count("*").alias("n_rows"), F.countDistinct("pair_id").alias("n_pairs"), F.countDistinct("run").alias("n_runs"))
    return out.withColumn("expected", F.col("n_pairs") * F.col("n_runs"))


def rows_per_model(log: DataFrame) -> DataFrame:
    """model (ALL: all), n_rows."""
    out = log.rollup("model").agg(F.count("*").alias("n_rows"), F.grouping("model").alias("g"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("model")).alias("model"), "n_rows")
