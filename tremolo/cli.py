"""Command line: collect judgments of prompt pairs, score a folder of logs, write the prompt pairs."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolo import schemas
from tremolo.functions import decisions as D
from tremolo.functions import fixed
from tremolo.operators import agreement, generate, report, runs
from tremolo.sources import judges, logs, readers, sinks

TASKS = [t for t, _, _ in fixed.TASKS]


def usable(rows: DataFrame) -> DataFrame:
    """Log rows with the decisions a and b, without excluded pairs, errors and unclear decisions."""
    a, b = (D.first_filled(F.col(f"normalized_{s}"), F.col(f"prompt_{s}_decision")) for s in "ab")
    able = rows.withColumns({"a": a, "b": b, "model": F.coalesce("model", F.lit("unknown")), "task_type": F.coalesce("task_type", F.lit("unknown"))})
    return able.where(D.not_excluded(F.col("pair_id")) & D.no_error(F.col("error")) & D.clear(F.col("a"), F.col("b")))


def suite_of_files(rows: DataFrame, exact: bool) -> DataFrame:
    """The metrics of every judge and task, each file scored by itself; of files that score the same judge and task the last by name counts."""
    keys = ["file", "model", "task_type"]
    suite = agreement.metric_suite(rows, keys, agreement.bootstrap_exact(rows, keys, ["line"]) if exact else None)
    last = Window.partitionBy("model", "task_type").orderBy(F.desc("file"))  # a row a file
    return suite.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "file")


def summarize(spark: SparkSession, folder: str, out: str | None = None, exact: bool = True) -> dict:
    """All seven metrics of every judge and task in a folder of JSON-lines logs, printed and written as JSON.

    A log may be a file, a folder of parts as ``evaluate`` writes it, or both.

    exact: intervals of the published generator, drawn in the order of each file's lines, a group in
    one task; otherwise the limit of many replicates, from counts alone.
    """
    log = logs.read(spark, folder, schemas.JUDGMENT)
    readers.warn_malformed(log.malformed)
    suite = suite_of_files(usable(log.rows), exact).cache()
    print(report.console_head(), *(r.line for r in report.console_rows(suite).collect()), sep="\n")
    found = sinks.summary_json(suite, out or f"{folder}/../metrics_summary.json")
    suite.unpersist()
    log.close()
    return found


def evaluate(
    spark: SparkSession, models: list[str], tasks: list[str], n_runs: int, source: str, out: str, dry_run: bool = False, make: Callable[[str], Callable[[], judges.Judge]] = judges.unpaced, wait: float = 5.0,
    paced: bool = True, permits: int = 4, at_once: int = 1, batch_rows: int = 200, together: bool = False,
) -> float:
    """Asks each judge for each task n_runs times what its log lacks; the estimated cost. A judge without a key or a task without pairs is skipped.

    Answers are in the logs batch by batch; those of the batch at hand are kept in a journal beside the
    logs, one by one, and a journal that a lost run has left goes to the logs first. A judge is asked by so many tasks as there are permits,
    which keep its provider's limit together. The judges take turns, or, ``together``, are asked in
    the same jobs, in which those of one provider share its limit.
    """
    known: dict[str, judges.Spec] = {}
    access: dict[str, runs.Access] = {}
    for model in models:
        try:
            access[model] = runs.Access(make(model), judges.spec(model).provider, judges.spec(model).pause if paced else 0.0)
            known[model] = judges.spec(model)
        except (RuntimeError, ValueError) as e:
            print(f"skipped {model}: {e}")
    found = {}
    for task in tasks if known else []:
        if readers.exists(spark, f"{source}/{task}.jsonl"):
            pairs = logs.records(spark, f"{source}/{task}.jsonl", schemas.PROMPT_PAIR)
            found[task] = pairs.orderBy("pair_id").limit(5) if dry_run else pairs
        else:
            print(f"no pairs at {source}/{task}.jsonl")
    at = lambda model, task: f"{out}/{model}_{task}.jsonl"
    add = lambda rows, model, task, name: sinks.append_jsonl(rows, at(model, task), name)
    journal = f"{out}/_answers"
    if saved := runs.recover(spark, journal, add):
        print(f"{saved} answers of a lost run saved")
    log = lambda model, task: logs.records(spark, at(model, task), schemas.JUDGMENT)
    total, each = 0.0, [(m, t) for m in known for t in found]
    if together and each:
        todo = reduce(DataFrame.unionByName, [runs.work_left(found[t].withColumn("task_type", F.lit(t)), m, t, n_runs, log(m, t)) for m, t in each])
        ok = runs.evaluate_together(todo, access, add, wait, permits, at_once, batch_rows, journal)
    for m, t in each:
        if together:
            n_ok = ok.get((m, t), 0)
        else:
            a = access[m]
            n_ok, _ = runs.evaluate(
                found[t], m, t, n_runs, a.make, log(m, t), lambda rows, name, m=m, t=t: add(rows, m, t, name), known[m].max_tokens, known[m].cost_per_1k, wait, a.pause, permits, at_once, batch_rows, journal,
            )
        cost = runs.price(n_ok, known[m].max_tokens, known[m].cost_per_1k)
        print(f"{m} {t}: {n_ok} judged, about {cost:.4f} USD")
        total += cost
    return total


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    todo = p.add_subparsers(dest="command", required=True)
    s = todo.add_parser("summarize", help="metrics of a folder of logs")
    s.add_argument("logs")
    s.add_argument("--out")
    s.add_argument("--from-counts", action="store_true", help="intervals from counts, for large logs")
    e = todo.add_parser("evaluate", help="ask judges")
    e.add_argument("--model", required=True, choices=[*judges.REGISTRY, "all"])
    e.add_argument("--task", required=True, choices=[*TASKS, "all"])
    e.add_argument("--runs", type=int, default=3)
    e.add_argument("--input", default="data/prompt_pairs")
    e.add_argument("--output", default="data/results/raw_outputs")
    e.add_argument("--dry-run", action="store_true", help="five pairs a task")
    e.add_argument("--permits", type=int, default=4, help="tasks that share a provider's limit")
    e.add_argument("--at-once", type=int, default=1, help="pairs that a task asks at the same time")
    e.add_argument("--together", action="store_true", help="ask all judges in the same jobs")
    e.add_argument("--batch", type=int, default=200, help="pairs between two writes of the log")
    g = todo.add_parser("generate", help="write the prompt pairs")
    g.add_argument("out")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "summarize":
        summarize(spark, args.logs, args.out, not args.from_counts)
    elif args.command == "evaluate":
        if Path(".env").is_file():
            readers.load_env()
        models = list(judges.REGISTRY) if args.model == "all" else [args.model]
        evaluate(spark, models, TASKS if args.task == "all" else [args.task], args.runs, args.input, args.output, args.dry_run, permits=args.permits, at_once=args.at_once, batch_rows=args.batch, together=args.together)
    else:
        sinks.by_task_jsonl(generate.generate_pairs(spark), args.out, TASKS)


if __name__ == "__main__":
    main()
