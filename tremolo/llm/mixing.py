"""Mixing sources to target weights, with DataFrame and SQL functions only.

A source's weight is its token share to the power of an exponent between 0 (all sources alike) and 1
(as they are), normalised. The exponent is bisected until the weights meet a target entropy, or
until no source is read more often than a repetition limit. A source's part of the token budget is
then read as blocks: whole passes over it, and at last the head of a permutation of its documents,
ordered by a hash, up to and with the document that meets the budget. Every reading knows its block
and its place in the permutation. So every source of a positive
target is read, and its weight is met to within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.textkit import cut, quoted, unused

WORD = r"[^\x20\x09-\x0D]+"
BISECTIONS = 60
#: With more sources than these, a plan is joined and not broadcast.
FEW_SOURCES = 50000


def tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(quoted(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_col: str) -> Column:
    """Place in the permutation: a digest of the identifier, then the identifier."""
    name = F.coalesce(quoted(id_col).cast("string"), F.lit(""))
    return F.concat(F.md5(name.cast("binary")), name)


def plan(measured: DataFrame, budget_share: float, entropy_share: float | None, repetition: float | None) -> DataFrame:
    """(source, source_tokens, exponent, weight, target_tokens, passes, rest) from the columns source and n_tokens.

    One row a source. Bisection sees each size of a source once, with the number of sources of that
    size, so what is gathered into one row grows with the distinct sizes and not with the sources.
    """
    sums = measured.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    kinds = sums.where("source_tokens > 0").groupBy("source_tokens").agg(F.count("*").alias("n"))
    shares = kinds.agg(
        F.array_sort(F.collect_list(F.struct(F.col("source_tokens").alias("t"), "n"))).alias("sizes"), F.sum(F.col("source_tokens") * F.col("n")).alias("all_tokens"), F.sum("n").alias("n_sources"),
    )
    power = "aggregate(sizes, 0D, (a, x) -> a + x.n * pow(x.t / all_tokens, {e}))"
    if entropy_share is not None:
        ratio = "aggregate(sizes, 0D, (a, x) -> a - x.n * pow(x.t / all_tokens, {e}) / {z} * ln(pow(x.t / all_tokens, {e}) / {z}))"
        goal = f"{entropy_share}D * ln(n_sources) + {1 - entropy_share}D * " + ratio.format(e="1D", z="1D")
        high = ratio.format(e="{e}", z=f"({power})") + " < goal"
    else:
        # the least, sizes[0], is read most often: budget * weight / tokens falls with the size
        goal = f"{repetition}D"
        high = f"{budget_share}D * all_tokens * pow(sizes[0].t / all_tokens, {{e}}) / ({power}) / sizes[0].t <= goal"
        high = f"NOT ({high})"
    step = high.format(e="((s.lo + s.hi) / 2)")
    if entropy_share is not None:  # entropy falls with the exponent: too little of it, lower the exponent
        move = f"IF({step}, named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2), named_struct('lo', (s.lo + s.hi) / 2, 'hi', s.hi))"
    else:  # repetition falls with the exponent: too much of it, raise the exponent
        move = f"IF({step}, named_struct('lo', (s.lo + s.hi) / 2, 'hi', s.hi), named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2))"
    start = "named_struct('lo', 0D, 'hi', 1D)"
    bisected = (
        shares.withColumn("goal", F.expr(goal))
        .withColumn("found", F.expr(f"aggregate(sequence(1, {BISECTIONS}), {start}, (s, i) -> {move})"))
        .withColumn("exponent", F.round(F.col("found.hi" if entropy_share is None else "found.lo"), 9))
        .withColumn("total", F.expr(power.format(e="exponent")))
    )
    weight = F.when(F.col("source_tokens") > 0, F.pow(F.col("source_tokens") / F.col("all_tokens"), F.col("exponent")) / F.col("total")).otherwise(F.lit(0.0))
    target = F.floor(F.lit(budget_share) * F.col("all_tokens") * weight + F.lit(1e-6)).cast("long")
    out = sums.crossJoin(F.broadcast(bisected)).withColumns({"weight": weight, "target_tokens": target})  # one row on the right
    return out.select(
        "source", "source_tokens", "source_docs", "exponent", "weight", "target_tokens",
        F.when(F.col("source_tokens") > 0, F.floor(F.col("target_tokens") / F.col("source_tokens"))).otherwise(F.lit(1)).cast("long").alias("passes"),
        F.when(F.col("source_tokens") > 0, F.col("target_tokens") % F.col("source_tokens")).otherwise(F.lit(-1)).cast("long").alias("rest"),
    )


def by_source(planned: DataFrame) -> DataFrame:
    """planned, to be broadcast if it has at most FEW_SOURCES rows."""
    return F.broadcast(planned) if planned.count() <= FEW_SOURCES else planned


def thresholds(measured: DataFrame, planned: DataFrame) -> DataFrame:
    """planned with last_key: the last place of each source's permutation that its rest pays for, at least in part.

    Running sums go piece by piece: a source of n documents has about sqrt(n) pieces (by its
    permutation), which are summed first, so no task sorts more than about sqrt(n) rows of a source.
    """
    piece = F.floor(F.conv(F.substring("place", 1, 7), 16, 10).cast("long") * F.ceil(F.sqrt("source_docs")) / F.lit(1 << 28)).cast("long")
    rows = measured.join(by_source(planned.where("rest > 0").select("source", "source_docs", "rest")), "source").select("source", "rest", "place", "n_tokens", piece.alias("piece"))
    places = rows.groupBy("source", "piece", "rest", "place").agg(F.sum("n_tokens").alias("n_tokens"))
    sums = rows.groupBy("source", "piece").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("source", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = places.join(before.select("source", "piece", "before"), ["source", "piece"]).withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    last = running.where("ahead < rest").groupBy("source").agg(F.max("place").alias("last_key"))
    return planned.join(last, "source", "left")


def mixture(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", budget_share: float = 1.0, entropy_share: float | None = None, repetition: float | None = 1.25) -> DataFrame:
    """The plan: one row a source with source, source_tokens, exponent, weight, target_tokens, passes, rest and last_key.

    budget_share: the token budget as a share of all tokens. entropy_share: the target entropy, as a
    share of the way from that of the token shares to the most possible; else repetition: the most
    times a source is read, but for a part of one document. A null source counts as the source ''.
    Texts without words (null and empty ones) have no tokens and go with their place. Documents of one
    identifier share a place, so they are read alike. A source without tokens is read once. Ties in
    size change nothing; an empty table gives an empty plan.
    """
    small = cut(df.select(F.coalesce(quoted(source).cast("string"), F.lit("")).alias("source"), tokens(text).alias("n_tokens"), order_key(id_col).alias("place")))
    planned = cut(plan(small, budget_share, entropy_share, repetition))
    return cut(thresholds(small, planned))


def read_times(planned: DataFrame, df: DataFrame, id_col: str = "doc_id", source: str = "source", into: str = "__mix") -> DataFrame:
    """df with a struct in the column ``into``; a column of that name is replaced.

    copies: how often the row is read; exponent and weight of its source; passes: the whole passes
    over its source, blocks 0 to passes - 1 of the reading; head: whether the row is in the head of
    the permutation too, which is block number passes; place: its place in the permutation. Up to
    FEW_SOURCES sources the rows of df aren't moved; beyond, they are dealt by source.
    """
    rows = df.drop(into)
    at = unused([*rows.columns, into], "plan")
    side = by_source(planned.select(F.struct("source", "exponent", "weight", "passes", "last_key").alias(at)))
    own, place = F.col(at), order_key(id_col)
    joined = rows.join(side, F.coalesce(quoted(source).cast("string"), F.lit("")) == own["source"])
    head = F.coalesce(place <= own["last_key"], F.lit(False))
    parts = {"copies": own["passes"] + head.cast("long"), "exponent": own["exponent"], "weight": own["weight"], "passes": own["passes"], "head": head, "place": place}
    return joined.withColumn(into, F.struct(*[c.alias(n) for n, c in parts.items()])).drop(at)


def readings(planned: DataFrame, df: DataFrame, id_col: str = "doc_id", source: str = "source", into: str = "__mix") -> DataFrame:
    """One row a reading of a row of df, with a struct (block, place, exponent, weight) in the column ``into``.

    Read in the order of block, then place: every source goes through whole passes, each in the order
    of its permutation, and at last through the permutation's head; so a document comes again only
    when all of its source has been read. Rows that are not read are left out.
    """
    times = read_times(planned, df, id_col, source, into)
    own = F.col(into)
    block = unused(times.columns, "block")
    again = times.where(own["copies"] > 0).withColumn(block, F.explode(F.sequence(F.lit(0), own["copies"].cast("int") - 1)))
    return again.withColumn(into, F.struct(F.col(block).cast("long").alias("block"), own["place"].alias("place"), own["exponent"].alias("exponent"), own["weight"].alias("weight"))).drop(block)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", source: str = "source", ordered: bool = False, **how) -> DataFrame:
    """df with every row as often as the mixture reads it, and no further columns; columns of any other name pass unchanged.

    ordered: rows in the order of ``readings``, which sorts the texts once; else in no order.
    """
    mix = unused(df.columns, "mix")
    rows = readings(mixture(df, id_col, source=source, **how), df, id_col, source, mix)
    if ordered:
        rows = rows.orderBy(F.col(mix)["block"], F.col(mix)["place"])
    return rows.select(*[quoted(c) for c in df.columns])
