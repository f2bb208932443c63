"""Column expressions over judges' answers: normal forms, errors, polarity, templates, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremolo.functions import fixed

UNCLEAR = "UNCLEAR"
# Every character that counts as white space at the ends of an answer, by code point.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit(UNCLEAR))


def tidy(raw: Column) -> Column:
    """Upper case without white space at the ends."""
    return F.upper(F.btrim(raw, F.lit(SPACE)))


def yes_no(raw: Column) -> Column:
    """YES if the answer holds YES anywhere, else NO if it holds NO, else UNCLEAR."""
    u = tidy(raw)
    return F.when(u.contains("YES"), "YES").when(u.contains("NO"), "NO").otherwise(UNCLEAR)


def a_or_b(raw: Column) -> Column:
    """The first A or B that stands alone once emphasis marks are gone."""
    bare = F.regexp_replace(tidy(raw), "[*_]+", "")
    return _first(bare, r"(^|[^\p{L}\p{N}_])([AB])($|[^\p{L}\p{N}_])", 2)


def one_to_five(raw: Column) -> Column:
    return _first(tidy(raw), "[1-5]", 0)


def normalize(raw: Column, task: Column) -> Column:
    """An answer's decision by its task; for another task its first ten characters."""
    return (
        F.when(task == "factuality", yes_no(raw)).when(task.isin("relevance", "preference"), a_or_b(raw))
        .when(task == "coherence", one_to_five(raw)).otherwise(F.substring(tidy(raw), 1, 10))
    )


def failed(raw: Column) -> Column:
    return F.coalesce(raw.startswith("ERROR:"), F.lit(False))


def normalize_or_unclear(raw: Column, task: Column) -> Column:
    return F.when(failed(raw), UNCLEAR).otherwise(normalize(raw, task))


def error_of(raw_a: Column, raw_b: Column) -> Column:
    return F.when(failed(raw_a), raw_a).when(failed(raw_b), raw_b)


def same(a: Column, b: Column) -> Column:
    """Equality in which null equals null."""
    return a.eqNullSafe(b)


def flipped(a: Column, b: Column) -> Column:
    return ~same(a, b)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; the empty string if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def invert(decision: Column) -> Column:
    """NO for YES, YES for anything else."""
    return F.when(decision == "YES", "NO").otherwise("YES")


def invert_if(decision: Column, template: Column, inverted: str = "T4") -> Column:
    return F.when(template == inverted, invert(decision)).otherwise(decision)


def template_of(prompt: Column, marker: str = "\n\nResponse:") -> Column:
    """The name of the factuality template before the marker, UNKNOWN for any other text."""
    head = F.split_part(prompt, F.lit(marker), F.lit(1))
    out = F.lit("UNKNOWN")
    for k, text in enumerate(fixed.FACTUALITY_TEMPLATES):
        out = F.when(head == text.split(marker)[0], f"T{k + 1}").otherwise(out)
    return out


def template_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def cycle_template(position: Column, second: bool, k: int = 5) -> Column:
    """Name of the template that the round robin gives to a position (from 0)."""
    return F.concat(F.lit("T"), (F.pmod(position * 2 + int(second), F.lit(k)) + 1).cast("string"))


# Filters. Each says which rows stay.
def not_excluded(pair_id: Column, excluded: list | None = None) -> Column:
    return ~F.coalesce(pair_id.isin(fixed.EXCLUDED_PAIRS if excluded is None else excluded), F.lit(False))


def no_error(error: Column) -> Column:
    """An empty error is an error."""
    return error.isNull()


def no_error_text(error: Column) -> Column:
    """An empty error is none."""
    return F.coalesce(error, F.lit("")) == ""


def clear(a: Column, b: Column) -> Column:
    return ~F.coalesce(a == UNCLEAR, F.lit(False)) & ~F.coalesce(b == UNCLEAR, F.lit(False))


def filled(a: Column, b: Column) -> Column:
    """Neither null nor empty; UNCLEAR stays."""
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")


def filled_and_clear(a: Column, b: Column) -> Column:
    return filled(a, b) & (a != UNCLEAR) & (b != UNCLEAR)


def has_inverted(a: Column, b: Column, inverted: str = "T4") -> Column:
    return (a == inverted) | (b == inverted)


def band(value: Column) -> Column:
    return F.when(value > 0.9, "high").when(value >= 0.65, "mid").otherwise("low")


def significance(delta: Column) -> Column:
    return F.when(F.abs(delta) > 0.05, "***").otherwise("")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, summed as doubles, to four places; null if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return python_round(F.try_divide(dot, norm(a) * norm(b)), 4)


def cost(n_ok: Column, max_tokens: Column, cost_per_1k: Column) -> Column:
    """Estimated price of the successful pairs: two calls each."""
    return n_ok * (fixed.PROMPT_TOKENS + max_tokens) * 2 / 1000.0 * cost_per_1k


def python_round(value: Column, digits: int) -> Column:
    """Rounded from the double's exact binary value, ties to even. Infinities, NaN and values of 2^40 or more stay as they are."""
    one = 1 << 62
    size = F.abs(value)
    whole = F.floor(size)
    units = ((size - whole) * float(one)).cast("long").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(6,0)")
    steps = F.call_function("div", units, F.lit(one).cast("decimal(19,0)"))
    rest = units - steps.cast("decimal(10,0)") * F.lit(one).cast("decimal(19,0)")
    half = F.lit(one >> 1).cast("decimal(19,0)")
    up = F.when((rest > half) | ((rest == half) & ((whole * 10**digits + steps) % 2 == 1)), 1).otherwise(0)
    rounded = F.signum(value) * (whole * 10**digits + steps + up) / float(10**digits)
    return F.when(F.isnan(value) | (size >= float(1 << 40)), value).otherwise(rounded)


def sql_round(value: str, digits: int) -> str:
    """python_round as DuckDB SQL over a DOUBLE expression."""
    units = f"((abs({value}) * 4611686018427387904)::HUGEINT * {10**digits})"
    rest = f"({units} % 4611686018427387904)"
    up = f"CASE WHEN {rest} > 2305843009213693952 OR ({rest} = 2305843009213693952 AND ({units} // 4611686018427387904) % 2 = 1) THEN 1 ELSE 0 END"
    return f"(sign({value}) * (({units} // 4611686018427387904) + {up})::DOUBLE / {10**digits})"
