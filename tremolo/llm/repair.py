"""Repair of conversation structure: the cheapest edits that make roles alternate.

A legal conversation is empty, or an optional system turn before one or more pairs of a user's and an
assistant's turn, told by the first letters of roles. A kept turn costs nothing, a rerole 2, a deletion
3, an inserted empty turn 2; a turn that breaks off costs 1 more unless it is deleted, and blank and
repeated turns must be deleted.

The plan is a dynamic program over the retained (kept or reroled) turns. A gap between two of them costs
the difference of two prefix sums of deletions and the turns that their two roles make necessary, so
for each role one running minimum stands for all later turns. Costs are found from the end; then the
plan is read from the front, each time the least letter that still leads to the least cost, which
gives the least audit (D, I, K, R: delete, insert, keep, rerole).

A plan holds 32 bytes of costs and a few of flags a turn of its conversation, which is one task's work:
its turns must be taken in order. Texts are not in memory with it; they stream past the finished plan.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANKS = " \t\n\x0b\x0c\r"
_DELETE, _REROLE, _INSERT, _BROKEN = 3, 2, 2, 1
_NEVER = 1 << 60
#: What a turn is worth to a plan: letter of its role (o: any other), upper case if it breaks off; x must be deleted.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLE = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
#: Turns to insert between a retained turn (row) and the next (column: system, user, assistant, the end).
_BETWEEN = ((0, 0, 1, 0), (_NEVER, 0, 1, 2), (_NEVER, 1, 0, 1), (_NEVER, 0, 1, 0))
_SHORT = 64


def _choices(code: str) -> list[tuple[int, int, str]]:
    """(role, cost, letter) of the ways to retain a turn."""
    if code == "x":
        return []
    own, more = _ROLE.get(code.lower()), _BROKEN if code.isupper() else 0
    kept = [(own, more, "K")] if own else []
    return kept + [(r, _REROLE + more, "R") for r in (_USER, _ASSISTANT) if r != own]


_CHOICES = {c: _choices(c) for c in "suaoSUAOx"}


def _plan(codes: str) -> tuple[int, str]:
    n = len(codes)
    # open_at[4 * i + p]: least cost of the turns from i on, after a retained turn of role p, plus the deletions before i
    open_at = array("q", bytes(32 * (n + 1)))
    least = [_DELETE * n + _INSERT * _BETWEEN[p][3] for p in range(4)]
    open_at[4 * n :] = array("q", least)
    for i in range(n - 1, -1, -1):
        after = tuple(least)
        for role, cost, _ in _CHOICES[codes[i]]:
            on = cost + after[role] - _DELETE  # the deletions before i, not before i + 1
            for p in range(4):
                if (found := on + _INSERT * _BETWEEN[p][role - 1]) < least[p]:
                    least[p] = found
        open_at[4 * i : 4 * i + 4] = array("q", least)
    role, out = _START, []
    for i, code in enumerate(codes):
        want, then = open_at[4 * i + role], open_at[4 * i + 4 : 4 * i + 8]
        if then[role] == want:
            out.append("D")
            continue
        found = min(
            ("I" * _BETWEEN[role][q - 1] + letter, q) for q, cost, letter in _CHOICES[code]
            if _BETWEEN[role][q - 1] < _NEVER and cost + then[q] - _DELETE + _INSERT * _BETWEEN[role][q - 1] == want
        )
        out.append(found[0])
        role = found[1]
    return open_at[_START], "".join(out) + "I" * _BETWEEN[role][3]


_short_plan = lru_cache(1 << 14)(_plan)


def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; of equally cheap ones the least audit.

    codes: a letter a turn: s, u, a or o for its role (any other), in upper case if it breaks off, x if it must go.
    """
    return (_short_plan if len(codes) <= _SHORT else _plan)(codes)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults set by a checksum of conv_id and turn: one turn in twenty each is dropped, emptied, robbed of its full stops, repeated, or given to the user. A null is one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", _digest())


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation.

    rows: conv_id, turn, role, text; other columns play no part, a null role or text counts as empty.
    Turns stand by turn, null first, then by a digest of role and text. A null conv_id is a
    conversation of its own. A turn is blank, or repeats role and text of an earlier one, or breaks off
    without a full stop, whichever holds first. Nothing but digests and flags is shuffled; repeats are
    found by a window within the same partitions, and a conversation's turns pass one at a time.
    """
    bare = F.btrim("text", F.lit(_BLANKS))
    first = F.substring("role", 1, 1)
    letter = F.when(first.isin(*_ROLE), first).otherwise("o")
    flags = _ordered(rows).select(
        "conv_id", "turn", "digest", letter.alias("letter"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("broken"),
    )
    dealt = flags.repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("broken"), "t").otherwise(" ")
    marked = dealt.withColumn("again", earlier).withColumn("fault", fault)
    placed = marked.sortWithinPartitions("conv_id", "turn", "digest", "again").select("conv_id", "turn", "letter", "fault")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, letters, faults = None, None, bytearray(), bytearray()

        def finish() -> tuple:
            first, last, distinct = turns
            said, wrong = letters.decode(), faults.decode()
            codes = "".join("x" if f in "bd" else c.upper() if f == "t" else c for c, f in zip(said, wrong, strict=True))
            legal = said.count("su") + said.count("ua") + said.count("au")  # no two overlap with themselves
            cost, audit = cheapest(codes)
            return conv, (last - first + 1 - distinct) if distinct else 0, wrong.count("b"), wrong.count("d"), wrong.count("t"), len(said) - 1 - legal, cost, audit

        for batch in batches:
            out = []
            for c, turn, letter, f in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if turns is None or c != conv:
                    if turns is not None:
                        out.append(finish())
                    conv, turns, letters, faults = c, (None, None, 0), bytearray(), bytearray()
                letters += letter.encode()
                faults += f.encode()
                if turn is not None and turn != turns[1]:
                    turns = (turn if turns[0] is None else turns[0], turn, turns[2] + 1)
            if out:
                yield _batch(out, _PLAN)
        if turns is not None:
            yield _batch([finish()], _PLAN)

    return placed.mapInArrow(walk, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


_PLAN = {"conv_id": pa.int64(), **{c: pa.int64() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}, "audit": pa.string()}
_TURN = {"conv_id": pa.int64(), "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text of the turns after repair, in order within a partition.

    planned: ``plans`` of the same rows. A conversation's plan stands before its turns in the sorted
    partition; a turn is passed on or dropped as it is read, and none is held.
    """
    steps = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("role"), F.col("audit").alias("text"))
    turns = _ordered(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    placed = steps.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest").select("conv_id", "kind", "role", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, role = None, "", 0, 0, _START

        def inserted() -> Iterator[tuple]:
            nonlocal at, place, role
            while at < len(audit) and audit[at] == "I":
                role = _ASSISTANT if role == _USER else _USER
                yield conv, place, "I", "assistant" if role == _ASSISTANT else "user", ""
                at, place = at + 1, place + 1

        for batch in batches:
            out, size = [], 0
            for c, kind, said, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if kind == 0:
                    conv, audit, at, place, role = c, text, 0, 0, _START
                    out += inserted()
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    role = _ROLE[said[0]]
                elif edit == "R":
                    role = _ASSISTANT if role == _USER else _USER
                    said = "assistant" if role == _ASSISTANT else "user"
                if edit != "D":
                    out.append((conv, place, edit, said, text))
                    place, size = place + 1, size + len(text)
                out += inserted()
                if size > 1 << 20:
                    yield _batch(out, _TURN)
                    out, size = [], 0
            if out:
                yield _batch(out, _TURN)

    return placed.mapInArrow(walk, "conv_id long, place long, edit string, role string, text string")


def text_digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of ``role:text`` of each turn, with line feeds between. turns: as ``repaired`` gives them; no shuffle."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h = None, None
        for batch in batches:
            out = []
            for c, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if place == 0:
                    if h is not None:
                        out.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if out:
                yield _batch(out, {"conv_id": pa.int64(), "sha256": pa.string()})
        if h is not None:
            yield _batch([(conv, h.hexdigest())], {"conv_id": pa.int64(), "sha256": pa.string()})

    return turns.select("conv_id", "place", "role", "text").mapInArrow(walk, "conv_id long, sha256 string")
