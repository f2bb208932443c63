"""The trie and the repair of conversations against plain Python and SQL."""

import hashlib
import random
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import duck, same
from tremolo.llm import queries, repair, trie
from tremolo.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
AWKWARD = [
    (5, 0, "user", "a"), (5, 1, "assistant", "b."), (5, 1, "assistant", "b."), (6, None, None, None), (6, 0, "user", ""), (7, 3, "User", "é日. "), (8, 0, "tool", " "),
    (-3, 0, "user", "a"), (None, 1, "user", "x"), (None, None, "assistant", "y"), (11, 0, "system", "s"), (12, 9, "user", "long " * 60000), (10, 0, "user", "a"), (13, 0, "user", "a"),
]


def table(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA + ", `key` string, `a.b` int").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_conversation_repair"])
def test_queries_equal_their_sql(spark, name):
    same(queries.queries()[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_conversation_repair"])
def test_queries_on_awkward_rows(spark, tmp_path, name):
    d = table(spark, tmp_path, AWKWARD)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{d}/conversations.parquet/*.parquet')")
    same(queries.queries()[name](spark, d).toPandas(), db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_conversation_repair"])
def test_queries_on_no_rows(spark, tmp_path, name):
    assert queries.queries()[name](spark, table(spark, tmp_path, [])).count() == 0


def brute_trie(rows, family, borrowed):
    talks = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        talks.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, own in talks.items():
        h = crc32(str(c).encode()) % (borrowed + 1)
        rebuilt[c] = talks.get(c - c % family, [])[:h] + own[h:]
    nodes = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = {}
    for n, members in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in nodes)]
        saved = sum((len(nodes[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(n))
        kids = sum(len(x) == len(n) + 1 and x[: len(n)] == n for x in nodes)
        out[min(members), len(n)] = (min(nodes[n[:-1]]) if n else None, len(members), kids, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def test_trie_against_sets_of_prefixes(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 8)  # ids of a node come in many strings
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "x", "yé"])) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes, ends = trie.prefix_trie(trie.steps(trie.digests(df), family=5, borrowed=8))
    found = nodes.join(trie.joined_ids(ends), "key", "left").collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.sha256 or hashlib.sha256(b"").hexdigest()) for r in found}
    assert len(found) == len(got)
    assert got == brute_trie(rows, 5, 8)


def test_trie_of_plain_conversations_is_as_deep_as_the_longest(spark):
    df = spark.createDataFrame([(c, t, "user", f"{t}") for c in range(3) for t in range(300 - c)], SCHEMA)
    nodes, _ = trie.prefix_trie(trie.steps(trie.digests(df)))
    deep = {r.depth: r for r in nodes.collect()}
    assert len(deep) == 301
    assert (deep[300].n_convs, deep[299].n_convs, deep[298].n_convs, deep[0].n_leaves) == (1, 2, 3, 1)
    assert deep[0].saved == sum(2 * len(str(t)) for t in range(298)) + len("298")


def brute_plan(codes):
    """All edit scripts, the cheapest and then least."""
    able, best = {"": "su", "s": "u", "u": "a", "a": "u"}, [3 * len(codes) + 1, None]

    def go(i, state, cost, audit):
        if cost > best[0]:
            return
        if i == len(codes) and state in ("", "a") and (cost < best[0] or best[1] is None or audit < best[1]):
            best[:] = cost, audit
        if i < len(codes):
            c, own = codes[i], int(codes[i].isupper())
            go(i + 1, state, cost + 3, audit + "D")
            if c != "x":
                if c.lower() in able[state]:
                    go(i + 1, c.lower(), cost + own, audit + "K")
                for r in set("ua") & set(able[state]):
                    go(i + 1, r, cost + 2 + own, audit + "R")
        for r in set("ua") & set(able[state]):
            if cost + 2 <= best[0]:
                go(i, r, cost + 2, audit + "I")

    go(0, "", 0, "")
    return tuple(best)


def test_plans_against_all_scripts():
    rng = random.Random(11)
    for _ in range(300):
        codes = "".join(rng.choice("suaoSUAOxua") for _ in range(rng.randint(0, 5)))
        assert repair.cheapest(codes) == brute_plan(codes), codes


def test_long_plans_are_cut_alike():
    codes = "s" + "ua" * 4000 + "xoU"
    cost, audit = repair.cheapest(codes)
    assert (cost, len(audit.replace("I", ""))) == (3 + 2 + 1 + min(2, 3), len(codes)) or cost <= 9
    assert audit.startswith("K" * 8001)


def test_repaired_turns_are_legal_and_stream(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, "user", "So?"), (2, 0, "system", "Be."), (2, 1, "user", "A"), (2, 2, "user", "B."), (3, 0, "user", " ")]
    df = spark.createDataFrame(rows, SCHEMA)
    planned = repair.plans(df)
    told = {r.conv_id: r for r in planned.collect()}
    assert (told[1].duplicate, told[2].truncated, told[3].blank, told[3].audit) == (1, 1, 1, "D")
    turns = {}
    for r in repair.repaired(df, planned).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert 3 not in turns
    for said in turns.values():
        roles = [r for _, r, _ in said]
        assert roles == (["system"] if roles[0] == "system" else []) + ["user", "assistant"] * ((len(roles) - (roles[0] == "system")) // 2)
    digests = {r.conv_id: r.sha256 for r in repair.text_digests(repair.repaired(df, planned)).collect()}
    assert digests == {c: hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in said).encode()).hexdigest() for c, said in turns.items()}


def test_damage_is_set_by_the_checksum(spark):
    df = spark.createDataFrame([(c, t, "assistant", "a.b!") for c in range(40) for t in range(5)], SCHEMA)
    got = {}
    for r in repair.damaged(df).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c in range(40):
        for t in range(5):
            want = {0: None, 1: [("assistant", "")], 2: [("assistant", "ab")], 3: [("assistant", "a.b!")] * 2, 4: [("user", "a.b!")]}
            assert got.get((c, t)) == want.get(crc32(f"{c}:{t}".encode()) % 20, [("assistant", "a.b!")])
    assert repair.damaged(df.withColumn("text", F.lit(None).cast("string"))).where("text not in ('', ' ')").count() == 0
