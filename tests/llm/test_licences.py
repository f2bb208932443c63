"""The licence scan against searches by brute force."""

import random
import re

from tests.oracle import duck
from tremolo.llm import licences as L
from tremolo.llm import queries

SF = "/root/testdata/sf0.001"
TEMPLATES = [L.split(t) for _, t in L.NOTICES]
TABLES = L._tables(L.NOTICES, L.PHRASES)


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}).encode())


def places(w):
    return sorted((i, label) for p, label in L.PHRASES for q in [p.encode().split()] for i in range(len(w)) if w[i : i + len(q)] == q)


def brute_matches(run):
    out = set()
    for t, own in enumerate(TEMPLATES):
        for i in range(len(run)):
            for k in range(len(own)):
                if run[i] == own[k] and (i + 1 == len(run) or k + 1 == len(own) or run[i + 1] != own[k + 1]):
                    n = 0
                    while n <= min(i, k) and run[i - n] == own[k - n]:
                        n += 1
                    if n >= L.LEAST:
                        out.add((t, k + 1, i + 1, n))
    return out


def test_automaton_against_all_alignments():
    rng = random.Random(2)
    for _ in range(40):
        run = []
        while len(run) < 50:
            own = rng.choice(TEMPLATES)
            at = rng.randrange(len(own))
            run += own[at : at + rng.randint(1, 12)] + ([rng.choice([b"the", b"zz", b"license"])] if rng.random() < 0.3 else [])
        found, hits = [], []
        TABLES.automaton.walk(run, 0, found, hits)
        assert len(found) == len(set(found))
        assert set(found) == brute_matches(run)
        assert sorted((i, L.PHRASES[p][1]) for i, p in hits) == places(run)


def brute_chain(matches, t):
    """Most words that a chain of matches of one template covers, over all subsets in order."""
    own = sorted((end, k, size) for u, k, end, size in matches if u == t)
    best = [0] * len(own)
    for n, (end, k, size) in enumerate(own):
        best[n] = max([size] + [best[j] + min(size, end - e, k - kj) for j, (e, kj, _) in enumerate(own[:n]) if kj < k and e < end and end - size - e <= L.GAP])
    return max(best, default=0)


def test_chains_are_the_longest():
    rng = random.Random(4)
    for _ in range(30):
        run = []
        for _ in range(12):
            own = rng.choice(TEMPLATES[:4])
            at = rng.randrange(len(own))
            run += own[at : at + rng.randint(3, 20)] + [b"zz"] * rng.randint(0, 3)
        matches = brute_matches(run)
        found = L.chains(sorted(matches), TABLES.sizes)
        for t in {m[0] for m in matches}:
            assert max(c[0] for c in found if c[1] == t) == brute_chain(matches, t)


def test_query_against_plain_search(spark):
    got = {r.doc_id: r for r in queries.queries()["op13_licence_scan"](spark, SF).collect()}
    docs = duck(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(docs)
    for name, text in docs:
        w, r = words(text), got[name]
        at = places(w)
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
        assert ("cc-by-nc" in r.labels.split(",")) == (b"licensed under cc by nc 4 0" in b" ".join(w))


def test_awkward_texts(spark):
    notice = dict(L.NOTICES[::-1])["isc"]
    texts = {
        1: None, 2: "", 3: "...", 4: "MIT-License mit", 5: notice.upper(), 6: notice.replace("modify, and", "alter or"), 7: "The MIT license. " * 40000, 8: "mit", 9: "license", 10: "é日 apache\nlicense",
        11: notice[: len(notice) // 2], 12: f"{notice} {notice}", 13: "licensed under cc by 4.0 licensed under cc by-sa 4.0",
    }
    df = spark.createDataFrame([(k, v, "kept", 0.5) for k, v in texts.items()], "doc_id long, text string, `__text` string, `a.b` double").coalesce(1)
    df = df.unionByName(df)
    rows = L.licences(df).collect()
    assert len(rows) == 2 * len(texts)
    assert {r["__text"] for r in rows} == {"kept"} and {r["a.b"] for r in rows} == {0.5}
    got = {r.doc_id: r for r in rows}
    for k, v in texts.items():
        assert (got[k].n_words, got[k].n_base) == (len(words(v)), len(places(words(v))))
    assert [got[k].labels for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)] == ["", "", "", "mit", "isc", "isc", "mit", "", "", "apache", ""]
    assert [s.first_word for s in got[12].spans] == [0, len(words(notice))]
    assert got[13].labels == "cc-by,cc-by-sa"
    assert 0.4 < got[11].score < 0.75 and got[1].score == 0
    assert L.licences(df.where("false")).count() == 0
