"""DuckDB SQL for the operators that it can express over whole tables."""

_MIX = r"""
WITH RECURSIVE m AS (
  SELECT doc_id, source, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n,
         md5(coalesce(doc_id::VARCHAR, '')) || coalesce(doc_id::VARCHAR, '') AS place FROM documents),
t AS (SELECT s, sum(n)::BIGINT AS tok FROM m GROUP BY s),
a AS (SELECT sum(tok)::DOUBLE AS total, min(tok) FILTER (tok > 0)::DOUBLE AS least, list_sort(list(tok::DOUBLE) FILTER (tok > 0)) AS sizes FROM t),
b AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN high THEN mid ELSE lo END, CASE WHEN high THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               NOT (total * pow(least / total, (lo + hi) / 2) / list_sum(list_transform(sizes, lambda x: pow(x / total, (lo + hi) / 2))) / least <= 1.25) AS high
        FROM b, a WHERE i < 60)),
e AS (SELECT round(hi, 9) AS exponent FROM b WHERE i = 60),
z AS (SELECT exponent, total, list_sum(list_transform(sizes, lambda x: pow(x / total, exponent))) AS norm FROM e, a),
p AS (SELECT s, tok, exponent, CASE WHEN tok > 0 THEN pow(tok / total, exponent) / norm ELSE 0 END AS weight, total FROM t, z),
q AS (SELECT *, floor(total * weight + 1e-6)::BIGINT AS target FROM p),
g AS (SELECT s, place, sum(n) AS n FROM m GROUP BY s, place),
r AS (SELECT s, place, sum(n) OVER (PARTITION BY s ORDER BY place ROWS UNBOUNDED PRECEDING) - n AS ahead FROM g),
c AS (SELECT r.s, max(place) AS last_key FROM r JOIN q USING (s) WHERE tok > 0 AND target % tok > 0 AND ahead < target % tok GROUP BY r.s)
SELECT m.doc_id, m.source, m.n AS n_tokens, round(q.exponent, 6) AS exponent, round(q.weight, 6) AS weight,
       (CASE WHEN tok > 0 THEN target // tok ELSE 1 END + CASE WHEN place <= last_key THEN 1 ELSE 0 END)::BIGINT AS copies
FROM m JOIN q USING (s) LEFT JOIN c USING (s)
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) = 1 THEN [t[1]]
      ELSE list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, md5(array_to_string(list_sort(s), chr(10))) AS f, s FROM g),
r AS (SELECT f, min(doc_id) AS node, any_value(n_shingles) AS n, any_value(s) AS s FROM n WHERE n_shingles > 0 AND doc_id IS NOT NULL GROUP BY f),
e AS (SELECT node, n, unnest(s) AS x FROM r),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT node AS x, node AS y FROM r UNION SELECT reach.x, both_ways.b FROM reach JOIN both_ways ON reach.y = both_ways.a),
c AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY x)
SELECT n.doc_id, n.n_shingles, coalesce(c.component, n.doc_id) AS component_id, n.doc_id = coalesce(c.component, n.doc_id) AS kept
FROM n LEFT JOIN r ON n.f = r.f AND n.n_shingles > 0 LEFT JOIN c ON r.node = c.node
"""

_TOP = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM o WHERE rank <= 5
"""

_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
v AS (SELECT r, i, w, lead(w, 1) OVER p AS x, lead(w, 2) OVER p AS y FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, w, CASE WHEN y IS NOT NULL AND count(*) OVER (PARTITION BY r, w, x, y) > 1 THEN 1 ELSE 0 END AS again FROM v),
g AS (SELECT r, w, greatest(again, lag(again, 1, 0) OVER p, lag(again, 2, 0) OVER p) AS covered FROM f WINDOW p AS (PARTITION BY r ORDER BY i)),
ws AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(covered) AS n_repeat_words FROM g GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
ls AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
h AS (SELECT r, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, hex(encode(t)) AS h FROM d),
x AS (SELECT r, good, unnest(regexp_extract_all(h, '.{6}')) AS x FROM h UNION ALL SELECT r, good, unnest(regexp_extract_all(substr(h, 3), '.{6}')) FROM h
      UNION ALL SELECT r, good, unnest(regexp_extract_all(substr(h, 5), '.{6}')) FROM h),
b AS (SELECT r, good, ('0x' || x)::BIGINT * 2654435761 % 4294967296 // 65536 AS b, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT b, sum(n) AS every, coalesce(sum(n) FILTER (good), 0) AS good FROM b GROUP BY b),
z AS (SELECT sum(every) AS every, sum(good) AS good FROM c),
q AS (SELECT c.b, CASE WHEN z.good > 0 THEN ln((c.good + 1) / (z.good + 65536)) - ln((c.every + 1) / (z.every + 65536)) ELSE 0 END AS q FROM c, z),
m AS (SELECT r, round(sum(n * q) / sum(n), 6) AS log_ratio FROM b JOIN q USING (b) GROUP BY r),
o AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(log_ratio, 0)::DOUBLE AS log_ratio
      FROM d LEFT JOIN ws USING (r) LEFT JOIN ls USING (r) LEFT JOIN m USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, log_ratio,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND log_ratio >= -0.5 AS kept FROM o
"""

#: tab: the table of the checksum that zlib calls crc32; _crc(text) is the checksum of an ASCII text.
_TAB = "tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), n)) AS tab)"


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda q: ascii(q)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295), 4294967295)"


_TRIE = rf"""
WITH {_TAB},
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 5 AS b, {_crc("c::VARCHAR")} % 9 AS h FROM ids, tab),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
      FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT h.c, p, r, x FROM h JOIN o ON o.c = h.b WHERE p < h.h UNION ALL SELECT h.c, p, r, x FROM h JOIN o ON o.c = h.c WHERE p >= h.h),
d AS (SELECT c, row_number() OVER w AS depth, strlen(x) AS size, string_agg(md5(strlen(r) || ':' || r || x), '' ORDER BY p) OVER (PARTITION BY c ORDER BY p) AS key
      FROM n WINDOW w AS (PARTITION BY c ORDER BY p)),
s AS (SELECT c, depth, size, key FROM d UNION ALL SELECT c, 0, 0, '' FROM ids),
e AS (SELECT c, max(depth) AS depth FROM s GROUP BY c),
v AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, min(size) AS size FROM s GROUP BY key, depth),
u AS (SELECT v.*, p.conv_id AS parent_conv_id, q.key AS parent FROM v LEFT JOIN s q ON q.c = v.conv_id AND q.depth = v.depth - 1 LEFT JOIN v p ON p.key = q.key AND p.depth = q.depth),
k AS (SELECT parent AS key, depth - 1 AS depth, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY 1, 2),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k ON k.key = u.key AND k.depth = u.depth),
t AS (SELECT s.key, s.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w.size) AS saved_tokens FROM w JOIN s ON s.c = w.conv_id AND s.depth <= w.depth GROUP BY 1, 2),
z AS (SELECT s.key, s.depth, string_agg(s.c::VARCHAR, ',' ORDER BY s.c) AS ids FROM s JOIN e ON s.c = e.c AND s.depth = e.depth GROUP BY 1, 2)
SELECT conv_id, w.depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN t ON t.key = w.key AND t.depth = w.depth LEFT JOIN z ON z.key = w.key AND z.depth = w.depth
"""

_REPAIR = rf"""
WITH RECURSIVE {_TAB},
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, tab),
g AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
m AS (SELECT g, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM r JOIN g ON r.conv_id IS NOT DISTINCT FROM g.conv_id WHERE k <> 0),
y AS (SELECT g, turn, role, text, left(role, 1) AS f, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS i FROM m),
o AS (SELECT *, lag(f) OVER (PARTITION BY g ORDER BY i) AS before,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM y),
t AS (SELECT g, i, f, fault IN ('b', 'd') AS gone, CASE fault WHEN 't' THEN 1 ELSE 0 END AS broken FROM o),
b AS (
  SELECT g, 0::BIGINT AS i, {{'c': 0, 'x': ''}} AS z, {{'c': 1000000, 'x': ''}} AS s, {{'c': 1000000, 'x': ''}} AS u, {{'c': 1000000, 'x': ''}} AS a FROM g
  UNION ALL
  SELECT b.g, t.i, {{'c': z.c + 3, 'x': z.x || 'D'}},
    list_min([{{'c': s.c + 3, 'x': s.x || 'D'}}, {{'c': CASE WHEN gone OR f <> 's' THEN 1000000 ELSE z.c + broken END, 'x': z.x || 'K'}}]),
    list_min([{{'c': u.c + 3, 'x': u.x || 'D'}}, {{'c': CASE WHEN gone THEN 1000000 ELSE z.c + cu END, 'x': z.x || ku}}, {{'c': CASE WHEN gone THEN 1000000 ELSE s.c + cu END, 'x': s.x || ku}},
              {{'c': CASE WHEN gone THEN 1000000 ELSE a.c + cu END, 'x': a.x || ku}}, {{'c': CASE WHEN gone THEN 1000000 ELSE u.c + 2 + cu END, 'x': u.x || 'I' || ku}}]),
    list_min([{{'c': a.c + 3, 'x': a.x || 'D'}}, {{'c': CASE WHEN gone THEN 1000000 ELSE u.c + ca END, 'x': u.x || ka}}, {{'c': CASE WHEN gone THEN 1000000 ELSE z.c + 2 + ca END, 'x': z.x || 'I' || ka}},
              {{'c': CASE WHEN gone THEN 1000000 ELSE s.c + 2 + ca END, 'x': s.x || 'I' || ka}}, {{'c': CASE WHEN gone THEN 1000000 ELSE a.c + 2 + ca END, 'x': a.x || 'I' || ka}}])
  FROM b JOIN (SELECT *, broken + CASE f WHEN 'u' THEN 0 ELSE 2 END AS cu, CASE f WHEN 'u' THEN 'K' ELSE 'R' END AS ku, broken + CASE f WHEN 'a' THEN 0 ELSE 2 END AS ca, CASE f WHEN 'a' THEN 'K' ELSE 'R' END AS ka FROM t) t
  ON t.g = b.g AND t.i = b.i + 1),
n AS (SELECT g, max(i) AS n FROM b GROUP BY g),
p AS (SELECT b.g, list_min([z, {{'c': s.c + 4, 'x': s.x || 'II'}}, {{'c': u.c + 2, 'x': u.x || 'I'}}, a]) AS p FROM b JOIN n ON b.g = n.g AND b.i = n.n),
c AS (SELECT g, unnest(string_split(p.x, '')) AS ch, generate_subscripts(string_split(p.x, ''), 1) AS j FROM p WHERE p.x <> ''),
q AS (SELECT g, ch, j, sum(CASE ch WHEN 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE ch WHEN 'D' THEN 0 ELSE 1 END) OVER w AS place FROM c WINDOW w AS (PARTITION BY g ORDER BY j)),
l AS (SELECT q.*, o.role, o.text, max(CASE WHEN place = 1 AND ch = 'K' AND f = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.g) AS led FROM q LEFT JOIN o ON o.g = q.g AND o.i = q.i),
e AS (SELECT g, string_agg(CASE ch WHEN 'K' THEN role ELSE CASE WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE ch WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole FROM l WHERE ch <> 'D' GROUP BY g),
f AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (i > 1 AND before || f NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY g)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, p.p.c::BIGINT AS cost, p.p.x AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM g JOIN p ON p.g = g.g LEFT JOIN f ON f.g = g.g LEFT JOIN e ON e.g = g.g
"""

ORACLES = {"op4_quality_rules": _RULES, "op5_mix_sources": _MIX, "op8_near_duplicates": _NEAR, "op9_exact_top_k": _TOP, "op11_prefix_trie": _TRIE, "op12_conversation_repair": _REPAIR}
