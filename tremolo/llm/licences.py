"""Licence notices in texts: matching statistics over a generalised suffix automaton, chained into spans.

The automaton accepts every run of words of every template. A text streams through it: at each word
the state tells the longest run of words ending there that some template holds, and where. Matches of
at least three words that no template position lengthens are chained, template by template, in the
order of text and template; a chain that covers three quarters of its template is a span. Of spans
that overlap the one that covers most words stays.

Only words that follow each other in some template can lengthen a match, so the automaton walks runs
of such pairs and skips the rest of a text; this leaves nothing out. The pairs are found by hashes of
64 bits, then compared by their bytes.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremolo.llm.textkit import LOWER, annotate, buffers, prefix_hash, span_hash, words

#: Bytes that part words, as a class [\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased.
PARTS = np.array([c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F for c in range(256)])
#: Phrases whose places are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of public licence notices, and the labels of texts that hold them.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "licensed under the apache license, version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "this work is licensed under the gnu general public license, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
)

#: Words of a match that is chained.
LEAST = 3
#: Words of text between two matches of a chain at most.
GAP = 24
#: Share of a template's words that a span covers.
ENOUGH = 0.75


def split(text: str) -> list[bytes]:
    """Words of a text."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), PARTS)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends, strict=True)]


class Automaton:
    """Suffix automaton of several sequences of words.

    ``places[state]``: (template, end) of each place where the state's runs end. ``phrases[state]``:
    (phrase, length) of the phrases that end where the state's runs end, if the run is as long.
    """

    def __init__(self, templates: list[list[bytes]], phrases: list[list[bytes]]):
        self.templates = templates
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, own = [-1], [0], [set()]

        def state(length: int, moves: dict[bytes, int], link: int) -> int:
            self.next.append(moves)
            self.length.append(length)
            self.link.append(link)
            own.append(set())
            return len(self.length) - 1

        def split_off(p: int, word: bytes, q: int) -> int:
            """The state of p's longest run with word, parted from q where q also holds longer runs."""
            if self.length[q] == self.length[p] + 1:
                return q
            made = state(self.length[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = made
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = made
                p = self.link[p]
            return made

        for t, sequence in enumerate([*templates, *phrases]):
            last = 0
            for k, word in enumerate(sequence):
                if word in self.next[last]:
                    last = split_off(last, word, self.next[last][word])
                else:
                    new, p = state(self.length[last] + 1, {}, 0), last
                    while p >= 0 and word not in self.next[p]:
                        self.next[p][word] = new
                        p = self.link[p]
                    if p >= 0:
                        self.link[new] = split_off(p, word, self.next[p][word])
                    last = new
                if t < len(templates):
                    own[last].add((t, k))
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(by_length):
            if self.link[v] > 0:
                own[self.link[v]] |= own[v]
        self.places = [sorted(x) for x in own]
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in own]
        for p, sequence in enumerate(phrases):
            v = 0
            for word in sequence:
                v = self.next[v][word]
            self.phrases[v].append((p, len(sequence)))
        for v in by_length:
            if self.link[v] > 0:
                self.phrases[v] = self.phrases[v] + self.phrases[self.link[v]]

    def walk(self, run: list[bytes], at: int, found: list[tuple[int, int, int, int]], hits: list[tuple[int, int]]) -> None:
        """Reads a run of words that begins at word ``at``: adds matches (template, end in it, end in text, words) and phrases (place, phrase)."""
        v, length = 0, 0
        for i, word in enumerate(run):
            while v and word not in self.next[v]:
                v = self.link[v]
                length = self.length[v]
            if word not in self.next[v]:
                continue
            v, length = self.next[v][word], length + 1
            hits += [(at + i - size + 1, p) for p, size in self.phrases[v] if size <= length]
            after, u, most, seen = run[i + 1] if i + 1 < len(run) else None, v, length, set()
            while u > 0 and most >= LEAST:
                for t, k in self.places[u]:
                    if (t, k) not in seen:
                        seen.add((t, k))
                        own = self.templates[t]
                        if k + 1 == len(own) or own[k + 1] != after:  # nothing lengthens it
                            found.append((t, k + 1, at + i + 1, most))
                u = self.link[u]
                most = self.length[u]


def chains(matches: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """(covered words, template, first word, end) of the best chain from each match that begins one."""
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for t, k, end, size in matches:
        by_template.setdefault(t, []).append((end, k, size))
    out = []
    for t, found in by_template.items():
        found.sort()
        best: list[tuple[int, int]] = []  # (covered, first match) of the best chain that ends with each
        low, longest, top = 0, max(m[2] for m in found), {}
        for n, (end, k, size) in enumerate(found):
            start, cover, root = end - size, size, n
            while found[low][0] < end - longest - GAP:
                low += 1
            for j in range(low, n):
                e, kj, _ = found[j]
                if kj < k and e < end and start - e <= GAP:
                    if (gain := best[j][0] + min(size, end - e, k - kj)) > cover:
                        cover, root = gain, best[j][1]
            best.append((cover, root))
            if cover > top.get(root, (0, 0))[0]:
                top[root] = (cover, end)
        out += [(cover, t, found[root][0] - found[root][2], end) for root, (cover, end) in top.items()]
    return out


def spans(found: list[tuple[int, int, int, int]], sizes: list[int], labels: list[str]) -> list[tuple[str, int, int, int, float]]:
    """(label, first word, last word, covered, share) of chains that cover enough, without overlap, in order of place."""
    able = sorted((c for c in found if c[0] >= ENOUGH * sizes[c[1]]), key=lambda c: (-c[0], -c[0] / sizes[c[1]], c[2], c[1]))
    starts, kept = [], {}
    for cover, t, start, end in able:
        at = bisect.bisect_left(starts, end)
        if at and kept[starts[at - 1]][1] > start:
            continue
        starts.insert(at, start)
        kept[start] = (t, end, cover)
    return [(labels[t], s, end - 1, cover, cover / sizes[t]) for s in starts for t, end, cover in [kept[s]]]


class _Tables:
    def __init__(self, notices: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
        texts, self.labels = [split(t) for _, t in notices], [label for label, _ in notices]
        said, self.phrase_labels = [split(t) for t, _ in phrases], [label for _, label in phrases]
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton(texts, said)
        vocabulary = sorted({w for t in [*texts, *said] for w in t})
        joined = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary])
        hashes = span_hash(prefix_hash(joined), ends - [len(w) for w in vocabulary], ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = {vocabulary[k]: n for n, k in enumerate(order)}
        self.pairs = np.unique([place[a] * len(place) + place[b] for t in [*texts, *said] for a, b in zip(t[:-1], t[1:], strict=True)])


@lru_cache(4)
def _tables(notices: tuple, phrases: tuple) -> _Tables:
    return _Tables(notices, phrases)


def _runs(hashes: np.ndarray, first: np.ndarray, tables: _Tables) -> list[tuple[int, int]]:
    """(first word, end) of the runs in which each two neighbours stand together in some template or phrase; none crosses texts."""
    if len(hashes) < 2:
        return []
    place = np.minimum(np.searchsorted(tables.hashes, hashes), len(tables.hashes) - 1)
    known = np.flatnonzero(tables.hashes[place] == hashes)
    able = known[:-1][np.diff(known) == 1]
    pair = place[able] * len(tables.hashes) + place[able + 1]
    able = able[tables.pairs[np.minimum(np.searchsorted(tables.pairs, pair), len(tables.pairs) - 1)] == pair]
    able = able[~np.isin(able + 1, first)]
    if not len(able):
        return []
    breaks = np.flatnonzero(np.diff(able) != 1)
    return list(zip(able[np.concatenate([[0], breaks + 1])].tolist(), (able[np.concatenate([breaks, [len(able) - 1]])] + 2).tolist(), strict=True))


_SPAN = T.StructType([T.StructField("label", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("first_word", "last_word", "covered")], T.StructField("share", T.DoubleType())])
_FIELDS = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("spans", T.ArrayType(_SPAN))]
_ARROW_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))


def licences(df: DataFrame, keep: list[str] | None = None, text: str = "text", notices: tuple = NOTICES, phrases: tuple = PHRASES) -> DataFrame:
    """Adds n_words; n_base, first_word, last_word, base_labels of the phrases; labels (of phrases and spans), score, spans.

    score: the largest share of a notice that a chain covers, 1 where a phrase stands. Null and empty
    texts have no words, labels of "" and a score of 0. A text is read whole; one longer than a slice is
    a slice of its own. Columns of df that bear the new names are replaced.
    """

    def kernel(batch: pa.RecordBatch, tables: _Tables) -> list[pa.Array]:
        data, off = buffers(batch.column(0))
        data = LOWER[data]
        starts, ends, first = words(data, off, PARTS)
        n = np.diff(first)
        matches: dict[int, list] = {}
        hits: dict[int, list] = {}
        runs = _runs(span_hash(prefix_hash(data), starts, ends), first, tables)
        rows = np.searchsorted(first, [r[0] for r in runs], "right") - 1
        for (a, b), row in zip(runs, rows.tolist(), strict=True):
            run = [data[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            tables.automaton.walk(run, a - int(first[row]), matches.setdefault(row, []), hits.setdefault(row, []))
        out: list[list] = [[0] * len(n), [None] * len(n), [None] * len(n), [""] * len(n), [""] * len(n), [0.0] * len(n), [[] for _ in n]]
        for row in matches:
            said, found = hits[row], chains(matches[row], tables.sizes)
            kept = spans(found, tables.sizes, tables.labels)
            base = {tables.phrase_labels[p] for _, p in said}
            if said:
                out[0][row], out[1][row], out[2][row] = len(said), min(h[0] for h in said), max(h[0] for h in said)
            out[3][row], out[4][row] = ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in kept}))
            out[5][row] = 1.0 if said else max((min(1.0, c[0] / tables.sizes[c[1]]) for c in found), default=0.0)
            out[6][row] = [dict(zip(("label", "first_word", "last_word", "covered", "share"), s, strict=True)) for s in kept]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _ARROW_SPAN)
        return [pa.array(n, pa.int64()), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]]

    return annotate(df, df.columns if keep is None else keep, _FIELDS, kernel, text, setup=lambda: _tables(notices, phrases))
