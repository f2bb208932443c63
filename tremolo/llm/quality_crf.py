"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line is described by its own measures and those of its neighbours. Training takes whole labelled
documents, each line bearing its document's label, and ascends the conditional likelihood. A
document's score is the mean over its lines, weighted by their length in bytes, of the
forward-backward marginal of "good".
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremolo.llm.textkit import SEPARATOR, annotate, buffers, lines, mix, owner, prefix_hash, span_hash, totals, words

_U64 = np.uint64
_UPPER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[list(b"#*$%&<>")] = True
FIELDS = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
TRAIN_ROWS, STEPS, OWN = 4000, 160, 11


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line that has a word, its length, and the index of each text's first such line."""
    s, e, first = lines(data, off)
    ws, we, _ = words(data, off)
    wf = np.searchsorted(ws, np.append(s, len(data)))
    wf[:-1], wt = np.searchsorted(ws, s), np.searchsorted(ws, e)
    real = wt > wf[:-1]
    first = np.concatenate([[0], np.cumsum(totals(real, first))])
    s, e, wf, wt = s[real], e[real], wf[:-1][real], wt[real]
    size = (e - s).astype(float)
    n = len(off) - 1
    run = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    share = lambda flag, r=None: ((r := run(flag))[e] - r[s]) / size
    prefix = prefix_hash(data)
    n_words = (wt - wf).astype(float)
    h = span_hash(prefix, ws, we)
    line_of = np.repeat(np.arange(len(s)), wt - wf)
    own = np.concatenate([np.arange(a, b) for a, b in zip(wf, wt, strict=True)]) if len(wf) and (wf[0] != 0 or wt[-1] != len(ws) or (wf[1:] != wt[:-1]).any()) else np.arange(wf[0] if len(wf) else 0, wt[-1] if len(wt) else 0)
    _, at = np.unique(mix(h[own] ^ mix(line_of.astype(_U64))), return_index=True)
    distinct = np.bincount(line_of[at], minlength=len(s))
    lh = span_hash(prefix, s, e)
    doc = owner(first)
    _, inverse, count = np.unique(mix(lh ^ mix(doc.astype(_U64))), return_inverse=True, return_counts=True)
    f = np.zeros((len(s), OWN))
    if len(s):
        f[:, 0] = np.log1p(size) / 5
        f[:, 1] = share(_UPPER[data])
        f[:, 2] = np.minimum(1, 4 * share(_SYMBOL[data]))
        f[:, 3] = np.minimum(1, 5 * share(data == 33))
        f[:, 4] = np.minimum(1, 5 * share(data == 124))
        f[:, 5] = share(_DIGIT[data])
        f[:, 6] = share(data >= 128)
        f[:, 7] = (size / n_words) / 10
        f[:, 8] = 1 - distinct / n_words
        f[:, 9] = count[inverse] > 1
        f[:, 10] = share(SEPARATOR[data])
    before, after = np.zeros_like(f), np.zeros_like(f)
    if len(s) > 1:
        joined = (doc[1:] == doc[:-1])[:, None]
        before[1:], after[:-1] = f[:-1] * joined, f[1:] * joined
    edge = np.zeros((len(s), 3))
    edge[:, 0] = 1
    starts, stops = first[:-1][first[:-1] < first[1:]], first[1:][first[:-1] < first[1:]] - 1
    edge[starts, 1], edge[stops, 2] = 1, 1
    assert n == len(first) - 1
    return np.hstack([f, before[:, 1:10], after[:, 1:10], edge]), size, first


WIDTH = OWN + 9 + 9 + 3


def marginals(potential: np.ndarray, first: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transitions over all lines, by forward-backward in step over all texts.

    potential: log-odds of good; change: 2 x 2 transition scores, from row to column.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], first[:-1][order]
    longest = int(n[0]) if len(n) else 0
    pot = np.stack([np.zeros(len(potential)), potential], axis=1)
    weight = np.exp(change)
    ahead, back = np.zeros((len(potential), 2)), np.zeros((len(potential), 2))
    state = np.exp(pot - pot.max(axis=1, keepdims=True))
    alive = [int(np.searchsorted(-n, -t, "left")) for t in range(longest)]
    for t in range(longest):
        at = start[: alive[t]] + t
        a = state[at] if t == 0 else state[at] * (ahead[at - 1] @ weight)
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    sums = np.zeros((2, 2))
    for t in reversed(range(longest)):
        k = alive[t + 1] if t + 1 < longest else 0
        at = start[: alive[t]] + t
        b = np.ones((len(at), 2))
        if k:
            nxt = at[:k] + 1
            b[:k] = (state[nxt] * back[nxt]) @ weight.T
            both = ahead[at[:k]][:, :, None] * weight[None] * (state[nxt] * back[nxt])[:, None, :]
            sums += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / np.maximum(both.sum(axis=1), 1e-300), sums


def train(texts: list[str], labels: list[int]) -> dict:
    """Weights of lines and transitions by Adam on the penalised conditional likelihood; the share of good texts serves texts without a line."""
    if not texts:
        return {"w": np.zeros(WIDTH), "change": np.zeros((2, 2)), "prior": 0.5}
    parts, sizes = [], [np.zeros(1, np.int64)]
    for at in range(0, len(texts), 256):
        raw = [t.encode() for t in texts[at : at + 256]]
        x, _, first = features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        parts.append(x)
        sizes.append(np.diff(first))
    x, first = np.vstack(parts), np.cumsum(np.concatenate(sizes))
    y = np.asarray(labels)[owner(first)]
    n = np.diff(first)
    per_line = (1 / np.maximum(n, 1))[owner(first)] ** 0.5
    stay = np.zeros((2, 2))
    for c in (0, 1):
        stay[c, c] = np.maximum(n[np.asarray(labels) == c] - 1, 0).sum()
    w, change = np.zeros(WIDTH), np.zeros((2, 2))
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    scale = max(1, len(texts))
    for step in range(1, STEPS + 1):
        p, moved = marginals(x @ w, first, change)
        g = np.concatenate([x.T @ ((y - p) * per_line) / scale - 2e-4 * w, ((stay - moved) / max(1, stay.sum()) - 2e-2 * change).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        move = 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-9) * (0.5 if step > STEPS // 2 else 1)
        w, change = w + move[:WIDTH], np.clip(change + move[WIDTH:].reshape(2, 2), -2, 2)
    return {"w": w, "change": change, "prior": float(np.mean(labels))}


def quality_crf(df: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns of df by default), score (0 to 1) and predicted (score >= 0.5), for each row of df.

    A text without a line that has a word (null and empty ones too) scores the share of good
    training documents (0.5 without any). Repeated rows score alike; a very long text is scored whole; a
    score of just 0.5 counts as good; an empty table gives an empty result. Columns of df named score or predicted are replaced.
    """

    def kernel(batch, _):
        data, off = buffers(batch.column(0))
        x, size, first = features(data, off)
        p, _ = marginals(x @ model["w"], first, model["change"])
        mass = totals(size, first)
        score = np.where(mass > 0, totals(p * size, first) / np.maximum(mass, 1), model["prior"])
        score = np.round(np.clip(score, 0, 1), 9)
        return [score, (score >= 0.5).astype(np.int32)]

    return annotate(df, df.columns if keep is None else keep, FIELDS, kernel, text)
