"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Terms are words (runs of letters and digits, A-Z as a-z) and their first PREFIX bytes. The vocabulary
holds every term of the labelled examples; document frequencies are counted over the whole corpus. A
term weighs its count times its inverse document frequency times a relevance factor: one plus its
standardised excess under label 1 among the examples, at least one, so no term is left out. Plain
TF-IDF (a factor of one) finds too few toxic texts of small languages; the README has the figures.

Examples are laid out by likeness in blocks of BLOCK. For every term and block that meet, the index
knows the postings and their largest weight. A block whose bound can't reach the k-th cosine
is skipped, so the k nearest examples are exact. Their votes, weighted by similarity, give the
score; they are the evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm import textkit
from tremolo.llm.textkit import LOWER, annotate, bound_batches, buffers, mix, prefix_hash, slices, span_hash

_U64 = np.uint64
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
PREFIX = 6
#: Bounds: labelled examples, nearest examples, examples in a block of the index, queries answered together.
EXAMPLES, NEAREST, BLOCK, TOGETHER = 12000, 15, 256, 256
#: Postings that the driver handles at a time.
PART = 1 << 19
#: Bytes of the examples' texts, which bound their terms.
EXAMPLE_BYTES = 96 << 20
#: Terms of more than this share of the examples have their weights in rows, all others in lists; kinds of examples in the layout.
DENSE, KINDS = 0.05, 16
#: Cosines are compared to this many decimals, ties by doc_id.
DECIMALS = 5
FIELDS = [
    ("score", T.DoubleType()), ("predicted", T.IntegerType()),
    ("evidence", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())]))),
]


def term_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term, and the text it stands in."""
    data = LOWER[data]
    if not len(data):
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    inside = _WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[off < len(data)]] = False
    after[off[off > 0] - 1] = False
    s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    prefix, of = prefix_hash(data), np.searchsorted(off, s, "right") - 1
    longer = e - s > PREFIX
    short = mix(span_hash(prefix, s[longer], s[longer] + PREFIX) + _U64(PREFIX))
    return np.concatenate([span_hash(prefix, s, e), short]), np.concatenate([of, of[longer]])


def known_terms(data: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the vocabulary's terms, by text, then term."""
    h, of = term_hashes(data, off)
    h, place = np.unique(h, return_inverse=True)
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    term = np.where(vocabulary[at] == h, at, -1)[place] if len(vocabulary) else np.full(len(place), -1)
    known = term >= 0
    n = max(1, len(vocabulary))
    pair, count = np.unique(of[known] * np.int64(n) + term[known], return_counts=True)
    return pair // n, pair % n, count


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int = EXAMPLES, most_bytes: int = EXAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out fold with at most ``most_bytes`` of text, one row an identifier."""
    return textkit.labelled_texts(docs, labels, label, modulus, remainder, most, most_bytes)


def train(examples: DataFrame) -> dict:
    """What is learned from the examples (doc_id, text, label): all their terms, with counts, and each term's relevance factor.

    The number of examples must be bounded: their term counts, not their texts, reach the driver.
    Examples without a term take no part. Repeated rows count as often as they stand.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, of = term_hashes(*buffers(part.column(1)))
                own = [np.unique(h[of == k], return_counts=True) for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([x.tobytes() for x, _ in own], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in own], pa.binary())],
                    ["doc_id", "label", "terms", "counts"],
                )

    bound_batches(examples.sparkSession)
    source = examples.select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int"))
    found = source.mapInArrow(run, "doc_id long, label int, terms binary, counts binary")
    rows = found.toArrow()
    ids, labels = rows.column("doc_id").to_numpy().astype(np.int64), rows.column("label").to_numpy().astype(np.int32)
    size = np.concatenate([pc.binary_length(c).to_numpy().astype(np.int64) // 8 for c in rows.column("terms").chunks] or [np.zeros(0, np.int64)])
    every, count = _joined(rows.column("terms"), _U64), _joined(rows.column("counts"), np.dtype("<i4")).astype(np.float32)
    del rows
    # in the order of doc_id; repeated ones by their number of terms and least hash, so that equal rows alone are interchangeable
    end = np.cumsum(size)
    least = np.append(every, _U64(0))[end - size] if len(size) else np.zeros(0, _U64)
    order = np.lexsort((least, size, ids))
    at, size = spread((end - size)[order], end[order])
    every, count, ids, labels = every[at], count[at], ids[order], labels[order]
    del at
    vocabulary = np.unique(every)
    term = np.searchsorted(vocabulary, every).astype(np.int32)
    del every
    example = np.repeat(np.arange(len(size), dtype=np.int32), size)
    return {
        "ids": ids, "labels": labels, "prior": float(labels.mean()) if len(labels) else 0.0, "vocabulary": vocabulary,
        "example": example, "term": term, "count": count, "relevance": relevance(term, labels[example], labels, len(vocabulary)),
    }


def _joined(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """All values of the cells of a binary column, in order, without a copy of each cell."""
    out = [np.zeros(0, kind)]
    for c in column.chunks:
        if len(c):
            off = np.frombuffer(c.buffers()[1], np.int32 if pa.types.is_binary(c.type) else np.int64)[c.offset : c.offset + len(c) + 1]
            out.append(np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind) if off[-1] > off[0] else np.zeros(0, kind))
    return np.concatenate(out)


def relevance(term: np.ndarray, label: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """One plus the standardised excess of label 1 among the examples that hold the term, at least one."""
    n, p = len(labels), labels.mean() if len(labels) else 0.0
    df, a = np.bincount(term, minlength=n_terms), np.bincount(term, weights=label, minlength=n_terms)
    spread = np.sqrt(np.maximum(df * p * (1 - p) * (1 - df / max(n, 1)), 1e-9))
    return np.where(0 < p < 1, 1 + np.maximum(a - df * p, 0) / spread * (df < n), 1.0)


def document_frequencies(df: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of texts, and in how many each term of the vocabulary stands, over all of df."""
    if not len(vocabulary):
        return 0, np.zeros(0)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        found = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                found[:-1] += np.bincount(known_terms(*buffers(part.column(0)), known)[1], minlength=len(known))
                found[-1] += part.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["term", "n"])

    bound_batches(df.sparkSession)
    rows = df.select(textkit.quoted(text).cast("string").alias("t")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    shared.destroy()
    return int(out[-1]), out[:-1]


def weigh(text: np.ndarray, count: np.ndarray, factor: np.ndarray, n: int) -> np.ndarray:
    """Unit-length weights; text: the owner of each term, factor: the term's. The weights are of single precision."""
    w = np.multiply(count, factor, dtype=np.float32)
    norm = np.zeros(n)
    for at in range(0, len(w), PART):  # the driver weighs all examples at once
        norm += np.bincount(text[at : at + PART], weights=np.square(w[at : at + PART]), minlength=n)
    norm = np.sqrt(norm).astype(np.float32)
    for at in range(0, len(w), PART):
        w[at : at + PART] /= norm[text[at : at + PART]]
    return w


class BlockMaxIndex:
    """Weights of terms in examples: rows for frequent terms, lists in blocks for all others, and the largest of every block."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, n_examples: int):
        """By example, then term."""
        self.span, self.n, self.n_blocks = BLOCK, n_examples, -(-n_examples // BLOCK)
        df = np.bincount(term, minlength=n_terms)
        frequent = np.flatnonzero(df > DENSE * n_examples)
        self.row = np.full(n_terms, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.layout = self._layout(example, term, weight, len(frequent))
        place = np.argsort(self.layout).astype(np.int32)
        self.dense = None
        head = np.flatnonzero(self.row[term] >= 0)
        self.head = (self.row[term[head]], place[example[head]], weight[head])
        size = len(term) - len(head)
        del head
        self.example, self.weight, sorted_term = np.empty(size, np.int32), np.empty(size, np.float32), np.empty(size, np.int32)
        listed, done = np.where(self.row >= 0, 0, df), 0
        for lo, hi in self._ranges(listed):  # in parts, as all places at once would take more than the lists themselves
            own = np.flatnonzero((term >= lo) & (term < hi) & (self.row[term] < 0))
            order = own[np.lexsort((place[example[own]], term[own]))]
            to = slice(done, done + len(order))
            self.example[to], self.weight[to], sorted_term[to] = place[example[order]], weight[order], term[order]
            done += len(order)
        term, block = sorted_term, self.example // self.span
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        #: of each (term, block) that meet: its postings, block and largest weight; of each term: its first pair
        self.begin, self.block = np.append(first, len(term)).astype(np.int32), block[first].astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.pairs = np.searchsorted(term[first], np.arange(n_terms + 1)).astype(np.int32)

    @staticmethod
    def _ranges(listed: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of terms with about PART postings each."""
        ends = np.searchsorted(np.cumsum(listed), np.arange(PART, int(listed.sum()) + PART, PART))
        ends = np.unique(np.append(np.minimum(ends + 1, len(listed)), len(listed)))
        return list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))

    def _layout(self, example, term, weight, n_rows) -> np.ndarray:
        """The examples by likeness in their frequent terms (spherical k-means from evenly spaced ones), so that a block is of one kind."""
        x = np.zeros((self.n, n_rows), np.float32)
        row = self.row[term]
        at = np.flatnonzero(row >= 0)
        x[example[at], row[at]] = weight[at]
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        centre = x[np.linspace(0, max(self.n - 1, 0), min(KINDS, self.n)).astype(np.int64)] if self.n else x
        kind = np.zeros(self.n, np.int64)
        for _ in range(6 if self.n else 0):
            kind = (x @ centre.T).argmax(axis=1)
            centre = np.stack([x[kind == k].sum(axis=0) if (kind == k).any() else centre[k] for k in range(len(centre))])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        return np.argsort(kind, kind="stable")

    def _open(self) -> None:
        """The rows and the lists as they are read, made where they are used."""
        row, example, weight = self.head
        self.dense = np.zeros((self.n_blocks, int((self.row >= 0).sum()), self.span), np.float32)
        self.dense[example // self.span, row, example % self.span] = weight
        self.dense_top = self.dense.max(axis=2).T
        #: example (low half) and weight (high half) side by side, so that a list is read once
        self.posting = np.stack([self.example, self.weight.view(np.int32)], axis=1).view("<i8").ravel()
        self.head = self.example = self.weight = None

    def nearest(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n texts the k examples of largest positive cosine with these, ties to the smaller example; by text."""
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        if self.dense is None:
            self._open()
        row = self.row[term]
        rows = np.zeros((n, self.dense.shape[1]), np.float32)
        rows[text[row >= 0], row[row >= 0]] = weight[row >= 0]
        text, term, weight = text[row < 0], term[row < 0], weight[row < 0]
        pair, size = spread(self.pairs[term], self.pairs[term + 1])
        text, weight, block = np.repeat(text, size), np.repeat(weight, size), self.block[pair]
        ends = np.searchsorted(text, np.arange(n + 1))
        bound = rows @ self.dense_top + np.bincount(text * self.n_blocks + block, weights=weight * self.top[pair], minlength=n * self.n_blocks).reshape(n, -1)
        scores = np.full((n, self.n_blocks * self.span), -1, np.float32)

        def read(open_):
            """Adds the lists of open blocks, text by text, so that they stay in the processor's cache; neighbouring blocks of a term are one run."""
            for q in np.flatnonzero(open_.any(axis=1)).tolist():
                own = np.flatnonzero(open_[q][block[ends[q] : ends[q + 1]]]) + ends[q]
                if len(own):
                    p, w = pair[own], weight[own]
                    first = np.flatnonzero(np.append(True, (p[1:] != p[:-1] + 1) | (w[1:] != w[:-1])))
                    at, size = spread(self.begin[p[first]], self.begin[p[np.append(first[1:], len(p)) - 1] + 1])
                    posting, value = self.posting[at], np.repeat(w[first], size)
                    value *= posting.view("<f4")[1::2]
                    scores[q] += np.bincount(posting & 0xFFFFFFFF, weights=value, minlength=scores.shape[1])

        lead = bound.argmax(axis=1)
        best = np.zeros_like(bound, bool)
        best[np.arange(n), lead] = True
        for q, b in enumerate(lead.tolist()):  # few texts share their first block, so that a product over all rows would mostly add zeros
            use = np.flatnonzero(rows[q])
            scores[q, b * self.span : (b + 1) * self.span] = rows[q, use] @ self.dense[b, use]
        read(best)
        first = scores.reshape(n, self.n_blocks, self.span)[np.arange(n), lead]
        least = np.partition(first, self.span - k, axis=1)[:, self.span - k] if k <= self.span else np.zeros(n)
        least = np.maximum(least, 0) - 10.0**-DECIMALS
        rest = (bound >= least[:, None]) & (bound > 0) & ~best
        for b in np.flatnonzero(rest.any(axis=0)).tolist():
            q = np.flatnonzero(rest[:, b])
            scores[q, b * self.span : (b + 1) * self.span] = rows[q] @ self.dense[b]
        read(rest)
        out = []
        for s, bar in zip(scores, least, strict=True):
            at = np.flatnonzero(s >= bar)
            value = np.round(s[at].astype(float), DECIMALS)
            use = (value > 0) & (at < self.n)
            value, name = value[use], self.layout[at[use]]
            order = np.lexsort((name, -value))[:k]
            out.append((name[order], value[order]))
        return out


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the runs from lo to hi, and the length of each run."""
    size = hi - lo
    return np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size), size


def index(model: dict, n_docs: int, frequency: np.ndarray) -> dict:
    """Everything that scoring needs; its size is bounded by the examples."""
    factor = ((np.log((1 + n_docs) / (1 + frequency)) + 1) * model["relevance"]).astype(np.float32)
    n = len(model["labels"])
    weight = weigh(model["example"], model["count"], factor[model["term"]], n)
    return {
        "vocabulary": model["vocabulary"], "factor": factor, "labels": model["labels"], "ids": model["ids"], "prior": model["prior"],
        "index": BlockMaxIndex(model["example"], model["term"], weight, len(factor), n),
    }


def toxicity(df: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns of df by default), score (0 to 1), predicted (score >= 0.5) and evidence for each row of df.

    evidence: the nearest examples (doc_id, similarity, label), nearest first, ties to the smaller
    doc_id; similarity is the cosine over the examples' terms. A text without one of these terms (null
    and empty ones too) has no evidence; its score is the share of toxic examples, but below 0.5, as
    is every score without an example. Repeated rows score alike; an empty table gives an empty
    result; a very long text is scored whole. Columns of df that bear these names are replaced.
    """
    n_docs, frequency = document_frequencies(df, text, model["vocabulary"])
    shared = df.sparkSession.sparkContext.broadcast(index(model, n_docs, frequency))

    def kernel(batch, _):
        m = shared.value
        scores, evidence = [], []
        step = -(-batch.num_rows // -(-batch.num_rows // TOGETHER))
        for lo in range(0, batch.num_rows, step):
            part = batch.column(0).slice(lo, step)
            of, term, count = known_terms(*buffers(part), m["vocabulary"])
            weight = weigh(of, count, m["factor"][term], len(part))
            for name, value in m["index"].nearest(of, term, weight, len(part), NEAREST):
                label, mass = m["labels"][name], value.sum()
                scores.append((float(value @ label) + 0.1 * m["prior"]) / (mass + 0.1) if len(name) else min(m["prior"], 0.499))
                evidence.append([{"doc_id": int(m["ids"][x]), "similarity": float(s), "label": int(y)} for x, s, y in zip(name, value, label, strict=True)])
        scores = np.round(np.clip(np.array(scores, float), 0, 1), 9)
        return [scores, (scores >= 0.5).astype(np.int32), pa.array(evidence, EVIDENCE)]

    return annotate(df, df.columns if keep is None else keep, FIELDS, kernel, text)


EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
