"""Language-model scoring by context-tree weighting over bytes, beside add-one word frequencies.

A byte is eight binary decisions. Its contexts are the bytes before it, none to byte_contexts.DEPTH
of them, whole. Every node holds a Krichevsky-Trofimov estimate; block probabilities weight all depths
against each other by half, from the leaves up. The posterior weights give one probability for
each context and byte. A context that training never saw passes its parent's estimate on. A text
ends with a byte of its own (0xFF, never in UTF-8), so the probabilities of all texts sum to one.
The tree gains contexts with the corpus; byte_contexts counts, weighs and reads it in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm import byte_contexts
from tremolo.llm.textkit import LOWER, bound_batches, buffers, cut, mix, owner, slices, totals, word_hashes

#: Words whose counts are broadcast, the most frequent ones: a bound on memory. All others are joined.
HEAD_WORDS = 1 << 17
#: Word counts held in a task before they are passed on.
HELD = 1 << 20
_U64 = np.uint64


def gather(df: DataFrame, text: str, trains: str) -> DataFrame:
    """(key, n): counts of words, by hash, over all texts of the fold."""

    def merged(held):
        key, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(inverse, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def rows(key, n):
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)])], ["key", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "t"):
                data, off = buffers(part.column(0))
                held.append(np.unique(word_hashes(LOWER[data], off)[0], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from rows(*held[0])
                        held, size = [], 0
        if size:
            yield from rows(*merged(held))

    bound_batches(df.sparkSession)
    found = df.where(F.col(trains)).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInArrow(run, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5, to about 1e-12."""
    shift = np.log(x)
    for k in range(1, 8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _block(n: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n[..., 0] zeros and n[..., 1] ones."""
    return _log_gamma(n[..., 0] + 0.5) + _log_gamma(n[..., 1] + 0.5) - _log_gamma(n.sum(axis=-1) + 1) - np.log(np.pi)


def least_frequent_head(words: DataFrame) -> int:
    """The least count of at most HEAD_WORDS most frequent words, from a histogram of counts: eight steps a doubling, so a few hundred rows."""
    step = F.floor(F.log2("n") * 8)
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    held, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r.step):
        held += r.words
        if held > HEAD_WORDS:
            break
        least = r.least
    return least


FIELDS = [("text_key", T.LongType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("logs", T.DoubleType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType())]


def language_model(df: DataFrame, trains: str, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, keep, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for each row of df.

    trains: a boolean column; the rows where it is true teach both models. A null text is the empty
    text: one token (the end), one byte (the end). Tokens are words with A-Z as a-z, then an end.
    base_score adds log10((c + 1) / (N + V + 1)) over the tokens; with no training text N = V = 0.
    score is the log10 probability of the text's bytes and end under the context tree, bits_per_byte
    its code length. Words count by 64-bit hash. Repeated rows each get the same values; a text of any
    length is read whole; an empty table gives an empty result. Columns of df not in keep play no part.
    """
    keep = [c for c in (keep or []) if c not in (id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")]
    words = cut(gather(df, text, trains))
    size = df.agg(F.count(F.when(F.col(trains), 1)).alias("trained"), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("bytes")).first()
    docs_trained = size.trained
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, v_train = total.n + docs_trained, total.v + (1 if docs_trained else 0)
    least = least_frequent_head(words)
    head = words.where(F.col("n") >= least).select("key", "n").toPandas()
    h = head["key"].to_numpy().view(_U64)
    order = np.argsort(h)
    sent = df.sparkSession.sparkContext.broadcast({"head": h[order], "n": head["n"].to_numpy()[order], "end": docs_trained})
    source = df.select(F.col(id_col), *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def look(m, hashes):
        at = np.searchsorted(m["head"], hashes)
        at[at == len(m["head"])] = 0
        return np.where(m["head"][at] == hashes, m["n"][at], 0) if len(m["head"]) else np.zeros(len(hashes), np.int64)

    def score(batch, given):
        m = sent.value
        data, off = buffers(batch.column(0))
        hashes, first = word_hashes(LOWER[data], off)
        n = np.diff(first)
        c = look(m, hashes)
        value = totals(given, off + np.arange(len(off)))
        logs = totals(np.log10(c + 1.0), first) + np.log10(m["end"] + 1.0)
        key = text_keys(hashes, first, off)
        return [key, (n + 1).astype(np.int64), totals(c > 0, first) + (m["end"] > 0), logs, value, -value / np.log10(2) / (np.diff(off) + 1)]

    learnt = df.where(F.col(trains)).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    scored = byte_contexts.scored(source, learnt, [id_col, *keep], FIELDS, score, size.bytes)

    def rare(batches):
        m = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = buffers(part.column(0))
                hashes, first = word_hashes(LOWER[data], off)
                key = text_keys(hashes, first, off)
                at = np.flatnonzero(look(m, hashes) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[owner(first)[at]]), pa.array(hashes[at].view(np.int64))], ["text_key", "key"])

    if total.v > HEAD_WORDS:
        others = words.where(F.col("n") < least).select("key", "n")
        tail = source.select("text").mapInArrow(rare, "text_key long, key long").join(others, "key")
        per_text = tail.groupBy("text_key").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
        copies = scored.groupBy("text_key").agg(F.count("*").alias("copies"))
        scored = scored.join(per_text.join(copies, "text_key"), "text_key", "left")
    else:
        scored = scored.withColumns({"more": F.lit(0), "more_logs": F.lit(0.0), "copies": F.lit(1)})
    copies = F.coalesce("copies", F.lit(1))
    return scored.select(
        id_col, *keep, "n_tokens", (F.col("known") + F.coalesce(F.col("more") / copies, F.lit(0)).cast("long")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce(F.col("more_logs") / copies, F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n_train + v_train + 1))).alias("base_score"), "score", "bits_per_byte",
    )


def text_keys(hashes: np.ndarray, first: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A key of each text's sequence of words."""
    place = np.arange(len(hashes)) - first[owner(first)]
    run = np.concatenate([[_U64(0)], np.cumsum(mix(hashes ^ mix(place.astype(_U64))), dtype=_U64)])
    return mix(run[first[1:]] - run[first[:-1]] + np.diff(first).astype(_U64)).view(np.int64)
