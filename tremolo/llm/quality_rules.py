"""Quality rules: exact measures of a text, then a hashed n-gram log-likelihood ratio.

Every document's byte trigrams, hashed into BUCKETS buckets, are counted over the whole corpus and
over trusted documents. A document's verdict is the mean over its trigrams of
log p(trusted) - log p(corpus), at or above a fixed threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.textkit import SEPARATOR, annotate, bound_batches, buffers, lines, mix, owner, prefix_hash, quoted, slices, span_hash, totals, words

BUCKETS = 1 << 16
#: Trusted identifiers up to this number are broadcast, more are joined.
FEW_TRUSTED = 1 << 18
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U64 = np.uint64

FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("log_ratio", T.DoubleType()), ("kept", T.BooleanType())]


def distinct_per(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each owner has."""
    if not len(keys):
        return np.zeros(n, np.int64)
    _, at = np.unique(mix(keys ^ mix(of.astype(_U64))), return_index=True)
    return np.bincount(of[at], minlength=n)


def measures(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(off) - 1
    starts, ends, first = words(data, off)
    n_words = np.diff(first)
    prefix = prefix_hash(data)
    letters = ((data & 0xC0) != 0x80) & ~SEPARATOR[data]
    word_chars, n_symbols = totals(letters, off), totals(_SYMBOL[data], off)
    ls, le, lf = lines(data, off)
    real = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    of = owner(lf)[real]
    n_dup_lines = np.bincount(of, minlength=n) - distinct_per(span_hash(prefix, ls[real], le[real]), of, n)
    h, of = span_hash(prefix, starts, ends), owner(first)
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        whole = of[2:] == of[:-2]
        at = np.flatnonzero(whole)
        window = mix(mix(h[at] * _U64(0x9E3779B97F4A7C15) + h[at + 1]) * _U64(0xC2B2AE3D27D4EB4F) + h[at + 2])
        _, inverse, count = np.unique(mix(window ^ mix(of[at].astype(_U64))), return_inverse=True, return_counts=True)
        again = at[count[inverse] > 1]
        for k in range(3):
            covered[again + k] = True
    return n_words, word_chars, n_symbols, n_dup_lines, totals(covered, first)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each run of three bytes: the upper half of its 32-bit product with a fixed odd number."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    x = data.astype(np.uint32)
    return (((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def counts(df: DataFrame, text: str, trusted: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts of all texts and of the trusted ones: at most BUCKETS rows reach the driver."""

    def run(batches):
        both = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                data, off = buffers(part.column(0))
                grams = trigrams(data)
                inside = np.ones(len(data), bool)
                for k in (1, 2):
                    inside[off[off >= k] - k] = False
                grams, good = grams[inside[: len(grams)]], np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(off))[: len(grams)][inside[: len(grams)]]
                both[0] += np.bincount(grams, minlength=BUCKETS)
                both[1] += np.bincount(grams[good], minlength=BUCKETS)
        at = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(both[0][at]), pa.array(both[1][at])], ["bucket", "every", "good"])

    bound_batches(df.sparkSession)
    source = df.select(F.col(text).cast("string").alias("t"), F.col(trusted).alias("good"))
    found = source.mapInArrow(run, "bucket int, every long, good long").groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("good").alias("good")).toPandas()
    every, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    every[found["bucket"]], good[found["bucket"]] = found["every"], found["good"]
    return every, good


def quality_rules(df: DataFrame, trusted_ids: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, threshold: float = -0.5, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """keep (all columns of df by default) and the columns of FIELDS, for each row of df.

    trusted_ids: id_col of the trusted documents, any number. base_failed: fewer than min_words words,
    or more than repeat_percent per cent of them in repeated 3-word windows. kept: not base_failed, and
    log_ratio >= threshold (equal counts). A text without trigrams (null, empty, one or two bytes) has
    log_ratio 0; null counts as empty, so it fails. Repeated rows each count and get the same verdict;
    very long texts are read whole. Columns of df that bear a name of FIELDS are replaced. With no
    trusted text every log_ratio is 0 and only the base rules decide. An empty table gives an empty result.
    """
    trusted = trusted_ids.select(quoted(id_col).alias("i")).where("i is not null").distinct().withColumn("g", F.lit(True))
    trusted = F.broadcast(trusted) if trusted.count() <= FEW_TRUSTED else trusted
    flagged = df.select(quoted(id_col).alias("i"), quoted(text).alias("t")).join(trusted, "i", "left")
    every, good = counts(flagged.withColumn("g", F.coalesce("g", F.lit(False))), "t", "g")
    ratio = np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((every + 1) / (every.sum() + BUCKETS)) if good.sum() else np.zeros(BUCKETS)

    def kernel(batch, _):
        data, off = buffers(batch.column(0))
        measured = measures(data, off)
        run = np.concatenate([[0.0], np.cumsum(ratio[trigrams(data)])])
        n = np.maximum(np.diff(off) - 2, 0)
        to = np.minimum(off[:-1] + n, len(run) - 1)
        mean = np.round((run[to] - run[np.minimum(off[:-1], len(run) - 1)]) / np.maximum(n, 1), 6)
        failed = (measured[0] < min_words) | (100 * measured[4] > repeat_percent * measured[0])
        return [*(m.astype(np.int64) for m in measured), failed, mean, ~failed & (mean >= threshold)]

    return annotate(df, df.columns if keep is None else keep, FIELDS, kernel, text)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """doc_id of all documents labelled good."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
