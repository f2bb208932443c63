"""Language identification by a string kernel.

The kernel of two texts is the cosine of their presence vectors over all character n-grams of 1 to
MAX_N characters (blended spectrum), hashed into DIMENSIONS places. Landmark texts (Nyström) stand
for the training set; one-versus-rest kernel ridge regression gives a weight a landmark and
language. Texts are scored in batches: presence matrix times landmark matrix, divided by the norms,
times weights.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.textkit import annotate, buffers, cut, hash_share, one_each

MAX_N, DIMENSIONS, RIDGE = 3, 1 << 13, 1e-2
TRAIN_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE, MOST_LANGUAGES = 300, 48, 256
#: Bytes of the sample's texts.
SAMPLE_BYTES = 64 << 20
FIELDS = [("lang_pred", T.StringType()), ("score", T.DoubleType())]
_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(0, DIMENSIONS, (3, 256), dtype=np.uint16)
_MULT = np.array([40503, 30011, 52363], np.uint32)


def _fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals U+00C0-U+00DE as small letters."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[at] += 0x20
    return out


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row a text: 1 where one of its n-grams falls. Digits, ASCII signs and white space count as one blank."""
    data = _fold(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = _BYTE[0][data[lead]].astype(np.uint32)
    for k in (1, 2, 3):
        at = lead + k
        ok = at < len(data)
        tail = np.zeros(len(lead), bool)
        tail[ok] = (data[at[ok]] & 0xC0) == 0x80
        if not tail.any():
            break
        code[tail] = code[tail] * np.uint32(40503) + data[at[tail]]
    plain = data[lead]
    code[(plain < 97) | ((plain > 122) & (plain < 128))] = 1
    first = np.searchsorted(lead, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    out = np.zeros((len(off) - 1, DIMENSIONS), np.float32)
    gram = np.zeros(len(code), np.uint32)
    for n in range(1, MAX_N + 1):
        gram = (gram[: len(code) - n + 1] if n > 1 else gram) * np.uint32(0x9E3779B1) + code[n - 1 :]
        if n > len(code):
            break
        inside = row[: len(gram)] == row[n - 1 :]
        place = ((gram * np.uint32(0x85EBCA6B)) >> np.uint32(19)).astype(np.int64)
        out[row[: len(gram)][inside], place[inside]] = 1
    return out


def sample(docs: DataFrame, allowed: Column, per_language: int = TRAIN_PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, str, str]]:
    """(doc_id, lang, text): at most per_language of each language, the first by a hash of doc_id, and at most most_bytes of text in all.

    Of rows that share doc_id and lang one is taken. More than MOST_LANGUAGES different values of lang
    raise an error: a model has a row of weights for each.
    """
    able = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = able.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("count")).limit(MOST_LANGUAGES + 1).collect()
    if not sizes:
        return []
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], 1.5 * per_language / r["count"])])  # a little more than is wanted: the count is near
    chosen = one_each(able.where(hash_share("doc_id") < F.element_at(share, F.col("lang"))).select("doc_id", "lang", F.col("text").cast("string").alias("text")), ["doc_id", "lang"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy(hash_share("doc_id"), "doc_id"))
    ranked = cut(chosen.withColumn("place", first).where(F.col("place") <= per_language))
    left, fits = most_bytes, []
    for _, name, lang, size in sorted(ranked.select("place", "doc_id", "lang", F.octet_length("text")).collect()):
        if size <= left:
            left -= size
            fits.append((name, lang))
    if not fits:
        return []
    fitting = ranked.sparkSession.createDataFrame(fits, ranked.select("doc_id", "lang").schema)
    rows = ranked.join(F.broadcast(fitting), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text").collect()
    return sorted((r[0], r[1], r[2]) for r in rows)


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / np.sqrt(np.maximum(a.sum(axis=1), 1)[:, None] * np.maximum(b.sum(axis=1), 1)[None, :])


def _texts(raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [r.encode() for r in raw]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def train(rows: list[tuple[int, str, str]]) -> dict | None:
    """Landmarks and weights; None without a row."""
    if not rows:
        return None
    names = sorted({r[1] for r in rows})
    x = np.vstack([presence(*_texts([r[2] for r in rows[at : at + 64]])) for at in range(0, len(rows), 64)])
    lang = np.array([names.index(r[1]) for r in rows])
    order = np.argsort([crc32(str(r[0]).encode()) for r in rows], kind="stable")  # landmarks by hash, not by age
    picked = np.concatenate([np.sort(order[lang[order] == k][:LANDMARKS_PER_LANGUAGE]) for k in range(len(names))])
    marks = x[picked]
    k_nm, k_mm = _kernel(x, marks).astype(float), _kernel(marks, marks).astype(float)
    target = np.where(lang[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    balance = (1 / np.bincount(lang, minlength=len(names)))[lang][:, None]
    left = k_nm.T @ (k_nm * balance) + RIDGE * k_mm / len(rows) + 1e-8 * np.eye(len(picked))
    return {"names": names, "marks": marks, "weights": np.linalg.solve(left, k_nm.T @ (target * balance)).astype(np.float32)}


def identify_language(df: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns of df by default), lang_pred and score (0 to 1) for each row of df.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if there is
    no model. Ties go to the language first in the alphabet. Repeated
    rows are answered alike, texts of any length are read whole, an empty table gives an empty result. Columns of df named lang_pred or score
    are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(batch, _):
        found = shared.value
        column = batch.column(0)
        names, scores = [], []
        strings = column.to_pylist()
        for at in range(0, len(column), 128):
            data, off = buffers(column.slice(at, 128))
            if found is not None:
                f = _kernel(presence(data, off), found["marks"]) @ found["weights"]
                p = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
            for k in range(len(off) - 1):
                if found is None or not any(map(str.isalpha, strings[at + k] or "")):
                    names.append("und")
                    scores.append(0.0)
                else:
                    best = int(f[k].argmax())
                    names.append(found["names"][best])
                    scores.append(round(float(p[k, best]), 6))
        return [names, np.array(scores)]

    return annotate(df, df.columns if keep is None else keep, FIELDS, kernel, text)
