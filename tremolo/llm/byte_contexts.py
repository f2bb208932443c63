"""Context-tree weighting over whole bytes, DEPTH bytes deep, counted, weighed and read in parts.

A key is the DEPTH bytes before a byte, the nearest highest, and the byte: 56 bits, exact. Every key
of the training texts is kept, so the tree gains contexts with the corpus. All contexts that share
their nearest NEAR bytes lie in one bucket; a bucket weighs its part of the tree by itself. The
contexts of less than NEAR bytes are weighed on the driver: at most 2^16 of 255 decisions. Texts are
scored in chunks: a chunk asks each bucket once for each of its distinct keys. What a byte of text
asks for shrinks as chunks grow, so a large corpus has larger chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.textkit import LOWER, bound_batches, buffers, cut, mix, slices, sweep

DEPTH, NEAR, END = 6, 3, 255
#: Bytes of text in a chunk, and of training text behind a bucket; keys held in a task before they are passed on.
CHUNK, BUCKET, HELD = 4 << 20, 16 << 20, 1 << 22
#: Chunks that are enough to work side by side: a corpus of more has larger ones, of LARGE bytes at most.
ENOUGH, LARGE = 32, 8 << 20
_HALF = np.log(0.5)
_CONTEXT = np.uint64((1 << 8 * (DEPTH + 1)) - 256)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_KEYS = "bucket int, chunk int, n int, keys binary, counts binary"


def keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every byte and text end; n + 1 offsets. Before a text stand ends."""
    n = len(off) - 1
    ends = DEPTH + 1 + off[1:] + DEPTH * np.arange(n)
    own = np.ones(DEPTH + 1 + len(data) + DEPTH * n, bool)
    own[: DEPTH + 1] = False
    own[(ends[:, None] + np.arange(DEPTH)).ravel()] = False
    spaced = np.full(len(own), END, np.uint8)  # DEPTH ends between two texts, the first of them the text's own
    spaced[own] = LOWER[data]
    own[ends] = True
    # eight bytes in a row, the last one highest: rotated by a byte, and without the first, they are the key
    seen = np.ndarray(len(data) + DEPTH * n, "<u8", spaced, strides=(1,))[own[DEPTH + 1 :]]
    return ((seen & _CONTEXT) | (seen >> np.uint64(8 * (DEPTH + 1)))).view(np.int64), off + np.arange(n + 1)


def bucket_of(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix((key >> (8 * (DEPTH - NEAR + 1))).astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)


def chunks_of(n_bytes: int) -> int:
    return max(1, min(-(-n_bytes // CHUNK), ENOUGH), -(-n_bytes // LARGE))


def pack(values: np.ndarray) -> bytes:
    """int64 values, byte by byte of their steps, compressed."""
    step = np.diff(values, prepend=0).astype("<i8")
    return pa.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view("<i8").reshape(-1))


def pack_logs(values: np.ndarray) -> bytes:
    """Values of single precision, byte by byte, compressed: their leading bytes differ little."""
    return pa.compress(np.ascontiguousarray(values.astype("<f4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpack_logs(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<f4").reshape(-1)


def distinct_of(key: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    key = np.sort(key)
    return key[np.flatnonzero(np.diff(key, prepend=-1))]


def distinct_of_all(found: Iterable[np.ndarray]) -> np.ndarray:
    """Sorted distinct keys of all of found, of which about HELD are held at a time."""
    held, size = [], 0
    for key in found:
        held.append(key)
        size += len(key)
        if size > HELD:
            held = [distinct_of(np.concatenate(held))]
            size = len(held[0])
    return distinct_of(np.concatenate(held)) if held else np.zeros(0, np.int64)


class Values:
    """Values of distinct keys, found by the leading bits of a one-to-one hash, which takes less time than to search sorted keys."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(1, len(key).bit_length())
        self.shift = np.uint64(64 - bits)
        hashed = key.view(np.uint64) * _SPREAD
        order = np.argsort(hashed)
        self.hashed, self.value = hashed[order], value[order]
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((hashed >> self.shift).view(np.int64), minlength=1 << bits), out=self.first[1:])

    def of(self, key: np.ndarray) -> np.ndarray:
        """The value of each key; all of them must be known."""
        hashed = key.view(np.uint64) * _SPREAD
        at = self.first[(hashed >> self.shift).view(np.int64)]
        left = np.flatnonzero(self.hashed[at] != hashed)
        while len(left):
            at[left] += 1
            left = left[self.hashed[at[left]] != hashed[left]]
        return self.value[at]


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def parts(key: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys in order) of sorted keys."""
    b = bucket_of(key, n_buckets)
    order = np.argsort(b, kind="stable")
    ends = np.flatnonzero(np.diff(b[order], append=-1)) + 1
    for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True) if len(key) else ():
        yield int(b[order[lo]]), order[lo:hi]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["bucket", "chunk", "n", "keys", "counts"])


def gather(texts: DataFrame, n_buckets: int) -> DataFrame:
    """Counts of all keys of the column t, one row for each bucket."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "t"):
                held.append(np.unique(keys(*buffers(part.column(0)))[0], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        for b, at in parts(held[0][0], n_buckets):
                            yield _batch([(b, 0, len(at), pack(held[0][0][at]), pack(held[0][1][at]))])
                        held, size = [], 0
        if size:
            key, n = merged(held)
            for b, at in parts(key, n_buckets):
                yield _batch([(b, 0, len(at), pack(key[at]), pack(n[at]))])

    def together(table):
        held, size = [], 0
        for r in table.to_pylist():
            held.append((unpack(r["keys"], r["n"]), unpack(r["counts"], r["n"])))
            size += r["n"]
            if size > HELD:
                held = [merged(held)]
                size = 0
        key, n = merged(held)
        return pa.Table.from_batches([_batch([(table.column("bucket")[0].as_py(), 0, len(key), pack(key), pack(n))])])

    bound_batches(texts.sparkSession)
    return texts.mapInArrow(count, _KEYS).groupBy("bucket").applyInArrow(together, _KEYS)


def _blocks(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    from tremolo.llm.context_tree import _block

    return _block(np.stack([zeros, ones], axis=-1).astype(float))


class Layer:
    """All decisions of one depth and level that training saw: node (context, leading bits), counts and weights."""

    def __init__(self, node: np.ndarray, ones: np.ndarray, n: np.ndarray, level: int, below: Layer | np.ndarray | None):
        self.node, self.level = node, level
        self.k = (ones + 0.5) / (n + 1)
        block = _blocks(n - ones, ones)
        if below is None:
            self.lw, self.w = block, np.ones(len(node))
            return
        deep = below if isinstance(below, np.ndarray) else np.bincount(self.find(below.up()), weights=below.lw, minlength=len(node))
        self.lw = np.logaddexp(_HALF + block, _HALF + deep)
        self.w = np.exp(_HALF + block - self.lw)

    def up(self) -> np.ndarray:
        """The nodes one byte shallower."""
        return (self.node >> (8 + self.level) << self.level) | (self.node & ((1 << self.level) - 1))

    def find(self, node: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.node, node)

    def mix(self, m: np.ndarray, r: np.ndarray) -> None:
        """m: what shallower depths give the probability of a one; r: the weight that they leave."""
        self.last = m + r * self.k
        self.m, self.r = m + r * self.w * self.k, r * (1 - self.w)

    def read(self, node: np.ndarray, value: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Sets value where training saw the node; the places that are still open."""
        if not len(self.node) or not len(open_):
            return open_
        at = np.minimum(self.find(node), len(self.node) - 1)
        seen = self.node[at] == node
        value[open_[seen]] = self.last[at[seen]]
        return open_[~seen]


def counted(key: np.ndarray, n: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, ones and count of each decision of a level, from sorted (context, byte) and their counts."""
    node = key >> (8 - level)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    return node[first], np.add.reduceat(n * (key >> (7 - level) & 1), first), np.add.reduceat(n, first)


def by_depth(key: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {DEPTH: (key, n)}
    for d in range(DEPTH - 1, NEAR - 1, -1):
        key, n = out[d + 1]
        out[d] = merged([(key >> 16 << 8 | key & 255, n)])
    return out


def layers(depths: dict[int, tuple[np.ndarray, np.ndarray]], level: int) -> dict[int, Layer]:
    out, below = {}, None
    for d in range(DEPTH, NEAR - 1, -1):
        below = out[d] = Layer(*counted(*depths[d], level), level, below)
    return out


def crowns(table: pa.Table) -> pa.Table:
    """For one bucket: node of NEAR - 1 bytes, ones, count and the log weighted probability of what lies below it."""
    (r,) = table.to_pylist()
    depths, out = by_depth(unpack(r["keys"], r["n"]), unpack(r["counts"], r["n"])), []
    for level in range(8):
        near = layers(depths, level)[NEAR]
        _, ones, n = counted(*depths[NEAR], level)
        node, at = np.unique(near.up(), return_inverse=True)
        out.append([np.full(len(node), level, np.int32), node, *(np.bincount(at, weights=x) for x in (ones, n, near.lw))])
    return pa.table(dict(zip(("level", "node", "ones", "n", "lw"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def crown(rows) -> list[list[Layer]]:
    """For each level, the mixed layers of depth 0 to NEAR - 1."""
    out = []
    for level in range(8):
        here = rows[rows["level"] == level].sort_values("node")
        node, ones, n, deep = (here[c].to_numpy() for c in ("node", "ones", "n", "lw"))
        found = [Layer(node, ones, n, level, deep)]
        for _ in range(NEAR - 1):
            up, at = np.unique(found[0].up(), return_inverse=True)
            ones, n = np.bincount(at, weights=ones, minlength=len(up)), np.bincount(at, weights=n, minlength=len(up))
            found.insert(0, Layer(up, ones, n, level, found[0]))
        found[0].mix(np.zeros(len(found[0].node)), np.ones(len(found[0].node)))
        for above, layer in zip(found, found[1:], strict=False):
            at = above.find(layer.up())
            layer.mix(above.m[at], above.r[at])
        out.append(found)
    return out


def answers(key: np.ndarray, depths: dict | None, tops: list[list[Layer]]) -> np.ndarray:
    """log10 probability of each key's byte after its context; depths: the bucket's counts."""
    out, every = np.zeros(len(key)), np.arange(len(key))
    for level in range(8):
        found = list(tops[level])
        if depths:
            deep = layers(depths, level)
            for d in range(NEAR, DEPTH + 1):
                at = found[-1].find(deep[d].up())
                deep[d].mix(found[-1].m[at], found[-1].r[at])
                found.append(deep[d])
        one, open_ = np.full(len(key), 0.5), every
        for d in range(len(found) - 1, -1, -1):
            k = key[open_]
            open_ = found[d].read((k >> (8 * (DEPTH - d + 1)) << level) | ((k & 255) >> (8 - level)), one, open_)
        out += np.log10(np.where(key >> (7 - level) & 1, one, 1 - one))
    return out


def scored(source: DataFrame, train: DataFrame, kept: list[str], fields: list[tuple[str, T.DataType]], kernel: Callable[..., list], n_bytes: int) -> DataFrame:
    """kept and fields for each row of source, written; kernel(batch, logs) gets the column text and the log10 probability of each byte and end.

    train: texts (t) that teach. n_bytes: bytes of text in source, which decides the number of parts only.
    """
    n_buckets, n_chunks = max(4, -(-n_bytes // BUCKET)), chunks_of(n_bytes)
    model = cut(gather(train, n_buckets))
    top = model.groupBy("bucket").applyInArrow(crowns, "level int, node long, ones double, n double, lw double")
    tops = source.sparkSession.sparkContext.broadcast(crown(top.groupBy("level", "node").agg(*(F.sum(c).alias(c) for c in ("ones", "n", "lw"))).toPandas()))
    sweep(source.sparkSession)  # the texts are dealt next; the shuffles behind the model need not lie beside them
    chunk = F.pmod(F.xxhash64(kept[0], "text"), F.lit(n_chunks)).cast("int")
    texts = source.withColumn("__chunk", chunk)

    def distinct(table):
        found = [part for b in table.to_batches() for part in slices(b, "text")]
        return found, distinct_of_all(key_of(part) for part in found)

    def key_of(part):
        return keys(*buffers(part.column(part.schema.get_field_index("text"))))[0]

    def ask(table):
        _, key = distinct(table)
        chunk = table.column("__chunk")[0].as_py()
        return pa.Table.from_batches([_batch([(b, chunk, len(at), pack(key[at]), None) for b, at in parts(key, n_buckets)])])

    def answer(known, asked):
        known, asked = known.to_pylist(), asked.to_pylist()
        depths = by_depth(unpack(known[0]["keys"], known[0]["n"]), unpack(known[0]["counts"], known[0]["n"])) if known else None
        wanted = [unpack(r["keys"], r["n"]) for r in asked]
        key = distinct_of(np.concatenate(wanted)) if wanted else np.zeros(0, np.int64)
        value = answers(key, depths, tops.value).astype("<f4")
        rows = [(r["bucket"], r["chunk"], r["n"], pack_logs(value[np.searchsorted(key, w)]), None) for r, w in zip(asked, wanted, strict=True)]
        return pa.Table.from_batches([_batch(rows)])

    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(n, t, True) for n, t in fields])

    def read(table, got):
        if not table.num_rows:
            return pa.table({n: [] for n in schema.names})
        found, key = distinct(table)
        value = np.zeros(len(key), "<f4")
        known = dict(zip(got.column("bucket").to_pylist(), got.column("keys").to_pylist(), strict=True))
        for b, at in parts(key, n_buckets):
            value[at] = unpack_logs(known[b], len(at))
        told, out = Values(key, value), []
        for part in found:
            logs = told.of(key_of(part)).astype(float)
            made = [x if isinstance(x, pa.Array) else pa.array(x) for x in kernel(part.select(["text"]), logs)]
            out.append(pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + made, schema.names))
        return pa.Table.from_batches(out)

    asked = texts.groupBy("__chunk").applyInArrow(ask, _KEYS)  # with all columns, so that both uses share one exchange
    told = model.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, _KEYS)
    out = cut(texts.groupBy("__chunk").cogroup(told.groupBy("chunk")).applyInArrow(read, schema))
    del texts, asked, told  # what they refer to is not swept
    sweep(source.sparkSession, model)
    return out


