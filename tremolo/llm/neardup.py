"""Near duplicates: MinHash signatures joined by multi-index Hamming search, links confirmed on full sets.

A text's signature has LANES lanes of 16 bits: the low bits of the least hash of its shingles under
LANES hash functions. Two sets of similarity J differ in a lane with probability 1 - J. The lanes
are cut into CHUNKS chunks; if two signatures differ in at most 2 * CHUNKS - 1 lanes, then by the
pigeonhole principle some chunk has at most one error. All one-error variants of a chunk are
enumerated (the chunk without one of its lanes, for each lane), so every pair within that distance
meets under some key, and pairs beyond it meet unless each chunk has two errors: at J = 0.8 a pair
is missed with probability 0.263^10 < 2e-6, and much less above.

Texts of one shingle set are one node, so copies cost nothing. Under each key, nodes are first
compared with the least node there. Nodes under a key that remain in different components are then
all compared, so no link between components is lost; nodes that a chain of confirmed links already
joins need no further comparison. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.graph import components
from tremolo.llm.textkit import LOWER, annotate, buffers, cut, mix, sweep, word_hashes

LANES, CHUNKS = 50, 10
#: Nodes of a key that are compared in one task, against as many.
BLOCK = 512
#: Shingles of the nodes of a block, about: a tile holds twice as many hashes of 8 bytes, or those of two longer sets.
BLOCK_SHINGLES = 1 << 22
#: By default, pairs whose signatures differ in more lanes aren't verified: at J = 0.8 that is 2.1e-6 of the links. LANES verifies all that meet.
MOST_DIFFERING = 24

_RNG = np.random.default_rng(41)
_XOR = _RNG.integers(0, 2**32, LANES, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, LANES, dtype=np.uint32) | np.uint32(1)
_U64 = np.uint64
_STEP = _U64(0xD6E8FEB86659FD93)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of width words; of the whole sequence where it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = hashes[: n - width + 1].copy()
    for k in range(1, width):
        out = mix(out * _STEP + hashes[k : n - width + 1 + k])
    return np.unique(out + _U64(width))


def lanes(shingle_set: np.ndarray) -> np.ndarray:
    h = (shingle_set >> _U64(32)).astype(np.uint32)
    least = np.full(LANES, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, ((h[None, at : at + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return (least & np.uint32(0xFFFF)).astype(np.uint16)


def sets_of(batch: pa.RecordBatch, name: str, width: int) -> list[np.ndarray]:
    data, off = buffers(batch.column(batch.schema.get_field_index(name)))
    hashes, first = word_hashes(LOWER[data], off)
    return [shingles(hashes[a:b], width) for a, b in zip(first[:-1], first[1:], strict=True)]


def signatures(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(doc, n_shingles, fp_a, fp_b, signature): fp_a and fp_b name the shingle set, signature is null if it is empty."""

    def kernel(batch, _):
        n, fa, fb, sig = [], [], [], []
        for s in sets_of(batch, "__text", width):
            n.append(len(s))
            fa.append(int((mix(s).sum(dtype=_U64) if len(s) else _U64(0)).view(np.int64)))
            fb.append(int((mix(s ^ _STEP).sum(dtype=_U64) if len(s) else _U64(0)).view(np.int64)))
            sig.append(lanes(s).tobytes() if len(s) else None)
        return [np.array(n, np.int64), np.array(fa, np.int64), np.array(fb, np.int64), pa.array(sig, pa.binary())]

    source = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    fields = [("n_shingles", T.LongType()), ("fp_a", T.LongType()), ("fp_b", T.LongType()), ("signature", T.BinaryType())]
    return annotate(source, ["doc"], fields, kernel)


def chunk_keys(signature_bytes: list[bytes]) -> np.ndarray:
    """All keys of each signature: a chunk without one lane, for each chunk and lane."""
    per = LANES // CHUNKS
    sig = np.frombuffer(b"".join(signature_bytes), np.uint16).reshape(-1, CHUNKS, per).astype(_U64)
    out = np.empty((len(sig), CHUNKS, per), _U64)
    chunk = np.arange(CHUNKS, dtype=_U64)[None, :]
    for skip in range(per):
        packed = np.zeros(sig.shape[:2], _U64)
        for k in range(per):
            if k != skip:
                packed = (packed << _U64(16)) | sig[:, :, k]
        out[:, :, skip] = mix(packed ^ mix(chunk * _U64(per) + _U64(skip + 1)))
    return out.reshape(len(sig), LANES).view(np.int64)


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, node): LANES rows a node."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                keys = chunk_keys(part.column(1).to_pylist())
                slot = np.tile(np.arange(LANES, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(slot), pa.array(np.repeat(part.column(0).to_numpy(), LANES))], ["key", "slot", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, slot int, node long")


def close(pairs: DataFrame, nodes: DataFrame, similarity: float, most: int) -> DataFrame:
    """Distinct pairs whose signatures and set sizes allow a link."""
    half = nodes.select("node", "signature", "n_shingles")
    a = half.toDF("a", "sig_a", "n_a")
    b = half.toDF("b", "sig_b", "n_b")
    fit = F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")
    joined = pairs.join(a, "a").join(b, "b").where(fit).select("a", "b", "sig_a", "sig_b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, LANES) for k in (2, 3))
            near = (x != y).sum(axis=1) <= most
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose full shingle sets have the similarity, by integer arithmetic. texts: (node, shingle set)."""
    num, den = round(similarity * 100), 100
    a = texts.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    b = texts.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), _U64) for c in (2, 3))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep[k] = den * common >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _lanes_of(signature_bytes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signature_bytes), np.uint16).reshape(-1, LANES)


def _due(sig: np.ndarray, component: np.ndarray, block: np.ndarray, slot: int, across: bool, most: int) -> np.ndarray:
    """Which pairs (row < column) must be compared under this key: close, of two components, first met here."""
    per, n = LANES // CHUNKS, len(sig)
    due = component[:, None] != component[None, :]
    due &= np.arange(n)[:, None] < np.arange(n)[None, :]
    if across:
        due &= block[:, None] != block[None, :]
    x, y = np.nonzero(due)
    for at in range(0, len(x), 65536):
        p, q = x[at : at + 65536], y[at : at + 65536]
        differ = sig[p] != sig[q]
        errors = differ.reshape(-1, CHUNKS, per).sum(axis=2)
        chunk = (errors <= 1).argmax(axis=1)
        here = differ.reshape(-1, CHUNKS, per)[np.arange(len(p)), chunk]
        due[p, q] = (errors.sum(axis=1) <= most) & (chunk * per + here.argmax(axis=1) == slot)
    return due


def bridges_within(rest: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, most: int) -> DataFrame:
    """Links between components that meet under a key, found tile by tile; of links that join the same two components in a tile, one.

    rest: key, slot, node, component. The nodes under a key are dealt into blocks of about BLOCK
    nodes and BLOCK_SHINGLES shingles; a tile holds two blocks, so no task holds more than that,
    however many nodes a key has and however long their texts are. Tiles
    compare signatures first; only nodes with a close partner go on, with their full sets.
    """
    num, den = round(similarity * 100), 100
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES))
    size = rest.select("key", "node").join(nodes.select("node", "n_shingles"), "node").groupBy("key").agg(F.least(parts, F.count("*")).cast("int").alias("blocks"))
    dealt = rest.join(size, "key").join(nodes.select("node", "signature"), "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    held = dealt.groupBy("key", "slot", "blocks", "block").agg(F.collect_list(F.struct("node", "component", "block", "signature")).alias("held"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = (
        held.select("key", "slot", "block", other.alias("other"), "held")
        .groupBy("key", "slot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .agg(F.flatten(F.collect_list("held")).alias("held"))
    )

    def screen(batches):
        for batch in batches:
            key, slot, i, j = (batch.column(k).to_pylist() for k in range(4))
            for k in range(batch.num_rows):
                rows = batch.column(4)[k].values
                node, component, block = (rows.field(f).to_numpy() for f in (0, 1, 2))
                signature = rows.field(3)
                due = _due(_lanes_of(signature.to_pylist()), component, block, slot[k], i[k] != j[k], most)
                use = np.flatnonzero(due.any(axis=0) | due.any(axis=1))
                if len(use):
                    tile = [pa.array(np.full(len(use), v[k])) for v in (key, slot, i, j)]
                    own = [pa.array(node[use]), pa.array(component[use]), pa.array(block[use]), signature.take(pa.array(use))]
                    yield pa.RecordBatch.from_arrays([pa.array(c.to_numpy(), t) for c, t in zip(tile, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)] + own, names)

    names = ["key", "slot", "i", "j", "node", "component", "block", "signature"]
    near = tiles.mapInArrow(screen, "key long, slot int, i int, j int, node long, component long, block int, signature binary")

    def settle(pdf):
        sets = [np.frombuffer(x, _U64) for x in pdf["members"]]
        component = pdf["component"].to_numpy()
        across = int(pdf["i"].iloc[0]) != int(pdf["j"].iloc[0])
        due = _due(_lanes_of(list(pdf["signature"])), component, pdf["block"].to_numpy(), int(pdf["slot"].iloc[0]), across, most)
        sizes = np.array([len(s) for s in sets])
        vocabulary, place = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        root = dict.fromkeys(component.tolist())
        root = {c: c for c in root}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for k in np.flatnonzero(due.any(axis=1)):
            mark = np.zeros(len(vocabulary), bool)
            mark[place[begin[k] : begin[k + 1]]] = True
            for m in np.flatnonzero(due[k]):
                if find(component[k]) != find(component[m]):
                    common = int(mark[place[begin[m] : begin[m + 1]]].sum())
                    if den * common >= num * (int(sizes[k] + sizes[m]) - common):
                        out.append((pdf["node"].iloc[k], pdf["node"].iloc[m]))
                        root[find(component[k])] = find(component[m])
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return near.join(texts, "node").groupBy("key", "i", "j").applyInPandas(settle, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, most_differing: int = MOST_DIFFERING) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of df.

    A-Z count as a-z; words are runs of bytes other than white space; a text's set holds its distinct
    width-word shingles, the whole sequence if it has fewer words. Texts without a word (null and
    empty ones too) have the empty set and link with nothing. component_id is the least identifier
    that links reach, kept says that it is the row's own. Rows with one identifier count as one
    document; a row with a null identifier links with nothing and is kept, its component_id is null.
    An empty table gives an empty result; other columns play no part. Texts are read whole, however
    long. most_differing: lanes in which two signatures may differ for a pair that meets to be
    verified; LANES verifies every pair that meets.
    """
    signed = cut(signatures(df, id_col, text, width))
    live = signed.where("n_shingles > 0 and doc is not null")
    nodes = cut(
        live.groupBy("fp_a", "fp_b").agg(F.min("doc").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    )
    keys = keyed(nodes)
    met = keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    crowd = cut(keys.join(met, "key").select("key", "slot", "node", "least"))
    sweep(df.sparkSession)
    ids = crowd.select("node").distinct()
    wanted = df.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text")).join(ids, "node", "left_semi")

    def members(batch, _):
        return [pa.array([s.tobytes() for s in sets_of(batch, "__text", width)], pa.binary())]

    texts = cut(annotate(wanted, ["node"], [("members", T.BinaryType())], members))
    first = crowd.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    links = cut(confirm(close(first, nodes, similarity, most_differing), texts, width, similarity).distinct())
    sweep(df.sparkSession)
    alias = live.join(nodes.select("fp_a", "fp_b", "node"), ["fp_a", "fp_b"]).where("doc <> node").groupBy("doc", "node").agg(F.count("*").alias("n"))
    twice = live.groupBy("doc").agg(F.min("fp_a").alias("x"), F.max("fp_a").alias("y")).where("x <> y")
    repeated = alias.join(twice.select("doc"), "doc", "left_semi").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    groups = components(links.unionByName(repeated))
    placed = crowd.join(groups, "node", "left").select("key", "slot", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    bridges = cut(bridges_within(placed.join(mixed, "key", "left_semi"), nodes, texts, similarity, most_differing).distinct())
    sweep(df.sparkSession)
    if not bridges.isEmpty():
        steps = bridges.unionByName(links).unionByName(repeated)
        groups = components(steps)
    sweep(df.sparkSession, crowd, texts, links, bridges)
    settled = (
        nodes.select("fp_a", "fp_b", "node").join(groups, "node", "left")
        .select("fp_a", "fp_b", F.coalesce("component", "node").alias("component_id"))
    )
    out = signed.where("n_shingles > 0").join(settled, ["fp_a", "fp_b"], "left")
    out = out.unionByName(signed.where("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long")))
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(
        F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )
