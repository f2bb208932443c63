"""Prefix trie of conversations, summed by heavy paths.

A conversation is a sequence of turns; a node is a distinct sequence of first turns. Texts are
digested where they are read and never move. A node is known by a chained hash of 128 bits, so two
different prefixes are taken for one with a chance of about n^2 / 2^129.

Heavy paths: each node's heavy child is the one with most members, so a step to any other child at
least halves the members, and a walk from the root crosses at most log2(conversations) light edges.
Sums over subtrees are suffix sums along heavy paths, from the paths behind most light edges to the
root's; between two rounds each light path adds its total to the node that it hangs from.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.textkit import remove, shared_dir

_ROOT = bytes(16)
#: Ids of one node are joined to strings of about this many bytes before they meet.
CHUNK = 1 << 16


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text; null counts as empty), size (UTF-8 bytes of the text). Rows without a conv_id belong to no conversation; other columns play no part; a text of any length is digested whole."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"))


_STEPS = ("conv_id", "depth", "key", "parent", "size", "ends")

_KINDS = {"conv_id": pa.int64(), "depth": pa.int32(), "key": pa.binary(), "parent": pa.binary(), "size": pa.int64(), "ends": pa.bool_(), "first": pa.int64(), "ids": pa.string(), "sha256": pa.string()}


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))


def steps(turns: DataFrame, family: int = 1, borrowed: int = 0) -> DataFrame:
    """conv_id, depth, key, parent (keys of nodes), size, ends: a row for the root and for each turn of each conversation.

    turns: conv_id, turn, digest, size. Turns stand in the order of turn, null first, then of digest;
    repeated rows are turns of their own.
    With family > 1 a conversation c begins with the first h turns of conversation c - c % family, and
    goes on with its own turns after its first h; h = crc32 of c's decimal text % (borrowed + 1).
    A family's turns pass through one task in order; at most ``borrowed`` of them are held.
    """
    lead = F.col("conv_id") - F.col("conv_id") % family
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (borrowed + 1) if family > 1 else F.lit(0)
    rows = turns.select(lead.alias("family"), (lead != F.col("conv_id")).alias("later"), "conv_id", "turn", "digest", "size", share.cast("int").alias("share"))
    placed = rows.repartition("family").sortWithinPartitions("family", "later", "conv_id", "turn", "digest")
    most = borrowed if family > 1 else 0

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[tuple[bytes, int]] = []  # the first turns of the family's lead
        at_family = at_conv = None
        key, depth, seen, last, out = _ROOT, 0, 0, None, []
        for batch in batches:
            for group, later, conv, digest, size, h in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("family", "later", "conv_id", "digest", "size", "share")), strict=True):
                if group != at_family:
                    at_family, head = group, []
                taken = []
                if conv != at_conv:
                    if last is not None:
                        out.append((*last, True))
                    at_conv, key, depth, seen, last = conv, _ROOT, 0, 0, (conv, 0, _ROOT, None, 0)
                    taken = head[:h] if later else []
                if not later and len(head) < most:
                    head.append((digest, size))
                if not later or seen >= h:
                    taken = [*taken, (digest, size)]
                seen += 1
                for d, s in taken:
                    out.append((*last, False))
                    parent, key, depth = key, hashlib.sha256(key + d).digest()[:16], depth + 1
                    last = (conv, depth, key, parent, s)
            if len(out) >= 4096:
                yield _batch(out, *_STEPS)
                out = []
        if last is not None:
            out.append((*last, True))
        if out:
            yield _batch(out, *_STEPS)

    return placed.select("family", "later", "conv_id", "digest", "size", "share").mapInArrow(walk, "conv_id long, depth int, key binary, parent binary, size long, ends boolean")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_trie(walked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations as ``steps`` gives them.

    nodes: key, conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved (sum over the subtree of (n_convs - 1) * size). ends: key, conv_id of each conversation's last
    node. No conversations, no nodes. Both are tables in the shared folder; what else was written is gone.

    Hot nodes: counts are combined before they are shuffled. Only the join that tells each step its
    node's numbers has a hot side; neither side comes partitioned, so AQE splits it.
    """
    spark = walked.sparkSession
    at = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    walked = _stored(walked, f"{at}/steps")
    nodes = _stored(
        walked.groupBy("key").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("conv_id").alias("node"), F.min("size").alias("size")),
        f"{at}/nodes",
    )
    root = nodes.where("depth = 0").first()
    ends = _stored(walked.where("ends").select("key", "conv_id"), f"{at}/ends")
    if root is None:
        remove(spark, f"{at}/steps")
        return nodes.select("key", F.col("node").alias("conv_id"), "depth", F.col("node").alias("parent_conv_id"), "n_convs", *[F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved")]), ends
    children = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children"), F.max_by("key", F.struct("n_convs", -F.col("node"))).alias("heavy"))
    children = _stored(children, f"{at}/children")
    known = _stored(
        nodes.join(children.select(F.col("parent").alias("key"), "n_children"), "key", "left").join(children.select(F.col("heavy").alias("key"), F.lit(True).alias("heavy")), "key", "left")
        .select("key", "node", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("heavy", F.lit(False)).alias("heavy")),
        f"{at}/known",
    )
    way = Window.partitionBy("conv_id").orderBy("depth")
    placed = (
        walked.where("depth > 0").select("conv_id", "depth", "key", "size").join(known, "key")
        .withColumns({
            "light": F.count_if(~F.col("heavy")).over(way), "path": F.coalesce(F.last(F.when(~F.col("heavy"), F.col("key")), ignorenulls=True).over(way), F.lit(_ROOT)),
            "parent_conv_id": F.coalesce(F.lag("node").over(way), F.lit(root.node)),
        })
        .where("conv_id = node")
    )
    top = known.where(F.col("key") == F.lit(_ROOT)).select(F.col("node").alias("conv_id"), F.lit(0).alias("depth"), "key", F.lit(0).cast("long").alias("size"), "node", "n_convs", "n_children", F.lit(False).alias("heavy"), F.lit(0).cast("long").alias("light"), F.col("key").alias("path"), F.lit(None).cast("long").alias("parent_conv_id"))
    placed.unionByName(top).select(
        "light", "path", "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (~F.col("heavy")).alias("head"),
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("own"),
    ).write.partitionBy("light").parquet(f"{at}/placed")
    placed = spark.read.parquet(f"{at}/placed")
    done = _rounds(placed, f"{at}/sums")
    for part in ("steps", "nodes", "children", "known", "placed"):
        remove(spark, f"{at}/{part}")
    return done, ends


def _rounds(placed: DataFrame, at: str) -> DataFrame:
    """Suffix sums of leaves and own along the paths, those behind most light edges first."""
    spark, hung, outs = placed.sparkSession, None, []
    below = Window.partitionBy("path").orderBy(F.desc("depth"))
    for light in range(int(placed.agg(F.max("light")).first()[0]), -1, -1):
        level = placed.where(F.col("light") == light)  # one folder
        if hung is not None:
            level = level.join(hung, ["conv_id", "depth"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaves", F.lit(0)), "own": F.col("own") + F.coalesce("more", F.lit(0))})
        sums = level.withColumns({"n_leaves": F.sum("leaf").over(below), "saved": F.sum("own").over(below)})
        out = sums.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "head")
        outs.append(f"{at}/{light}")
        out = _stored(out, outs[-1])
        hung = out.where("head and depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more"))
    return spark.read.schema(out.schema).parquet(*outs).drop("head")


def joined_ids(ends: DataFrame) -> DataFrame:
    """key, sha256: digest of each key's ids in decimal, ascending, with commas between.

    A hot key's ids are put in order and joined in many tasks; one task then reads the strings of
    about ``CHUNK`` bytes in order and holds one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or size >= CHUNK:
                    if ids:
                        out.append((key, first, ",".join(ids)))
                    key, first, ids, size = k, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield _batch(out, "key", "first", "ids")
        if ids:
            yield _batch([(key, first, ",".join(ids))], "key", "first", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if h is not None:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield _batch(out, "key", "sha256")
        if h is not None:
            yield _batch([(key, h.hexdigest())], "key", "sha256")

    parts = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, sha256 string")

