"""Exact top-k search by inner product: aggregation of sorted lists without random access.

Queries are dealt into groups that a task can hold, rows into slices that it streams; each pair of a
group and a slice is one task's cell. In a cell the rows go by in blocks of BLOCK, and in each block
every component is a sorted list. For a query the lists are read in step from the end that helps it most.
What a row has shown so far, plus the least (or most) that its unread entries can add, bounds its
score from below (or above); the frontier of a list bounds all that is unread in it. Reading stops
when no row outside a few candidates can reach the k-th lower bound, or the k-th score of the blocks
before; the candidates' final scores are then resolved. The best k of all cells are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.textkit import bound_batches

BLOCK, QUERIES = 4096, 256
#: Bytes of the queries that a cell holds, and of the rows that it streams. Rows are shuffled once a group, queries once a slice.
HELD, STREAMED = 1 << 25, 1 << 28
#: Shares of the lists after which bounds are compared; so few rows are resolved at once.
DEPTHS, CANDIDATES = (0.15, 0.35, 0.6), 96


def quantised(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, dims, v): floor(scale * component) as 64-bit integers; rows without a whole finite vector or an identifier are left out."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            off = rows.offsets.to_numpy().astype(np.int64)
            x = rows.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(float) * scale  # a null is NaN
            off, dims = off - off[0], np.diff(off)
            finite = np.isfinite(x)
            broken = np.concatenate([[0], np.cumsum(~finite)])
            whole = (dims > 0) & (broken[off[1:]] == broken[off[:-1]])
            whole &= rows.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            own = np.repeat(whole, dims)
            if (np.repeat(dims, dims)[own] * np.square(x[own]) >= 2.0**62).any():
                raise ValueError("a component is beyond the range of 64-bit scores")
            ends = np.concatenate([[0], np.cumsum(8 * dims[whole])]).astype(np.int32)
            data = np.floor(x[own]).astype(np.int64).tobytes()
            v = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(whole)), pa.array(dims[whole].astype(np.int32)), v], ["id", "dims", "v"])

    source = df.select(F.col(id_col).cast("long"), F.col(vector).cast("array<double>"))
    return source.mapInArrow(run, "id long, dims int, v binary")


def sorted_lists(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every component of a block: its rows by rising value, and each row's place among them."""
    order = np.argsort(block, axis=0, kind="stable")
    return order, np.argsort(order, axis=0, kind="stable")


def candidates(queries: np.ndarray, block: np.ndarray, own: np.ndarray, k: int, lists: tuple[np.ndarray, np.ndarray] | None = None, reached: np.ndarray | None = None) -> np.ndarray:
    """(query, row) pairs of a block that may be among the query's k best; all others are excluded by their bounds.

    own: (query, row) pairs that don't compete. lists: the block's ``sorted_lists``. reached: for each
    query a score that k rows elsewhere have. Every component's list is read to a common depth,
    for all queries of the batch at once: from the top where the query's component is positive, from
    the bottom where it is negative. A read entry adds its product; an unread one lies between the
    list's far end and its frontier. Queries that still have many rows in question read on.
    """
    n = len(block)
    alive = ~own
    order, rank = sorted_lists(block) if lists is None else lists
    x, q = block.astype(float), queries.astype(float)
    rising, falling = np.maximum(q, 0), np.minimum(q, 0)
    low, high = x.min(axis=0), x.max(axis=0)
    floor = rising @ low + falling @ high
    open_ = np.flatnonzero(alive.sum(axis=1) > max(CANDIDATES, k))
    for part in DEPTHS:
        if not len(open_):
            break
        depth = max(1, int(n * part))
        column = np.arange(block.shape[1])
        top, bottom = x[order[n - depth], column], x[order[depth - 1], column]
        up, down = rank >= n - depth, rank < depth
        r, f = rising[open_], falling[open_]
        lower = floor[open_, None] + r @ np.where(up, x - low, 0).T + f @ np.where(down, x - high, 0).T
        upper = (r @ top + f @ bottom)[:, None] + r @ np.where(up, x - top, 0).T + f @ np.where(down, x - bottom, 0).T
        lower[~alive[open_]] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k]
        if reached is not None:
            bar = np.maximum(bar, reached[open_])
        alive[open_] &= upper >= bar[:, None]
        open_ = open_[alive[open_].sum(axis=1) > max(CANDIDATES, k)]
    return np.argwhere(alive)


def top_k(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), id_col, score: each query's k best rows of df other than its own, all if there are fewer; ties to the smaller identifier.

    queries has the columns of df. Vectors (and queries) that are null, empty or hold null or
    non-finite components take no part, nor do rows with a null identifier; vectors of another
    length are no candidates. Components so large that a score could pass 2^62 raise an error. Queries repeated with the same vector count once; repeated candidates
    stay as often as they stand. No vectors or no queries: an empty result.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = quantised(df, id_col, vector, scale)
    asked = quantised(queries, id_col, vector, scale).distinct()
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(8 * F.col("dims").cast("long")), F.lit(0))).first()
    slices = max(1, -(-size // STREAMED), min(-(-count // BLOCK), 2 * spark.sparkContext.defaultParallelism))
    groups = max(1, -(-(asked.agg(F.sum(8 * F.col("dims").cast("long"))).first()[0] or 0) // HELD))

    def dealt(part: DataFrame, own: int, others: int, cell: str, asks: bool) -> DataFrame:
        """part hashed into own slices or groups, each in as many cells as there are others."""
        placed = part.withColumn("p", F.pmod(F.xxhash64("id", "v"), F.lit(own)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return placed.select(F.expr(cell).cast("int").alias("cell"), "dims", F.lit(not asks).alias("row"), "id", "v")

    cells = dealt(asked, groups, slices, f"o * {groups} + p", True).unionByName(dealt(rows, slices, groups, f"p * {groups} + o", False))
    cells = cells.repartitionById(slices * groups, "cell").sortWithinPartitions("dims", "row").select("dims", "row", "id", "v")

    def run(batches):
        cell = None
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, row = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            begins = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (row[1:] != row[:-1])]))
            for lo, hi in zip(begins, [*begins[1:], len(dims)], strict=True):
                if cell is None or cell.dims != dims[lo]:
                    if cell is not None:
                        yield from cell.best()
                    cell = Cell(int(dims[lo]), k)
                v = batch.column(3).slice(lo, hi - lo)
                (cell.read if row[lo] else cell.ask)(batch.column(2).slice(lo, hi - lo).to_numpy(), np.frombuffer(b"".join(v.to_pylist()), np.int64).reshape(-1, cell.dims))
        if cell is not None:
            yield from cell.best()

    found = cells.mapInArrow(run, "query_id long, key long, id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


class Cell:
    """The queries of a group, of one length, and their best rows among those that went by: all queries come first."""

    def __init__(self, dims: int, k: int):
        self.dims, self.k = dims, k
        self.asks, self.asked, self.rows, self.held = [], None, [], 0

    def ask(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.asks.append((ids, vectors))

    def read(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not self.asks:
            return
        self.rows.append((ids, vectors))
        self.held += len(ids)
        if self.held >= BLOCK:
            self._search()

    def _open(self) -> None:
        """The queries in batches of QUERIES: identifiers, vectors, and so far no (query, row, score)."""
        ids, vectors = (np.concatenate(x) for x in zip(*self.asks, strict=True))
        none = np.zeros(0, np.int64)
        self.asked = [[ids[at : at + QUERIES], vectors[at : at + QUERIES], none, none, none] for at in range(0, len(ids), QUERIES)]

    def _search(self) -> None:
        if self.asked is None:
            self._open()
        ids, block = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.rows, self.held = [], 0
        lists = sorted_lists(block)
        for part in self.asked:
            ask, vectors, query, row, score = part
            reached = np.full(len(ask), -np.inf)
            last = np.searchsorted(query, np.arange(len(ask)), "right") - 1
            full = np.bincount(query, minlength=len(ask)) == self.k
            reached[full] = score[last[full]]
            pairs = candidates(vectors, block, ask[:, None] == ids[None, :], self.k, lists, reached)
            new = np.concatenate([(vectors[p[:, 0]] * block[p[:, 1]]).sum(axis=1) for p in np.array_split(pairs, 1 + len(pairs) // 65536)])
            query, row, score = np.concatenate([query, pairs[:, 0]]), np.concatenate([row, ids[pairs[:, 1]]]), np.concatenate([score, new])
            order = np.lexsort((row, -score, query))
            query = query[order]
            best = np.arange(len(query)) - np.searchsorted(query, query) < self.k
            part[2:] = query[best], row[order][best], score[order][best]

    def best(self):
        """The cell's result, once all rows went by."""
        if self.rows:
            self._search()
        for ask, vectors, query, row, score in self.asked or []:
            keys = np.array([hash_of(v) for v in vectors], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ask[query], keys[query], row, score)], ["query_id", "key", "id", "score"])


def hash_of(vector: np.ndarray) -> int:
    """Tells queries of one identifier apart."""
    import zlib

    return zlib.crc32(vector.tobytes())
