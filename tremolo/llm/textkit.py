"""Vectorised text kernels over Arrow string buffers.

Every operator here reads whole texts as UTF-8 bytes straight from Arrow buffers, in slices of
about ``SLICE_BYTES`` (a longer text is a slice of its own), so memory follows the longest text
and not the size of a partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import platform
import sys
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20

#: Bytes that part words: space and 0x09-0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U64 = np.uint64
_CODES = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=_U64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, _U64), np.ones(1, _U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 8)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, _U64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=_U64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit integers."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[off[0] : off[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, text: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most limit bytes of the text (a column's name or number), or one row."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text (and the end) the index of its first word. separator: whether a byte parts words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = separator[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[off[off < n]] = True
    after[off[off > 0] - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, _U64)
    np.cumsum(_CODES[data] * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever the span stands."""
    return mix((prefix[ends] - prefix[starts]) * _powers(len(prefix))[1][starts] + (ends - starts).astype(_U64))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of each text's first word."""
    s, e, first = words(data, off)
    return span_hash(prefix_hash(data), s, e), first


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(names: list[str], name: str) -> str:
    """A name like ``name`` that none of names is, in any case of letters."""
    taken, found = {n.lower() for n in names}, f"__{name}"
    while found.lower() in taken:
        found += "_"
    return found


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of an Arrow batch, so that a batch of long texts stays small in the JVM and in Python."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def annotate(
    df: DataFrame,
    keep: list[str],
    fields: list[tuple[str, T.DataType]],
    kernel: Callable[..., list],
    text: str = "text",
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Adds columns computed from whole texts, batch by batch.

    kernel(batch, state) returns one Arrow array (or numpy array) a field. Columns of df that bear
    a new field's name are replaced; those not in keep are not returned. Names in keep may hold any
    character, and none is reserved.
    """
    bound_batches(df.sparkSession)
    new = [n for n, _ in fields]
    kept = [c for c in keep if c not in new]
    passed = text in kept and isinstance(df.schema[text].dataType, T.StringType)  # then the text travels once
    taken = [quoted(c) for c in kept] + ([] if passed else [quoted(text).cast("string")])
    source = df.select(*[c.alias(f"c{k}") for k, c in enumerate(taken)])  # a name with a dot can't be handed to Python
    at_text = kept.index(text) if passed else len(kept)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t, True) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in slices(batch, at_text):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in kernel(pa.RecordBatch.from_arrays([part.column(at_text)], ["__text"]), state)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(kept))] + made, [*kept, *new])

    return source.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True if the checksum of the identifier's decimal text leaves the remainder; false for a null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_share(*columns: str) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(77)), 11) / F.lit(float(1 << 53))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one set here where it is unset."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if at is None:
            import tempfile

            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="tremolo-")
        context.setCheckpointDir(at)
    return at or context._jsc.sc().getCheckpointDir().get()


def release() -> None:
    """Gives freed memory of this process back to the machine: garbage, Arrow's pool, and what the C library keeps (where it is glibc)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and platform.libc_ver()[0] == "glibc":
        ctypes.CDLL(None).malloc_trim(0)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession, *done: DataFrame) -> None:
    """Deletes the tables in done, all from cut(), that nothing reads any more, and has the driver collect its garbage.

    Spark frees the shuffle files behind a written table only when the driver's garbage collector
    finds that nothing refers to them; a loop of many small shuffles may end before it looks. Python
    hands references that it lets go to the JVM once a second, so that the JVM looks a little later,
    beside the next step.
    """
    for df in done:
        at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if at.isDefined():
            remove(spark, at.get())
    jvm = spark._jvm

    def look() -> None:
        with contextlib.suppress(Py4JError, OSError):  # the session may have ended
            jvm.System.gc()

    gc.collect()
    timer = threading.Timer(1.2, look)
    timer.daemon = True
    timer.start()


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without the line feed) of all lines, and the index of each text's first; the empty text has one line."""
    feed = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], feed + 1]), kind="stable")
    first = np.concatenate([[0], np.cumsum(1 + np.searchsorted(feed, off[1:]) - np.searchsorted(feed, off[:-1]))])
    # a feed at a text's end opens a line that stands before the next text's first
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = off[1:]
    return starts, ends, first


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs that first parts values into; 0 for an empty run."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[first[1:]] - run[first[:-1]]


def owner(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int, most_bytes: int) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out fold: at most ``most`` of them, the first by a hash of doc_id, and at most ``most_bytes`` of text.

    Of rows that share a doc_id one is an example, that of the least hash of its text; of labels that
    differ the largest holds. Documents with a null identifier, text or label are no examples.
    """
    able = labels.where(quoted(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
    ids = able.groupBy("doc_id").agg(F.max(quoted(label)).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    return bounded_texts(one_each(rows, ["doc_id", "label"]), most_bytes)


def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and text, one row a key, that of the least hash of its text; combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select(keys[0], "text", *keys[1:])


def bounded_texts(rows: DataFrame, most_bytes: int) -> DataFrame:
    """rows (doc_id, text, ...; one an identifier, in bounded number), in the order of a hash of doc_id as long as their texts have room in most_bytes; a text that has none is left out."""
    rows = cut(rows)
    sizes = rows.select(F.xxhash64("doc_id"), "doc_id", F.octet_length("text")).collect()
    left, fits = most_bytes, []
    for _, name, size in sorted(sizes):
        if size <= left:
            left -= size
            fits.append((name,))
    if len(fits) == len(sizes):
        return rows
    chosen = rows.sparkSession.createDataFrame(fits, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]))
    return rows.join(F.broadcast(chosen), "doc_id", "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int, remainder: int, most_bytes: int = 64 << 20) -> list[tuple[int, str, int]]:
    """``labelled_texts`` as a list, in the order of doc_id; both bounds hold for any input, so the driver has room."""
    rows = labelled_texts(docs, labels, label, modulus, remainder, most, most_bytes).toArrow()
    return sorted(zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True))
