"""Token identifiers as sorted-string-table shards.

A shard holds documents in the order of their identifier:

    magic | data blocks | index | Bloom filter | footer

A data block is a zstd frame of entries (varint shared key prefix, varint length of the rest, the
rest, varint number of ids, ids), after one byte that gives the width of an id (2 or 4 bytes), and
is followed by its CRC-32. The index has each block's first key, offset and length; the footer (64
bytes) the places of index and filter and the totals. A lookup asks the filter, searches the index
by bisection, reads one block. A key is 0x00 for a null identifier, else 0x01 and the identifier as
big-endian with its sign flipped, then a running number of four bytes for repeated identifiers.

Shards are written under a task's own name and then renamed, so a task that is run again replaces
its shard whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.textkit import slices

MAGIC = b"TRMLSST1"
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 1 << 18, 10, 7
_FOOTER = struct.Struct("<QQQQQQQ8s")
SHARD_BYTES = 256 << 20
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1_300_000


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None, turn: int = 0) -> bytes:
    return (b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", turn)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def bloom_places(name: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(name), zlib.crc32(name, 0x5BD1E995) | 1
    return [(a + k * b + k * k) % bits for k in range(BLOOM_HASHES)]


def open_path(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3:, ...) or of a plain path."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (pafs.LocalFileSystem(), uri)


class Writer:
    """Appends documents in key order to a stream; close() ends the file."""

    def __init__(self, sink):
        self.sink, self.at, self.index, self.names, self.n_docs, self.n_ids = sink, 0, [], [], 0, 0
        self.last_id, self.turn = (), 0
        self._put(MAGIC)
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.size, self.wide, self.last, self.head = [], 0, 2, b"", None

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.turn = self.turn + 1 if self.last_id == (doc_id,) else 0
        self.last_id = (doc_id,)
        key = key_of(doc_id, self.turn)
        if self.size > BLOCK_BYTES:
            self._end_block()
        if self.head is None:
            self.head = key
        if len(ids) and ids.max() > 0xFFFF:
            self.wide = 4
        self.block.append((key, ids))
        self.size += 2 * len(ids) + len(key)
        self.names.append(key[:-4])
        self.n_docs += 1
        self.n_ids += len(ids)

    def _end_block(self) -> None:
        if not self.block:
            return
        out, last, kind = [bytes([self.wide])], b"", "<u2" if self.wide == 2 else "<u4"
        for key, ids in self.block:
            shared = next((k for k, (x, y) in enumerate(zip(last, key, strict=False)) if x != y), min(len(last), len(key)))
            out += [varint(shared), varint(len(key) - shared), key[shared:], varint(len(ids)), ids.astype(kind).tobytes()]
            last = key
        frame = zstandard.ZstdCompressor(level=1).compress(b"".join(out))
        self.index.append((self.head, self.at, len(frame)))
        self._put(frame + struct.pack("<I", zlib.crc32(frame)))
        self._fresh()

    def close(self) -> None:
        self._end_block()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.names))
        bloom = bytearray(-(-bits // 8))
        for name in self.names:
            for p in bloom_places(name, bits):
                bloom[p >> 3] |= 128 >> (p & 7)
        packed = bytes(bloom)
        index_at = self.at
        self._put(index + packed)
        self._put(_FOOTER.pack(index_at, len(index), index_at + len(index), bits, self.n_docs, self.n_ids, zlib.crc32(index + packed), MAGIC))


class Reader:
    """A shard, read block by block or by identifier."""

    def __init__(self, uri: str):
        files, path = open_path(uri)
        self.file = files.open_input_file(path)
        self.file.seek(self.file.size() - _FOOTER.size)
        index_at, index_n, bloom_at, self.bits, self.n_docs, self.n_ids, check, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        self.file.seek(index_at)
        tail = self.file.read(bloom_at - index_at + -(-self.bits // 8))
        if magic != MAGIC or zlib.crc32(tail) != check:
            raise ValueError(f"{uri} is no whole shard")
        self.bloom, self.index, at = tail[index_n:], [], 0
        while at < index_n:
            n, at = read_varint(tail, at)
            key, at = tail[at : at + n], at + n
            offset, at = read_varint(tail, at)
            length, at = read_varint(tail, at)
            self.index.append((key, offset, length))

    def close(self) -> None:
        self.file.close()

    def block(self, k: int) -> list[tuple[bytes, np.ndarray]]:
        _, offset, length = self.index[k]
        self.file.seek(offset)
        frame = self.file.read(length + 4)
        if struct.unpack("<I", frame[-4:])[0] != zlib.crc32(frame[:-4]):
            raise ValueError("a block is damaged")
        data = zstandard.ZstdDecompressor().decompress(frame[:-4])
        out, last, at, wide = [], b"", 1, data[0]
        while at < len(data):
            shared, at = read_varint(data, at)
            n, at = read_varint(data, at)
            last, at = last[:shared] + data[at : at + n], at + n
            n, at = read_varint(data, at)
            out.append((last, np.frombuffer(data, "<u2" if wide == 2 else "<u4", n, at).astype("<u4")))
            at += n * wide
        return out

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of the identifier."""
        name = key_of(doc_id)[:-4]
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_places(name, self.bits)):
            return []
        k = max(0, bisect_right([key for key, _, _ in self.index], name) - 1)
        out = []
        while k < len(self.index) and (self.index[k][0][:-4] <= name):
            out += [ids for key, ids in self.block(k) if key[:-4] == name]
            k += 1
        return out


#: A pre-tokenizer whose pieces don't cross white space: what the pattern matches is kept, the rest goes.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def piecewise(spec: dict) -> bool:
    """Whether a tokenizers file is of the kind whose texts may be encoded piece by piece: lower case, split at white space, plain merges, nothing added."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = spec.get("model") or {}
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and (parts[0].get("pattern"), parts[0].get("behavior"), parts[0].get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
        and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback")
        and not any(spec.get(k) for k in ("post_processor", "truncation", "padding"))
        and all(a["content"].startswith("<|") and not (a.get("lstrip") or a.get("rstrip") or a.get("normalized")) for a in spec.get("added_tokens", []))
    )


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class Encoder:
    """Ids of whole texts by a tokenizers file of lower-case word pieces that don't cross a blank.

    Such a tokenizer gives a text the ids of its pieces between blanks, one after the other, with
    A-Z as a-z. So each distinct piece is encoded once and its ids are remembered: plain words by the
    tokenizer's model, all others many in one call with the end-of-text mark between them. A text that may hold a mark of its own is encoded whole,
    and so is every text if the file says that its tokenizer isn't of this kind.
    """

    MARK = "<|endoftext|>"
    #: Letters: a-z, and U+00E0-U+00FF but the division sign.
    #: A word of these and a run of ASCII signs after it (no apostrophe) are encoded apart.
    _WORD = re.compile(rb"((?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
    #: How byte-level vocabularies spell bytes that don't print: the n-th of them as character 256 + n.
    _SPELT = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
    _SHARED: dict[str, dict[bytes, bytes]] = {}
    _PIECEWISE: dict[str, bool] = {}

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.end = Tokenizer.from_file(path), self._SHARED.setdefault(path, {b"": b""}), np.uint32(end_id).tobytes()
        self.mark = self.tokenizer.token_to_id(self.MARK)
        if path not in self._PIECEWISE:
            with open(path, encoding="utf-8") as file:
                self._PIECEWISE[path] = self.mark is not None and piecewise(json.load(file))
        self.piecewise = self._PIECEWISE[path]

    def _learn(self, pieces: list[bytes]) -> None:
        tokenize, match, known, rest, ended = self.tokenizer.model.tokenize, self._WORD.fullmatch, self.known, [], []
        for p in pieces:
            if p.isalpha():  # no step before the merges changes it
                ids = [t.id for t in tokenize(p.decode())]
                known[p] = _PACK[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()
                continue
            found = match(p)
            if not found:
                rest.append(p)
                continue
            word, signs = found.groups()
            if word not in known:  # nor this but for the spelling of its bytes
                ids = [t.id for t in tokenize(word.decode("latin-1").translate(self._SPELT))]
                known[word] = np.array(ids, "<u4").tobytes()
            if signs:
                ended.append((p, word, signs))
        pieces = [*rest, *{s for _, _, s in ended if s not in known}]
        for at in range(0, len(pieces), 2048):
            part = pieces[at : at + 2048]
            ids = np.array(self.tokenizer.encode(self.MARK.join(p.decode() for p in part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(ids == self.mark).tolist()
            raw = ids.tobytes()
            for p, a, b in zip(part, [0, *(s + 1 for s in stops)], [*stops, len(ids)], strict=True):
                self.known[p] = raw[4 * a : 4 * b]
        for p, word, signs in ended:
            known[p] = known[word] + known[signs]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        cut, new = [], set()
        for text in texts:
            data = text.encode().lower()
            if not self.piecewise or b"<|" in data:
                cut.append(None)
            else:
                pieces = data.replace(b"\n", b" ").split(b" ")
                cut.append(pieces)
                new.update(pieces)
        new = new.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.known[b""] = b""
            new = {p for pieces in cut if pieces for p in pieces if p}
        self._learn(list(new))
        look = self.known.__getitem__
        out = []
        for text, pieces in zip(texts, cut, strict=True):
            if pieces is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end)
            else:
                out.append(b"".join([*map(look, pieces), self.end]))
        return out


def shards_for(df: DataFrame, least: int) -> int:
    """Shards of about SHARD_BYTES of input by the size that the plan expects, at least ``least``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(-(-size // SHARD_BYTES), 1 << 20)) if size < 1 << 60 else least


def write_shards(df: DataFrame, out: str, tokenizer: str, end_id: int, shards: int, id_col: str = "doc_id", text: str = "text") -> list[tuple]:
    """Writes df in ascending order of id_col as shards under out; one row (number, uri, documents, ids) a shard, in order.

    A null text is the empty text (its end id alone). Null identifiers come first. Documents of one
    identifier stand in the order of a hash of their text; they may span two shards, each of which
    numbers its own. A text of any length is encoded whole. An empty table gives no shard. tokenizer must be readable on all executors.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    ordered = source.repartitionByRange(shards, "id", F.xxhash64("t")).sortWithinPartitions("id", F.xxhash64("t"))

    def run(batches):
        encode, task, writer = Encoder(tokenizer, end_id), TaskContext.get(), None
        files, root = open_path(out)
        name = f"{root}/shard-{task.partitionId():06d}.sst"
        own = f"{name}.{task.taskAttemptId()}"
        for batch in batches:
            for part in slices(batch, "t"):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    if writer is None:
                        files.create_dir(root, recursive=True)
                        writer = Writer(files.open_output_stream(own))
                    writer.add(doc_id, np.frombuffer(ids, "<u4"))
        if writer is not None:
            writer.close()
            writer.sink.close()
            files.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([f"{out}/shard-{task.partitionId():06d}.sst"]), pa.array([writer.n_docs]), pa.array([writer.n_ids])], ["shard", "uri", "documents", "ids"])

    return sorted(tuple(r) for r in ordered.mapInArrow(run, "shard long, uri string, documents long, ids long").collect())


def read_shards(spark, manifest: list[tuple], id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, read back from the shards; start counts the ids of all documents before it."""
    starts, total = [], 0
    for _, uri, _, ids in manifest:
        starts.append((uri, total))
        total += ids

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Reader(uri)
                for k in range(len(shard.index)):
                    rows = [(id_of(key), len(ids), zlib.crc32(ids.tobytes())) for key, ids in shard.block(k)]
                    n = np.array([r[1] for r in rows])
                    begin = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                    start += int(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(begin), pa.array(n), pa.array([r[2] for r in rows], pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])
                shard.close()

    listed = spark.createDataFrame(starts, "uri string, start long").repartition(max(1, len(starts)))
    return listed.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
