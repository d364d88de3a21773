"""Sorted-string-table shards: token ids keyed by document id, with binary-search lookup.

Layout of a shard, in order (integers little-endian, keys big-endian so that byte order is key order):

* data blocks: entries ``varint shared, varint suffix length, varint value length, suffix, value``; a key
  is its first ``shared`` bytes of the key before it, then the suffix. Every 16th entry is a restart with
  nothing shared; the block ends with the restarts' places and their number. A block is stored
  zstd-compressed, behind its crc32.
* index block, like a data block: the last key of each data block, with its place and stored size.
* Bloom filter: bits of all keys, then the number of probes.
* footer, 60 bytes: places and sizes of index and filter, counts of documents and ids, magic.

A key is the document id with its sign bit flipped, then the row's number among the shard's rows of the same id, so
repeated ids keep all their rows. A null id sorts before all others (flag byte 0). Rows of one id may go on in the next shards.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumafold.llm.chunk_encoder import encoder
from lumafold.llm.common import new_dir, stage

MAGIC = b"LFSSTBL1"
FOOTER = struct.Struct("<QQQQQQ4x8s")
RESTART = 16
PROBES = 7
BITS_PER_KEY = 10


def make_key(doc_id: int | None, copy: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")) + copy.to_bytes(4, "big")


def split_key(key: bytes) -> tuple[int | None, int]:
    return (None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)), int.from_bytes(key[9:13], "big")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = raw[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


class _Block:
    def __init__(self) -> None:
        self.parts, self.size, self.count, self.last, self.restarts = [], 0, 0, b"", []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(self.size)
        else:
            for a, b in zip(key, self.last, strict=False):
                if a != b:
                    break
                shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.parts += (entry, value)
        self.size += len(entry) + len(value)
        self.count, self.last = self.count + 1, key

    def packed(self, zstd: zstandard.ZstdCompressor) -> bytes:
        raw = b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        body = zstd.compress(raw)
        return struct.pack("<I", zlib.crc32(body)) + body


def _unpacked(stored: bytes) -> bytes:
    if zlib.crc32(stored[4:]) != struct.unpack_from("<I", stored)[0]:
        raise ValueError("a block's checksum is wrong")
    return zstandard.ZstdDecompressor().decompress(stored[4:])


def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    key = b""
    while at < end:
        shared, at = _read_varint(raw, at)
        suffix, at = _read_varint(raw, at)
        size, at = _read_varint(raw, at)
        key = key[:shared] + raw[at : at + suffix]
        at += suffix
        yield key, raw[at : at + size]
        at += size


def _restarts(raw: bytes) -> tuple[list[int], int]:
    n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
    end = len(raw) - 4 - 4 * n
    return list(struct.unpack_from(f"<{n}I", raw, end)), end


def _seek(raw: bytes, key: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Entries from the last restart whose key isn't after ``key``: a binary search over restarts."""
    starts, end = _restarts(raw)
    at = bisect.bisect_right(starts, key, key=lambda s: next(_entries(raw, s, end))[0]) - 1
    return _entries(raw, starts[max(at, 0)], end)


def _halves(key: bytes) -> tuple[int, int]:
    """Two 64-bit hashes of a key's id."""
    h = xxhash.xxh3_128_intdigest(key[:9])
    return h & ((1 << 64) - 1), h >> 64


def _probes(a: int, b: int, bits: int) -> list[int]:
    return [(a + k * (b | 1)) % bits for k in range(PROBES)]


class ShardWriter:
    """Writes one shard to a binary stream; keys must ascend."""

    def __init__(self, sink, block_bytes: int = 1 << 16) -> None:
        self.sink, self.block_bytes = sink, block_bytes
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.block, self.index, self.at = _Block(), _Block(), 0
        self.first = self.last = b""
        self.hashes = array("Q")  # two for each id
        self.docs = self.ids = 0

    def _write(self, stored: bytes) -> tuple[int, int]:
        place = (self.at, len(stored))
        self.sink.write(stored)
        self.at += len(stored)
        return place

    def _flush(self) -> None:
        if self.block.count:
            last = self.block.last
            self.index.add(last, struct.pack("<QQ", *self._write(self.block.packed(self.zstd))))
            self.block = _Block()

    def add(self, key: bytes, value: bytes) -> None:
        if self.docs and key <= self.last:
            raise ValueError("keys must ascend")
        self.block.add(key, value)
        if not self.docs:
            self.first = key
        if key[:9] != self.last[:9]:
            self.hashes.extend(_halves(key))
        self.last = key
        self.docs, self.ids = self.docs + 1, self.ids + len(value) // 4
        if self.block.size >= self.block_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        index = self._write(self.index.packed(self.zstd))
        bits = max(64, BITS_PER_KEY * len(self.hashes) // 2)
        bloom = bytearray((bits + 7) // 8)
        for a, b in zip(self.hashes[::2], self.hashes[1::2], strict=True):
            for p in _probes(a, b, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        filter_ = self._write(struct.pack("<Q", bits) + bytes(bloom))
        self.sink.write(FOOTER.pack(*index, *filter_, self.docs, self.ids, MAGIC))


class ShardReader:
    """Reads a shard from a seekable file: whole, in key order, or by binary-search lookup."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        self.index_at, self.index_size, self.bloom_at, self.bloom_size, self.docs, self.ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self._index = _unpacked(self._read(self.index_at, self.index_size))
        self._bloom: bytes | None = None

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def may_have(self, doc_id: int | None) -> bool:
        if self._bloom is None:
            self._bloom = self._read(self.bloom_at, self.bloom_size)
        bits = struct.unpack_from("<Q", self._bloom)[0]
        return all(self._bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(*_halves(make_key(doc_id)), bits))

    def get(self, doc_id: int | None, copy: int = 0) -> bytes | None:
        key = make_key(doc_id, copy)
        if not self.docs or not self.may_have(doc_id):
            return None
        for last, place in _seek(self._index, key):
            if last >= key:
                block = _unpacked(self._read(*struct.unpack("<QQ", place)))
                for k, value in _seek(block, key):
                    if k >= key:
                        return value if k == key else None
        return None

    def get_all(self, doc_id: int | None) -> Iterator[bytes]:
        """The values of all rows with an id that this shard holds."""
        if not self.docs or not self.may_have(doc_id):
            return
        low, high = make_key(doc_id), make_key(doc_id, (1 << 32) - 1)
        for last, place in _seek(self._index, low):
            if last < low:
                continue
            block = _unpacked(self._read(*struct.unpack("<QQ", place)))
            for key, value in _seek(block, low):
                if key > high:
                    return
                if key >= low:
                    yield value

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        if self.docs:
            for _, place in _entries(self._index, 0, _restarts(self._index)[1]):
                block = _unpacked(self._read(*struct.unpack("<QQ", place)))
                yield from _entries(block, 0, _restarts(block)[1])


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, drops_space: bool = True, shard_bytes: int = 32 << 20) -> DataFrame:
    """Encode ``docs`` and write them to shards under ``path``, in ascending doc_id order from shard to shard.

    Shards are ranges of doc_id with about ``shard_bytes`` of text each (raise it with the corpus, to keep files few). Rows of one
    id (or without one) are split further by their text's hash, so an id that many texts share fills as many shards as it needs; equal
    rows stay in one shard, where a text is encoded once in a step. A range is sorted by Spark, with spill, and streamed through
    the encoder into its file, so memory doesn't grow with it but for 16 bytes of filter hashes an id.
    Returns the manifest: a row (shard, file, n_docs, n_ids, first_key, last_key) for each shard. A file bears its task attempt's name,
    and only the manifest, which Spark commits once, says which file counts: a lost executor's shard is written again under another
    name, and nothing is renamed (a copy on object stores).
    Null and empty texts hold only the end id; repeated ids keep all rows; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        task = TaskContext.get()
        file = f"shard-{task.partitionId():08d}-{task.taskAttemptId()}.sst"
        enc, writer, sink, last, copy = encoder(tokenizer, drops_space), None, None, (), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{file}")
                    writer = ShardWriter(sink)
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                once = list(dict.fromkeys(texts))
                of = dict(zip(once, enc.encode(once), strict=True))
                for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    copy = copy + 1 if last == (doc,) else 0
                    last = (doc,)
                    writer.add(make_key(doc, copy), of[text] + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((task.partitionId(), file, writer.docs, writer.ids, writer.first, writer.last), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "file", "n_docs", "n_ids", "first_key", "last_key"])

    order = (F.asc_nulls_first("doc_id"), F.xxhash64("text").asc())
    spread = docs.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order, "text")
    return stage(spread.mapInArrow(write, "shard long, file string, n_docs long, n_ids long, first_key binary, last_key binary"), "sst-manifest")


#: Shards of one bucket of the prefix sum over the manifest.
BUCKET = 1024


def shard_starts(manifest: DataFrame) -> DataFrame:
    """file and base (ids in all shards before): a prefix sum in two steps, over buckets of shards and inside each."""
    placed = manifest.select("shard", "file", "n_ids", F.floor(F.col("shard") / BUCKET).alias("bucket"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row for each BUCKET shards
    buckets = placed.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select("bucket", F.coalesce(before, F.lit(0)).alias("ahead"))
    inside = F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(buckets, "bucket").select("file", (F.col("ahead") + F.col("inside")).alias("base"))


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """The rows of written shards: doc_id, start (ids of all rows before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/{file}") as source:
                    rows: list[tuple] = []
                    for key, value in ShardReader(source).scan():
                        rows.append((split_key(key)[0], start, len(value) // 4, zlib.crc32(value)))
                        start += len(value) // 4
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return shard_starts(manifest).repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Ids that one lookup may ask for.
MOST_WANTED = 10_000


def lookup(manifest: DataFrame, path: str, wanted: list[int | None]) -> DataFrame:
    """doc_id and ids (binary, little-endian) of every row with one of the ``wanted`` ids (MOST_WANTED at most).

    An id meets the shards whose range of keys may hold it (one, unless its rows go on in the next); there the Bloom filter, the
    sparse index and binary search find it, and no other block is read.
    """
    if len(wanted) > MOST_WANTED:
        raise ValueError(f"at most {MOST_WANTED} ids a lookup")
    asked = manifest.sparkSession.createDataFrame([(i, make_key(i), make_key(i, (1 << 32) - 1)) for i in dict.fromkeys(wanted)], "doc_id long, low binary, high binary")
    met = manifest.select("file", "first_key", "last_key").join(F.broadcast(asked), (F.col("first_key") <= F.col("high")) & (F.col("last_key") >= F.col("low")))

    def find(key: tuple, table: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(path)
        ids, values = [], []
        with fs.open_input_file(f"{root}/{key[0].as_py()}") as source:
            reader = ShardReader(source)
            for doc in table["doc_id"].to_pylist():
                for value in reader.get_all(doc):
                    ids.append(doc)
                    values.append(value)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(values, pa.binary())})

    return met.select("file", "doc_id").groupBy("file").applyInArrow(find, "doc_id long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and read them back."""
    path = new_dir(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, tokenizer, path, **how), path)
