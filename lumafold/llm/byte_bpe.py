"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each neighbouring pair that the vocabulary can merge lies in a
bucket of its merge rank, as the place of its left part. A bitmap of 64-bit words marks the buckets in use, and a
bitmap above it the words in use: find-first-set on the way down gives the lowest rank at a cost that depends
neither on the pre-token's length nor on the number of waiting pairs. A place whose pair has
changed since it was queued is skipped when it comes up. Within a bucket the leftmost place comes first,
as in the reference order of merges.

Words repeat, so the ids of what stands between two spaces are kept in a bounded memo. The work for a pre-token of n bytes is O(n log n) at worst (the buckets are heaps), so one
pre-token of megabytes is no special case.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumafold.llm.chunk_encoder import LONGEST, chunk_of, cuts, safe_chunks, safe_word
from lumafold.llm.common import own_memory

def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with pafs.FileSystem.from_uri(path)[0].open_input_stream(pafs.FileSystem.from_uri(path)[1]) if "://" in path else open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.read().splitlines()) if token}


class RankQueue:
    """Bitmaps over ranks: a bit in ``low`` for each rank in use. The level above, a bit for each word of ``low`` that isn't
    zero, is one integer that merge_bytes keeps, as it does the buckets."""

    def __init__(self, size: int) -> None:
        self.low = [0] * ((size + 63) >> 6)


_BIT = [1 << k for k in range(64)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of one pre-token. All bits of the queue are clear before and after.

    Pushing and popping stand in line, since they are most of the work. A bucket is a place, or a heap of places if
    there are several.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    low, top, bit, rank_of = queue.low, 0, _BIT, ranks.get
    buckets: dict[int, int | list[int]] = {}
    after = list(range(1, n + 1))  # the place right of a part, which is also the part's end
    before = list(range(-1, n - 1))
    waiting = [-1] * n  # the rank under which the pair that begins here is queued
    fresh = [(rank, i) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    while True:
        for rank, i in fresh:  # push
            waiting[i] = rank
            if rank in buckets:
                bucket = buckets[rank]
                if type(bucket) is int:
                    buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heapq.heappush(bucket, i)
            else:
                buckets[rank] = i
                word = rank >> 6
                low[word] |= bit[rank & 63]
                top |= 1 << word
        if not top:
            break
        # find-first-set on both levels: the lowest rank in use, and its leftmost place
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        i = buckets[rank]
        if type(i) is not int:
            bucket = i
            i = heapq.heappop(bucket)
            if len(bucket) == 1:
                buckets[rank] = bucket[0]
        else:
            del buckets[rank]
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
        fresh = []
        if waiting[i] != rank:
            continue  # stale: the pair has changed or gone
        j = after[i]
        end = after[j]
        after[i] = end
        waiting[i] = waiting[j] = -1
        if end < n:
            before[end] = i
            new = rank_of(piece[i : after[end]])
            if new is not None:
                fresh.append((new, i))
        left = before[i]
        if left >= 0:
            new = rank_of(piece[left:end])
            if new is None:
                waiting[left] = -1
            elif new != waiting[left]:
                fresh.append((new, left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class ByteBPE:
    """Encodes texts by ranks and a pre-token pattern, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cap: int = 700_000) -> None:
        self.ranks, self.cap = ranks, cap
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.marks = {m: self._chunk(m) for m in ".,!?;:"}
        #: Whether the pattern takes words as _word() expects, so that it needn't run on each.
        self.plain = [self.split(x) for x in (" the", " É,", " ñu:", " x!")] == [[" the"], [" É", ","], [" ñu", ":"], [" x", "!"]]
        self.words: dict[str, bytes] = {}  # of a space and the word
        self.older: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for pretoken in self.split(chunk):
            ids += merge_bytes(pretoken.encode(), self.ranks, self.queue)
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word of cuts(). Letters are one pre-token with the space before them, a closing mark is another one; all
        else goes through the pattern."""
        mark = self.marks.get(word[-1])
        core = word[:-1] if mark else word
        if self.plain and core.isalpha():
            if mark is None:
                return array("I", merge_bytes((" " + core).encode(), self.ranks, self.queue)).tobytes()
            ids = self.words.get(core) or self.older.get(core)
            if ids is None:
                ids = self.words[core] = self._word(core)
            return ids + mark
        return self._chunk(chunk_of(word))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = []
        for text in texts:
            head, *rest = cuts(text)
            part = list(map(self.words.get, rest))
            older = self.older
            safe = not rest or safe_word(head)
            for i in [i for i, ids in enumerate(part) if ids is None]:
                word = rest[i]
                if not safe_word(word):
                    safe = False  # not every space of this text is a place to cut
                    break
                ids = older.get(word) or self._word(word)
                part[i] = ids
                if len(word) <= LONGEST:
                    self.words[word] = ids
            if not safe:
                out.append(b"".join(map(self._chunk, safe_chunks(text))))
                continue
            out.append(self._chunk(head) + b"".join(part))
            if len(self.words) > self.cap:
                self.older, self.words = self.words, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian unsigned 32-bit ids stand for."""
        return self.decode_list(np.frombuffer(ids, "<u4").tolist())

    def decode_list(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _kept(path: str, pattern: str, cap: int) -> ByteBPE:
    return ByteBPE(load_ranks(path), pattern, cap)


def codec(path: str, pattern: str, cap: int = 700_000) -> ByteBPE:
    """One codec for each worker process, kept over its tasks."""
    own_memory(path, _kept.cache_clear)
    return _kept(path, pattern, cap)


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, text and ids (binary, little-endian unsigned 32-bit). Null and empty texts have no ids.

    Repeated rows are encoded each; an empty table gives an empty result; other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                ids = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

    return _columns(docs).mapInArrow(encode, "doc_id long, text string, ids binary")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Add ``decoded`` (binary) to a table with doc_id and ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks, pattern)
        for batch in batches:
            raw = [bpe.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode, decode, and return doc_id, n_tokens, and sha256 of the decimal ids and of the decoded bytes.

    Both steps run in one pass, so that neither ids nor decoded texts leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks, pattern)
        decimal = list(map(str, range(len(bpe.tokens))))
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                n, ids_sha, text_sha = [], [], []
                for raw in bpe.encode([t or "" for t in batch.column(1).to_pylist()]):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode_list(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _columns(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
