"""Substring dedup with difference-cover anchors.

A window is ``length`` consecutive words of one document. A word is removed if a window that covers it has
the same words as a window that starts in a document with a smaller doc_id.

Hashing every window of the corpus into a shuffle would cost more than the texts. Instead only anchors are
hashed: runs of ``length - PERIOD + 1`` words that start at a place whose remainder modulo PERIOD lies in
a difference cover. For any two places there is a shift below PERIOD that brings both into the cover, so
two equal windows hold an equal, aligned anchor. Anchors that occur in one document only are dropped. Every
other anchor is extended to all windows that hold it, and only these windows are compared, as wholes, over
all documents. So no match is lost. Anchors are hashed to 64 bits, since a false anchor only adds a candidate; what decides
(windows, and whole sequences) to 128 bits, so that none is added at any size of corpus.

The same comparison finds whole copies: a document's word sequence counts as one more anchor. A copy of a
document with a smaller id loses all its words and needs no windows.

Every step is a partial aggregation (smallest and largest doc_id of a hash) followed by an equi-join on the
hash, which adaptive execution splits where one passage fills much of the corpus; no group is collected
but the places of one document, as a set, so equal rows of one id add nothing to it.

Null texts: no words. Texts with fewer than ``length`` words lose nothing. Rows that repeat a doc_id are
one document to the rule: they remove nothing of each other, and each loses its own words only. A null doc_id
sorts after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumafold.llm.common import MULTIPLIERS, OnceEach, drop_staged, own_memory, release, rolling, stage, with_row_keys, word_hashes

#: A perfect difference set: every residue modulo 31 is a difference of two members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
LAST_ID = (1 << 63) - 1
#: The place of a document's whole word sequence among its anchors.
WHOLE = -1

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def anchor_places(n: int) -> np.ndarray:
    """Which of the first ``n`` places are in the cover."""
    return np.flatnonzero(np.resize(_IN_COVER, n)) if n > 0 else np.empty(0, np.int64)


def candidate_windows(places: np.ndarray, width: int, length: int, n: int) -> np.ndarray:
    """Starts of all windows of ``length`` words, of ``n`` words, that hold an anchor of ``width`` words at one of ``places``."""
    step = np.zeros(n + 2, np.int64)
    np.add.at(step, np.maximum(places - (length - width), 0), 1)
    np.add.at(step, places + 1, -1)
    return np.flatnonzero(np.cumsum(step)[: max(0, n - length + 1)] > 0)


def _named(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("__lf_doc").alias("doc"), F.col("__lf_key").alias("key"), F.col("text").cast("string").alias("text"))


def _flush(found: list[tuple[np.ndarray, np.ndarray, int, int, np.ndarray]]) -> pa.RecordBatch:
    h, h2 = (np.concatenate([x[k] for x in found]).view(np.int64) for k in (0, 1))
    sizes = [len(x[0]) for x in found]
    doc, key = (np.repeat(np.array([x[k] for x in found], np.int64), sizes) for k in (2, 3))
    at = np.concatenate([x[4] for x in found]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(h2), pa.array(doc), pa.array(key), pa.array(at)], ["h", "h2", "doc", "key", "at"])


def anchors(keyed: DataFrame, length: int = 50) -> DataFrame:
    """h, h2, doc, key, at: hashes of all anchors (h2 is 0), and of the whole word sequence (128 bits), of rows with ``length`` words or more."""
    width = length - PERIOD + 1
    if width < 1:
        raise ValueError(f"windows must have {PERIOD} words or more")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("words", word_hashes.clear)
        once = OnceEach()
        for batch in batches:
            found, size = [], 0
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words = text.split() if text and once.first(doc, key) else ()
                if len(words) < length:
                    continue
                at = anchor_places(len(words) - width + 1)
                whole = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words), seed=1), np.uint64)
                h2 = np.zeros(len(at) + 1, np.uint64)
                h2[-1] = whole[1]
                found.append((np.append(rolling(word_hashes.of(words), width)[at], whole[0]), h2, doc, key, np.append(at, WHOLE)))
                size += len(h2)
                if size > 200_000:
                    yield _flush(found)
                    found, size = [], 0
            if found:
                yield _flush(found)

    return _named(keyed).mapInArrow(find, "h long, h2 long, doc long, key long, at int")


def _shared(table: DataFrame) -> DataFrame:
    """h, h2, first: the hashes that occur in two documents or more, and the smallest of these."""
    return table.groupBy("h", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h", "h2", "first")


def _with_places(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """doc, key, text, places of the rows that ``places`` (doc, key, places) has anchors of."""
    return _named(keyed).join(places.hint("shuffle_hash"), ["doc", "key"]).select("doc", "key", "text", "places")


def _windows(held: DataFrame, length: int) -> DataFrame:
    """h, h2, doc, key, at of the candidate windows around the anchors in ``held`` (doc, key, text, places)."""
    width = length - PERIOD + 1

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("words", word_hashes.clear)
        once = OnceEach()
        for batch in batches:
            found, size = [], 0
            for doc, key, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3), strict=True):
                words = text.split() if text and once.first(doc, key) else ()
                if len(words) < length:
                    continue
                starts = candidate_windows(at.values.to_numpy(), width, length, len(words))
                hashes = word_hashes.of(words)
                found.append((*(rolling(hashes, length, m)[starts] for m in MULTIPLIERS), doc, key, starts))
                size += len(starts)
                if size > 200_000:
                    yield _flush(found)
                    found, size = [], 0
            if found:
                yield _flush(found)

    return held.mapInArrow(extend, "h long, h2 long, doc long, key long, at int")


def removals(keyed: DataFrame, length: int = 50) -> DataFrame:
    """doc, key, copy, starts: what each row loses, all or the words of the windows at ``starts``."""
    table = anchors(keyed, length)
    # Written, so that the join has an exchange on either side, which adaptive execution can split.
    shared = stage(_shared(table), "shared-anchors")
    release(keyed.sparkSession)
    hits = table.join(shared, ["h", "h2"])
    is_copy = (F.col("at") == WHOLE) & (F.col("doc") > F.col("first"))
    by_doc = stage(hits.groupBy("doc", "key").agg(F.max(is_copy).alias("copy"), F.collect_set(F.when(F.col("at") != WHOLE, F.col("at"))).alias("places")), "anchors")
    release(keyed.sparkSession)
    # Written, since the windows are hashed twice from the few texts with shared anchors: all texts move once, not twice.
    held = stage(_with_places(keyed, by_doc.where("not copy and size(places) > 0").select("doc", "key", "places")), "held")
    release(keyed.sparkSession)
    found = _windows(held, length)
    repeated = stage(_shared(found), "shared-windows")
    release(keyed.sparkSession)
    late = found.join(repeated, ["h", "h2"]).where("doc > first").groupBy("doc", "key").agg(F.collect_set("at").alias("starts"))
    copies = by_doc.where("copy").select("doc", "key", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts"))
    out = stage(late.select("doc", "key", F.lit(False).alias("copy"), "starts").unionByName(copies), "removals")
    drop_staged(by_doc, shared, held, repeated)
    release(keyed.sparkSession)
    return out


def cut_words(words: list[bytes], copy: bool | None, starts: np.ndarray | None, length: int) -> list[bytes]:
    """The words that stay."""
    if copy:
        return []
    if starts is None or not len(starts):
        return words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(step)[:-1] == 0)]


def _with_removals(docs: DataFrame, length: int) -> DataFrame:
    keyed = with_row_keys(docs, LAST_ID)
    gone = removals(keyed, length).withColumnsRenamed({x: f"__lf_{x}" for x in ("doc", "key", "copy", "starts")})
    return keyed.join(gone.hint("shuffle_hash"), ["__lf_doc", "__lf_key"], "left").drop("__lf_doc", "__lf_key")


def _starts(column: pa.Array) -> Iterator[np.ndarray | None]:
    for x in column:
        yield x.values.to_numpy() if x.is_valid else None


def dedup_digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, and the sha256 of the words that stay, joined by one space."""
    joined = _with_removals(docs.select("doc_id", F.col("text").cast("string").alias("text")), length).select("doc_id", "text", "__lf_copy", "__lf_starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            for text, copy, starts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), _starts(batch.column(3)), strict=True):
                words = text.split() if text else []
                kept = cut_words(words, copy, starts, length)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, length: int = 50, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """``docs`` with removed words cut from ``text`` (the rest joined by one space; texts that lose nothing stay as they are).

    Adds ``counts`` (long): words before, and words removed. Other columns stay, but for such as are named like ``counts``.
    """
    names = [c for c in docs.columns if c not in counts]
    at = names.index("text")
    joined = _with_removals(docs, length).select(*names, "__lf_copy", "__lf_starts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names) + f", `{counts[0]}` long, `{counts[1]}` long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, removed = [], [], []
            for text, copy, starts in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist(), _starts(batch.column(len(names) + 1)), strict=True):
                words = text.split() if text else []
                kept = cut_words(words, copy, starts, length)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(text if len(kept) == len(words) else b" ".join(kept))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], [*names, *counts])

    return joined.mapInArrow(cut, schema)


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM words WHERE len(w) >= 50)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS least_id FROM windows) WHERE least_id < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS places FROM late, range(50) AS t(k) GROUP BY doc_id
), kept AS (
  SELECT words.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i - 1)) END AS k
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
