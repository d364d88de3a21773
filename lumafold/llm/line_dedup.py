"""Line dedup by overlapping three-line windows.

A text's lines are its \\n-separated parts; lines without a word (only white space) form no windows and are
never removed. Every ``width`` consecutive lines with words make a window, hashed to 128 bits. Of the
windows with the same lines the first stays: the one in the smallest doc_id, and there the earliest. All
later ones cover their lines, overlapping covers merge, and covered lines are removed.

A document sends each distinct window once, and its repeats inside the document are found in place, so a
window that fills a third of the corpus still meets the shuffle once per document, after a partial
aggregation for the counts; the join that brings the first document's id back is a plain equi-join that
adaptive execution splits where it is skewed.

Null texts: no lines, nothing removed, the text stays null. Empty texts: one line without a word. Rows that
repeat a doc_id count as one document for "first": neither removes the other's lines, but each loses its own
late lines only. A null doc_id sorts after all others. Extra columns are kept by ``dedup_lines``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumafold.llm.common import OnceEach, stage, with_row_keys

#: Stands for a null doc_id, after all others.
LAST_ID = (1 << 63) - 1


def word_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the places of those with a word."""
    lines = text.split(b"\n")
    return lines, [k for k, line in enumerate(lines) if line.strip(b" \t\r\x0b\x0c")]


def window_hashes(lines: list[bytes], places: list[int], width: int) -> list[bytes]:
    """16 bytes for each window of ``width`` consecutive lines with words."""
    digest = xxhash.xxh3_128_digest
    each = [digest(lines[k]) for k in places]
    return [digest(b"".join(each[i : i + width])) for i in range(len(each) - width + 1)]


def windows(keyed: DataFrame, width: int = 3) -> DataFrame:
    """Each row's distinct windows: two halves of the hash, doc_id, row key, and the number of the first window that has it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = OnceEach()
        for batch in batches:
            hashes: list[bytes] = []
            ids: list[int] = []
            keys: list[int] = []
            places: list[int] = []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if text and once.first(doc, key):
                    first: dict[bytes, int] = {}
                    for k, h in enumerate(window_hashes(*word_lines(text), width)):
                        first.setdefault(h, k)
                    hashes += first
                    places += first.values()
                    ids += [doc] * len(first)
                    keys += [key] * len(first)
            if ids:
                halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32())], ["h1", "h2", "doc", "key", "at"])

    return keyed.select("__lf_doc", "__lf_key", F.col("text").cast("string")).mapInArrow(find, "h1 long, h2 long, doc long, key long, at int")


def late_windows(keyed: DataFrame, width: int = 3) -> DataFrame:
    """doc, key, late: the numbers of a row's windows that a smaller doc_id has too; equal rows of an id share one set, no longer than a text."""
    found = windows(keyed, width)
    first = found.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h1", "h2", "first")
    # Written, so that the join has an exchange on either side, which adaptive execution can split.
    first = stage(first, "repeated-lines")
    late = found.join(first, ["h1", "h2"]).where("doc > first")
    return late.groupBy("doc", "key").agg(F.collect_set("at").alias("late"))


def covered(hashes: list[bytes], late: list[int], width: int) -> np.ndarray:
    """Which lines with words are covered by a window that is late (so are its repeats), or that the text had before."""
    n = len(hashes) + width - 1 if hashes else 0
    step = np.zeros(n + 1, np.int64)
    seen = {hashes[k] for k in late}
    for i, h in enumerate(hashes):
        if h in seen:
            step[i] += 1
            step[i + width] -= 1
        else:
            seen.add(h)
    return np.cumsum(step)[:n] > 0


def _kept(text: bytes, late: list[int], width: int) -> tuple[bytes, int, int]:
    """The text that stays, its number of lines before, and how many were removed."""
    lines, places = word_lines(text)
    gone = covered(window_hashes(lines, places, width), late, width)
    if not gone.any():
        return text, len(lines), 0
    removed = {places[k] for k in np.flatnonzero(gone)}
    return b"\n".join(line for k, line in enumerate(lines) if k not in removed), len(lines), len(removed)


def _with_late(docs: DataFrame, width: int) -> DataFrame:
    """docs, with the column of late windows beside; a row meets at most its own windows."""
    keyed = with_row_keys(docs, LAST_ID)
    late = late_windows(keyed, width).withColumnsRenamed({"doc": "__lf_doc", "key": "__lf_key", "late": "__lf_late"})
    return keyed.join(late.hint("shuffle_hash"), ["__lf_doc", "__lf_key"], "left").drop("__lf_doc", "__lf_key")


def _late(column: pa.Array) -> list[list[int]]:
    return [x or [] for x in column.to_pylist()]


def dedup_lines(docs: DataFrame, width: int = 3, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with repeated line windows removed from ``text``; adds ``counts`` (long): lines before, and lines removed.

    Other columns stay, but for such as are named like ``counts``.
    """
    names = [c for c in docs.columns if c not in counts]
    at = names.index("text")
    joined = _with_late(docs, width).select(*names, "__lf_late")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names) + f", `{counts[0]}` long, `{counts[1]}` long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(None, 0, 0) if text is None else _kept(text, late, width) for text, late in zip(batch.column(at).cast(pa.binary()).to_pylist(), _late(batch.column(len(names))), strict=True)]
            texts = pa.array([x[0] for x in out], pa.binary()).cast(pa.string())
            columns = [texts if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], [*names, *counts])

    return joined.mapInArrow(cut, schema)


def dedup_digest(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed and the sha256 of the text that stays, without moving texts after the cut."""
    joined = _with_late(docs.select("doc_id", F.col("text").cast("string").alias("text")), width).select("doc_id", "text", "__lf_late")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(b"", 0, 0) if text is None else _kept(text, late, width) for text, late in zip(batch.column(1).cast(pa.binary()).to_pylist(), _late(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in out], pa.string())],
                ["doc_id", "n_lines", "n_removed", "kept_sha256"],
            )

    return joined.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines long, n_removed long, kept_sha256 string")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT doc_id, k, line, row_number() OVER p AS i, lead(line, 1) OVER p AS line2, lead(line, 2) OVER p AS line3
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  WINDOW p AS (PARTITION BY doc_id ORDER BY k)
), late AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, i) AS copy
  FROM worded WHERE line3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, i + s AS i FROM late, range(3) AS t(s) WHERE copy > 1
), marked AS (
  SELECT l.doc_id, l.k, l.line, g.i IS NOT NULL AS removed
  FROM lines l LEFT JOIN worded w ON w.doc_id = l.doc_id AND w.k = l.k LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT removed), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN done ON done.doc_id = d.doc_id
"""
