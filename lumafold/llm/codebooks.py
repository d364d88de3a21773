"""Vector codes from codebooks that are refined in rounds, with kd-trees for the nearest entry.

Components become integers (floor of SCALE times the component), vectors are cut into equal parts, and each part position has
a codebook. A codebook starts as its part of the vectors with the smallest ids; each round assigns every part to the
nearest entry of its codebook and moves entries to the floored means of their parts. All arithmetic is on integers, so
results don't depend on how rows are dealt.

Each round broadcasts one kd-tree for each codebook (``entries`` rows of a part's length, whatever the table). A tree is
searched branch and bound for a whole batch at once: rows go down their near side first, and take the other side only if its
box is no farther than what they have. Boxes at the same distance are visited too, so that of equally near entries the one
with the lowest index survives. Tasks sum their rows by entry; a few rows a task go to the sum over all, and one row for
each entry and position comes back. The integers are written once and read by every round.

Vectors that are null, or hold a null or non-finite component, or another number of components than most (the smaller of
two equally common ones stays) take no part. Repeated ids are rows of their own; among the first entries they are in the order
of their integers. Null ids come after all others. With fewer rows than ``entries`` a codebook has as many entries as there
are rows. An empty table has no codes. Integers beyond REACH, or a number of components that ``parts`` doesn't divide, are
errors, since squared distances must fit into 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumafold.llm.common import drop_staged, stage

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Largest size of an integer component.
REACH = (1 << 26) - 1
#: Components of a vector at most, so that its squared distance stays below 2^62.
WIDEST = 256
#: Entries of a leaf, and rows searched at once.
LEAF, TOGETHER = 4, 8192


class KdTree:
    """A kd-tree over the rows of ``entries`` (integers). A node is the box of its entries; inner nodes halve their widest side."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.nodes: list[dict] = []
        self._build(np.arange(len(entries)))

    def _build(self, members: np.ndarray) -> int:
        inside = self.entries[members]
        node: dict = {"low": inside.min(axis=0), "high": inside.max(axis=0), "members": np.sort(members)}
        at = len(self.nodes)
        self.nodes.append(node)
        if len(members) > LEAF:
            axis = int((node["high"] - node["low"]).argmax())
            order = members[np.lexsort((members, inside[:, axis]))]
            half = len(order) // 2
            node["axis"], node["split"] = axis, int(self.entries[order[half - 1], axis])
            node["left"], node["right"] = self._build(order[:half]), self._build(order[half:])
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``points`` the index of the nearest entry, the lowest among equals, and its squared distance."""
        index = np.full(len(points), len(self.entries), np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max, np.int64)
        self._visit(0, np.arange(len(points)), points, index, best)
        return index, best

    def _visit(self, at: int, rows: np.ndarray, points: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        node = self.nodes[at]
        here = points[rows]
        gap = np.maximum(np.maximum(node["low"] - here, here - node["high"]), 0)
        open_ = np.einsum("ij,ij->i", gap, gap) <= best[rows]  # a box at an equal distance may hold a lower index
        if not open_.any():
            return
        rows, here = rows[open_], here[open_]
        if "axis" not in node:
            apart = here[:, None, :] - self.entries[node["members"]][None, :, :]
            squares = np.einsum("ijk,ijk->ij", apart, apart)
            first = squares.argmin(axis=1)  # members ascend, so this is the lowest index of a leaf
            d, e = squares[np.arange(len(rows)), first], node["members"][first]
            better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
            index[rows[better]], best[rows[better]] = e[better], d[better]
            return
        low = here[:, node["axis"]] <= node["split"]
        for child, near in ((node["left"], rows[low]), (node["right"], rows[~low]), (node["right"], rows[low]), (node["left"], rows[~low])):
            if len(near):
                self._visit(child, near, points, index, best)


def integers(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """id, label and v (little-endian 32-bit integers) of the rows that take part; written."""
    kept = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("x"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = kept.where(F.col("x").isNotNull() & ~odd)
    sizes = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = sizes[0]["n"] if sizes else 0
    if width % PARTS or width > WIDEST:
        raise ValueError(f"vectors need a multiple of {PARTS} components, {WIDEST} at most")

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False) * float(SCALE))
            if len(x) and np.abs(x).max() > REACH:
                raise ValueError(f"components must stay below {REACH / SCALE}")
            raw = x.astype("<i4").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in raw], pa.binary())], ["id", "label", "v"])

    kinds = {name: kept.schema[name].dataType.simpleString() for name in ("id", "label")}
    return stage(kept.where(F.size("x") == width).mapInArrow(floor, f"id {kinds['id']}, label {kinds['label']}, v binary"), "integers")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Arrow batches in tables of about TOGETHER rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _parts(column: pa.ChunkedArray, parts: int) -> np.ndarray:
    """part x row x position."""
    raw = np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)
    return raw.reshape(len(column), parts, -1).transpose(1, 0, 2) if len(column) else raw.reshape(parts, 0, 0)


def summed(vectors: DataFrame, trees: Broadcast) -> DataFrame:
    """part, entry, at, total, n: the sums of all parts that an entry is nearest to, by position, and their number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = trees.value
        width, entries = found[0].entries.shape[1], len(found[0].entries)
        total, n = np.zeros((len(found), entries, width), np.int64), np.zeros((len(found), entries), np.int64)
        for table in _gathered(batches):
            for p, points in enumerate(_parts(table["v"], len(found))):
                if len(points):
                    near, _ = found[p].nearest(points)
                    np.add.at(total[p], near, points)
                    n[p] += np.bincount(near, minlength=entries)
        part, entry = np.nonzero(n)
        if len(part):
            columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), total[part, entry].ravel(), np.repeat(n[part, entry], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "at", "total", "n"])

    sent = vectors.select("v").mapInArrow(add, "part long, entry long, at long, total long, n long")
    # Sums over all rows may pass 64 bits.
    return sent.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def refined(vectors: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (part x entry x position) after ``rounds`` rounds over ``vectors`` (v)."""
    sc = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        trees = sc.broadcast([KdTree(book) for book in books])
        books = books.copy()
        for r in summed(vectors, trees).collect():
            books[r["part"], r["entry"], r["at"]] = int(r["total"]) // int(r["n"])
        trees.destroy()
    return books


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code, error of every row."""
    trees = vectors.sparkSession.sparkContext.broadcast([KdTree(book) for book in books])
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = trees.value
        for table in _gathered(batches):
            if table.num_rows:
                both = [tree.nearest(points) for tree, points in zip(found, _parts(table["v"], len(found)), strict=True)]
                codes = np.stack([near for near, _ in both], axis=1).astype(np.uint8)
                error = np.sum([d for _, d in both], axis=0)
                flat = [table[c].combine_chunks() for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*flat, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error.astype(np.int64))], ["id", "label", "code", "error"])

    return vectors.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def first_books(vectors: DataFrame, entries: int, parts: int) -> np.ndarray:
    """part x entry x position, from the rows with the smallest ids."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy() if rows else np.empty((parts, 0, 0), np.int64)


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, np.ndarray]:
    """The codes (id, label, code, error; a row for each row that takes part; written), and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so 256 entries at most")
    ints = integers(vectors, id_column, vector_column, label_column)
    books = refined(ints, first_books(ints, entries, PARTS), rounds) if (some := ints.limit(1).count()) else np.empty((PARTS, 0, 0), np.int64)
    codes = stage(encoded(ints, books) if some else ints.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), "codes")
    drop_staged(ints)
    return codes, books


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: the error summed over the rows of a label, or over those without one."""
    # Written: where labels are few its size is known, and small enough for Spark to send it around; else both sides are dealt
    # by label, and adaptive execution splits a hot one.
    sums = stage(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "label_"), "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("label_"))).drop("label_")


def code_table(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    codes, books = compressed(vectors)
    return label_errors(codes).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL: a statement for each round."""
    steps = [
        f"""kept AS (
  SELECT vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)""",
        f"part AS MATERIALIZED (SELECT vec_id, p, v[(p * len(v)) // {parts} + 1 : ((p + 1) * len(v)) // {parts}] AS v FROM kept, range({parts}) AS t(p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries})",
        "book0 AS MATERIALIZED (SELECT p, e, v FROM part JOIN first USING (vec_id))",
    ]

    def near(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (
  SELECT vec_id, x.p, min(struct_pack(d := list_sum([(pair[1] - pair[2]) * (pair[1] - pair[2]) FOR pair IN list_zip(x.v, b.v)])::BIGINT, e := b.e)) AS best
  FROM part x JOIN book{k} b ON b.p = x.p GROUP BY vec_id, x.p
)"""

    for k in range(rounds):
        steps += [
            near(k),
            f"""mean{k} AS (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
  FROM (SELECT p, best.e AS e, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM part JOIN near{k} USING (vec_id, p)) GROUP BY p, best.e, i)
  GROUP BY p, e
)""",
            f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (p, e))",
        ]
    steps += [
        near(rounds),
        f"code AS (SELECT vec_id, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)",
        f"sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})",
    ]
    body = ",\n".join(steps)
    return f"WITH {body}\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256\nFROM code JOIN kept USING (vec_id) CROSS JOIN sha"
