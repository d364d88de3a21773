"""Best-fit packing of token sequences by hierarchical residual packing.

Pieces are packed best-fit-decreasing inside each input partition (in groups of ``group_rows`` consecutive pieces, so
that memory is bounded however large a partition is; the size of Arrow batches plays no part). Bins that are nearly
full are final; the others become items of the next round, where the bins of ``fan_in`` neighbouring groups are
packed together, and so on until one group is left. Moving whole bins keeps every piece's place inside its bin, so a
piece's final place is the sum of the offsets along its chain of bins.

Only ids, sizes and offsets move between rounds, never tokens. A group passes its ``carry`` emptiest underfull bins
upwards, and it can pass no more that would ever gain by it: of the bins that best-fit leaves, no two fit into one (the
later one's first item would have gone into the earlier), so all but one are more than half full, and each takes in at
most one bin of another group. A round therefore joins at most ``fan_in`` pairs, and a bin that fits anywhere
fits into the emptiest. With ``carry`` well above ``fan_in`` no join is lost, and no task grows with the corpus.

Nulls, empty texts: a null or empty text is one piece holding only the end id. Repeated rows are packed
as often as they occur. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumafold.llm.chunk_encoder import encoder
from lumafold.llm.common import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Documents encoded at a time in a worker.
STEP = 256


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [n]
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: id, number, start, length, crc32 of the ids, and if asked for the ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, ids in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids += end
                    start = 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + n)]
                        for column, value in zip(out, (doc, k, start, n, zlib.crc32(part), part if with_ids else None), strict=True):
                            column.append(value)
                        start += n
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 6 if with_ids else 5], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill.

    Open bins are listed by room left; a bit set of the rooms in use finds the tightest fit.
    """
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for k in order:
        size = sizes[k]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, fill


def _final(fill: list[int], capacity: int, full_enough: float, carry: int) -> list[bool]:
    """Which bins of a group go no further: nearly full ones, and all beyond the ``carry`` emptiest, which nothing could fill."""
    final = [f >= full_enough * capacity for f in fill]
    under = sorted((k for k, done in enumerate(final) if not done), key=lambda k: fill[k])
    for k in under[carry:]:
        final[k] = True
    return final


#: Groups of one partition, at most: a group's number is its partition's times this, plus its own.
GROUPS = 1 << 16


def pack(pieces: DataFrame, capacity: int = 1024, full_enough: float = 0.995, fan_in: int = 8, carry: int = 1024, group_rows: int = 1 << 18) -> DataFrame:
    """Give each piece (a ``length`` column of 1 to ``capacity``) a sequence_id and its offset in that sequence.

    ``pieces`` must be a stable table (a read of written files): its partitions are the groups of round 0.
    """
    if carry < 4 * fan_in:
        raise ValueError("carry must be at least four times fan_in")
    names = pieces.columns
    first = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", bin long, `offset` long, fill long, final boolean, grp long"
    schema = pa.schema([("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("final", pa.bool_()), ("grp", pa.int64())])

    def placed_group(batches: list[pa.RecordBatch], part: int, group: int, used: int) -> tuple[list[pa.RecordBatch], int]:
        """The batches of a group with the places of their pieces, and the number of its bins."""
        bins, offsets, fill = best_fit([n for b in batches for n in b.column(names.index("length")).to_pylist()], capacity)
        bins_at = np.array(bins, np.int64)
        columns = [
            (part << 36) + used + bins_at, np.array(offsets, np.int64), np.array(fill, np.int64)[bins_at],
            np.array(_final(fill, capacity, full_enough, carry), bool)[bins_at], np.full(len(bins_at), part * GROUPS + group, np.int64),
        ]
        out, at = [], 0
        for b in batches:
            added = [pa.array(c[at : at + b.num_rows], f.type) for c, f in zip(columns, schema, strict=True)]
            out.append(pa.RecordBatch.from_arrays([*b.columns, *added], [*names, *schema.names]))
            at += b.num_rows
        return out, len(fill)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        group = used = rows = 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, group_rows - rows)
                held.append(batch)
                at, rows = at + batch.num_rows, rows + batch.num_rows
                if rows == group_rows:
                    out, bins = placed_group(held, part, group, used)
                    yield from out
                    held, rows, group, used = [], 0, group + 1, used + bins
        if held:
            yield from placed_group(held, part, group, used)[0]

    placed = stage(pieces.mapInArrow(local, first), "pack-local")
    residual = placed.where("not final and `offset` = 0").select("bin", "fill", "grp")
    chains: DataFrame | None = None
    last = residual.agg(F.max("grp").alias("top"), F.max(F.col("grp") % GROUPS).alias("inner")).first()
    # Groups of one partition merge first, where there are several; then neighbouring partitions.
    top, step = last["top"], GROUPS
    if top is not None and not last["inner"]:
        top, residual, step = top // GROUPS, residual.withColumn("grp", F.floor(F.col("grp") / GROUPS).cast("long")), fan_in
    level = 0
    while top is not None:
        level += 1
        merged = stage(residual.select("bin", "fill", F.floor(F.col("grp") / step).cast("long").alias("up")).groupBy("up").applyInArrow(_merge(capacity, full_enough, carry), "bin long, root long, shift long, fill long, final boolean, grp long"), f"pack-merge-{level}")
        moved = merged.select("bin", "root", "shift")
        if chains is None:
            chains = moved
        else:
            up = moved.select(F.col("bin").alias("root"), F.col("root").alias("root2"), F.col("shift").alias("shift2"))
            chains = chains.join(up, "root", "left").select("bin", F.coalesce("root2", "root").alias("root"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"))
            chains = stage(chains, f"pack-chain-{level}")
        if top < step:
            break
        residual = merged.where("not final and shift = 0").select(F.col("root").alias("bin"), "fill", "grp")
        top, step = top // step, fan_in
    if chains is None:
        return placed.select(*names, F.col("bin").alias("sequence_id"), F.col("offset"))
    out = placed.join(chains, "bin", "left")
    return out.select(*names, F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def _merge(capacity: int, full_enough: float, carry: int):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((table["bin"].to_numpy(), -table["fill"].to_numpy()))
        table = table.take(pa.array(order))
        ids, sizes = table["bin"].to_pylist(), table["fill"].to_pylist()
        bins, offsets, fill = best_fit(sizes, capacity)
        final = _final(fill, capacity, full_enough, carry)
        root = {b: ids[k] for k, (b, o) in enumerate(zip(bins, offsets, strict=True)) if o == 0}
        return pa.table({
            "bin": pa.array(ids, pa.int64()), "root": pa.array([root[b] for b in bins], pa.int64()), "shift": pa.array(offsets, pa.int64()),
            "fill": pa.array([fill[b] for b in bins], pa.int64()), "final": pa.array([final[b] for b in bins]), "grp": pa.array([key[0].as_py()] * len(bins), pa.int64()),
        })

    return merge


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False, **how) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row for each piece, with its place (and its ids if ``with_ids``)."""
    return pack(stage(token_pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity, **how)
