"""Loop files of converted logs: rows are encoded in tasks, in parts of known places, and joined behind a head of definitions.

A row of the loop has a fixed width, so each part of ROWS rows has its place in the file before any is encoded. A task encodes one part and writes nothing but
its row of the table of parts, which is written to the shared folder; the commit appends head, parts in order and foot to a file of another
name and then renames it, holding one part at a time. So no task, nor the driver, holds the loop, a lost executor costs its parts only, and a
torn write is never read.

What the head holds is bounded by the format (16-bit counts of parents and segments).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumafold.operators import events as E
from lumafold.operators.convert import Loop
from lumafold.session import kept
from lumafold.sources import loopfile
from lumafold.sources.loopfile import Gradient, LoopFile, Parent, Pulse, SegmentDef

#: The loop's columns, in the order of the file.
COLUMNS = (
    "segment_id", "parent_id", "rf_amp", "rf_phase", "frequency", "amp_gx", "energy_gx", "amp_gy", "energy_gy", "amp_gz", "energy_gz",
    "adc_phase", "duration", "trigger", "r00", "r01", "r02", "r10", "r11", "r12", "r20", "r21", "r22",
)
#: Rows of one part: 24 MB.
ROWS = 1 << 18
#: Rows up to which the heating check looks for the last whole segment.
HEAT_CAP = 40_000
#: What a definition holds at most.
MOST = (1 << 15) - 1


def _gradient(found, points: dict[int, list]) -> Gradient | None:
    if found is None:
        return None
    if (shape := found.asDict().get("shape")) is None:
        return Gradient(found["delay"], found["rise"], found["flat"], found["fall"])
    t, v = np.array([(p["t"], p["v"]) for p in points[shape]], float).T
    return Gradient(found["delay"], times=t, waveform=v)


def unit_slew(g: Gradient | None) -> float:
    """Steepest slope of a gradient of amplitude 1; 0 without one."""
    if g is None:
        return 0.0
    if g.waveform is None:
        return max(1 / g.rise, 1 / g.fall)
    return float(np.abs(np.diff(g.waveform) / np.diff(g.times)).max() / np.abs(g.waveform).max())


def parents_of(loop: Loop, pulses: dict[str, Pulse], shapes: DataFrame | None = None) -> list[Parent]:
    """The parents with their pulses, gradients and readouts, from the block of each one's first appearance."""
    at = loop.parents.join(loop.segments.select("seg_id", "first_row"), "seg_id").select("parent_id", (F.col("first_row") + F.col("j") - 1).alias("n"))
    rows = loop.blocks.join(at, "n").select("parent_id", "duration", "rf", *E.AXES, "adc").orderBy("parent_id").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a loop file holds {MOST} parents at most")
    used = {s for r in rows for a in E.AXES if r[a] is not None and (s := r[a].asDict().get("shape")) is not None}
    points = {r["shape"]: r["points"] for r in shapes.where(F.col("shape").isin(list(used))).collect()} if used else {}
    out = []
    for r in rows:
        adc = r["adc"] and (r["adc"]["samples"], r["adc"]["dwell"], r["adc"].asDict().get("delay") or 0.0)
        out.append(Parent(r["parent_id"], r["duration"], r["rf"] and pulses[r["rf"]["shape"]], tuple(_gradient(r[a], points) for a in E.AXES), adc))
    return out


def segments_of(loop: Loop) -> list[SegmentDef]:
    rows = loop.positions.groupBy("seg_id").agg(F.sort_array(F.collect_list(F.struct("j", "block_id"))).alias("b")).join(loop.segments, "seg_id").orderBy("seg_id").limit(MOST + 1).collect()
    if len(rows) > MOST or any(len(r["b"]) > MOST for r in rows):
        raise ValueError(f"a loop file holds {MOST} segments, and as many blocks of each, at most")
    return [SegmentDef(r["seg_id"], [b["block_id"] for b in r["b"]], r["strongest_row"]) for r in rows]


def definitions(loop: Loop, pulses: dict[str, Pulse], shapes: DataFrame | None = None, quantum: int = 1, heat_cap: int = HEAT_CAP) -> tuple[LoopFile, int]:
    """All but the loop's rows, and their number. The slew is the steepest one that a row reaches with its own amplitude."""
    parents = parents_of(loop, pulses, shapes)
    figures = loop.header.first()
    units = loop.rows.sparkSession.createDataFrame([(p.number, *map(unit_slew, p.axes)) for p in parents] or [(0, 0.0, 0.0, 0.0)], "parent_id int, u_gx double, u_gy double, u_gz double")
    steep = F.greatest(*[F.col(f"u_{a}") * F.abs(f"amp_{a}") for a in E.AXES])
    slew = loop.rows.where("parent_id >= 1").join(F.broadcast(units), "parent_id").agg(F.max(steep).alias("s")).first()["s"]  # 32,767 rows at most
    n = figures["rows"]
    ends = loop.instances.where(F.col("start") < min(n, heat_cap)).select((F.col("start") + F.col("blocks") - 1).alias("last"))
    heat = E.heat_rows(ends, "last", heat_cap - 1).first()["heat_rows"]
    limits = (1.0, figures["max_b1"] or 0.0, figures["max_grad"] or 0.0, slew or 0.0, figures["duration"] or 0.0)
    return LoopFile(parents, segments_of(loop), np.empty((0, len(COLUMNS))), limits, figures["readouts"], quantum, heat), n


def encoded_parts(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """part, body: the bytes of rows part * size + 1 and on, in order of n."""

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        part, n = key[0].as_py(), table["n"].to_numpy()
        order = np.argsort(n)
        if (n[order] != np.arange(part * size + 1, part * size + 1 + len(n))).any():
            raise ValueError("the loop's rows must be numbered from 1, without gaps")
        body = np.stack([table[c].to_numpy().astype("<f4") for c in COLUMNS], axis=1)[order].tobytes()
        return pa.table({"part": pa.array([part], pa.int64()), "body": pa.array([body], pa.binary())})

    numbered = rows.select(F.floor((F.col("n") - 1) / size).cast("long").alias("part"), F.col("n").cast("long").alias("n"), *COLUMNS)
    return numbered.groupBy("part").applyInArrow(encode, "part long, body binary")


def write_loop(loop: Loop, path: str, pulses: dict[str, Pulse], shapes: DataFrame | None = None, quantum: int = 1, size: int = ROWS) -> int:
    """Write the loop file ``path`` (a URI of any store that pyarrow opens, or a local path); gives its length in bytes.

    ``pulses``: the pulse of each shape name of the log.
    """
    content, n = definitions(loop, pulses, shapes, quantum)
    parts = kept(encoded_parts(loop.rows, size))
    store, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    fresh = f"{name}.{uuid.uuid4().hex[:12]}"
    width, total = 4 * len(COLUMNS), 0
    with store.open_output_stream(fresh) as out:
        total += out.write(loopfile.head(content, n, len(COLUMNS)))
        start = total
        for row in parts.orderBy("part").toLocalIterator():
            if total != start + row["part"] * size * width:
                raise ValueError("a part of the loop is missing")
            total += out.write(bytes(row["body"]))
        if total != start + n * width:
            raise ValueError("rows of the loop are missing")
        total += out.write(loopfile.foot(content))
    store.move(fresh, name)
    return total
