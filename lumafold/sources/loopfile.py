"""The binary loop file: parents, segments and the loop table, little-endian.

Layout (fixed): int16 mark 47; int16 count of parents, then parents; int16 count of segments, then segments; int32 rows, int16
columns, rows x columns float32; five float32 (RF power, largest B1, gradient, slew, duration); three int32 (readouts,
quantisation, heat-check rows).

* A parent: int32 number, float32 duration, pulse, three gradients, ADC, int16 trigger (always 0).
* A pulse: int16 tag (0 none, 1 raster centres, 2 corner points), int16 1 (complex), int32 samples, float32 raster, times (tag 2 only),
  magnitudes over their peak, phases, then float32 shape duration, delay and energy (of the scaled magnitudes).
* A gradient: int16 tag (0 none, 1 trapezoid, 2 raster centres, 3 corner points). Trapezoid: float32 delay, rise, flat, fall. Samples: float32
  delay, int32 count, float32 raster (0 for corner points), times (tag 3 only), signed samples over their peak.
* ADC: int16 tag; int32 samples, float32 dwell, float32 delay.
* A segment: int16 number, int16 count, int16 blocks, int32 row of its strongest instance, int16 whether a parent has a gradient.

Shapes are stored without their scale, which the loop's rows hold.
"""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = 47
FOOT = struct.Struct("<5f3i")


@dataclass
class Gradient:
    """A trapezoid (rise, flat, fall) or samples (waveform at times)."""

    delay: float = 0.0
    rise: float = 0.0
    flat: float = 0.0
    fall: float = 0.0
    times: np.ndarray | None = None
    waveform: np.ndarray | None = None

    @property
    def at_centers(self) -> bool:
        """Samples at raster centres start after time zero, corner points at it."""
        return self.times is not None and float(self.times[0]) > 0


@dataclass
class Pulse:
    times: np.ndarray
    magnitude: np.ndarray
    phase: np.ndarray
    duration: float
    delay: float

    @property
    def energy(self) -> float:
        return float((scaled(self.magnitude)[:-1] ** 2 * np.diff(self.times)).sum())


def scaled(shape: np.ndarray) -> np.ndarray:
    """A shape over its peak; zeros stay."""
    peak = float(np.abs(shape).max(initial=0.0))
    return np.asarray(shape, float) / peak if peak else np.asarray(shape, float)


@dataclass
class Parent:
    number: int
    duration: float
    pulse: Pulse | None = None
    axes: tuple[Gradient | None, Gradient | None, Gradient | None] = (None, None, None)
    adc: tuple[int, float, float] | None = None  # samples, dwell, delay


@dataclass
class SegmentDef:
    number: int
    blocks: list[int]
    strongest_row: int


@dataclass
class LoopFile:
    parents: list[Parent]
    segments: list[SegmentDef]
    loop: np.ndarray  # rows x columns
    limits: tuple[float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, 0.0)
    readouts: int = 0
    quantum: int = 1
    heat_rows: int = 0
    _: dict = field(default_factory=dict, repr=False)


def regular_raster(times: np.ndarray) -> bool:
    """Whether second differences are rounding only."""
    return len(times) < 3 or bool(np.abs(np.diff(times, 2)).max() < 10 * np.finfo(float).eps)


def encode(content: LoopFile) -> bytes:
    return head(content, *content.loop.shape) + np.asarray(content.loop, "<f4").tobytes() + foot(content)


def foot(content: LoopFile) -> bytes:
    """What follows the loop's rows."""
    return FOOT.pack(*content.limits, content.readouts, content.quantum, content.heat_rows)


def head(content: LoopFile, rows: int, columns: int) -> bytes:
    """What comes before the loop's rows."""
    out = io.BytesIO()
    put = lambda fmt, *v: out.write(struct.pack("<" + fmt, *v))
    floats = lambda x: out.write(np.asarray(x, "<f4").tobytes())

    def gradient(g: Gradient | None) -> None:
        if g is None:
            put("h", 0)
        elif g.waveform is None:
            put("h4f", 1, g.delay, g.rise, g.flat, g.fall)
        elif g.at_centers:
            put("hfif", 2, g.delay, len(g.waveform), g.times[1] - g.times[0])
            floats(scaled(g.waveform))
        else:
            put("hfif", 3, g.delay, len(g.waveform), 0.0)
            floats(g.times)
            floats(scaled(g.waveform))

    put("hh", MARK, len(content.parents))
    for p in content.parents:
        put("if", p.number, p.duration)
        if p.pulse is None:
            put("h", 0)
        else:
            n = len(p.pulse.magnitude)
            regular = n > 3 and regular_raster(p.pulse.times)
            put("hhif", 1 if regular else 2, 1, n, p.pulse.times[1] - p.pulse.times[0])
            if not regular:
                floats(p.pulse.times)
            floats(scaled(np.abs(p.pulse.magnitude)))
            floats(p.pulse.phase)
            put("3f", p.pulse.duration, p.pulse.delay, p.pulse.energy)
        for g in p.axes:
            gradient(g)
        put("h", int(p.adc is not None))
        if p.adc is not None:
            put("iff", *p.adc)
        put("h", 0)  # no trigger
    put("h", len(content.segments))
    moved = {p.number for p in content.parents if any(g is not None for g in p.axes)}
    for s in content.segments:
        put("hh", s.number, len(s.blocks))
        put(f"{len(s.blocks)}h", *s.blocks)
        put("ih", s.strongest_row, int(not moved.isdisjoint(s.blocks)))
    put("ih", rows, columns)
    return out.getvalue()


def decode(raw: bytes) -> LoopFile:
    """The content of a loop file; a wrong mark, a short file or bytes left over are errors."""
    at = 0

    def take(fmt: str) -> tuple:
        nonlocal at
        size = struct.calcsize("<" + fmt)
        if at + size > len(raw):
            raise ValueError("the loop file ends early")
        at += size
        return struct.unpack_from("<" + fmt, raw, at - size)

    def floats(n: int) -> np.ndarray:
        return np.array(take(f"{n}f"), float)

    def gradient() -> Gradient | None:
        (tag,) = take("h")
        if tag == 0:
            return None
        if tag == 1:
            return Gradient(*take("4f"))
        if tag == 2:
            delay, n, step = take("fif")
            return Gradient(delay, times=(np.arange(n) + 0.5) * step, waveform=floats(n))
        if tag == 3:
            delay, n, _ = take("fif")
            return Gradient(delay, times=floats(n), waveform=floats(n))
        raise ValueError(f"unknown gradient tag {tag}")

    mark, count = take("hh")
    if mark != MARK:
        raise ValueError("not a loop file")
    parents = []
    for _ in range(count):
        number, duration = take("if")
        pulse = None
        (tag,) = take("h")
        if tag:
            _, n, step = take("hif")
            times = floats(n) if tag == 2 else (np.arange(n) + 0.5) * step
            magnitude, phase = floats(n), floats(n)
            length, delay, _ = take("3f")
            pulse = Pulse(times, magnitude, phase, length, delay)
        axes = (gradient(), gradient(), gradient())
        adc = take("iff") if take("h")[0] else None
        take("h")
        parents.append(Parent(number, duration, pulse, axes, adc))
    segments = []
    for _ in range(take("h")[0]):
        number, n = take("hh")
        blocks = list(take(f"{n}h"))
        row, _ = take("ih")
        segments.append(SegmentDef(number, blocks, row))
    rows, columns = take("ih")
    loop = np.frombuffer(raw, "<f4", rows * columns, at).reshape(rows, columns).astype(float)
    at += 4 * rows * columns
    *limits, readouts, quantum, heat = take("5f3i")
    if at != len(raw):
        raise ValueError("bytes are left over after the loop file's end")
    return LoopFile(parents, segments, loop, tuple(limits), readouts, quantum, heat)


def read_loops(spark: SparkSession, path: str, suffix: str = "pge") -> DataFrame:
    """path, row, column, value of the loop tables of all files under ``path`` (any store that Spark reads)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "content")

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                loop = decode(content).loop
                at = np.indices(loop.shape, np.int32).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * loop.size), pa.array(at[0]), pa.array(at[1]), pa.array(loop.ravel())], ["path", "row", "column", "value"])

    return files.mapInArrow(rows, "path string, row int, column int, value double")


def read_definitions(spark: SparkSession, path: str, suffix: str = "pge") -> DataFrame:
    """path, kind (parent, segment or header), number, place and value of all files under ``path``: durations of parents, blocks of segments, and the header's figures."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "content")

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = decode(content)
                out = [("parent", p.number, 0, float(p.duration)) for p in found.parents]
                out += [("segment", s.number, k, float(b)) for s in found.segments for k, b in enumerate(s.blocks)]
                out += [("header", 0, k, float(v)) for k, v in enumerate((*found.limits, found.readouts, found.quantum, found.heat_rows))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True))], ["path", "kind", "number", "place", "value"])

    return files.mapInArrow(rows, "path string, kind string, number int, place int, value double")


def loop_limits(loop: DataFrame, rf: str = "rf_amp", axes: tuple[str, ...] = ("amp_gx", "amp_gy", "amp_gz")) -> DataFrame:
    """One row: largest RF amplitude and gradient amplitude of a loop table."""
    return loop.agg(F.max(F.abs(rf)).alias("max_b1"), F.max(F.greatest(*[F.abs(a) for a in axes])).alias("max_grad"))
