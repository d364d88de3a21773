"""Acquisition programs as event tables: schedule or lattice times a template of blocks, numbered in closed form.

A block row: n, shot keys, kind, trid (on rows that open a segment), duration, areas along y and z in cycles, phase in degrees, adc flag.
Nothing here depends on row order; ``n`` is computed from the keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumafold.operators import schedule as S
from lumafold.operators.feasibility import least_trapezoid, phase_encode


@dataclass(frozen=True)
class Readout:
    """Durations of an echo train's parts, from physical limits."""

    ramp: float
    flat: float
    blip: float
    echo: float
    samples: int

    @classmethod
    def design(cls, nx: int, fov: float, dwell: float, gamma: float, max_grad: float, max_slew: float, raster: float, max_dy: float, max_dz: float, dky: float, dkz: float) -> Readout:
        """A trapezoid whose flat part covers nx / fov, with the blips of the largest steps hidden in its ramps; samples are a multiple of 4."""
        blips = [least_trapezoid(step * dk, max_grad * gamma, max_slew * gamma, raster) for step, dk in ((max_dy, dky), (max_dz, dkz))]
        blip = max(b["rise"] + b["flat"] + b["fall"] for b in blips)
        amplitude = min(max_grad * gamma, 1 / (fov * dwell))
        up = lambda t: -(-round(t / raster, 9) // 1) * raster
        ramp, flat = up(max(amplitude / (max_slew * gamma), blip / 2)), up(nx / fov / amplitude)
        samples = int((flat + 2 * ramp - blip) / dwell) // 4 * 4
        return cls(ramp, flat, blip, 2 * ramp + flat, samples)


def _template(rows: list[tuple]) -> Column:
    """An array literal of blocks: (kind, trid, duration, adc)."""
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).cast("int").alias("trid"), F.lit(float(d)).alias("duration"), F.lit(a).alias("adc")) for k, t, d, a in rows])


HEAD = ("fatsat", "spoil", "rf", "rephase", "te_delay", "prephase", "lead_in")
TAIL = ("spoil_end", "tr_delay")


def echo_train(schedule: DataFrame, shots: int, etl: int, readout: Readout, head: dict[str, float], tail: dict[str, float], scale: float = 1.0, trid: int = 1, adc: bool = True) -> DataFrame:
    """The main program: each shot's head, an echo for each sample with the blip to the next, and its tail.

    ``scale`` 0 gives the calibration program (no blips). Blocks of zero duration among head and tail are left out.
    Adds sy, sz: the blip's steps; polarity; phase of the shot's RF pulse.
    """
    before = [(k, head[k]) for k in HEAD if head.get(k, 0) > 0]
    after = [(k, tail[k]) for k in TAIL if tail.get(k, 0) > 0]
    size = len(before) + etl + len(after)
    stepped = S.blips(schedule)
    count = S.rf_count(F.col("frame"), F.col("shot"), shots)
    start = (F.col("frame") * shots + F.col("shot")) * size
    echoes = stepped.select(
        "frame", "shot", (start + len(before) + F.col("echo") + 1).alias("n"), F.lit("echo").alias("kind"), F.lit(None).cast("int").alias("trid"), F.lit(readout.echo).alias("duration"), F.lit(adc).alias("adc"),
        "echo", "polarity", (F.coalesce("dy", F.lit(0)) * scale).alias("sy"), (F.coalesce("dz", F.lit(0)) * scale).alias("sz"), S.rf_phase(count).alias("phase"),
    )
    frame = [(k, trid if i == 0 else None, d, False) for i, (k, d) in enumerate(before)] + [(k, None, d, False) for k, d in after]
    first = schedule.where("echo = 0").select("frame", "shot", "iy", "iz")
    rest = first.select("frame", "shot", "iy", "iz", F.posexplode(_template(frame)).alias("p", "b"))
    place = F.when(F.col("p") < len(before), F.col("p")).otherwise(F.col("p") + etl) + 1
    moves = F.col("b.kind") == "prephase"
    framed = rest.select(
        "frame", "shot", (start + place).alias("n"), "b.kind", "b.trid", "b.duration", "b.adc", F.lit(None).cast(schedule.schema["echo"].dataType).alias("echo"), F.lit(0).alias("polarity"),
        F.when(moves, F.col("iy")).otherwise(0).cast("double").alias("sy"), F.when(moves, F.col("iz")).otherwise(0).cast("double").alias("sz"), S.rf_phase(count).alias("phase"),
    )
    return framed.unionByName(echoes)


def integrated_places(program: DataFrame) -> DataFrame:
    """frame, shot, echo, iy, iz: where the program's prephaser and blips put each echo (running sums inside a shot)."""
    w = Window.partitionBy("frame", "shot").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    moved = program.withColumn("iy", F.coalesce(F.sum("sy").over(w), F.lit(0.0))).withColumn("iz", F.coalesce(F.sum("sz").over(w), F.lit(0.0)))
    return moved.where("kind = 'echo'").select("frame", "shot", "echo", F.round("iy").cast("int").alias("iy"), F.round("iz").cast("int").alias("iz"))


def calibration_schedule(spark: SparkSession, etl: int, shots: int, dummies: int) -> DataFrame:
    """Shots at the centre line; the first ``dummies`` without acquisition (negative numbers)."""
    i = F.col("id")
    return spark.range((shots + dummies) * etl).select(F.lit(0).alias("frame"), (F.floor(i / etl) - dummies).cast("int").alias("shot"), (i % etl).cast("int").alias("echo"), F.lit(0).alias("iy"), F.lit(0).alias("iz"))


GRE_TEMPLATE = ("rf", "prephase", "te_delay", "readout", "rewind", "spoil", "tr_delay")


def dual_echo_program(spark: SparkSession, ny: int, nz: int, te: tuple[float, ...], durations: dict[str, float], dummies: int = 4) -> DataFrame:
    """Gradient echoes over iz (dummies negative, then 0 for gain calibration, then 1..nz), iy and echo, seven blocks each."""
    least = durations["rf"] / 2 + durations["prephase"] + durations["readout"] / 2
    if min(te) < least:
        raise ValueError("an echo time is too short")
    echoes, planes = len(te), nz + dummies + 1
    i = F.col("id")
    size = len(GRE_TEMPLATE)
    keys = spark.range(planes * ny * echoes * size).select(
        (i + 1).alias("n"), (F.floor(i / (size * echoes * ny)) - dummies).cast("int").alias("iz"), (F.floor(i / (size * echoes)) % ny).cast("int").alias("iy"), (F.floor(i / size) % echoes).cast("int").alias("echo"), (i % size).cast("int").alias("j")
    )
    kind = F.element_at(F.array(*[F.lit(k) for k in GRE_TEMPLATE]), F.col("j") + 1)
    spare = F.element_at(F.array(*[F.lit(t - least) for t in te]), F.col("echo") + 1)
    fixed = F.element_at(F.create_map(*[F.lit(x) for k in GRE_TEMPLATE for x in (k, float(durations.get(k, 0.0)))]), kind)
    moves = F.when(kind == "prephase", 1.0).when(kind == "rewind", -1.0).otherwise(0.0)
    real = F.col("iz") > 0
    return keys.select(
        "n", "iz", "iy", "echo", kind.alias("kind"), F.when(kind == "te_delay", spare).otherwise(fixed).alias("duration"), (moves * phase_encode(F.col("iy"), ny)).alias("sy"),
        F.when(real, moves * phase_encode(F.col("iz") - 1, nz)).otherwise(0.0).alias("sz"), ((kind == "readout") & (F.col("iz") >= 0)).alias("adc"), S.rf_phase(F.floor((F.col("n") - 1) / size) + 1).alias("phase"),
        F.when(F.col("j") == 0, F.when(F.col("iz") < 0, 1).when(F.col("iz") == 0, 2).otherwise(3)).cast("int").alias("trid"),
    )


def noise_program(spark: SparkSession, coils: int, samples: int, duration: float, delay: float) -> DataFrame:
    """ceil(20 coils^2 / samples) acquisitions, each with its delay if there is one, and a closing RF block."""
    reps = -(-20 * coils * coils // samples)
    size = 2 if delay > 1e-9 else 1
    i = F.col("id")
    body = spark.range(reps * size).select((i + 1).alias("n"), F.when(i % size == 0, "adc").otherwise("delay").alias("kind"), F.when(i % size == 0, F.lit(duration)).otherwise(F.lit(delay)).alias("duration"), F.when(i == 0, 1).cast("int").alias("trid"))
    end = spark.range(1).select(F.lit(reps * size + 1).cast("long").alias("n"), F.lit("rf").alias("kind"), F.lit(duration).alias("duration"), F.lit(2).alias("trid"))
    return body.unionByName(end)


def one_repetition(program: DataFrame, shot: int) -> DataFrame:
    """The blocks of one shot with their start times."""
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # one shot's blocks
    return program.where(F.col("shot") == shot).withColumn("start", F.coalesce(F.sum("duration").over(w), F.lit(0.0)))


def compare_tables(ours: DataFrame, theirs: DataFrame, key: list[str], tolerance: float = 1e-4) -> DataFrame:
    """key, field, ours, theirs: fields that differ by more than the tolerance, and rows that one side lacks."""
    names = [c for c in ours.columns if c not in key]
    long = lambda d, as_: d.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias(as_)) for c in names])).alias("x")).select(*key, "x.field", f"x.{as_}")
    met = long(ours, "ours").withColumn("__l", F.lit(1)).join(long(theirs, "theirs").withColumn("__r", F.lit(1)), [*key, "field"], "full_outer")
    return met.where(F.col("__l").isNull() | F.col("__r").isNull() | (F.abs(F.coalesce("ours", F.lit(0.0)) - F.coalesce("theirs", F.lit(0.0))) > tolerance)).drop("__l", "__r")
