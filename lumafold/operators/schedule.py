"""From masks to shots: native partitioning, ordering keys and step statistics."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_step(dy: Column, dz: Column, ky: float = 1.0, kz: float = 1.0) -> Column:
    """Weighted Chebyshev length of a step."""
    return F.greatest(F.abs(dy) * ky, F.abs(dz) * kz)


def center_out_index(n: int, place: Column) -> Column:
    """The row visited at ``place`` of a centre-out walk over 0..n-1."""
    half = F.floor(place / 2)
    return F.when(place % 2 == 0, F.pmod(F.lit(n - 1) - half + n // 2, F.lit(n))).otherwise(F.pmod(F.floor((place - 1) / 2) + n // 2, F.lit(n)))


def center_out_rank(n: int, row: Column) -> Column:
    """When a centre-out walk over 0..n-1 visits ``row``: the inverse of center_out_index."""
    up = F.pmod(row - n // 2, F.lit(n))
    down = F.pmod(F.lit(n - 1 + n // 2) - row, F.lit(n))
    return F.least(2 * up + 1, 2 * down)


def sequential_parts(mask: DataFrame, ny: int, etl: int) -> DataFrame:
    """Adds part (from 1): columns in turn, rows centre-out, exactly ``etl`` samples a part."""
    order = Window.partitionBy("frame").orderBy("iz", center_out_rank(ny, F.col("iy")))
    return mask.withColumn("part", (F.floor((F.row_number().over(order) - 1) / etl) + 1).cast("int"))


def folded_angle(ny: int, nz: int, iy: Column, iz: Column) -> Column:
    """Angle about the centre, modulo pi."""
    return F.pmod(F.atan2(iz - nz / 2.0, iy - ny / 2.0), F.pi())


def wedge_parts(mask: DataFrame, ny: int, nz: int, etl: int) -> DataFrame:
    """Adds theta and wedge (from 0): samples sorted by folded angle, ``etl`` a wedge."""
    theta = F.round(folded_angle(ny, nz, F.col("iy"), F.col("iz")), 12)
    order = Window.partitionBy("frame").orderBy("theta", "iy", "iz")
    return mask.withColumn("theta", theta).withColumn("wedge", F.floor((F.row_number().over(order) - 1) / etl).cast("int"))


def wedge_axes(wedges: DataFrame) -> DataFrame:
    """frame, wedge, n, center (mean folded angle) and axis (doubled-angle circular mean)."""
    return wedges.groupBy("frame", "wedge").agg(
        F.count("*").alias("n"), F.avg("theta").alias("center"), (F.lit(0.5) * F.atan2(F.avg(F.sin(2 * F.col("theta"))), F.avg(F.cos(2 * F.col("theta"))))).alias("axis")
    )


def pivot_split(wedges: DataFrame, axes: DataFrame, ny: int, nz: int, etl: int, places: int = 9) -> DataFrame:
    """Adds slot (from 0): samples along the wedge's axis, with the one nearest to the centre at the echo of TE.

    The pivot sits at (etl - 1) // 2; the first so many others in projection order come before it, the rest after.
    """
    y, z = F.col("iy") - ny / 2.0, F.col("iz") - nz / 2.0
    proj = F.round(y * F.cos("axis") + z * F.sin("axis"), places)
    at = Window.partitionBy("frame", "wedge")
    target = (etl - 1) // 2
    seen = wedges.join(axes.select("frame", "wedge", "axis"), ["frame", "wedge"]).withColumn("proj", proj).withColumn("dist2", y * y + z * z)
    near = seen.withColumn("near", F.row_number().over(at.orderBy("dist2", "proj", "iy", "iz")))
    order = F.row_number().over(at.orderBy((F.col("near") == 1).cast("int"), "proj", "iy", "iz")) - 1
    return near.withColumn("place", order).withColumn("slot", F.when(F.col("near") == 1, F.lit(target)).when(F.col("place") < target, F.col("place")).otherwise(F.col("place") + 1).cast("int")).drop("near", "place")


def count_check(mask: DataFrame, etl: int, shots: int) -> DataFrame:
    """frame, samples and ok: whether each frame holds exactly shots * etl samples."""
    return mask.groupBy("frame").agg(F.sum(F.col("sampled").cast("long")).alias("samples")).withColumn("ok", F.col("samples") == shots * etl)


def blips(schedule: DataFrame) -> DataFrame:
    """Adds dy, dz (step to the next echo, null at the last), polarity of the readout, and the shot's running number."""
    order = Window.partitionBy("frame", "shot").orderBy("echo")
    return schedule.withColumn("dy", F.lead("iy").over(order) - F.col("iy")).withColumn("dz", F.lead("iz").over(order) - F.col("iz")).withColumn("polarity", F.when(F.col("echo") % 2 == 0, 1).otherwise(-1))


def max_steps(schedule: DataFrame) -> DataFrame:
    """One row: the largest step along y and along z; zero for one-echo shots."""
    stepped = blips(schedule)
    return stepped.agg(F.coalesce(F.max(F.abs("dy")), F.lit(0)).alias("max_dy"), F.coalesce(F.max(F.abs("dz")), F.lit(0)).alias("max_dz"))


def rf_phase(count: Column, increment: float = 117.0) -> Column:
    """Quadratic spoiling phase in degrees, of the ``count``-th pulse.

    An increment of up to six decimals is a fraction p / q, and the turns are taken off in whole numbers modulo 720 q, whose square fits 64 bits, so
    the phase is exact at any count: as doubles, half degrees are lost from count 8,774,089 on. Other increments stay doubles.
    """
    step = Fraction(str(increment))
    if step.denominator > 1_000_000:
        return F.pmod(F.lit(0.5) * increment * count * count, F.lit(360.0))
    turn = 720 * step.denominator
    modulo = lambda x: F.pmod(x, F.lit(turn).cast("long"))
    place = modulo(count.cast("long"))
    return modulo(modulo(place * place) * F.lit(step.numerator % turn).cast("long")) / F.lit(2.0 * step.denominator)


def rf_count(frame: Column, shot: Column, shots: int) -> Column:
    """The running pulse number, in closed form instead of a global window."""
    return frame * shots + shot + 1


def rebuilt_mask(cells: DataFrame, schedule: DataFrame) -> DataFrame:
    """cells with sampled: whether the schedule visits them."""
    visited = schedule.select("frame", "iy", "iz").distinct().withColumn("hit", F.lit(True))
    return cells.join(visited, ["frame", "iy", "iz"], "left").withColumn("sampled", F.coalesce("hit", F.lit(False))).drop("hit")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, counted with repeats; empty if both hold the same."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def crossing(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column], s: tuple[Column, Column]) -> Column:
    """Whether the segments p-q and r-s cross: each one's ends lie on different sides of the other."""

    def side(a, b, c) -> Column:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    return ((side(p, q, r) > 0) != (side(p, q, s) > 0)) & ((side(r, s, p) > 0) != (side(r, s, q) > 0))


def crossings(paths: DataFrame, key: str = "shot", order: str = "echo", x: str = "iy", y: str = "iz") -> DataFrame:
    """key, crossings: pairs of path segments at least two apart that cross, but for the first with the last."""
    w = Window.partitionBy(key).orderBy(order)
    seg = paths.select(key, (F.row_number().over(w) - 1).alias("i"), F.col(x).alias("x1"), F.col(y).alias("y1"), F.lead(x).over(w).alias("x2"), F.lead(y).over(w).alias("y2"), F.count("*").over(Window.partitionBy(key)).alias("m")).where("x2 IS NOT NULL")
    a, b = seg.alias("a"), seg.alias("b")
    far = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.i") >= F.col("a.i") + 2) & ~((F.col("a.i") == 0) & (F.col("b.i") == F.col("a.m") - 2))
    hit = crossing(*((F.col(f"{t}.x{k}"), F.col(f"{t}.y{k}")) for t in "ab" for k in (1, 2)))
    found = a.join(b, far & hit).groupBy(F.col(f"a.{key}").alias(key)).agg(F.count("*").alias("crossings"))
    return paths.select(key).distinct().join(found, key, "left").select(key, F.coalesce("crossings", F.lit(0)).cast("long").alias("crossings"))


def golden_angle(t: int) -> float:
    """Target angle of the t-th shot, modulo pi."""
    return math.fmod(t * math.pi * (math.sqrt(5) - 1) / 2, math.pi)
