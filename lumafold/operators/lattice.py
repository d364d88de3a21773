"""Sampling lattices and the masks over them, as closed-form predicates and ranked selections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumafold.functions.columns import uniform


def lattice(spark: SparkSession, ny: int, nz: int, frames: int = 1) -> DataFrame:
    """All cells: frame, iy, iz. One range split by arithmetic, so it is as parallel as spark.range."""
    i = F.col("id")
    return spark.range(frames * ny * nz).select((i / (ny * nz)).cast("int").alias("frame"), (F.floor(i / nz) % ny).cast("int").alias("iy"), (i % nz).cast("int").alias("iz"))


def balanced_factors(ny: int, nz: int, accel: int) -> tuple[int, int]:
    """accel = ry * rz, as equal as can be; the larger factor goes to the longer side, to y on a tie."""
    if accel < 1:
        raise ValueError("the acceleration must be 1 or more")
    small = max(d for d in range(1, math.isqrt(accel) + 1) if accel % d == 0)
    return (accel // small, small) if ny >= nz else (small, accel // small)


def caipi(ny: int, nz: int, accel: int, iy: Column, iz: Column, offset: int = 0) -> Column:
    """Whether a cell lies on the sheared lattice."""
    ry, rz = balanced_factors(ny, nz, accel)
    column = F.floor(iz / rz)
    roll = F.pmod(F.pmod(column, F.lit(ry)) + offset, F.lit(ry))
    return (F.pmod(iz, F.lit(rz)) == 0) & (F.pmod(F.pmod(iy - roll, F.lit(ny)), F.lit(ry)) == 0)


def temporal_caipi(ny: int, nz: int, accel: int, iy: Column, iz: Column, frame: Column) -> Column:
    """The sheared lattice, moved frame by frame so that ``accel`` frames cover every cell once."""
    _, rz = balanced_factors(ny, nz, accel)
    cycle = F.pmod(frame, F.lit(accel))
    return caipi(ny, nz, accel, F.pmod(iy - F.floor(cycle / rz), F.lit(ny)), F.pmod(iz - cycle % rz, F.lit(nz)))


def gaussian_density(cells: DataFrame, ny: int, nz: int, sigma: float | tuple[float, float]) -> DataFrame:
    """Adds w, a Gaussian around the middle cell. Its maximum over the whole lattice is 1 (the middle is a cell), so no pass for the maximum is needed."""
    sy, sz = sigma if isinstance(sigma, tuple) else (sigma, sigma)
    y, z = F.col("iy") - ((ny + 1) // 2 - 1), F.col("iz") - ((nz + 1) // 2 - 1)
    return cells.withColumn("w", F.exp(-(y * y / (2.0 * sy * sy) + z * z / (2.0 * sz * sz))))


def elliptic_radius(ny: int, nz: int, iy: Column, iz: Column) -> Column:
    """Distance from the middle as a share of the half sides."""
    y, z = (iy - ny / 2.0) / (ny / 2.0), (iz - nz / 2.0) / (nz / 2.0)
    return F.sqrt(y * y + z * z)


def calibration_radius(ny: int, nz: int, target: int, fraction: float) -> float:
    """Radius of the central disc that takes ``fraction`` of the target samples."""
    return min(math.sqrt(4 * fraction * target / (math.pi * ny * nz)), 0.999) if fraction > 0 else 0.0


def weighted_top(cells: DataFrame, count: int | Column, weight: Column, seed: int, eps: float = 1e-12) -> DataFrame:
    """Weighted sampling without replacement in each frame: the ``count`` largest keys ln(u) / (w + eps)."""
    key = F.log(uniform(seed, F.col("frame"), F.col("iy"), F.col("iz")) + F.lit(1e-12)) / (weight + eps)
    ranked = cells.withColumn("key", key).withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("key"), "iy", "iz")))
    return ranked.where(F.col("rank") <= count)


def exact_count(cells: DataFrame, count: int, seed: int) -> DataFrame:
    """Prune or fill each frame of ``cells`` (frame, iy, iz, sampled, calib) to exactly ``count`` samples.

    Calibration cells are never pruned; filling takes any free cell. Both go by a random rank.
    """
    u = uniform(seed, F.col("frame"), F.col("iy"), F.col("iz"))
    classes = cells.withColumn("class", F.when(F.col("sampled") & F.col("calib"), 0).when(F.col("sampled"), 1).otherwise(2)).withColumn("u", u)
    order = Window.partitionBy("frame").orderBy("class", "u", "iy", "iz")
    return classes.withColumn("rank", F.row_number().over(order)).withColumn("sampled", (F.col("rank") <= count) | (F.col("class") == 0)).drop("class", "u", "rank")


def coverage(mask: DataFrame) -> DataFrame:
    """Cells that any frame samples: iy, iz, frames."""
    return mask.where("sampled").groupBy("iy", "iz").agg(F.countDistinct("frame").alias("frames"))


METHODS = ("caipi", "ticaipi", "rand", "rand_gaussian", "pd")


def sampling_masks(spark: SparkSession, method: str, ny: int, nz: int, frames: int, accel: int, seed: int = 0, seed_per_frame: bool = False, sigma: tuple[float, float] | None = None, **disc) -> DataFrame:
    """frame, iy, iz, sampled for every cell, by a named method.

    Without ``seed_per_frame`` the random methods draw one mask for all frames.
    """
    cells = lattice(spark, ny, nz, frames)
    iy, iz, frame = F.col("iy"), F.col("iz"), F.col("frame")
    if method == "caipi":
        return cells.withColumn("sampled", caipi(ny, nz, accel, iy, iz))
    if method == "ticaipi":
        return cells.withColumn("sampled", temporal_caipi(ny, nz, accel, iy, iz, frame))
    if method in ("rand", "rand_gaussian"):
        sy, sz = sigma or (ny / 6, nz / 6)
        base = cells if seed_per_frame else cells.where("frame = 0")
        dense = gaussian_density(base, ny, nz, (sy, sz)) if method == "rand_gaussian" else base.withColumn("w", F.lit(1.0))
        chosen = weighted_top(dense, round(ny * nz / accel), F.col("w"), seed).select("frame", "iy", "iz", F.lit(True).alias("hit"))
        on = ["frame", "iy", "iz"] if seed_per_frame else ["iy", "iz"]
        return cells.join(chosen.select(*on, "hit"), on, "left").select("frame", "iy", "iz", F.coalesce("hit", F.lit(False)).alias("sampled"))
    if method == "pd":
        from lumafold.operators.disc import disc_masks

        return disc_masks(spark, ny, nz, frames, accel, seed, seed_per_frame, **disc)
    raise ValueError(f"unknown sampling method {method!r}; known: {', '.join(METHODS)}")
