"""Variable-density Poisson-disc masks: one frame to a task, with an exact number of samples."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def disc_points(ry: np.ndarray, rz: np.ndarray, calib: np.ndarray, attempts: int, rng: np.random.Generator) -> np.ndarray:
    """A mask on the grid of ``ry`` (radii along y and z of each cell): no sample inside another one's ellipse.

    Samples grow from active ones: candidates at one to two radii; a candidate is refused if any sample has it inside that
    sample's own ellipse. Each sample paints its ellipse into a grid of refused cells when it is taken, so a candidate
    is one lookup, and all candidates of a step are looked up at once. Calibration cells are all taken.
    """
    ny, nz = ry.shape
    pad_y, pad_z = math.ceil(2 * ry.max()) + 2, math.ceil(2 * rz.max()) + 2  # no candidate or ellipse reaches beyond
    refused = np.ones((ny + 2 * pad_y, nz + 2 * pad_z), bool)
    refused[pad_y : pad_y + ny, pad_z : pad_z + nz] = False
    width, flat = refused.shape[1], refused.ravel()
    ys, zs = np.arange(-pad_y, pad_y + 1.0), np.arange(-pad_z, pad_z + 1.0)
    taken = np.zeros((ny, nz), bool)

    def take(y: int, z: int) -> tuple[int, int, float, float]:
        a, b = float(ry[y, z]), float(rz[y, z])
        m, n = math.ceil(a), math.ceil(b)
        dy, dz = ys[pad_y - m : pad_y + m + 1] / a, zs[pad_z - n : pad_z + n + 1] / b
        refused[y + pad_y - m : y + pad_y + m + 1, z + pad_z - n : z + pad_z + n + 1] |= (dy * dy)[:, None] + dz * dz < 1
        taken[y, z] = True
        return y, z, a, b

    active = [take(int(rng.integers(ny)), int(rng.integers(nz)))]
    drawn = 0
    while active:
        if drawn == 0:
            drawn = 256
            grow, turn = np.sqrt(3 * rng.random((drawn, attempts)) + 1), 2 * math.pi * rng.random((drawn, attempts))
            along_y, along_z, picks = grow * np.sin(turn), grow * np.cos(turn), rng.random(drawn)
        drawn -= 1
        k = int(picks[drawn] * len(active))
        y, z, a, b = active[k]
        # Padded places are positive, so cutting off the fraction rounds them.
        at = (along_y[drawn] * a + (y + pad_y + 0.5)).astype(np.intp) * width + (along_z[drawn] * b + (z + pad_z + 0.5)).astype(np.intp)
        first = int(at[flat[at].argmin()])
        if flat[first]:
            active[k] = active[-1]
            active.pop()
        else:
            active.append(take(first // width - pad_y, first % width - pad_z))
    return taken | calib


def disc_mask(ny: int, nz: int, accel: float, seed: int, calib_frac: float = 0.0, crop: bool = True, attempts: int = 30, tol: float = 0.1, decay: float = 1.0, searches: int = 50) -> np.ndarray:
    """Exactly floor(ny * nz / accel) samples: the density's slope by bisection, then a random prune or fill."""
    if accel <= 1:
        raise ValueError("the acceleration must be above 1")
    target = int(ny * nz / accel)
    y, z = np.mgrid[:ny, :nz]
    rho = np.hypot((y - ny / 2) / (ny / 2), (z - nz / 2) / (nz / 2))
    core = min(math.sqrt(4 * calib_frac * target / (math.pi * ny * nz)), 0.999) if calib_frac > 0 else 0.0
    calib = rho <= core if core else np.zeros((ny, nz), bool)
    if calib.sum() > target:
        raise ValueError("the calibration region holds more than the target")
    ramp = np.maximum(rho - core, 0) / max(1 - core, 1e-6)
    low, high = 0.0, float(max(ny, nz))
    mask = calib
    for _ in range(searches):
        slope = (low + high) / 2
        r = 1 + ramp ** (1 / decay) * slope
        ry, rz = np.maximum(r * ny / max(ny, nz), 1), np.maximum(r * nz / max(ny, nz), 1)
        mask = disc_points(ry, rz, calib, attempts, np.random.default_rng(seed))
        if crop:
            mask &= (rho <= 1) | calib
        reached = ny * nz / max(int(mask.sum()), 1)
        if abs(reached - 0.95 * accel) <= tol:
            break
        if reached < 0.95 * accel:
            low = slope
        else:
            high = slope
    rng = np.random.default_rng([seed, 1])
    spare = int(mask.sum()) - target
    pool = np.flatnonzero(mask & ~calib) if spare > 0 else np.flatnonzero(~mask)
    picked = rng.choice(pool, abs(spare), replace=False)
    mask.ravel()[picked] = spare < 0
    return mask


def disc_masks(spark: SparkSession, ny: int, nz: int, frames: int, accel: float, seed: int = 0, seed_per_frame: bool = False, **how) -> DataFrame:
    """frame, iy, iz, sampled: a mask for each frame, frames in parallel (all alike unless ``seed_per_frame``)."""
    if accel <= 1:
        raise ValueError("the acceleration must be above 1")
    distinct = frames if seed_per_frame else 1

    def draw(batches):
        for batch in batches:
            for frame in batch.column(0).to_pylist():
                mask = disc_mask(ny, nz, accel, seed + frame, **how)
                at = np.indices(mask.shape, np.int32).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(mask.size, frame, np.int32)), pa.array(at[0]), pa.array(at[1]), pa.array(mask.ravel())], ["frame", "iy", "iz", "sampled"])

    drawn = spark.range(distinct).repartition(distinct).mapInArrow(draw, "frame int, iy int, iz int, sampled boolean")
    if seed_per_frame:
        return drawn
    return drawn.select(F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"), "iy", "iz", "sampled")
