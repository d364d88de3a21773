"""Drivers: raw shots to k-space volumes, volumes to images, programs to exported loops, and the data behind figures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumafold.operators import coils as C
from lumafold.operators import feasibility as P
from lumafold.operators import recon as R
from lumafold.operators import signal as G
from lumafold.session import kept
from lumafold.sources import committed, images, loopfile


def calibrated_matrices(noise: DataFrame, reference: DataFrame, energy: float, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Whitening from noise samples, and compression from whitened reference samples (sample, coil, re, im)."""
    white = C.whitening(noise)
    covariance = C.matrix_of(C.gram(C.mixed(reference, white, conjugate=True), conjugate_first=False))
    return white, C.compression(covariance, C.channels_for_energy(covariance, energy, floor))


#: Samples of a calibration train up to which it is sent to every task of a delay sweep (about 10 MB); beyond, it is joined.
TRAIN_SENT = 250_000


def delayed(trajectory: DataFrame, delay: float) -> DataFrame:
    """A trajectory (parity, i, kx) at the middle of each sample, shifted by ``delay`` samples; it goes on straight beyond its ends."""
    return G.shifted_samples(trajectory.select("parity", "i", "kx"), ["parity"], "kx", delay + 0.5).select("parity", "i", F.col("shifted").alias("kx"))


def delayed_weights(trajectory: DataFrame, delays: Iterable[float]) -> DataFrame:
    """delay, parity, i, kx, w: every candidate's trajectory with the density weights of its samples, which sum to one.

    A trajectory is one short array, so candidates are a column: no join, and a plan whose size doesn't depend on their number.
    """
    sorted_kx = F.transform(F.sort_array(F.collect_list(F.struct("i", "kx"))), lambda r: r["kx"])
    arrays = trajectory.groupBy("parity").agg(sorted_kx.alias("k")).withColumn("n", F.size("k"))
    each = arrays.select("parity", "k", "n", F.explode(F.lit([float(d) for d in delays])).alias("delay")).repartition("delay")

    def moved(i):
        s = i - 0.5 - F.col("delay")
        j = F.greatest(F.lit(0), F.least(F.floor(s).cast("int"), F.col("n") - 2))
        first = F.get("k", j)
        return first + (s - j) * (F.coalesce(F.get("k", j + 1), first) - first)

    shifted = each.withColumn("k", F.transform(F.sequence(F.lit(0), F.col("n") - 1), moved))
    steps = F.transform(F.col("k"), lambda x, i: F.coalesce(F.abs(F.get("k", i + 1) - x), F.lit(0.0)))
    dense = shifted.withColumn("w", steps).withColumn("total", F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x))
    return dense.select("delay", "parity", "total", F.posexplode(F.arrays_zip("k", "w")).alias("i", "at")).select("delay", "parity", "i", F.col("at.k").alias("kx"), (F.col("at.w") / F.col("total")).alias("w"))


def calibration_phase(shots: DataFrame, trajectory: DataFrame, nx: int, etl: int, fov_cm: float) -> DataFrame:
    """One row (a0, a1) from calibration shots (shot, echo, coil, i, re, im): averaged over shots, gridded, fitted."""
    mean = shots.groupBy("echo", "coil", "i").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return R.odd_even_phase(R.grid_readouts(mean, R.gridding_weights(trajectory, nx, fov_cm), ["echo", "coil"]), nx, etl)


def delayed_lines(shots: DataFrame, trajectory: DataFrame, nx: int, etl: int, fov_cm: float, delays: Iterable[float]) -> DataFrame:
    """delay, echo, coil, ix, re, im: image lines of the averaged shots (shot, echo, coil, i, re, im) under each candidate delay.

    One plan for all candidates. Shots are averaged first (gridding is linear), the train is written once, a row for each
    sample number with all its echoes and channels; each row meets every candidate's weights, and lines are summed by
    candidate, so the weights of a place are made once and not for each channel.
    """
    mean = shots.where(F.col("echo") < etl - etl % 2).groupBy("echo", "coil", "i").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    rows = mean.groupBy((F.col("echo") % 2).cast("int").alias("parity"), "i").agg(F.collect_list(F.struct("echo", "coil", "re", "im")).alias("train"))  # an entry for each echo and channel
    train = kept(rows)
    size = train.agg(F.coalesce(F.sum(F.size("train")), F.lit(0))).first()[0]
    met = delayed_weights(trajectory, delays).join(F.broadcast(train) if size <= TRAIN_SENT else train, ["parity", "i"])
    places = met.select("delay", "train", "kx", "w", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("ix"))
    angle = 2 * math.pi * F.col("kx") * (F.col("ix") - nx / 2.0) * (fov_cm / nx)
    turned = places.select("delay", "train", "ix", (F.col("w") * F.cos(angle)).alias("wre"), (F.col("w") * F.sin(angle)).alias("wim"))
    parts = turned.select("delay", "ix", "wre", "wim", F.explode("train").alias("s")).select("delay", "ix", "wre", "wim", "s.*")
    return parts.groupBy("delay", "echo", "coil", "ix").agg(F.sum(F.col("re") * F.col("wre") - F.col("im") * F.col("wim")).alias("re"), F.sum(F.col("re") * F.col("wim") + F.col("im") * F.col("wre")).alias("im"))


def delay_report(shots: DataFrame, trajectory: DataFrame, nx: int, etl: int, fov_cm: float, delays: Iterable[float]) -> DataFrame:
    """delay, a1, a2, wrap_count for each candidate delay; ``recon.best_delay`` picks one. Lines are written once."""
    report = R.odd_even_report(kept(delayed_lines(shots, trajectory, nx, etl, fov_cm, delays)), nx, etl, key=("delay",))
    return report.select("delay", F.col("a0").alias("a1"), F.col("a1").alias("a2"), "wrap_count")


def kspace_volume(shots: DataFrame, schedule: DataFrame, white: np.ndarray, squeeze: np.ndarray, weights: DataFrame, phase: tuple[float, float], nx: int, ny: int, nz: int) -> DataFrame:
    """frame, coil, ix, iy, iz, re, im: raw shots (frame, shot, echo, coil, i, re, im) whitened, compressed, gridded, corrected and put
    in their places. Places without a sample are left out, which stands for zero. Channels mix before gridding, so the joins
    after it are smaller by the compression."""
    mixed = C.mixed(shots, squeeze @ white.conj(), conjugate=False)
    lines = R.grid_readouts(mixed, weights, ["frame", "shot", "echo", "coil"])
    fixed = R.phase_corrected(lines, nx, *phase)
    placed = R.pair_with_schedule(fixed, schedule)
    at = Window.partitionBy("frame", "coil", "ix", "iy", "iz").orderBy(F.desc("shot"), F.desc("echo"))
    kept = placed.where(F.col("iy").between(0, ny - 1) & F.col("iz").between(0, nz - 1)).withColumn("rk", F.row_number().over(at)).where("rk = 1")
    return kept.select("frame", "coil", "ix", "iy", "iz", "re", "im")


def preprocess(root: str, scan: str, shots: DataFrame, schedule: DataFrame, noise: DataFrame, reference: DataFrame, calibration: DataFrame, trajectory: DataFrame, size: tuple[int, int, int], etl: int, fov_cm: float, delay: float, energy: float = 0.95, floor: int = 1, batch: int = 8) -> tuple[str, list[int]]:
    """Raw shots to k-space volumes under ``root``, a batch of frames to a job, going on where an earlier run stopped.

    Tables: shots (frame, shot, echo, coil, i, re, im), schedule (frame, shot, echo, iy, iz), noise and reference (sample, coil, re, im),
    calibration (shot, echo, coil, i, re, im), trajectory (parity, i, kx). The mark covers the name of the scan, settings and
    all tables but the shots, which are too many to read twice; another set of shots needs another name. A frame whose
    shots aren't all there is an error that names it; frames before it stay. Returns the mark (see read_frames) and the frames written.
    """
    spark = shots.sparkSession
    nx, ny, nz = size
    settings = {"scan": scan, "size": list(size), "etl": etl, "fov_cm": fov_cm, "delay": delay, "energy": energy, "floor": floor}
    mark = committed.fingerprint(settings, {"schedule": schedule, "noise": noise, "reference": reference, "calibration": calibration, "trajectory": trajectory})
    frames = [r["frame"] for r in schedule.select("frame").distinct().collect()]  # numbers of frames
    if all(str(f) in committed.commits(spark, root, mark) for f in frames):
        return mark, []
    white, squeeze = calibrated_matrices(noise, reference, energy, floor)
    moved = delayed(trajectory, delay)
    even = etl - etl % 2
    fit = calibration_phase(C.mixed(calibration.where(F.col("echo") < even), squeeze @ white.conj(), conjugate=False), moved, nx, even, fov_cm).first()
    weights = kept(R.gridding_weights(moved, nx, fov_cm))

    def work(now: list[int]) -> DataFrame:
        own, plan = shots.where(F.col("frame").isin(now)), schedule.where(F.col("frame").isin(now))
        arrived = own.select("frame", "shot", "echo").distinct()
        short = sorted(r["frame"] for r in plan.select("frame", "shot", "echo").join(arrived, ["frame", "shot", "echo"], "left_anti").select("frame").distinct().collect())
        if short:
            raise RuntimeError(f"the archive ended before all shots of frames {short} were read")
        return kspace_volume(own, plan, white, squeeze, weights, (fit["a0"], fit["a1"]), nx, ny, nz)

    return mark, committed.process_frames(root, mark, frames, work, spark, batch)


def duplicate_places(schedule: DataFrame) -> DataFrame:
    """frame, duplicates: samples that another one of the frame overwrites."""
    return schedule.groupBy("frame", "iy", "iz").count().groupBy("frame").agg(F.sum(F.col("count") - 1).alias("duplicates"))


def reconstruct(kspace: DataFrame, maps: DataFrame | Callable[[], DataFrame], shape: tuple[int, ...], channels: int, method: str = "rss", frames: int | None = None, **how) -> DataFrame:
    """Images of all frames (or the first ``frames``) by rss, cg_sense or wavelet_tv. Maps may be a function, called only if the method needs them."""
    wanted = kspace if frames is None else kspace.where(F.col("frame") < frames)
    if method == "rss":
        return R.frame_map(wanted, None, shape, channels, lambda k, _: R.rss_image(k))
    if method not in ("cg_sense", "wavelet_tv"):
        raise ValueError(f"unknown method {method!r}")
    solver = {"cg_sense": R.cg_sense, "wavelet_tv": R.wavelet_tv}[method]
    return R.frame_map(wanted, maps() if callable(maps) else maps, shape, channels, lambda k, m: solver(k, m, **how))


def empty_frames(image: DataFrame) -> DataFrame:
    """Frames whose image is zero everywhere."""
    return image.groupBy("frame").agg(F.bool_or((F.col("re") != 0) | (F.col("im") != 0)).alias("any")).where("not any").select("frame")


def run_all(names: Iterable[str], work: Callable[[str], DataFrame]) -> dict[str, str]:
    """Run one job for each sequence; one that fails is reported and doesn't stop the others."""
    out = {}
    for name in names:
        try:
            work(name).write.format("noop").mode("overwrite").save()
            out[name] = "ok"
        except Exception as error:
            out[name] = f"failed: {error}"
    return out


# ---- export ----------------------------------------------------------------------------------------------------------


def require_feasible(report: DataFrame) -> DataFrame:
    """The report; raises, with its summary, if anything is over its limit."""
    row = report.first()
    if not row["ok"]:
        raise ValueError(row["summary"])
    return report


def export_loops(reports: dict[str, DataFrame], contents: dict[str, loopfile.LoopFile]) -> dict[str, bytes]:
    """All loops encoded; every report is checked before any is encoded."""
    for report in reports.values():
        require_feasible(report)
    return {name: loopfile.encode(content) for name, content in contents.items()}


# ---- data behind figures ---------------------------------------------------------------------------------------------


def mask_figure(mask: DataFrame, frame: int, ny: int, nz: int, fov_y: float, fov_z: float) -> DataFrame:
    """One frame's cells in 1/m."""
    return mask.where(F.col("frame") == frame).select(((F.col("iy") - ny / 2) / fov_y).alias("ky"), ((F.col("iz") - nz / 2) / fov_z).alias("kz"), "sampled")


def trajectory_figure(schedule: DataFrame, frame: int) -> DataFrame:
    """One frame's path, in order."""
    return schedule.where(F.col("frame") == frame).orderBy("shot", "echo")


def repetition_figure(program: DataFrame, shot: int, etl: int) -> DataFrame:
    """One shot's blocks with start times; the echo of TE is marked."""
    from lumafold.operators.assembly import one_repetition

    return one_repetition(program, shot).withColumn("is_te", F.col("echo") == (etl - 1) // 2)


def stimulation_figure(wave: DataFrame, first: int, last: int, hardware, dt: float, weights: tuple[float, ...]) -> DataFrame:
    """i, ch, g, slew and the combined stimulation over a range of samples."""
    part = wave.where(F.col("i").between(first, last))
    steps = P.slew(part, dt).withColumnRenamed("g", "slew")
    return part.join(steps, ["ch", "i"]).join(P.stimulation(part, hardware.slew_min, hardware.chronaxie, dt, weights), "i")


def replotted(spark: SparkSession, schedule_path: str, frame: int, ny: int, nz: int) -> DataFrame:
    """The mask of a stored schedule's frame, for drawing again."""
    from lumafold.operators.lattice import lattice
    from lumafold.operators.schedule import rebuilt_mask

    plan = images.read_arrays(spark, schedule_path).where(F.col("frame") == frame).withColumn("frame", F.lit(0))
    return rebuilt_mask(lattice(spark, ny, nz), plan)
