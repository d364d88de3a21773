"""From scattered samples to images: scatter, gridding, phase correction, coil combination and iterative solvers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumafold.operators import volumes


def scatter(cells: DataFrame, samples: DataFrame, values: list[str], last_first: list[Column], key: tuple[str, ...] = ("frame", "iy", "iz")) -> DataFrame:
    """Every cell with its sample's values, zero where there is none; filled, and copies (samples that fell on the cell).

    Of several samples on a cell the first in ``last_first`` order stays (the one written last).
    """
    at = Window.partitionBy(*key)
    best = samples.withColumn("__rk", F.row_number().over(at.orderBy(*last_first))).withColumn("copies", F.count("*").over(at)).where("__rk = 1").select(*key, "copies", *values)
    met = cells.join(best, list(key), "left")
    return met.select(*cells.columns, *[F.coalesce(v, F.lit(0)).alias(v) for v in values], F.col("copies").isNotNull().alias("filled"), F.coalesce("copies", F.lit(0)).alias("copies"))


def pair_with_schedule(samples: DataFrame, schedule: DataFrame) -> DataFrame:
    """Samples (frame, shot, echo, ...) with the cell (iy, iz) that the schedule gives them."""
    return samples.join(schedule.select("frame", "shot", "echo", "iy", "iz"), ["frame", "shot", "echo"])


def dual_echo_index(acq: Column, ny: int, echoes: int) -> Column:
    """echo, iy, iz of an acquisition number (echo fastest, then y, then z), null inside the first ny * echoes of gain calibration."""
    a = acq - ny * echoes
    return F.when(a >= 0, F.struct((a % echoes).cast("int").alias("echo"), (F.floor(a / echoes) % ny).cast("int").alias("iy"), F.floor(a / (echoes * ny)).cast("int").alias("iz")))


def frames_of(acq: Column, size: int) -> Column:
    """Count-based tumbling window: which frame of ``size`` acquisitions."""
    return F.floor(acq / size)


def frame_completeness(samples: DataFrame, size: int) -> DataFrame:
    """frame, n, complete: whether each frame has exactly ``size`` different acquisitions."""
    return samples.groupBy("frame").agg(F.countDistinct("acq").alias("n")).withColumn("complete", F.col("n") == size)


def point_spread(mask: DataFrame, ny: int, nz: int, key: tuple[str, ...] = ()) -> DataFrame:
    """key, py, pz, psf: magnitude of the centred inverse transform of a mask (its sampled cells), one axis after the other.

    Separable weight joins: a cell meets nz weights, then a column sum meets ny.
    """
    v = F.explode(F.sequence(F.lit(0), F.lit(nz - 1)))
    tau = 2 * math.pi

    def angle(k: str, i: str, n: int) -> Column:
        return F.lit(tau) * ((F.col(k) * F.col(i)) % n) / F.lit(float(n))

    along_z = mask.select(*key, "iy", "iz", v.alias("v")).groupBy(*key, "iy", "v").agg(F.sum(F.cos(angle("v", "iz", nz))).alias("re"), F.sum(F.sin(angle("v", "iz", nz))).alias("im"))
    along_y = along_z.select("*", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("u"))
    c, s = F.cos(angle("u", "iy", ny)), F.sin(angle("u", "iy", ny))
    total = along_y.groupBy(*key, "u", "v").agg((F.sum(F.col("re") * c - F.col("im") * s) / (ny * nz)).alias("re"), (F.sum(F.col("re") * s + F.col("im") * c) / (ny * nz)).alias("im"))
    return total.select(*key, F.pmod(F.col("u") + ny // 2, F.lit(ny)).cast("int").alias("py"), F.pmod(F.col("v") + nz // 2, F.lit(nz)).cast("int").alias("pz"), F.hypot("re", "im").alias("psf"))


def rss(frame: DataFrame, key: list[str]) -> DataFrame:
    """Root of the summed squared magnitudes over channels (re, im)."""
    return frame.groupBy(*key).agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("rss"))


def normalised(frame: DataFrame, key: list[str], eps: float = 1e-12) -> DataFrame:
    """Channel values divided by the root sum of squares of their cell; left as they are where that is next to zero."""
    total = F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).over(Window.partitionBy(*key)))
    safe = F.when(total < eps, F.lit(1.0)).otherwise(total)
    return frame.withColumn("re", F.col("re") / safe).withColumn("im", F.col("im") / safe)


def masked_maps(maps: DataFrame, eigen: DataFrame, threshold: float, key: tuple[str, ...] = ("ix", "iy", "iz")) -> DataFrame:
    """Maps set to zero where the eigenvalue (ev) is not above the threshold."""
    keep = F.col("ev") > threshold
    return maps.join(eigen, list(key)).select(*maps.columns[:-2], F.when(keep, F.col("re")).otherwise(0.0).alias("re"), F.when(keep, F.col("im")).otherwise(0.0).alias("im"))


def cropped(frame: DataFrame, axis: str, size: int, target: int) -> DataFrame:
    """Keep ``target`` places in the middle of an axis of ``size``, numbered anew."""
    if target > size:
        raise ValueError("the target field of view is larger than the source")
    start = (size - target) // 2
    return frame.where((F.col(axis) >= start) & (F.col(axis) < start + target)).withColumn(axis, (F.col(axis) - start).cast("int"))


def spline_weights(n: int, m: int) -> np.ndarray:
    """m x n matrix that resamples n points to m by an interpolating cubic spline (mirror ends), ends on ends."""
    basis = np.zeros((n, n))
    for i in range(n):
        for d, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            j = abs(i + d)
            basis[i, 2 * (n - 1) - j if j > n - 1 else j] += w
    at = np.linspace(0, n - 1, m) if m > 1 else np.zeros(1)
    pick = np.zeros((m, n))
    for r, x in enumerate(at):
        for k in range(math.floor(x) - 1, math.floor(x) + 3):
            t = abs(x - k)
            w = 2 / 3 - t * t + t**3 / 2 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0
            j = abs(k)
            pick[r, 2 * (n - 1) - j if j > n - 1 else j] += w
    return pick @ np.linalg.inv(basis) if n > 1 else np.ones((m, 1))


def resampled(frame: DataFrame, axis: str, n: int, m: int, key: list[str]) -> DataFrame:
    """Resample (re, im) along one axis by a spline's weight table of n * m rows."""
    weights = spline_weights(n, m)
    rows = [(k, i, float(weights[k, i])) for k in range(m) for i in range(n) if abs(weights[k, i]) > 1e-12]
    table = frame.sparkSession.createDataFrame(rows, "k int, i int, w double")
    met = frame.join(F.broadcast(table), F.col(axis) == F.col("i"))
    return met.groupBy(*key, F.col("k").alias(axis)).agg(F.sum(F.col("re") * F.col("w")).alias("re"), F.sum(F.col("im") * F.col("w")).alias("im"))


# ---- readout gridding and odd/even phase -------------------------------------------------------------------------


def density_compensation(trajectory: DataFrame) -> DataFrame:
    """parity, i, kx, w: step to the next sample, 0 at the last, over the largest."""
    at = Window.partitionBy("parity")
    step = F.coalesce(F.abs(F.lead("kx").over(at.orderBy("i")) - F.col("kx")), F.lit(0.0))
    return trajectory.withColumn("w", step).withColumn("w", F.col("w") / F.max("w").over(at))


def gridding_weights(trajectory: DataFrame, nx: int, fov_cm: float) -> DataFrame:
    """parity, i, ix, wre, wim: the adjoint of the transform at each sample's kx, scaled to sum to one."""
    dense = density_compensation(trajectory)
    total = F.sum("w").over(Window.partitionBy("parity"))
    scaled = dense.withColumn("w", F.col("w") / total)
    x = (F.col("ix") - nx / 2.0) * (fov_cm / nx)
    angle = 2 * math.pi * F.col("kx") * x
    grid = scaled.select("parity", "i", "kx", "w", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("ix"))
    return grid.select("parity", "i", "ix", (F.col("w") * F.cos(angle)).alias("wre"), (F.col("w") * F.sin(angle)).alias("wim"))


def grid_readouts(samples: DataFrame, weights: DataFrame, key: list[str]) -> DataFrame:
    """key, ix, re, im: image lines from ramp-sampled readouts (echo, i, re, im); odd-numbered echoes use the other trajectory."""
    met = samples.withColumn("parity", (F.col("echo") % 2).cast("int")).join(F.broadcast(weights), ["parity", "i"])
    return met.groupBy(*key, "ix").agg(F.sum(F.col("re") * F.col("wre") - F.col("im") * F.col("wim")).alias("re"), F.sum(F.col("re") * F.col("wim") + F.col("im") * F.col("wre")).alias("im"))


def pair_phases(lines: DataFrame, nx: int, etl: int, threshold: float = 0.1, key: tuple[str, ...] = ()) -> DataFrame:
    """key, pair, ix, th, inside: phase of the second over the first echo of each pair along x, and whether the fit uses that place.

    ``lines``: key, echo (from 0), coil, ix, re, im in image space along x, from a train without blips; an odd last echo is left out.
    Native: phase along the second echoes at the middle, unwrapped for each channel, averaged by power, smoothed and fitted for the
    off-resonance drift; drift removed; phases of pairs averaged over channels by power. A place is inside if the echo
    half a train after the pair's number is strong there, in the middle half of x, for the later half of the pairs.
    """
    from lumafold.operators.signal import middle_reference, moving_average, unwrap, weighted_phase

    by, pairs = list(key), etl // 2
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    used = lines.where(F.col("echo") < 2 * pairs)
    second = used.where((F.col("echo") % 2 == 1) & (F.col("ix") == nx // 2 - 1)).select(*by, "coil", F.floor(F.col("echo") / 2).alias("m"), F.atan2("im", "re").alias("phase"), power.alias("w"))
    drift = middle_reference(unwrap(second, [*by, "coil"], ["m"], "phase"), [*by, "coil"], ["m"], "unwrapped")
    across = drift.groupBy(*by, "m").agg(weighted_phase(F.col("w"), F.col("centered")).alias("phase")).withColumn("__all", F.lit(1))
    smooth = moving_average(unwrap(across, [*by, "__all"], ["m"], "phase"), [*by, "__all"], ["m"], "unwrapped", 1 if pairs < 10 else 5)
    place = 2 * F.col("m") + 2
    line = smooth.groupBy(*by, "__all").agg(F.regr_intercept(F.col("smooth"), place).alias("b0"), F.regr_slope(F.col("smooth"), place).alias("b1"))
    # A removed drift turns both echoes of a pair, so its phase changes by one step of the drift; magnitudes stay as they are.
    strength = used.groupBy(*by, "echo", "ix").agg(F.sqrt(F.sum(power)).alias("s")).withColumn("__all", F.lit(1))
    peak = strength.groupBy(*by, "__all").agg(F.max("s").alias("peak"))
    low, high = math.floor(nx / 4 + 0.5), math.floor(3 * nx / 4 + 0.5) - 1
    strong = strength.where((F.col("echo") >= pairs + pairs // 2) & (F.col("ix") >= low) & (F.col("ix") < high)).join(peak, [*by, "__all"])
    strong = strong.where(F.col("s") > threshold * F.col("peak")).select(*by, (F.col("echo") - pairs).cast("long").alias("pair"), "ix", F.lit(True).alias("inside"))
    of = lambda side, c: F.max(F.when(F.col("echo") % 2 == side, F.col(c)))
    met = used.groupBy(*by, "coil", F.floor(F.col("echo") / 2).alias("pair"), "ix").agg(of(0, "re").alias("ar"), of(0, "im").alias("ai"), of(1, "re").alias("br"), of(1, "im").alias("bi"))
    turned = F.atan2(F.col("bi") * F.col("ar") - F.col("br") * F.col("ai"), F.col("br") * F.col("ar") + F.col("bi") * F.col("ai"))
    summed = met.withColumn("p", F.col("br") * F.col("br") + F.col("bi") * F.col("bi")).withColumn("d", turned).groupBy(*by, "pair", "ix").agg(F.sum(F.col("p") * F.cos("d")).alias("c"), F.sum(F.col("p") * F.sin("d")).alias("s")).withColumn("__all", F.lit(1))
    fixed = summed.join(line, [*by, "__all"]).withColumn("th", F.atan2(F.col("s") * F.cos("b1") - F.col("c") * F.sin("b1"), F.col("c") * F.cos("b1") + F.col("s") * F.sin("b1")))
    return fixed.join(strong, [*by, "pair", "ix"], "left").select(*by, "pair", "ix", "th", F.coalesce("inside", F.lit(False)).alias("inside"))


def _phase_fit(nx: int) -> tuple[Column, Column]:
    th, x = F.when(F.col("inside"), F.col("th")), F.when(F.col("inside"), (F.col("ix") - nx / 2.0 + 0.5) / nx)
    return F.regr_intercept(th, x).alias("a0"), F.regr_slope(th, x).alias("a1")


def odd_even_phase(lines: DataFrame, nx: int, etl: int, threshold: float = 0.1, key: tuple[str, ...] = ()) -> DataFrame:
    """key, a0, a1: constant and linear phase between odd and even echoes of a calibration train, over the places inside (see pair_phases)."""
    return pair_phases(lines, nx, etl, threshold, key).groupBy(*key).agg(*_phase_fit(nx))


def odd_even_report(lines: DataFrame, nx: int, etl: int, threshold: float = 0.1, key: tuple[str, ...] = (), jump: float = math.pi) -> DataFrame:
    """key, a0, a1, wrap_count: the fit, and the steps over ``jump`` between neighbours in the middle half of x, in the later half of the pairs."""
    pairs, low, high = etl // 2, math.floor(nx / 4 + 0.5), math.floor(3 * nx / 4 + 0.5)
    w = Window.partitionBy(*key, "pair").orderBy("ix")
    middle = (F.col("pair") >= pairs // 2) & (F.col("ix") >= low) & (F.col("ix") < high)
    # Only neighbours that are both in the middle half make a step.
    phases = pair_phases(lines, nx, etl, threshold, key).withColumn("__d", F.abs(F.col("th") - F.lag("th").over(w)))
    return phases.groupBy(*key).agg(*_phase_fit(nx), F.count_if(middle & (F.col("ix") > low) & (F.col("__d") > jump)).cast("int").alias("wrap_count"))


def phase_corrected(lines: DataFrame, nx: int, a0: float | Column, a1: float | Column) -> DataFrame:
    """Image lines with the odd/even phase taken from odd-numbered echoes."""
    a0, a1 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a0, a1))
    t = F.when(F.col("echo") % 2 == 1, -(a0 + a1 * (F.col("ix") - nx / 2.0 + 0.5) / nx)).otherwise(F.lit(0.0))
    re, im = F.col("re") * F.cos(t) - F.col("im") * F.sin(t), F.col("re") * F.sin(t) + F.col("im") * F.cos(t)
    return lines.withColumns({"re": re, "im": im})


def best_delay(report: DataFrame) -> DataFrame:
    """The row of a delay report (delay, a1, a2, wrap_count): without wraps and least |a2|, else fewest wraps; first on a tie."""
    clean = F.col("wrap_count") == 0
    return report.orderBy(F.desc(clean), F.when(clean, F.abs("a2")).otherwise(F.col("wrap_count")), "delay").limit(1)


def wrap_counts(phases: DataFrame, key: list[str], order: list[str], phase: str) -> DataFrame:
    """key, wrap_count: steps of more than pi."""
    w = Window.partitionBy(*key).orderBy(*order)
    return phases.withColumn("__d", F.abs(F.col(phase) - F.lag(phase).over(w))).groupBy(*key).agg(F.count_if(F.col("__d") > F.pi()).alias("wrap_count"))


# ---- per-frame solvers ---------------------------------------------------------------------------------------------

def fftc(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """Centred unitary transform."""
    return np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(x, axes), axes=axes, norm="ortho"), axes)


def ifftc(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return np.fft.fftshift(np.fft.ifftn(np.fft.ifftshift(x, axes), axes=axes, norm="ortho"), axes)


def cg_sense(kspace: np.ndarray, maps: np.ndarray, iterations: int = 20, tolerance: float = 1e-9) -> np.ndarray:
    """Least squares over coils by conjugate gradients. Arrays end in the coil axis; unsampled places are zero in coil 0."""
    axes = tuple(range(kspace.ndim - 1))
    mask = (np.abs(kspace[..., :1]) > 0).astype(float)

    def normal(x: np.ndarray) -> np.ndarray:
        return (maps.conj() * ifftc(mask * fftc(maps * x[..., None], axes), axes)).sum(-1)

    residual = (maps.conj() * ifftc(mask * kspace, axes)).sum(-1)
    image, direction = np.zeros_like(residual), residual.copy()
    energy = start = float(np.vdot(residual, residual).real)
    for _ in range(iterations):
        if energy == 0:
            break
        moved = normal(direction)
        step = energy / float(np.vdot(direction, moved).real)
        image = image + step * direction
        residual = residual - step * moved
        new = float(np.vdot(residual, residual).real)
        if math.sqrt(new / start) < tolerance:
            break
        direction, energy = residual + (new / energy) * direction, new
    return image


def rss_image(kspace: np.ndarray, maps: np.ndarray | None = None) -> np.ndarray:
    axes = tuple(range(kspace.ndim - 1))
    shift = lambda x, f: np.fft.fftshift(f(np.fft.fftshift(x, axes)), axes)
    return np.sqrt((np.abs(shift(kspace, lambda x: np.fft.ifftn(x, axes=axes))) ** 2).sum(-1))


#: The scaling filter of the Daubechies wavelet with four vanishing moments.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def _wavelet_level(n: int) -> np.ndarray:
    """One level for any length: averages, then details, of the signal with zeros beyond its ends.

    Every place at which a filter meets the signal is kept, (n + 7) // 2 of each kind, so columns are orthonormal and the transpose
    is the exact adjoint and a left inverse.
    """
    taps = len(DB4)
    half = (n + taps - 1) // 2
    out = np.zeros((2 * half, n))
    for r in range(half):
        for k, (low, high) in enumerate(zip(DB4, reversed(DB4), strict=True)):
            at = 2 * r + 2 - taps + k
            if 0 <= at < n:
                out[r, at] = low
                out[half + r, at] = (-1) ** k * high
    return out


class Wavelets:
    """Separable Daubechies wavelets of an array, over as many levels as its shortest axis allows (axes too short for one are left as they are).

    A level splits every axis into averages and details; the next level splits the corner of averages alone. ``forward`` gives the
    last corner and each level's array with its corner zero; ``back`` is the adjoint, which undoes it. Axes may be odd.
    """

    def __init__(self, shape: tuple[int, ...], levels: int | None = None) -> None:
        taps = len(DB4)
        even = [n + n % 2 for n in shape]
        self.axes = [a for a, n in enumerate(even) if n >= 2 * (taps - 1)]
        most = min((int(math.log2(even[a] / (taps - 1))) for a in self.axes), default=0)
        self.levels = most if levels is None else min(levels, most)
        self.steps: list[tuple[list[np.ndarray], tuple[slice, ...]]] = []
        now = list(shape)
        for _ in range(self.levels):
            matrices = [_wavelet_level(now[a]) for a in self.axes]
            corner = [slice(None)] * len(shape)
            for a, w in zip(self.axes, matrices, strict=True):
                now[a] = len(w) // 2
                corner[a] = slice(0, now[a])
            self.steps.append((matrices, tuple(corner)))

    def _turned(self, x: np.ndarray, matrices: list[np.ndarray], back: bool) -> np.ndarray:
        for a, w in zip(self.axes, matrices, strict=True):
            x = np.moveaxis(np.tensordot(w.T if back else w, x, (1, a)), 0, a)
        return x

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        details = []
        for matrices, corner in self.steps:
            full = self._turned(x, matrices, False)
            x = full[corner].copy()
            full[corner] = 0
            details.append(full)
        return [x, *details]

    def back(self, parts: list[np.ndarray]) -> np.ndarray:
        x = parts[0]
        for (matrices, corner), full in zip(reversed(self.steps), reversed(parts[1:]), strict=True):
            full = full.copy()
            full[corner] = x  # a corner of a level's own array has no part in it
            x = self._turned(full, matrices, True)
        return x


def largest_eigenvalue(operator: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], steps: int = 30, seed: int = 0) -> float:
    """Of a positive operator, by power iteration from a random start (never above the true one)."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=shape) + 1j * rng.normal(size=shape)
    size = 0.0
    for _ in range(steps):
        norm = float(np.linalg.norm(x))
        if norm == 0:
            return 0.0
        moved = operator(x / norm)
        size, x = float(np.linalg.norm(moved)), moved
    return size


def wavelet_tv_objective(image: np.ndarray, kspace: np.ndarray, maps: np.ndarray, l1: float, tv: float) -> float:
    """What wavelet_tv makes least, for data and image in the same scale: half the squared misfit plus both weighted l1 norms."""
    axes = tuple(range(kspace.ndim - 1))
    mask = np.abs(kspace).max(-1, keepdims=True) > 0
    misfit = mask * (fftc(maps * image[..., None], axes) - kspace)
    rough = sum(float(np.abs(np.roll(image, -1, a) - image).sum()) for a in axes)
    sparse = sum(float(np.abs(p).sum()) for p in Wavelets(image.shape).forward(image))
    return 0.5 * float((np.abs(misfit) ** 2).sum()) + l1 * sparse + tv * rough


def wavelet_tv(kspace: np.ndarray, maps: np.ndarray, l1: float, tv: float, iterations: int = 100) -> np.ndarray:
    """Sparse reconstruction, l1 norm of wavelets over all levels plus total variation, by a primal-dual hybrid gradient.

    Data are scaled so that the 99th percentile of their nonzero magnitudes is 1. A place is sampled if any channel has a value
    there. Step sizes come from the largest eigenvalue of the stacked operator, by power iteration behind its known bound.
    """
    axes = tuple(range(kspace.ndim - 1))
    mask = (np.abs(kspace).max(-1, keepdims=True) > 0).astype(float)
    found = np.abs(kspace[np.abs(kspace) > 0])
    scale = 1 / np.percentile(found, 99) if found.size else 1.0
    data = kspace * scale
    shape = kspace.shape[:-1]
    waves = Wavelets(shape)
    forward = lambda x: mask * fftc(maps * x[..., None], axes)
    adjoint = lambda y: (maps.conj() * ifftc(mask * y, axes)).sum(-1)
    grad = lambda x: np.stack([np.roll(x, -1, a) - x for a in axes])
    div = lambda g: sum(np.roll(g[k], 1, a) - g[k] for k, a in enumerate(axes))

    def normal(x: np.ndarray) -> np.ndarray:
        return adjoint(forward(x)) + (x if l1 else 0) + (div(grad(x)) if tv else 0)  # wavelets and their adjoint cancel

    bound = float((np.abs(maps) ** 2).sum(-1).max()) + (1 if l1 else 0) + (4 * len(axes) if tv else 0)
    size = min(bound, 1.05 * largest_eigenvalue(normal, shape)) or 1.0
    tau = sigma = 1 / math.sqrt(size)
    x = np.zeros(shape, complex)
    ahead = x.copy()
    y, v = np.zeros_like(data, dtype=complex), np.zeros((len(axes), *shape), complex)
    u = [np.zeros_like(p) for p in waves.forward(x)]
    for _ in range(iterations):
        y = (y + sigma * (forward(ahead) - data)) / (1 + sigma)
        move = adjoint(y)
        if l1:
            u = [a + sigma * b for a, b in zip(u, waves.forward(ahead), strict=True)]
            u = [a / np.maximum(1, np.abs(a) / l1) for a in u]
            move = move + waves.back(u)
        if tv:
            v = v + sigma * grad(ahead)
            v = v / np.maximum(1, np.abs(v) / tv)
            move = move + div(v)
        new = x - tau * move
        ahead, x = 2 * new - x, new
    return x / scale


def frame_map(kspace: DataFrame, maps: DataFrame | None, shape: tuple[int, ...], coils: int, solve: volumes.SolverFn) -> DataFrame:
    """Reconstruct each frame in its own task: frame, ix, iy, iz, re, im, status. See ``volumes.frame_images``, which moves packed blocks."""
    return volumes.voxels(volumes.frame_images(kspace, maps, shape, coils, solve), shape)
