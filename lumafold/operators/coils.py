"""Channel statistics: Gram matrices in Spark, small dense algebra on the driver, and channel mixing as broadcast joins.

A channel matrix has at most MAX_CHANNELS squared entries, which bounds what is collected and what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_CHANNELS = 256


def gram(samples: DataFrame, conjugate_first: bool = True) -> DataFrame:
    """i, j, re, im: average over samples of conj(x_i) x_j (noise layout), or of x_i conj(x_j).

    ``samples``: sample, coil, re, im. Each sample's channels become one array first. A task multiplies whole batches of samples and
    sends one matrix (at most MAX_CHANNELS squared entries), so rows made don't grow with the samples. Pairs that no sample has
    are left out.
    """
    entry = F.struct(F.col("coil").cast("int").alias("coil"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    rows = samples.groupBy("sample").agg(F.collect_list(entry).alias("x")).select("x")  # an entry for each channel

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total, seen, count = 0, np.zeros((0, 0), complex), np.zeros((0, 0)), 0
        for batch in batches:
            lists = batch.column(0)
            entries = lists.flatten()
            coil = entries.field("coil").to_numpy()
            if not len(coil):
                continue
            if coil.min() < 0 or coil.max() >= MAX_CHANNELS:
                raise ValueError("too many channels")
            if coil.max() >= size:
                grown = int(coil.max()) + 1 - size
                total, seen, size = np.pad(total, (0, grown)), np.pad(seen, (0, grown)), size + grown
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            x, has = np.zeros((len(lists), size), complex), np.zeros((len(lists), size))
            x[row, coil], has[row, coil] = entries.field("re").to_numpy() + 1j * entries.field("im").to_numpy(), 1
            total, seen, count = total + x.conj().T @ x, seen + has.T @ has, count + len(lists)
        i, j = np.nonzero(seen)
        whole = np.append(total[i, j], count)  # the last row carries the number of samples
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(whole.real), pa.array(whole.imag)], ["i", "j", "re", "im"])

    sums = rows.mapInArrow(partial, "i int, j int, re double, im double").groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    n = F.max(F.when(F.col("i") < 0, F.col("re"))).over(Window.partitionBy(F.lit(0)))  # a row for each pair of channels
    sign = 1 if conjugate_first else -1
    return sums.withColumn("n", n).where("i >= 0").select("i", "j", (F.col("re") / F.col("n")).alias("re"), (sign * F.col("im") / F.col("n")).alias("im"))


def matrix_of(entries: DataFrame) -> np.ndarray:
    """The matrix behind i, j, re, im; collects at most MAX_CHANNELS squared rows."""
    rows = entries.limit(MAX_CHANNELS * MAX_CHANNELS + 1).collect()
    if len(rows) > MAX_CHANNELS * MAX_CHANNELS:
        raise ValueError("too many channels")
    n = 1 + max((max(r["i"], r["j"]) for r in rows), default=-1)
    out = np.zeros((n, n), complex)
    for r in rows:
        out[r["i"], r["j"]] = complex(r["re"], r["im"])
    return out


def matrix_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    rows = [(i, j, float(matrix[i, j].real), float(matrix[i, j].imag)) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, re double, im double")


def whitening(noise: DataFrame) -> np.ndarray:
    """Inverse Cholesky factor of the noise Gram matrix."""
    return np.linalg.inv(np.linalg.cholesky(matrix_of(gram(noise))))


def channels_for_energy(covariance: np.ndarray, share: float, floor: int) -> int:
    """Fewest principal channels that hold ``share`` of the energy; at least ``floor``, at most all."""
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1].clip(min=0)
    held = np.cumsum(values) / values.sum()
    return min(max(int(np.searchsorted(held, share - 1e-12)) + 1, floor), len(values))


def compression(covariance: np.ndarray, count: int) -> np.ndarray:
    """count x n: conjugate rows of the leading eigenvectors."""
    _, vectors = np.linalg.eigh(covariance)
    return vectors[:, ::-1][:, :count].conj().T


def mixed(samples: DataFrame, matrix: np.ndarray, conjugate: bool) -> DataFrame:
    """sample, coil, re, im: x times the transposed matrix (conjugated for whitening)."""
    w = matrix.conj() if conjugate else matrix
    table = matrix_table(samples.sparkSession, w).withColumnsRenamed({"i": "out", "j": "coil", "re": "wre", "im": "wim"})
    met = samples.join(F.broadcast(table), "coil")
    keys = [c for c in samples.columns if c not in ("coil", "re", "im")]
    return met.groupBy(*keys, F.col("out").alias("coil")).agg(F.sum(F.col("re") * F.col("wre") - F.col("im") * F.col("wim")).alias("re"), F.sum(F.col("re") * F.col("wim") + F.col("im") * F.col("wre")).alias("im"))


def sensitivity_maps(calibration: np.ndarray, kernel: int = 5, threshold: float = 0.02, crop: float = 0.8, size: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maps and leading eigenvalue from a k-space calibration block (axes..., coil), by an eigenvalue approach.

    Patches of the block span a signal space; its projector, as a convolution, has at each voxel an eigenvector of
    eigenvalue one that holds the coils' sensitivities. One dense task per call; voxels are solved together.
    """
    *grid, coils = calibration.shape
    side = [min(kernel, g) for g in grid]
    windows = np.lib.stride_tricks.sliding_window_view(calibration, side, axis=tuple(range(len(grid))))
    patches = np.moveaxis(windows, len(grid), -1).reshape(int(np.prod([g - s + 1 for g, s in zip(grid, side, strict=True)])), -1)
    _, strength, basis = np.linalg.svd(patches, full_matrices=False)
    kept = basis[strength > threshold * strength[0]].reshape(-1, *side, coils)
    size = tuple(size or grid)
    axes = tuple(range(1, 1 + len(grid)))
    padded = np.zeros((len(kept), *size, coils), complex)
    padded[(slice(None), *(slice(n // 2 - s // 2, n // 2 - s // 2 + s) for n, s in zip(size, side, strict=True)))] = kept.conj()
    images = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(padded, axes), axes=axes), axes) / np.sqrt(np.prod(side))
    flat = images.reshape(len(kept), -1, coils)
    operator = np.einsum("kva,kvb->vab", flat.conj(), flat)
    values, vectors = np.linalg.eigh(operator)
    lead, top = values[:, -1], vectors[:, :, -1].conj()
    phase = np.exp(-1j * np.angle(top[:, :1]))
    maps = (top * phase).reshape(*size, coils)
    eigen = lead.reshape(size)
    return np.where((eigen > crop)[..., None], maps, 0), eigen
