"""Signals along an ordered axis: differences, smoothing, unwrapping, regression, transforms by weight tables, interpolation, convolution."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumafold.functions.columns import wrapped


def difference(frame: DataFrame, key: list[str], order: list[str], value: str, out: str = "d") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return frame.withColumn(out, F.col(value) - F.lag(value).over(w))


def second_difference(frame: DataFrame, key: list[str], order: list[str], value: str, out: str = "d2") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return frame.withColumn(out, F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w))


def moving_average(frame: DataFrame, key: list[str], order: list[str], value: str, span: int = 5, out: str = "smooth") -> DataFrame:
    """Centred average over an odd span; beyond an end there is nothing to average."""
    if span < 1 or span % 2 == 0:
        raise ValueError("the span must be odd")
    w = Window.partitionBy(*key).orderBy(*order)
    return frame.withColumn(out, F.avg(value).over(w.rowsBetween(-(span // 2), span // 2)))


def unwrap(frame: DataFrame, key: list[str], order: list[str], phase: str, out: str = "unwrapped") -> DataFrame:
    """Remove jumps of more than pi between neighbours, by whole turns."""
    w = Window.partitionBy(*key).orderBy(*order)
    step = F.col(phase) - F.lag(phase).over(w)
    fix = F.when(F.abs(step) < F.pi(), F.lit(0.0)).otherwise(wrapped(step) - step)
    return frame.withColumn("__fix", F.coalesce(fix, F.lit(0.0))).withColumn(out, F.col(phase) + F.sum("__fix").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fix")


def middle_reference(frame: DataFrame, key: list[str], order: list[str], value: str, out: str = "centered") -> DataFrame:
    """Subtract the value at place (n - 1) // 2 of each group."""
    w = Window.partitionBy(*key)
    place = F.row_number().over(w.orderBy(*order))
    size = F.count("*").over(w)
    numbered = frame.withColumn("__p", place).withColumn("__n", size)
    middle = F.max(F.when(F.col("__p") == F.floor((F.col("__n") - 1) / 2) + 1, F.col(value))).over(w)
    return numbered.withColumn(out, F.col(value) - middle).drop("__p", "__n")


def cumulative_share(frame: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """Adds rank, cumulative and share of the total. For short tables (channels, eigenvalues)."""
    w = Window.orderBy(*order)
    return frame.withColumn("rank", F.row_number().over(w)).withColumn("cumulative", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("share", F.col("cumulative") / F.sum(value).over(Window.partitionBy(F.lit(1))))


def masked_fit(frame: DataFrame, key: list[str], x: str, y: str, mask: Column) -> DataFrame:
    """key, offset, slope: least-squares line of y on x over the rows where the mask holds."""
    kept = frame.where(mask)
    return kept.groupBy(*key).agg(F.regr_intercept(F.col(y), F.col(x)).alias("offset"), F.regr_slope(F.col(y), F.col(x)).alias("slope"))


def weighted_phase(weight: Column, phase: Column) -> Column:
    """Angle of the weighted sum of unit phasors."""
    return F.atan2(F.sum(weight * F.sin(phase)), F.sum(weight * F.cos(phase)))


def dft_weights(spark, n: int, inverse: bool = False) -> DataFrame:
    """i, k, wre, wim: n * n rows, for small n (the weight-table join; larger transforms go through ``fft_lines``)."""
    if n > 512:
        raise ValueError("weight tables are for short axes")
    sign = 1.0 if inverse else -1.0
    i, k = F.col("id") % n, F.floor(F.col("id") / n)
    angle = sign * 2 * math.pi * ((i * k) % n) / n
    scale = 1.0 / n if inverse else 1.0
    return spark.range(n * n).select(i.cast("int").alias("i"), k.cast("int").alias("k"), (F.cos(angle) * scale).alias("wre"), (F.sin(angle) * scale).alias("wim"))


def apply_weights(samples: DataFrame, weights: DataFrame, key: list[str]) -> DataFrame:
    """key, k, re, im: complex sums of samples (i, re, im) over a weight table (at most 512 * 512 rows, so broadcast)."""
    met = samples.join(F.broadcast(weights), "i")
    return met.groupBy(*key, "k").agg(F.sum(F.col("re") * F.col("wre") - F.col("im") * F.col("wim")).alias("re"), F.sum(F.col("re") * F.col("wim") + F.col("im") * F.col("wre")).alias("im"))


def fft_lines(frame: DataFrame, re: str, im: str, inverse: bool = False, centered: bool = True, unitary: bool = False) -> DataFrame:
    """Transform the arrays in ``re`` and ``im`` row by row, in Arrow batches.

    centered: the zero is in the middle before and after (fftshift on both sides; with ``unitary`` ifftshift goes in, fftshift out).
    """
    names = frame.columns
    a, b = names.index(re), names.index(im)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out_re, out_im = [], []
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                z = np.asarray(x, float) + 1j * np.asarray(y, float)
                if centered:
                    z = np.fft.ifftshift(z) if unitary else np.fft.fftshift(z)
                z = np.fft.ifft(z, norm="ortho" if unitary else None) if inverse else np.fft.fft(z, norm="ortho" if unitary else None)
                if centered:
                    z = np.fft.fftshift(z)
                out_re.append(z.real.tolist())
                out_im.append(z.imag.tolist())
            columns = [pa.array(out_re, pa.list_(pa.float64())) if k == a else pa.array(out_im, pa.list_(pa.float64())) if k == b else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name in (re, im) else f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, fields)


def band_maximum(spectrum: DataFrame, bands: DataFrame, magnitude: str = "mag") -> DataFrame:
    """band (lo, hi) with the greatest magnitude inside it, over all channels; 0 where none falls in.

    ``bands`` is a table of a few rows for each hardware axis, so the range join broadcasts it behind that bound.
    """
    met = spectrum.join(F.broadcast(bands), F.col("hz").between(F.col("lo"), F.col("hi")))
    top = met.groupBy("band").agg(F.max(magnitude).alias("peak"))
    return bands.join(top, "band", "left").select("band", "lo", "hi", F.coalesce("peak", F.lit(0.0)).alias("peak"))


def shifted_samples(frame: DataFrame, key: list[str], value: str, delay: Column | float) -> DataFrame:
    """Adds shifted: the value at place i - delay, linear between samples and along the first or last step beyond them.

    ``frame`` holds i = 0..n-1 in each group; places are found by arithmetic and met by an equi-join.
    """
    delay = F.lit(float(delay)) if not isinstance(delay, Column) else delay
    size = frame.groupBy(*key).agg(F.count("*").alias("n"))
    at = frame.join(size, key).withColumn("s", F.col("i") - delay).withColumn("j", F.greatest(F.lit(0), F.least(F.floor("s"), F.col("n") - 2)).cast("int"))
    left = frame.select(*key, F.col("i").alias("j"), F.col(value).alias("v0"))
    right = frame.select(*key, (F.col("i") - 1).cast("int").alias("j"), F.col(value).alias("v1"))
    met = at.join(left, [*key, "j"]).join(right, [*key, "j"], "left")
    return met.withColumn("shifted", F.col("v0") + (F.col("s") - F.col("j")) * (F.coalesce("v1", F.col("v0")) - F.col("v0"))).drop("s", "j", "n", "v0", "v1")


def as_of(left: DataFrame, right: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """left with the last non-null ``value`` of ``right`` that comes before or at it in its group (union and one window)."""
    stamp = [F.col(c) for c in order]
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(*key, *order, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*key).orderBy(*stamp, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__v", "__side")


def short_convolution(frame: DataFrame, key: list[str], order: list[str], value: str, kernel: list[float], out: str = "filtered") -> DataFrame:
    """Causal FIR filter with a short kernel, as lags in one window; samples before the start count as zero."""
    w = Window.partitionBy(*key).orderBy(*order)
    terms = [F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) * c for k, c in enumerate(kernel)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return frame.withColumn(out, total)


def long_convolution(frame: DataFrame, kernel: np.ndarray, chunk: int = 65_536) -> DataFrame:
    """ch, i, p: causal convolution of g (ch, i, g) with a long kernel, by chunks with a halo.

    Each chunk also gets the kernel's length of samples before it, so chunks are independent tasks: overlap-save.
    """
    taps = len(kernel)
    reach = -(-(taps - 1) // chunk) if taps > 1 else 0
    home = F.floor(F.col("i") / chunk)
    dealt = frame.select("ch", "i", "g", F.explode(F.sequence(home, home + reach)).alias("chunk")).where(F.col("i") >= F.col("chunk") * chunk - (taps - 1))

    def filtered(key: tuple, table: pa.Table) -> pa.Table:
        at = key[1].as_py() * chunk
        i, g = table["i"].to_numpy(), table["g"].to_numpy()
        own = np.sort(i[i >= at])
        if not len(own):
            return pa.table({"ch": pa.array([], pa.int32()), "i": pa.array([], pa.int64()), "p": pa.array([], pa.float64())})
        base = at - (taps - 1)
        line = np.zeros(int(own[-1]) - base + 1)
        line[i - base] = g
        size = 1 << int(len(line) + taps - 1).bit_length()
        out = np.fft.irfft(np.fft.rfft(line, size) * np.fft.rfft(kernel, size), size)[own - base]
        return pa.table({"ch": pa.array(np.full(len(own), key[0].as_py(), np.int32)), "i": pa.array(own), "p": pa.array(out)})

    return dealt.groupBy("ch", "chunk").applyInArrow(filtered, "ch int, i long, p double")


def combined(frame: DataFrame, key: list[str], value: str, out: str = "total") -> DataFrame:
    """Root of the sum of squares over channels."""
    return frame.groupBy(*key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias(out))


#: Values that a percentile gathers at last, and bins of each pass before.
LAST_VALUES, BINS = 100_000, 1024


def exact_percentile(frame: DataFrame, value: Column, share: float, last_values: int = LAST_VALUES) -> float | None:
    """The percentile of ``value`` (nulls left out), linear between neighbours, or None without values.

    Each pass counts values in BINS equal bins of the range that still matters, and keeps the bins of the two ranks
    that are wanted; only when few values are left (or all are equal) are they gathered. No task holds them all.
    """
    values = frame.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    row = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, lo, hi, below, inside = row["n"], row["lo"], row["hi"], 0, row["n"]
    if not n:
        return None
    at = share * (n - 1)
    first, second = math.floor(at), min(math.floor(at) + 1, n - 1)
    while inside > last_values and hi > lo:
        width = (hi - lo) / BINS
        bin_of = F.least(F.floor((F.col("v") - lo) / width), F.lit(BINS - 1))
        counts = values.where((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()  # at most BINS rows
        kept, seen = [], below
        for r in counts:
            if seen + r["n"] > first and seen <= second:
                kept.append((r["lo"], r["hi"], r["n"], seen))
            seen += r["n"]
        if len(kept) == 2:  # the first rank is the last of one bin, the second the first of the next
            return kept[0][1] + (at - first) * (kept[1][0] - kept[0][1])
        lo, hi, inside, below = kept[0]
    if hi == lo:
        return lo
    ordered = sorted(r["v"] for r in values.where((F.col("v") >= lo) & (F.col("v") <= hi)).collect())  # at most last_values rows
    pick = [ordered[k - below] for k in (first, second)]
    return pick[0] + (at - first) * (pick[1] - pick[0])


def percentile_scale(frame: DataFrame, magnitude: Column, share: float = 0.99) -> DataFrame:
    """One row: the reciprocal of a percentile of the magnitudes that aren't zero; 1 if there is none."""
    found = exact_percentile(frame.where(magnitude > 0), magnitude, share)
    return frame.sparkSession.createDataFrame([(1.0 / found if found else 1.0,)], "scale double")
