"""Ordered block logs: dictionary of parent blocks, segments, the loop table, and what is measured on them.

A block log is a table with an ordering key ``n`` and, where it applies: ``trid`` (label that opens a segment instance, else
null), ``duration``, and for each axis a struct of type, amplitude and timing. No operator relies on row order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

AXES = ("gx", "gy", "gz")


def trap_energy(amplitude: Column, rise: Column, flat: Column, fall: Column) -> Column:
    """Integral of the squared trapezoid."""
    return amplitude * amplitude * (rise / 3.0 + flat + fall / 3.0)


def samples_energy(samples: Column, dt: Column) -> Column:
    """Integral of squared samples on a raster."""
    return F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x * x) * dt


def block_kind(rf: Column, grads: list[Column], adc: Column, label: Column, trigger: Column) -> Column:
    """Flags of a block: pure_delay, has_rf, has_adc, has_label, is_trigger."""
    nothing = reduce(lambda a, b: a & b, [g.isNull() for g in grads], rf.isNull() & adc.isNull() & trigger.isNull())
    return F.struct(nothing.alias("pure_delay"), rf.isNotNull().alias("has_rf"), adc.isNotNull().alias("has_adc"), label.isNotNull().alias("has_label"), (trigger == "physio1").alias("is_trigger"))


def signature(duration: Column, parts: list[Column], raster: float = 1e-6) -> Column:
    """Text that two blocks share exactly if they have the same parent: duration on the raster, and what doesn't scale."""
    return F.concat_ws("|", F.round(duration / raster).cast("long").cast("string"), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def parent_blocks(blocks: DataFrame, sig: str = "signature", order: str = "n") -> DataFrame:
    """signature, first_row, instances, parent_id: parents numbered by first appearance.

    The numbering window holds one row for each distinct signature, not for each block.
    """
    groups = blocks.groupBy(sig).agg(F.min(order).alias("first_row"), F.count("*").alias("instances"))
    return groups.withColumn("parent_id", F.row_number().over(Window.orderBy("first_row", sig)).cast("int"))


def tolerant_parents(blocks: DataFrame, kind: str, duration: str = "duration", order: str = "n", tolerance: float = 1e-6) -> DataFrame:
    """Adds parent_n, the first block of the same kind whose duration is within the tolerance.

    For durations that lie on no raster. Blocks meet candidates through buckets of the tolerance's width, and only
    distinct (kind, duration) pairs are compared.
    """
    bucket = F.floor(F.col(duration) / tolerance)
    groups = blocks.groupBy(kind, duration).agg(F.min(order).alias("n0")).withColumn("bucket", bucket)
    near = groups.select(F.col(kind).alias("k2"), F.col(duration).alias("d2"), F.col("n0").alias("m0"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("b2"))
    met = groups.join(near, (F.col(kind) == F.col("k2")) & (F.col("bucket") == F.col("b2")) & (F.abs(F.col(duration) - F.col("d2")) < tolerance))
    first = met.groupBy(kind, duration).agg(F.min("m0").alias("parent_n"))
    return blocks.join(first, [kind, duration])


def sessions(log: DataFrame, key: list[str], order: list[str], opens: Column) -> DataFrame:
    """Adds instance (from 1; 0 before the first opening row) and j, the place inside it. Windows run inside ``key``."""
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = log.withColumn("instance", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.withColumn("j", F.row_number().over(Window.partitionBy(*key, "instance").orderBy(*order)).cast("int"))


def segment_table(instances: DataFrame, trid: str, first: str, length: str) -> DataFrame:
    """trid, seg_id (by sorted trid), n_instances, first_row, n_blocks (length of the first instance)."""
    groups = instances.groupBy(trid).agg(F.count("*").alias("n_instances"), F.min(first).alias("first_row"), F.min_by(length, first).alias("n_blocks"))
    return groups.withColumn("seg_id", F.row_number().over(Window.orderBy(trid)).cast("int"))


def variable_positions(rows: DataFrame, segment: str, position: str, duration: str) -> DataFrame:
    """segment, position, durations, variable: whether a position's duration differs between instances."""
    return rows.groupBy(segment, position).agg(F.countDistinct(duration).alias("durations"), F.count("*").alias("n")).withColumn("variable", F.col("durations") > 1)


def strongest_instance(instances: DataFrame, segment: str, energy: str, order: str) -> DataFrame:
    """For each segment the instance of greatest energy; the earliest on a tie, and the first where all are zero."""
    at = Window.partitionBy(segment).orderBy(F.desc(energy), F.asc(order))
    return instances.withColumn("rk", F.row_number().over(at)).where("rk = 1").drop("rk")


#: Rows of one range of running_rows, about.
RANGE_ROWS = 200_000
#: Rows of one range of running_numbers, about.
NUMBER_ROWS = 65_536


def partitions(ranges: int) -> int:
    """Partitions for ranges of about NUMBER_ROWS rows each: some four to a task, so that a task's memory doesn't grow with the table."""
    return max(1, min(ranges, 64), ranges // 4)


def in_order(order: list[str]) -> WindowSpec:
    """The window in which running_numbers numbers a range; more windows of this order on its rows sort nothing again."""
    return Window.partitionBy("range").orderBy(order[0], *[F.asc_nulls_last(c) for c in order[1:]])


def running_numbers(rows: DataFrame, order: list[str], size: int = NUMBER_ROWS) -> DataFrame:
    """Adds n, the row's number (from 1) by ``order``, whose first column is numeric, and range: rows of one key lie in one range, and a range in one partition.

    A count in two steps, as in running_rows: inside equal ranges of the key, of about ``size`` rows, then over the ranges' totals. Nulls come last.
    """
    key = F.col(order[0])
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
    groups = max(1, -(-ends["n"] // size))
    share = (key - F.lit(ends["lo"])) / (F.lit(ends["hi"]) - F.lit(ends["lo"]) + 1)
    spread = rows.withColumn("range", F.coalesce(F.floor(share * groups), F.lit(groups)).cast("long"))
    totals = spread.groupBy("range").agg(F.count("*").alias("__n"))
    before = totals.select("range", F.coalesce(F.sum("__n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(in_order(order))
    met = spread.repartition(partitions(groups), "range").withColumn("__in", inside).join(F.broadcast(before), "range")  # a row for each range
    return met.withColumn("n", F.col("__before") + F.col("__in")).drop("__before", "__in")


def running_rows(instances: DataFrame, order: str, size: str, groups: int | None = None) -> DataFrame:
    """Adds first and last: the row numbers (from 1) of each instance when instances follow each other by ``order``.

    A running sum in two steps, so that no single task sees all instances: inside equal ranges of the (numeric) key,
    then over the ranges' totals. Without ``groups`` there are as many ranges as keep each at about RANGE_ROWS rows.
    """
    groups = groups or max(64, -(-instances.count() // RANGE_ROWS))
    ends = instances.agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    share = (F.col(order) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1)
    spread = instances.crossJoin(F.broadcast(ends)).withColumn("__g", F.floor(share * groups)).drop("__lo", "__hi")  # one row of ends
    inside = spread.withColumn("__run", F.sum(size).over(Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = spread.groupBy("__g").agg(F.sum(size).alias("__n"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = inside.join(F.broadcast(before.select("__g", "__before")), "__g")  # ``groups`` rows
    return met.withColumn("last", F.col("__before") + F.col("__run")).withColumn("first", F.col("last") - F.col(size) + 1).drop("__g", "__run", "__before")


def whole_segment_window(instances: DataFrame, first: str, last: str, duration: str, below: int) -> DataFrame:
    """One row: instances that start before row ``below``, their total duration and last row."""
    return instances.where(F.col(first) < below).agg(F.count("*").alias("n_instances"), F.coalesce(F.sum(duration), F.lit(0)).alias("elapsed"), F.max(last).alias("last_row"))


def heat_rows(instances: DataFrame, last: str, limit: int) -> DataFrame:
    """One row: the last row of the last instance that ends within ``limit`` rows; 0 if none does."""
    return instances.where(F.col(last) <= limit).agg(F.coalesce(F.max(last), F.lit(0)).alias("heat_rows"))


def unit_slew(rise: Column, fall: Column) -> Column:
    """Steepest slope of a unit trapezoid."""
    return F.greatest(1.0 / rise, 1.0 / fall)


def realised_slew(loop: DataFrame, parents: DataFrame, on: str, amplitude: str, unit: str) -> DataFrame:
    """max_slew over loop rows whose parent is a real block (id of 1 or more)."""
    return loop.where(F.col(on) >= 1).join(parents, on).agg(F.max(F.col(unit) * F.abs(amplitude)).alias("max_slew"))


def loop_table(blocks: DataFrame, parents: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """The 23-column loop table from blocks with trid, duration, rf/adc structs and axis structs.

    Parents are met by signature; without them the blocks have their parent_id. Amplitudes and energies of an axis are the trapezoid's,
    but for those that the blocks have as amp_ and energy_ columns. Columns named in ``also`` are kept.

    Columns: segment, parent and trigger numbers, RF amplitude/phase/frequency and energy, amplitude and energy of each
    axis, ADC phase, duration, and the nine entries of the (always identity) rotation.
    """
    joined = blocks if parents is None else blocks.join(parents.select("signature", "parent_id"), "signature", "left")
    identity = [F.lit(1.0 if r == c else 0.0).alias(f"r{r}{c}") for r in range(3) for c in range(3)]
    adc_freq, rf_freq = F.col("adc.freq"), F.col("rf.freq")
    own = lambda name, made: F.coalesce(F.col(name) if name in blocks.columns else made, F.lit(0.0)).alias(name)
    axes = [x for a in AXES for x in (own(f"amp_{a}", F.col(f"{a}.amplitude")), own(f"energy_{a}", trap_energy(F.col(f"{a}.amplitude"), F.col(f"{a}.rise"), F.col(f"{a}.flat"), F.col(f"{a}.fall"))))]
    return joined.select(
        "n", F.coalesce("seg_id", F.lit(0)).alias("segment_id"), F.coalesce("parent_id", F.lit(0)).alias("parent_id"), F.col("is_trigger").cast("int").alias("trigger"),
        F.coalesce("rf.amplitude", F.lit(0.0)).alias("rf_amp"), F.coalesce("rf.phase", F.lit(0.0)).alias("rf_phase"), F.coalesce(adc_freq, rf_freq, F.lit(0.0)).alias("frequency"),
        *axes, F.coalesce("adc.phase", F.lit(0.0)).alias("adc_phase"), "duration", *identity, *also,
    )
