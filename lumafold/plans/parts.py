"""Queries on single operators: design arithmetic, block properties, checks, corrections, and numbered entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumafold.functions.columns import round_away, settled
from lumafold.operators import config as C
from lumafold.operators import events as E
from lumafold.operators import feasibility as P
from lumafold.operators import lattice as L
from lumafold.operators import recon as R
from lumafold.operators import registry as K
from lumafold.operators import schedule as S
from lumafold.operators import signal as G
from lumafold.plans.blocks import _OLD_SQL
from lumafold.plans.masks import _SCHED_SQL, ACCEL, _ticaipi_sql, query_set, schedule
from lumafold.plans.views import ACQ_SQL, CELLS_SQL, NY, NZ, acquisitions, cells
from lumafold.session import table
from lumafold.streaming.frames import event_windows

QUERIES, ORACLES, query = query_set()

_SCANNERS = [C.Hardware("scanner0", 0.05, 200.0, 25e-6, 3.0), C.Hardware("scanner1", 0.08, 180.0, 20e-6, 3.0), C.Hardware("scanner2", 0.04, 150.0, 14e-6, 1.5)]
_SCANNERS_SQL = ", ".join(f"('{h.name}', {h.max_grad}::DOUBLE, {h.max_slew}::DOUBLE, {h.b0}::DOUBLE)" for h in _SCANNERS)


@query("q48_scanner_limits", f"SELECT s_suppkey, scanner, max_grad, max_slew, b0 FROM (SELECT s_suppkey, 'scanner' || (s_nationkey % 3) AS scanner FROM supplier) JOIN (VALUES {_SCANNERS_SQL}) AS c(name, max_grad, max_slew, b0) ON name = scanner")
def q48(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("scanner"), (F.col("s_nationkey") % 3).cast("string")).alias("scanner"))
    return C.with_hardware(runs, C.hardware_catalog(spark, _SCANNERS)).select("s_suppkey", "scanner", "max_grad", "max_slew", "b0")


@query("q49_stored_numbering", f"WITH {CELLS_SQL} SELECT frame, sum(iy - 1)::BIGINT AS zero_iy, sum(iz - 1)::BIGINT AS zero_iz, sum(iy + 1)::BIGINT AS one_iy, sum(iz + 1)::BIGINT AS one_iz FROM cells GROUP BY frame")
def q49(spark: SparkSession, sf: str) -> DataFrame:
    zero = C.zero_based(cells(spark, sf)).groupBy("frame").agg(F.sum("iy").alias("zero_iy"), F.sum("iz").alias("zero_iz"))
    one = C.one_based(cells(spark, sf)).groupBy("frame").agg(F.sum("iy").alias("one_iy"), F.sum("iz").alias("one_iz"))
    return zero.join(one, "frame")


@query("q50_snapshot_scalars", "SELECT p_partkey, round(p_retailprice / 100, 6) + 0.0 AS kx, 1 AS n_echoes, true AS one_echo FROM part")
def q50(spark: SparkSession, sf: str) -> DataFrame:
    stored = C.scalars(C.cycles_per_cm(table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("kx"))))
    return stored.select("p_partkey", settled(F.col("kx")).alias("kx"), "n_echoes", F.col("te_degre").isNull().alias("one_echo"))


_UP = "(ceil(({t}) / 4.0 - 1e-9) * 4.0)"
_RISE, _FLAT, _FALL = (_UP.format(t=t) for t in ("l_linenumber * 3.0 + 1", "l_quantity", "l_linenumber"))


@query(
    "q51_area_on_raster",
    f"""WITH t AS (SELECT l_returnflag, l_discount * 100 AS a, {_RISE} AS r, {_FLAT} AS f, {_FALL} AS d, l_discount * 100 * (l_quantity + (l_linenumber * 3.0 + 1 + l_linenumber) / 2) AS area FROM lineitem)
SELECT l_returnflag, round(sum(CASE WHEN abs(area) > 1e-6 THEN area / (f + (r + d) / 2) ELSE a END), 3) + 0.0 AS amplitude, sum(r) AS rise, sum(f) AS flat, sum(d) AS fall FROM t GROUP BY l_returnflag""",
)
def q51(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber").cast("double")
    shaped = table(spark, sf, "lineitem").select("l_returnflag", P.area_preserving(F.col("l_discount") * 100, n * 3.0 + 1, F.col("l_quantity"), n, 4.0).alias("g"))
    return shaped.groupBy("l_returnflag").agg(settled(F.sum("g.amplitude"), 3).alias("amplitude"), F.sum("g.rise").alias("rise"), F.sum("g.flat").alias("flat"), F.sum("g.fall").alias("fall"))


@query(
    "q52_padding_and_angles",
    """SELECT p_partkey, CASE WHEN p_retailprice - p_size * 50.0 > 0 THEN floor((p_retailprice - p_size * 50.0) / 4.0 + 1e-9) * 4.0 ELSE 0.0 END AS delay, p_retailprice - p_size * 50.0 >= -1e-9 AS feasible,
round(degrees(acos(exp(-(p_size * 0.01) / 1.5))), 6) + 0.0 AS flip, round((p_size - 60 / 2.0) / 60 * 2.0, 6) + 0.0 AS encode FROM part""",
)
def q52(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    parts = table(spark, sf, "part").withColumn("pad", P.padding(F.col("p_retailprice"), size * 50.0, 4.0))
    return parts.select("p_partkey", "pad.delay", "pad.feasible", settled(P.ernst_angle(size * 0.01, F.lit(1.5))).alias("flip"), settled(P.phase_encode(size, 60)).alias("encode"))


@query("q53_peak_b1", "SELECT vec_id, round(list_max(list_transform(range(32), lambda k: sqrt(embedding[k + 1]::DOUBLE * embedding[k + 1]::DOUBLE + embedding[k + 33]::DOUBLE * embedding[k + 33]::DOUBLE))) / 42.576 * 1e4, 6) + 0.0 AS b1 FROM embeddings")
def q53(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", settled(P.peak_b1(F.slice(x, 1, 32), F.slice(x, 33, 32), 42.576)).alias("b1"))


@query(
    "q54_block_kinds",
    """WITH b AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 END AS rf, CASE WHEN l_linenumber % 2 = 0 THEN 1 END AS gx, CASE WHEN l_linenumber % 3 = 0 THEN 1 END AS gy, CASE WHEN l_linestatus = 'O' THEN 1 END AS adc, CASE WHEN l_linenumber = 1 THEN 1 END AS label, CASE WHEN l_tax > 0.07 THEN 'physio1' WHEN l_tax > 0.06 THEN 'other' END AS trig FROM lineitem)
SELECT rf IS NULL AND gx IS NULL AND gy IS NULL AND adc IS NULL AND trig IS NULL AS pure_delay, rf IS NOT NULL AS has_rf, adc IS NOT NULL AS has_adc, label IS NOT NULL AS has_label, coalesce(trig = 'physio1', false) AS is_trigger, count(*) AS n FROM b GROUP BY ALL""",
)
def q54(spark: SparkSession, sf: str) -> DataFrame:
    when = lambda c: F.when(c, F.lit(1))
    n, tax = F.col("l_linenumber"), F.col("l_tax")
    trigger = F.when(tax > 0.07, F.lit("physio1")).when(tax > 0.06, F.lit("other"))
    kind = E.block_kind(when(F.col("l_returnflag") == "R"), [when(n % 2 == 0), when(n % 3 == 0)], when(F.col("l_linestatus") == "O"), when(n == 1), trigger)
    flags = table(spark, sf, "lineitem").select(kind.alias("k")).select("k.pure_delay", "k.has_rf", "k.has_adc", "k.has_label", F.coalesce("k.is_trigger", F.lit(False)).alias("is_trigger"))
    return flags.groupBy(*flags.columns).agg(F.count("*").alias("n"))


@query("q55_block_energies", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * 0.5, 6) + 0.0 AS sampled, round(embedding[1]::DOUBLE * embedding[1]::DOUBLE * (label / 3.0 + 2.0 + (label + 1) / 3.0), 6) + 0.0 AS trapezoid FROM embeddings")
def q55(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    energy = E.trap_energy(F.get(x, 0), F.col("label"), F.lit(2.0), F.col("label") + 1)
    return table(spark, sf, "embeddings").select("vec_id", settled(E.samples_energy(x, F.lit(0.5))).alias("sampled"), settled(energy).alias("trapezoid"))


@query(
    "q56_tolerant_parents",
    """WITH g AS (SELECT l_returnflag AS kind, l_discount AS duration, min(l_orderkey) AS n0, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.kind, a.duration, max(a.n) AS n, min(b.n0) AS parent_n FROM g a JOIN g b ON a.kind = b.kind AND abs(a.duration - b.duration) < 0.015 GROUP BY 1, 2""",
)
def q56(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("duration"), F.col("l_orderkey").alias("n"))
    return E.tolerant_parents(blocks, "kind", tolerance=0.015).groupBy("kind", "duration", "parent_n").agg(F.count("*").alias("n"))


_BLIP_SQL = f"{_SCHED_SQL}, b AS (SELECT *, lead(iy) OVER w - iy AS dy, lead(iz) OVER w - iz AS dz FROM sched WINDOW w AS (PARTITION BY frame, shot ORDER BY echo))"


@query("q57_weighted_steps", f"WITH {_BLIP_SQL} SELECT frame, shot, round(max(greatest(abs(dy) * 1.0, abs(dz) * 2.3)), 6) + 0.0 AS longest FROM b WHERE dy IS NOT NULL GROUP BY frame, shot")
def q57(spark: SparkSession, sf: str) -> DataFrame:
    step = S.weighted_step(F.col("dy"), F.col("dz"), 1.0, 2.3)
    return S.blips(schedule(spark, sf)).where("dy IS NOT NULL").groupBy("frame", "shot").agg(settled(F.max(step)).alias("longest"))


@query("q58_max_steps", f"WITH {_BLIP_SQL} SELECT coalesce(max(abs(dy)), 0)::INT AS max_dy, coalesce(max(abs(dz)), 0)::INT AS max_dz FROM b")
def q58(spark: SparkSession, sf: str) -> DataFrame:
    return S.max_steps(schedule(spark, sf))


@query("q59_sample_counts", f"WITH {CELLS_SQL} SELECT frame, count(*) FILTER (WHERE iy % 2 = 0) AS samples, count(*) FILTER (WHERE iy % 2 = 0) = 60 * 12 AS ok FROM cells GROUP BY frame")
def q59(spark: SparkSession, sf: str) -> DataFrame:
    return S.count_check(cells(spark, sf).withColumn("sampled", F.col("iy") % 2 == 0), 60, 12)


@query(
    "q60_schedule_difference",
    f"""WITH {_SCHED_SQL}, a AS (SELECT iy, iz FROM sched WHERE echo < 8), b AS (SELECT iy, iz FROM sched WHERE echo >= 4)
SELECT side, count(*) AS n, sum(iy * 100 + iz)::BIGINT AS checksum FROM (SELECT *, 'left' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT ALL FROM a)) GROUP BY side""",
)
def q60(spark: SparkSession, sf: str) -> DataFrame:
    plan = schedule(spark, sf)
    a, b = plan.where("echo < 8").select("iy", "iz"), plan.where("echo >= 4").select("iy", "iz")
    return S.set_difference(a, b).groupBy("side").agg(F.count("*").alias("n"), F.sum(F.col("iy") * 100 + F.col("iz")).alias("checksum"))


@query("q61_second_difference", f"WITH {ACQ_SQL}, d AS (SELECT channel, i, lead(value) OVER w - 2 * value + lag(value) OVER w AS d2 FROM acq WINDOW w AS (PARTITION BY channel ORDER BY i)) SELECT channel, i, round(d2, 6) + 0.0 AS d2 FROM d WHERE d2 IS NOT NULL")
def q61(spark: SparkSession, sf: str) -> DataFrame:
    return G.second_difference(acquisitions(spark, sf), ["channel"], ["i"], "value").where("d2 IS NOT NULL").select("channel", F.col("i").cast("long").alias("i"), settled(F.col("d2")).alias("d2"))


@query("q62_middle_reference", f"WITH {ACQ_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM acq) SELECT a.channel, a.i, round(a.value - b.value, 6) + 0.0 AS centered FROM m a JOIN m b ON a.channel = b.channel AND b.i = (b.n - 1) // 2")
def q62(spark: SparkSession, sf: str) -> DataFrame:
    return G.middle_reference(acquisitions(spark, sf), ["channel"], ["i"], "value").select("channel", F.col("i").cast("long").alias("i"), settled(F.col("centered")).alias("centered"))


@query("q63_scheduled_samples", f"WITH {ACQ_SQL}, {_SCHED_SQL} SELECT s.frame, s.iy, s.iz, round(sum(a.value), 6) + 0.0 AS total FROM acq a JOIN sched s ON s.frame = a.channel AND s.shot = a.i // 16 AND s.echo = a.i % 16 GROUP BY 1, 2, 3")
def q63(spark: SparkSession, sf: str) -> DataFrame:
    samples = acquisitions(spark, sf).select(F.col("channel").alias("frame"), F.floor(F.col("i") / 16).alias("shot"), (F.col("i") % 16).cast("long").alias("echo"), "value")
    return R.pair_with_schedule(samples, schedule(spark, sf)).groupBy("frame", "iy", "iz").agg(settled(F.sum("value")).alias("total"))


@query(
    "q64_masked_and_cropped",
    f"""WITH m AS (SELECT l_linenumber AS ix, (l_partkey % {NY})::INT AS iy, (l_suppkey % {NZ})::INT AS iz, sum(l_quantity) AS re, sum(l_quantity * 2) AS im, max(l_discount) > 0.05 AS keep FROM lineitem GROUP BY 1, 2, 3)
SELECT ix, min(iy) - 70 AS least_iy, max(iy) - 70 AS most_iy, count(*) AS n, sum(CASE WHEN keep THEN re ELSE 0 END) AS re, sum(CASE WHEN keep THEN im ELSE 0 END) AS im FROM m WHERE iy >= 70 AND iy < 170 GROUP BY ix""",
)
def q64(spark: SparkSession, sf: str) -> DataFrame:
    place = [F.col("l_linenumber").alias("ix"), (F.col("l_partkey") % NY).cast("int").alias("iy"), (F.col("l_suppkey") % NZ).cast("int").alias("iz")]
    lines = table(spark, sf, "lineitem").select(*place, "l_quantity", "l_discount")
    maps = lines.groupBy("ix", "iy", "iz").agg(F.sum("l_quantity").alias("re"), F.sum(F.col("l_quantity") * 2).alias("im"))
    eigen = lines.groupBy("ix", "iy", "iz").agg(F.max("l_discount").alias("ev"))
    middle = R.cropped(R.masked_maps(maps, eigen, 0.05), "iy", NY, 100)
    return middle.groupBy("ix").agg(F.min("iy").alias("least_iy"), F.max("iy").alias("most_iy"), F.count("*").alias("n"), F.sum("re").alias("re"), F.sum("im").alias("im"))


_DENSE_SQL = "t AS (SELECT (p_partkey % 2)::INT AS parity, p_partkey // 2 AS i, p_size * 0.01 AS kx FROM part), s AS (SELECT *, coalesce(abs(lead(kx) OVER (PARTITION BY parity ORDER BY i) - kx), 0.0) AS step FROM t), dense AS (SELECT parity, i, kx, step / max(step) OVER (PARTITION BY parity) AS w FROM s)"


def _trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select((F.col("p_partkey") % 2).cast("int").alias("parity"), F.floor(F.col("p_partkey") / 2).alias("i"), (F.col("p_size") * 0.01).alias("kx"))


@query("q65_density_compensation", f"WITH {_DENSE_SQL} SELECT parity, i, round(w, 6) + 0.0 AS w FROM dense")
def q65(spark: SparkSession, sf: str) -> DataFrame:
    return R.density_compensation(_trajectory(spark, sf)).select("parity", "i", settled(F.col("w")).alias("w"))


_FOV, _NX = 21.6, 8


@query(
    "q66_gridded_readouts",
    f"""WITH {ACQ_SQL}, {_DENSE_SQL}, g AS (SELECT parity, i, ix, w / sum(w) OVER (PARTITION BY parity, ix) AS w, 2 * pi() * kx * ((ix - {_NX / 2}) * {_FOV / _NX}) AS a FROM dense, range({_NX}) AS r(ix)),
m AS (SELECT channel, i // 16 AS echo, i % 16 AS i, value AS re, value * 0.5 AS im FROM acq)
SELECT m.channel, m.echo, g.ix::INT AS ix, round(sum(re * w * cos(a) - im * w * sin(a)), 6) + 0.0 AS re, round(sum(re * w * sin(a) + im * w * cos(a)), 6) + 0.0 AS im FROM m JOIN g ON g.i = m.i AND g.parity = m.echo % 2 GROUP BY 1, 2, 3""",
)
def q66(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    samples = acquisitions(spark, sf).select("channel", F.floor(F.col("i") / 16).alias("echo"), (F.col("i") % 16).cast("long").alias("i"), value.alias("re"), (value * 0.5).alias("im"))
    # Sixteen places a parity meet the readouts, so only their weights travel.
    weights = R.gridding_weights(_trajectory(spark, sf), _NX, _FOV).where("i < 16")
    lines = R.grid_readouts(samples, weights, ["channel", "echo"])
    return lines.select("channel", "echo", "ix", settled(F.col("re")).alias("re"), settled(F.col("im")).alias("im"))


@query(
    "q67_phase_correction",
    f"""WITH {ACQ_SQL}, s AS (SELECT channel, i, value, CASE WHEN (i // 16) % 2 = 1 THEN -(0.3 + 0.7 * (i % 16 - 8.0 + 0.5) / 16) ELSE 0.0 END AS t FROM acq)
SELECT channel, i, round(value * cos(t) - value * 0.5 * sin(t), 6) + 0.0 AS re, round(value * sin(t) + value * 0.5 * cos(t), 6) + 0.0 AS im FROM s""",
)
def q67(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    lines = acquisitions(spark, sf).select("channel", F.col("i").cast("long").alias("i"), F.floor(F.col("i") / 16).alias("echo"), (F.col("i") % 16).alias("ix"), value.alias("re"), (value * 0.5).alias("im"))
    return R.phase_corrected(lines, 16, 0.3, 0.7).select("channel", "i", settled(F.col("re")).alias("re"), settled(F.col("im")).alias("im"))


@query("q68_wrap_counts", f"WITH {ACQ_SQL}, d AS (SELECT channel, abs(value * 0.2 - lag(value * 0.2) OVER (PARTITION BY channel ORDER BY i)) AS d FROM acq) SELECT channel, count(*) FILTER (WHERE d > pi()) AS wrap_count FROM d GROUP BY channel")
def q68(spark: SparkSession, sf: str) -> DataFrame:
    return R.wrap_counts(acquisitions(spark, sf).withColumn("phase", F.col("value") * 0.2), ["channel"], ["i"], "phase")


@query("q69_rounded_away", "SELECT p_partkey, round(p_retailprice / 10.0 - 60)::BIGINT AS whole FROM part")
def q69(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", round_away(F.col("p_retailprice") / 10.0 - 60).alias("whole"))


@query("q70_mask_dispatch", f"WITH {CELLS_SQL} SELECT frame::INT AS frame, count(*) AS cells, count(*) FILTER (WHERE {_ticaipi_sql()}) AS samples, coalesce(sum(iy * 100 + iz) FILTER (WHERE {_ticaipi_sql()}), 0)::BIGINT AS checksum FROM cells WHERE frame < {ACCEL} GROUP BY frame")
def q70(spark: SparkSession, sf: str) -> DataFrame:
    """Of the points that occur, those that the dispatched mask samples."""
    mask = L.sampling_masks(spark, "ticaipi", NY, NZ, ACCEL, ACCEL).select(F.col("frame").cast("int").alias("frame"), "iy", "iz", "sampled")
    seen = cells(spark, sf).select(F.col("frame").cast("int").alias("frame"), "iy", "iz").join(mask, ["frame", "iy", "iz"])
    return seen.groupBy("frame").agg(F.count("*").alias("cells"), F.count_if("sampled").alias("samples"), F.sum(F.when(F.col("sampled"), F.col("iy") * 100 + F.col("iz")).otherwise(0)).cast("long").alias("checksum"))


_ECHO_LIMITS = [(0, 400.0, 900.0), (1, 250.0, 310.0), (2, 510.0, 1200.0)]
_ECHO_BANDS_SQL = "bands AS (SELECT band, axis, 1 / (2e-6 * long) AS lo, 1 / (2e-6 * short) AS hi FROM (VALUES " + ", ".join(f"({k}, {a}, {s}::DOUBLE, {g}::DOUBLE)" for k, (a, s, g) in enumerate(_ECHO_LIMITS)) + ") AS t(band, axis, short, long))"


@query("q71_acoustic_bands", f"WITH {_ECHO_BANDS_SQL} SELECT band::INT AS band, axis::INT AS axis, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, count(value) AS inside, round(coalesce(max(value), 0), 6) + 0.0 AS peak FROM bands LEFT JOIN events ON value * 20 BETWEEN lo AND hi GROUP BY ALL")
def q71(spark: SparkSession, sf: str) -> DataFrame:
    """The bands of the echo limits, and the readings inside them; a reading may lie in several."""
    bands = P.acoustic_bands(spark, _ECHO_LIMITS)
    met = table(spark, sf, "events").select("value", (F.col("value") * 20).alias("hz")).join(F.broadcast(bands), F.col("hz").between(F.col("lo"), F.col("hi")))  # three bands
    inside = met.groupBy("band").agg(F.count("value").alias("inside"), F.max("value").alias("peak"))
    return bands.join(inside, "band", "left").select("band", "axis", settled(F.col("lo")).alias("lo"), settled(F.col("hi")).alias("hi"), F.coalesce("inside", F.lit(0)).cast("long").alias("inside"), settled(F.coalesce("peak", F.lit(0.0))).alias("peak"))


@query("q72_event_windows", "SELECT floor(epoch(ts) / 300)::BIGINT * 300 AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def q72(spark: SparkSession, sf: str) -> DataFrame:
    return event_windows(table(spark, sf, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", settled(F.col("total"), 4).alias("total"))


@query("q73_entry_listing", "SELECT (o_custkey % 10000)::INT AS entry, count(*) AS files, max(o_orderkey + 0.5)::DOUBLE AS newest FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def q73(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.when(key % 3 == 0, F.lit(".bak")).otherwise(F.lit(".entry"))
    lines = table(spark, sf, "orders").select(F.concat(key.cast("string"), F.lit(".5 some/where/pge"), (F.col("o_custkey") % K.CAPACITY).cast("string"), name).alias("value"))
    return K.parse_entries(lines).groupBy("entry").agg(F.count("*").alias("files"), F.max("mtime").alias("newest"))


@query(
    "q74_reused_entries",
    """WITH runs AS (SELECT p_partkey::INT AS entry, 'file ' || p_partkey AS basename FROM part WHERE p_partkey % 4 <> 0), files AS (SELECT 'file ' || s_suppkey * 2 AS basename FROM supplier)
SELECT basename, coalesce(entry, -1) AS entry, entry IS NOT NULL AS reused FROM files LEFT JOIN runs USING (basename)""",
)
def q74(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    lines = table(spark, sf, "part").select(F.when(key % 4 == 0, F.concat(F.lit("file "), key.cast("string"))).otherwise(F.concat(key.cast("string"), F.lit(" file "), key.cast("string"))).alias("value"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("file "), (F.col("s_suppkey") * 2).cast("string")).alias("basename"))
    known, new = K.split_reused(files, K.parse_runs(lines))
    return known.select("basename", "entry", F.lit(True).alias("reused")).unionByName(new.select("basename", F.lit(-1).alias("entry"), F.lit(False).alias("reused")))


_CAND_SQL = f"{_OLD_SQL}, c AS (SELECT entry, tier, row_number() OVER (ORDER BY tier, mtime, entry) AS rank FROM (SELECT n::INT AS entry, 0 AS tier, 0.0::DOUBLE AS mtime FROM range(10000) AS t(n) WHERE n NOT IN (SELECT entry FROM used) UNION ALL SELECT entry, 1, mtime FROM used))"


def _used(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % K.CAPACITY).cast("int").alias("entry")).agg(F.max(seconds).alias("mtime"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """The suppliers as files in order (their keys run from 1, or 0)."""
    return table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).cast("int").alias("place"), F.concat(F.lit("loop"), F.col("s_suppkey").cast("string")).alias("basename"))


@query("q75_entry_assignment", f"WITH {_CAND_SQL} SELECT 'loop' || s_suppkey AS basename, entry, CASE WHEN tier = 0 THEN 'new' ELSE 'replaces' END AS how, '1' || chr(10) || 'dir/loop' || s_suppkey || chr(10) AS content FROM supplier JOIN c ON rank = s_suppkey + 1")
def q75(spark: SparkSession, sf: str) -> DataFrame:
    assigned = K.allocate(_files(spark, sf), _used(spark, sf))
    content = assigned.select("entry", K.entry_text(F.concat(F.lit("dir/"), F.col("basename"))).alias("content"))
    return K.assignment_report(assigned).join(content, "entry").select("basename", "entry", "how", "content")


@query(
    "q76_spare_entries",
    f"""WITH {_CAND_SQL}, taken AS (SELECT DISTINCT (p_partkey * 3 % 10000)::INT AS entry FROM part), w AS (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM c WHERE rank <= 50 AND entry NOT IN (SELECT entry FROM taken))
SELECT 'wanted' AS part, entry, rank::INT AS rank FROM c WHERE rank <= 25 UNION ALL SELECT 'spare', entry, rank::INT FROM c WHERE rank > 25 AND rank <= 50 UNION ALL SELECT 'claimed', entry, rank::INT FROM w WHERE k <= 20""",
)
def q76(spark: SparkSession, sf: str) -> DataFrame:
    wanted, spare = K.padded(_used(spark, sf), 25)
    taken = table(spark, sf, "part").select((F.col("p_partkey") * 3 % K.CAPACITY).cast("int").alias("entry")).distinct()
    claimed = K.claim(wanted.unionByName(spare), taken, 20)
    sets = [x.select(F.lit(name).alias("part"), "entry", F.col("rank").cast("int").alias("rank")) for name, x in (("wanted", wanted), ("spare", spare), ("claimed", claimed))]
    return sets[0].unionByName(sets[1]).unionByName(sets[2])


@query("q77_realised_slew_by_join", "WITH t AS (SELECT p_partkey AS parent, greatest(1.0 / p_size, 1.0 / (p_size + 2.0)) AS unit FROM part) SELECT round(max(unit * abs(l_extendedprice)), 4) + 0.0 AS max_slew FROM lineitem JOIN t ON parent = l_partkey WHERE l_partkey >= 1")
def q77(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "part").select(F.col("p_partkey").alias("parent_id"), E.unit_slew(F.col("p_size"), F.col("p_size") + 2.0).alias("unit"))
    loop = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("parent_id"), "l_extendedprice")
    return E.realised_slew(loop, parents, "parent_id", F.col("l_extendedprice"), "unit").select(settled(F.col("max_slew"), 4).alias("max_slew"))


@query("q78_plain_difference", f"WITH {ACQ_SQL}, d AS (SELECT channel, i, value - lag(value) OVER (PARTITION BY channel ORDER BY i) AS d FROM acq) SELECT channel, i, round(d, 6) + 0.0 AS d FROM d WHERE d IS NOT NULL")
def q78(spark: SparkSession, sf: str) -> DataFrame:
    return G.difference(acquisitions(spark, sf), ["channel"], ["i"], "value").where("d IS NOT NULL").select("channel", F.col("i").cast("long").alias("i"), settled(F.col("d")).alias("d"))
