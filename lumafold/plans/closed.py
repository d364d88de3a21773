"""Queries on solvers, orders and channel matrices whose exact answer SQL finds another way: by small linear systems, recursion or a full search."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumafold.functions.columns import settled
from lumafold.operators import coils, lattice, ordering, pipeline, recon, schedule, volumes
from lumafold.plans.masks import _RANK_SQL, _SCHED_SQL, _THETA, _WEDGE, ACCEL, ETL, _caipi_sql, query_set
from lumafold.plans.masks import schedule as event_schedule
from lumafold.plans.views import CELLS_SQL, COIL_SQL, NY, NZ, cells, coil_samples
from lumafold.session import shared_folder, table
from lumafold.sources import images

QUERIES, ORACLES, query = query_set()
SCALE = (1.0, 2.3)

# ---- solvers -------------------------------------------------------------------------------------------------------

#: Channel views of an 8 x 8 image for each label: eight vectors of a label, averaged over ids modulo 8, give 4 channels of 64 places.
_VIEWS_SQL = f"""{COIL_SQL}, flat AS (SELECT frame::INT AS frame, (sample % 8) * 32 + coil AS p, avg(re) AS re, avg(im) AS im FROM coilvec GROUP BY 1, 2),
views AS (SELECT frame, (p // 64)::INT AS c, (p % 8)::INT AS ix, ((p // 8) % 8)::INT AS iy, re, im FROM flat)"""
_CORNERS = ((0.0, 0.0), (7.0, 0.0), (0.0, 7.0), (7.0, 7.0))
_CORNERS_SQL = "corners AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(_CORNERS)) + ") AS t(c, cx, cy))"


def _views(spark: SparkSession, sf: str) -> DataFrame:
    flat = coil_samples(spark, sf).groupBy(F.col("frame").cast("int").alias("frame"), ((F.col("sample") % 8) * 32 + F.col("coil")).cast("int").alias("p")).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return flat.select("frame", F.floor(F.col("p") / 64).cast("int").alias("coil"), (F.col("p") % 8).alias("ix"), F.floor(F.col("p") / 8 % 8).cast("int").alias("iy"), F.lit(0).alias("iz"), "re", "im")


def _corner_maps(spark: SparkSession) -> DataFrame:
    """Sensitivities of four Gaussian channels at the corners."""
    places = spark.range(256).select(F.floor(F.col("id") / 64).cast("int").alias("coil"), (F.col("id") % 8).cast("int").alias("ix"), F.floor(F.col("id") / 8 % 8).cast("int").alias("iy"), F.lit(0).alias("iz"))
    cx, cy = (F.get(F.array(*[F.lit(c[a]) for c in _CORNERS]), F.col("coil")) for a in (0, 1))
    return places.select("coil", "ix", "iy", "iz", F.exp(-((F.col("ix") - cx) * (F.col("ix") - cx) + (F.col("iy") - cy) * (F.col("iy") - cy)) / 72.0).alias("re"), F.lit(0.0).alias("im"))


@query(
    "q90_sense_half_sampled",
    f"""WITH {_VIEWS_SQL}, {_CORNERS_SQL}, grid AS (SELECT f.frame, c, x, y, cx, cy FROM (SELECT DISTINCT frame FROM views) f, corners, range(4) AS a(x), range(8) AS b(y)),
s AS (SELECT frame, c, x, y, exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / 72.0) AS s1, exp(-((x + 4 - cx) * (x + 4 - cx) + (y - cy) * (y - cy)) / 72.0) AS s2 FROM grid),
m AS (SELECT s.*, coalesce(u.re, 0) + coalesce(v.re, 0) AS ar, coalesce(u.im, 0) + coalesce(v.im, 0) AS ai FROM s LEFT JOIN views u ON u.frame = s.frame AND u.c = s.c AND u.ix = x AND u.iy = y LEFT JOIN views v ON v.frame = s.frame AND v.c = s.c AND v.ix = x + 4 AND v.iy = y),
g AS (SELECT frame, x, y, sum(s1 * s1) AS a, sum(s1 * s2) AS b, sum(s2 * s2) AS d, sum(s1 * ar) AS pr, sum(s1 * ai) AS pi, sum(s2 * ar) AS qr, sum(s2 * ai) AS qi FROM m GROUP BY frame, x, y),
o AS (SELECT frame, x AS ix, y AS iy, (d * pr - b * qr) / (a * d - b * b) AS re, (d * pi - b * qi) / (a * d - b * b) AS im FROM g UNION ALL SELECT frame, x + 4, y, (a * qr - b * pr) / (a * d - b * b), (a * qi - b * pi) / (a * d - b * b) FROM g)
SELECT frame, ix::INT AS ix, iy::INT AS iy, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im, 'ok' AS status FROM o""",
)
def q90(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares from every other line of measured (inconsistent) channel views: places x and x + 4 fold together, so each pair is a system of two unknowns in SQL."""

    def solve(views: np.ndarray, sens: np.ndarray) -> np.ndarray:
        kspace = recon.fftc(views, (0, 1, 2))
        kspace[1::2] = 0
        return recon.cg_sense(kspace, sens, 300, 1e-12)

    solved = recon.frame_map(_views(spark, sf), _corner_maps(spark), (8, 8, 1), 4, solve)
    return solved.select("frame", "ix", "iy", settled(F.col("re"), 4).alias("re"), settled(F.col("im"), 4).alias("im"), "status")


@query(
    "q95_rss_images",
    f"""WITH {COIL_SQL}, k AS (SELECT frame::INT AS frame, sample % 4 AS c, coil % 8 AS kx, coil // 8 AS ky, avg(re) AS re, avg(im) AS im FROM coilvec GROUP BY 1, 2, 3, 4),
t AS (SELECT frame, c, ix, iy, re, im, 2 * pi() * ((kx - 4) * (ix - 4) / 8.0 + (ky - 2) * (iy - 2) / 4.0) AS w FROM k, range(8) AS a(ix), range(4) AS b(iy)),
x AS (SELECT frame, c, ix, iy, sum(re * cos(w) - im * sin(w)) / 32 AS re, sum(re * sin(w) + im * cos(w)) / 32 AS im FROM t GROUP BY ALL)
SELECT frame, ix::INT AS ix, iy::INT AS iy, round(sqrt(sum(re * re + im * im)), 6) + 0.0 AS rss FROM x GROUP BY frame, ix, iy""",
)
def q95(spark: SparkSession, sf: str) -> DataFrame:
    """Root of the sum of squares of 8 x 4 images, a frame for each label; a vector's channels are places in k-space."""
    mean = coil_samples(spark, sf).groupBy(F.col("frame").cast("int").alias("frame"), (F.col("sample") % 4).cast("int").alias("c"), "coil").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    kspace = mean.select("frame", (F.col("coil") % 8).alias("ix"), F.floor(F.col("coil") / 8).cast("int").alias("iy"), F.lit(0).alias("iz"), F.col("c").alias("coil"), "re", "im")
    return pipeline.reconstruct(kspace, None, (8, 4, 1), 4, "rss").select("frame", "ix", "iy", settled(F.col("re")).alias("rss"))


@query(
    "q99_packed_blocks",
    f"WITH {_VIEWS_SQL} SELECT frame, c AS coil, count(*) AS voxels, round(sum(re), 6) + 0.0 AS re, round(sum(im), 6) + 0.0 AS im, sum(8 * ix + iy)::BIGINT AS places FROM views GROUP BY frame, c",
)
def q99(spark: SparkSession, sf: str) -> DataFrame:
    """What the packed blocks of each frame and channel hold, read back from their bytes."""

    def opened(batches):
        for batch in batches:
            places = [np.frombuffer(p, "<i4").reshape(-1, 3).astype(np.int64) for p in batch.column(2).to_pylist()]
            data = [np.frombuffer(d, "<c16").sum() for d in batch.column(3).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([len(p) for p in places], pa.int64()), pa.array([z.real for z in data], pa.float64()), pa.array([z.imag for z in data], pa.float64()), pa.array([int((8 * p[:, 0] + p[:, 1]).sum()) for p in places], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["frame", "coil", "n", "re", "im", "at"])

    rows = volumes.packed(_views(spark, sf)).mapInArrow(opened, "frame int, coil int, n long, re double, im double, at long")
    return rows.groupBy("frame", "coil").agg(F.sum("n").alias("voxels"), settled(F.sum("re")).alias("re"), settled(F.sum("im")).alias("im"), F.sum("at").alias("places"))


# ---- channel matrices ------------------------------------------------------------------------------------------------

#: Every vector as 16 samples of two channels, whose matrices SQL can invert and decompose.
_TWO_SQL = f"""{COIL_SQL}, two AS (SELECT sample * 16 + coil // 2 AS sample, max(re) FILTER (WHERE coil % 2 = 0) AS r0, max(im) FILTER (WHERE coil % 2 = 0) AS i0, max(re) FILTER (WHERE coil % 2 = 1) AS r1, max(im) FILTER (WHERE coil % 2 = 1) AS i1 FROM coilvec GROUP BY 1),
g AS (SELECT avg(r0 * r0 + i0 * i0) AS p, avg(r1 * r1 + i1 * i1) AS q, avg(r0 * r1 + i0 * i1) AS gr, avg(r0 * i1 - i0 * r1) AS gi FROM two)"""


def _two_channels(spark: SparkSession, sf: str) -> DataFrame:
    return coil_samples(spark, sf).select((F.col("sample") * 16 + F.floor(F.col("coil") / 2)).alias("sample"), (F.col("coil") % 2).alias("coil"), "re", "im")


@query(
    "q93_whitened_channels",
    f"""WITH {_TWO_SQL}, l AS (SELECT *, sqrt(q - (gr * gr + gi * gi) / p) AS low FROM g)
SELECT sample, 0 AS coil, round(r0 / sqrt(p), 5) + 0.0 AS re, round(i0 / sqrt(p), 5) + 0.0 AS im FROM two, l
UNION ALL SELECT sample, 1, round((r1 - (r0 * gr - i0 * gi) / p) / low, 5) + 0.0, round((i1 - (r0 * gi + i0 * gr) / p) / low, 5) + 0.0 FROM two, l""",
)
def q93(spark: SparkSession, sf: str) -> DataFrame:
    """Samples behind the inverse Cholesky factor of their own Gram matrix."""
    samples = _two_channels(spark, sf)
    return coils.mixed(samples, coils.whitening(samples), conjugate=True).select("sample", "coil", settled(F.col("re"), 5).alias("re"), settled(F.col("im"), 5).alias("im"))


@query(
    "q94_principal_channel",
    f"""WITH {_TWO_SQL}, e AS (SELECT *, (p + q) / 2 + sqrt((p - q) * (p - q) / 4 + gr * gr + gi * gi) AS top, (p + q) / 2 - sqrt((p - q) * (p - q) / 4 + gr * gr + gi * gi) AS low FROM g)
SELECT sample, round(((p - low) * (r0 * r0 + i0 * i0) + (q - low) * (r1 * r1 + i1 * i1) + 2 * (gr * (r0 * r1 + i0 * i1) + gi * (r0 * i1 - i0 * r1))) / (top - low), 5) + 0.0 AS energy,
  CASE WHEN top / (top + low) >= 0.9 THEN 1 ELSE 2 END AS kept FROM two, e""",
)
def q94(spark: SparkSession, sf: str) -> DataFrame:
    """Each sample's energy in the leading channel, and how many channels nine tenths of all energy take."""
    samples = _two_channels(spark, sf)
    covariance = coils.matrix_of(coils.gram(samples, conjugate_first=False))
    lead = coils.mixed(samples, coils.compression(covariance, 1), conjugate=False)
    return lead.select("sample", settled(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 5).alias("energy"), F.lit(coils.channels_for_energy(covariance, 0.9, 1)).alias("kept"))


# ---- orders ----------------------------------------------------------------------------------------------------------

_PARTS_SQL = f"parts AS (SELECT *, ((row_number() OVER (PARTITION BY frame ORDER BY iz, {_RANK_SQL}) - 1) // {ETL} + 1)::INT AS part FROM cells)"
_KY, _KZ = SCALE


def _link(tail: str, head: str) -> str:
    return f"greatest((n.iy - r.iy) * {_KY}, abs(n.{head} - r.{tail}) * {_KZ})"


@query(
    "q91_row_direction_costs",
    f"""WITH RECURSIVE {CELLS_SQL}, {_PARTS_SQL}, lines AS (SELECT frame, part, iy, min(iz) AS lo, max(iz) AS hi, row_number() OVER (PARTITION BY frame, part ORDER BY iy) AS k, count(*) OVER (PARTITION BY frame, part) AS n FROM parts GROUP BY frame, part, iy),
r AS (SELECT frame, part, k, iy, lo, hi, n, 0.0::DOUBLE AS sf, 0.0::DOUBLE AS sb, 0.0::DOUBLE AS mf, 0.0::DOUBLE AS mb FROM lines WHERE k = 1
UNION ALL SELECT n.frame, n.part, n.k, n.iy, n.lo, n.hi, n.n,
  least(r.sf + {_link("hi", "lo")}, r.sb + {_link("lo", "lo")}), least(r.sf + {_link("hi", "hi")}, r.sb + {_link("lo", "hi")}),
  least(greatest(r.mf, {_link("hi", "lo")}), greatest(r.mb, {_link("lo", "lo")})), least(greatest(r.mf, {_link("hi", "hi")}), greatest(r.mb, {_link("lo", "hi")}))
  FROM r JOIN lines n ON n.frame = r.frame AND n.part = r.part AND n.k = r.k + 1)
SELECT frame, part, n::INT AS lines, round(least(sf, sb), 6) + 0.0 AS least_sum, round(least(mf, mb), 6) + 0.0 AS least_longest FROM r WHERE k = n""",
)
def q91(spark: SparkSession, sf: str) -> DataFrame:
    """The least sum and the least longest link that sweep directions of each part's rows can reach."""

    def best(key: tuple, rows: pa.Table) -> pa.Table:
        y, z = rows["iy"].to_numpy(), rows["iz"].to_numpy()
        lines = sorted(set(y.tolist()))
        columns = [sorted(z[y == r].tolist()) for r in lines]
        found = []
        for objective, total in (("sum", sum), ("max", max)):
            links = ordering.row_links(lines, columns, ordering.row_directions(lines, columns, SCALE, objective), SCALE)
            found.append(float(total(links)) if links else 0.0)
        return pa.table({"frame": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "lines": pa.array([len(lines)], pa.int32()), "least_sum": [found[0]], "least_longest": [found[1]]})

    parts = schedule.sequential_parts(cells(spark, sf), NY, ETL)
    costs = parts.groupBy("frame", "part").applyInArrow(best, "frame int, part int, lines int, least_sum double, least_longest double")
    return costs.select("frame", "part", "lines", settled(F.col("least_sum")).alias("least_sum"), settled(F.col("least_longest")).alias("least_longest"))


_GOLD = "fmod(t * pi() * (sqrt(5) - 1) / 2, pi())"


@query(
    "q92_radial_shots",
    f"""WITH RECURSIVE {CELLS_SQL}, {_THETA}, {_WEDGE}, c AS (SELECT frame, wedge, avg(theta) AS center, count(*) AS n, sum(iy * 64 + iz)::BIGINT AS checksum FROM wedges GROUP BY frame, wedge),
g AS (SELECT DISTINCT frame, 0 AS t, []::INT[] AS used FROM c
UNION ALL SELECT g.frame, g.t + 1, list_append(any_value(g.used), min(struct_pack(gap := least(abs(center - {_GOLD.replace("t *", "g.t *")}) % pi(), pi() - abs(center - {_GOLD.replace("t *", "g.t *")}) % pi()), w := wedge)).w)
  FROM g JOIN c ON c.frame = g.frame AND NOT list_contains(g.used, c.wedge) GROUP BY g.frame, g.t),
o AS (SELECT frame, t - 1 AS shot, used[t] AS wedge FROM g WHERE t > 0)
SELECT c.frame, o.shot::INT AS shot, c.n, c.checksum, true AS centred FROM o JOIN c ON c.frame = o.frame AND c.wedge = o.wedge""",
)
def q92(spark: SparkSession, sf: str) -> DataFrame:
    """Radial shots in golden-angle order: what each holds, and whether its nearest cell to the centre comes at the echo of TE."""
    plan = ordering.plan_schedule(cells(spark, sf), "radial", NY, NZ, ETL, SCALE)
    y, z = F.col("iy") - NY / 2.0, F.col("iz") - NZ / 2.0
    seen = plan.withColumn("d", y * y + z * z).groupBy("frame", "shot").agg(F.count("*").alias("n"), F.sum(F.col("iy") * 64 + F.col("iz")).alias("checksum"), F.min("d").alias("least"), F.collect_list(F.struct("echo", "d")).alias("at"))
    target = F.least(F.lit((ETL - 1) // 2), F.col("n") - 1)
    return seen.select("frame", "shot", "n", "checksum", F.exists("at", lambda s: (s["echo"] == target) & (s["d"] == F.col("least"))).alias("centred"))


@query(
    "q96_step_bounds",
    f"""WITH RECURSIVE {CELLS_SQL}, {_PARTS_SQL}, p AS (SELECT frame, part, row_number() OVER (PARTITION BY frame, part ORDER BY iy, iz) AS k, iy, iz FROM parts),
d AS (SELECT a.frame, a.part, a.k AS a, b.k AS b, greatest(abs(a.iy - b.iy) * {_KY}, abs(a.iz - b.iz) * {_KZ})::DOUBLE AS d FROM p a JOIN p b ON a.frame = b.frame AND a.part = b.part),
r AS (SELECT frame, part, k, CASE WHEN k = 1 THEN 0 ELSE 1e9 END::DOUBLE AS reach, 0 AS t FROM p
UNION ALL SELECT r.frame, r.part, d.b, min(greatest(r.reach, d.d)), r.t + 1 FROM r JOIN d ON d.frame = r.frame AND d.part = r.part AND d.a = r.k WHERE r.t < {ETL} GROUP BY r.frame, r.part, d.b, r.t),
s AS (SELECT frame, part, count(*) FILTER (WHERE a = b) AS n, sum(d) AS total, max(d) AS farthest FROM d GROUP BY frame, part)
SELECT s.frame, s.part, s.n, round(total, 4) + 0.0 AS total, round(farthest, 6) + 0.0 AS farthest, round(b.bottleneck, 6) + 0.0 AS bottleneck
FROM s JOIN (SELECT frame, part, max(reach) AS bottleneck FROM r WHERE t = {ETL} GROUP BY frame, part) b ON b.frame = s.frame AND b.part = s.part""",
)
def q96(spark: SparkSession, sf: str) -> DataFrame:
    """Steps between all cells of a part (at most 60), and the least longest step that any path through them must take."""

    def bounds(key: tuple, rows: pa.Table) -> pa.Table:
        d = ordering.step_lengths(np.column_stack([rows["iy"].to_numpy(), rows["iz"].to_numpy()]).astype(float), SCALE)
        return pa.table({"frame": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(d)], pa.int64()), "total": [float(d.sum())], "farthest": [float(d.max())], "bottleneck": [ordering.tree_bottleneck(d)]})

    parts = schedule.sequential_parts(cells(spark, sf), NY, ETL)
    found = parts.groupBy("frame", "part").applyInArrow(bounds, "frame int, part int, n long, total double, farthest double, bottleneck double")
    return found.select("frame", "part", "n", settled(F.col("total"), 4).alias("total"), settled(F.col("farthest")).alias("farthest"), settled(F.col("bottleneck")).alias("bottleneck"))


@query(
    "q98_laminar_shots",
    f"""WITH {CELLS_SQL}, {_PARTS_SQL} SELECT frame, part - 1 AS shot, count(*) AS n, sum(iy * 64 + iz)::BIGINT AS checksum, count(DISTINCT iy) AS lines, min(iy) AS first_line, max(iy) AS last_line, true AS in_turn, 0::BIGINT AS turns FROM parts GROUP BY frame, part""",
)
def q98(spark: SparkSession, sf: str) -> DataFrame:
    """Laminar shots: what each holds, that its rows come in turn, and how often the sweep turns inside a row."""
    plan = ordering.plan_schedule(cells(spark, sf), "laminar", NY, NZ, ETL, SCALE)
    w, line = Window.partitionBy("frame", "shot").orderBy("echo"), Window.partitionBy("frame", "shot", "iy").orderBy("echo")
    steps = plan.withColumns({"up": F.col("iy") - F.lag("iy").over(w), "way": F.signum(F.col("iz") - F.lag("iz").over(line))})
    turned = steps.withColumn("turned", (F.col("way") != F.lag("way").over(line)).cast("long"))
    whole = turned.groupBy("frame", "shot").agg(F.count("*").alias("n"), F.sum(F.col("iy") * 64 + F.col("iz")).alias("checksum"), F.countDistinct("iy").alias("lines"), F.min("iy").alias("low"), F.max("iy").alias("high"), F.min_by("iy", "echo").alias("first_line"), F.max_by("iy", "echo").alias("last_line"), F.every(F.coalesce(F.col("up"), F.lit(0)) >= 0).alias("in_turn"), F.coalesce(F.sum("turned"), F.lit(0)).alias("turns"))
    return whole.select("frame", "shot", "n", "checksum", "lines", "first_line", "last_line", "in_turn", "turns")


# ---- drivers, figures and stored images --------------------------------------------------------------------------------


@query("q100_overwritten_places", f"WITH {_SCHED_SQL} SELECT frame, (count(*) - count(DISTINCT iy * 64 + iz))::BIGINT AS duplicates FROM sched GROUP BY frame")
def q100(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of each frame's schedule that another one overwrites."""
    return pipeline.duplicate_places(event_schedule(spark, sf))


@query("q101_empty_frames", "SELECT (event_id // 8)::BIGINT AS frame FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase' AND value <> 0) = 0")
def q101(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of eight events whose image, the values of purchases, is zero everywhere."""
    events = table(spark, sf, "events")
    return pipeline.empty_frames(events.select(F.floor(F.col("event_id") / 8).alias("frame"), F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(F.lit(0.0)).alias("re"), F.lit(0.0).alias("im")))


@query("q102_stored_magnitudes", f"WITH {_VIEWS_SQL} SELECT frame, ix, iy, c AS iz, round(sqrt(re * re + im * im), 4) + 0.0 AS value FROM views")
def q102(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes stored by frame, one frame written twice, read back by name; then their magnitudes (held as 32-bit numbers)."""
    path = f"{shared_folder(spark)}/volumes-{uuid.uuid4().hex}"
    volume = _views(spark, sf).select("frame", "ix", "iy", F.col("coil").alias("iz"), "re", "im")
    images.write_volume(volume, path)
    images.write_volume(volume.where("frame = 1"), path)  # replaces its own partition only
    back = images.read_arrays(spark, path, ["frame", "ix", "iy", "iz", "re", "im"])
    return images.magnitude_image(back).select(F.col("frame").cast("int").alias("frame"), "ix", "iy", "iz", settled(F.col("value").cast("double"), 4).alias("value"))


@query("q103_mask_figures", f"WITH {CELLS_SQL} SELECT frame, round((iy - {NY / 2}) / 0.216, 6) + 0.0 AS ky, round((iz - {NZ / 2}) / 0.0405, 6) + 0.0 AS kz, {_caipi_sql('iy', 'iz')} AS sampled FROM cells")
def q103(spark: SparkSession, sf: str) -> DataFrame:
    """What a figure of each frame's mask shows: its cells in 1/m, and which of them a lattice samples."""
    mask = cells(spark, sf).withColumn("sampled", lattice.caipi(NY, NZ, ACCEL, F.col("iy"), F.col("iz")))
    frames = [r["frame"] for r in mask.select("frame").distinct().collect()]  # numbers of frames
    figures = [pipeline.mask_figure(mask, f, NY, NZ, 0.216, 0.0405).select(F.lit(f).alias("frame"), settled(F.col("ky")).alias("ky"), settled(F.col("kz")).alias("kz"), "sampled") for f in frames]
    return reduce(DataFrame.unionByName, figures)
