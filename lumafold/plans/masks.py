"""Queries on sampling masks and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumafold.functions.columns import settled
from lumafold.operators import lattice as L
from lumafold.operators import schedule as S
from lumafold.plans.views import CELLS_SQL, NY, NZ, acquisitions, cells
from lumafold.session import table

ACCEL = 9
ETL = 60


def query_set():
    """An empty pair of tables, and the decorator that registers a query in them with its SQL, if it has any."""
    queries, oracles = {}, {}

    def query(name: str, sql: str | None = None):
        def add(fn):
            queries[name] = fn
            if sql:
                oracles[name] = sql
            return fn

        return add

    return queries, oracles, query


QUERIES, ORACLES, query = query_set()


def _caipi_sql(iy: str, iz: str) -> str:
    ry, rz = L.balanced_factors(NY, NZ, ACCEL)
    roll = f"((floor(({iz}) / {rz})::BIGINT % {ry}) % {ry})"
    return f"(({iz}) % {rz} = 0 AND ((((({iy}) - {roll}) % {NY}) + {NY}) % {NY}) % {ry} = 0)"


def _ticaipi_sql() -> str:
    _, rz = L.balanced_factors(NY, NZ, ACCEL)
    c = f"(frame % {ACCEL})"
    return _caipi_sql(f"((iy - {c} // {rz}) % {NY} + {NY}) % {NY}", f"((iz - {c} % {rz}) % {NZ} + {NZ}) % {NZ}")


def _u_sql(seed: int, *ids: str) -> str:
    return f"(('0x' || substr(md5('{seed}' || " + " || ".join(f"':' || {i}" for i in ids) + "), 1, 8))::BIGINT / 4294967296.0)"


@query("q01_caipi_membership", f"WITH {CELLS_SQL} SELECT frame, count(*) AS n, count(*) FILTER (WHERE {_caipi_sql('iy', 'iz')}) AS hits FROM cells GROUP BY frame")
def q01(spark: SparkSession, sf: str) -> DataFrame:
    hit = L.caipi(NY, NZ, ACCEL, F.col("iy"), F.col("iz"))
    return cells(spark, sf).groupBy("frame").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))


@query("q02_temporal_caipi_coverage", f"WITH {CELLS_SQL}, f AS (SELECT DISTINCT iy, iz, t.frame AS frame FROM cells, range({ACCEL}) AS t(frame)) SELECT iy, iz, count(*) FILTER (WHERE {_ticaipi_sql()}) AS frames FROM f GROUP BY iy, iz HAVING count(*) FILTER (WHERE {_ticaipi_sql()}) > 0")
def q02(spark: SparkSession, sf: str) -> DataFrame:
    seen = cells(spark, sf).select("iy", "iz").distinct()
    frames = seen.select("iy", "iz", F.explode(F.sequence(F.lit(0), F.lit(ACCEL - 1))).alias("frame"))
    hit = L.temporal_caipi(NY, NZ, ACCEL, F.col("iy"), F.col("iz"), F.col("frame"))
    return L.coverage(frames.withColumn("sampled", hit))


_SY, _SZ = NY / 6, NZ / 6
_W_SQL = f"exp(-((iy - {(NY + 1) // 2 - 1})^2 / (2.0 * {_SY} * {_SY}) + (iz - {(NZ + 1) // 2 - 1})^2 / (2.0 * {_SZ} * {_SZ})))"


@query("q03_gaussian_density", f"WITH {CELLS_SQL} SELECT DISTINCT iy, iz, round({_W_SQL}, 9) + 0.0 AS w FROM cells")
def q03(spark: SparkSession, sf: str) -> DataFrame:
    seen = cells(spark, sf).select("iy", "iz").distinct()
    return L.gaussian_density(seen, NY, NZ, (_SY, _SZ)).select("iy", "iz", settled(F.col("w"), 9).alias("w"))


_RC = L.calibration_radius(NY, NZ, NY * NZ // ACCEL, 0.2)
_RHO_SQL = f"sqrt(((iy - {NY / 2}) / {NY / 2})^2 + ((iz - {NZ / 2}) / {NZ / 2})^2)"


@query("q04_elliptic_radius", f"WITH {CELLS_SQL} SELECT frame, count(*) AS n, count(*) FILTER (WHERE {_RHO_SQL} <= 1) AS inside, count(*) FILTER (WHERE {_RHO_SQL} <= {_RC!r}) AS calib, round(avg({_RHO_SQL}), 6) + 0.0 AS mean_rho FROM cells GROUP BY frame")
def q04(spark: SparkSession, sf: str) -> DataFrame:
    rho = L.elliptic_radius(NY, NZ, F.col("iy"), F.col("iz"))
    return cells(spark, sf).groupBy("frame").agg(F.count("*").alias("n"), F.count_if(rho <= 1).alias("inside"), F.count_if(rho <= _RC).alias("calib"), settled(F.avg(rho)).alias("mean_rho"))


@query("q05_weighted_sampling", f"WITH {CELLS_SQL}, k AS (SELECT *, ln({_u_sql(7, 'frame', 'iy', 'iz')} + 1e-12) / (round({_W_SQL}, 9) + 1e-12) AS key FROM cells), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY key DESC, iy, iz) AS rank FROM k) SELECT frame, iy, iz, rank FROM r WHERE rank <= 1200")
def q05(spark: SparkSession, sf: str) -> DataFrame:
    dense = L.gaussian_density(cells(spark, sf), NY, NZ, (_SY, _SZ))
    return L.weighted_top(dense, 1200, F.round("w", 9), 7).select("frame", "iy", "iz", "rank")


_LATTICE_SQL = f"lattice AS (SELECT f AS frame, y AS iy, z AS iz FROM range(1, 8) AS a(f), range({NY}) AS b(y), range({NZ}) AS c(z))"


@query(
    "q06_exact_count",
    f"""WITH {CELLS_SQL}, {_LATTICE_SQL}, s AS (
  SELECT l.frame, l.iy, l.iz, CASE WHEN c.frame IS NULL THEN 2 WHEN sqrt(((l.iy - {NY / 2}) / {NY / 2})^2 + ((l.iz - {NZ / 2}) / {NZ / 2})^2) <= 0.15 THEN 0 ELSE 1 END AS class
  FROM lattice l LEFT JOIN cells c ON c.frame = l.frame AND c.iy = l.iy AND c.iz = l.iz
), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY class, {_u_sql(11, 'frame', 'iy', 'iz')}, iy, iz) AS rank FROM s)
SELECT frame::INT AS frame, count(*) FILTER (WHERE rank <= 1200 OR class = 0) AS samples, count(*) FILTER (WHERE class = 0) AS calib, sum(CASE WHEN rank <= 1200 OR class = 0 THEN iy * 100 + iz ELSE 0 END)::BIGINT AS checksum FROM r GROUP BY frame""",
)
def q06(spark: SparkSession, sf: str) -> DataFrame:
    grid = L.lattice(spark, NY, NZ, 7).withColumn("frame", F.col("frame") + 1)
    full = S.rebuilt_mask(grid, cells(spark, sf)).withColumn("calib", F.col("sampled") & (L.elliptic_radius(NY, NZ, F.col("iy"), F.col("iz")) <= 0.15))
    exact = L.exact_count(full, 1200, 11)
    return exact.groupBy("frame").agg(F.count_if("sampled").alias("samples"), F.count_if("calib").alias("calib"), F.sum(F.when(F.col("sampled"), F.col("iy") * 100 + F.col("iz")).otherwise(0)).alias("checksum"))


_RANK_SQL = f"least(2 * (((iy - {NY // 2}) % {NY} + {NY}) % {NY}) + 1, 2 * ((({NY - 1 + NY // 2} - iy) % {NY} + {NY}) % {NY}))"


@query("q07_laminar_parts", f"WITH {CELLS_SQL}, p AS (SELECT *, ((row_number() OVER (PARTITION BY frame ORDER BY iz, {_RANK_SQL}) - 1) // {ETL} + 1)::INT AS part FROM cells) SELECT frame, part, count(*) AS n, sum(iy)::BIGINT AS sum_iy, sum(iz)::BIGINT AS sum_iz FROM p GROUP BY frame, part")
def q07(spark: SparkSession, sf: str) -> DataFrame:
    return S.sequential_parts(cells(spark, sf), NY, ETL).groupBy("frame", "part").agg(F.count("*").alias("n"), F.sum("iy").alias("sum_iy"), F.sum("iz").alias("sum_iz"))


_THETA = f"theta AS (SELECT *, round(CASE WHEN a < 0 THEN a + pi() WHEN a >= pi() THEN a - pi() ELSE a END, 12) AS theta FROM (SELECT *, atan2(iz - {NZ / 2}, iy - {NY / 2}) AS a FROM cells))"
_WEDGE = f"wedges AS (SELECT frame, iy, iz, theta, ((row_number() OVER (PARTITION BY frame ORDER BY theta, iy, iz) - 1) // {ETL})::INT AS wedge FROM theta)"
_AXES = "axes AS (SELECT frame, wedge, count(*) AS n, avg(theta) AS center, 0.5 * atan2(avg(sin(2 * theta)), avg(cos(2 * theta))) AS axis FROM wedges GROUP BY frame, wedge)"


@query("q08_radial_wedges", f"WITH {CELLS_SQL}, {_THETA}, {_WEDGE}, {_AXES} SELECT frame, wedge, n, round(center, 6) + 0.0 AS center, round(axis, 6) + 0.0 AS axis FROM axes")
def q08(spark: SparkSession, sf: str) -> DataFrame:
    return S.wedge_axes(S.wedge_parts(cells(spark, sf), NY, NZ, ETL)).select("frame", "wedge", "n", settled(F.col("center")).alias("center"), settled(F.col("axis")).alias("axis"))


_T = (ETL - 1) // 2


@query(
    "q09_projection_split",
    f"""WITH {CELLS_SQL}, {_THETA}, {_WEDGE}, {_AXES}, p AS (
  SELECT w.*, round((iy - {NY / 2}) * cos(round(axis, 9)) + (iz - {NZ / 2}) * sin(round(axis, 9)), 6) AS proj, (iy - {NY / 2})^2 + (iz - {NZ / 2})^2 AS dist2
  FROM wedges w JOIN axes a ON a.frame = w.frame AND a.wedge = w.wedge
), m AS (SELECT *, row_number() OVER (PARTITION BY frame, wedge ORDER BY dist2, proj, iy, iz) AS near FROM p
), o AS (SELECT *, row_number() OVER (PARTITION BY frame, wedge ORDER BY (near = 1)::INT, proj, iy, iz) - 1 AS place FROM m)
SELECT frame, wedge, iy, iz, (CASE WHEN near = 1 THEN {_T} WHEN place < {_T} THEN place ELSE place + 1 END)::INT AS slot FROM o""",
)
def q09(spark: SparkSession, sf: str) -> DataFrame:
    wedges = S.wedge_parts(cells(spark, sf), NY, NZ, ETL)
    axes = S.wedge_axes(wedges).withColumn("axis", F.round("axis", 9))
    return S.pivot_split(wedges, axes, NY, NZ, ETL, places=6).select("frame", "wedge", "iy", "iz", "slot")


_SCHED_SQL = f"sched AS (SELECT i // 16 AS shot, i % 16 AS echo, channel AS frame, (event_id % {NY})::INT AS iy, (event_id % {NZ})::INT AS iz FROM (SELECT user_id AS channel, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events))"


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a schedule: sixteen echoes a shot, each channel a frame."""
    acq = acquisitions(spark, sf)
    return acq.select(F.col("channel").alias("frame"), F.floor(F.col("i") / 16).alias("shot"), (F.col("i") % 16).cast("long").alias("echo"), (F.col("event_id") % NY).cast("int").alias("iy"), (F.col("event_id") % NZ).cast("int").alias("iz"))


@query(
    "q10_blips_and_steps",
    f"""WITH {_SCHED_SQL}, b AS (SELECT *, lead(iy) OVER w - iy AS dy, lead(iz) OVER w - iz AS dz, CASE WHEN echo % 2 = 0 THEN 1 ELSE -1 END AS polarity FROM sched WINDOW w AS (PARTITION BY frame, shot ORDER BY echo))
SELECT frame, coalesce(max(abs(dy)), 0)::INT AS max_dy, coalesce(max(abs(dz)), 0)::INT AS max_dz, sum(polarity)::BIGINT AS polarity, count(dy) AS steps FROM b GROUP BY frame""",
)
def q10(spark: SparkSession, sf: str) -> DataFrame:
    stepped = S.blips(schedule(spark, sf))
    return stepped.groupBy("frame").agg(F.coalesce(F.max(F.abs("dy")), F.lit(0)).alias("max_dy"), F.coalesce(F.max(F.abs("dz")), F.lit(0)).alias("max_dz"), F.sum("polarity").alias("polarity"), F.count("dy").alias("steps"))


@query("q11_rf_phase", f"WITH {_SCHED_SQL}, s AS (SELECT DISTINCT frame, shot FROM sched), n AS (SELECT *, frame * 100 + shot + 1 AS k FROM s) SELECT frame, shot, k, round((0.5 * 117.0 * k * k) % 360.0, 6) + 0.0 AS phase FROM n")
def q11(spark: SparkSession, sf: str) -> DataFrame:
    shots = schedule(spark, sf).select("frame", "shot").distinct().withColumn("k", S.rf_count(F.col("frame"), F.col("shot"), 100))
    return shots.select("frame", "shot", "k", settled(S.rf_phase(F.col("k"))).alias("phase"))


@query(
    "q34_mask_rebuilt",
    f"WITH {CELLS_SQL}, {_SCHED_SQL}, v AS (SELECT DISTINCT frame % 7 + 1 AS f, iy, iz FROM sched) SELECT frame, count(*) AS n, count(v.iy) AS sampled FROM cells LEFT JOIN v ON v.f = frame AND v.iy = cells.iy AND v.iz = cells.iz GROUP BY frame",
)
def q34(spark: SparkSession, sf: str) -> DataFrame:
    plan = schedule(spark, sf).withColumn("frame", (F.col("frame") % 7 + 1).cast("int"))
    return S.rebuilt_mask(cells(spark, sf), plan).groupBy("frame").agg(F.count("*").alias("n"), F.count_if("sampled").alias("sampled"))


@query(
    "q37_crossing_pairs",
    f"""WITH {_SCHED_SQL}, g AS (SELECT frame, shot, row_number() OVER w - 1 AS i, iy AS x1, iz AS y1, lead(iy) OVER w AS x2, lead(iz) OVER w AS y2, count(*) OVER (PARTITION BY frame, shot) AS m FROM sched WINDOW w AS (PARTITION BY frame, shot ORDER BY echo)),
s AS (SELECT * FROM g WHERE x2 IS NOT NULL), x AS (
  SELECT a.frame, a.shot FROM s a JOIN s b ON a.frame = b.frame AND a.shot = b.shot AND b.i >= a.i + 2 AND NOT (a.i = 0 AND b.i = a.m - 2)
  WHERE (((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1) > 0) <> ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1) > 0))
    AND (((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1) > 0) <> ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1) > 0))
), k AS (SELECT frame, shot, count(*) AS c FROM x GROUP BY 1, 2)
SELECT DISTINCT s.frame, s.shot, coalesce(c, 0) AS crossings FROM sched s LEFT JOIN k ON k.frame = s.frame AND k.shot = s.shot""",
)
def q37(spark: SparkSession, sf: str) -> DataFrame:
    plan = schedule(spark, sf).withColumn("path", F.struct("frame", "shot"))
    return S.crossings(plan, key="path").select("path.frame", "path.shot", "crossings")


@query(
    "q33_scatter",
    f"""WITH {_LATTICE_SQL}, s AS (SELECT l_linenumber AS frame, (l_partkey % {NY})::INT AS iy, (l_suppkey % {NZ})::INT AS iz, l_quantity AS v, row_number() OVER (PARTITION BY l_linenumber, l_partkey % {NY}, l_suppkey % {NZ} ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rk, count(*) OVER (PARTITION BY l_linenumber, l_partkey % {NY}, l_suppkey % {NZ}) AS copies FROM lineitem)
SELECT l.frame::INT AS frame, count(*) AS cells, count(s.v) AS filled, count(*) FILTER (WHERE copies > 1) AS duplicated, sum(coalesce(s.v, 0))::BIGINT AS total FROM lattice l LEFT JOIN s ON s.rk = 1 AND s.frame = l.frame AND s.iy = l.iy AND s.iz = l.iz GROUP BY l.frame""",
)
def q33(spark: SparkSession, sf: str) -> DataFrame:
    from lumafold.operators.recon import scatter

    lines = table(spark, sf, "lineitem")
    samples = lines.select(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % NY).cast("int").alias("iy"), (F.col("l_suppkey") % NZ).cast("int").alias("iz"), F.col("l_quantity").alias("v"), "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    grid = L.lattice(spark, NY, NZ, 7).withColumn("frame", F.col("frame") + 1)
    placed = scatter(grid, samples, ["v"], [F.desc("l_orderkey"), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_extendedprice")])
    return placed.groupBy("frame").agg(F.count("*").alias("cells"), F.count_if("filled").alias("filled"), F.count_if(F.col("copies") > 1).alias("duplicated"), F.sum("v").cast("long").alias("total"))


_PSF_SQL = f"""WITH {CELLS_SQL}, az AS (
  SELECT frame, iy, v, sum(cos(2 * pi() * ((v * iz) % {NZ}) / {NZ}.0)) AS re, sum(sin(2 * pi() * ((v * iz) % {NZ}) / {NZ}.0)) AS im FROM cells, range({NZ}) AS t(v) GROUP BY frame, iy, v
), ay AS (
  SELECT frame, u, v, sum(re * cos(2 * pi() * ((u * iy) % {NY}) / {NY}.0) - im * sin(2 * pi() * ((u * iy) % {NY}) / {NY}.0)) / {NY * NZ} AS re,
         sum(re * sin(2 * pi() * ((u * iy) % {NY}) / {NY}.0) + im * cos(2 * pi() * ((u * iy) % {NY}) / {NY}.0)) / {NY * NZ} AS im FROM az, range({NY}) AS t(u) GROUP BY frame, u, v
)
SELECT frame, ((u + {NY // 2}) % {NY})::INT AS py, ((v + {NZ // 2}) % {NZ})::INT AS pz, round(sqrt(re * re + im * im), 6) + 0.0 AS psf FROM ay"""


@query("q42_point_spread", _PSF_SQL)
def q42(spark: SparkSession, sf: str) -> DataFrame:
    from lumafold.operators.recon import point_spread

    return point_spread(cells(spark, sf), NY, NZ, ("frame",)).select("frame", "py", "pz", settled(F.col("psf")).alias("psf"))
