"""Queries whose operators are iterative: shot ordering, row sweeps, Poisson discs, per-frame solvers, long convolution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumafold.operators import disc, lattice, ordering, recon, schedule
from lumafold.operators import feasibility as P
from lumafold.plans.masks import ETL, query_set
from lumafold.plans.views import CELLS_SQL, NY, NZ, cells, coil_samples
from lumafold.session import table

QUERIES, ORACLES, query = query_set()
SCALE = (1.0, 2.3)


@query("q38_shot_ordering", f"WITH {CELLS_SQL} SELECT frame, count(*) AS n, ceil(count(*) / {ETL}.0)::INT AS shots, sum(iy * 64 + iz)::BIGINT AS checksum FROM cells GROUP BY frame")
def q38(spark: SparkSession, sf: str) -> DataFrame:
    """Radial schedule; every sampled cell exactly once."""
    plan = ordering.plan_schedule(cells(spark, sf), "radial", NY, NZ, ETL, SCALE)
    return plan.groupBy("frame").agg(F.count("*").alias("n"), F.countDistinct("shot").cast("int").alias("shots"), F.sum(F.col("iy") * 64 + F.col("iz")).alias("checksum"))


@query("q38_shot_paths")
def q38_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The laminar schedule itself, with its largest steps."""
    plan = ordering.plan_schedule(cells(spark, sf), "laminar", NY, NZ, ETL, SCALE)
    w = Window.partitionBy("frame", "shot").orderBy("echo")
    step = schedule.weighted_step(F.col("iy") - F.lag("iy").over(w), F.col("iz") - F.lag("iz").over(w), *SCALE)
    return plan.withColumn("step", step).groupBy("frame", "shot").agg(F.count("*").alias("n"), F.coalesce(F.max("step"), F.lit(0.0)).alias("max_step"))


@query("q39_row_directions")
def q39(spark: SparkSession, sf: str) -> DataFrame:
    """Best sweep directions of each part's rows, and the longest link that they leave."""
    parts = schedule.sequential_parts(cells(spark, sf), NY, ETL)

    def sweep(key: tuple, rows: pa.Table) -> pa.Table:
        y, z = rows["iy"].to_numpy(), rows["iz"].to_numpy()
        lines = sorted(set(y.tolist()))
        columns = [sorted(z[y == r].tolist()) for r in lines]
        ways = ordering.best_directions(lines, columns, SCALE)
        links = ordering.row_links(lines, columns, ways, SCALE)
        return pa.table({"frame": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "ways": ["".join(ways)], "longest": [float(max(links, default=0.0))], "total": [float(sum(links))]})

    return parts.groupBy("frame", "part").applyInArrow(sweep, "frame int, part int, ways string, longest double, total double")


@query("q40_poisson_disc", "SELECT l_linenumber AS frame, 500::BIGINT AS samples, true AS calibrated FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def q40(spark: SparkSession, sf: str) -> DataFrame:
    """A mask for each frame number that occurs, of exactly 60 * 50 / 6 samples, with its calibration disc full."""
    frames = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("frame")).distinct()
    masks = disc.disc_masks(spark, 60, 50, 8, 6, seed=3, seed_per_frame=True, calib_frac=0.1)
    radius = lattice.calibration_radius(60, 50, 500, 0.1)
    inside = lattice.elliptic_radius(60, 50, F.col("iy"), F.col("iz")) <= radius
    counted = masks.groupBy("frame").agg(F.count_if("sampled").alias("samples"), F.every(F.col("sampled") | ~inside).alias("calibrated"))
    return frames.join(counted, "frame")


@query("q41_cg_sense")
def q41(spark: SparkSession, sf: str) -> DataFrame:
    """Conjugate-gradient reconstruction of an 8 x 8 image for each label, from four of its vectors' channels."""
    samples = coil_samples(spark, sf)
    mean = samples.groupBy("frame", "coil").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    grid = spark.range(64).select((F.col("id") % 8).cast("int").alias("ix"), F.floor(F.col("id") / 8).cast("int").alias("iy"))
    # A smooth object for each frame; four Gaussian coils see it.
    objects = mean.groupBy(F.col("frame").cast("int").alias("frame")).agg(F.sort_array(F.collect_list(F.struct("coil", "re", "im"))).alias("x"))
    image = objects.crossJoin(grid).withColumn("p", F.get("x", (F.col("ix") + 8 * F.col("iy")).cast("int") % 32)).select("frame", "ix", "iy", F.col("p.re").alias("vr"), F.col("p.im").alias("vi"))
    corners = [(0, 0.0, 0.0), (1, 7.0, 0.0), (2, 0.0, 7.0), (3, 7.0, 7.0)]
    coils = spark.createDataFrame(corners, "coil int, cx double, cy double")
    weight = F.exp(-((F.col("ix") - F.col("cx")) * (F.col("ix") - F.col("cx")) + (F.col("iy") - F.col("cy")) * (F.col("iy") - F.col("cy"))) / 72.0)
    maps = grid.crossJoin(coils).select("coil", "ix", "iy", F.lit(0).alias("iz"), weight.alias("re"), F.lit(0.0).alias("im"))
    seen = image.join(maps.select("coil", "ix", "iy", F.col("re").alias("s")), ["ix", "iy"]).select("frame", "coil", "ix", "iy", F.lit(0).alias("iz"), (F.col("vr") * F.col("s")).alias("re"), (F.col("vi") * F.col("s")).alias("im"))

    def solve(views: np.ndarray, sens: np.ndarray) -> np.ndarray:
        return recon.cg_sense(recon.fftc(views, (0, 1, 2)), sens, 60)

    solved = recon.frame_map(seen, maps, (8, 8, 1), 4, solve)
    error = F.sqrt(F.sum((F.col("re") - F.col("vr")) ** 2 + (F.col("im") - F.col("vi")) ** 2) / F.sum(F.col("vr") ** 2 + F.col("vi") ** 2))
    return solved.join(image, ["frame", "ix", "iy"]).groupBy("frame", "status").agg((error < 1e-3).alias("recovered"), F.count("*").alias("voxels"))


ORACLES["q41_cg_sense"] = "SELECT DISTINCT label::INT AS frame, 'ok' AS status, true AS recovered, 64::BIGINT AS voxels FROM embeddings"

_DT, _SLEW, _CHRON = 4e-6, 23.4 / 0.333, 40e-6


@query(
    "q47_stimulation",
    f"""WITH w AS (SELECT 0 AS ch, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, value * 1e-6 AS g FROM events), s AS (SELECT i, coalesce((g - lag(g) OVER (ORDER BY i)) / {_DT}, 0) AS s FROM w),
p AS (SELECT a.i, sum(b.s * {_DT} / {_SLEW} * {_CHRON} / power({_CHRON} + {_DT} * (a.i - b.i + 1), 2)) AS p FROM s a JOIN s b ON b.i <= a.i AND b.i > a.i - 200 GROUP BY a.i)
SELECT i, round(100 * abs(p), 4) + 0.0 AS pns FROM p""",
)
def q47(spark: SparkSession, sf: str) -> DataFrame:
    """Nerve stimulation of one waveform, by chunks with a halo."""
    from lumafold.operators.events import running_rows

    events = table(spark, sf, "events").select("ts", "event_id", F.col("value").alias("v"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    # Row numbers over the whole log in two steps: counts by instant first, then the place inside an instant.
    instants = running_rows(events.groupBy("us").agg(F.count("*").alias("n")), "us", "n").select("us", "first")
    placed = events.join(instants, "us").withColumn("i", F.col("first") - 2 + F.row_number().over(Window.partitionBy("us").orderBy("event_id")))
    wave = placed.select(F.lit(0).alias("ch"), "i", (F.col("v") * 1e-6).alias("g"))
    found = P.stimulation(wave, _SLEW, _CHRON, _DT, (1.0,), chunk=2048)
    return found.select("i", (F.round("pns", 4) + F.lit(0.0)).alias("pns"))
