import math

import pytest
from pyspark.sql import functions as F

from lumafold.operators import disc, lattice, schedule


def counts(mask):
    return [r["n"] for r in mask.groupBy("frame").agg(F.count_if("sampled").alias("n")).orderBy("frame").collect()]


@pytest.mark.parametrize("grid,accel", [((12, 8), 4), ((24, 16), 6), ((15, 10), 3), ((90, 60), 6)])
def test_caipi_count_and_offset(spark, grid, accel):
    cells = lattice.lattice(spark, *grid)
    for offset in (0, 1):
        hit = lattice.caipi(*grid, accel, F.col("iy"), F.col("iz"), offset)
        assert cells.where(hit).count() == grid[0] * grid[1] // accel


@pytest.mark.parametrize("grid,accel", [((12, 8), 4), ((24, 16), 6)])
def test_temporal_caipi_covers_once(spark, grid, accel):
    mask = lattice.sampling_masks(spark, "ticaipi", *grid, accel, accel)
    assert counts(mask) == [grid[0] * grid[1] // accel] * accel
    seen = lattice.coverage(mask)
    assert seen.count() == grid[0] * grid[1] and seen.where("frames <> 1").count() == 0


def test_gaussian_peak_and_range(spark):
    dense = lattice.gaussian_density(lattice.lattice(spark, 15, 21), 15, 21, 4.0)
    peak = dense.orderBy(F.desc("w")).first()
    assert (peak["iy"], peak["iz"], peak["w"]) == (7, 10, 1.0)
    assert dense.where("w <= 0 OR w > 1").count() == 0


def test_random_masks_have_exact_counts(spark):
    for method in ("rand", "rand_gaussian"):
        a = lattice.sampling_masks(spark, method, 20, 30, 2, 5, seed=1)
        assert counts(a) == [120, 120]
    per = lattice.sampling_masks(spark, "rand", 20, 30, 2, 5, seed=1, seed_per_frame=True)
    first, second = ({(r["iy"], r["iz"]) for r in per.where((F.col("frame") == k) & F.col("sampled")).collect()} for k in (0, 1))
    assert len(first) == len(second) == 120 and first != second
    with pytest.raises(ValueError):
        lattice.sampling_masks(spark, "spiral", 4, 4, 1, 2)


def test_prune_and_fill(spark):
    cells = lattice.lattice(spark, 10, 10).withColumn("sampled", F.col("iy") < 5).withColumn("calib", F.col("iy") < 2)
    for n in (30, 70):
        out = lattice.exact_count(cells, n, 3)
        assert out.where("sampled").count() == n
        assert out.where("calib AND NOT sampled").count() == 0


def test_disc_mask():
    for seed in (0, 1):
        mask = disc.disc_mask(40, 30, 4, seed, calib_frac=0.2)
        assert mask.sum() == 300
        assert (mask == disc.disc_mask(40, 30, 4, seed, calib_frac=0.2)).all()
        core = min(math.sqrt(4 * 0.2 * 300 / (math.pi * 1200)), 0.999)
        assert all(mask[y, z] for y in range(40) for z in range(30) if math.hypot((y - 20) / 20, (z - 15) / 15) <= core)
    inner, outer = disc.disc_mask(60, 60, 6, 2)[20:40, 20:40].mean(), disc.disc_mask(60, 60, 6, 2)[:8].mean()
    assert inner > outer
    for bad in (0.5, 1):
        with pytest.raises(ValueError):
            disc.disc_mask(10, 10, bad, 0)


def test_center_out(spark):
    for n in range(1, 30):
        rows = spark.range(n).select(schedule.center_out_index(n, F.col("id")).alias("row"), F.col("id").alias("p"))
        back = rows.select("p", schedule.center_out_rank(n, F.col("row")).alias("r")).collect()
        assert all(r["p"] == r["r"] for r in back)
