"""Operators that no query registers, on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumafold.functions import columns as K
from lumafold.operators import config, events, feasibility, recon, registry, schedule, signal
from lumafold.sources import images, loopfile

AXIS = "struct<amplitude:double,rise:double,flat:double,fall:double>"


def test_loop_table(spark):
    rows = [
        (1, "rf", 1, False, 0.5, (2.0, 0.1, 30.0), None, (3.0, 1.0, 2.0, 1.0), None, None),
        (2, "adc", 1, True, 0.25, None, (0.7, 11.0), None, (-1.0, 0.5, 0.0, 0.5), None),
        (3, "rf", 2, False, 0.5, (4.0, 0.2, 30.0), None, (6.0, 1.0, 2.0, 1.0), None, None),
    ]
    schema = f"n long, signature string, seg_id int, is_trigger boolean, duration double, rf struct<amplitude:double,phase:double,freq:double>, adc struct<phase:double,freq:double>, gx {AXIS}, gy {AXIS}, gz {AXIS}"
    blocks = spark.createDataFrame(rows, schema)
    parents = events.parent_blocks(blocks)
    loop = events.loop_table(blocks, parents)
    assert len(loop.columns) == 24  # n and the 23 columns
    got = {r["n"]: r for r in loop.collect()}
    assert got[1]["parent_id"] == got[3]["parent_id"] == 1 and got[2]["parent_id"] == 2
    assert got[1]["energy_gx"] == pytest.approx(9 * (1 / 3 + 2 + 1 / 3)) and got[2]["frequency"] == 11.0 and got[2]["trigger"] == 1
    assert [got[1][f"r{k}{k}"] for k in range(3)] == [1.0] * 3
    assert loopfile.loop_limits(loop).first()[:] == (4.0, 6.0)
    slew = events.realised_slew(loop, parents.select("parent_id").withColumn("unit", F.lit(2.0)), "parent_id", "amp_gx", "unit")
    assert slew.first()["max_slew"] == 12.0


def test_block_kinds(spark):
    rows = spark.createDataFrame([(None, None, None, None, None), (1.0, None, None, 1, "physio1")], "rf double, gx double, adc double, label int, trig string")
    kind = events.block_kind(F.col("rf"), [F.col("gx")], F.col("adc"), F.col("label"), F.col("trig"))
    a, b = (r["k"] for r in rows.select(kind.alias("k")).collect())
    assert a["pure_delay"] and not b["pure_delay"] and b["has_rf"] and b["is_trigger"]


def test_running_rows(spark):
    sizes = [3, 1, 4, 1, 5, 9, 2, 6]
    rows = spark.createDataFrame([(10 * k, n) for k, n in enumerate(sizes)], "k long, n long")
    got = [(r["first"], r["last"]) for r in events.running_rows(rows, "k", "n", 3).orderBy("k").collect()]
    ends = np.cumsum(sizes)
    assert got == [(int(e - n + 1), int(e)) for e, n in zip(ends, sizes, strict=True)]


def test_gradient_arithmetic(spark):
    row = spark.range(1).select(
        feasibility.area_preserving(F.lit(2.0), F.lit(1.0), F.lit(2.5), F.lit(1.0), 1.0).alias("g"),
        feasibility.padding(F.lit(10.3), F.lit(4.0), 1.0).alias("d"), feasibility.padding(F.lit(1.0), F.lit(4.0), 1.0).alias("e"),
        feasibility.raster_up(F.lit(0.3), 0.1).alias("r"), feasibility.ernst_angle(F.lit(1.0), F.lit(1.0)).alias("a"),
        feasibility.peak_b1(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(4.0), F.lit(0.0)), 5.0).alias("b"),
    ).first()
    assert row["g"]["flat"] == 3.0 and row["g"]["amplitude"] * 4 == pytest.approx(7.0)
    assert row["d"]["delay"] == 6.0 and row["d"]["feasible"] and row["e"]["delay"] == 0.0 and not row["e"]["feasible"]
    assert row["r"] == pytest.approx(0.3) and row["a"] == pytest.approx(math.degrees(math.acos(math.exp(-1)))) and row["b"] == pytest.approx(1e4)


def test_spectrum_and_bands(spark):
    dt, f = 4e-6, 1200.0
    wave = np.cos(2 * np.pi * f * dt * np.arange(5000))[None] * 0.01
    hz, mag = feasibility.spectrum(wave, dt)
    assert len(hz) % 2 == 0 and abs(abs(hz[mag[0].argmax()]) - f) < 10
    bands = feasibility.acoustic_bands(spark, [(0, 400.0, 450.0), (1, 100.0, 110.0)])
    table = spark.createDataFrame([(float(h), float(m)) for h, m in zip(hz, mag[0], strict=True)], "hz double, mag double")
    peaks = {r["band"]: r["peak"] for r in signal.band_maximum(table, bands.drop("axis")).collect()}
    assert peaks[0] > 10 * peaks[1]


def test_maps_are_masked_cropped_and_resampled(spark):
    rows = [(0, x, 0, z, float(z), 0.0) for x in range(2) for z in range(8)]
    maps = spark.createDataFrame(rows, "coil int, ix int, iy int, iz int, re double, im double")
    eigen = maps.select("ix", "iy", "iz", F.when(F.col("iz") == 5, 0.1).otherwise(1.0).alias("ev"))
    masked = recon.masked_maps(maps, eigen, 0.5)
    assert masked.where("iz = 5 AND re <> 0").count() == 0 and masked.where("iz = 4 AND re = 4").count() == 2
    cut = recon.cropped(maps, "iz", 8, 4)
    assert cut.agg(F.min("re"), F.max("re"), F.max("iz")).first()[:] == (2.0, 5.0, 3)
    with pytest.raises(ValueError):
        recon.cropped(maps, "iz", 8, 9)
    fine = recon.resampled(maps, "iz", 8, 15, ["coil", "ix", "iy"]).where("ix = 0").orderBy("iz").collect()
    assert np.allclose([r["re"] for r in fine][::2], np.arange(8))


def test_transforms(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(3, 9)) + 1j * rng.normal(size=(3, 9))
    rows = spark.createDataFrame([(k, z[k].real.tolist(), z[k].imag.tolist()) for k in range(3)], "k int, re array<double>, im array<double>")
    there = signal.fft_lines(rows, "re", "im", unitary=True)
    back = signal.fft_lines(there, "re", "im", inverse=True, unitary=True).orderBy("k").collect()
    assert np.allclose([np.array(r["re"]) + 1j * np.array(r["im"]) for r in back], z)
    with pytest.raises(ValueError):
        signal.dft_weights(spark, 1000)


def test_complex_columns(spark):
    a, b = K.complex_of(F.lit(1.0), F.lit(2.0)), K.complex_of(F.lit(3.0), F.lit(-1.0))
    r = spark.range(1).select(K.c_mul(a, b).alias("m"), K.c_conj(a).alias("c"), K.c_abs(b).alias("n"), K.c_angle(a).alias("p"), K.c_polar(F.lit(2.0), F.lit(0.0)).alias("q"), K.round_away(F.lit(-2.5)).alias("r"), K.shifted(F.lit(0), 5).alias("s")).first()
    assert (r["m"]["re"], r["m"]["im"]) == (5.0, 5.0) and r["c"]["im"] == -2.0 and r["n"] == pytest.approx(math.sqrt(10))
    assert r["p"] == pytest.approx(math.atan2(2, 1)) and r["q"]["re"] == 2.0 and r["r"] == -3 and r["s"] == 2


def test_steps_and_counts(spark):
    one = spark.createDataFrame([(0, 0, 0, 3, 4)], "frame int, shot int, echo int, iy int, iz int")
    assert schedule.max_steps(one).first()[:] == (0, 0)
    two = spark.createDataFrame([(0, 0, 0, 3, 4), (0, 0, 1, 5, 1)], one.schema)
    assert schedule.max_steps(two).first()[:] == (2, 3)
    mask = spark.createDataFrame([(0, True), (0, False), (0, True)], "frame int, sampled boolean")
    assert schedule.count_check(mask, 2, 1).first()["ok"] and not schedule.count_check(mask, 3, 1).first()["ok"]
    d2 = signal.second_difference(spark.createDataFrame([(0, i, float(i * i)) for i in range(4)], "g int, i int, v double"), ["g"], ["i"], "v")
    assert [r["d2"] for r in d2.orderBy("i").collect()] == [None, 2.0, 2.0, None]
    assert signal.difference(d2, ["g"], ["i"], "v").where("d = 5").count() == 1


def test_phases_of_high_counts_are_exact(spark):
    counts = [1, 2, 17, 8_773_999, 8_774_089, 8_999_905, 90_000_000_001]
    got = spark.createDataFrame([(k,) for k in counts], "k long").select("k", *[schedule.rf_phase(F.col("k"), step).alias(str(i)) for i, step in enumerate((117.0, 50.25, -3.0))]).collect()
    for i, (p, q) in enumerate(((117, 1), (201, 4), (-3, 1))):
        assert [r[str(i)] for r in got] == [(p * r["k"] ** 2) % (720 * q) / (2 * q) for r in got]


def test_entry_files_and_claims(spark):
    wanted = spark.createDataFrame([(2, 1), (4, 2), (7, 3)], "entry int, rank int")
    taken = spark.createDataFrame([(4,)], "entry int")
    assert [r["entry"] for r in registry.claim(wanted, taken, 2).collect()] == [2, 7]
    assert spark.range(1).select(registry.entry_text(F.lit("/a/b")).alias("t")).first()["t"] == "1\n/a/b\n"
    assigned = spark.createDataFrame([(2, "a", 0), (1, "b", 1)], "entry int, basename string, tier int")
    assert [r["how"] for r in registry.assignment_report(assigned).collect()] == ["replaces", "new"]


def test_hardware_and_volumes(spark, tmp_path):
    catalog = config.hardware_catalog(spark, [config.Hardware("s1", 0.05, 200.0, 2e-5, 3.0), config.Hardware("s2", 0.03, 120.0, 2e-5, 1.5)])
    runs = spark.createDataFrame([("r", "s2")], "run string, scanner string")
    assert config.with_hardware(runs, catalog).first()["b0"] == 1.5
    assert config.zero_based(config.one_based(spark.createDataFrame([(0, 1)], "iy int, iz int"))).first()[:] == (0, 1)
    assert set(config.paths("/d/", "x")) >= {"schedule", "kspace"}
    frames = lambda v: spark.createDataFrame([(f, 0, v + f) for f in range(3)], "frame int, ix int, re double")
    path = str(tmp_path / "v")
    images.write_volume(frames(0.0), path)
    images.write_volume(frames(10.0).where("frame = 1"), path)
    assert [images.read_frame(spark, path, k).first()["re"] for k in range(3)] == [0.0, 11.0, 2.0]
    assert images.read_arrays(spark, path, ["re"]).columns == ["re"]


def test_program_comparison(spark):
    from lumafold.operators.assembly import compare_tables

    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "n int, v double")
    b = spark.createDataFrame([(1, 1.00001), (2, 2.5), (3, 0.0)], "n int, v double")
    assert sorted(r["n"] for r in compare_tables(a, b, ["n"]).collect()) == [2, 3]


def test_exact_percentile_in_passes(spark):
    import numpy as np

    from lumafold.operators import signal

    rng = np.random.default_rng(0)
    for values in (rng.lognormal(0, 3, 5000), np.repeat([1.0, 2.0, 5.0], 2000), np.concatenate([np.full(4000, 7.0), rng.random(30)]), np.array([3.0])):
        table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for share in (0.0, 0.5, 0.99, 1.0):
            got = signal.exact_percentile(table, F.col("v"), share, last_values=50)
            assert abs(got - np.quantile(values, share)) < 1e-9 * max(1, abs(got))
    assert signal.exact_percentile(table.limit(0), F.col("v"), 0.5) is None
