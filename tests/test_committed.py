"""Committed results: reruns do the rest alone, torn writes are never read, changed inputs miss."""

import numpy as np
import pytest

from lumafold.operators import pipeline
from lumafold.sources import committed


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    mark = committed.fingerprint({"n": 3}, {"a": a})
    assert mark == committed.fingerprint({"n": 3}, {"a": a.repartition(3).orderBy("v")})
    assert mark == committed.fingerprint({"n": 3}, {"a": a.select("v", "k")})
    others = [
        committed.fingerprint({"n": 4}, {"a": a}), committed.fingerprint({"n": 3}, {"b": a}), committed.fingerprint({"n": 3}, {"a": a.distinct()}),
        committed.fingerprint({"n": 3}, {"a": a.selectExpr("cast(k as long) AS k", "v")}), committed.fingerprint({"n": 3}, {"a": a.fillna("")}), committed.fingerprint({"n": 3}),
    ]
    assert len({mark, *others}) == 7 and committed.fingerprint({}, {"a": a.limit(0)}) != committed.fingerprint({}, {"a": a})


def test_cache(spark, tmp_path):
    root, made = str(tmp_path), []

    def make():
        made.append(1)
        return {"raw": spark.range(5), "eigen": spark.range(2), "echo_times": spark.createDataFrame([(0, 1.5)], "echo int, te double")}

    names = ["raw", "eigen", "echo_times"]
    first = committed.cached(root, "m1", names, make, spark)
    again = committed.cached(root, "m1", names, make, spark)
    assert len(made) == 1 and again["raw"].count() == 5 and again["echo_times"].first()["te"] == 1.5 and first["eigen"].count() == 2
    committed.cached(root, "m2", names, make, spark)
    assert len(made) == 2
    # A write that stopped before its commit isn't read, and the tables are made again.
    with pytest.raises(ZeroDivisionError):
        committed.cached(root, "m3", names, lambda: {"raw": spark.range(9), "eigen": spark.range(1), "echo_times": 1 / 0}, spark)
    spark.range(9).write.parquet(f"{root}/m3/torn/raw")
    assert committed.commits(spark, root, "m3") == {} and committed.cached(root, "m3", names, make, spark)["raw"].count() == 5
    with pytest.raises(ValueError, match="eigen"):
        committed.cached(root, "m4", names, lambda: {"raw": spark.range(1), "echo_times": spark.range(1)}, spark)


def test_frames_resume(spark, tmp_path):
    root, calls = str(tmp_path), []

    def work(fails):
        def run(frames):
            calls.append(frames)
            if fails in frames:
                raise RuntimeError("lost")
            return spark.createDataFrame([(f, k) for f in frames if f != 5 for k in range(3)], "frame int, k int")  # frame 5 has no rows

        return run

    with pytest.raises(ValueError):
        committed.read_frames(root, "m", spark)
    with pytest.raises(RuntimeError):
        committed.process_frames(root, "m", range(9), work(4), spark, batch=2)
    assert sorted(committed.commits(spark, root, "m")) == ["0", "1", "2", "3"]
    spark.createDataFrame([(4, 99, 4)], "frame int, k int, frame_number int").write.partitionBy("frame_number").parquet(f"{root}/m/attempt=torn")
    assert committed.read_frames(root, "m", spark).count() == 12
    calls.clear()
    assert committed.process_frames(root, "m", range(9), work(None), spark, batch=2) == [4, 5, 6, 7, 8] and calls == [[4, 5], [6, 7], [8]]
    table = committed.read_frames(root, "m", spark)
    assert table.columns == ["frame", "k"] and sorted((r["frame"], r["k"]) for r in table.collect()) == [(f, k) for f in range(9) if f != 5 for k in range(3)]
    assert committed.read_frames(root, "m", spark, [7, 5, 77]).count() == 3
    calls.clear()
    assert committed.process_frames(root, "m", range(9), work(None), spark) == [] and calls == []


def test_preprocess_goes_on(spark, tmp_path):
    """Four frames of which the last two lose shots: the first run stops there, the second does these alone."""
    rng, nx, ny, etl, coils, frames = np.random.default_rng(1), 8, 4, 8, 2, 4
    kx = (np.arange(nx + 1) - nx / 2) / 20.0
    value = lambda: (float(rng.normal()), float(rng.normal()))
    shots = spark.createDataFrame([(f, 0, e, c, i, *value()) for f in range(frames) for e in range(etl) for c in range(coils) for i in range(nx + 1)], "frame int, shot int, echo int, coil int, i int, re double, im double")
    plan = spark.createDataFrame([(f, 0, e, e % ny, e // ny) for f in range(frames) for e in range(etl)], "frame int, shot int, echo int, iy int, iz int")
    samples = lambda n: spark.createDataFrame([(s, c, *value()) for s in range(n) for c in range(coils)], "sample int, coil int, re double, im double")
    x = (np.arange(nx) - nx / 2) * 20.0 / nx
    line = np.exp(-2j * np.pi * np.outer(kx, x)) @ np.array([0, 0, 1, 1, 1, 1, 0, 0.0])
    cal = spark.createDataFrame([(0, e, c, i, float(line[i].real), float(line[i].imag)) for e in range(etl) for c in range(coils) for i in range(nx + 1)], "shot int, echo int, coil int, i int, re double, im double")
    trajectory = spark.createDataFrame([(p, i, float(k)) for p in (0, 1) for i, k in enumerate(kx)], "parity int, i int, kx double")
    tables = {"noise": samples(60), "reference": samples(40), "calibration": cal, "trajectory": trajectory}
    tables = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in tables.items()}
    run = lambda s, scan="a", **how: pipeline.preprocess(str(tmp_path), scan, s, plan, **tables, size=(nx, ny, 2), etl=etl, fov_cm=20.0, delay=0.0, **{"batch": 2, "floor": 2, **how})
    with pytest.raises(RuntimeError, match=r"\[2, 3\]"):
        run(shots.where("NOT (frame >= 2 AND echo = 7)"))
    mark, written = run(shots)
    assert written == [2, 3] and run(shots) == (mark, [])
    volume = committed.read_frames(str(tmp_path), mark, spark)
    assert volume.groupBy("frame").count().where(f"count = {nx * ny * 2 * 2}").count() == frames
    whole, _ = run(shots, scan="b", batch=4)
    other = committed.read_frames(str(tmp_path), whole, spark)
    key = ["frame", "coil", "ix", "iy", "iz"]
    apart = volume.join(other.withColumnsRenamed({"re": "r2", "im": "i2"}), key)
    assert apart.count() == volume.count() and apart.where("abs(re - r2) > 1e-9 OR abs(im - i2) > 1e-9").count() == 0
    assert run(shots, energy=0.5)[0] != mark
