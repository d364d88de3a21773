"""Packed volumes: frames solved from blocks, maps read once by a worker process."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumafold.operators import coils, recon, volumes

VOXELS = "frame int, coil int, ix int, iy int, iz int, re double, im double"
MAPS = "coil int, ix int, iy int, iz int, re double, im double"


def voxel_rows(array, frame=None):
    for at in np.argwhere(array):
        z = array[tuple(at)]
        yield (*(() if frame is None else (frame,)), int(at[3]), int(at[0]), int(at[1]), int(at[2]), float(z.real), float(z.imag))


def volume(seed, shape=(6, 5, 2), channels=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(*shape, channels)) + 1j * rng.normal(size=(*shape, channels))


def test_blocks_hold_the_voxels(spark, monkeypatch):
    monkeypatch.setattr(volumes, "HELD", 7)  # many blocks for a frame and channel
    wanted = {f: volume(f) for f in range(3)}
    wanted[1][::2] = 0
    blocks = volumes.packed(spark.createDataFrame([r for f, v in wanted.items() for r in voxel_rows(v, f)], VOXELS)).toArrow()
    for f, v in wanted.items():
        own = blocks.filter(np.asarray(blocks["frame"]) == f)
        assert np.array_equal(volumes.dense(own, v.shape[:3], v.shape[3]), v)


def test_frames_equal_numpy(spark):
    maps = volume(99)
    maps /= np.sqrt((np.abs(maps) ** 2).sum(-1, keepdims=True))
    frames = {f: volume(f) for f in range(4)}
    for v in frames.values():
        v[1::3] = 0
    k = spark.createDataFrame([r for f, v in frames.items() for r in voxel_rows(v, f)], VOXELS).repartition(5)
    found = recon.frame_map(k, spark.createDataFrame(list(voxel_rows(maps)), MAPS).repartition(3), (6, 5, 2), 3, lambda v, m: recon.cg_sense(v, m, 15)).toPandas()
    assert len(found) == 4 * 60 and set(found["status"]) == {"ok"}
    for f, v in frames.items():
        own = found[found["frame"] == f]
        image = np.zeros((6, 5, 2), complex)
        image[own["ix"], own["iy"], own["iz"]] = own["re"] + 1j * own["im"]
        assert np.allclose(image, recon.cg_sense(v, maps, 15))


def test_maps_do_not_move_with_the_frames(spark):
    """One exchange, of the frames' blocks: no join, and nothing that grows with frames times maps."""
    k = spark.createDataFrame(list(voxel_rows(volume(0), 0)), VOXELS)
    solved = recon.frame_map(k, spark.createDataFrame(list(voxel_rows(volume(1))), MAPS), (6, 5, 2), 3, lambda v, m: v[..., 0])
    plan = solved._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Cartesian" not in plan and "CoGroup" not in plan


def test_failures(spark):
    k = spark.createDataFrame([(0, 0, 0, 0, 0, 1.0, 0.0), (1, 0, 9, 0, 0, 1.0, 0.0), (2, 5, 0, 0, 0, 1.0, 0.0)], VOXELS)  # a place and a channel that don't exist
    status = {r["frame"]: r["status"] for r in volumes.frame_images(k, None, (2, 2, 1), 1, lambda v, m: v[..., 0]).collect()}
    assert status[0] == "ok" and status[1].startswith("failed") and status[2].startswith("failed")
    wrong = spark.createDataFrame([(7, 0, 0, 0, 1.0, 0.0)], MAPS)  # maps that can't be read are nobody's frame
    with pytest.raises(Exception, match="out of bounds"):
        volumes.frame_images(k, wrong, (2, 2, 1), 1, lambda v, m: v[..., 0]).collect()
    assert recon.frame_map(k.limit(0), None, (2, 2, 1), 1, lambda v, m: v[..., 0]).count() == 0


def test_gram_by_batches(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) + 1j * rng.normal(size=(300, 6))
    has = rng.random(x.shape) < 0.7
    has[:, 4] &= ~has[:, 5]  # channels that no sample has together
    has[np.flatnonzero(~has.any(1)), 0] = True
    rows = [(i, c, float(x[i, c].real), float(x[i, c].imag)) for i, c in np.argwhere(has).tolist()]
    samples = spark.createDataFrame(rows, "sample int, coil int, re double, im double").repartition(7)
    y = np.where(has, x, 0)
    for first in (True, False):
        want = y.conj().T @ y / len(y)
        want = want if first else want.conj()
        got = {(r["i"], r["j"]): complex(r["re"], r["im"]) for r in coils.gram(samples, first).collect()}
        assert set(got) == {(i, j) for i in range(6) for j in range(6)} - {(4, 5), (5, 4)}
        assert all(np.isclose(z, want[at]) for at, z in got.items())
    assert coils.gram(samples.limit(0)).count() == 0
    with pytest.raises(Exception, match="too many channels"):
        coils.gram(samples.withColumn("coil", F.col("coil") + 999)).collect()
