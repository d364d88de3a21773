"""Discs: distances by brute force, exact counts, speed."""

import time

import numpy as np
import pytest

from lumafold.operators import disc


def radii(ny, nz, slope):
    y, z = np.mgrid[:ny, :nz]
    rho = np.hypot((y - ny / 2) / (ny / 2), (z - nz / 2) / (nz / 2))
    r = 1 + rho * slope
    return np.maximum(r * ny / max(ny, nz), 1), np.maximum(r * nz / max(ny, nz), 1)


@pytest.mark.parametrize(("ny", "nz", "slope"), [(40, 30, 2.0), (30, 40, 0.0), (25, 25, 25.0), (1, 20, 3.0), (64, 20, 4.5)])
def test_no_sample_lies_in_an_earlier_ellipse(ny, nz, slope):
    """Of two samples, at least one lies outside the other's ellipse (the earlier one's); the set can't be extended by much."""
    ry, rz = radii(ny, nz, slope)
    mask = disc.disc_points(ry, rz, np.zeros((ny, nz), bool), 60, np.random.default_rng(7))
    at = np.argwhere(mask)
    d2 = lambda p, q: ((p[0] - q[0]) / ry[tuple(q)]) ** 2 + ((p[1] - q[1]) / rz[tuple(q)]) ** 2
    for i, p in enumerate(at):
        for q in at[i + 1 :]:
            assert d2(p, q) >= 1 or d2(q, p) >= 1
    if ry.max() > min(ny, nz) / 4:
        return  # candidates of wide ellipses leave the grid, so growth may end early
    # Growth fills the grid: hardly any cell is outside of every sample's ellipse.
    y, z = np.mgrid[:ny, :nz]
    covered = np.zeros((ny, nz), bool)
    for q in at:
        covered |= ((y - q[0]) / ry[tuple(q)]) ** 2 + ((z - q[1]) / rz[tuple(q)]) ** 2 < 1
    assert (~covered).mean() < 0.06


def test_uniform_radius_keeps_its_distance():
    ry = rz = np.full((50, 50), 3.0)
    at = np.argwhere(disc.disc_points(ry, rz, np.zeros((50, 50), bool), 30, np.random.default_rng(1))).astype(float)
    gaps = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
    np.fill_diagonal(gaps, np.inf)
    assert gaps.min() >= 3.0 and gaps.min(axis=1).max() < 6.0


@pytest.mark.parametrize(("ny", "nz", "accel", "calib"), [(60, 50, 6, 0.1), (90, 60, 10, 0.0), (32, 32, 2.5, 0.2)])
def test_exact_counts_and_calibration(ny, nz, accel, calib):
    for seed in range(3):
        mask = disc.disc_mask(ny, nz, accel, seed, calib)
        assert mask.sum() == int(ny * nz / accel)
        assert (mask == disc.disc_mask(ny, nz, accel, seed, calib)).all()
        if calib:
            y, z = np.mgrid[:ny, :nz]
            core = np.sqrt(4 * calib * int(ny * nz / accel) / (np.pi * ny * nz))
            assert mask[np.hypot((y - ny / 2) / (ny / 2), (z - nz / 2) / (nz / 2)) <= core].all()
    near, far = mask[ny // 4 : 3 * ny // 4, nz // 4 : 3 * nz // 4].mean(), mask.mean()
    assert near > far  # denser in the middle


def test_a_frame_is_quick():
    disc.disc_mask(90, 60, 10, 0)
    start = time.perf_counter()
    for seed in range(5):
        disc.disc_mask(90, 60, 10, seed)
    assert (time.perf_counter() - start) / 5 < 1.0  # measured: see README
