"""Wavelet levels on odd axes, and the sparse reconstruction against an independent solver."""

import numpy as np
import pytest

from lumafold.operators import recon


@pytest.mark.parametrize("n", [2, 7, 14, 15, 45, 64])
def test_one_level_keeps_lengths(n):
    w = recon._wavelet_level(n)
    assert w.shape == (2 * ((n + 7) // 2), n) and np.allclose(w.T @ w, np.eye(n), atol=1e-10)


def test_details_of_polynomials_vanish_inside():
    """Four vanishing moments: a cubic has no details away from the ends."""
    w = recon._wavelet_level(40)
    half = len(w) // 2
    details = w[half:] @ (np.linspace(-1, 1, 40) ** 3)
    assert np.abs(details[4:-4]).max() < 1e-8 and np.abs(details).max() > 1e-3


@pytest.mark.parametrize(("shape", "levels"), [((64, 45), 2), ((29, 31, 15), 1), ((64, 5), 3), ((6, 5), 0), ((120, 60, 1), 3)])
def test_levels_adjoint_and_inverse(shape, levels):
    waves, rng = recon.Wavelets(shape), np.random.default_rng(1)
    assert waves.levels == levels
    x = rng.normal(size=shape) + 1j * rng.normal(size=shape)
    parts = waves.forward(x)
    assert np.allclose(waves.back(parts), x, atol=1e-9)
    assert sum((np.abs(p) ** 2).sum() for p in parts) == pytest.approx((np.abs(x) ** 2).sum())
    other = [rng.normal(size=p.shape) for p in parts]
    for (_, corner), part in zip(waves.steps, other[1:], strict=True):
        part[corner] = 0
    ahead = sum(np.vdot(p, q) for p, q in zip(parts, other, strict=True))
    assert ahead == pytest.approx(np.vdot(x, waves.back(other)))


def test_power_iteration():
    a = np.diag([1.0, 5.0, 2.0])
    assert recon.largest_eigenvalue(lambda x: a @ x, (3,)) == pytest.approx(5.0)


def dense(operator, shape):
    eye = np.eye(int(np.prod(shape)))
    return np.stack([operator(row.reshape(shape)) for row in eye], axis=1)


@pytest.mark.parametrize(("l1", "tv"), [(0.02, 0.01), (0.05, 0.0), (0.0, 0.03)])
def test_objective_equals_reweighted_least_squares(l1, tv):
    shape, rng = (15, 14), np.random.default_rng(4)
    y, x = np.mgrid[: shape[0], : shape[1]]
    image = ((np.hypot(y - 7, x - 6) < 5) * 1.0 + (np.hypot(y - 6, x - 8) < 2) * 0.7).astype(complex)
    maps = np.stack([np.exp(-((y - 3) ** 2 + (x - c) ** 2) / 120) * np.exp(0.2j * c) for c in (1, 7, 12)], -1)
    k = recon.fftc(maps * image[..., None], (0, 1)) + 0.01 * rng.normal(size=(*shape, 3))
    k *= (rng.random(shape) < 0.5)[..., None]
    k[3, 4, 0] = 0  # the other channels still say that the place is sampled
    k /= np.percentile(np.abs(k[np.abs(k) > 0]), 99)  # so that the solver's own scale is 1
    mask = np.abs(k).max(-1, keepdims=True) > 0
    a = dense(lambda v: (mask * recon.fftc(maps * v[..., None], (0, 1))).ravel(), shape)
    w = dense(lambda v: np.concatenate([p.ravel() for p in recon.Wavelets(shape).forward(v)]), shape)
    g = dense(lambda v: np.concatenate([(np.roll(v, -1, axis) - v).ravel() for axis in (0, 1)]), shape)
    rows, weights = np.vstack([w, g]), np.concatenate([np.full(len(w), l1), np.full(len(g), tv)])
    v = np.linalg.lstsq(a, k.ravel(), rcond=None)[0]
    for eps in [10.0**-e for e in range(1, 8) for _ in range(25)]:
        lean = weights / np.maximum(np.abs(rows @ v), eps)
        v = np.linalg.solve(a.conj().T @ a + rows.T @ (lean[:, None] * rows), a.conj().T @ k.ravel())
    least = recon.wavelet_tv_objective(v.reshape(shape), k, maps, l1, tv)
    got = [recon.wavelet_tv_objective(recon.wavelet_tv(k, maps, l1, tv, n), k, maps, l1, tv) for n in (20, 200, 2000)]
    assert got[0] > got[1] >= got[2] - 1e-9
    assert got[2] == pytest.approx(least, rel=2e-3) and got[2] <= least * 1.002
