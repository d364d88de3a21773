"""The delay sweep in one plan, against a loop over candidates in numpy."""

import numpy as np
import pytest

from lumafold.operators import pipeline, recon


def smoothed(x, span):
    half = span // 2
    return np.array([x[max(0, i - half) : i + half + 1].mean() for i in range(len(x))])


def fitted(x, threshold=0.1):
    """a0, a1 and the phases [nx, pairs] of a train [nx, etl, coils] in image space."""
    nx, etl, _ = x.shape
    pairs = etl // 2
    xe = x[nx // 2 - 1, 1::2]
    turn = np.unwrap(np.angle(xe), axis=0)
    turn = turn - turn[(pairs - 1) // 2]
    drift = smoothed(np.unwrap(np.angle((np.abs(xe) ** 2 * np.exp(1j * turn)).sum(1))), 1 if pairs < 10 else 5)
    slope, start = np.polyfit(np.arange(2, etl + 1, 2), drift, 1)
    fixed = x * np.exp(-1j * (start + slope * np.arange(1, etl + 1)))[None, :, None]
    strength = np.sqrt((np.abs(fixed) ** 2).sum(2))
    mask = strength > threshold * strength.max()
    mask[: int(nx / 4 + 0.5)] = False
    mask[int(3 * nx / 4 + 0.5) - 1 :] = False
    first, second = fixed[:, 0::2], fixed[:, 1::2]
    th = np.angle((np.abs(second) ** 2 * np.exp(1j * np.angle(second / first))).sum(2))
    mask = mask[:, pairs:]
    mask[:, : pairs // 2] = False
    at = np.broadcast_to(((np.arange(nx) - nx / 2 + 0.5) / nx)[:, None], th.shape)
    a1, a0 = np.polyfit(at[mask], th[mask], 1)
    return a0, a1, th


def swept(samples, kx, nx, fov, delays):
    """The report for samples [i, etl, coils] and trajectories [parity][i]."""
    n, etl, _ = samples.shape
    out = {}
    for d in delays:
        x = np.zeros((nx, etl, samples.shape[2]), complex)
        for parity in (0, 1):
            at = np.arange(n) - 0.5 - d
            j = np.clip(np.floor(at).astype(int), 0, n - 2)
            k = kx[parity][j] + (at - j) * (kx[parity][j + 1] - kx[parity][j])
            w = np.append(np.abs(np.diff(k)), 0.0)
            w /= w.sum()
            turn = np.exp(2j * np.pi * np.outer((np.arange(nx) - nx / 2) * fov / nx, k)) * w
            x[:, parity::2] = np.einsum("xi,iec->xec", turn, samples[:, parity::2])
        a0, a1, th = fitted(x)
        middle = th[int(nx / 4 + 0.5) : int(3 * nx / 4 + 0.5), th.shape[1] // 2 :]
        out[d] = (a0, a1, int((np.abs(np.diff(middle, axis=0)) > np.pi).sum()))
    return out


@pytest.fixture(scope="module")
def scan(spark):
    """Two channels, a drift along echoes, a trajectory that is off by 1.5 samples; nx = 30 meets the rounding of halves."""
    rng, nx, etl, n, fov = np.random.default_rng(5), 30, 24, 48, 20.0
    ramp = np.cumsum(np.minimum(np.minimum(np.arange(n) + 1, n - np.arange(n)), 6)).astype(float)
    kx = (ramp - ramp.mean()) / np.ptp(ramp) * nx / fov
    true = np.interp(np.arange(n) - 0.5 - 1.5, np.arange(n), kx)
    places = np.linspace(-6, 6, 40)
    samples = np.zeros((2, n, etl, 2), complex)
    for e in range(etl):
        k = true if e % 2 == 0 else -true
        for c in (0, 1):
            gain = np.exp(-(((places - 3 * (2 * c - 1)) / 6) ** 2)) * np.exp(0.5j * c)
            line = (np.exp(-2j * np.pi * np.outer(k, places)) * gain).sum(1) * np.exp(1j * (0.05 * e + 0.4 * (e % 2)))
            samples[:, :, e, c] = line + rng.normal(size=(2, n)) * 0.05
    rows = [(s, e, c, i, float(samples[s, i, e, c].real), float(samples[s, i, e, c].imag)) for s in range(2) for i in range(n) for e in range(etl) for c in range(2)]
    shots = spark.createDataFrame(rows, "shot int, echo int, coil int, i int, re double, im double")
    trajectory = spark.createDataFrame([(p, i, float(k if p == 0 else -k)) for p in (0, 1) for i, k in enumerate(kx)], "parity int, i int, kx double")
    return shots, trajectory, samples.mean(0), [kx, -kx], nx, etl, fov


@pytest.mark.parametrize("sent", [True, False])
def test_sweep_equals_a_loop(scan, monkeypatch, sent):
    shots, trajectory, mean, kx, nx, etl, fov = scan
    if not sent:
        monkeypatch.setattr(pipeline, "TRAIN_SENT", 0)
    delays = [round(-6 + 0.05 * k, 2) for k in range(241)] if sent else [-6.0, 0.0, 1.5, 6.0]
    got = pipeline.delay_report(shots, trajectory, nx, etl, fov, delays)
    want = swept(mean, kx, nx, fov, delays)
    rows = {r["delay"]: r for r in got.collect()}
    assert sorted(rows) == sorted(delays)
    for d in delays:
        a0, a1, wraps = want[d]
        assert rows[d]["wrap_count"] == wraps, d
        assert rows[d]["a1"] == pytest.approx(a0, abs=1e-6) and rows[d]["a2"] == pytest.approx(a1, abs=1e-6)
    assert abs(recon.best_delay(got).first()["delay"] - 1.5) < 0.2


def test_plan_does_not_grow(scan):
    shots, trajectory, _, _, nx, etl, fov = scan
    depth = lambda n: pipeline.delayed_weights(trajectory, [0.1 * k for k in range(n)])._jdf.queryExecution().analyzed().treeString().count("\n")
    assert depth(3) == depth(200)


def test_an_odd_last_echo_is_left_out(scan, spark):
    shots, trajectory, mean, kx, nx, etl, fov = scan
    got = pipeline.delay_report(shots.where(f"echo < {etl - 1}"), trajectory, nx, etl - 1, fov, [1.5]).first()
    a0, a1, wraps = swept(mean[:, : etl - 2], kx, nx, fov, [1.5])[1.5]
    assert (got["a1"], got["a2"]) == pytest.approx((a0, a1), abs=1e-6) and got["wrap_count"] == wraps
