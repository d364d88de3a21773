import numpy as np
import pytest
from pyspark.sql import functions as F

from lumafold.operators import coils, lattice, recon, signal


def coil_toy(n=16):
    y, x = np.mgrid[:n, :n]
    image = np.zeros((n, n), complex)
    image[4:12, 5:11] = 1 + 0.5j
    maps = np.stack([np.exp(-((y - a) ** 2 + (x - b) ** 2) / 200) for a, b in ((0, 0), (0, n), (n, 0), (n, n))], -1).astype(complex)
    return image, maps / np.sqrt((np.abs(maps) ** 2).sum(-1, keepdims=True))


def test_cg_sense():
    image, maps = coil_toy()
    k = recon.fftc(maps * image[..., None], (0, 1))
    assert np.abs(recon.cg_sense(k, maps, 30) - image).max() < 1e-3
    k[1::2] = 0
    assert np.abs(recon.cg_sense(k, maps, 60) - image).max() < 5e-2
    assert not recon.cg_sense(np.zeros_like(k), maps, 5).any() and not recon.cg_sense(k, maps, 0).any()


def test_wavelet_tv_converges_as_weights_fall():
    image, maps = coil_toy()
    k = recon.fftc(maps * image[..., None], (0, 1))
    errors = [np.linalg.norm(recon.wavelet_tv(k, maps, w, w, 300) - image) / np.linalg.norm(image) for w in (1e-2, 1e-3, 1e-5)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-3
    k[1::3] = 0
    assert np.isfinite(recon.wavelet_tv(k, maps, 1e-3, 1e-3, 50)).all()


def test_rss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 8, 4, 3)) + 1j * rng.normal(size=(6, 8, 4, 3))
    k = np.fft.fftshift(np.fft.fftn(np.fft.fftshift(x, (0, 1, 2)), axes=(0, 1, 2)), (0, 1, 2))
    assert np.allclose(recon.rss_image(k), np.sqrt((np.abs(x) ** 2).sum(-1)))


def test_frame_map_isolates_failures(spark):
    rows = [(f, 0, x, y, 0, float(f + x), float(y)) for f in range(3) for x in range(2) for y in range(2)]
    k = spark.createDataFrame(rows, "frame int, coil int, ix int, iy int, iz int, re double, im double")
    maps = spark.createDataFrame([(0, x, y, 0, 1.0, 0.0) for x in range(2) for y in range(2)], "coil int, ix int, iy int, iz int, re double, im double")

    def solve(views, sens):
        if views[0, 0, 0, 0].real == 1:
            raise RuntimeError("bad frame")
        return views[..., 0]

    out = {r["frame"]: r for r in recon.frame_map(k, maps, (2, 2, 1), 1, solve).groupBy("frame").agg(F.first("status").alias("s"), F.sum("re").alias("re")).collect()}
    assert out[0]["s"] == "ok" and out[2]["re"] == 10.0
    assert out[1]["s"].startswith("failed: bad frame") and out[1]["re"] == 0.0


def test_scatter_last_write_wins(spark):
    cells = lattice.lattice(spark, 3, 2)
    samples = spark.createDataFrame([(0, 1, 1, 5.0, 0), (0, 1, 1, 7.0, 1), (0, 2, 0, 3.0, 0)], "frame int, iy int, iz int, v double, echo int")
    got = {(r["iy"], r["iz"]): (r["v"], r["filled"], r["copies"]) for r in recon.scatter(cells, samples, ["v"], [F.desc("echo")]).collect()}
    assert got[1, 1] == (7.0, True, 2) and got[2, 0] == (3.0, True, 1) and got[0, 0] == (0.0, False, 0) and len(got) == 6


def test_dual_echo_decode(spark):
    acq = spark.range(8 + 5 * 4 * 2).select(recon.dual_echo_index(F.col("id"), 5, 2).alias("x"), "id")
    rows = [r for r in acq.collect() if r["x"]]
    assert len(rows) == 38 and all((r["x"]["iz"] * 5 + r["x"]["iy"]) * 2 + r["x"]["echo"] == r["id"] - 10 for r in rows)


def test_whitening_and_compression(spark):
    rng = np.random.default_rng(0)
    n, c = 2000, 4
    mix = rng.normal(size=(c, c)) + 1j * rng.normal(size=(c, c))
    x = (rng.normal(size=(n, c)) + 1j * rng.normal(size=(n, c))) @ mix
    noise = spark.createDataFrame([(i, k, float(x[i, k].real), float(x[i, k].imag)) for i in range(n) for k in range(c)], "sample int, coil int, re double, im double")
    white = coils.matrix_of(coils.gram(coils.mixed(noise, coils.whitening(noise), True)))
    assert np.allclose(white, np.eye(c), atol=1e-6)
    low = np.outer(rng.normal(size=8), rng.normal(size=3)) @ np.diag([3, 2, 1])
    assert coils.channels_for_energy(low @ low.T, 0.95, 1) == 1 and coils.channels_for_energy(low @ low.T, 0.95, 4) == 4
    v = coils.compression(coils.matrix_of(coils.gram(noise, False)), 2)
    assert np.allclose(v @ v.conj().T, np.eye(2))


def test_sensitivity_maps_recover_a_square():
    image, maps = coil_toy(24)
    image[2:22, 2:22] = 1
    found, eigen = coils.sensitivity_maps(recon.fftc(maps * image[..., None], (0, 1)), kernel=5)
    inside = np.s_[8:16, 8:16]
    ratio = (np.abs(found[inside]) * np.abs(maps[inside])).sum(-1)
    assert ratio.min() > 0.98 and eigen[inside].min() > 0.8


def test_spline_weights():
    w = recon.spline_weights(9, 17)
    assert np.allclose(w.sum(1), 1) and np.allclose(w[::2], np.eye(9), atol=1e-9)


def phase_lines(nx, etl, a0, a1, seed, drift=0.0):
    rng = np.random.default_rng(seed)
    profile = np.exp(-(((np.arange(nx) - nx / 2 + 0.5) / (nx / 4)) ** 2))
    coils_ = rng.normal(size=4) + 1j * rng.normal(size=4)
    x = (np.arange(nx) - nx / 2 + 0.5) / nx
    rows = []
    for e in range(etl):
        phase = drift * e + ((a0 + a1 * x) if e % 2 else 0)
        for c in range(4):
            z = coils_[c] * profile * np.exp(1j * phase)
            rows += [(e, c, i, float(z[i].real), float(z[i].imag)) for i in range(nx)]
    return rows


@pytest.mark.parametrize("a0,a1", [(0.7, -1.3), (0.4, 0.9)])
def test_odd_even_phase(spark, a0, a1):
    lines = spark.createDataFrame(phase_lines(64, 20, a0, a1, 42), "echo int, coil int, ix int, re double, im double")
    got = recon.odd_even_phase(lines, 64, 20).first()
    assert got["a0"] == pytest.approx(a0, abs=1e-6) and got["a1"] == pytest.approx(a1, abs=1e-6)
    fixed = recon.phase_corrected(lines, 64, got["a0"], got["a1"])
    again = recon.odd_even_phase(fixed, 64, 20).first()
    assert abs(again["a0"]) < 1e-6 and abs(again["a1"]) < 1e-6


def test_moving_average_vector(spark):
    rows = spark.createDataFrame([(0, i, float(i)) for i in range(6)], "g int, i int, v double")
    got = [r["smooth"] for r in signal.moving_average(rows, ["g"], ["i"], "v", 3).orderBy("i").collect()]
    assert got == [0.5, 1, 2, 3, 4, 4.5]
    with pytest.raises(ValueError):
        signal.moving_average(rows, ["g"], ["i"], "v", 4)


def test_unwrap_equals_numpy(spark):
    phase = np.angle(np.exp(1j * np.cumsum(np.random.default_rng(1).normal(0, 2, 60))))
    rows = spark.createDataFrame([(0, i, float(p)) for i, p in enumerate(phase)], "g int, i int, p double")
    got = [r["unwrapped"] for r in signal.unwrap(rows, ["g"], ["i"], "p").orderBy("i").collect()]
    assert np.allclose(got, np.unwrap(phase))


def test_long_convolution_equals_direct(spark):
    rng = np.random.default_rng(2)
    g, kernel = rng.normal(size=5000), rng.normal(size=300)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(g)], "ch int, i long, g double")
    for chunk in (128, 1024):
        got = [r["p"] for r in signal.long_convolution(rows, kernel, chunk).orderBy("i").collect()]
        assert np.allclose(got, np.convolve(g, kernel)[:5000])


def test_shift_extrapolates_lines(spark):
    rows = spark.createDataFrame([(0, i, 0.37 * i) for i in range(20)], "g int, i int, v double")
    got = [r["shifted"] for r in signal.shifted_samples(rows, ["g"], "v", 3.0).orderBy("i").collect()]
    assert np.allclose(got, 0.37 * (np.arange(20) - 3))


def test_gridding_finds_the_object(spark):
    nx, fov = 48, 20.0
    u = np.linspace(-1, 1, 200)
    kx = nx / (2 * fov) * np.sign(u) * np.abs(u) ** 1.5
    where = 4.0
    rows = [(p, i, float(k * (1.05 if p else 1))) for p in (0, 1) for i, k in enumerate(kx)]
    weights = recon.gridding_weights(spark.createDataFrame(rows, "parity int, i int, kx double"), nx, fov)
    samples = []
    for e in (0, 1):
        s = np.exp(-2j * np.pi * kx * (1.05 if e else 1) * where)
        samples += [(e, i, float(z.real), float(z.imag)) for i, z in enumerate(s)]
    lines = recon.grid_readouts(spark.createDataFrame(samples, "echo int, i int, re double, im double"), weights, ["echo"])
    for e in (0, 1):
        top = lines.where(F.col("echo") == e).orderBy(F.desc(F.hypot("re", "im"))).first()
        assert abs((top["ix"] - nx / 2) * fov / nx - where) <= fov / nx


def test_best_delay(spark):
    rows = [(-1.0, 0.0, 0.5, 0), (0.0, 0.0, -0.1, 0), (1.0, 0.0, 0.01, 2)]
    report = spark.createDataFrame(rows, "delay double, a1 double, a2 double, wrap_count int")
    assert recon.best_delay(report).first()["delay"] == 0.0
    assert recon.best_delay(report.where("wrap_count > 0")).first()["delay"] == 1.0
