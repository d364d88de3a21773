import numpy as np
import pytest
from pyspark.sql import functions as F

from lumafold.operators import assembly, config, events, feasibility, lattice, ordering, registry, schedule
from lumafold.sources import images, loopfile
from lumafold.streaming import frames

READOUT = assembly.Readout(1e-4, 3e-4, 1e-4, 5e-4, 100)
HEAD = {"fatsat": 0.01, "spoil": 0.002, "rf": 0.004, "rephase": 0.001, "prephase": 0.001}


def test_program_integrates_to_its_schedule(spark):
    mask = lattice.sampling_masks(spark, "caipi", 16, 12, 2, 8).where("sampled")
    plan = ordering.plan_schedule(mask, "laminar", 16, 12, 8)
    program = assembly.echo_train(plan, 3, 8, READOUT, HEAD, {"spoil_end": 0.002, "tr_delay": 0.01})
    back = assembly.integrated_places(program)
    assert schedule.set_difference(back, plan.select("frame", "shot", "echo", "iy", "iz")).count() == 0
    n = program.count()
    assert n == 2 * 3 * (5 + 8 + 2) and program.agg(F.countDistinct("n"), F.min("n"), F.max("n")).first()[:] == (n, 1, n)
    flat = assembly.echo_train(plan, 3, 8, READOUT, HEAD, {}, scale=0.0)
    assert flat.where("kind = 'echo' AND (sy <> 0 OR sz <> 0)").count() == 0
    assert assembly.one_repetition(program.where("frame = 0"), 0).agg(F.max("start")).first()[0] > 0


def test_dual_echo_and_noise_programs(spark):
    times = {"rf": 0.002, "prephase": 0.001, "readout": 0.002, "rewind": 0.001, "spoil": 0.001, "tr_delay": 0.001}
    program = assembly.dual_echo_program(spark, 6, 3, (0.005, 0.008), times)
    assert program.count() == (4 + 1 + 3) * 6 * 2 * 7
    assert program.where("iz < 0 AND adc").count() == 0
    with pytest.raises(ValueError):
        assembly.dual_echo_program(spark, 6, 3, (0.001,), times)
    noise = assembly.noise_program(spark, 8, 500, 0.01, 0.0)
    assert noise.count() == 4 and noise.orderBy(F.desc("n")).first()["kind"] == "rf"


def test_readout_design():
    r = assembly.Readout.design(240, 0.216, 4e-6, config.GAMMA, 0.05, 100.0, 4e-6, 3, 2, 1 / 0.216, 1 / 0.0405)
    assert r.samples % 4 == 0 and r.echo == pytest.approx(2 * r.ramp + r.flat)


def test_parents_and_sessions(spark):
    blocks = spark.createDataFrame([(1, "a", 0.1), (2, "b", 0.2), (3, "a", 0.1 + 5e-7), (4, "b", 0.3)], "n long, kind string, duration double")
    near = {r["n"]: r["parent_n"] for r in events.tolerant_parents(blocks, "kind").collect()}
    assert near == {1: 1, 2: 2, 3: 1, 4: 4}
    log = spark.createDataFrame([(0, i, i in (1, 4)) for i in range(6)], "k int, n int, opens boolean")
    got = [(r["instance"], r["j"]) for r in events.sessions(log, ["k"], ["n"], F.col("opens")).orderBy("n").collect()]
    assert got == [(0, 1), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]


def test_stimulation_chunks_agree(spark):
    g = np.cumsum(np.random.default_rng(0).normal(size=5000)) * 1e-4
    wave = spark.createDataFrame([(c, i, float(v * (c + 1))) for c in (0, 1) for i, v in enumerate(g)], "ch int, i long, g double")
    kernel = feasibility.stimulation_kernel(70.0, 334e-6, 4e-6)
    s = np.concatenate([[0], np.diff(g)]) / 4e-6
    p = 100 * np.convolve(s, kernel)[:5000]
    want = np.sqrt((0.8 * p) ** 2 + (2 * p) ** 2)
    got = [r["pns"] for r in feasibility.stimulation(wave, 70.0, 334e-6, 4e-6, (0.8, 1.0), 1000).orderBy("i").collect()]
    assert np.allclose(got, want)


@pytest.mark.parametrize("pns,acoustics,ok,flag", [(50.0, 0.1, True, "ok"), (81.0, 0.1, True, "WARN"), (101.0, 0.1, False, "FAIL"), (50.0, 0.9, False, "FAIL")])
def test_report(spark, pns, acoustics, ok, flag):
    values = spark.createDataFrame([(1.0, 2.0, 0.1, pns, acoustics, 5.0, 20.0, 0.2, 100.0, 0.3)], "max_grad double, max_slew double, max_b1 double, peak_pns double, acoustics double, spec_grad double, spec_slew double, spec_b1 double, spec_pns double, spec_acoustics double")
    row = feasibility.report(values).first()
    assert row["ok"] is ok and flag in row["summary"]


def test_trapezoids():
    for area in (1e-6, 1e-4, 1e-2):
        t = feasibility.least_trapezoid(area, 0.05, 100.0, 4e-6)
        assert t["amplitude"] * (t["flat"] + t["rise"]) == pytest.approx(area) and abs(t["amplitude"]) <= 0.05 + 1e-9


def test_registry(spark):
    entries = spark.createDataFrame([(0, 5.0), (1, 9.0), (3, 1.0)], "entry int, mtime double")
    assert [r["entry"] for r in registry.candidates(entries, 5).orderBy("rank").collect()] == [2, 4, 3, 0, 1]
    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "basename string, place int")
    assert {r["basename"]: r["entry"] for r in registry.allocate(files, entries, 5).collect()} == {"a": 2, "b": 4, "c": 3}
    lines = spark.createDataFrame([("12.5 pge7.entry",), ("junk",), ("3 x y",)], "value string")
    assert [tuple(r) for r in registry.parse_entries(lines).collect()] == [(7, 12.5)]
    runs = registry.parse_runs(lines)
    assert [tuple(r) for r in runs.collect()] == [("x y", 3)]
    reused, new = registry.split_reused(files, spark.createDataFrame([("a", 4)], "basename string, entry int"))
    assert reused.count() == 1 and new.count() == 2
    first, spare = registry.padded(entries, 2, 100)
    assert first.count() == 2 and spare.count() == 10


def test_settings(spark):
    e = config.overridden(config.Experiment(), accel=6)
    assert e.samples == 1800 and config.one_row(spark, e).first()["accel"] == 6
    with pytest.raises(TypeError):
        config.overridden(e, speed=2)
    s = config.Session("/d/", ("a",), delay={"a": 1.5})
    assert s.delay_of("a") == 1.5
    with pytest.raises(KeyError):
        s.delay_of("b")
    old = config.scalars(spark.createDataFrame([(1,)], "nx int")).first()
    assert old["n_echoes"] == 1 and old["te_degre"] is None


def test_loop_file_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    parents = [
        loopfile.Parent(1, 0.5, loopfile.Pulse(np.array([0.5, 1.0, 1.5]), np.array([0.0, 2.0, 1.0]), np.array([0.0, 0.5, 1.0]), 0.25, 0.125), (loopfile.Gradient(0.5, 1, 2, 1), None, None)),
        loopfile.Parent(2, 0.25, None, (loopfile.Gradient(0.0, times=np.arange(4) * 0.25, waveform=np.arange(4.0)), loopfile.Gradient(0.0, times=np.array([0, 0.25, 1.0]), waveform=np.array([0, 1.0, 0])), None), (64, 0.5, 0.25)),
    ]
    loop = rng.integers(0, 100, (7, 23)).astype(float)
    content = loopfile.LoopFile(parents, [loopfile.SegmentDef(1, [1, 2, 0], 3)], loop, (1.0, 0.5, 0.25, 0.125, 2.0), 7, 1, 6)
    raw = loopfile.encode(content)
    back = loopfile.decode(raw)
    assert loopfile.encode(back) == raw and (back.loop == loop).all() and back.segments[0].blocks == [1, 2, 0]
    for bad in (raw + b"\0", raw[:-1], b"\0\0" + raw[2:]):
        with pytest.raises(ValueError):
            loopfile.decode(bad)
    (tmp_path / "a.pge").write_bytes(raw)
    assert loopfile.read_loops(spark, str(tmp_path)).count() == 7 * 23
    assert registry.list_files(spark, str(tmp_path)).count() == 1


def test_images_and_maps(spark, tmp_path):
    image = spark.createDataFrame([(f, 0, 0, 0, 3.0, 4.0) for f in range(2)], "frame int, ix int, iy int, iz int, re double, im double")
    images.save_image(image, str(tmp_path / "i"), (0.2, 0.3, 0.4), (2, 3, 4), name="x")
    assert [r["value"] for r in images.read_frame(spark, str(tmp_path / "i/image"), 1).collect()] == [5.0]
    side = spark.read.json(str(tmp_path / "i/sidecar")).first()
    assert side["voxel_mm"] == [100.0, 100.0, 100.0] and side["attributes"] == '{"name":"x"}'
    assert images.cached_maps(spark, str(tmp_path / "none"), 4) is None
    images.write_maps(image, str(tmp_path / "m"), 4)
    assert images.cached_maps(spark, str(tmp_path / "m"), 4).count() == 2 and images.cached_maps(spark, str(tmp_path / "m"), 5) is None


def test_stream_survives_a_restart(spark, tmp_path):
    schema = "acq long, coil int, re double"
    shots = lambda a, b: spark.createDataFrame([(i, c, float(10 * i + c)) for i in range(a, b) for c in (0, 1)], schema)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    shots(0, 6).coalesce(1).write.parquet(source)
    run = lambda: frames.write_frames(frames.read_shots(spark, source, schema, 1), 4, out, check).awaitTermination()
    run()
    assert spark.read.parquet(f"{out}/frames").select("frame").distinct().count() == 1
    assert [tuple(r) for r in frames.missing_frames(spark, out, 4, 2).collect()] == [(1, 2)]
    shots(6, 8).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    done = spark.read.parquet(f"{out}/frames")
    assert done.count() == 16 and done.where("frame <> floor(acq / 4)").count() == 0


def test_event_windows(spark, sf):
    from lumafold.session import table

    events_ = table(spark, sf, "events")
    assert frames.event_windows(events_).agg(F.sum("n")).first()[0] == events_.count()


def test_pulses():
    from lumafold.operators import pulses

    limits = {"max_grad": 0.05, "max_slew": 100.0, "raster": 4e-6}
    p = pulses.excitation_pulse(10.0, 0.004, 6.0, 0.04, **limits)
    assert p.duration == pytest.approx(0.004) and p.magnitude.sum() * p.raster == pytest.approx(10 / 360) and p.peak_gauss > 0
    assert pulses.fat_pulse(90.0, 0.01, 2.0, 3.0, 4e-6).offset < 0
    with pytest.raises(ValueError):
        pulses.excitation_pulse(10.0, 0.0001, 60.0, 0.001, **limits)
    for t, n, f in zip(pulses.prephasers((240, 240, 45), (0.2, 0.2, 0.04), **limits), (240, 240, 45), (0.2, 0.2, 0.04), strict=True):
        assert t["amplitude"] * (t["flat"] + t["rise"]) == pytest.approx(-n / 2 / f)
    assert pulses.spoilers((240, 240, 45), (0.2, 0.2, 0.04), 4, **limits)[0]["amplitude"] > 0


def test_export_checks_before_it_writes(spark):
    from lumafold.operators import pipeline

    schema = "max_grad double, max_slew double, max_b1 double, peak_pns double, acoustics double, spec_grad double, spec_slew double, spec_b1 double, spec_pns double, spec_acoustics double"
    good = feasibility.report(spark.createDataFrame([(1.0, 2.0, 0.1, 50.0, 0.1, 5.0, 20.0, 0.2, 100.0, 0.3)], schema))
    bad = feasibility.report(spark.createDataFrame([(9.0, 2.0, 0.1, 50.0, 0.1, 5.0, 20.0, 0.2, 100.0, 0.3)], schema))
    content = loopfile.LoopFile([], [], np.zeros((1, 23)))
    assert loopfile.decode(pipeline.export_loops({"a": good}, {"a": content})["a"]).loop.shape == (1, 23)
    with pytest.raises(ValueError, match="grad"):
        pipeline.export_loops({"a": good, "b": bad}, {"a": content, "b": content})


def test_raw_shots_to_image(spark):
    """A fully sampled object through whitening, compression, gridding, correction and combination."""
    from lumafold.operators import pipeline, recon

    nx, ny, ncoil = 16, 4, 3
    rng = np.random.default_rng(3)
    image = np.zeros((nx, ny))
    image[5:11, 1:3] = 1.0
    sens = rng.normal(size=ncoil) + 1j * rng.normal(size=ncoil)
    kx = (np.arange(nx) - nx / 2) / 20.0
    ky = np.fft.fftshift(np.fft.fft(np.fft.fftshift(image, 1), axis=1), 1)
    x = (np.arange(nx) - nx / 2) * 20.0 / nx
    rows = []
    for e in range(ny):
        line = np.exp(-2j * np.pi * np.outer(kx, x)) @ ky[:, e]
        line = line * np.exp(1j * 0.4) if e % 2 else line
        rows += [(0, 0, e, c, i, float((line[i] * sens[c]).real), float((line[i] * sens[c]).imag)) for c in range(ncoil) for i in range(nx)]
    shots = spark.createDataFrame(rows, "frame int, shot int, echo int, coil int, i int, re double, im double")
    plan = spark.createDataFrame([(0, 0, e, e, 0) for e in range(ny)], "frame int, shot int, echo int, iy int, iz int")
    trajectory = spark.createDataFrame([(p, i, float(k)) for p in (0, 1) for i, k in enumerate(kx)], "parity int, i int, kx double")
    weights = recon.gridding_weights(trajectory, nx, 20.0)
    volume = pipeline.kspace_volume(shots, plan, np.eye(ncoil), np.eye(ncoil), weights, (0.4, 0.0), nx, ny, 1)
    assert pipeline.duplicate_places(plan).first()["duplicates"] == 0
    found = np.zeros((nx, ny, ncoil), complex)
    for r in volume.collect():
        found[r["ix"], r["iy"], r["coil"]] = complex(r["re"], r["im"])
    lines = np.fft.fftshift(np.fft.ifft(np.fft.fftshift(found, 1), axis=1), 1)
    got = np.sqrt((np.abs(lines) ** 2).sum(-1))
    assert np.corrcoef(got.ravel(), image.ravel())[0, 1] > 0.95
    out = pipeline.reconstruct(volume, lambda: pytest.fail("rss needs no maps"), (nx, ny, 1), ncoil, "rss")
    assert out.count() == nx * ny and out.where("status <> 'ok'").count() == 0 and pipeline.empty_frames(out).count() == 0
    with pytest.raises(ValueError):
        pipeline.reconstruct(volume, volume, (nx, ny, 1), ncoil, "magic")


def test_delay_report_and_figures(spark):
    from lumafold.operators import pipeline, recon

    nx, etl = 32, 8
    kx = np.linspace(-nx / 40, nx / 40, 40, endpoint=False)
    rows = []
    for e in range(etl):
        s = sum(np.exp(-2j * np.pi * kx * p) for p in np.linspace(-4, 4, 9)) * np.exp(1j * (0.3 if e % 2 else 0.0))
        rows += [(0, e, 0, i, float(s[i].real), float(s[i].imag)) for i in range(len(kx))]
    shots = spark.createDataFrame(rows, "shot int, echo int, coil int, i int, re double, im double")
    trajectory = spark.createDataFrame([(p, i, float(k)) for p in (0, 1) for i, k in enumerate(kx)], "parity int, i int, kx double")
    report = pipeline.delay_report(shots, trajectory, nx, etl, 20.0, [-1.0, 0.0, 1.0])
    assert report.count() == 3 and recon.best_delay(report).count() == 1
    mask = lattice.sampling_masks(spark, "caipi", 8, 8, 2, 4)
    assert pipeline.mask_figure(mask, 1, 8, 8, 0.2, 0.2).count() == 64
    assert pipeline.run_all(["a", "b"], lambda n: spark.range(1) if n == "a" else spark.table("nowhere"))["b"].startswith("failed")


def test_loop_file_bytes():
    """The layout, written out by hand."""
    import struct

    pulse = loopfile.Pulse((np.arange(4) + 0.5) * 2.0, np.array([1.0, 4.0, 2.0, 0.0]), np.zeros(4), 8.0, 0.5)
    corner = loopfile.Pulse(np.array([0.0, 1.0]), np.array([2.0, 2.0]), np.array([0.0, 1.0]), 1.0, 0.0)
    center = loopfile.Gradient(0.25, times=np.array([1.0, 3.0]), waveform=np.array([-2.0, 1.0]))
    edge = loopfile.Gradient(0.0, times=np.array([0.0, 4.0]), waveform=np.array([0.0, -8.0]))
    parents = [loopfile.Parent(1, 0.5, pulse, (loopfile.Gradient(1, 2, 3, 4), center, edge), None), loopfile.Parent(2, 0.25, corner, (None, None, None), (64, 0.5, 0.125))]
    content = loopfile.LoopFile(parents, [loopfile.SegmentDef(1, [1, 0], 7), loopfile.SegmentDef(2, [2, -1], 9)], np.array([[1.0, 2.0]]), (1.0, 0.5, 0.25, 0.125, 2.0), 3, 1, 4)
    want = struct.pack("<hh", 47, 2)
    want += struct.pack("<if", 1, 0.5) + struct.pack("<hhif", 1, 1, 4, 2.0) + struct.pack("<8f", 0.25, 1.0, 0.5, 0.0, 0, 0, 0, 0) + struct.pack("<3f", 8.0, 0.5, 2 * (0.0625 + 1 + 0.25))
    want += struct.pack("<h4f", 1, 1, 2, 3, 4) + struct.pack("<hfif2f", 2, 0.25, 2, 2.0, -1.0, 0.5) + struct.pack("<hfif4f", 3, 0.0, 2, 0.0, 0.0, 4.0, 0.0, -1.0) + struct.pack("<hh", 0, 0)
    want += struct.pack("<if", 2, 0.25) + struct.pack("<hhif", 2, 1, 2, 1.0) + struct.pack("<6f", 0.0, 1.0, 1.0, 1.0, 0.0, 1.0) + struct.pack("<3f", 1.0, 0.0, 1.0)
    want += struct.pack("<hhh", 0, 0, 0) + struct.pack("<hiff", 1, 64, 0.5, 0.125) + struct.pack("<h", 0)
    want += struct.pack("<h", 2) + struct.pack("<hhhhih", 1, 2, 1, 0, 7, 1) + struct.pack("<hhhhih", 2, 2, 2, -1, 9, 0)
    want += struct.pack("<ih2f", 1, 2, 1.0, 2.0) + struct.pack("<5f3i", 1.0, 0.5, 0.25, 0.125, 2.0, 3, 1, 4)
    assert loopfile.encode(content) == want
    assert loopfile.encode(loopfile.decode(want)) == want
