"""Block logs to loops and waveforms, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumafold.operators import convert, events, feasibility
from lumafold.plans import logs

GRAD = "struct<delay:double,rise:double,flat:double,fall:double,amplitude:double>"
LOG = f"n long, duration double, trid int, rf struct<shape:string,amplitude:double,phase:double,freq:double>, gx {GRAD}, gy {GRAD}, gz {GRAD}, adc struct<samples:int,dwell:double,phase:double,freq:double>, trigger string"


def program(shots=30, wrong=False):
    """A leading block, then shots of two kinds: pulse, delay (variable in the second kind), readout."""
    rows = [(0.001, None, None, None, None, None, None, None)]
    for k in range(shots):
        scale = 1.0 + k % 5
        trap = lambda a: (0.0, 2e-5, 4e-5, 2e-5, a)
        rows.append((2e-4, 5 if k % 3 else 9, ("sinc", 100.0 * scale, 0.1 * k, 0.0), None, None, trap(50.0 * scale), None, None))
        rows.append((1e-4 * (1 + k % 2 if k % 3 else 1), None, None, None, None, None, None, None))
        rows.append((2e-4, None, None, trap(1000.0 * scale), trap(-200.0), None, (64, 4e-6, 0.2 * k, 0.0), "physio1" if k == 3 else None))
        if k % 3:
            rows.append((4e-4 if wrong and k == 10 else 2e-4, None, None, None, trap(10.0), None, None, None))
    return [(n, *r) for n, r in enumerate(rows, 1)]


@pytest.mark.parametrize("chunk", [7, 65_536])
def test_block_log_to_loop(spark, monkeypatch, chunk):
    monkeypatch.setattr(convert.with_instances, "__defaults__", (chunk,))
    log = program()
    loop = convert.to_loop(spark.createDataFrame(log, LOG))
    segments = [tuple(r) for r in loop.segments.select("seg_id", "trid", "n_instances", "first_row", "n_blocks", "strongest_row").orderBy("seg_id").collect()]
    starts = {t: [r[0] for r in log if r[2] == t] for t in (5, 9)}
    energy = {r[0]: sum(g[4] ** 2 * (g[1] / 3 + g[2] + g[3] / 3) for g in r[4:7] if g) for r in log}
    of = lambda s, k: sum(energy[s + j] for j in range(k))
    best = [max(starts[t], key=lambda s: (round(of(s, k), 9), -s)) for t, k in ((5, 4), (9, 3))]
    assert segments == [(1, 5, 20, starts[5][0], 4, best[0]), (2, 9, 10, starts[9][0], 3, best[1])]
    places = {(r["seg_id"], r["j"]): r["block_id"] for r in loop.positions.collect()}
    assert places == {(1, 1): 1, (1, 2): -1, (1, 3): 2, (1, 4): 3, (2, 1): 1, (2, 2): 0, (2, 3): 2}
    assert loop.parents.count() == 3 and loop.issues.count() == 0
    rows = {r["n"]: r for r in loop.rows.collect()}
    assert len(rows) == len(log) and rows[1]["segment_id"] == 0 and rows[1]["parent_id"] == 0
    for n, _, _, rf, gx, gy, gz, adc, trigger in log:
        r = rows[n]
        assert r["rf_amp"] == (rf[1] if rf else 0) and r["amp_gx"] == (gx[4] if gx else 0) and r["amp_gz"] == (gz[4] if gz else 0) and r["trigger"] == int(trigger is not None)
        assert r["energy_gx"] + r["energy_gy"] + r["energy_gz"] == pytest.approx(energy[n]) and r["adc_phase"] == (adc[2] if adc else 0)
    head = loop.header.first()
    assert (head["max_b1"], head["max_grad"], head["readouts"], head["rows"]) == (500.0, 5000.0, 30, len(log))
    found = [tuple(r) for r in convert.to_loop(spark.createDataFrame(program(wrong=True), LOG)).issues.select("kind", "seg_id", "j").collect()]
    assert found == [("duration", 1, 4)]


def heaviest(frame):
    """The rows of the fullest task of the last exchange."""
    return frame.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_tasks_hold_a_few_chunks_however_long_the_log(spark):
    """Long logs are sorted a few chunks to a task, and the last opening row comes without sorting the log by struct or moving it by label."""
    log = spark.range(1, 8001).select(F.col("id").alias("n"), F.when(F.col("id") % 7 == 3, (F.col("id") % 2).cast("int")).alias("trid"))
    placed = convert.with_instances(log, 10)
    assert placed.count() == 8000 and heaviest(placed) <= 200
    wrong = placed.where("NOT (start <=> CASE WHEN n >= 3 THEN n - (n - 3) % 7 END AND trid <=> CAST(start % 2 AS int) AND j <=> CAST(n - start + 1 AS int))")
    assert wrong.count() == 0


def test_waveform_and_slopes_take_bounded_tasks(spark):
    """One reading of the waveform gives samples and slopes, dealt over as many tasks as asked, and a long log's starts a few chunks to a task."""
    log = spark.range(1, 2001).select(F.col("id").alias("n"), F.lit(3.0).alias("duration"), *[F.struct(F.lit(0.0).alias("delay"), F.lit(1.0).alias("rise"), F.lit(1.0).alias("flat"), F.lit(1.0).alias("fall"), (F.col("id") % 5).cast("double").alias("amplitude")).alias(a) for a in ("gx", "gy", "gz")])
    wave = convert.waveform(log, 1.0, ("gx",))
    both = feasibility.stepped(wave, 1.0, 100, 50)
    assert heaviest(both) <= 600
    got = {r["i"]: (r["g"], r["s"]) for r in both.collect()}
    want = np.concatenate([np.array([0.5, 1.0, 0.5]) * (n % 5) for n in range(1, 2001)])
    assert np.allclose([got[i][0] for i in range(6000)], want) and np.allclose([got[i][1] for i in range(6000)], np.diff(want, prepend=want[0])) and len(got) == 6000
    assert {r["i"]: r["g"] for r in feasibility.slew(wave, 1.0, 100).collect()} == {i: s for i, (_, s) in got.items()}


def test_rows_are_numbered_in_ranges(spark):
    rows = [(k, v) for k in (5, -3, 900, None, 17, 18, 19, 20) for v in (2, None, 1)]
    want = {r: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)), 1)}
    for size in (1, 4, 1000):
        got = events.running_numbers(spark.createDataFrame(rows, "k long, v long").repartition(3), ["k", "v"], size).collect()
        assert {(r["k"], r["v"]): r["n"] for r in got} == want and len(got) == len(rows)
        assert len({(r["k"], r["range"]) for r in got}) == 8
    assert events.running_numbers(spark.createDataFrame([], "k long, v long"), ["k", "v"]).count() == 0
    assert heaviest(events.running_numbers(spark.range(8000), ["id"], 10)) <= 200


def test_energies_that_tie_take_the_earliest_instance(spark):
    log = [(n, 2e-4, 5 if n % 2 else None, None, (0.0, 2e-5, 4e-5, 2e-5, 3.0), None, None, None, None) for n in range(1, 41)]
    loop = convert.to_loop(spark.createDataFrame(log, LOG))
    assert [r["strongest_row"] for r in loop.segments.collect()] == [1] and loop.header.first()["rows"] == 40
    assert sorted((r["n"], r["j"]) for r in loop.rows.collect()) == [(n, 2 - n % 2) for n in range(1, 41)]


def test_waveform_and_report(spark):
    dt, log = 1e-5, program(12)
    blocks = spark.createDataFrame(log, LOG)
    total = round(sum(r[1] for r in log) / dt)
    want = np.zeros((3, total))
    at = 0
    for _, duration, _, _, *axes, _, _ in log:
        ticks = round(duration / dt)
        for k, g in enumerate(axes):
            if g:
                t = (np.arange(ticks) + 0.5) * dt - g[0]
                want[k, at : at + ticks] = np.interp(t, np.cumsum([0, g[1], g[2], g[3]]), [0, g[4], g[4], 0])
        at += ticks
    got = np.full((3, total), np.nan)
    for r in convert.waveform(blocks, dt).collect():
        got[r["ch"], r["i"]] = r["g"]
    assert np.allclose(got, want)
    gamma = 42.576e6
    bands = feasibility.acoustic_bands(spark, [(0, 400.0, 900.0)])
    row = convert.feasibility(blocks, {"grad": 1.0, "slew": 1e9, "b1": 1.0, "pns": 1e9, "acoustics": 1e9}, dt=dt, gamma=gamma, slew_min=70.0, chronaxie=334e-6, bands=bands).first()
    assert row["max_grad"] == pytest.approx(np.abs(want).max() / gamma) and row["max_slew"] == pytest.approx(np.abs(np.diff(want)).max() / dt / gamma)
    slew = np.concatenate([np.zeros((3, 1)), np.diff(want)], axis=1) / dt / gamma
    kernel = feasibility.stimulation_kernel(70.0, 334e-6, dt)
    pns = 100 * np.sqrt(sum(np.convolve(s, kernel)[:total] ** 2 for s in slew)).max()
    assert row["peak_pns"] == pytest.approx(pns) and row["max_b1"] == pytest.approx(500 / gamma * 1e4) and row["acoustics"] > 0 and row["ok"]
    assert not convert.feasibility(blocks, {"grad": 1e-9, "slew": 1e9, "b1": 1.0, "pns": 1e9, "acoustics": 1.0}, dt=dt, gamma=gamma, slew_min=70.0, chronaxie=334e-6).first()["ok"]


def test_shapes_at_a_place_keep_the_parents_polarity_in_long_logs(spark):
    """A log with shapes of many chunks: rows keep their place, and joins with segments and positions send those around instead of sorting the log."""
    drawn = lambda a, s: (0.0, 0.0, 0.0, 0.0, a, s)
    schema = LOG.replace(GRAD, GRAD[:-1] + ",shape:long>")
    log = [(n, 2e-4, 1 if n % 2 else None, None, drawn(-2.0 if n % 4 == 1 else 3.0, 7), None, None, None, None) for n in range(1, 401)]
    library = convert.shape_library(spark.createDataFrame([(7, 0.0, 0.0), (7, 1e-4, 1.0), (7, 2e-4, 0.0)], "shape long, t double, v double"))
    loop = convert.to_loop(spark.createDataFrame(log, schema), library)
    assert {r["n"]: r["amp_gx"] for r in loop.rows.collect()} == {n: 2.0 if n % 4 == 1 else -3.0 for n in range(1, 401)}
    assert "SortMergeJoin" not in loop.rows._jdf.queryExecution().executedPlan().toString()


def test_rows_carry_their_place(spark):
    """Rows have the place inside their instance, so none is joined back to the log."""
    rows = convert.to_loop(spark.createDataFrame(program(6), LOG)).rows
    assert [r["j"] for r in rows.orderBy("n").limit(8).collect()] == [None, 1, 2, 3, 1, 2, 3, 4]


def test_the_written_log_is_read_by_columns(spark):
    """The header's totals read three columns of the log, not its rows whole."""
    plan = convert.to_loop(spark.createDataFrame(program(6), LOG)).blocks.agg(F.sum("duration"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<duration:double>" in plan


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [3, 1000])
def test_a_waveform_starts_from_runs_of_the_numbering(spark, size):
    """Runs inside ranges give the samples that a log without them gives: null, negative and uneven durations, no gradient, a shape that the library lacks, and an unnumbered key last."""
    grad = "struct<delay:double,rise:double,flat:double,fall:double,amplitude:double,shape:long>"
    draw = lambda k: None if k % 5 == 0 else (0.25 * (k % 4), 1.0, 0.5 * (k % 3), 0.7, float(k), {0: 7, 1: None, 2: None, 3: 99}[k % 4])
    last = lambda k: None if k == 4 else -2.0 if k == 9 else 1.3 + k % 6
    rows = [(None if k == 17 else 3 * k, k, last(k), draw(k)) for k in range(30)]
    log = events.running_numbers(spark.createDataFrame(rows, f"key long, k long, duration double, gx {grad}").repartition(3), ["key", "k"], size)
    library = convert.shape_library(spark.createDataFrame([(7, 0.0, 0.0), (7, 1.0, -4.0), (7, 1.5, 2.0)], "shape long, t double, v double"))
    got, plain = (sorted(map(tuple, convert.waveform(x, 0.5, ("gx",), library).collect())) for x in (convert.with_runs(log, 0.5, ["key", "k"]), log))
    assert got == plain
    want, at = {}, 0.0
    for _, _, duration, g in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if duration is None or duration < 0:
            continue
        for i in range(int(np.ceil(at / 0.5 - 0.5 - 1e-9)), int(np.ceil((at + duration) / 0.5 - 0.5 - 1e-9))):
            if g and g[5] == 99:
                continue
            corners, values = ([0], [0]) if not g else (g[0] + np.array([0, 1.0, 1.5]), [0, -1.0, 0.5]) if g[5] else (np.cumsum(g[:4]), [0, 1, 1, 0])
            want[i] = (g[4] if g else 0.0) * np.interp((i + 0.5) * 0.5 - at, corners, values, 0, 0)
        at += duration
    assert [r[1] for r in got] == sorted(want) and np.allclose([r[2] for r in got], [want[i] for i in sorted(want)], atol=1e-4)


def test_the_waveform_neither_moves_the_written_log_nor_calls_functions_on_its_lists(spark, sf):
    """One exchange and one sort number the log; its waveform joins starts and shapes, and only parts are shuffled."""
    plan = plan_of(logs.q86(spark, sf))
    assert "REPARTITION" not in plan and "transform(__" not in plan and "filter(" not in plan and "Sort [n#" not in plan
    lines = plan_of(logs.numbered_lines(spark, sf).select("n", "j", "len"))
    assert lines.count("Sort [range") == 2  # the log's, and that of a row for each range
