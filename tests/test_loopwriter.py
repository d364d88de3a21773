"""A converted log as a loop file, against the file of the collected loop."""

import numpy as np
import pytest
from test_acoustics import SHAPED
from test_convert import LOG, program

from lumafold.operators import convert
from lumafold.sources import loopfile, loopwriter

PULSES = {"sinc": loopfile.Pulse((np.arange(8) + 0.5) * 1e-6, np.hanning(8), np.zeros(8), 8e-6, 1e-6)}


@pytest.mark.parametrize("size", [10, 1 << 18])
def test_file_equals_the_collected_form(spark, tmp_path, size):
    log = program()[1:]
    log = [(n, *r[1:]) for n, r in enumerate(log, 1)]
    loop = convert.to_loop(spark.createDataFrame(log, LOG).repartition(3))
    path = tmp_path / "loop.pge"
    length = loopwriter.write_loop(loop, f"file://{path}", PULSES, size=size)
    raw = path.read_bytes()
    assert len(raw) == length and [p.name for p in tmp_path.iterdir()] == ["loop.pge"]
    table = loop.rows.orderBy("n").toPandas()
    content, n = loopwriter.definitions(loop, PULSES)
    content.loop = table[list(loopwriter.COLUMNS)].to_numpy(float)
    assert n == len(log) and raw == loopfile.encode(content)
    back = loopfile.decode(raw)
    gx = max(abs(r[4][4]) for r in log if r[4])
    assert back.limits[1] == 500.0 and back.limits[2] == gx and back.limits[3] == pytest.approx(gx / 2e-5, rel=1e-6) and back.readouts == 30
    assert back.heat_rows == len(log) and [s.blocks for s in back.segments] == [[1, -1, 2, 3], [1, 0, 2]]
    assert [(s.number, s.strongest_row) for s in back.segments] == [(r["seg_id"], r["strongest_row"]) for r in loop.segments.orderBy("seg_id").collect()]
    assert back.parents[0].pulse is not None and back.parents[1].adc[0] == 64 and back.parents[2].axes[1] is not None
    assert np.allclose(back.loop[:, 12].sum(), sum(r[1] for r in log), rtol=1e-6)


def test_shapes_reach_the_file(spark, tmp_path):
    corners = spark.createDataFrame([(1, 0.0, 0.0), (1, 3e-5, 4.0), (1, 9e-5, -2.0), (1, 1e-4, 0.0)], "shape long, t double, v double")
    library = convert.shape_library(corners)
    log = [(n, 2e-4, 7 if n % 2 else None, None, (0.0, None, None, None, 3.0 * n, 1), None, None, None, None) for n in range(1, 7)]
    loop = convert.to_loop(spark.createDataFrame(log, SHAPED), library)
    loopwriter.write_loop(loop, str(tmp_path / "a.pge"), {}, library)
    back = loopfile.decode((tmp_path / "a.pge").read_bytes())
    g = back.parents[0].axes[0]
    assert np.allclose(g.times, [0, 3e-5, 9e-5, 1e-4]) and np.allclose(g.waveform, [0, 1, -0.5, 0]) and len(back.parents) == 1
    assert back.limits[3] == pytest.approx(18.0 * (0.5 / 1e-5), rel=1e-6)


def test_gaps_are_an_error_and_leave_no_file(spark, tmp_path):
    log = [r for r in program() if r[0] != 5]
    loop = convert.to_loop(spark.createDataFrame(log, LOG))
    with pytest.raises(Exception, match="without gaps|missing"):
        loopwriter.write_loop(loop, str(tmp_path / "b.pge"), PULSES, size=10)
    assert not (tmp_path / "b.pge").exists()
