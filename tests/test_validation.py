"""Validation by field: planted differences are told apart."""

import math

import numpy as np
import pytest

from lumafold.operators import validation as V
from lumafold.sources import loopfile


@pytest.mark.parametrize("single", [False, True])
def test_ulps(spark, single):
    kind = np.float32 if single else np.float64
    rng = np.random.default_rng(2)
    values = [kind(v) for v in [1.0, 2.0, 0.5, 3.7e-5, np.finfo(kind).max, np.finfo(kind).tiny, *(2.0**k for k in range(-30, 30)), *(rng.normal(size=40) * 10.0 ** rng.integers(-12, 12, 40))]]
    pairs = [(float(v), float(np.nextafter(v, kind(0))), 1.0) for v in values] + [(float(v), float(np.nextafter(np.nextafter(-v, kind(0)), kind(0))), None) for v in values[:3]]
    small = float(np.nextafter(kind(0), kind(1)))
    pairs += [(0.0, -0.0, 0.0), (small, -small, 2.0), (small, 0.0, 1.0), (1.0, 1.0, 0.0), (math.nan, 1.0, None), (math.inf, 1.0, None)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "k int, a double, b double")
    from pyspark.sql import functions as F

    got = {r["k"]: r["u"] for r in rows.select("k", V.ulps_between(F.col("a"), F.col("b"), single).alias("u")).collect()}
    for k, (a, b, want) in enumerate(pairs):
        if want is not None:
            assert got[k] == want, (a, b)
        elif not math.isfinite(a):
            assert got[k] is None
        else:
            assert got[k] > 2**20


SCHEMA = "id int, name string, count long, value double, part struct<x:double,y:array<double>>, tags array<struct<k:int,v:float>>"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_planted_differences(spark):
    near = float(np.nextafter(3.0, 4.0))
    ours = table(spark, (1, "a", 7, 3.0, (1.0, [1.0, 2.0]), [(1, 0.5)]), (2, "b", 2**60, math.nan, None, None), (3, "c", 1, 5.0, (2.0, []), []), (5, "e", 1, 1.0, (1.0, [0.0]), None))
    theirs = table(spark, (1, "a", 7, near, (-1.0, [1.0, 2.1]), [(1, 0.5), (2, 0.5)]), (2, "x", 2**60 + 1, math.nan, (0.0, []), None), (4, "c", 1, 5.0, (2.0, []), []), (5, "e", 1, 1.0 + 1e-9, (1.0, [-0.0]), None))
    rules = [V.Rule(r"^part\.y$", absolute=0.05), V.Rule("value", ulps=0, relative=1e-8)]
    got = {(r["id"], r["path"]): r for r in V.compared(ours, theirs, ["id"], rules).collect()}
    verdict = {k: r["verdict"] for k, r in got.items()}
    assert verdict[1, "value"] == "within" and got[1, "value"]["ulps"] == 1.0
    assert verdict[1, "part.x"] == "sign"
    assert verdict[1, "part.y[0]"] == "equal" and verdict[1, "part.y[1]"] == "differs" and verdict[1, "part.y.size"] == "equal"
    assert verdict[1, "tags.size"] == "differs" and verdict[1, "tags[1].v"] == "only_theirs" and verdict[1, "tags[0].v"] == "equal"
    assert verdict[2, "name"] == "differs" and verdict[2, "count"] == "differs" and verdict[2, "value"] == "equal"
    assert verdict[2, "part"] == "only_theirs" and verdict[2, "part.x"] == "only_theirs" and verdict[2, "tags"] == "equal"
    assert verdict[3, "value"] == "only_ours" and verdict[4, "value"] == "only_theirs"
    assert verdict[5, "value"] == "within" and verdict[5, "part.y[0]"] == "equal"
    exact = {(r["id"], r["path"]): r["verdict"] for r in V.compared(ours, theirs, ["id"]).collect()}
    assert exact[1, "value"] == "differs" and exact[5, "value"] == "differs"
    one = {(r["id"], r["path"]): r["verdict"] for r in V.compared(ours, theirs, ["id"], [V.Rule("value", ulps=1)]).collect()}
    assert one[1, "value"] == "within" and one[5, "value"] == "differs"
    report = {r["field"]: r for r in V.field_report(V.compared(ours, theirs, ["id"], rules)).collect()}
    assert not report["part.x"]["ok"] and report["part.x"]["sign"] == 1 and report["part.y"]["leaves"] == 3  # two of row 1, one of row 5
    same = V.field_report(V.compared(ours, ours, ["id"]))
    assert same.where("not ok").count() == 0 and V.compared(ours.limit(0), ours.limit(0), ["id"]).count() == 0
    with pytest.raises(ValueError):
        V.leaves(spark.sql("SELECT 1 AS id, map(1, 2) AS m"), ["id"])


def test_loop_files(spark, tmp_path):
    def content(rows, rise, sample):
        pulse = loopfile.Pulse(np.arange(4) * 2e-6, np.array([0.0, sample, 1.0, 0.0]), np.zeros(4), 8e-6, 1e-4)
        parents = [loopfile.Parent(1, 1e-3, pulse, (loopfile.Gradient(0.0, rise, 1e-4, 1e-4), None, None), (64, 2e-6, 0.0))]
        return loopfile.encode(loopfile.LoopFile(parents, [loopfile.SegmentDef(1, [1, 0], 1)], rows, (1.0, 0.2, 0.03, 100.0, 0.5), 3, 4, 2))

    rows = np.arange(46.0).reshape(2, 23)
    off = rows.copy()
    off[1, 5], off[0, 3] = -off[1, 5], np.nextafter(np.float32(off[0, 3]), np.float32(9))
    for side, raw in (("a", content(rows, 1e-4, 0.5)), ("b", content(off, 1.2e-4, 0.50001)), ("c", content(rows, 1e-4, 0.5))):
        (tmp_path / side).mkdir()
        (tmp_path / side / "x.pge").write_bytes(raw)
    got = V.compare_loop_files(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    bad = {(r["row"], r["column"], r["path"]): r["verdict"] for r in got.where("verdict NOT IN ('equal', 'within')").collect()}
    assert bad == {(1, 5, "value"): "sign", (None, None, "parents[0].gx.rise"): "differs"}
    near = {(r["row"], r["path"]): r["ulps"] for r in got.where("verdict = 'within'").collect()}
    assert near[0, "value"] == 1.0 and (None, "parents[0].pulse.magnitude[1]") in near
    assert V.field_report(V.compare_loop_files(spark, str(tmp_path / "a"), str(tmp_path / "c"))).where("not ok").count() == 0
