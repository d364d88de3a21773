"""Running numbers of logs: the stream equals the table, in any order of arrival, over restarts and replays."""

import random

import pandas as pd
import pytest

from lumafold.streaming import counters


def expected(rows):
    """(log, n) to (segment, instance, j, pulses), row by row in the order of each log."""
    out = {}
    for name in {r[0] for r in rows}:
        segment, instance, j, pulses = None, 0, 0, 0
        for _, n, trid, pulse in sorted({r[1]: r for r in rows if r[0] == name}.values(), key=lambda r: r[1]):
            pulses += bool(pulse)
            if trid is not None:
                segment, instance, j = trid, instance + 1, 1
            elif instance:
                j += 1
            out[name, n] = (segment, instance, j, pulses)
    return out


def logs(seed, sizes):
    rng = random.Random(seed)
    return [(f"log{k}", n, rng.choice([3, 7, 9]) if n > 2 and rng.random() < 0.2 else None, rng.choice([True, False, None])) for k, size in enumerate(sizes) for n in range(size)]


def found(frame):
    return {(r["log"], r["n"]): (r["segment"], r["instance"], r["j"], r["pulses"]) for r in frame.collect()}


def write(spark, folder, number, rows):
    pd.DataFrame(rows, columns=["log", "n", "trid", "pulse"]).astype({"trid": "Int32", "pulse": "boolean", "n": "int64"}).to_parquet(f"{folder}/part{number:03d}.parquet")


def test_table(spark):
    rows = logs(1, [40, 1, 25])
    got = counters.counted(spark.createDataFrame(rows + rows[:5], counters.LOG))
    assert got.count() == len(rows) and found(got) == expected(rows)
    assert counters.counted(spark.createDataFrame([], counters.LOG)).count() == 0
    second = counters.with_phase(got.where("pulses = 2")).first()
    assert second["phase"] == pytest.approx(234.0)


@pytest.mark.parametrize("seed", [2, 3])
def test_stream_over_restarts(spark, tmp_path, seed):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    rows = logs(seed, [120, 60, 1, 33])
    mixed = rows[:]
    random.Random(seed).shuffle(mixed)
    parts = [mixed[k::6] for k in range(6)]
    parts[4] = parts[4] + parts[0][:10]  # rows that come again
    read = lambda: spark.readStream.schema(counters.LOG).option("maxFilesPerTrigger", 1).parquet(source)
    done = 0
    for number, part in enumerate(parts):
        write(spark, source, number, part)
        if number in (1, 3, 5):  # each of these is a new query that goes on from the checkpoint
            counters.write_counted(read(), out, checkpoint).awaitTermination()
            table = spark.read.parquet(out)
            assert table.count() == table.select("log", "n").distinct().count() >= done
            done = table.count()
            want = expected(rows)
            assert all(want[k] == v for k, v in found(table).items())
    assert done == len(rows) and found(spark.read.parquet(out)) == expected(rows) == found(counters.counted(spark.createDataFrame(rows, counters.LOG)))


def test_rows_wait_for_a_gap(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rows = [("a", n, 5 if n == 1 else None, True) for n in range(6)]
    run = lambda: counters.write_counted(spark.readStream.schema(counters.LOG).parquet(source), out, checkpoint).awaitTermination()
    write(spark, source, 0, rows[:2] + rows[3:])
    run()
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [0, 1]
    write(spark, source, 1, rows[2:3])
    run()
    assert found(spark.read.parquet(out)) == expected(rows)


def test_a_table_needs_no_state(spark):
    with pytest.raises(ValueError):
        counters.counted_stream(spark.createDataFrame(logs(4, [3]), counters.LOG))
