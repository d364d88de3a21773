import numpy as np
import pytest
from pyspark.sql import functions as F

from lumafold.sources import rawshots


def test_archive_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    shots = (rng.normal(size=(150, 2, 4)) + 1j * rng.normal(size=(150, 2, 4))).astype(np.complex64)
    path = tmp_path / "a"
    path.mkdir()
    (path / "0.shots").write_bytes(rawshots.encode_shots(shots[:100], 0))
    (path / "1.shots").write_bytes(rawshots.encode_shots(shots[100:], 100))
    got = rawshots.read_archive(spark, str(path))
    assert got.count() == 300
    row = got.where("acq = 120 AND coil = 1").first()
    assert np.allclose(np.array(row["re"]) + 1j * np.array(row["im"]), shots[120, 1])
    assert rawshots.explode_samples(got).count() == 1200
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: rawshots.stream_archive(spark, str(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    run()
    (path / "2.shots").write_bytes(rawshots.encode_shots(shots[:10], 150))
    run()
    assert spark.read.parquet(out).agg(F.countDistinct("acq")).first()[0] == 160


def test_archive_errors(spark, tmp_path):
    with pytest.raises(Exception, match="no shots"):
        rawshots.read_archive(spark, str(tmp_path)).count()
    (tmp_path / "x.shots").write_bytes(rawshots.encode_shots(np.zeros((2, 1, 4), np.complex64), 0)[:-3])
    with pytest.raises(Exception, match="inside a shot"):
        rawshots.read_archive(spark, str(tmp_path)).count()
