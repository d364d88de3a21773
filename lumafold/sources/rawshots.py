"""Raw shot archives: a binary format and a Spark data source ("lumashots") that reads it in batches or as a stream.

An archive is a folder of files. A file: magic, int32 channels, int32 samples, int64 first acquisition, then shots of
channels x samples complex64 (little-endian). A file cut short inside a shot is an error; an archive without shots is one too.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MAGIC = b"LFSHOTS1"
HEAD = struct.Struct("<8siiq")
SCHEMA = "acq long, coil int, re array<float>, im array<float>"
#: Shots in a record batch.
STEP = 64


def encode_shots(shots: np.ndarray, first: int) -> bytes:
    """The bytes of a file with shots (shot, channel, sample) that begin at acquisition ``first``."""
    _, channels, samples = shots.shape
    return HEAD.pack(MAGIC, channels, samples, first) + np.ascontiguousarray(shots, "<c8").tobytes()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def list_archive(path: str) -> list[str]:
    """The archive's files in name order."""
    fs, root = _filesystem(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".shots"))


def read_file(fs: pafs.FileSystem, name: str) -> Iterator[pa.RecordBatch]:
    with fs.open_input_stream(name) as stream:
        magic, channels, samples, acq = HEAD.unpack(stream.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a shot file")
        size = 8 * channels * samples
        while raw := stream.read(STEP * size):
            if len(raw) % size:
                raise ValueError(f"{name} ends inside a shot")
            lines = np.frombuffer(raw, "<c8").reshape(-1, samples)
            n = len(lines)
            offsets = pa.array(np.arange(0, (n + 1) * samples, samples, dtype=np.int32)) if samples else pa.array(np.zeros(n + 1, np.int32))
            number = acq + np.arange(n) // channels
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), pa.array((np.arange(n) % channels).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(lines.real.ravel())), pa.ListArray.from_arrays(offsets, pa.array(lines.imag.ravel()))],
                ["acq", "coil", "re", "im"],
            )
            acq += n // channels


class _File(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        files = [_File(name) for name in list_archive(self.path)]
        if not files:
            raise ValueError(f"no shots under {self.path}")
        return files

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from read_file(_filesystem(self.path)[0], partition.name)


class _Stream(DataSourceStreamReader):
    """Files in name order; the offset is the number of files taken."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(list_archive(self.path))}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(name) for name in list_archive(self.path)[start["files"] : end["files"]]]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from read_file(_filesystem(self.path)[0], partition.name)

    def commit(self, end: dict) -> None:
        """Nothing to release."""


class ShotArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumashots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All shots of an archive; raises if there are none."""
    spark.dataSource.register(ShotArchive)
    return spark.read.format("lumashots").load(path)


def stream_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive as a stream, file by file as they arrive in name order."""
    spark.dataSource.register(ShotArchive)
    return spark.readStream.format("lumashots").load(path)


def explode_samples(shots: DataFrame) -> DataFrame:
    """acq, coil, i, re, im: a row for each sample."""
    from pyspark.sql import functions as F

    zipped = F.arrays_zip("re", "im")
    return shots.select("acq", "coil", F.posexplode(zipped).alias("i", "z")).select("acq", "coil", "i", F.col("z.re").cast("double").alias("re"), F.col("z.im").cast("double").alias("im"))
