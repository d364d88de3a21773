"""Volumes as typed blocks: many voxels of a frame and channel in one row, which is what moves to the tasks that solve frames.

A block holds the places of its voxels (three 32-bit numbers each) and their values (complex doubles), 28 bytes a voxel. Blocks
are made where the voxels are read, so a frame's voxels move once, packed. Maps, which every frame needs, don't move with the
frames: they are written once as blocks, and a worker process reads them once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumafold.session import shared_folder

#: Voxels that a task gathers before it writes their blocks.
HELD = 1 << 18
#: Voxels of an output batch.
SENT = 1 << 16

SolverFn = Callable[[np.ndarray, np.ndarray | None], np.ndarray]


def packed(volume: DataFrame) -> DataFrame:
    """frame (0 where ``volume`` has none), coil, places, data: blocks of coil, ix, iy, iz, re, im; several for a frame and channel."""
    frame = (F.col("frame") if "frame" in volume.columns else F.lit(0)).cast("int").alias("frame")
    voxels = volume.select(frame, F.col("coil").cast("int").alias("coil"), *[F.col(c).cast("int").alias(c) for c in ("ix", "iy", "iz")], *[F.col(c).cast("double").alias(c) for c in ("re", "im")])

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        frames, coils = table["frame"].to_numpy(), table["coil"].to_numpy()
        order = np.lexsort((coils, frames))
        places = np.column_stack([table[c].to_numpy() for c in ("ix", "iy", "iz")]).astype("<i4")[order]
        data = (table["re"].to_numpy() + 1j * table["im"].to_numpy()).astype("<c16")[order]
        frames, coils = frames[order], coils[order]
        cuts = np.flatnonzero((np.diff(frames) != 0) | (np.diff(coils) != 0)) + 1
        starts = np.concatenate([[0], cuts])
        columns = [pa.array(frames[starts], pa.int32()), pa.array(coils[starts], pa.int32()), *[pa.array([part.tobytes() for part in np.split(x, cuts)], pa.binary()) for x in (places, data)]]
        return pa.RecordBatch.from_arrays(columns, ["frame", "coil", "places", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= HELD:
                yield blocks(held)
                held, count = [], 0
        if held:
            yield blocks(held)

    return voxels.mapInArrow(pack, "frame int, coil int, places binary, data binary")


def dense(blocks: pa.Table, shape: tuple[int, ...], coils: int) -> np.ndarray:
    """The array (shape..., coils) behind blocks; places without a voxel are zero."""
    out = np.zeros((*shape, coils), complex)
    for coil, places, data in zip(*(blocks[c].to_pylist() for c in ("coil", "places", "data")), strict=True):
        at = np.frombuffer(places, "<i4").reshape(-1, 3)
        out[at[:, 0], at[:, 1], at[:, 2], coil] = np.frombuffer(data, "<c16")
    return out


def written_maps(maps: DataFrame) -> str:
    """Where the blocks of ``maps`` (coil, ix, iy, iz, re, im) were written, in the folder that all executors share."""
    path = f"{shared_folder(maps.sparkSession)}/maps-{uuid.uuid4().hex}"
    packed(maps).select("coil", "places", "data").write.parquet(path)
    return path


_READ: dict[tuple, np.ndarray] = {}


def worker_maps(path: str, shape: tuple[int, ...], coils: int) -> np.ndarray:
    """Written maps as an array; a worker process reads them once and holds one set at a time."""
    key = (path, tuple(shape), coils)
    if key not in _READ:
        _READ.clear()
        fs, root = pafs.FileSystem.from_uri(path)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")]
        out = np.zeros((*shape, coils), complex)
        for file in sorted(files):
            out += dense(pq.read_table(file, filesystem=fs), shape, coils)
        out.flags.writeable = False
        _READ[key] = out
    return _READ[key]


def frame_images(kspace: DataFrame, maps: DataFrame | None, shape: tuple[int, ...], coils: int, solve: SolverFn) -> DataFrame:
    """frame, status, image (complex doubles in C order): each frame solved in its own task.

    kspace: frame, coil, ix, iy, iz, re, im (missing places are zero). maps: coil, ix, iy, iz, re, im, or none, if the solver
    needs none. A frame whose solver fails becomes zeros with the error as status; maps that can't be read fail the task.
    """
    where = written_maps(maps) if maps is not None else None

    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        sens = worker_maps(where, shape, coils) if where else None
        try:
            image, status = np.asarray(solve(dense(blocks, shape, coils), sens), complex).reshape(shape), "ok"
        except Exception as error:  # one bad frame must not stop the others
            image, status = np.zeros(shape, complex), f"failed: {error}"
        return pa.table({"frame": pa.array([key[0].as_py()], pa.int32()), "status": [status], "image": pa.array([image.astype("<c16").tobytes()], pa.binary())})

    return packed(kspace).groupBy("frame").applyInArrow(run, "frame int, status string, image binary")


def voxels(images: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """frame, ix, iy, iz, re, im, status: the voxels of solved frames, unpacked where they are."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, status, image in zip(*(batch.column(c).to_pylist() for c in ("frame", "status", "image")), strict=True):
                data = np.frombuffer(image, "<c16")
                for first in range(0, data.size, SENT):
                    part = data[first : first + SENT]
                    n, at = part.size, np.unravel_index(np.arange(first, first + part.size), shape)
                    columns = [pa.array(np.full(n, frame, np.int32)), *[pa.array(a.astype(np.int32)) for a in at], pa.array(part.real), pa.array(part.imag), pa.array([status] * n, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["frame", "ix", "iy", "iz", "re", "im", "status"])

    return images.mapInArrow(unpack, "frame int, ix int, iy int, iz int, re double, im double, status string")
