"""One-row tables of settings: defaults, overrides, the hardware catalog, and what follows from them."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: hydrogen's gyromagnetic ratio in Hz/T.
GAMMA = 42.576e6


@dataclass(frozen=True)
class Hardware:
    """One row of the hardware catalog; SI units (T/m, T/m/s, s, T)."""

    name: str
    max_grad: float
    max_slew: float
    max_b1: float
    b0: float
    grad_raster: float = 4e-6
    rf_raster: float = 2e-6
    block_raster: float = 4e-6
    chronaxie: float = 334e-6
    rheobase: float = 23.4
    alpha: float = 0.333

    @property
    def slew_min(self) -> float:
        return self.rheobase / self.alpha


@dataclass(frozen=True)
class Experiment:
    """Settings of an acquisition. Unused settings are accepted and kept."""

    nx: int = 240
    ny: int = 240
    nz: int = 45
    fov: tuple[float, float, float] = (0.216, 0.216, 0.0405)
    accel: int = 9
    etl: int = 60
    tr: float = 0.1
    te: float = 0.039
    frames: int = 30
    t1: float = 1.5
    dwell: float = 4e-6
    sampling_method: str = "caipi"
    trajectory: str = "laminar"
    sigma: float | None = None
    seed: int | None = None

    @property
    def samples(self) -> int:
        return self.ny * self.nz // self.accel

    @property
    def shots(self) -> int:
        return self.samples // self.etl

    @property
    def volume_tr(self) -> float:
        return self.shots * self.tr

    @property
    def flip(self) -> float:
        """Ernst angle in degrees."""
        return math.degrees(math.acos(math.exp(-self.tr / self.t1)))


@dataclass(frozen=True)
class Session:
    """Settings of a reconstruction run. ``delay`` is one number, or one for each sequence."""

    data_dir: str
    names: tuple[str, ...]
    delay: float | dict[str, float] = 0.0
    virtual_coils: int | None = None
    energy: float = 0.95
    do_sense: bool = True
    frames: int | None = None  # null: all

    def delay_of(self, name: str) -> float:
        """A map must hold every sequence that is asked for."""
        return self.delay[name] if isinstance(self.delay, dict) else self.delay


def overridden(base, **changes):
    """``base`` with other values; unknown names are a TypeError."""
    unknown = set(changes) - {f.name for f in fields(base)}
    if unknown:
        raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(base, **changes)


def paths(data_dir: str, name: str) -> dict[str, str]:
    """Where a sequence's tables lie."""
    root = f"{data_dir.rstrip('/')}/{name}"
    return {k: f"{root}/{k}.parquet" for k in ("schedule", "scalars", "trajectory", "raw", "kspace", "maps", "image", "report")}


def one_row(spark: SparkSession, settings) -> DataFrame:
    """A settings object as a one-row table; tuples become arrays."""
    row = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(settings).items() if v is not None}
    return spark.createDataFrame([row])


def hardware_catalog(spark: SparkSession, rows: list[Hardware]) -> DataFrame:
    return spark.createDataFrame([asdict(r) for r in rows])


def with_hardware(runs: DataFrame, catalog: DataFrame, key: str = "scanner") -> DataFrame:
    """Runs with their hardware's limits. The catalog is a handful of hand-written rows."""
    return runs.join(F.broadcast(catalog.withColumnRenamed("name", key)), key)


def scalars(frame: DataFrame) -> DataFrame:
    """A stored scalar snapshot, with what older snapshots lack: one echo, no echo times."""
    have = set(frame.columns)
    out = frame.withColumn("n_echoes", F.coalesce(F.col("n_echoes"), F.lit(1)) if "n_echoes" in have else F.lit(1))
    return out if "te_degre" in have else out.withColumn("te_degre", F.lit(None).cast("array<double>"))


def cycles_per_cm(trajectory: DataFrame) -> DataFrame:
    """A stored trajectory (cycles per metre) in cycles per centimetre."""
    return trajectory.withColumn("kx", F.col("kx") / 100)


def zero_based(schedule: DataFrame) -> DataFrame:
    """A stored schedule's 1-based places, 0-based."""
    return schedule.withColumns({c: (F.col(c) - 1).cast("int") for c in ("iy", "iz")})


def one_based(schedule: DataFrame) -> DataFrame:
    return schedule.withColumns({c: (F.col(c) + 1).cast("int") for c in ("iy", "iz")})
