"""Session defaults and table access shared by every plan."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lumafold", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables; ``sf_dir`` may be any URI that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI: under spark.checkpoint.dir, or in local mode a folder of our own where that is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="lumafold-kept-")
        sc.setCheckpointDir(base)
    scheme, colon, rest = sc.getCheckpointDir().partition(":")
    return f"{scheme}://{rest}" if colon and not rest.startswith("//") else f"{scheme}{colon}{rest}"


def kept(frame: DataFrame) -> DataFrame:
    """``frame``, computed once and written to the shared folder: plans built on it start from the written rows, and lost executors cost a read."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """``frame``, computed once and written to the shared folder as Parquet: plans built on it read the columns that they use, and Spark knows its size."""
    path = f"{shared_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, so that Arrow functions import it wherever the driver was started.

    Also lower the rows of an Arrow batch, if the session left them at the default: rows may hold whole documents.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")
    if getattr(sc, "_lumafold_shipped", None) != sc.applicationId:
        target = os.path.join(tempfile.mkdtemp(prefix="lumafold-"), "lumafold.zip")
        with zipfile.ZipFile(target, "w") as bundle:
            for path in sorted(PACKAGE.rglob("*.py")):
                bundle.write(path, path.relative_to(PACKAGE.parent))
        known = list(sys.path)
        sc.addPyFile(target)
        sys.path[:] = known  # the driver keeps importing from where it started
        sc._lumafold_shipped = sc.applicationId
    return spark
