"""Images and cached volumes as Parquet, partitioned by frame, with JSON sidecars and validity metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_volume(frame: DataFrame, path: str) -> None:
    """Append by frame; a frame written again replaces only its own partition."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("frame").parquet(path)


def read_frame(spark: SparkSession, path: str, frame: int) -> DataFrame:
    """One frame; the other partitions are not read."""
    return spark.read.parquet(path).where(F.col("frame") == frame)


def read_arrays(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Named columns of a stored table (all, if none are named)."""
    table = spark.read.parquet(path)
    return table.select(*names) if names else table


def magnitude_image(image: DataFrame) -> DataFrame:
    """frame, ix, iy, iz, value (float): what an image file holds."""
    return image.select("frame", "ix", "iy", "iz", F.hypot("re", "im").cast("float").alias("value"))


def sidecar(spark: SparkSession, fov: tuple[float, float, float], size: tuple[int, int, int], **attributes) -> DataFrame:
    """One row: voxel edges in millimetres, the diagonal affine, and the attributes as JSON."""
    edges = [1000 * f / n for f, n in zip(fov, size, strict=True)]
    affine = [[edges[r] if r == c and r < 3 else 1.0 if r == c else 0.0 for c in range(4)] for r in range(4)]
    values = [F.lit(v).alias(k) for k, v in sorted(attributes.items())] or [F.lit(None).cast("string").alias("none")]
    return spark.range(1).select(F.array(*map(F.lit, edges)).alias("voxel_mm"), F.array(*[F.array(*map(F.lit, r)) for r in affine]).alias("affine"), F.to_json(F.struct(*values)).alias("attributes"))


def save_image(image: DataFrame, path: str, fov: tuple[float, float, float], size: tuple[int, int, int], **attributes) -> None:
    """The magnitude image and its sidecar, as Parquet and JSON beside each other."""
    magnitude_image(image).write.mode("overwrite").partitionBy("frame").parquet(f"{path}/image")
    sidecar(image.sparkSession, fov, size, **attributes).write.mode("overwrite").json(f"{path}/sidecar")


def write_maps(maps: DataFrame, path: str, channels: int) -> None:
    maps.withColumn("n_channels", F.lit(channels)).write.mode("overwrite").parquet(path)


def cached_maps(spark: SparkSession, path: str, channels: int) -> DataFrame | None:
    """Stored maps, if there are any for this number of channels."""
    try:
        table = spark.read.parquet(path)
    except Exception as error:  # no such table yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER" in str(error):
            return None
        raise
    return table.drop("n_channels") if table.where(F.col("n_channels") == channels).limit(1).count() else None
