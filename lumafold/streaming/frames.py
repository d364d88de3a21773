"""A stream of shots, gathered into frames by count and written once each.

Rows are keyed by (frame, acq), never by their place in the stream, and a frame's partition is replaced as a whole, so a
restart from the checkpoint gives the same table as a run without one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumafold.operators.recon import frames_of


def read_shots(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Raw shots (acq, coil, re, im, ...) as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_frames(shots: DataFrame, size: int) -> DataFrame:
    return shots.withColumn("frame", frames_of(F.col("acq"), size))


def write_frames(shots: DataFrame, size: int, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write each frame's rows to its partition of ``out``/shots, and each completed frame, processed, to ``out``/frames.

    A micro-batch adds its shots (replacing those of the same batch after a restart), then processes the frames that
    are complete now. At-least-once batches thus give each frame exactly once.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = with_frames(batch, size)
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("frame", "batch").parquet(f"{out}/shots")
        touched = [r["frame"] for r in new.select("frame").distinct().collect()]  # frames of one micro-batch
        if not touched:
            return
        # Only the folders of these frames are listed, so a batch's cost doesn't grow with the batches before it.
        stored = spark.read.option("basePath", f"{out}/shots").parquet(*[f"{out}/shots/frame={f}" for f in touched]).drop("batch").dropDuplicates(["frame", "acq", "coil"])
        complete = stored.groupBy("frame").agg(F.countDistinct("acq").alias("n")).where(F.col("n") == size).select("frame")
        whole = stored.join(complete, "frame", "left_semi")
        result = process(whole) if process else whole
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("frame").parquet(f"{out}/frames")

    return with_frames(shots, size).drop("frame").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missing_frames(spark: SparkSession, out: str, size: int, frames: int) -> DataFrame:
    """frame, n: expected frames that never became complete, with the acquisitions that arrived."""
    arrived = spark.read.parquet(f"{out}/shots").groupBy("frame").agg(F.countDistinct("acq").alias("n"))
    expected = spark.range(frames).select(F.col("id").alias("frame"))
    return expected.join(arrived.withColumn("frame", F.col("frame").cast("long")), "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < size)


def event_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums in event-time windows, with a watermark (timestamps without zone are taken as UTC)."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
