"""How the supplied tables stand in for lattices, block logs, acquisitions and channel data; each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumafold.session import table

NY, NZ = 240, 45

#: The unique order of the loop's rows.
LOOP_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LOOP_ORDER_SQL = ", ".join(LOOP_ORDER)

CELLS_SQL = f"cells AS (SELECT DISTINCT l_linenumber AS frame, (l_partkey % {NY})::INT AS iy, (l_suppkey % {NZ})::INT AS iz FROM lineitem)"
ACQ_SQL = "acq AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_id, ts, event_type, value FROM events)"
COIL_SQL = """coilvec AS (
  SELECT vec_id AS sample, label AS frame, c AS coil, embedding[2 * c + 1]::DOUBLE AS re, embedding[2 * c + 2]::DOUBLE AS im
  FROM embeddings, range(32) AS t(c)
)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled lattice points: frame, iy, iz."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % NY).cast("int").alias("iy"), (F.col("l_suppkey") % NZ).cast("int").alias("iz")).distinct()


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of channels in time order: channel, i, event_id, ts, event_type, value."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select(F.col("user_id").alias("channel"), place.alias("i"), "event_id", "ts", "event_type", "value")


def coil_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex channel samples: sample, frame, coil, re, im."""
    vectors = table(spark, sf_dir, "embeddings")
    pairs = vectors.select(F.col("vec_id").alias("sample"), F.col("label").alias("frame"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda c: F.struct(F.get("embedding", 2 * c).cast("double").alias("re"), F.get("embedding", 2 * c + 1).cast("double").alias("im")))).alias("coil", "z"))
    return pairs.select("sample", "frame", "coil", "z.re", "z.im")
