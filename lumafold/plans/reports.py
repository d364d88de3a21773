"""Queries on running counters, delay sweeps, and comparisons by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumafold.functions.columns import settled
from lumafold.operators import pipeline
from lumafold.operators import validation as V
from lumafold.plans.masks import query_set
from lumafold.plans.views import ACQ_SQL, acquisitions
from lumafold.session import table
from lumafold.streaming import counters

QUERIES, ORACLES, query = query_set()


@query(
    "q87_log_counters",
    f"""WITH {ACQ_SQL}, r AS (SELECT channel, i, CASE WHEN event_id % 5 = 0 THEN event_id % 7 END AS trid, value > 20 AS pulse FROM acq),
s AS (SELECT *, count(trid) OVER w AS instance, last_value(trid IGNORE NULLS) OVER w AS segment, count(*) FILTER (WHERE pulse) OVER w AS pulses FROM r WINDOW w AS (PARTITION BY channel ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT channel::VARCHAR AS log, i::BIGINT AS n, coalesce(segment, -1)::INT AS segment, instance::BIGINT AS instance, CASE WHEN instance = 0 THEN 0 ELSE row_number() OVER (PARTITION BY channel, instance ORDER BY i) END::BIGINT AS j, pulses::BIGINT AS pulses, ((pulses * pulses * 117) % 720) / 2.0 + 0.0 AS phase FROM s""",
)
def q87(spark: SparkSession, sf: str) -> DataFrame:
    """Every channel as a block log: open segment (-1 before the first), its instance, the place in it, pulses so far and their phase (what the stream of the same rows gives)."""
    log = acquisitions(spark, sf).select(F.col("channel").cast("string").alias("log"), F.col("i").cast("long").alias("n"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 7).cast("int").alias("trid"), (F.col("value") > 20).alias("pulse"))
    return counters.with_phase(counters.counted(log)).fillna(-1, ["segment"])


_DELAYS = (-1.5, -0.25, 0.0, 0.5, 2.0)


@query(
    "q88_delayed_lines",
    f"""WITH {ACQ_SQL}, m AS (SELECT (i // 16) % 4 AS echo, channel % 2 AS coil, i % 16 AS k, avg(value) AS re, avg(value * 0.5) AS im FROM acq GROUP BY 1, 2, 3), d AS (SELECT unnest([{", ".join(map(str, _DELAYS))}])::DOUBLE AS delay),
t AS (SELECT p, k, (1 - 2 * p) * ((k - 7.5) * 0.05 + 0.0005 * k * k)::DOUBLE AS kx FROM range(2) AS a(p), range(16) AS b(k)),
s AS (SELECT delay, p, k, k - 0.5 - delay AS pos, greatest(0, least(floor(k - 0.5 - delay), 14))::INT AS j FROM t, d),
x AS (SELECT delay, s.p, s.k, a.kx + (pos - j) * (b.kx - a.kx) AS kx FROM s JOIN t a ON a.p = s.p AND a.k = j JOIN t b ON b.p = s.p AND b.k = j + 1),
g AS (SELECT *, coalesce(abs(lead(kx) OVER (PARTITION BY delay, p ORDER BY k) - kx), 0) AS w FROM x), n AS (SELECT *, w / sum(w) OVER (PARTITION BY delay, p) AS u FROM g),
v AS (SELECT delay, p, k, ix, u * cos(2 * pi() * kx * (ix - 4) * 2.5) AS wre, u * sin(2 * pi() * kx * (ix - 4) * 2.5) AS wim FROM n, range(8) AS c(ix))
SELECT delay, echo::BIGINT AS echo, coil::BIGINT AS coil, ix::INT AS ix, round(sum(re * wre - im * wim), 5) + 0.0 AS re, round(sum(re * wim + im * wre), 5) + 0.0 AS im FROM m JOIN v ON v.k = m.k AND v.p = echo % 2 GROUP BY delay, echo, coil, ix""",
)
def q88(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the shots of a calibration train of four echoes and two channels, under every candidate delay."""
    i = F.col("i")
    shots = acquisitions(spark, sf).select(F.floor(i / 64).alias("shot"), (F.floor(i / 16) % 4).cast("long").alias("echo"), (F.col("channel") % 2).cast("long").alias("coil"), (i % 16).cast("int").alias("i"), F.col("value").alias("re"), (F.col("value") * 0.5).alias("im"))
    k, p = F.col("id") % 16, F.floor(F.col("id") / 16)
    trajectory = spark.range(32).select(p.cast("int").alias("parity"), k.cast("int").alias("i"), ((1 - 2 * p) * ((k - 7.5) * 0.05 + k * k * 0.0005)).alias("kx"))
    lines = pipeline.delayed_lines(shots, trajectory, 8, 4, 20.0, _DELAYS)
    return lines.select("delay", "echo", "coil", "ix", settled(F.col("re"), 5).alias("re"), settled(F.col("im"), 5).alias("im"))


_KINDS = ("equal", "within", "sign", "differs", "only_ours", "only_theirs")
_FIELD_SQL = {"price": ("r NOT IN (0, 1, 3)", "r = 0", "r = 1", "false"), "part": ("r <> 3", "false", "false", "false"), "part.custkey": ("r NOT IN (2, 3)", "false", "false", "r = 2"), "part.status": ("r <> 3", "false", "false", "false")}


@query(
    "q89_field_report",
    "WITH k AS (SELECT o_orderkey % 7 AS r FROM orders), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) AS leaves, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in zip(_KINDS, (*counts, "r = 3", "false"), strict=True)) + " FROM k" for f, counts in _FIELD_SQL.items()
    )
    + ") SELECT *, \"equal\" + \"within\" = leaves AS ok FROM c",
)
def q89(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against a version with planted differences: by a millionth, in sign, in a number, and rows left out."""
    r = F.col("o_orderkey") % 7
    orders = table(spark, sf, "orders").withColumn("price", F.col("o_totalprice").cast("double"))
    part = lambda key: F.struct(key.alias("custkey"), F.col("o_orderstatus").alias("status")).alias("part")
    ours = orders.select("o_orderkey", "price", part(F.col("o_custkey")))
    theirs = orders.where(r != 3).select("o_orderkey", F.when(r == 0, F.col("price") + 1e-6).when(r == 1, -F.col("price")).otherwise(F.col("price")).alias("price"), part(F.when(r == 2, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))))
    return V.field_report(V.compared(ours, theirs, ["o_orderkey"], [V.Rule("^price$", absolute=1e-5)])).drop("worst_ulps")
