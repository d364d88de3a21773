"""Queries on block logs, segments, feasibility, acquisition frames and entry numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumafold.functions.columns import settled
from lumafold.operators import events as E
from lumafold.operators import feasibility as P
from lumafold.operators import recon as R
from lumafold.operators import registry as K
from lumafold.plans.masks import query_set
from lumafold.plans.views import ACQ_SQL, LOOP_ORDER, LOOP_ORDER_SQL, acquisitions
from lumafold.session import table

QUERIES, ORACLES, query = query_set()


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


_SIG_SQL = "concat_ws('|', round(l_tax / 1e-6)::BIGINT::VARCHAR, coalesce(l_returnflag, '-'), coalesce(l_linestatus, '-'), coalesce(l_linenumber::VARCHAR, '-'))"
_N_SQL = "(l_orderkey * 8 + l_linenumber)"


@query("q12_parent_blocks", f"WITH s AS (SELECT {_SIG_SQL} AS signature, {_N_SQL} AS n FROM lineitem), g AS (SELECT signature, min(n) AS first_row, count(*) AS instances FROM s GROUP BY signature) SELECT signature, first_row, instances, row_number() OVER (ORDER BY first_row, signature)::INT AS parent_id FROM g")
def q12(spark: SparkSession, sf: str) -> DataFrame:
    sig = E.signature(F.col("l_tax"), [F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")])
    blocks = _lines(spark, sf).select(sig.alias("signature"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"))
    return E.parent_blocks(blocks)


_INST_SQL = """s AS (SELECT user_id AS channel, ts, event_id, event_type, value, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS instance FROM events),
j AS (SELECT *, row_number() OVER (PARTITION BY channel, instance ORDER BY ts, event_id) AS j FROM s)"""


@query("q13_segments", f"WITH {_INST_SQL}, i AS (SELECT channel, instance, min(event_id) AS first_row, count(*) AS n_blocks FROM j WHERE instance > 0 GROUP BY 1, 2), g AS (SELECT channel, count(*) AS n_instances, min(first_row) AS first_row, arg_min(n_blocks, first_row) AS n_blocks FROM i GROUP BY channel) SELECT channel, n_instances, first_row, n_blocks, row_number() OVER (ORDER BY channel)::INT AS seg_id FROM g")
def q13(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").withColumnRenamed("user_id", "channel")
    marked = E.sessions(log, ["channel"], ["ts", "event_id"], F.col("event_type") == "purchase").where("instance > 0")
    instances = marked.groupBy("channel", "instance").agg(F.min("event_id").alias("first_row"), F.count("*").alias("n_blocks"))
    return E.segment_table(instances, "channel", "first_row", "n_blocks")


@query("q14_variable_positions", f"WITH r AS (SELECT o_orderpriority AS segment, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LOOP_ORDER_SQL}) AS j, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT segment, j::INT AS j, count(DISTINCT l_quantity) AS durations, count(*) AS n, count(DISTINCT l_quantity) > 1 AS variable FROM r GROUP BY 1, 2")
def q14(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("segment"))
    rows = _lines(spark, sf).withColumn("j", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LOOP_ORDER))).join(orders, "l_orderkey")
    return E.variable_positions(rows, "segment", "j", "l_quantity")


_ENERGY_SQL = "round(sum(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 4)"


@query(
    "q15_segment_energy_argmax",
    f"""WITH i AS (SELECT l_orderkey, count(*) AS n_blocks, {_ENERGY_SQL} + 0.0 AS energy FROM lineitem GROUP BY l_orderkey), r AS (SELECT o_orderpriority AS segment, l_orderkey AS instance, n_blocks, energy, row_number() OVER (PARTITION BY o_orderpriority ORDER BY energy DESC, l_orderkey) AS rk FROM i JOIN orders ON l_orderkey = o_orderkey)
SELECT segment, instance, n_blocks, energy FROM r WHERE rk = 1""",
)
def q15(spark: SparkSession, sf: str) -> DataFrame:
    """Loop rows to segment instances, their energy, and the strongest instance of each segment type."""
    energy = F.col("l_quantity") * F.col("l_quantity") + F.col("l_discount") * F.col("l_discount") + F.col("l_tax") * F.col("l_tax")
    instances = _lines(spark, sf).groupBy("l_orderkey").agg(F.count("*").alias("n_blocks"), settled(F.sum(energy), 4).alias("energy"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("segment"))
    named = instances.join(orders, "l_orderkey").withColumnRenamed("l_orderkey", "instance")
    return E.strongest_instance(named, "segment", "energy", "instance").select("segment", "instance", "n_blocks", "energy")


_ROWS_SQL = "t AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS duration FROM lineitem GROUP BY l_orderkey), c AS (SELECT *, sum(n) OVER (ORDER BY l_orderkey) AS last, sum(n) OVER (ORDER BY l_orderkey) - n + 1 AS first FROM t)"


@query("q16_whole_segment_window", f"WITH {_ROWS_SQL} SELECT count(*) FILTER (WHERE first < 1000) AS n_instances, coalesce(sum(duration) FILTER (WHERE first < 1000), 0)::BIGINT AS elapsed, max(last) FILTER (WHERE first < 1000)::BIGINT AS last_row, coalesce(max(last) FILTER (WHERE last <= 40000), 0)::BIGINT AS heat_rows FROM c")
def q16(spark: SparkSession, sf: str) -> DataFrame:
    instances = E.running_rows(_lines(spark, sf).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("duration")), "l_orderkey", "n")
    window = E.whole_segment_window(instances, "first", "last", "duration", 1000)
    return window.crossJoin(E.heat_rows(instances, "last", 40_000))


@query("q17_realised_slew", "WITH t AS (SELECT p_partkey, greatest(1.0 / p_size, 1.0 / (p_size + 2.0)) AS unit FROM part) SELECT l_returnflag, round(max(unit * abs(l_extendedprice)), 4) + 0.0 AS max_slew FROM lineitem JOIN t ON p_partkey = l_partkey GROUP BY l_returnflag")
def q17(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), E.unit_slew(F.col("p_size"), F.col("p_size") + 2.0).alias("unit"))
    met = _lines(spark, sf).join(parts, "l_partkey")
    return met.groupBy("l_returnflag").agg(settled(F.max(F.col("unit") * F.abs("l_extendedprice")), 4).alias("max_slew"))


_WAVE_SQL = f"w AS (SELECT *, abs(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {LOOP_ORDER_SQL})) AS step FROM lineitem), m AS (SELECT max(l_quantity) AS max_grad, max(step) AS max_slew, max(l_tax) AS max_b1, max(l_discount) * 900 AS peak_pns, max(l_discount) AS acoustics FROM w)"


@query(
    "q18_feasibility",
    f"""WITH {_WAVE_SQL} SELECT max_grad, max_slew, max_b1, round(peak_pns, 6) + 0.0 AS peak_pns, acoustics, max_grad <= 50 AND max_slew <= 49.5 AND max_b1 <= 0.25 AND peak_pns <= 100 AND acoustics <= 0.3 AS ok,
CASE WHEN max_grad > 50 THEN 'FAIL' ELSE 'ok' END AS grad, CASE WHEN max_slew > 49.5 THEN 'FAIL' ELSE 'ok' END AS slew, CASE WHEN peak_pns > 100 THEN 'FAIL' WHEN peak_pns > 80 THEN 'WARN' ELSE 'ok' END AS pns FROM m""",
)
def q18(spark: SparkSession, sf: str) -> DataFrame:
    step = F.abs(F.col("l_quantity") - F.lag("l_quantity").over(Window.partitionBy("l_orderkey").orderBy(*LOOP_ORDER)))
    values = _lines(spark, sf).withColumn("step", step).agg(F.max("l_quantity").alias("max_grad"), F.max("step").alias("max_slew"), F.max("l_tax").alias("max_b1"), (F.max("l_discount") * 900).alias("peak_pns"), F.max("l_discount").alias("acoustics"))
    specs = {"spec_grad": 50.0, "spec_slew": 49.5, "spec_b1": 0.25, "spec_pns": 100.0, "spec_acoustics": 0.3}
    judged = P.report(values.withColumns({k: F.lit(v) for k, v in specs.items()}))
    flags = [P.status(F.col("max_grad"), F.col("spec_grad")).alias("grad"), P.status(F.col("max_slew"), F.col("spec_slew")).alias("slew"), P.status(F.col("peak_pns"), F.col("spec_pns"), P.WARN_SHARE).alias("pns")]
    return judged.select("max_grad", "max_slew", "max_b1", settled(F.col("peak_pns")).alias("peak_pns"), "acoustics", "ok", *flags)


@query("q35_dual_echo_index", f"WITH {ACQ_SQL}, a AS (SELECT channel, i - 24 AS a FROM acq WHERE i >= 24) SELECT channel, (a % 2)::INT AS echo, ((a // 2) % 12)::INT AS iy, (a // 24)::INT AS iz FROM a")
def q35(spark: SparkSession, sf: str) -> DataFrame:
    index = R.dual_echo_index(F.col("i"), 12, 2)
    return acquisitions(spark, sf).select("channel", index.alias("x")).where("x IS NOT NULL").select("channel", "x.echo", "x.iy", "x.iz")


_OLD_SQL = "used AS (SELECT (o_custkey % 10000)::INT AS entry, max(epoch(o_orderdate))::DOUBLE AS mtime FROM orders GROUP BY 1)"


@query(
    "q43_entry_allocation",
    f"""WITH {_OLD_SQL}, c AS (SELECT n::INT AS entry, 0 AS tier, 0.0::DOUBLE AS mtime FROM range(10000) AS t(n) WHERE n NOT IN (SELECT entry FROM used) UNION ALL SELECT entry, 1, mtime FROM used)
SELECT entry, tier, row_number() OVER (ORDER BY tier, mtime, entry)::INT AS rank FROM c""",
)
def q43(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    entries = orders.groupBy((F.col("o_custkey") % K.CAPACITY).cast("int").alias("entry")).agg(F.max(seconds).alias("mtime"))
    return K.candidates(entries).select("entry", "tier", "rank")


@query("q45_frame_windows", f"WITH {ACQ_SQL} SELECT channel, i // 16 AS frame, count(*) AS n, count(*) = 16 AS complete FROM acq GROUP BY 1, 2")
def q45(spark: SparkSession, sf: str) -> DataFrame:
    acq = acquisitions(spark, sf).select(F.struct("channel", R.frames_of(F.col("i"), 16).alias("frame")).alias("frame"), F.col("i").alias("acq"))
    return R.frame_completeness(acq, 16).select("frame.channel", "frame.frame", "n", "complete")


@query("q46_scanner_catalog", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def q46(spark: SparkSession, sf: str) -> DataFrame:
    """The keyed lookup of the hardware catalog; nation and region have 25 and 5 rows at every scale, supplier stays as it is."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    met = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return met.select("s_suppkey", "s_name", "n_name", "r_name")
