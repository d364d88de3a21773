"""Queries on signals and channel data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumafold.functions.columns import settled
from lumafold.operators import coils as C
from lumafold.operators import recon as R
from lumafold.operators import signal as G
from lumafold.plans.masks import query_set
from lumafold.plans.views import ACQ_SQL, COIL_SQL, acquisitions, coil_samples

QUERIES, ORACLES, query = query_set()


@query("q19_moving_average", f"WITH {ACQ_SQL} SELECT channel, i, round(avg(value) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS smooth FROM acq")
def q19(spark: SparkSession, sf: str) -> DataFrame:
    return G.moving_average(acquisitions(spark, sf), ["channel"], ["i"], "value", 5).select("channel", F.col("i").cast("long").alias("i"), settled(F.col("smooth")).alias("smooth"))


_PHASE_SQL = "(value * 0.37 - 2 * pi() * floor((value * 0.37 + pi()) / (2 * pi())))"


@query(
    "q20_phase_unwrap",
    f"""WITH {ACQ_SQL}, p AS (SELECT channel, i, round({_PHASE_SQL}, 9) AS phase FROM acq), d AS (SELECT *, phase - lag(phase) OVER (PARTITION BY channel ORDER BY i) AS step FROM p),
f AS (SELECT *, CASE WHEN step IS NULL OR abs(step) < pi() THEN 0.0 ELSE -2 * pi() * floor((step + pi()) / (2 * pi())) END AS fix FROM d)
SELECT channel, i, round(phase + sum(fix) OVER (PARTITION BY channel ORDER BY i), 5) + 0.0 AS unwrapped FROM f""",
)
def q20(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value") * 0.37
    phase = F.round(v - 2 * F.pi() * F.floor((v + F.pi()) / (2 * F.pi())), 9)
    return G.unwrap(acquisitions(spark, sf).withColumn("phase", phase), ["channel"], ["i"], "phase").select("channel", F.col("i").cast("long").alias("i"), settled(F.col("unwrapped"), 5).alias("unwrapped"))


@query(
    "q21_odd_even_phase",
    f"""WITH {ACQ_SQL}, p AS (SELECT channel, i // 2 AS pair, i % 2 AS side, value, value * 0.01 AS phase FROM acq),
j AS (SELECT a.channel, a.pair, a.value * b.value AS w, b.phase - a.phase AS d FROM p a JOIN p b ON a.channel = b.channel AND a.pair = b.pair AND a.side = 0 AND b.side = 1)
SELECT pair, count(*) AS n, round(atan2(sum(w * sin(d)), sum(w * cos(d))), 6) + 0.0 AS phase FROM j GROUP BY pair""",
)
def q21(spark: SparkSession, sf: str) -> DataFrame:
    acq = acquisitions(spark, sf).select("channel", F.floor(F.col("i") / 2).alias("pair"), (F.col("i") % 2).alias("side"), "value")
    # Both halves of a pair meet in one aggregation, instead of a self-join.
    pairs = acq.groupBy("channel", "pair").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("b")).where("b IS NOT NULL")
    w, d = F.col("a") * F.col("b"), F.col("b") * 0.01 - F.col("a") * 0.01
    return pairs.groupBy("pair").agg(F.count("*").alias("n"), settled(G.weighted_phase(w, d)).alias("phase"))


@query("q22_masked_fit", f"WITH {ACQ_SQL} SELECT channel, round(regr_intercept(value, i), 6) + 0.0 AS b0, round(regr_slope(value, i), 6) + 0.0 AS slope FROM acq WHERE value > 20 GROUP BY channel")
def q22(spark: SparkSession, sf: str) -> DataFrame:
    fit = G.masked_fit(acquisitions(spark, sf), ["channel"], "i", "value", F.col("value") > 20)
    return fit.select("channel", settled(F.col("offset")).alias("b0"), settled(F.col("slope")).alias("slope"))


@query(
    "q23_delay_selection",
    f"""WITH {ACQ_SQL}, c AS (SELECT d, d * 0.05 - 6 AS delay FROM range(241) AS t(d)), p AS (SELECT c.d, channel, i, round(value * 0.02 * (c.delay - 1.3), 9) AS phase FROM acq, c),
w AS (SELECT d, channel, i, phase, abs(phase - lag(phase) OVER (PARTITION BY d, channel ORDER BY i)) AS step FROM p),
r AS (SELECT d, count(*) FILTER (WHERE step > pi()) AS wrap_count, round(avg(phase), 6) AS a2 FROM w GROUP BY d)
SELECT d, wrap_count, a2 + 0.0 AS a2 FROM r ORDER BY (wrap_count = 0) DESC, CASE WHEN wrap_count = 0 THEN abs(a2) ELSE wrap_count END, d LIMIT 1""",
)
def q23(spark: SparkSession, sf: str) -> DataFrame:
    # The phase is linear in the delay, so one window and one pass of conditional counts serve all candidates.
    steps = G.difference(acquisitions(spark, sf), ["channel"], ["i"], "value", "step")
    turn = [0.02 * (d * 0.05 - 6 - 1.3) for d in range(241)]
    counts = F.array(*[F.count_if(F.abs("step") * abs(t) > F.pi()) for t in turn])
    tried = steps.agg(counts.alias("wraps"), F.avg("value").alias("mean")).select("mean", F.posexplode("wraps").alias("d", "wrap_count"))
    found = tried.select("d", "wrap_count", settled(F.col("mean") * 0.02 * (F.col("d") * 0.05 - 6 - 1.3)).alias("a2")).withColumn("delay", F.col("d"))
    return R.best_delay(found).select(F.col("d").cast("long").alias("d"), "wrap_count", "a2")


_DFT_SQL = "frames AS (SELECT channel, i // 32 AS f, i % 32 AS s, value FROM acq), k AS (SELECT k FROM range(32) AS t(k)), dft AS (SELECT channel, f, k, sum(value * cos(2 * pi() * ((s * k) % 32) / 32)) AS re, -sum(value * sin(2 * pi() * ((s * k) % 32) / 32)) AS im FROM frames, k GROUP BY channel, f, k)"


def _dft(spark: SparkSession, sf: str) -> DataFrame:
    acq = acquisitions(spark, sf).select("channel", F.floor(F.col("i") / 32).alias("f"), (F.col("i") % 32).cast("int").alias("i"), F.col("value").alias("re"), F.lit(0.0).alias("im"))
    return G.apply_weights(acq, G.dft_weights(spark, 32), ["channel", "f"])


@query("q24_dft_frames", f"WITH {ACQ_SQL}, {_DFT_SQL} SELECT channel, f, k, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM dft")
def q24(spark: SparkSession, sf: str) -> DataFrame:
    return _dft(spark, sf).select("channel", "f", F.col("k").cast("long").alias("k"), settled(F.col("re"), 4).alias("re"), settled(F.col("im"), 4).alias("im"))


_BANDS = [(0, 0.5, 3.5), (1, 2.0, 5.0), (2, 9.0, 12.0), (3, 40.0, 50.0)]
_BANDS_SQL = "bands AS (SELECT * FROM (VALUES " + ", ".join(f"({b}, {lo}::DOUBLE, {hi}::DOUBLE)" for b, lo, hi in _BANDS) + ") AS t(band, lo, hi))"


@query("q25_band_peaks", f"WITH {ACQ_SQL}, {_DFT_SQL}, {_BANDS_SQL}, h AS (SELECT (k + 16) % 32 - 16.0 + 0.0 AS hz, sqrt(re * re + im * im) AS mag FROM dft) SELECT band::INT AS band, round(coalesce(max(mag), 0), 4) + 0.0 AS peak FROM bands LEFT JOIN h ON hz BETWEEN lo AND hi GROUP BY band")
def q25(spark: SparkSession, sf: str) -> DataFrame:
    spectrum = _dft(spark, sf).select((F.pmod(F.col("k") + 16, F.lit(32)) - 16.0).alias("hz"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mag"))
    bands = spark.createDataFrame(_BANDS, "band int, lo double, hi double")
    return G.band_maximum(spectrum, bands).select("band", settled(F.col("peak"), 4).alias("peak"))


_KERNEL = [0.5, 0.25, 0.125, 0.0625]


@query(
    "q26_fir_and_rss",
    f"WITH {ACQ_SQL}, c AS (SELECT channel, i, " + " + ".join(f"coalesce(lag(value, {k}) OVER w, 0) * {c}" for k, c in enumerate(_KERNEL)) + " AS p FROM acq WINDOW w AS (PARTITION BY channel ORDER BY i)) SELECT i, round(sqrt(sum(p * p)), 6) + 0.0 AS total FROM c GROUP BY i",
)
def q26(spark: SparkSession, sf: str) -> DataFrame:
    filtered = G.short_convolution(acquisitions(spark, sf), ["channel"], ["i"], "value", _KERNEL, "p")
    return G.combined(filtered, ["i"], "p").select(F.col("i").cast("long").alias("i"), settled(F.col("total")).alias("total"))


@query(
    "q27_interpolated_shift",
    f"""WITH {ACQ_SQL}, n AS (SELECT channel, i, value, count(*) OVER (PARTITION BY channel) AS n FROM acq), s AS (SELECT *, greatest(0, least(floor(i - 0.3), n - 2)) AS j FROM n)
SELECT s.channel, s.i, round(a.value + (s.i - 0.3 - j) * (coalesce(b.value, a.value) - a.value), 6) + 0.0 AS shifted FROM s JOIN acq a ON a.channel = s.channel AND a.i = j LEFT JOIN acq b ON b.channel = s.channel AND b.i = j + 1""",
)
def q27(spark: SparkSession, sf: str) -> DataFrame:
    acq = acquisitions(spark, sf).select("channel", "i", "value")
    return G.shifted_samples(acq, ["channel"], "value", 0.3).select("channel", F.col("i").cast("long").alias("i"), settled(F.col("shifted")).alias("shifted"))


@query(
    "q28_as_of",
    "WITH b AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS e, value FROM events WHERE event_type = 'view'), m AS (SELECT b.user_id, b.event_id, arg_max(v.value, (v.ts, v.e)) AS last_view FROM b LEFT JOIN v ON v.user_id = b.user_id AND (v.ts, v.e) <= (b.ts, b.event_id) GROUP BY 1, 2) SELECT user_id, event_id, last_view FROM m",
)
def q28(spark: SparkSession, sf: str) -> DataFrame:
    from lumafold.session import table

    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    buys = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    views = events.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    return G.as_of(buys, views, ["user_id"], ["ts", "event_id"], "value", "last_view").select("user_id", "event_id", "last_view")


@query("q29_channel_gram", f"WITH {COIL_SQL}, n AS (SELECT count(DISTINCT sample) AS n FROM coilvec) SELECT a.coil::INT AS i, b.coil::INT AS j, round(sum(a.re * b.re + a.im * b.im) / max(n.n), 6) + 0.0 AS re, round(sum(a.re * b.im - a.im * b.re) / max(n.n), 6) + 0.0 AS im FROM coilvec a JOIN coilvec b ON a.sample = b.sample, n GROUP BY 1, 2")
def q29(spark: SparkSession, sf: str) -> DataFrame:
    return C.gram(coil_samples(spark, sf)).select("i", "j", settled(F.col("re")).alias("re"), settled(F.col("im")).alias("im"))


@query(
    "q30_explained_energy",
    f"""WITH {COIL_SQL}, e AS (SELECT coil::INT AS coil, round(sum(re * re + im * im), 6) AS energy FROM coilvec GROUP BY coil), c AS (SELECT coil, row_number() OVER (ORDER BY energy DESC, coil) AS rank, sum(energy) OVER (ORDER BY energy DESC, coil ROWS UNBOUNDED PRECEDING) / sum(energy) OVER () AS share FROM e)
SELECT coil, rank, round(share, 6) + 0.0 AS share, least(greatest((SELECT min(rank) FROM c WHERE share >= 0.9), 4), 32)::INT AS kept FROM c""",
)
def q30(spark: SparkSession, sf: str) -> DataFrame:
    energy = coil_samples(spark, sf).groupBy("coil").agg(F.round(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 6).alias("energy"))
    ranked = G.cumulative_share(energy, "energy", [F.desc("energy"), F.asc("coil")])
    kept = C.channels_for_energy(np.diag([r["energy"] for r in energy.collect()]), 0.9, 4)  # a row for each channel
    return ranked.select("coil", F.col("rank").cast("long").alias("rank"), settled(F.col("share")).alias("share"), F.lit(kept).alias("kept"))


@query("q31_whitening", "SELECT i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS re, 0.0::DOUBLE AS im FROM range(32) AS a(i), range(32) AS b(j)")
def q31(spark: SparkSession, sf: str) -> DataFrame:
    samples = coil_samples(spark, sf).select("sample", "coil", "re", "im")
    after = C.gram(C.mixed(samples, C.whitening(samples), conjugate=True))
    return after.select("i", "j", settled(F.col("re"), 5).alias("re"), settled(F.col("im"), 5).alias("im"))


@query("q32_compression")
def q32(spark: SparkSession, sf: str) -> DataFrame:
    samples = coil_samples(spark, sf).select("sample", "coil", "re", "im")
    covariance = C.matrix_of(C.gram(samples, conjugate_first=False))
    count = C.channels_for_energy(covariance, 0.9, 4)
    squeezed = C.mixed(samples, C.compression(covariance, count), conjugate=False)
    total = float(np.trace(covariance).real)
    n = samples.select("sample").distinct().count()
    return squeezed.groupBy("coil").agg((F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (n * total)).alias("share")).withColumn("kept", F.lit(count))


@query("q36_rss_normalised", f"WITH {COIL_SQL}, t AS (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY sample)) AS s FROM coilvec) SELECT sample, round(max(s), 6) + 0.0 AS rss, round(sum((re * re + im * im) / CASE WHEN s < 1e-12 THEN 1 ELSE s * s END), 6) + 0.0 AS after FROM t GROUP BY sample")
def q36(spark: SparkSession, sf: str) -> DataFrame:
    samples = coil_samples(spark, sf)
    before = R.rss(samples, ["sample"])
    after = R.normalised(samples, ["sample"]).groupBy("sample").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("after"))
    return before.join(after, "sample").select("sample", settled(F.col("rss")).alias("rss"), settled(F.col("after")).alias("after"))


@query("q44_percentile_scale", f"WITH {COIL_SQL} SELECT round(1.0 / quantile_cont(sqrt(re * re + im * im), 0.99), 8) + 0.0 AS scale FROM coilvec WHERE re <> 0 OR im <> 0")
def q44(spark: SparkSession, sf: str) -> DataFrame:
    magnitude = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return G.percentile_scale(coil_samples(spark, sf), magnitude).select(settled(F.col("scale"), 8).alias("scale"))
