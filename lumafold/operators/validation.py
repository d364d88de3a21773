"""Comparison of two versions of nested tables, field by field, under a rule for each field.

Every leaf of the schema becomes a row (path, ours, theirs, ulps, verdict): structs and arrays are walked as the schema says, so paths
read like ``parents[3].gx.amplitude``. Presence is compared before values, and numbers by the first rule whose pattern
matches the path. All in DataFrame expressions; rows meet in one join.

Verdicts: equal (the same value, both absent, or both not a number), within (unequal, but the rule allows it), sign (one is the other's
negative, and the rule doesn't allow it), differs, and only_ours or only_theirs for a field, item or row that the other lacks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumafold.sources.loopfile import Gradient, decode, read_loops


@dataclass(frozen=True)
class Rule:
    """How far numbers may lie apart whose path, indices left out, matches ``pattern``: absolutely plus relative to theirs, or in units in the last place."""

    pattern: str
    absolute: float = 0.0
    relative: float = 0.0
    ulps: int = 0


def float_index(value: Column, single: bool = False) -> Column:
    """The place of a number among the floats (doubles, or singles) in order: neighbours are one apart, both zeros are 0. Null for what isn't finite."""
    digits, least = (23, -126) if single else (52, -1022)
    x = F.abs(value.cast("double"))
    # The logarithm may be off by one beside a power of two.
    about = F.greatest(F.lit(least), F.floor(F.log2(x)).cast("int"))
    power = F.greatest(F.lit(least), F.when(F.pow(F.lit(2.0), about) > x, about - 1).when(x / F.pow(F.lit(2.0), about) >= 2, about + 1).otherwise(about))
    size = (power - least).cast("long") * (1 << digits) + F.floor(x / F.pow(F.lit(2.0), power) * float(1 << digits)).cast("long")
    finite = value.isNotNull() & ~F.isnan(value) & (x != float("inf"))
    return F.when(finite & (x == 0), F.lit(0).cast("long")).when(finite, F.when(value < 0, -size).otherwise(size))


def ulps_between(a: Column, b: Column, single: bool = False) -> Column:
    """Steps between two numbers along the floats, as a double (exact below 2^53)."""
    apart = lambda c: float_index(c, single).cast("decimal(20,0)")
    return F.abs(apart(a) - apart(b)).cast("double")


def _leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """An array of (path, text, number, place) for all leaves under a value."""

    def leaf(at: Column, text: Column, number: Column | None = None, place: Column | None = None) -> Column:
        none = F.lit(None)
        return F.array(F.struct(at.alias("path"), text.cast("string").alias("text"), (none if number is None else number).cast("double").alias("number"), (none if place is None else place).cast("long").alias("place")))

    if isinstance(kind, T.StructType):
        inner = [_leaves(value.getField(f.name), f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields]
        return F.when(value.isNull(), leaf(path, F.lit(None))).otherwise(F.concat(leaf(path, F.lit("present")), *inner))
    if isinstance(kind, T.ArrayType):
        items = F.flatten(F.transform(value, lambda x, i: _leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(value.isNull(), leaf(path, F.lit(None))).otherwise(F.concat(leaf(F.concat(path, F.lit(".size")), F.size(value), F.size(value)), items))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return leaf(path, value, value, float_index(value, isinstance(kind, T.FloatType)))
    if isinstance(kind, T.NumericType):
        return leaf(path, value, value)
    return leaf(path, value)


def leaves(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, path, text, number, place: a row for each leaf of each row (map columns aren't walked)."""
    rest = [f for f in table.schema.fields if f.name not in key]
    if maps := [f.name for f in rest if isinstance(f.dataType, T.MapType)]:
        raise ValueError(f"maps have no order of their own to compare by: {maps}")
    every = F.concat(*[_leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in rest])
    return table.select(*key, F.explode(every).alias("leaf")).select(*key, "leaf.*")


def compared(ours: DataFrame, theirs: DataFrame, key: Sequence[str], rules: Sequence[Rule] = ()) -> DataFrame:
    """key, path, ours, theirs, ulps, verdict for every leaf of either table. Rows are named by ``key``, which must be unique."""
    renamed = lambda side, t: leaves(t, key).select(*key, "path", F.col("text").alias(side), F.col("number").alias(f"__{side}"), F.col("place").alias(f"__{side}_place"), F.lit(True).alias(f"__has_{side}"))
    both = renamed("ours", ours).join(renamed("theirs", theirs), [*key, "path"], "full_outer")
    a, b = F.col("__ours"), F.col("__theirs")
    plain = F.regexp_replace("path", r"\[\d+\]", "")
    ulps = F.abs(F.col("__ours_place").cast("decimal(20,0)") - F.col("__theirs_place").cast("decimal(20,0)")).cast("double")
    allowed = reduce(
        lambda rest, r: F.when(plain.rlike(r.pattern), (F.abs(a - b) <= r.absolute + r.relative * F.abs(b)) | (F.coalesce(ulps, F.lit(float("inf"))) <= r.ulps if r.ulps else F.lit(False))).otherwise(rest),
        reversed(list(rules)),
        F.lit(False),
    )
    # Whole numbers are compared as text, since large ones are alike as doubles; floats by place, which is one for both zeros.
    same = F.col("ours").eqNullSafe(F.col("theirs")) | F.coalesce(F.col("__ours_place") == F.col("__theirs_place"), F.lit(False))
    verdict = (
        F.when(F.col("__has_theirs").isNull(), "only_ours")
        .when(F.col("__has_ours").isNull(), "only_theirs")
        .when(same, "equal")
        .when(F.col("ours").isNull(), "only_theirs")
        .when(F.col("theirs").isNull(), "only_ours")
        .when(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b), "differs")
        .when(allowed & (a != b), "within")
        .when((a == -b), "sign")
        .otherwise("differs")
    )
    return both.select(*key, "path", "ours", "theirs", ulps.alias("ulps"), verdict.alias("verdict"))


def field_report(verdicts: DataFrame) -> DataFrame:
    """field (path without indices), leaves, worst_ulps, the count of each verdict, and ok: nothing beyond its rule."""
    kinds = ["equal", "within", "sign", "differs", "only_ours", "only_theirs"]
    counted = verdicts.groupBy(F.regexp_replace("path", r"\[\d+\]", "").alias("field")).agg(
        F.count("*").alias("leaves"), F.max("ulps").alias("worst_ulps"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds]
    )
    return counted.withColumn("ok", F.col("equal") + F.col("within") == F.col("leaves"))


#: How far figures of two loop files may lie apart.
LOOP_RULES = (
    Rule(r"^limits\.", 1e-3, 1e-4),
    Rule(r"^parents\.duration$", 1e-9),
    Rule(r"\.(waveform|magnitude)$", 1e-4, 1e-3),
    Rule(r"^value$", 1e-4, 1e-4),
    Rule(r"\.(delay|rise|flat|fall|dwell|times|phase|duration)$", 1e-9, 1e-6),
)

_GRADIENT = pa.struct([(c, pa.float64()) for c in ("delay", "rise", "flat", "fall")] + [(c, pa.list_(pa.float64())) for c in ("times", "waveform")])
_CONTENT = pa.schema([
    ("file", pa.string()), ("readouts", pa.int32()), ("quantum", pa.int32()), ("heat_rows", pa.int32()), ("rows", pa.int32()), ("columns", pa.int32()),
    ("limits", pa.struct([(c, pa.float64()) for c in ("power", "b1", "gradient", "slew", "duration")])),
    ("segments", pa.list_(pa.struct([("number", pa.int32()), ("blocks", pa.list_(pa.int32())), ("strongest_row", pa.int32())]))),
    ("parents", pa.list_(pa.struct([
        ("number", pa.int32()), ("duration", pa.float64()), ("gx", _GRADIENT), ("gy", _GRADIENT), ("gz", _GRADIENT),
        ("pulse", pa.struct([("duration", pa.float64()), ("delay", pa.float64())] + [(c, pa.list_(pa.float64())) for c in ("times", "magnitude", "phase")])),
        ("adc", pa.struct([("samples", pa.int32()), ("dwell", pa.float64()), ("delay", pa.float64())])),
    ]))),
])


def read_contents(spark: SparkSession, path: str, suffix: str = "pge") -> DataFrame:
    """A row for each loop file under ``path``: its name, header figures, segments and parents, nested as they are; the loop's rows are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "content")
    numbers = lambda x: None if x is None else [float(v) for v in x]

    def gradient(g: Gradient | None) -> dict | None:
        return None if g is None else {"delay": g.delay, "rise": g.rise, "flat": g.flat, "fall": g.fall, "times": numbers(g.times), "waveform": numbers(g.waveform)}

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = decode(content)
                parents = [
                    {
                        "number": p.number, "duration": p.duration, **dict(zip(("gx", "gy", "gz"), map(gradient, p.axes), strict=True)),
                        "pulse": None if p.pulse is None else {"duration": p.pulse.duration, "delay": p.pulse.delay, **{c: numbers(getattr(p.pulse, c)) for c in ("times", "magnitude", "phase")}},
                        "adc": None if p.adc is None else dict(zip(("samples", "dwell", "delay"), p.adc, strict=True)),
                    }
                    for p in found.parents
                ]
                row = {
                    "file": name.rsplit("/", 1)[-1], "readouts": found.readouts, "quantum": found.quantum, "heat_rows": found.heat_rows, "rows": found.loop.shape[0], "columns": found.loop.shape[1],
                    "limits": dict(zip(("power", "b1", "gradient", "slew", "duration"), found.limits, strict=True)),
                    "segments": [{"number": s.number, "blocks": list(s.blocks), "strongest_row": s.strongest_row} for s in found.segments], "parents": parents,
                }
                yield pa.RecordBatch.from_pylist([row], schema=_CONTENT)

    from pyspark.sql.pandas.types import from_arrow_schema

    return files.mapInArrow(rows, from_arrow_schema(_CONTENT))


def compare_loop_files(spark: SparkSession, ours: str, theirs: str, rules: Sequence[Rule] = LOOP_RULES) -> DataFrame:
    """file, row, column, path, ours, theirs, ulps, verdict over all loop files of two folders that have the same names; row and column are null outside the loops."""
    inside = compared(read_contents(spark, ours), read_contents(spark, theirs), ["file"], rules)
    name = F.element_at(F.split("path", "/"), -1)
    loop = lambda p: read_loops(spark, p).select(name.alias("file"), "row", "column", F.col("value").cast("float").alias("value"))
    loops = compared(loop(ours), loop(theirs), ["file", "row", "column"], rules)
    return loops.unionByName(inside, allowMissingColumns=True)
