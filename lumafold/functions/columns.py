"""Column helpers that several operators share. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *ids: Column) -> Column:
    """A uniform in [0, 1) that any engine with md5 reproduces, from a seed and the ids' decimal texts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def settled(value: Column, places: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(value, places) + F.lit(0.0)


def round_away(value: Column) -> Column:
    """Half away from zero, to a whole number."""
    return F.round(value).cast("long")


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def c_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_conj(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def c_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def c_angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def c_polar(radius: Column, angle: Column) -> Column:
    return complex_of(radius * F.cos(angle), radius * F.sin(angle))


def shifted(k: Column, n: int, inverse: bool = False) -> Column:
    """Place of frequency k after the zero frequency is moved to the middle (or back, for ``inverse``)."""
    return F.pmod(k + F.lit((n + 1) // 2 if inverse else n // 2), F.lit(n))


def wrapped(delta: Column) -> Column:
    """An angle's difference brought into (-pi, pi], with a step of exactly -pi or pi keeping its sign's side."""
    tau = F.lit(2.0) * F.pi()
    low = F.pmod(delta + F.pi(), tau) - F.pi()
    return F.when((low == -F.pi()) & (delta > 0), F.pi()).otherwise(low)
