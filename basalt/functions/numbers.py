"""Numbers and times where the engine's rule is not Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Euclid on 64-bit integers; the number of steps is bounded by the width (at most 93)."""
    pair = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % s["y"]).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(93)), pair, step)["x"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(a).cast("long") * (F.abs(b).cast("long") / g).cast("long"))


def iszero(x: Column) -> Column:
    return x == 0


def trunc(x: Column, places: int = 0) -> Column:
    """Towards zero at so many decimal places."""
    scale = F.lit(10.0**places)
    return F.when(x >= 0, F.floor(x * scale)).otherwise(F.ceil(x * scale)).cast("double") / scale


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def int_div(a: Column, b: Column) -> Column:
    """Integer division truncates."""
    return F.when(b != 0, ((a - a % b) / b).cast("long"))


def day_of_week(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def date_bin(seconds: int, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the stretch of so many seconds, counted from the origin, in which a time lies."""
    base = F.unix_seconds(F.to_timestamp(F.lit(origin)))
    return F.timestamp_seconds(F.floor((F.unix_seconds(ts) - base) / seconds) * seconds + base)


def from_unixtime(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_unixtime(ts: Column) -> Column:
    return F.unix_seconds(ts)
