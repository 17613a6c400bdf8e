"""Deterministic aggregates and their forms over sliding frames.

All are compositions of Spark's own aggregates, so partial aggregation, spilling and frames come from Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def list_unique(value: Column, ignore_nulls: bool = True) -> Column:
    """Distinct values in byte order; with nulls respected, one null comes last."""
    if ignore_nulls:
        return F.array_sort(F.collect_set(value))
    return F.array_sort(F.transform(F.collect_set(F.struct(value.alias("x"))), lambda s: s["x"]))


collect_set = list_unique


def count_distinct_agg(value: Column, ignore_nulls: bool = True) -> Column:
    """With nulls respected, a null counts as one more value."""
    out = F.count_distinct(value)
    return out if ignore_nulls else out + F.coalesce(F.max(value.isNull().cast("long")), F.lit(0))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def string_agg(value: Column, order: Column, separator: str = ",") -> Column:
    """Non-null values joined in the order of a key; null if there are none."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("k"), value.cast("string").alias("v")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: p["v"]), separator))


def _known(value: Column, key: Column, pair: Column) -> Column:
    return F.when(value.isNotNull() & key.isNotNull(), pair)


def arg_min(value: Column, key: Column) -> Column:
    """The value at the smallest key, of equal keys the smallest value; rows with a null are skipped."""
    return F.min(_known(value, key, F.struct(key.alias("k"), value.alias("v"))))["v"]


def descending(key: Column, kind: str = "number") -> Column:
    """A value that sorts the other way round, exactly: for a number, integer, text, date, timestamp, local_timestamp
    (a time without a zone) or boolean.

    Numbers change their sign, and NaN, which is above all, comes first; integers flip their bits, so that the least one has
    a counterpart; so do the bytes of a text, and an end that is above every byte makes the longer text come first.  A time without a zone is never read in the session's zone, whose clocks may skip it.
    """
    if kind == "local_timestamp":
        return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") - key
    if kind == "number":
        return F.struct((~F.isnan(key)).alias("nan"), (-key).alias("k"))
    if kind in ("integer", "date", "timestamp"):
        whole = {"integer": key, "date": F.unix_date(key) if kind == "date" else key, "timestamp": F.unix_micros(key) if kind == "timestamp" else key}[kind]
        return F.bitwise_not(whole.cast("long"))
    if kind == "text":
        return F.concat(F.translate(F.hex(key.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    if kind == "boolean":
        return ~key
    raise ValueError(f"unknown kind of key {kind}")


def arg_max(value: Column, key: Column, kind: str = "number") -> Column:
    """The value at the largest key, of equal keys the smallest value; rows with a null are skipped.

    ``kind`` says what the key is (``descending``).  One aggregate that combines map-side.
    """
    return F.min(_known(value, key, F.struct(descending(key, kind).alias("k"), value.alias("v"))))["v"]


def any_value_det(value: Column, key: Column) -> Column:
    return arg_min(value, key)


def asof_select(value: Column, key: Column, kind: str = "number") -> Column:
    """The latest value."""
    return arg_max(value, key, kind)


def array_agg(value: Column) -> Column:
    """All values, nulls kept."""
    return F.transform(F.collect_list(F.struct(value.alias("x"))), lambda s: s["x"])


def sliding_list_unique(value: Column, frame: WindowSpec) -> Column:
    return F.array_sort(F.collect_set(value).over(frame))


def sliding_count_distinct(value: Column, frame: WindowSpec) -> Column:
    """Spark has no DISTINCT in windows; the frame's set has the count."""
    return F.size(F.collect_set(value).over(frame)).cast("long")


def sliding_any_value_det(value: Column, key: Column, partition: list[str], order: list[Column]) -> Column:
    """A value that has been in the frame stays: the frame always starts at the first row."""
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.min(_known(value, key, F.struct(key.alias("k"), value.alias("v")))).over(frame)["v"]


def row_number_window(partition: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def lag_window(value: Column, partition: list[str], order: list[Column], offset: int = 1) -> Column:
    return F.lag(value, offset).over(Window.partitionBy(*partition).orderBy(*order))


def lead_window(value: Column, partition: list[str], order: list[Column], offset: int = 1) -> Column:
    return F.lead(value, offset).over(Window.partitionBy(*partition).orderBy(*order))
