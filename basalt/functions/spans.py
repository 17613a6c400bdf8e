"""Byte spans as structs; every predicate is a native expression, so it can become a join condition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_make(bstart, bend, line_base=0, col_unit="byte", end_exclusive=True) -> Column:
    """struct<bstart long, bend long, line_base int, col_unit string, end_exclusive boolean>; never null itself."""
    as_col = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    unit = col_unit if isinstance(col_unit, Column) else F.lit(col_unit)
    return F.struct(
        as_col(bstart).cast("long").alias("bstart"),
        as_col(bend).cast("long").alias("bend"),
        as_col(line_base).cast("int").alias("line_base"),
        unit.cast("string").alias("col_unit"),
        as_col(end_exclusive).cast("boolean").alias("end_exclusive"),
    )


def span_start(span: Column) -> Column:
    return span["bstart"]


def span_end(span: Column) -> Column:
    return span["bend"]


def span_len(span: Column) -> Column:
    return span["bend"] - span["bstart"]


def _open_end(span: Column) -> Column:
    """The end as an exclusive bound; a missing flag means exclusive."""
    return F.when(F.coalesce(span["end_exclusive"], F.lit(True)), span["bend"]).otherwise(span["bend"] + 1)


def span_overlaps(a: Column, b: Column) -> Column:
    """True if the spans share a byte; null if a bound is null."""
    known = a["bstart"].isNotNull() & a["bend"].isNotNull() & b["bstart"].isNotNull() & b["bend"].isNotNull()
    return F.when(known, (a["bstart"] < _open_end(b)) & (b["bstart"] < _open_end(a)))


def span_contains(a: Column, b: Column) -> Column:
    """True if b lies in a; null if a bound is null."""
    known = a["bstart"].isNotNull() & a["bend"].isNotNull() & b["bstart"].isNotNull() & b["bend"].isNotNull()
    return F.when(known, (a["bstart"] <= b["bstart"]) & (_open_end(b) <= _open_end(a)))


def interval_align_score(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """Shorter right intervals score higher: minus the right length; null if any bound is null."""
    known = ls.isNotNull() & le.isNotNull() & rs.isNotNull() & re.isNotNull()
    return F.when(known, -(re - rs).cast("double"))
