"""Columns in lines, counted in code units, to byte offsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def position_encoding_norm(value: Column) -> Column:
    """1 for UTF-8, 2 for UTF-16, 3 for UTF-32 and anything else."""
    text = F.upper(F.trim(value.cast("string")))
    bare = F.regexp_replace(text, "[-_ ]", "")
    return (
        F.when(text == "1", 1).when(text == "2", 2).when(text == "3", 3)
        .when(bare.contains("UTF8"), 1).when(bare.contains("UTF16"), 2).otherwise(3)
    )


def unit_offset(line: str, col: int, unit: str) -> int:
    """Bytes before so many code units; an offset inside a character is an error."""
    left = max(0, int(col))
    at = 0
    for c in line:
        if left <= 0:
            break
        left -= len(c.encode()) if unit == "UTF8" else 2 if ord(c) > 0xFFFF else 1
        at += len(c.encode())
    if left < 0:
        raise ValueError(f"column {col} is inside a character")
    return at


def col_to_byte(line: Column, col: Column, unit: str | None = None) -> Column:
    """BYTE clamps to the line; UTF32 (the default) is native; UTF8 and UTF16 go through Arrow."""
    unit = (unit or "UTF32").upper().replace("-", "")
    if unit == "BYTE":
        return F.least(F.greatest(col.cast("long"), F.lit(0)), F.octet_length(line).cast("long"))
    if unit == "UTF32":
        return F.octet_length(F.substring(line, F.lit(1), F.greatest(col, F.lit(0)).cast("int"))).cast("long")

    @F.pandas_udf("long")
    def convert(lines: pd.Series, cols: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or pd.isna(b) else unit_offset(a, b, unit) for a, b in zip(lines, cols, strict=True)], dtype="Int64")

    return convert(line, col.cast("long"))


def canonicalize_byte_span(s_start: Column, s_text: Column, s_col: Column, e_start: Column, e_text: Column, e_col: Column, unit: str | None = None) -> Column:
    """struct<bstart, bend>: the start of a line and the column's offset, on both sides."""
    return F.struct(
        (s_start + col_to_byte(s_text, s_col, unit)).cast("long").alias("bstart"),
        (e_start + col_to_byte(e_text, e_col, unit)).cast("long").alias("bend"),
    )
