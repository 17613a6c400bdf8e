"""Readers, writers and file pruning over Spark's own sources."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats that Spark itself reads; avro needs its package on the class path.
FORMATS = ("parquet", "csv", "json", "orc", "text", "avro", "binaryFile")


def open_dataset(spark: SparkSession, source, fmt: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """A path, several paths, an Arrow table, a pandas frame, rows, columns, or a DataFrame."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str) or (isinstance(source, list) and source and isinstance(source[0], str)):
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt}")
        reader = spark.read.format(fmt).options(**options)
        return (reader.schema(schema) if schema else reader).load(source)
    if isinstance(source, dict):  # columns
        rows = [dict(zip(source, r, strict=True)) for r in zip(*source.values(), strict=True)]
        return spark.createDataFrame(rows, schema) if schema else spark.createDataFrame(rows).select(*source)
    return spark.createDataFrame(source, schema) if schema else spark.createDataFrame(source)


def union_dataset(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def with_defaults(df: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """The schema's columns: missing ones get their default, or null; others are cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def param_table(spark: SparkSession, values: list, dtype: str = "string", name: str = "value") -> DataFrame:
    """A list of values as a table to join with."""
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options) -> None:
    """Modes error, overwrite and append; CSV and JSON take no partitions."""
    if fmt in ("csv", "json") and partition_by:
        raise ValueError(f"{fmt} is not partitioned")
    writer = df.write.format(fmt).mode("errorifexists" if mode == "error" else mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


@dataclass(frozen=True)
class FileFilter:
    """A condition on a column's partition value, or on its range in a file: = != > >= < <= in, not in."""

    column: str
    op: str
    value: object


def candidate_files(index: DataFrame, filters: list[FileFilter]) -> DataFrame:
    """Files of an index (path, min_<column>, max_<column>) that can hold a matching row; all without a filter.

    A file whose range is not known stays.
    """
    for f in filters:
        lo, hi = F.col(f"min_{f.column}"), F.col(f"max_{f.column}")
        may = {
            "=": lambda v: (lo <= v) & (hi >= v), "!=": lambda v: ~((lo == v) & (hi == v)), ">": lambda v: hi > v, ">=": lambda v: hi >= v,
            "<": lambda v: lo < v, "<=": lambda v: lo <= v,
        }
        if f.op == "in":
            test = reduce(lambda a, b: a | b, [may["="](v) for v in f.value], F.lit(False))
        elif f.op == "not in":
            test = ~((lo == hi) & lo.isin(list(f.value)))
        else:
            test = may[f.op](f.value)
        index = index.where(F.coalesce(test, F.lit(True)))
    return index


#: Rows below and above which a table is small or large.
SMALL_ROWS, LARGE_ROWS = 10_000, 1_000_000


def size_tier(rows: int | None) -> str:
    """An unknown size is medium."""
    if rows is None:
        return "medium"
    return "small" if rows < SMALL_ROWS else "large" if rows > LARGE_ROWS else "medium"
