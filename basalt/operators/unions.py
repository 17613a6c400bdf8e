"""Unions: tolerant of schema drift, strict, and to a canonical schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical columns of nodes and edges.
NODE_SCHEMA = T.StructType().add("entity_id", "string").add("path", "string").add("bstart", "long").add("bend", "long")
EDGE_SCHEMA = T.StructType().add("source_id", "string").add("target_id", "string").add("path", "string").add("bstart", "long").add("bend", "long")


def union_by_name(sources: dict[str, DataFrame], discriminator: str | None = None, distinct: bool = False) -> DataFrame:
    """Missing columns become null, columns are in alphabetical order, ``distinct`` includes the discriminator."""
    if not sources:
        raise ValueError("a union needs a source")
    parts = [df.withColumn(discriminator, F.lit(name)) if discriminator else df for name, df in sources.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = out.select(*sorted(out.columns))
    return out.distinct() if distinct else out


def union_with_discriminator(tables: dict[str, DataFrame], discriminator: str = "kind") -> DataFrame:
    """All rows with their table's name; the tables must have the same columns in the same order."""
    if not tables:
        raise ValueError("a union needs a source")
    if len({tuple(df.columns) for df in tables.values()}) > 1:
        raise ValueError("the tables differ in their columns")
    return reduce(DataFrame.union, [df.withColumn(discriminator, F.lit(n)) for n, df in tables.items()])


def project_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Casts what is there, typed nulls for what is missing, drops the rest."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def union_nodes(tables: dict[str, DataFrame], discriminator: str = "node_kind") -> DataFrame:
    return union_with_discriminator({n: project_to_schema(df, NODE_SCHEMA) for n, df in tables.items()}, discriminator)


def union_edges(tables: dict[str, DataFrame], discriminator: str = "edge_kind") -> DataFrame:
    return union_with_discriminator({n: project_to_schema(df, EDGE_SCHEMA) for n, df in tables.items()}, discriminator)
