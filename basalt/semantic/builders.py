"""Domain views: byte spans from lines and columns, unnested spans, types, diagnostics, canonical relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import joined_parts, stable_hash128
from ..functions.positions import canonicalize_byte_span
from ..functions.spans import span_make
from ..functions.text import utf8_normalize
from ..operators.intervals import line_index_join
from ..operators.unions import project_to_schema

#: Canonical columns of a relation.
RELATION_SCHEMA = (
    T.StructType().add("entity_id", "string").add("symbol", "string").add("symbol_roles", "integer").add("path", "string").add("edge_owner_file_id", "string")
    .add("bstart", "long").add("bend", "long").add("resolution_method", "string").add("confidence", "double").add("score", "double").add("task_name", "string").add("task_priority", "integer")
)
LINE_COLUMNS = ("start_line", "end_line", "start_col", "end_col", "start_char", "end_char", "line", "col", "line_no")


def drop_line_columns(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*LINE_COLUMNS, *extra)


def normalize_byte_span(df: DataFrame, index: DataFrame | None = None, key: str = "file_id", unit: str | None = None) -> DataFrame:
    """bstart and bend from the best there is: as they are, a byte start and length, or lines and columns by the line index."""
    have = set(df.columns)
    if {"bstart", "bend"} <= have:
        out = df
    elif {"byte_start", "byte_len"} <= have:
        out = df.withColumn("bstart", F.col("byte_start").cast("long")).withColumn("bend", (F.col("byte_start") + F.col("byte_len")).cast("long"))
    elif "span" in have and "byte_span" in df.schema["span"].dataType.names:
        s = F.col("span.byte_span")
        out = df.withColumn("bstart", s["byte_start"].cast("long")).withColumn("bend", (s["byte_start"] + s["byte_len"]).cast("long")).drop("span")
    elif index is None:
        raise ValueError("lines need the line index")
    else:
        joined = line_index_join(df, index, "start_line", "end_line", key)
        c = F.col
        span = canonicalize_byte_span(c("start_line_start"), c("start_line_text"), c("start_col"), c("end_line_start"), c("end_line_text"), c("end_col"), unit)
        out = joined.withColumn("_s", span).withColumn("bstart", F.col("_s.bstart")).withColumn("bend", F.col("_s.bend"))
        out = out.drop("_s", "start_line_start", "start_line_text", "end_line_start", "end_line_text")
    return out.withColumn("span", span_make("bstart", "bend"))


def occurrences_to_bytes(occurrences: DataFrame | None, index: DataFrame | None, spark: SparkSession, key: str = "path", unit: str | None = None) -> DataFrame:
    """Symbol occurrences by line and character to byte spans; lines count from ``line_base``.  Empty without either table."""
    if occurrences is None or index is None:
        return spark.createDataFrame([], f"{key} string, symbol string, symbol_roles int, bstart long, bend long")
    based = occurrences.withColumn("start_line", F.col("start_line") - F.coalesce("line_base", F.lit(0))).withColumn("end_line", F.col("end_line") - F.coalesce("line_base", F.lit(0)))
    based = based.withColumnRenamed("start_char", "start_col").withColumnRenamed("end_char", "end_col")
    return drop_line_columns(normalize_byte_span(based, index, key, unit)).select(key, "symbol", "symbol_roles", "bstart", "bend")


def line_table_bytes(lines: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    """A bytecode line table with the byte at which each of its lines starts."""
    i = index.select(F.col(key).alias("_k"), F.col("line_no").alias("_n"), "line_start_byte")
    return lines.join(i, (lines[key] == i["_k"]) & (lines["line_no"] == i["_n"]), "left").drop("_k", "_n")


def unnest_spans(df: DataFrame, span: str = "span", keep: tuple[str, ...] = ("file_id", "path")) -> DataFrame:
    s = F.col(span)
    return df.select(*keep, s["bstart"].alias("bstart"), s["bend"].alias("bend"), s.alias("span"), s["col_unit"].alias("col_unit"))


def relation_output(df: DataFrame, name: str, priority: int = 0, method: str | None = None) -> DataFrame:
    """The canonical columns; the owner of an edge is its file, or its path where the file is not known."""
    have = set(df.columns)
    owner = [F.col(c).cast("string") for c in ("edge_owner_file_id", "file_id", "path") if c in have]
    df = df.withColumn("edge_owner_file_id", F.coalesce(*owner) if owner else F.lit(None).cast("string"))
    df = df.withColumn("task_name", F.lit(name)).withColumn("task_priority", F.lit(priority)).withColumn("resolution_method", F.lit(method or name))
    return project_to_schema(df, RELATION_SCHEMA)


def type_exprs(df: DataFrame, text: str = "expr_text", namespace: str = "type_expr") -> DataFrame:
    """Type expressions with a normalised text, an id of their place and one of their type."""
    df = df.withColumn("type_repr", utf8_normalize(F.col(text), casefold=False)).where("type_repr is not null")
    df = df.withColumn("type_expr_id", F.concat(F.lit(f"{namespace}:"), stable_hash128(joined_parts("path", "bstart", "bend"))))
    return df.withColumn("type_id", F.concat(F.lit("type:"), stable_hash128("type_repr"))).withColumn("span", span_make("bstart", "bend"))


def type_nodes(annotations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each type once, from annotations and from symbols."""
    cols = ("type_id", "type_repr", "type_form", "origin")
    a = annotations.select("type_id", "type_repr", F.lit("annotation").alias("type_form"), F.lit("annotation").alias("origin"))
    b = symbols.select(F.concat(F.lit("type:"), stable_hash128("type_repr")).alias("type_id"), "type_repr", F.lit("symbol").alias("type_form"), F.lit("inferred").alias("origin"))
    return a.union(b).select(*cols).distinct()


def diagnostics_view(errors: DataFrame | None, spark: SparkSession, severity: str = "ERROR", message: str = "syntax error", source: str = "parser") -> DataFrame:
    """Syntax errors as diagnostics; empty without the table."""
    schema = "path string, bstart long, bend long, severity string, message string, diag_source string, diag_id string"
    if errors is None:
        return spark.createDataFrame([], schema)
    ident = F.concat(F.lit("diag:"), stable_hash128(joined_parts("path", "bstart", "bend", F.lit(source))))
    return errors.select("path", F.col("bstart").cast("long"), F.col("bend").cast("long"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(source).alias("diag_source"), ident.alias("diag_id"))


def span_errors(errors: DataFrame | None, spark: SparkSession) -> DataFrame:
    """Spans that could not be turned into bytes, as they were recorded; empty without the table."""
    schema = "path string, line_no int, error string"
    return spark.createDataFrame([], schema) if errors is None else project_to_schema(errors, T._parse_datatype_string(schema))


def needed(reads: dict[str, tuple[str, ...]], outputs: tuple[str, ...]) -> set[str]:
    """The views that outputs reach through what they read."""
    todo, seen = list(outputs), set()
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo += reads.get(name, ())
    return seen


def order_groups(groups: list[dict]) -> list[dict]:
    """Join groups by rows, then selectivity (high first), keys, consumers, name; unknown sizes last."""
    far = float("inf")
    rank: Callable = lambda g: (g.get("rows", far), -(g.get("selectivity") or 0.0), -len(g.get("keys", ())), -g.get("consumers", 0), g["name"])
    return sorted(groups, key=rank)
