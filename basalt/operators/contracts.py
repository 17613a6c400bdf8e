"""Output contracts: align, check, split good rows from bad, dedupe, sort."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import DedupeSpec, SortKey, canonical_sort, dedupe


@dataclass(frozen=True)
class Invariant:
    """A row is bad where ``bad`` (SQL) is true."""

    code: str
    bad: str
    message: str = ""


@dataclass(frozen=True)
class Contract:
    schema: T.StructType
    key_fields: tuple[str, ...] = ()
    required_non_null: tuple[str, ...] = ()
    invariants: tuple[Invariant, ...] = ()
    dedupe: DedupeSpec | None = None
    canonical_sort: tuple[SortKey, ...] = ()
    strict: bool = False
    tier: str = "best_effort"


class Finalized(NamedTuple):
    good: DataFrame
    errors: DataFrame
    stats: DataFrame
    alignment: dict


class ContractError(ValueError):
    """Rows break a strict contract."""


def align_to_schema(df: DataFrame, schema: T.StructType, safe_cast: bool = True, keep_extra: bool = False) -> tuple[DataFrame, dict]:
    """(aligned rows, what was missing, dropped and cast).  An unsafe cast fails on a bad value, a safe one gives null."""
    have = {f.name: f.dataType for f in df.schema}
    out, missing, casted = [], [], []
    for f in schema:
        if f.name not in have:
            missing.append(f.name)
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif have[f.name] != f.dataType:
            casted.append(f.name)
            c = F.col(f.name)
            out.append((c.try_cast(f.dataType) if safe_cast else c.cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    extra = [c for c in df.columns if c not in {f.name for f in schema}]
    if keep_extra:
        out += [F.col(c) for c in extra]
    return df.select(*out), {"missing": missing, "dropped": [] if keep_extra else extra, "casted": casted}


def _checks(contract: Contract) -> list[tuple[str, str, Column]]:
    found = [("REQUIRED_NON_NULL", f"{c} is null", F.col(c).isNull()) for c in contract.required_non_null]
    return found + [(i.code, i.message or i.bad, F.coalesce(F.expr(i.bad), F.lit(False))) for i in contract.invariants]


def finalize(df: DataFrame, contract: Contract) -> Finalized:
    """Good rows, bad rows with a code and message for each broken check, counts by code, and what aligning did.

    Checks are evaluated once, as an array of the failures of each row.  A strict contract raises if any row is bad.
    """
    aligned, report = align_to_schema(df, contract.schema)
    failures = [F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))) for code, message, bad in _checks(contract)]
    none = F.array().cast("array<struct<code:string,message:string>>")
    marked = aligned.withColumn("_bad", F.array_compact(F.array(*failures)) if failures else none)
    columns = [f.name for f in contract.schema]
    good = marked.where(F.size("_bad") == 0).select(*columns)
    errors = marked.where(F.size("_bad") > 0).select(*columns, F.explode("_bad").alias("_e")).select(*columns, F.col("_e.code").alias("error_code"), F.col("_e.message").alias("error_message"))
    if contract.strict and not errors.isEmpty():
        raise ContractError(f"rows break {sorted(r.error_code for r in errors.select('error_code').distinct().collect())}")
    if contract.dedupe:
        good = dedupe(good, contract.dedupe, contract.canonical_sort)
    if contract.canonical_sort:
        good = canonical_sort(good, list(contract.canonical_sort), contract.tier)
    stats = errors.groupBy("error_code").agg(F.count("*").alias("n"))
    return Finalized(align_to_schema(good, contract.schema)[0], errors, stats, report)


def error_details(errors: DataFrame, keys: list[str]) -> DataFrame:
    """The failures of each key as one sorted list."""
    return errors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("error_code", "error_message"))).alias("details"))


def normalize_only(df: DataFrame, schema: T.StructType) -> DataFrame:
    return align_to_schema(df, schema)[0]
