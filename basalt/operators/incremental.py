"""Change feeds: filters, merges, joins, and cursors that move after the work is done."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.changes import CHANGE_TYPE, COMMIT_TIMESTAMP, COMMIT_VERSION

APPEND, UPSERT, REPLACE, DELETE_INSERT = "append", "upsert", "replace", "delete_insert"


@dataclass(frozen=True)
class ChangeFilter:
    """Which kinds of change count; preimages never do."""

    insert: bool = True
    update_postimage: bool = True
    delete: bool = True

    def kinds(self) -> list[str]:
        return [k for k in ("insert", "update_postimage", "delete") if getattr(self, k)]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(CHANGE_TYPE).isin(self.kinds()) if self.kinds() else F.lit(False))


INSERTS_AND_UPDATES = ChangeFilter(delete=False)


def is_change_feed(df: DataFrame) -> bool:
    return CHANGE_TYPE in df.columns


def strip_change_columns(df: DataFrame) -> DataFrame:
    return df.drop(CHANGE_TYPE, COMMIT_VERSION, COMMIT_TIMESTAMP)


def change_feed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The changes from one state of a table to the next, as rows with a change kind; keys are unique in each."""
    rest = [c for c in new.columns if c not in keys]
    a = old.select(F.struct(*new.columns).alias("_old"), *[F.col(k).alias(f"_a_{k}") for k in keys])
    b = new.select(F.struct(*new.columns).alias("_new"), *[F.col(k).alias(f"_b_{k}") for k in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"_a_{k}") == F.col(f"_b_{k}"))
    both = a.join(b, cond, "full")
    differ = F.lit(False)
    for c in rest:
        differ = differ | ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    row = lambda s, kind: F.struct(F.col(s).alias("row"), F.lit(kind).alias("kind"))
    changes = (
        F.when(F.col("_old").isNull(), F.array(row("_new", "insert")))
        .when(F.col("_new").isNull(), F.array(row("_old", "delete")))
        .when(differ, F.array(row("_old", "update_preimage"), row("_new", "update_postimage")))
    )
    return both.select(F.explode(changes).alias("c")).select("c.row.*", F.col("c.kind").alias(CHANGE_TYPE))


def apply_merge(base: DataFrame, changes: DataFrame, strategy: str, keys: list[str] | None = None, partition_column: str | None = None) -> DataFrame:
    """The base with the changes put in.

    append adds; upsert and delete_insert replace rows with an equal key (null keys match nothing); replace drops
    every partition that the changes touch.
    """
    new = strip_change_columns(changes)
    if strategy == APPEND:
        return base.unionByName(new, allowMissingColumns=True)
    if strategy in (UPSERT, DELETE_INSERT):
        if not keys:
            raise ValueError(f"{strategy} needs keys")
        rest = base.join(new.select(*keys).distinct(), keys, "left_anti")
    elif strategy == REPLACE:
        if not partition_column:
            raise ValueError("replace needs a partition column")
        rest = base.join(new.select(partition_column).distinct(), partition_column, "left_anti")
    else:
        raise ValueError(f"unknown merge strategy {strategy}")
    return rest.unionByName(new, allowMissingColumns=True)


def merge_incremental(base: DataFrame | None, changes: DataFrame, strategy: str, **how) -> DataFrame:
    return changes if base is None else apply_merge(base, changes, strategy, **how)


def incremental_join(left: DataFrame, right: DataFrame, join: Callable[[DataFrame, DataFrame], DataFrame], policy: ChangeFilter = INSERTS_AND_UPDATES) -> DataFrame:
    """Joins what the policy lets through on each side that is a change feed, then the whole of what is left."""
    pick = lambda df: policy.apply(df) if is_change_feed(df) else df
    return join(pick(left), pick(right))
