"""What a change-feed row means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANGE_TYPE, COMMIT_VERSION, COMMIT_TIMESTAMP = "_change_type", "_commit_version", "_commit_timestamp"
#: Fixed values.
RANKS = {"update_postimage": 3, "insert": 2, "delete": 1, "update_preimage": 0}


def cdf_change_rank(change: Column) -> Column:
    """3, 2, 1, 0 by kind; -1 for an unknown kind; null for null."""
    kind = F.lower(F.trim(change))
    out = F.when(kind.isNull(), F.lit(None).cast("int"))
    for name, rank in RANKS.items():
        out = out.when(kind == name, F.lit(rank))
    return out.otherwise(F.lit(-1))


def cdf_is_upsert(change: Column) -> Column:
    return cdf_change_rank(change).isin(3, 2)


def cdf_is_delete(change: Column) -> Column:
    return cdf_change_rank(change) == 1
