"""Bounded closures over edges, neighbourhoods, and pairs of definitions and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize

MOST_DEPTH = 16


def ancestor_closure(edges: DataFrame, child: str, parent: str, max_depth: int = MOST_DEPTH) -> DataFrame:
    """(child, ancestor, depth) by self-joins; each pair at its least depth.

    Distances double in each round, so depth 16 takes four joins.  Each round is a table in the shared folder, as the
    next one reads it twice.
    """
    found = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).where("node is not null and ancestor is not null").distinct()
    reach = 1
    while reach < max_depth:
        up = found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("higher"), F.col("depth").alias("more"))
        longer = found.join(up, "ancestor").select("node", F.col("higher").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        found = found.union(longer).where(F.col("depth") <= max_depth).groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        found = materialize(found, "closure")
        reach *= 2
    return found


def expand(edges: DataFrame, seeds: DataFrame, source: str, target: str, depth: int = 1) -> DataFrame:
    """(node, depth): what lies within so many steps of the seeds, at its least distance; seeds are at 0."""
    known = seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = known
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges[source]).select(F.col(target).alias("node"), F.lit(d).alias("depth")).distinct()
        frontier = materialize(step.join(known.select("node"), "node", "left_anti"), "frontier")
        known = known.union(frontier)
    return known


def reaching_pairs(defs: DataFrame, uses: DataFrame, unit: str, symbol: str, def_cols: list[str], use_cols: list[str]) -> DataFrame:
    """Definitions and uses of the same symbol in the same unit, without regard to flow."""
    d = defs.select(unit, symbol, *[F.col(c).alias(f"def_{c}") for c in def_cols])
    u = uses.select(unit, symbol, *[F.col(c).alias(f"use_{c}") for c in use_cols])
    return d.join(u, [unit, symbol])
