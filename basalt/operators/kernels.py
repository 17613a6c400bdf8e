"""Deterministic row kernels: dedupe, winner selection, list explosion, canonical sort."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import array_agg


class Keep(Enum):
    FIRST_AFTER_SORT = "first_after_sort"
    BEST_BY_SCORE = "best_by_score"
    ARBITRARY = "arbitrary"
    COLLAPSE_LIST = "collapse_list"


@dataclass(frozen=True)
class SortKey:
    """Ascending keys put nulls first, descending ones last."""

    column: str
    order: str = "ascending"

    def expr(self) -> Column:
        c = F.col(self.column)
        return c.asc_nulls_first() if self.order == "ascending" else c.desc_nulls_last()


@dataclass(frozen=True)
class DedupeSpec:
    keys: tuple[str, ...]
    tie_breakers: tuple[SortKey, ...] = ()
    strategy: Keep = Keep.FIRST_AFTER_SORT


def _first_of_each(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def dedupe(df: DataFrame, spec: DedupeSpec, ordering: tuple[SortKey, ...] = ()) -> DataFrame:
    """One row for each key, or one row with lists for COLLAPSE_LIST.

    The first row by tie-breakers, then by the table's own ordering keys, stays; that needs one of them.
    """
    if spec.strategy is Keep.ARBITRARY:
        return df.dropDuplicates(list(spec.keys))
    if spec.strategy is Keep.COLLAPSE_LIST:
        rest = [c for c in df.columns if c not in spec.keys]
        if not rest:
            return df.select(*spec.keys).distinct()
        return df.groupBy(*spec.keys).agg(*[array_agg(F.col(c)).alias(c) for c in rest])
    named = {k.column for k in spec.tie_breakers}
    order = [*spec.tie_breakers, *[k for k in ordering if k.column not in named]]
    if not order:
        raise ValueError("dedupe by order needs tie-breakers or ordering keys")
    return _first_of_each(df, spec.keys, [k.expr() for k in order])


def winner_select(df: DataFrame, keys: tuple[str, ...], score: str = "score", score_order: str = "descending", tie_breakers: tuple[SortKey, ...] = ()) -> DataFrame:
    """The row with the best score for each key; equal scores go by the tie-breakers, whatever the input's order."""
    return dedupe(df, DedupeSpec(keys, (SortKey(score, score_order), *tie_breakers), Keep.BEST_BY_SCORE))


def semantic_dedupe(df: DataFrame, keys: list[str], score: str, descending: bool = True) -> DataFrame:
    """Best row by score with nulls first in either direction: a null score wins."""
    c = F.col(score)
    return _first_of_each(df, keys, [c.desc_nulls_first() if descending else c.asc_nulls_first()])


def canonical_sort(df: DataFrame, keys: list[SortKey], tier: str = "canonical", provenance: tuple[str, ...] = ()) -> DataFrame:
    """Sorts in the canonical tier alone; provenance columns come after the keys, nulls always last."""
    if tier != "canonical":
        return df
    named = {k.column for k in keys}
    order = [F.col(k.column).asc_nulls_last() if k.order == "ascending" else F.col(k.column).desc_nulls_last() for k in keys]
    return df.orderBy(*order, *[F.col(c).asc_nulls_last() for c in provenance if c in df.columns and c not in named])


def explode_list(df: DataFrame, parent_keys: tuple[str, ...], list_col: str, value_col: str = "value", idx_col: str | None = "idx", keep_empty: bool = True) -> DataFrame:
    """One row for each element with its place from 0, sorted by parent (nulls first) and place.

    ``keep_empty`` leaves a row of nulls for a null or empty list.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    out = df.select(*parent_keys, explode(list_col).alias("_idx", value_col))
    out = out.orderBy(*[F.col(k).asc_nulls_first() for k in parent_keys], F.col("_idx").asc_nulls_first())
    return out.withColumnRenamed("_idx", idx_col) if idx_col else out.drop("_idx")


def unnest_columns(df: DataFrame, columns: list[str], preserve_nulls: bool = True) -> DataFrame:
    """Several lists side by side, the shorter ones padded with nulls."""
    rest = [c for c in df.columns if c not in columns]
    zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array()) for c in columns]).alias("_z")
    opened = df.select(*rest, (F.explode_outer if preserve_nulls else F.explode)(zipped).alias("_z"))
    return opened.select(*rest, *[F.col(f"_z.`{i}`").alias(c) for i, c in enumerate(columns)])


#: A value with more pairs than this, and more than an eighth of a task's share, is cut into pieces of about as many, up to MOST_PIECES.
PIECE_PAIRS = 1 << 22
MOST_PIECES = 64


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join on columns whose values are few or uneven: the pairs of one value are made in several tasks.

    The left rows of a value with more than its share of pairs are dealt to pieces by their hash, its right rows go to each
    piece, at most ``MOST_PIECES`` times.  So what is shuffled grows with the rows and not with the pairs, and nothing goes
    through the driver but one row.
    """
    key, other, pieces, share, l, r = (_free(n, left, right) for n in ("_key", "_other", "_pieces", "_share", "_left", "_right"))
    known = lambda df: df.where(" and ".join(f"`{c}` is not null" for c in on))
    left, right = known(left), known(right)
    counts = left.groupBy(*on).agg(F.count("*").alias(l)).join(right.groupBy(*on).agg(F.count("*").alias(r)), on)
    # A number of its own, as the pairs are not seen from the size of what is shuffled.
    number = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * left.sparkSession.sparkContext.defaultParallelism)
    made = F.col(l).cast("double") * F.col(r)
    total = counts.agg(F.greatest(F.sum(made) / (8 * number), F.lit(float(PIECE_PAIRS))).alias(share))
    counts = counts.crossJoin(F.broadcast(total))
    size = F.least(F.ceil(made / F.col(share)), F.lit(MOST_PIECES)).cast("int")
    hot = counts.select(*on, size.alias(pieces)).where(F.col(pieces) > 1)
    many = F.coalesce(pieces, F.lit(1))
    # All fields may be null on both sides: else the join casts one key and shuffles once more.
    whole = lambda df, n: F.struct(*on, n).cast("struct<" + ",".join(f"`{c}`:{t}" for c, t in [(c, dict(df.dtypes)[c]) for c in on]) + f",`{pieces}`:int>")
    dealt = left.join(hot, on, "left").withColumn(key, whole(left, F.pmod(F.xxhash64(*left.columns), many).cast("int").alias(pieces)))
    copied = right.join(hot, on, "left").withColumn(pieces, F.explode(F.sequence(F.lit(0), many - 1))).withColumn(other, whole(right, F.col(pieces)))
    a = dealt.drop(pieces).repartition(number, key)
    b = copied.drop(pieces, *on).repartition(number, other)
    return a.join(b.hint("merge"), F.col(key) == F.col(other)).drop(key, other)


def _free(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has."""
    while any(name in df.columns for df in frames):
        name += "_"
    return name
