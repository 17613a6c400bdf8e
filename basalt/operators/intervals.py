"""Interval and span joins: equality on a path where there is one, bins where there is none."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import span_contains, span_overlaps
from ..sources.shared import materialize
from .kernels import SortKey, spread_join

#: Sections of the times of a left range join; their table is one window.
SECTIONS = 4096

EXACT, OVERLAP, CONTAINED = "EXACT", "OVERLAP_MAX", "CONTAINED_BEST"


@dataclass(frozen=True)
class AlignSpec:
    """How to align; ``OVERLAP_BEST`` is another name for ``OVERLAP_MAX``."""

    mode: str = CONTAINED
    how: str = "inner"
    left_path: str = "path"
    left_start: str = "bstart"
    left_end: str = "bend"
    right_path: str = "path"
    right_start: str = "bstart"
    right_end: str = "bend"
    left_columns: tuple[str, ...] | None = None
    right_columns: tuple[str, ...] | None = None
    tie_breakers: tuple[SortKey, ...] = field(default=())


def _pairs(ls: Column, le: Column, rs: Column, re: Column, mode: str) -> Column:
    if mode == EXACT:
        return (ls == rs) & (le == re)
    if mode in (OVERLAP, "OVERLAP_BEST"):
        return (rs < le) & (ls < re)
    return (rs <= ls) & (re >= le)


def interval_align(left: DataFrame, right: DataFrame, spec: AlignSpec) -> DataFrame:
    """Each left row with its best right row of the same path.

    Columns: left's, right's (a name that is taken gets ``__r``, then ``_r`` again), match_kind, match_score.
    The best has the largest overlap, then comes first by tie-breakers, start and end, nulls last.  ``how=left``
    keeps unmatched rows as NO_MATCH.

    One join by path, then one ranking by the number that each left row gets before it; equal left rows stay apart.
    """
    lcols = list(spec.left_columns or left.columns)
    rcols = list(spec.right_columns or right.columns)
    names, taken = {}, set(lcols)
    for c in rcols:
        name = c if c not in taken else f"{c}__r"
        while name in taken:
            name += "_r"
        names[c] = name
        taken.add(name)
    probe = left.select(
        F.monotonically_increasing_id().alias("_row"), F.col(spec.left_path).alias("_lp"), F.col(spec.left_start).alias("_ls"), F.col(spec.left_end).alias("_le"),
        *[F.col(c).alias(f"_l_{c}") for c in lcols],
    )
    used = {*rcols, spec.right_path, spec.right_start, spec.right_end, *[k.column for k in spec.tie_breakers]}
    other = right.select(F.lit(True).alias("_hit"), *[F.col(c).alias(f"_r_{c}") for c in sorted(used)])
    rs, re = F.col(f"_r_{spec.right_start}"), F.col(f"_r_{spec.right_end}")
    cond = (F.col("_lp") == F.col(f"_r_{spec.right_path}")) & _pairs(F.col("_ls"), F.col("_le"), rs, re, spec.mode)
    score = F.greatest(F.least(F.col("_le"), re) - F.greatest(F.col("_ls"), rs), F.lit(0)).cast("double")
    pairs = probe.join(other, cond, "left" if spec.how.lower() == "left" else "inner")
    pairs = pairs.withColumn("match_score", F.when(F.col("_hit"), score))
    order = [F.col("match_score").desc_nulls_last()]
    for k in spec.tie_breakers:
        c = F.col(f"_r_{k.column}")
        order.append(c.asc_nulls_last() if k.order == "ascending" else c.desc_nulls_last())
    order += [rs.asc_nulls_last(), re.asc_nulls_last()]
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy(*order))).where("_n = 1")
    kind = F.when(F.col("_hit"), spec.mode).otherwise("NO_MATCH")
    return best.select(*[F.col(f"_l_{c}").alias(c) for c in lcols], *[F.col(f"_r_{c}").alias(names[c]) for c in rcols], kind.alias("match_kind"), "match_score")


def range_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], condition: str = "contains", how: str = "inner", width: int | None = None, most_bins: int = 64) -> DataFrame:
    """Joins intervals without an equality: left contains right, or overlaps it.

    Of two such intervals one has the other's start in it, so the starts of one side meet the intervals of the other: a start is
    in one bin of ``width``, an interval is dealt to the bins that it touches, and a pair meets once.  Without a width, the median
    length of both sides is taken.  An interval that would touch more than ``most_bins`` goes to bins of a coarser level, 64
    times as wide (and so on), and starts are filed on every level that is in use, so nothing is dropped.  Bins with very many
    pairs are made in several tasks (``spread_join``).

    ``how`` is inner or left; for left, both sides are written once, so that all uses see the same rows, and the left rows without
    a pair are told without making pairs (``_alone``).
    """
    if how == "left":
        left, right = materialize(left, "range-left"), materialize(right, "range-right")
    side = lambda df, x, bounds: df.select(*[F.col(c).alias(f"_{x}{i}") for i, c in enumerate(df.columns)], F.col(bounds[0]).cast("long").alias(f"_{x}s"), F.col(bounds[1]).cast("long").alias(f"_{x}e"))
    every, b = side(left, "l", left_bounds), side(right, "r", right_bounds).where("_rs <= _re")
    a = every.where("_ls <= _le")
    sizes = a.select((F.col("_le") - F.col("_ls")).alias("n")).union(b.select((F.col("_re") - F.col("_rs")).alias("n")))
    middle, longest = sizes.agg(F.percentile_approx("n", 0.5), F.max("n")).first()
    levels = [width or max(1, int(middle or 1))]
    while int(longest or 1) / levels[-1] > most_bins:
        levels.append(levels[-1] * most_bins)
    contains = condition == "contains"
    sides = lambda df, own: (_touched(df, own, levels, most_bins), _starts(df, own, levels))
    (wide_a, starts_a), (wide_b, starts_b) = sides(a, "l"), sides(b, "r")
    mark = lambda df, kind: df.withColumn("_kind", F.lit(kind))
    one = mark(wide_a, 0), mark(starts_b, 0)
    # Both ways in one join, so that pairs are not gathered from two.
    l, r = one if contains else (one[0].unionByName(mark(starts_a, 1)), one[1].unionByName(mark(wide_b, 1)))
    meet = "_rs >= _ls and _re <= _le" if contains else "_rs < _le and _ls < _re and (_kind = 0) = (_rs >= _ls)"
    pairs = spread_join(l, r, ["_kind", "_level", "_bin"]).where(meet)
    taken = set(left.columns)
    mine = [F.col(f"_l{i}").alias(c) for i, c in enumerate(left.columns)]
    found = pairs.select(*mine, *[F.col(f"_r{i}").alias(c if c not in taken else f"{c}__r") for i, c in enumerate(right.columns)])
    if how != "left":
        return found
    return found.union(_alone(every, b, condition).select(*mine, *[F.lit(None).cast(f.dataType) for f in right.schema]))


def _touched(df: DataFrame, side: str, levels: list[int], most_bins: int) -> DataFrame:
    """Each interval for each bin that it touches, on its level."""
    lo, hi = F.col(f"_{side}s"), F.col(f"_{side}e")
    level = sum((((hi - lo) > most_bins * x).cast("int") for x in levels[:-1]), F.lit(0))
    size = F.element_at(F.array(*map(F.lit, levels)), F.col("_level") + 1).cast("long")
    return df.withColumn("_level", level).withColumn("_bin", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))))


def _starts(df: DataFrame, side: str, levels: list[int]) -> DataFrame:
    """Each interval for the bin of its start on each level."""
    size = F.element_at(F.array(*map(F.lit, levels)), F.col("_level") + 1).cast("long")
    return df.withColumn("_level", F.explode(F.array(*map(F.lit, range(len(levels)))))).withColumn("_bin", F.floor(F.col(f"_{side}s") / size))


def _alone(every: DataFrame, b: DataFrame, condition: str) -> DataFrame:
    """The left rows that contain, or overlap, no right row, from the least end of all that start later (or the greatest of all
    that start earlier).

    Times are cut into at most ``SECTIONS`` sections: each is looked through by itself, and a table with a row for each
    section carries what lies beyond it.
    """
    inside = condition == "contains"
    at, best = ("_ls", F.min) if inside else ("_le", F.max)
    ends = b.groupBy(F.col("_rs").alias("_at")).agg(best("_re").alias("_v"), F.lit(True).alias("_given"))
    # Of equal times, the right rows count for the left ones where they may start together.
    asked = every.where("_ls <= _le").select(F.col(at).alias("_at")).distinct().select("_at", F.lit(None).cast("long").alias("_v"), F.lit(False).alias("_given"))
    times = ends.union(asked)
    first, last = times.agg(F.min("_at"), F.max("_at")).first()
    span = (int(last or 0) - int(first or 0)) // SECTIONS + 1
    times = times.withColumn("_section", F.floor((F.col("_at") - int(first or 0)) / span))
    order = [F.col("_at").desc(), F.col("_given").desc()] if inside else [F.col("_at"), F.col("_given")]
    within = best("_v").over(Window.partitionBy("_section").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    past = Window.orderBy(F.col("_section").desc() if inside else F.col("_section")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = times.groupBy("_section").agg(best("_v").alias("_x")).select("_section", best("_x").over(past).alias("_beyond"))
    here = times.withColumn("_here", within).where("not _given").join(F.broadcast(beyond), "_section")
    reach = (F.least if inside else F.greatest)("_here", "_beyond")  # nulls are skipped
    known = here.select(F.col("_at").alias("_key"), reach.alias("_reach"))
    hit = F.col("_reach") <= F.col("_le") if inside else F.col("_reach") > F.col("_ls")
    joined = every.join(known, F.col(at) == F.col("_key"), "left")
    return joined.where(~F.coalesce((F.col("_ls") <= F.col("_le")) & hit, F.lit(False)))


def smallest_container(rows: DataFrame, id_col: str, path: str = "path", start: str = "bstart", end: str = "bend") -> DataFrame:
    """(id, holder): for each interval the shortest other one of its path that contains it, of equal ones the smallest id.

    Pairs come from one join by path; the best of each is an aggregate, combined map-side, and not a ranking of all pairs.
    """
    inner = rows.select(F.col(id_col).alias("_id"), F.col(path).alias("_p"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    outer = rows.select(F.col(path).alias("_q"), F.col(id_col).alias("holder"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    pairs = inner.join(outer, (F.col("_p") == F.col("_q")) & (F.col("_a") <= F.col("_s")) & (F.col("_e") <= F.col("_b")) & (F.col("_id") != F.col("holder")))
    best = pairs.groupBy("_id").agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("size"), "holder")).alias("best"))
    return best.select(F.col("_id").alias(id_col), "best.holder")


def join_by_path(left: DataFrame, right: DataFrame, left_path: str, right_path: str, how: str = "inner") -> DataFrame:
    """Equality on the path, both sides' columns prefixed ``left__`` and ``right__``."""
    l, r = prefixed(left, "left__"), prefixed(right, "right__")
    return l.join(r, l[f"left__{left_path}"] == r[f"right__{right_path}"], how)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def join_by_span_overlap(left: DataFrame, right: DataFrame, path: str = "path", span: str = "span") -> DataFrame:
    return _span_join(left, right, path, span_overlaps, span, False)


def join_by_span_contains(left: DataFrame, right: DataFrame, path: str = "path", span: str = "span", left_contains_right: bool = True) -> DataFrame:
    return _span_join(left, right, path, span_contains, span, not left_contains_right)


def _span_join(left, right, path, test, span, swap) -> DataFrame:
    l, r = prefixed(left, "left__"), prefixed(right, "right__")
    a, b = l[f"left__{span}"], r[f"right__{span}"]
    return l.join(r, (l[f"left__{path}"] == r[f"right__{path}"]) & (test(b, a) if swap else test(a, b)))


def line_index_join(df: DataFrame, index: DataFrame, start_line: str, end_line: str, key: str = "file_id") -> DataFrame:
    """Adds the line starts and texts of the start and end lines; rows without one keep nulls."""
    for side, line in (("start", start_line), ("end", end_line)):
        part = index.select(
            F.col(key).alias("_k"), F.col("line_no").alias("_n"),
            F.col("line_start_byte").alias(f"{side}_line_start"), F.col("line_text").alias(f"{side}_line_text"),
        )
        df = df.join(part, (df[key] == part["_k"]) & (df[line] == part["_n"]), "left").drop("_k", "_n")
    return df


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], value_cols: list[str], tolerance: float | None = None) -> DataFrame:
    """Each left row with the latest right row at or before it, by union and a running last value.

    One shuffle by key and one sort; no pairs are formed.  ``tolerance`` is in the units of ``on`` (seconds for times).
    """
    number = (lambda c: c.cast("timestamp").cast("double")) if dict(left.dtypes)[on].startswith("timestamp") else (lambda c: c.cast("double"))
    l = left.select(*[F.col(c) for c in left.columns], F.lit(None).cast("struct<" + ",".join(f"`{c}`:{dict(right.dtypes)[c]}" for c in [on, *value_cols]) + ">").alias("_r"), F.lit(1).alias("_side"))
    cols = [F.col(c) if c in (on, *by) else F.lit(None).cast(t).alias(c) for c, t in left.dtypes]
    r = right.select(*cols, F.struct(on, *value_cols).alias("_r"), F.lit(0).alias("_side"))
    frame = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = l.unionByName(r).withColumn("_last", F.last("_r", ignorenulls=True).over(frame)).where("_side = 1")
    near = F.lit(True) if tolerance is None else number(F.col(on)) - number(F.col("_last").getField(on)) <= tolerance
    return seen.select(*left.columns, *[F.when(near, F.col("_last").getField(c)).alias(c if c not in left.columns else f"{c}__r") for c in value_cols])
