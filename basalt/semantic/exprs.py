"""Expression specs: predicates and features over columns that are named before their table is known."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash64 as _hash64
from ..functions.spans import span_contains, span_overlaps


@dataclass(frozen=True)
class ExprSpec:
    """A column expression and the columns that it needs."""

    build: Callable[[], Column]
    columns: frozenset[str] = frozenset()

    def __call__(self) -> Column:
        return self.build()


def _spec(fn, *specs: ExprSpec) -> ExprSpec:
    return ExprSpec(lambda: fn(*[s() for s in specs]), frozenset().union(*[s.columns for s in specs]))


def c(name: str) -> ExprSpec:
    return ExprSpec(lambda: F.col(name), frozenset({name}))


def v(value) -> ExprSpec:
    return ExprSpec(lambda: F.lit(value))


def _of(x) -> ExprSpec:
    return x if isinstance(x, ExprSpec) else c(x)


def eq(left, right) -> ExprSpec:
    return _spec(lambda a, b: a == b, _of(left), _of(right))


def gt(left, right) -> ExprSpec:
    return _spec(lambda a, b: a > b, _of(left), _of(right))


def lt(left, right) -> ExprSpec:
    return _spec(lambda a, b: a < b, _of(left), _of(right))


def gte(left, right) -> ExprSpec:
    return _spec(lambda a, b: a >= b, _of(left), _of(right))


def lte(left, right) -> ExprSpec:
    return _spec(lambda a, b: a <= b, _of(left), _of(right))


def eq_value(column, value) -> ExprSpec:
    return eq(column, v(value))


def truthy(column) -> ExprSpec:
    """The value as text is "true" in any case."""
    return _spec(lambda a: F.lower(a.cast("string")) == "true", _of(column))


def is_null(column) -> ExprSpec:
    return _spec(lambda a: a.isNull(), _of(column))


def is_not_null(column) -> ExprSpec:
    return _spec(lambda a: a.isNotNull(), _of(column))


def and_(*preds: ExprSpec) -> ExprSpec:
    def fold(*cols):
        out = F.lit(True)
        for x in cols:
            out = out & x
        return out

    return _spec(fold, *preds)


def or_(*preds: ExprSpec) -> ExprSpec:
    def fold(*cols):
        out = F.lit(False)
        for x in cols:
            out = out | x
        return out

    return _spec(fold, *preds)


def between_overlap(ls, le, rs, re) -> ExprSpec:
    return _spec(lambda a, b, x, y: (a < y) & (x < b), *map(_of, (ls, le, rs, re)))


def range_contains(ls, le, rs, re) -> ExprSpec:
    """The left range contains the right one."""
    return _spec(lambda a, b, x, y: (a <= x) & (y <= b), *map(_of, (ls, le, rs, re)))


def span_start(span) -> ExprSpec:
    return _spec(lambda s: s["bstart"], _of(span))


def span_end(span) -> ExprSpec:
    return _spec(lambda s: s["bend"], _of(span))


def span_overlaps_expr(a, b) -> ExprSpec:
    return _spec(span_overlaps, _of(a), _of(b))


def span_contains_expr(a, b) -> ExprSpec:
    return _spec(span_contains, _of(a), _of(b))


def case_eq(left, right) -> ExprSpec:
    """1 if equal, else 0."""
    return _spec(lambda a, b: F.when(a == b, 1).otherwise(0), _of(left), _of(right))


def case_eq_value(column, value) -> ExprSpec:
    return case_eq(column, v(value))


def coalesce_default(column, default) -> ExprSpec:
    return _spec(lambda a: F.coalesce(a, F.lit(default)), _of(column))


def add_columns(*columns) -> ExprSpec:
    def fold(first, *rest):
        for x in rest:
            first = first + x
        return first

    return _spec(fold, *map(_of, columns))


def mul(column, factor) -> ExprSpec:
    return _spec(lambda a: a * factor, _of(column))


def clamp(value, low: float, high: float) -> ExprSpec:
    """Null stays null; least and greatest would skip it."""
    return _spec(lambda a: F.when(a < low, F.lit(low)).when(a > high, F.lit(high)).otherwise(a), _of(value))


def stable_hash64(column) -> ExprSpec:
    return _spec(_hash64, _of(column))


def alias(spec: ExprSpec, name: str) -> ExprSpec:
    return _spec(lambda a: a.alias(name), spec)


def sort_expr(column, direction: str = "asc") -> ExprSpec:
    """Ascending puts nulls first, descending last."""
    return _spec(lambda a: a.asc_nulls_first() if direction == "asc" else a.desc_nulls_last(), _of(column))


def missing_columns(spec: ExprSpec, df: DataFrame) -> set[str]:
    return set(spec.columns) - set(df.columns)


def stringify(x: Column) -> Column:
    return x.try_cast("string")


def bit_wise(op: str, *cols: Column, boolean: bool = False) -> Column:
    """A fold of or / and over integers or booleans."""
    out = cols[0]
    for x in cols[1:]:
        if boolean:
            out = (out | x) if op == "or" else (out & x)
        else:
            out = out.bitwiseOR(x) if op == "or" else out.bitwiseAND(x)
    return out


def in_set(x: Column, values: list) -> Column:
    """An empty set is a false predicate."""
    return x.isin(values) if values else F.lit(False)


@dataclass(frozen=True)
class QuerySpec:
    """Derived columns, then a projection, then predicates."""

    projection: tuple[str, ...] = ()
    derived: tuple[tuple[str, ExprSpec], ...] = ()
    predicate: ExprSpec | None = None
    pushdown: ExprSpec | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        for name, spec in self.derived:
            df = df.withColumn(name, spec())
        if self.projection:
            df = df.select(*self.projection, *[n for n, _ in self.derived if n not in self.projection])
        for p in (self.pushdown, self.predicate):
            if p is not None:
                df = df.where(p())
        return df
