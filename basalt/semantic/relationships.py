"""Relationships with a score, a confidence and a ranking; relate by an inferred join; normalisation of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import joined_parts, stable_hash128
from ..functions.spans import span_contains, span_make, span_overlaps
from ..functions.text import utf8_normalize
from ..operators.intervals import prefixed
from . import exprs as E
from .inference import require_join


@dataclass(frozen=True)
class Feature:
    name: str
    expr: E.ExprSpec
    weight: float = 1.0


@dataclass(frozen=True)
class Rank:
    """Rows of a group in order; ``best`` keeps the first ``top_k``, ``all`` only marks them."""

    group: E.ExprSpec
    order_by: tuple[E.ExprSpec, ...]
    keep: str = "best"
    top_k: int = 1


@dataclass(frozen=True)
class Relationship:
    """How left (``l__``) and right (``r__``) rows relate; file quality, if given, comes as ``fq__``."""

    name: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    how: str = "inner"
    hard: tuple[E.ExprSpec, ...] = ()
    features: tuple[Feature, ...] = ()
    base_score: float = 0.0
    base_confidence: float = 0.0
    quality_weight: float = 0.0
    quality_column: str = "fq__file_quality_score"
    rank: Rank | None = None
    select: tuple[tuple[str, E.ExprSpec], ...] = ()


def join_group(left: DataFrame, right: DataFrame, spec: Relationship) -> DataFrame:
    """The shared join of several relationships; the same lazy rows serve all of them."""
    l, r = prefixed(left, "l__"), prefixed(right, "r__")
    cond = F.lit(True)
    for a, b in zip(spec.left_keys, spec.right_keys, strict=True):
        cond = cond & (l[f"l__{a}"] == r[f"r__{b}"])
    return l.join(r, cond, spec.how)


def compile_relationship(joined: DataFrame, spec: Relationship, file_quality: DataFrame | None = None, file_key: str = "l__file_id") -> DataFrame:
    """Join rows to scored, ranked and projected relations.

    Predicates over missing columns are left out; a null predicate drops the row; a null feature makes the score
    null.  Confidence = base + score / 10000 + quality (1000 if unknown) x weight, between 0 and 1.
    """
    df = joined
    if file_quality is not None:
        q = prefixed(file_quality, "fq__")
        df = df.join(q, df[file_key] == q["fq__file_id"], "left")
    for p in spec.hard:
        if not E.missing_columns(p, df):
            df = df.where(p())
    score: Column = F.lit(float(spec.base_score))
    for f in spec.features:
        df = df.withColumn(f"feat_{f.name}", f.expr().cast("double"))
        score = score + F.col(f"feat_{f.name}") * f.weight
    df = df.withColumn("score", score)
    confidence = F.lit(float(spec.base_confidence)) + F.col("score") / 10000.0
    if spec.quality_column in df.columns:
        confidence = confidence + F.coalesce(F.col(spec.quality_column).cast("double"), F.lit(1000.0)) * spec.quality_weight
    df = df.withColumn("confidence", F.when(confidence < 0, 0.0).when(confidence > 1, 1.0).otherwise(confidence))
    if spec.rank:
        df = df.withColumn("ambiguity_group_id", spec.rank.group().cast("string"))
        order = [o() for o in spec.rank.order_by]
        df = df.withColumn("ambiguity_rank", F.row_number().over(Window.partitionBy("ambiguity_group_id").orderBy(*order)))
        if spec.rank.keep == "best":
            df = df.where(F.col("ambiguity_rank") <= spec.rank.top_k)
    if not spec.select:
        return df
    rank = ["ambiguity_group_id", "ambiguity_rank"] if spec.rank else []
    return df.select(*[s().alias(n) for n, s in spec.select], "score", "confidence", *rank)


def entity_symbol(name: str, contains: bool = False, role: E.ExprSpec | None = None, entity: str = "entity_id") -> Relationship:
    """Entities to the symbol occurrences in their span: exact ends score more, one occurrence for each entity stays."""
    inside = E.span_contains_expr("l__span", "r__span") if contains else E.span_overlaps_expr("l__span", "r__span")
    return Relationship(
        name, ("path",), ("path",), hard=(inside, *([role] if role else [])),
        features=(
            Feature("exact_start", E.case_eq(E.span_start("l__span"), E.span_start("r__span")), 20.0),
            Feature("exact_end", E.case_eq(E.span_end("l__span"), E.span_end("r__span")), 10.0),
        ),
        base_score=2000.0, base_confidence=0.95,
        rank=Rank(E.c(f"l__{entity}"), (E.sort_expr("score", "desc"), E.sort_expr(E.span_start("r__span")))),
        select=(("entity_id", E.c(f"l__{entity}")), ("symbol", E.c("r__symbol")), ("path", E.c("l__path")), ("bstart", E.span_start("r__span")), ("bend", E.span_end("r__span"))),
    )


def relate(left: DataFrame, right: DataFrame, hint: str | None = None, origin: str = "semantic", where: str | None = None) -> DataFrame:
    """Joins two tables as their columns suggest: (entity_id, symbol, path, bstart, bend, origin), distinct."""
    found = require_join(left.schema, right.schema, hint)
    l, r = prefixed(left, "left__"), prefixed(right, "right__")
    cond = F.lit(True)
    for a, b in zip(found.left_keys, found.right_keys, strict=True):
        cond = cond & (F.col(f"left__{a}") == F.col(f"right__{b}"))
    if found.kind.startswith("span_"):
        span = lambda side, df: F.col(f"{side}__span") if "span" in df.columns else span_make(f"{side}__bstart", f"{side}__bend")
        test = span_contains if found.kind == "span_contains" else span_overlaps
        cond = cond & test(span("left", left), span("right", right))
    joined = l.join(r, cond)
    if where:
        joined = joined.where(where)
    have = set(joined.columns)
    pick = lambda n, *among: next((F.col(x) for x in among if x in have), F.lit(None).cast("long" if n in ("bstart", "bend") else "string")).alias(n)
    sides = lambda n: (n, f"left__{n}", f"right__{n}")
    return joined.select(*[pick(*sides(n)) for n in ("entity_id", "symbol", "path", "bstart", "bend")], F.lit(origin).alias("origin")).distinct()


def null_guard(value: Column, columns: list[str]) -> Column:
    """The value where all columns are known, else null."""
    known = F.lit(True)
    for x in columns:
        known = known & F.col(x).isNotNull()
    return F.when(known, value)


def span_entity_id(namespace: str, path: str, start: str, end: str, guarded: bool = True) -> Column:
    value = F.concat(F.lit(f"{namespace}:"), stable_hash128(joined_parts(F.col(path), F.col(start), F.col(end))))
    return null_guard(value, [path, start, end]) if guarded else value


def normalize(df: DataFrame, prefix: str, start: str = "bstart", end: str = "bend", path: str = "path", foreign: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """Adds span, entity_id and an id for each foreign reference {column: (namespace, start, end)}; drops line columns.

    An end column whose name ends in byte_len is a length.
    """
    stop = F.col(start) + F.col(end) if end.endswith("byte_len") else F.col(end)
    df = df.withColumn("bstart", F.col(start).cast("long")).withColumn("bend", stop.cast("long"))
    df = df.withColumn("span", span_make("bstart", "bend")).withColumn("entity_id", span_entity_id(prefix, path, "bstart", "bend"))
    for name, (namespace, s, e) in (foreign or {}).items():
        df = df.withColumn(name, span_entity_id(namespace, path, s, e))
    return df.drop(*[x for x in df.columns if x in ("start_line", "end_line", "start_col", "end_col", "line", "col")])


def normalize_texts(df: DataFrame, columns: list[str], suffix: str = "_norm", form: str = "NFC", casefold: bool = False, collapse_ws: bool = False) -> DataFrame:
    for x in columns:
        df = df.withColumn(f"{x}{suffix}", utf8_normalize(F.col(x), form, casefold, collapse_ws))
    return df
