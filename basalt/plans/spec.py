"""Declarative view specs: what a view is made of, checked and composed into lazy DataFrames.

A spec is plain data.  Composing it only strings DataFrame operations together; Catalyst plans and optimises them.
"""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stable_id
from ..functions.spans import span_make
from ..functions.text import utf8_normalize
from ..operators.intervals import range_join
from ..operators.unions import union_by_name

SCHEMA_VERSION = 4
#: Fixed values.
JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


class SpecError(ValueError):
    """A spec cannot be built."""


@dataclass(frozen=True)
class Normalize:
    source: str
    id_columns: tuple[str, ...] = ()
    span_columns: tuple[str, str] | None = None
    text_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relate:
    left: str
    right: str
    join_type: str = "inner"
    join_keys: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Union:
    sources: tuple[str, ...]
    discriminator_column: str | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Project:
    source: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Filter:
    source: str
    predicate: str


@dataclass(frozen=True)
class Aggregation:
    column: str
    function: str
    alias: str


@dataclass(frozen=True)
class Aggregate:
    source: str
    group_by: tuple[str, ...]
    aggregations: tuple[Aggregation, ...]


@dataclass(frozen=True)
class IncrementalCdf:
    source: str
    starting_version: int | None = None
    ending_version: int | None = None


@dataclass(frozen=True)
class Metadata:
    source: str


@dataclass(frozen=True)
class FileManifest:
    source: str


@dataclass(frozen=True)
class CpgEmit:
    output_kind: str
    sources: tuple[str, ...]


Transform = Normalize | Relate | Union | Project | Filter | Aggregate | IncrementalCdf | Metadata | FileManifest | CpgEmit


@dataclass(frozen=True)
class View:
    name: str
    transform: Transform
    output_schema: tuple[str, ...] = ()


@dataclass(frozen=True)
class Output:
    table: str
    source: str
    columns: tuple[str, ...] = ()
    mode: str = "overwrite"
    partition_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Param:
    """A typed value: by position in SQL, or as a filter on a column of every output."""

    kind: str
    value: object
    position: int | None = None
    filter_column: str | None = None


#: Parameter types.
PARAM_TYPES = {"utf8": "string", "int64": "long", "float64": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "null": "string"}


@dataclass(frozen=True)
class Spec:
    inputs: tuple[str, ...]
    views: tuple[View, ...]
    outputs: tuple[Output, ...] = ()
    params: tuple[Param, ...] = field(default=())
    version: int = SCHEMA_VERSION

    def fingerprint(self) -> str:
        """sha256 of the canonical JSON."""
        return hashlib.sha256(json.dumps(_plain(self), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _plain(x):
    if dataclasses.is_dataclass(x):
        return {"kind": type(x).__name__, **{f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    return [_plain(v) for v in x] if isinstance(x, tuple) else x


def sources_of(t: Transform) -> tuple[str, ...]:
    if isinstance(t, Relate):
        return (t.left, t.right)
    return t.sources if isinstance(t, Union | CpgEmit) else (t.source,)


def build_order(spec: Spec) -> list[View]:
    """Views after what they read.  Doubled names, unknown sources and cycles are errors."""
    names = [*spec.inputs, *[v.name for v in spec.views]]
    if twice := [n for n, k in Counter(names).items() if k > 1]:
        raise SpecError(f"defined twice: {twice}")
    for v in spec.views:
        if lost := [s for s in sources_of(v.transform) if s not in names]:
            raise SpecError(f"{v.name} reads unknown {lost}")
    for o in spec.outputs:
        if o.source not in names:
            raise SpecError(f"output {o.table} reads unknown {o.source}")
    done, out, left = set(spec.inputs), [], list(spec.views)
    while left:
        ready = [v for v in left if all(s in done for s in sources_of(v.transform))]
        if not ready:
            raise SpecError(f"cycle among {[v.name for v in left]}")
        out += ready
        done |= {v.name for v in ready}
        left = [v for v in left if v.name not in done]
    return out


def is_span_containment(keys: tuple[tuple[str, str], ...]) -> bool:
    """Exactly a start and an end, on both sides."""
    start = lambda c: c == "bstart" or c.endswith("_bstart")
    end = lambda c: c == "bend" or c.endswith("_bend")
    return len(keys) == 2 and all(map(start, keys[0])) and all(map(end, keys[1]))


def relate(left: DataFrame, right: DataFrame, t: Relate) -> DataFrame:
    """An equi-join that keeps the keys of both sides, or a join of spans that contain others.

    Columns of the right side whose names are taken get ``__r``.
    """
    if not t.join_keys:
        raise SpecError("a join needs keys: products are not allowed")
    kind = t.join_type.lower()
    if kind not in JOIN_TYPES:
        raise SpecError(f"unknown join type {t.join_type}")
    if is_span_containment(t.join_keys) and kind in ("inner", "left"):
        (ls, rs), (le, re) = t.join_keys
        return range_join(left, right, (ls, le), (rs, re), "contains", kind)
    taken = set(left.columns)
    names = {c: f"{c}__r" if c in taken else c for c in right.columns}
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    cond = F.lit(True)
    for a, b in t.join_keys:
        cond = cond & (left[a] == r[f"_r_{b}"])
    joined = left.join(r, cond, JOIN_TYPES[kind])
    if kind in ("semi", "anti"):
        return joined
    return joined.select(*[left[c] for c in left.columns], *[r[f"_r_{c}"].alias(n) for c, n in names.items()])


def _apply(t: Transform, name: str, tables: dict[str, DataFrame], stores: dict) -> DataFrame:
    match t:
        case Normalize():
            df = tables[t.source]
            first = F.col(t.id_columns[0]).cast("string") if t.id_columns else F.lit(t.source)
            df = df.withColumn("entity_id", stable_id(name, first))
            if t.span_columns:
                df = df.withColumn("span", span_make(*t.span_columns))
            for c in t.text_columns:
                df = df.withColumn(f"{c}_normalized", utf8_normalize(F.col(c)))
            return df
        case Relate():
            return relate(tables[t.left], tables[t.right], t)
        case Union():
            return union_by_name({s: tables[s] for s in t.sources}, t.discriminator_column, t.distinct)
        case Project():
            return tables[t.source].select(*t.columns)
        case Filter():
            return tables[t.source].where(t.predicate)
        case Aggregate():
            if bad := [a.function for a in t.aggregations if a.function not in AGGREGATES]:
                raise SpecError(f"unknown aggregates {bad}")
            aggs = [AGGREGATES[a.function]("*" if a.column == "*" else F.col(a.column)).alias(a.alias) for a in t.aggregations]
            return tables[t.source].groupBy(*t.group_by).agg(*aggs)
        case IncrementalCdf():
            return stores[t.source].changes(t.starting_version, t.ending_version)
        case Metadata():
            return stores[t.source].snapshot()
        case FileManifest():
            return stores[t.source].files()
        case CpgEmit():
            if not t.sources:
                raise SpecError("emit needs a source")
            one = tables[t.sources[0]]
            return one if len(t.sources) == 1 else union_by_name({s: tables[s] for s in t.sources})
    raise SpecError(f"unknown transform {t}")


def nodes_of_files(files: DataFrame) -> DataFrame:
    """A node for each file, where no source has nodes."""
    return files.select(stable_id("node", "path").alias("entity_id"), "path", F.lit(0).cast("long").alias("bstart"), F.col("size_bytes").cast("long").alias("bend"))


def typed(p: Param) -> Column:
    if p.kind not in PARAM_TYPES:
        raise SpecError(f"unknown parameter type {p.kind}")
    return F.lit(None if p.kind == "null" else p.value).cast(PARAM_TYPES[p.kind])


#: What a value of each type may be in Python; dates and times may also be ISO text.
_HOLDS = {"utf8": (str,), "int64": (int,), "float64": (int, float), "boolean": (bool,), "date": (datetime.date,), "timestamp": (datetime.datetime,)}


def python_value(p: Param) -> object:
    """The value as its type says; another kind of value is an error."""
    if p.kind not in PARAM_TYPES:
        raise SpecError(f"unknown parameter types {[p.kind]}")
    if p.kind == "null" or p.value is None:
        return None
    value = p.value
    if p.kind in ("date", "timestamp") and isinstance(value, str):
        try:
            value = (datetime.date if p.kind == "date" else datetime.datetime).fromisoformat(value)
        except ValueError:
            raise SpecError(f"{p.value!r} is no {p.kind}") from None
    wrong = isinstance(value, bool) != (p.kind == "boolean") or (p.kind == "date" and isinstance(value, datetime.datetime))
    if wrong or not isinstance(value, _HOLDS[p.kind]) or (p.kind == "int64" and not -(1 << 63) <= value < 1 << 63):
        raise SpecError(f"{p.value!r} is no {p.kind}")
    return float(value) if p.kind == "float64" else value


def positional(params: tuple[Param, ...]) -> list:
    """Values of $1..$N as their types say; doubled or missing places and values of another type are errors."""
    found = sorted((p for p in params if p.position is not None), key=lambda p: p.position)
    if [p.position for p in found] != list(range(1, len(found) + 1)):
        raise SpecError("positions run from 1 without gaps or repeats")
    return [python_value(p) for p in found]


def sql_with_params(spark: SparkSession, sql: str, params: tuple[Param, ...], **tables: DataFrame) -> DataFrame:
    """SQL with ? for each positional parameter and {name} for each table."""
    return spark.sql(sql, args=positional(params), **tables)


def compose(spec: Spec, inputs: dict[str, DataFrame], stores: dict | None = None) -> dict[str, DataFrame]:
    """Every view by name, lazily; output contracts are checked on the way."""
    tables = dict(inputs)
    if lost := set(spec.inputs) - set(inputs) - set(stores or {}):
        raise SpecError(f"no input {sorted(lost)}")
    for view in build_order(spec):
        df = _apply(view.transform, view.name, tables, stores or {})
        if view.output_schema and (lost := set(view.output_schema) - set(df.columns)):
            raise SpecError(f"{view.name} lacks {sorted(lost)}")
        tables[view.name] = df
    return tables


def outputs(spec: Spec, inputs: dict[str, DataFrame], stores: dict | None = None) -> dict[str, DataFrame]:
    """The outputs by table: projected, then filtered by the parameters that name a column."""
    tables, out = compose(spec, inputs, stores), {}
    for o in spec.outputs:
        df = tables[o.source]
        df = df.select(*o.columns) if o.columns else df
        for p in spec.params:
            if p.filter_column:
                df = df.where(F.col(p.filter_column) == typed(p))
        out[o.table] = df
    return out


def write_outputs(spec: Spec, inputs: dict[str, DataFrame], root: str, stores: dict | None = None) -> dict[str, str]:
    """Writes every output as Parquet under the root; returns their paths."""
    paths = {}
    for o in spec.outputs:
        df = outputs(spec, inputs, stores)[o.table]
        writer = df.write.mode(o.mode)
        paths[o.table] = f"{root}/{o.table}"
        (writer.partitionBy(*o.partition_by) if o.partition_by else writer).parquet(paths[o.table])
    return paths


def cache_choice(spec: Spec) -> dict[str, bool]:
    """Which views are worth keeping: read three times or more, or twice if they are a join or an aggregate."""
    reads = Counter(s for v in spec.views for s in sources_of(v.transform)) + Counter(o.source for o in spec.outputs)
    heavy = {v.name: isinstance(v.transform, Relate | Aggregate) for v in spec.views}
    return {v.name: reads[v.name] >= 3 or (reads[v.name] == 2 and heavy[v.name]) for v in spec.views}
