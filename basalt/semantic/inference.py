"""Semantic column types from names and metadata, and the join that two schemas suggest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Column names with a meaning of their own.
STANDARD = {
    "file_id": "FILE_ID", "path": "PATH", "bstart": "SPAN_START", "bend": "SPAN_END", "span": "SPAN",
    "entity_id": "ENTITY_ID", "symbol": "SYMBOL", "qname": "QNAME", "line_no": "LINE_NO", "text": "TEXT", "node_kind": "KIND",
}
#: In this order unless a hint says otherwise.
DEFAULT_ORDER = ("span_overlap", "foreign_key", "symbol_match", "equi_join")


class JoinInferenceError(ValueError):
    """No join fits the two schemas."""


@dataclass(frozen=True)
class JoinStrategy:
    kind: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    confidence: float
    evidence: tuple[str, ...]


def semantic_type(field: T.StructField) -> str:
    """From the field's metadata, else from its name."""
    said = (field.metadata or {}).get("semantic_type")
    if said:
        return said
    name = field.name
    if name in STANDARD:
        return STANDARD[name]
    if name.endswith("_bstart"):
        return "SPAN_START"
    if name.endswith("_bend"):
        return "SPAN_END"
    if name.endswith("_id"):
        return "FOREIGN_KEY"
    if name.endswith("_text"):
        return "TEXT"
    return "OTHER"


def annotate(schema: T.StructType) -> dict[str, str]:
    return {f.name: semantic_type(f) for f in schema}


def _span(kinds: dict[str, str]) -> bool:
    have = set(kinds.values())
    return "SPAN" in have or {"SPAN_START", "SPAN_END"} <= have


def _file_keys(a: dict[str, str], b: dict[str, str]) -> tuple[str, ...]:
    return next(((k,) for k in ("file_id", "path") if k in a and k in b), ())


def _candidate(kind: str, a: dict[str, str], b: dict[str, str]) -> JoinStrategy | None:
    keys = _file_keys(a, b)
    if kind in ("span_overlap", "span_contains") and keys and _span(a) and _span(b):
        return JoinStrategy(kind, keys, keys, 0.95 if kind == "span_overlap" else 0.9, ("file identity", "span columns on both sides"))
    if kind == "foreign_key":
        for fk in (n for n, k in a.items() if k == "FOREIGN_KEY"):
            for pk in (n for n, k in b.items() if k == "ENTITY_ID"):
                if fk not in b:
                    return JoinStrategy(kind, (fk,), (pk,), 0.85, (f"{fk} names an entity", f"{pk} is an identity"))
    if kind == "symbol_match":
        both = [n for n, k in a.items() if k == "SYMBOL" and b.get(n) == "SYMBOL"]
        if both:
            return JoinStrategy(kind, (both[0],), (both[0],), 0.75, ("symbol on both sides",))
    if kind == "equi_join" and keys:
        return JoinStrategy(kind, keys, keys, 0.6, ("file identity",))
    return None


def infer_join(left: T.StructType, right: T.StructType, hint: str | None = None) -> JoinStrategy | None:
    """The first strategy that fits, or the hinted one if it fits; None otherwise."""
    a, b = annotate(left), annotate(right)
    for kind in (hint,) if hint else DEFAULT_ORDER:
        found = _candidate(kind, a, b)
        if found:
            return found
    return None


def require_join(left: T.StructType, right: T.StructType, hint: str | None = None) -> JoinStrategy:
    found = infer_join(left, right, hint)
    if found is None:
        raise JoinInferenceError(f"no join between {left.names} and {right.names}" + (f" by {hint}" if hint else ""))
    return found
