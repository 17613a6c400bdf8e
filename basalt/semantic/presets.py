"""The named relationships of a code graph, as specs over the canonical columns of its tables."""

from __future__ import annotations

from . import exprs as E
from .relationships import Feature, Rank, Relationship, entity_symbol

#: Base score, base confidence and the weight of the one feature of each relationship.
_FIXED = {
    "rel_cst_docstring_owner_by_id": (1000.0, 0.98, 5.0),
    "rel_cst_docstring_owner_by_span": (500.0, 0.75, 10.0),
    "rel_call_to_def_scip": (1000.0, 0.95, 15.0),
    "rel_call_to_def_name": (500.0, 0.50, 10.0),
}
#: Relationships of entities to symbols, by whether the occurrence has to lie inside and what the entity is called.
_SYMBOLS = {"rel_name_symbol": (False, "entity_id"), "rel_def_symbol": (True, "entity_id"), "rel_import_symbol": (False, "entity_id"), "rel_callsite_symbol": (False, "call_id")}
_SCORE, _START = E.sort_expr("score", "desc"), E.sort_expr(E.span_start("r__span"))


def _related(name: str, keys: dict[str, str], hard, feature: Feature, group: str, order, select) -> Relationship:
    score, confidence, weight = _FIXED[name]
    return Relationship(
        name, tuple(keys), tuple(keys.values()), hard=tuple(hard), features=(Feature(feature.name, feature.expr, weight),), base_score=score, base_confidence=confidence,
        rank=Rank(E.c(group), tuple(order)), select=tuple(select),
    )


def presets() -> dict[str, Relationship]:
    """Every named relationship.  Equalities are keys of the join, so that a path is never joined with itself as a whole."""
    pair = lambda kind: (("src", E.c("l__entity_id")), ("dst", E.c("r__entity_id")), ("kind", E.v(kind)))
    out = {name: entity_symbol(name, inside, entity=entity) for name, (inside, entity) in _SYMBOLS.items()}
    kind = Feature("kind_match", E.case_eq("l__owner_kind", "r__kind"))
    out["rel_cst_docstring_owner_by_id"] = _related(
        "rel_cst_docstring_owner_by_id", {"path": "path", "owner_def_id": "entity_id"}, (), kind, "l__entity_id", (_SCORE, _START), pair("has_docstring")
    )
    adjacent = Feature("adjacent", E.case_eq(E.span_start("l__span"), E.span_end("r__span")))
    out["rel_cst_docstring_owner_by_span"] = _related(
        "rel_cst_docstring_owner_by_span", {"path": "path"}, (E.is_null("l__owner_def_id"),), adjacent, "l__entity_id", (_SCORE, E.sort_expr("r__entity_id")), pair("has_docstring")
    )
    exact = Feature("exact_span", E.case_eq(E.span_start("l__span"), E.span_start("r__span")))
    known = (E.is_not_null(E.span_start("l__span")), E.is_not_null(E.span_start("r__span")))
    out["rel_call_to_def_scip"] = _related(
        "rel_call_to_def_scip", {"path": "path"}, known, exact, "l__call_id", (_SCORE, E.sort_expr("r__symbol")), (("src", E.c("l__call_id")), ("symbol", E.c("r__symbol")), ("path", E.c("l__path")))
    )
    scope = Feature("same_scope", E.case_eq("l__scope", "r__scope"))
    calls = (("src", E.c("l__call_id")), ("dst", E.c("r__entity_id")), ("kind", E.v("calls")))
    out["rel_call_to_def_name"] = _related("rel_call_to_def_name", {"path": "path", "name": "name"}, (), scope, "l__call_id", (_SCORE, _START, E.sort_expr("r__entity_id")), calls)
    return out
