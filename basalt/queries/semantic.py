"""Scored relationships, reports on them, symbol tables, and the relational code queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spans import span_make
from ..operators.intervals import smallest_container
from ..semantic import diagnostics as D
from ..semantic import exprs as E
from ..semantic import relationships as R
from ..semantic import scopes as C
from .registry import INTERVALS_SQL, intervals, query

_REL = """
WITH j AS (
  SELECT c_custkey AS entity_id, o_orderkey AS target_id, 500 + (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 20.0 + o_totalprice * 0.001 AS score, n_regionkey * 100.0 AS q
  FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 50000
), k AS (SELECT *, least(greatest(0.5 + score / 10000.0 + q * 0.0005, 0), 1) AS confidence FROM j)
SELECT entity_id, target_id, round(score, 6) AS score, round(confidence, 6) AS confidence, CAST(entity_id AS VARCHAR) AS ambiguity_group_id,
       row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, target_id) AS ambiguity_rank
FROM k {tail}
"""


def _related(t, keep, top_k=1):
    spec = R.Relationship(
        "orders_of", ("c_custkey",), ("o_custkey",), hard=(E.gt("r__o_totalprice", E.v(50000)), E.eq("l__no_such", "r__column")),
        features=(R.Feature("done", E.case_eq_value("r__o_orderstatus", "F"), 20.0), R.Feature("price", E.c("r__o_totalprice"), 0.001)),
        base_score=500.0, base_confidence=0.5, quality_weight=0.0005,
        rank=R.Rank(E.c("l__c_custkey"), (E.sort_expr("score", "desc"), E.sort_expr("r__o_orderkey")), keep, top_k),
        select=(("entity_id", E.c("l__c_custkey")), ("target_id", E.c("r__o_orderkey"))),
    )
    quality = t.nation.select(F.col("n_nationkey").alias("file_id"), (F.col("n_regionkey") * 100).alias("file_quality_score"))
    return R.compile_relationship(R.join_group(t.customer, t.orders, spec), spec, quality, "l__c_nationkey")


def _rounded(df):
    return df.withColumn("score", F.round("score", 6)).withColumn("confidence", F.round("confidence", 6))


@query(_REL.format(tail="QUALIFY ambiguity_rank <= 1"))
def relationship_quality(t):
    return _rounded(_related(t, "best"))


@query(_REL.format(tail="QUALIFY ambiguity_rank <= 3"))
def ambiguity_rank_topk(t):
    return _rounded(_related(t, "best", 3))


_ALL = _REL.format(tail="")


@query(f"""
SELECT 'orders_of' AS relationship, count(*) AS total_edges, count(DISTINCT entity_id) AS unique_sources, count(DISTINCT target_id) AS unique_targets, round(avg(confidence), 6) AS avg_confidence,
       min(confidence) AS min_confidence, max(confidence) AS max_confidence, round(avg(score), 4) AS avg_score, min(score) AS min_score, max(score) AS max_score, count(*) FILTER (WHERE confidence < 0.5) AS low_confidence_edges
FROM ({_ALL})
""")
def quality_metrics(t):
    out = D.quality_metrics(_rounded(_related(t, "all")), "orders_of", "entity_id", "target_id")
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6)).withColumn("avg_score", F.round("avg_score", 4))


@query(f"""
SELECT 'orders_of' AS relationship, count(*) AS total_sources, count(*) FILTER (WHERE n > 1) AS ambiguous_sources, max(n) AS max_candidates, round(avg(CASE WHEN n > 1 THEN n END), 6) AS avg_candidates,
       round(count(*) FILTER (WHERE n > 1) / count(*), 6) AS ambiguity_rate
FROM (SELECT entity_id, count(*) AS n FROM ({_ALL}) GROUP BY 1)
""")
def ambiguity_report(t):
    out = D.ambiguity_report(_related(t, "all"), "orders_of", "entity_id", "ambiguity_group_id")
    return out.withColumn("avg_candidates", F.round("avg_candidates", 6)).withColumn("ambiguity_rate", F.round("ambiguity_rate", 6))


@query("""
SELECT c_custkey AS file_id, coalesce(n, 0) AS pending_count, coalesce(m, 0) AS errors_count, CAST(1000 - coalesce(n, 0) * 10 - coalesce(m, 0) * 5 AS DOUBLE) AS file_quality_score
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, count(*) AS m FROM events WHERE event_type = 'error' GROUP BY 1) ON user_id = c_custkey
""")
def file_quality(t):
    signals = {"pending": (t.orders.where("o_orderstatus = 'P'"), "o_custkey", F.lit(10.0)), "errors": (t.events.where("event_type = 'error'"), "user_id", F.lit(5.0))}
    return D.file_quality(t.customer.select(F.col("c_custkey").alias("file_id")), signals)


@query("""
SELECT c_custkey AS file_id, CAST(c_custkey IN (SELECT o_custkey FROM orders) AS INTEGER) AS has_orders, CAST(c_custkey IN (SELECT user_id FROM events) AS INTEGER) AS has_events,
       CAST(c_custkey IN (SELECT o_custkey FROM orders) AS INTEGER) + CAST(c_custkey IN (SELECT user_id FROM events) AS INTEGER) AS source_count FROM customer
""")
def file_coverage(t):
    return D.file_coverage(t.customer.select(F.col("c_custkey").alias("file_id")), {"orders": (t.orders, "o_custkey"), "events": (t.events, "user_id")})


@query("""
WITH s AS {s}
SELECT DISTINCT r.event_id AS entity_id, CAST(NULL AS VARCHAR) AS symbol, l.path, l.bstart, l.bend, 'semantic' AS origin
FROM s l JOIN s r ON l.path = r.path AND l.bstart < r.bend AND r.bstart < l.bend WHERE l.event_type = 'signup' AND r.event_type = 'purchase'
""".replace("{s}", INTERVALS_SQL))
def relate_inferred_overlap(t):
    s = intervals(t)
    return R.relate(s.where("event_type = 'signup'").select("path", "bstart", "bend"), s.where("event_type = 'purchase'").select("path", "bstart", "bend", F.col("event_id").alias("entity_id")))


@query("""
WITH s AS {s}, l AS (SELECT * FROM s WHERE event_type = 'view'), r AS (SELECT * FROM s WHERE event_type = 'error')
SELECT CAST(l.event_id AS VARCHAR) AS entity_id, 'e' || r.event_id AS symbol, l.path, r.bstart, r.bend, CAST(2000 + 20 * CAST(l.bstart = r.bstart AS INTEGER) + 10 * CAST(l.bend = r.bend AS INTEGER) AS DOUBLE) AS score, CAST(1 AS DOUBLE) AS confidence,
       CAST(l.event_id AS VARCHAR) AS ambiguity_group_id, 1 AS ambiguity_rank
FROM l JOIN r ON l.path = r.path AND l.bstart < r.bend AND r.bstart < l.bend
QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY 2000.0 + 20.0 * CAST(l.bstart = r.bstart AS INTEGER) + 10.0 * CAST(l.bend = r.bend AS INTEGER) DESC, r.bstart) = 1
""".replace("{s}", INTERVALS_SQL))
def entity_symbol_relationship(t):
    s = intervals(t).withColumn("span", span_make("bstart", "bend"))
    left = s.where("event_type = 'view'").select(F.col("event_id").cast("string").alias("entity_id"), "path", "span")
    right = s.where("event_type = 'error'").select(F.concat(F.lit("e"), "event_id").alias("symbol"), "path", "span")
    spec = R.entity_symbol("rel")
    return R.compile_relationship(R.join_group(left, right, spec), spec)


@query("""
SELECT event_id AS binding_id, CASE WHEN event_type = 'error' THEN 'nonlocal' WHEN event_type = 'click' THEN 'param' WHEN event_type = 'view' THEN 'free' ELSE 'local' END AS binding_kind,
       event_type IN ('click', 'signup') AS declared_here FROM events
""")
def symtable_bindings(t):
    e = t.events
    flag = lambda *kinds: F.col("event_type").isin(*kinds)
    symbols = e.select(
        F.col("event_id").alias("binding_id"), F.col("user_id").alias("scope_id"), F.col("props").alias("name"), flag("error").alias("is_nonlocal"), F.lit(False).alias("is_global"), flag("view", "error").alias("is_free"),
        flag("click").alias("is_param"), F.lit(False).alias("is_import"), F.lit(None).cast("boolean").alias("is_namespace"), F.lit(False).alias("is_annot_only"), flag("signup").alias("is_assigned"),
    )
    scopes = e.select(F.col("user_id").alias("scope_id"), F.lit("FUNCTION").alias("scope_type"), F.col("user_id").cast("string").alias("path")).distinct()
    return C.bindings(symbols, scopes).select("binding_id", "binding_kind", "declared_here")


@query("SELECT event_id, CASE WHEN event_type IN ('signup', 'error') THEN 'def' ELSE 'use' END AS kind FROM events WHERE event_type <> 'view'")
def def_use_events(t):
    op = F.when(F.col("event_type") == "signup", "STORE_FAST").when(F.col("event_type") == "error", "IMPORT_NAME").when(F.col("event_type") != "view", "LOAD_GLOBAL").otherwise("NOP")
    rows = t.events.select(F.col("user_id").alias("code_unit_id"), F.col("event_id").alias("instr_id"), op.alias("opname"), F.col("props").alias("symbol"))
    return C.def_use_events(rows).select(F.col("instr_id").alias("event_id"), "kind")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def nested_view_explode(t):
    lists = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("found"))
    nested = t.customer.join(lists, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", F.struct("found").alias("body"))
    return C.nested_base(nested, "body.found", ["c_custkey"])


@query("""
SELECT c_custkey, c_name, n_orders FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE regexp_matches(c_name, '0[1-3]$') AND n_orders BETWEEN 2 AND 20
""")
def entity_filter(t):
    """Entities by a pattern of their name and the count of what hangs on them."""
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    found = t.customer.where(F.col("c_name").rlike("0[1-3]$")).join(counts, F.col("o_custkey") == F.col("c_custkey"))
    return found.where(F.col("n_orders").between(2, 20)).select("c_custkey", "c_name", "n_orders")


@query("""
WITH s AS {s}, p AS (SELECT l.event_id, r.event_id AS holder, r.bend - r.bstart AS size FROM s l JOIN s r ON l.path = r.path AND r.bstart <= l.bstart AND l.bend <= r.bend AND l.event_id <> r.event_id)
SELECT event_id, holder FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY size, holder) = 1
""".replace("{s}", INTERVALS_SQL))
def smallest_containing_interval(t):
    return smallest_container(intervals(t), "event_id")
