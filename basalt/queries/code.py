"""Code-graph queries, with events as nodes and orders as calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import code_queries as Q
from ..semantic import builders as B
from .registry import INTERVALS_SQL, intervals, query

_NODES = INTERVALS_SQL.replace("user_id AS path", "CAST(user_id AS VARCHAR) AS path").replace("event_id,", "event_id AS node_id,")


def _nodes(t):
    s = intervals(t)
    return s.select(F.col("event_id").alias("node_id"), F.col("path").cast("string").alias("path"), F.col("event_type").alias("kind"), F.col("event_type").alias("name"), "bstart", "bend")


def _pick(t, kind):
    return Q.entities(_nodes(t), kind)


_N = f"WITH n AS {_NODES}"


@query(f"{_N} SELECT node_id FROM n a WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM n b WHERE b.event_type = 'view' AND a.path = b.path AND b.bstart <= a.bstart AND a.bend <= b.bend)")
def nodes_inside(t):
    return Q.inside(_pick(t, "click"), _pick(t, "view")).select("node_id")


@query(f"{_N} SELECT node_id FROM n a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM n b WHERE b.event_type = 'click' AND a.path = b.path AND a.bstart <= b.bstart AND b.bend <= a.bend)")
def nodes_having(t):
    return Q.has(_pick(t, "view"), _pick(t, "click")).select("node_id")


@query(f"{_N} SELECT node_id FROM n a WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM n b WHERE b.event_type = 'error' AND a.path = b.path AND a.bend <= b.bstart)")
def nodes_preceding(t):
    return Q.precedes(_pick(t, "click"), _pick(t, "error")).select("node_id")


@query(f"{_N} SELECT node_id FROM n a WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM n b WHERE b.event_type = 'error' AND a.path = b.path AND a.bstart >= b.bend)")
def nodes_following(t):
    return Q.follows(_pick(t, "click"), _pick(t, "error")).select("node_id")


@query(f"{_N} SELECT node_id FROM n WHERE path LIKE '1%' AND NOT regexp_matches(event_type, '^(c|v)')")
def nodes_composite(t):
    n = _nodes(t)
    return Q.combine("not", Q.entities(n, within="1"), Q.entities(n, name="~^c"), Q.entities(n, name="~^v")).select("node_id")


@query(f"{_N} SELECT node_id FROM n QUALIFY row_number() OVER (PARTITION BY path, event_type ORDER BY bstart DESC, node_id DESC) = 2")
def nodes_nth_child(t):
    return Q.nth_child(_nodes(t).withColumn("parent_id", F.col("kind")), 2, True).select("node_id")


_CALLS = "(SELECT o_orderstatus AS path, CAST(o_custkey AS VARCHAR) AS caller, o_orderpriority AS callee, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 END AS n_args FROM orders)"


def _calls(t):
    n = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 5)
    return t.orders.select(F.col("o_orderstatus").alias("path"), F.col("o_custkey").cast("string").alias("caller"), F.col("o_orderpriority").alias("callee"), n.alias("n_args"))


@query(f"SELECT callee, count(*) AS calls, count(DISTINCT caller) AS callers, count(DISTINCT path) AS files, list_sort(list(DISTINCT n_args) FILTER (WHERE n_args IS NOT NULL)) AS shapes FROM {_CALLS} GROUP BY 1")
def call_census(t):
    return Q.call_census(_calls(t))


@query(f"SELECT CASE WHEN n_args IS NULL THEN 'ambiguous' WHEN n_args < 1 OR n_args > 3 THEN 'would_break' ELSE 'ok' END AS verdict, count(*) AS n FROM {_CALLS} WHERE callee = '1-URGENT' GROUP BY 1")
def signature_impact(t):
    return Q.signature_impact(_calls(t), "1-URGENT", 1, 3).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""
SELECT coalesce(a.k, b.k) AS exception, coalesce(a.n, 0) AS raised, coalesce(b.n, 0) AS caught, coalesce(b.n, 0) = 0 AS uncaught
FROM (SELECT props AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) a FULL JOIN (SELECT props AS k, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.k = b.k
""")
def exception_census(t):
    e = t.events.withColumn("exception", F.col("props"))
    return Q.exception_census(e.where("event_type = 'error'"), e.where("event_type = 'click'"))


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, (c_nationkey * 7 + 3) % 25 AS b FROM customer), r(a, b, d) AS (SELECT a, b, 1 FROM e UNION ALL SELECT r.a, e.b, d + 1 FROM r JOIN e ON r.b = e.a WHERE d < 16)
SELECT a AS module, min(d) AS length FROM r WHERE a = b GROUP BY 1
""")
def import_cycles(t):
    edges = t.customer.select(F.col("c_nationkey").alias("importer"), ((F.col("c_nationkey") * 7 + 3) % 25).alias("imported")).distinct()
    return Q.import_cycles(edges)


@query("""
SELECT p_partkey, CAST(2 * CAST(p_type = 'ECONOMY' AS INTEGER) + CAST(p_size > 20 AS INTEGER) AS DOUBLE) AS score FROM part WHERE regexp_matches(p_name, 'w')
ORDER BY score DESC, p_brand, p_partkey LIMIT 25
""")
def ranked_search(t):
    """A top-k report: the limit is the feature."""
    lines = t.part.select("p_partkey", F.col("p_brand").alias("path"), F.col("p_partkey").alias("line_no"), F.col("p_name").alias("text"), "p_type", "p_size")
    return Q.ranked_search(lines, "w", {"p_type = 'ECONOMY'": 2, "p_size > 20": 1}, 25).select("p_partkey", "score")


@query("""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
SELECT doc_id, CAST(strlen(substr(lines[1], 1, 4)) AS BIGINT) AS bstart, CAST(strlen(text) - strlen(lines[-1]) + strlen(substr(lines[-1], 1, 6)) AS BIGINT) AS bend FROM l
""")
def occurrences_to_bytes(t):
    """An occurrence from the first line of each text to the last, over an index of all lines of all texts."""
    d = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lines = d.select("path", F.posexplode("lines").alias("line_no", "line_text"))
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    index = lines.withColumn("line_start_byte", F.coalesce(F.sum(F.octet_length("line_text") + 1).over(before), F.lit(0)).cast("long"))
    occ = d.select(
        "path", F.lit("s").alias("symbol"), F.lit(0).alias("symbol_roles"), F.lit(1).alias("line_base"), F.lit(1).alias("start_line"), F.lit(4).alias("start_char"), F.size("lines").alias("end_line"), F.lit(6).alias("end_char")
    )
    return B.occurrences_to_bytes(occ, index, t.spark).select(F.col("path").cast("long").alias("doc_id"), "bstart", "bend")


@query(f"SELECT event_id, path, bstart, bend, 'byte' AS col_unit FROM {INTERVALS_SQL}")
def span_unnest(t):
    s = intervals(t).select("event_id", "path", F.col("bstart").alias("byte_start"), (F.col("bend") - F.col("bstart")).alias("byte_len"))
    return B.unnest_spans(B.normalize_byte_span(s), keep=("event_id", "path")).drop("span")


@query(f"""
SELECT CAST(event_id AS VARCHAR) AS entity_id, event_type AS symbol, CAST(NULL AS INTEGER) AS symbol_roles, CAST(path AS VARCHAR) AS path, CAST(path AS VARCHAR) AS edge_owner_file_id, bstart, bend,
       'by_type' AS resolution_method, CAST(NULL AS DOUBLE) AS confidence, CAST(bend - bstart AS DOUBLE) AS score, 'events' AS task_name, 3 AS task_priority FROM {INTERVALS_SQL}
""")
def relation_output(t):
    s = intervals(t).select(F.col("event_id").alias("entity_id"), F.col("event_type").alias("symbol"), "path", "bstart", "bend", (F.col("bend") - F.col("bstart")).alias("score"))
    return B.relation_output(s, "events", 3, "by_type")


@query("SELECT DISTINCT type_repr, form AS type_form FROM (SELECT p_type AS type_repr, 'annotation' AS form FROM part UNION ALL SELECT p_brand, 'symbol' FROM part)")
def type_nodes(t):
    spans = t.part.select(F.col("p_brand").alias("path"), F.concat(F.lit(" "), "p_type").alias("expr_text"), F.col("p_partkey").alias("bstart"), F.col("p_partkey").alias("bend"))
    return B.type_nodes(B.type_exprs(spans), t.part.select(F.col("p_brand").alias("type_repr"))).select("type_repr", "type_form")
