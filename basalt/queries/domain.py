"""Domain views over stand-in tables: normalisation, symbol tables, control flow, named relationships, expression specs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates as A
from ..functions import nested as N
from ..functions import numbers as M
from ..functions import text as X
from ..functions.spans import span_make
from ..operators import code_queries as Q
from ..operators import kernels as K
from ..operators import unions as U
from ..semantic import builders as B
from ..semantic import diagnostics as D
from ..semantic import exprs as E
from ..semantic import relationships as R
from ..semantic import scopes as C
from ..semantic.presets import presets
from .registry import INTERVALS_SQL, intervals, query

_S = f"WITH s AS {INTERVALS_SQL}"


@query(f"{_S} SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(path AS VARCHAR) END AS path, bstart, bend, bend - bstart AS span_len, event_id % 7 <> 0 AS known FROM s")
def normalize_spans(t):
    """A row without a path has no id; a length gives the end."""
    s = intervals(t).withColumn("path", F.when(F.col("event_id") % 7 != 0, F.col("path").cast("string")))
    s = s.select("event_id", "path", F.col("bstart").alias("start"), (F.col("bend") - F.col("bstart")).alias("byte_len"), F.lit(1).alias("line"))
    out = R.normalize(s, "ref", "start", "byte_len")
    return out.select("event_id", "path", "bstart", "bend", (F.col("span.bend") - F.col("span.bstart")).alias("span_len"), F.col("entity_id").isNotNull().alias("known"))


@query(r"SELECT doc_id, nullif(regexp_replace(regexp_replace(source || '  x ' || source, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '') AS v_norm, lang AS lang_norm FROM documents")
def normalize_text_columns(t):
    d = t.documents.select("doc_id", F.concat(F.lit(" "), "source", F.lit("  x "), "source", F.lit(" ")).alias("v"), "lang")
    return R.normalize_texts(d, ["v", "lang"], collapse_ws=True).select("doc_id", "v_norm", "lang_norm")


_NODE = "SELECT CAST({0} AS VARCHAR) AS entity_id, {1} AS path, CAST({0} AS BIGINT) AS bstart, CAST(NULL AS BIGINT) AS bend, '{2}' AS node_kind FROM {2}"


@query(_NODE.format("c_custkey", "c_name", "customer") + " UNION ALL " + _NODE.format("s_suppkey", "s_name", "supplier"))
def union_nodes(t):
    c = t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("path"), F.col("c_custkey").alias("bstart"), F.col("c_acctbal").alias("extra"))
    s = t.supplier.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("path"), F.col("s_suppkey").alias("bstart"))
    return U.union_nodes({"customer": c, "supplier": s})


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CAST(o_custkey AS VARCHAR) AS target_id, NULL::VARCHAR AS path, NULL::BIGINT AS bstart, NULL::BIGINT AS bend, 'orders' AS edge_kind FROM orders
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), l_returnflag, CAST(l_linenumber AS BIGINT), NULL, 'lines' FROM lineitem
""")
def union_edges(t):
    o = t.orders.select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("bstart"))
    return U.union_edges({"orders": o, "lines": lines})


def _bound(t):
    """Customers as bindings of their nation's name, declared by every second one."""
    c = F.col("c_custkey")
    kind = F.when(c % 3 == 0, "local").otherwise("param")
    return t.customer.select(c.alias("binding_id"), F.lit("p").alias("path"), F.col("c_nationkey").alias("name"), kind.alias("binding_kind"), (c % 2 == 0).alias("declared_here"))


@query("""
SELECT c_custkey AS binding_id, s_suppkey AS def_id, CASE WHEN c_custkey % 3 = 0 THEN 'local' ELSE 'param' END AS binding_kind, CASE WHEN s_suppkey % 2 = 0 THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence
FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey % 2 = 0
""")
def symtable_def_sites(t):
    start = F.when(F.col("s_suppkey") % 2 != 0, F.col("s_suppkey"))
    defs = t.supplier.select(F.lit("p").alias("path"), F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("def_id"), start.alias("name_bstart"), F.col("s_suppkey").alias("name_bend"))
    return C.def_sites(_bound(t), defs).select("binding_id", "def_id", "binding_kind", "confidence")


@query("""
SELECT c_custkey AS binding_id, s_suppkey AS ref_id, CASE s_suppkey % 3 WHEN 0 THEN 'write' WHEN 1 THEN 'del' ELSE 'read' END AS use_kind, 0.85::DOUBLE AS confidence FROM customer JOIN supplier ON c_nationkey = s_nationkey
""")
def symtable_use_sites(t):
    k = F.col("s_suppkey") % 3
    refs = t.supplier.select(F.lit("p").alias("path"), F.col("s_nationkey").alias("ref_text"), F.col("s_suppkey").alias("ref_id"), F.when(k == 0, "Store").when(k == 1, "Del").otherwise("Load").alias("expr_ctx"))
    return C.use_sites(_bound(t), refs).select("binding_id", "ref_id", "use_kind", "confidence")


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 0),
up(node, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT up.node, e.parent, depth + 1 FROM up JOIN e ON up.ancestor = e.child WHERE depth < 16),
b AS (SELECT c_custkey AS id, c_custkey % 5 AS name, c_custkey % 2 = 0 AS declared, CASE c_custkey % 6 WHEN 1 THEN 'free' WHEN 3 THEN 'nonlocal' WHEN 5 THEN 'global' ELSE 'local' END AS kind,
      CASE WHEN c_custkey <= 6 THEN 'MODULE' ELSE 'FUNCTION' END AS type FROM customer)
SELECT DISTINCT x.id AS binding_id, y.id AS target_id, x.kind AS reason, CASE x.kind WHEN 'global' THEN 0.9 WHEN 'nonlocal' THEN 0.85 ELSE 0.75 END::DOUBLE AS confidence
FROM b x JOIN up ON up.node = x.id JOIN b y ON up.ancestor = y.id AND x.name = y.name AND y.declared
WHERE x.kind <> 'local' AND (x.kind <> 'global' OR y.type = 'MODULE') AND (x.kind <> 'nonlocal' OR y.type <> 'MODULE')
""")
def symtable_binding_resolutions(t):
    c = F.col("c_custkey")
    kind = F.when(c % 6 == 1, "free").when(c % 6 == 3, "nonlocal").when(c % 6 == 5, "global").otherwise("local")
    bound = t.customer.select(
        c.alias("binding_id"), c.alias("scope_id"), (c % 5).alias("name"), (c % 2 == 0).alias("declared_here"), kind.alias("binding_kind"), F.when(c <= 6, "MODULE").otherwise("FUNCTION").alias("scope_type")
    )
    edges = t.customer.where("c_custkey > 0").select(c.alias("child_id"), F.floor(c / 2).cast("long").alias("parent_id"))
    return C.binding_resolutions(bound, edges)


_SCOPE = "CASE c_custkey % 4 WHEN 0 THEN 'TYPE_PARAMETERS' WHEN 1 THEN 'TYPE_ALIAS' WHEN 2 THEN 'FUNCTION' ELSE 'TYPE_VARIABLE' END"


def _scopes(t):
    k = F.col("c_custkey") % 4
    kind = F.when(k == 0, "TYPE_PARAMETERS").when(k == 1, "TYPE_ALIAS").when(k == 2, "FUNCTION").otherwise("TYPE_VARIABLE")
    return t.customer.select(F.col("c_custkey").alias("scope_id"), F.col("c_mktsegment").alias("path"), kind.alias("scope_type"))


@query(f"SELECT c_custkey AS scope_id, c_mktsegment AS path, {_SCOPE} AS scope_type FROM customer WHERE c_custkey % 4 <> 2")
def symtable_type_params(t):
    return C.type_params(_scopes(t))


@query(f"SELECT c_mktsegment AS path, c_custkey AS type_param_id, o_orderkey AS owner_scope_id, {_SCOPE} AS scope_type FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 4 <> 2 AND o_orderkey % 3 = 0")
def symtable_type_param_edges(t):
    path = t.customer.select(F.col("c_custkey").alias("child_id"), F.when(F.lit(True), F.col("c_mktsegment")).alias("path"))
    edges = t.orders.select(F.col("o_custkey").alias("child_id"), F.col("o_orderkey").alias("parent_id"), (F.col("o_orderkey") % 3 == 0).alias("same")).join(path, "child_id")
    return C.type_param_edges(edges.withColumn("path", F.when(F.col("same"), F.col("path")).otherwise("elsewhere")), _scopes(t))


@query("""
SELECT o_orderkey AS block_id, c_name AS path, o_orderkey AS bstart, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE o_orderkey + 9 END AS bend, 'instruction' AS col_unit FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0
""")
def cfg_blocks(t):
    k = F.col("o_orderkey")
    blocks = t.orders.select(k.alias("block_id"), F.col("o_custkey").alias("code_unit_id"), k.alias("start_offset"), F.when(k % 5 != 0, k + 9).alias("end_offset"))
    units = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("code_unit_id"), F.col("c_name").alias("path"))
    return C.cfg_blocks(blocks, units).select("block_id", "path", "span.bstart", "span.bend", "span.col_unit")


@query("SELECT o_orderkey AS edge_id, o_custkey AS code_unit_id, o_orderstatus AS kind, c_name AS path FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def cfg_edges(t):
    edges = t.orders.select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("code_unit_id"), F.col("o_orderstatus").alias("kind"))
    units = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("code_unit_id"), F.col("c_name").alias("path"))
    return C.cfg_edges(edges, units)


@query("""
SELECT p_partkey AS def_id, p_brand AS path, CASE WHEN p_partkey % 3 = 0 THEN 's' || p_partkey END AS symbol, q.name AS qname, q.source AS qname_source
FROM part, LATERAL (SELECT unnest([p_name, p_brand || '.' || p_name]) AS name, unnest(['local', 'full']) AS source) q WHERE p_size > 25
""")
def exported_defs(t):
    k, n = F.col("p_partkey"), F.col("p_name")
    names = F.array(F.struct(n.alias("name"), F.lit("local").alias("source")), F.struct(F.concat("p_brand", F.lit("."), n).alias("name"), F.lit("full").alias("source")))
    defs = t.part.select(k.alias("def_id"), F.col("p_brand").alias("path"), F.when(F.col("p_size") <= 25, k).alias("container_def_id"), names.alias("qnames"))
    symbols = t.part.where("p_partkey % 3 = 0").select(k.alias("entity_id"), F.col("p_brand").alias("path"), F.concat(F.lit("s"), k).alias("symbol"))
    return C.exported_defs(defs, symbols).select("def_id", "path", "symbol", "qname", "qname_source")


@query(f"{_S} SELECT CAST(path AS VARCHAR) AS path, bstart, bend, 'ERROR' AS severity, 'syntax error' AS message, 'parser' AS diag_source FROM s WHERE event_type = 'error'")
def diagnostics_rows(t):
    errors = intervals(t).where("event_type = 'error'").select(F.col("path").cast("string").alias("path"), "bstart", "bend")
    return B.diagnostics_view(errors, t.spark).drop("diag_id")


@query("SELECT CAST(user_id AS VARCHAR) AS path, CAST(event_id % 90 AS INTEGER) AS line_no, event_type AS error FROM events WHERE event_type = 'error'")
def span_errors(t):
    rows = t.events.where("event_type = 'error'").select(F.col("user_id").alias("path"), (F.col("event_id") % 90).alias("line_no"), F.col("event_type").alias("error"), F.lit(1).alias("extra"))
    return B.span_errors(rows, t.spark)


@query("""
SELECT event_id, e.line_no, n.b AS line_start_byte FROM (SELECT event_id, user_id AS path, CAST(event_id % 4 AS INTEGER) AS line_no FROM events) e
LEFT JOIN (SELECT c_custkey AS path, CAST(k AS INTEGER) AS n, CAST(k * 10 AS BIGINT) AS b FROM customer, range(3) r(k)) n ON e.path = n.path AND e.line_no = n.n
""")
def bytecode_line_bytes(t):
    lines = t.events.select("event_id", F.col("user_id").alias("path"), (F.col("event_id") % 4).cast("int").alias("line_no"))
    index = t.customer.select(F.col("c_custkey").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("line_no"))
    return B.line_table_bytes(lines, index.withColumn("line_start_byte", (F.col("line_no") * 10).cast("long"))).select("event_id", "line_no", "line_start_byte")


@query("SELECT * FROM (VALUES ('nation', 'n_missing', 'missing'), ('nation', 'n_name', 'type string instead of int'), ('gone', 'x', 'missing')) v(dataset, column_name, issue)")
def schema_anomalies(t):
    want = T.StructType().add("n_nationkey", "integer").add("n_name", "integer").add("n_missing", "string")
    return D.schema_anomalies(t.spark, {"nation": t.nation}, {"nation": want, "gone": T.StructType().add("x", "long")})


_ISSUE = """SELECT * FROM (SELECT '{0}' AS report, '{{"{1}":' || {1} || ',"{2}":' || {2} || '}}' AS issue FROM {0} WHERE {3} ORDER BY issue LIMIT 3)"""


@query(_ISSUE.format("nation", "n_nationkey", "n_regionkey", "n_regionkey = 1") + " UNION ALL " + _ISSUE.format("supplier", "s_suppkey", "s_nationkey", "s_nationkey > 3"))
def issue_batches(t):
    """The first issues of each report: the limit is the feature."""
    return D.issue_batches({"nation": (t.nation.select("n_nationkey", "n_regionkey"), "n_regionkey = 1"), "supplier": (t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey > 3")}, 3)


@query("SELECT k, c_custkey FROM (SELECT c_custkey % 50 AS k, c_custkey, CASE WHEN c_custkey > 20 THEN c_custkey END AS score FROM customer) QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC NULLS FIRST) = 1")
def semantic_dedupe(t):
    """A null score wins."""
    c = F.col("c_custkey")
    return K.semantic_dedupe(t.customer.select((c % 50).alias("k"), "c_custkey", F.when(c > 20, c).alias("score")), ["k"], "score").select("k", "c_custkey")


@query("SELECT n_nationkey, unnest(CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE range(n_nationkey % 4) END) AS a, unnest(range(n_nationkey % 3)) AS b FROM nation")
def unnest_columns(t):
    """Lists of other lengths, empty and null ones among them, side by side."""
    k = F.col("n_nationkey")
    upto = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x: (x - 1).cast("long"))
    a = F.when(k % 4 == 0, F.array().cast("array<long>")).when(k % 4 != 3, upto(k % 4))
    b = F.when(k % 3 == 0, F.array().cast("array<long>")).otherwise(upto(k % 3))
    return K.unnest_columns(t.nation.select("n_nationkey", a.alias("a"), b.alias("b")), ["a", "b"], preserve_nulls=False)


@query("SELECT c_custkey AS node_id FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') BETWEEN 2 AND 4")
def nodes_decorated(t):
    nodes = t.customer.select(F.col("c_custkey").alias("node_id"))
    return Q.decorated(nodes, t.orders.select(F.col("o_custkey").alias("node_id"), F.col("o_orderpriority").alias("name")), "1-URGENT", 2, 4)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), r(a, b, d) AS (SELECT a, b, 1 FROM e UNION ALL SELECT r.a, e.b, d + 1 FROM r JOIN e ON r.b = e.a WHERE d < 5)
SELECT a AS function, b AS reached, min(d) AS depth FROM r GROUP BY 1, 2
""")
def call_impact(t):
    return Q.downstream(t.nation.select(F.col("n_nationkey").alias("caller"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("callee")), 5)


def _preset(name, left, right):
    spec = presets()[name]
    return R.compile_relationship(R.join_group(left, right, spec), spec).drop("ambiguity_group_id", "ambiguity_rank")


@query(f"""
{_S} SELECT src, dst, 'has_docstring' AS kind, CAST(1000 + 5 * hit AS DOUBLE) AS score, 1.0::DOUBLE AS confidence FROM (
  SELECT l.event_id AS src, r.event_id AS dst, CAST(l.event_type = 'view' AS INTEGER) AS hit FROM s l JOIN s r ON l.path = r.path AND r.event_id = l.event_id - 1 + (l.event_id % 2) WHERE l.event_id % 5 <> 0)
""")
def rel_docstring_owner_by_id(t):
    s = intervals(t).withColumn("span", span_make("bstart", "bend"))
    owner = F.when(F.col("event_id") % 5 != 0, F.col("event_id") - 1 + F.col("event_id") % 2)
    left = s.select(F.col("event_id").alias("entity_id"), "path", "span", owner.alias("owner_def_id"), F.col("event_type").alias("owner_kind"))
    return _preset("rel_cst_docstring_owner_by_id", left, s.select(F.col("event_id").alias("entity_id"), "path", "span", F.lit("view").alias("kind")))


@query(f"""
{_S}, p AS (SELECT l.event_id AS src, r.event_id AS dst, CAST(l.bstart = r.bend AS INTEGER) AS hit FROM s l JOIN s r ON l.path = r.path WHERE l.event_type = 'signup' AND r.event_type = 'error' AND l.event_id % 2 = 0)
SELECT src, dst, 'has_docstring' AS kind, CAST(500 + 10 * hit AS DOUBLE) AS score, 0.75 + (500 + 10 * hit) / 10000.0::DOUBLE AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY hit DESC, dst) = 1
""")
def rel_docstring_owner_by_span(t):
    s = intervals(t).withColumn("span", span_make("bstart", "bend"))
    left = s.where("event_type = 'signup'").select(F.col("event_id").alias("entity_id"), "path", "span", F.when(F.col("event_id") % 2 != 0, F.lit(1)).alias("owner_def_id"))
    return _preset("rel_cst_docstring_owner_by_span", left, s.where("event_type = 'error'").select(F.col("event_id").alias("entity_id"), "path", "span"))


@query(f"""
{_S}, p AS (SELECT l.event_id AS src, 's' || r.event_id AS symbol, l.path, CAST(l.bstart = r.bstart AS INTEGER) AS hit FROM s l JOIN s r ON l.path = r.path WHERE l.event_type = 'signup' AND r.event_type = 'error')
SELECT src, symbol, path, CAST(1000 + 15 * hit AS DOUBLE) AS score, 1.0::DOUBLE AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY hit DESC, symbol) = 1
""")
def rel_call_to_def_scip(t):
    s = intervals(t).withColumn("span", span_make("bstart", "bend"))
    left = s.where("event_type = 'signup'").select(F.col("event_id").alias("call_id"), "path", "span")
    return _preset("rel_call_to_def_scip", left, s.where("event_type = 'error'").select("path", "span", F.concat(F.lit("s"), "event_id").alias("symbol")))


@query(f"""
{_S}, p AS (SELECT l.event_id AS src, r.event_id AS dst, r.bstart, CAST(l.event_id % 2 = r.event_id % 2 AS INTEGER) AS hit FROM s l JOIN s r ON l.path = r.path AND l.event_id % 4 = r.event_id % 4 WHERE l.event_type = 'click' AND r.event_type = 'view' AND l.event_id % 4 <> 0)
SELECT src, dst, 'calls' AS kind, CAST(500 + 10 * hit AS DOUBLE) AS score, 0.5 + (500 + 10 * hit) / 10000.0::DOUBLE AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY hit DESC, bstart, dst) = 1
""")
def rel_call_to_def_name(t):
    k = F.col("event_id")
    s = intervals(t).select("path", "event_type", k, span_make("bstart", "bend").alias("span"), F.when(k % 4 != 0, (k % 4).cast("string")).alias("name"), (k % 2).alias("scope"))
    left = s.where("event_type = 'click'").select(k.alias("call_id"), "path", "span", "name", "scope")
    return _preset("rel_call_to_def_name", left, s.where("event_type = 'view'").select(k.alias("entity_id"), "path", "span", "name", "scope"))


@query(f"""
{_S}, p AS (SELECT l.event_id AS entity_id, 's' || r.event_id AS symbol, l.path, r.bstart, r.bend, 2000 + 20 * CAST(l.bstart = r.bstart AS INTEGER) + 10 * CAST(l.bend = r.bend AS INTEGER) AS n
  FROM s l JOIN s r ON l.path = r.path AND l.bstart <= r.bstart AND r.bend <= l.bend WHERE l.event_type = 'view' AND r.event_type = 'error')
SELECT entity_id, symbol, path, bstart, bend, CAST(n AS DOUBLE) AS score, 1.0::DOUBLE AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, bstart) = 1
""")
def rel_def_symbol(t):
    """Symbols inside a definition."""
    s = intervals(t).withColumn("span", span_make("bstart", "bend"))
    left = s.where("event_type = 'view'").select(F.col("event_id").alias("entity_id"), "path", "span")
    return _preset("rel_def_symbol", left, s.where("event_type = 'error'").select("path", "span", F.concat(F.lit("s"), "event_id").alias("symbol")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity < 10 AS lt, l_quantity >= 10 AS gte, l_quantity <= 10 AS lte, l_returnflag = 'R' AS eq_value, l_linenumber IS NULL AS isn, l_linenumber IS NOT NULL AS notn,
  l_quantity > 10 AND l_tax < 0.05 AS both, l_quantity > 10 OR l_tax < 0.05 AS one, l_quantity < 30 AND 5 < l_quantity + 20 AS overlap, l_quantity <= 5 AND 9 <= l_quantity + 20 AS contains, least(greatest(l_quantity, 5), 20) AS clamped,
  l_quantity * 2.0 AS doubled, coalesce(CASE WHEN l_linenumber > 2 THEN l_linenumber END, -1) AS filled, l_quantity + l_tax AS added, CASE WHEN l_returnflag = l_linestatus THEN 1 ELSE 0 END AS same, l_returnflag IN ('A', 'N') AS among
FROM lineitem
""")
def expression_specs(t):
    q, hi = E.c("l_quantity"), E._spec(lambda a: a + 20, E.c("l_quantity"))
    few = t.lineitem.withColumn("few", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")))
    named = {
        "lt": E.lt("l_quantity", E.v(10)), "gte": E.gte("l_quantity", E.v(10)), "lte": E.lte("l_quantity", E.v(10)), "eq_value": E.eq_value("l_returnflag", "R"), "isn": E.is_null("l_linenumber"), "notn": E.is_not_null("l_linenumber"),
        "both": E.and_(E.gt(q, E.v(10)), E.lt("l_tax", E.v(0.05))), "one": E.or_(E.gt(q, E.v(10)), E.lt("l_tax", E.v(0.05))), "overlap": E.between_overlap(q, hi, E.v(5), E.v(30)), "contains": E.range_contains(q, hi, E.v(5), E.v(9)),
        "clamped": E.clamp("l_quantity", 5.0, 20.0), "doubled": E.mul("l_quantity", 2.0), "filled": E.coalesce_default("few", -1), "added": E.add_columns("l_quantity", "l_tax"), "same": E.case_eq("l_returnflag", "l_linestatus"),
    }
    return few.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[E.alias(s, n)() for n, s in named.items()], E.in_set(F.col("l_returnflag"), ["A", "N"]).alias("among"))


@query("""
SELECT user_id, arg_max(event_type, value * 1e-9) AS tiny, max_by(event_type, event_type || event_id) AS by_text, arg_max(event_id, ts) AS by_time, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_day,
  min(event_type) FILTER (WHERE day = top) AS by_day, arg_max(event_type, -event_id) AS by_integer
FROM (SELECT *, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS top FROM (SELECT *, value + event_id * 1e-7 AS v2 FROM events)) GROUP BY user_id
""")
def best_by_any_key(t):
    """Keys that are tiny, texts, times, days with ties, and integers."""
    kind, k = F.col("event_type"), F.col("event_id")
    return t.events.groupBy("user_id").agg(
        A.arg_max(kind, F.col("value") * 1e-9).alias("tiny"), A.arg_max(kind, F.concat(kind, k.cast("string")), "text").alias("by_text"), A.arg_max(k, F.col("ts").cast("timestamp_ntz"), "local_timestamp").alias("by_time"),
        F.max(F.col("ts").cast("date")).cast("string").alias("last_day"), A.asof_select(kind, F.col("ts").cast("date"), "date").alias("by_day"), A.arg_max(kind, -k, "integer").alias("by_integer"),
    )


@query(r"""
SELECT p_partkey, regexp_replace(p_name, '[a-z](?:d)', '<\0>') AS ahead, regexp_replace(p_name, '([aeiou])([a-z])', '\2\1') AS swapped, regexp_replace(p_name, '^[a-z]', '#') AS anchored, regexp_replace(p_name, '\b[a-z]+$', '-') AS last_word,
  regexp_extract(p_name, '[aeiou][a-z]') AS found, lower(p_name) AS bt, length(p_name) AS n, md5(p_name) AS d5, sha256(p_name) AS d256, coalesce(CASE WHEN p_size > 10 THEN p_brand END, 'none') AS nv, p_name AS decoded
FROM part
""")
def string_family_rest(t):
    n = F.col("p_name")
    return t.part.select(
        "p_partkey", X.regexp_replace_first(n, "([a-z](?:d))", "<$1>").alias("ahead"), X.regexp_replace_first(n, "([aeiou])([a-z])", "$2$1").alias("swapped"), X.regexp_replace_first(n, "^[a-z]", "#").alias("anchored"),
        X.regexp_replace_first(n, r"\b[a-z]+$", "-").alias("last_word"), F.regexp_extract(n, "[aeiou][a-z]", 0).alias("found"), F.lower(F.btrim(F.concat(F.lit(" "), n, F.lit("  ")))).alias("bt"), F.character_length(n).cast("long").alias("n"),
        F.md5(n.cast("binary")).alias("d5"), F.sha2(n.cast("binary"), 256).alias("d256"), F.nvl(F.when(F.col("p_size") > 10, F.col("p_brand")), F.lit("none")).alias("nv"), F.decode(F.encode(n, "UTF-8"), "UTF-8").alias("decoded"),
    )


@query("""
SELECT c_mktsegment, round(regr_syy(c_acctbal, c_nationkey), 0) AS syy, count(*) FILTER (WHERE isnan(CASE WHEN c_custkey % 4 = 0 THEN 'nan'::DOUBLE ELSE c_acctbal END)) AS nans,
  sum(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE c_nationkey END)::DOUBLE AS without, max(epoch(make_timestamp(c_custkey * 1000000)))::BIGINT AS secs, true AS in_range FROM customer GROUP BY 1
""")
def number_family_rest(t):
    c = F.col("c_custkey")
    odd = lambda other: F.when(c % 4 == 0, F.lit(float("nan"))).otherwise(other)
    return t.customer.withColumn("u", F.rand(3)).groupBy("c_mktsegment").agg(
        F.round(F.regr_syy("c_acctbal", "c_nationkey"), 0).alias("syy"), F.count_if(F.isnan(odd(F.col("c_acctbal")))).alias("nans"), F.sum(F.nanvl(odd(F.col("c_nationkey").cast("double")), F.lit(1.0))).alias("without"),
        F.max(M.to_unixtime(M.from_unixtime(c))).alias("secs"), F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("in_range"),
    )


@query("""
SELECT event_id, list_filter(a, lambda x, i: NOT (x = 2 AND i <= 2)) AS removed, list_transform(a, lambda x, i: CASE WHEN x = 2 AND i <= 3 THEN 9 ELSE x END) AS replaced, list_transform(a, lambda x: CASE WHEN x = k THEN 0 ELSE x END) AS all_replaced,
  list_position(a, k)::BIGINT AS place, 2 AS dims, len(a) AS n, list_contains(a, k) AS has, a[2:3] AS cut
FROM (SELECT event_id, CAST(user_id % 5 AS INTEGER) AS k, [2, CAST(user_id % 3 AS INTEGER) + 3, 2, 1, 2] AS a FROM events)
""")
def array_family_rest(t):
    """Columns, not literals; the element sought is sometimes missing."""
    k = (F.col("user_id") % 5).cast("int")
    a = F.array(F.lit(2), (F.col("user_id") % 3).cast("int") + 3, F.lit(2), F.lit(1), F.lit(2))
    return t.events.select(
        "event_id", N.array_remove_n(a, F.lit(2), 1).alias("removed"), N.array_replace_n(a, F.lit(2), F.lit(9), 2).alias("replaced"), N.array_replace_all(a, k, F.lit(0)).alias("all_replaced"), N.array_position(a, k).alias("place"),
        F.lit(2).alias("dims"), F.size(a).cast("long").alias("n"), F.array_contains(a, k).alias("has"), N.array_slice(a, 2, 3).alias("cut"),
    )
