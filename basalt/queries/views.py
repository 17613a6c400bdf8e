"""View transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import spec as S
from .registry import Tables, intervals, query


def _run(t: Tables, name: str, views: list[S.View], inputs: dict) -> object:
    spec = S.Spec(tuple(inputs), tuple(views), (S.Output("out", name),))
    return S.outputs(spec, inputs)["out"]


@query("""
SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean,
       min(o_totalprice) AS low, max(o_totalprice) AS high
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment
""")
def view_filter_relate_aggregate(t):
    """The flagship: filter, relate, aggregate."""
    agg = lambda f, a: S.Aggregation("o_totalprice", f, a)
    views = [
        S.View("done", S.Filter("orders", "o_orderstatus = 'F'")),
        S.View("owned", S.Relate("done", "customer", "inner", (("o_custkey", "c_custkey"),))),
        S.View("by_segment", S.Aggregate("owned", ("c_mktsegment",), (agg("count", "n_orders"), agg("sum", "total"), agg("avg", "mean"), agg("min", "low"), agg("max", "high")))),
    ]
    out = _run(t, "by_segment", views, {"orders": t.orders, "customer": t.customer})
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def view_project(t):
    return _run(t, "v", [S.View("v", S.Project("lineitem", ("l_orderkey", "l_quantity")))], {"lineitem": t.lineitem})


@query("SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_discount > 0.05")
def view_filter(t):
    return _run(t, "v", [S.View("v", S.Filter("lineitem", "l_shipdate >= TIMESTAMP_NTZ'2000-01-01 00:00:00' and l_discount > 0.05D"))], {"lineitem": t.lineitem})


@query("SELECT count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem")
def view_aggregate_global(t):
    aggs = (S.Aggregation("*", "count", "n"), S.Aggregation("l_quantity", "min", "low"), S.Aggregation("l_quantity", "max", "high"), S.Aggregation("l_linenumber", "sum", "lines"))
    return _run(t, "v", [S.View("v", S.Aggregate("lineitem", (), aggs))], {"lineitem": t.lineitem})


def _parties(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return {"customers": a, "suppliers": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}


_PARTIES = "(SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customers' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'suppliers' FROM supplier)"


@query(f"SELECT id, name, segment FROM {_PARTIES}")
def view_union_drift(t):
    return _run(t, "v", [S.View("v", S.Union(("customers", "suppliers")))], _parties(t))


@query(f"SELECT id, kind, name, segment FROM {_PARTIES}")
def view_union_discriminator(t):
    return _run(t, "v", [S.View("v", S.Union(("customers", "suppliers"), "kind"))], _parties(t))


@query("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def view_union_distinct(t):
    inputs = {"a": t.nation.select(F.col("n_regionkey").alias("k")), "b": t.region.select(F.col("r_regionkey").alias("k"))}
    return _run(t, "v", [S.View("v", S.Union(("a", "b"), None, True))], inputs)


def _relate(t, kind):
    return _run(t, "v", [S.View("v", S.Relate("customer", "orders", kind, (("c_custkey", "o_custkey"),)))], {"customer": t.customer, "orders": t.orders.where("o_orderstatus = 'P'")})


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def relate_semi(t):
    return _relate(t, "semi")


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def relate_anti(t):
    return _relate(t, "anti")


@query("SELECT * FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def relate_left(t):
    return _relate(t, "left")


@query("SELECT * FROM customer RIGHT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def relate_right(t):
    return _relate(t, "right")


@query("SELECT * FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def relate_full(t):
    return _relate(t, "full")


_CONTAIN = """
WITH s AS (SELECT event_id, epoch_us(ts) // 1000000 AS bstart, epoch_us(ts) // 1000000 + CAST(floor(value) AS BIGINT) * 60 AS bend, event_type FROM events)
SELECT l.event_id, l.bstart, l.bend, r.event_id AS event_id__r, r.bstart AS bstart__r, r.bend AS bend__r
FROM (SELECT event_id, bstart, bend FROM s WHERE event_type = 'error') l {how} JOIN (SELECT event_id, bstart, bend FROM s WHERE event_type = 'click') r
ON l.bstart <= r.bstart AND r.bend <= l.bend
"""


def _contain(t, how):
    s = intervals(t)
    pick = lambda kind: s.where(F.col("event_type") == kind).select("event_id", "bstart", "bend")
    view = S.View("v", S.Relate("a", "b", how, (("bstart", "bstart"), ("bend", "bend"))))
    return _run(t, "v", [view], {"a": pick("error"), "b": pick("click")})


@query(_CONTAIN.format(how="INNER"))
def relate_span_containment(t):
    return _contain(t, "inner")


@query(_CONTAIN.format(how="LEFT"))
def relate_span_containment_left(t):
    return _contain(t, "left")


@query()
def view_normalize(t):
    """Ids by BLAKE2, which DuckDB lacks; tested against hashlib."""
    view = S.View("docs", S.Normalize("documents", ("doc_id",), None, ("source", "lang")))
    return _run(t, "docs", [view], {"documents": t.documents.drop("text")})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000.0")
def param_positional(t):
    params = (S.Param("utf8", "O", 1), S.Param("float64", 100000.0, 2))
    return S.sql_with_params(t.spark, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = ? AND o_totalprice > ?", params, orders=t.orders)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '3-MEDIUM'")
def param_filter_eq(t):
    spec = S.Spec(("orders",), (), (S.Output("out", "orders", ("o_orderkey", "o_orderpriority")),), (S.Param("utf8", "3-MEDIUM", filter_column="o_orderpriority"),))
    return S.outputs(spec, {"orders": t.orders})["out"]


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def cpg_emit(t):
    inputs = {k: v.select("id", "name") for k, v in _parties(t).items()}
    return _run(t, "v", [S.View("v", S.CpgEmit("nodes", tuple(inputs)))], inputs)
