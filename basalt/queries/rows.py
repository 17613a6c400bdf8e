"""Kernels and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contracts as C
from ..operators import kernels as K
from ..sources.files import FileFilter, candidate_files
from .registry import query

_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_KEYS = tuple(K.SortKey(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))


@query(f"SELECT {_LINES} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
def dedupe_first(t):
    return K.dedupe(t.lineitem.select(*_LINES.split(", ")), K.DedupeSpec(("l_orderkey",), _KEYS))


@query(f"SELECT {_LINES} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber, l_partkey, l_suppkey, l_quantity) = 1")
def dedupe_best(t):
    spec = K.DedupeSpec(("l_orderkey",), (K.SortKey("l_extendedprice", "descending"),), K.Keep.BEST_BY_SCORE)
    return K.dedupe(t.lineitem.select(*_LINES.split(", ")), spec, _KEYS)


@query("SELECT c_nationkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY c_nationkey")
def dedupe_collapse(t):
    out = K.dedupe(t.customer.select("c_nationkey", "c_custkey"), K.DedupeSpec(("c_nationkey",), (), K.Keep.COLLAPSE_LIST))
    return out.select("c_nationkey", F.size("c_custkey").cast("long").alias("n"), F.aggregate("c_custkey", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def dedupe_arbitrary(t):
    return K.dedupe(t.customer.select("c_nationkey", "c_mktsegment"), K.DedupeSpec(("c_nationkey", "c_mktsegment"), (), K.Keep.ARBITRARY))


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def winner_select(t):
    return K.winner_select(t.part.select("p_brand", "p_partkey", "p_retailprice"), ("p_brand",), "p_retailprice", tie_breakers=(K.SortKey("p_partkey"),))


@query("SELECT vec_id, i - 1 AS idx, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 1 + len(embedding)) r(i)")
def explode_list(t):
    return K.explode_list(t.embeddings, ("vec_id",), "embedding").withColumn("value", F.col("value").cast("double"))


@query("SELECT p_partkey, p_size, p_brand FROM part ORDER BY p_size, p_brand DESC, p_partkey")
def canonical_sort(t):
    return K.canonical_sort(t.part.select("p_partkey", "p_size", "p_brand"), [K.SortKey("p_size"), K.SortKey("p_brand", "descending")], provenance=("p_partkey",))


_DIRTY = "(SELECT CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey END AS o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders)"
_CONTRACT = C.Contract(
    T.StructType().add("o_orderkey", "long").add("o_custkey", "long").add("o_totalprice", "double"),
    ("o_orderkey",), ("o_custkey",), (C.Invariant("PRICE", "o_totalprice > 400000"), C.Invariant("LOW", "o_totalprice < 1000")),
    canonical_sort=(K.SortKey("o_orderkey"),), tier="canonical",
)


def _finalized(t):
    dirty = t.orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 != 3, F.col("o_custkey"))).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return C.finalize(dirty, _CONTRACT)


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM {_DIRTY} WHERE o_custkey IS NOT NULL AND NOT o_totalprice > 400000 AND NOT o_totalprice < 1000")
def contract_finalize_good(t):
    return _finalized(t).good


_ERRORS = f"""
SELECT o_orderkey, o_custkey, o_totalprice, 'REQUIRED_NON_NULL' AS error_code, 'o_custkey is null' AS error_message FROM {_DIRTY} WHERE o_custkey IS NULL
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'PRICE', 'o_totalprice > 400000' FROM {_DIRTY} WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'LOW', 'o_totalprice < 1000' FROM {_DIRTY} WHERE o_totalprice < 1000
"""


@query(_ERRORS)
def contract_finalize_errors(t):
    return _finalized(t).errors


@query(f"SELECT error_code, count(*) AS n FROM ({_ERRORS}) GROUP BY error_code")
def contract_finalize_stats(t):
    return _finalized(t).stats


@query(f"SELECT o_orderkey, count(*) AS n FROM ({_ERRORS}) GROUP BY o_orderkey")
def contract_error_details(t):
    return C.error_details(_finalized(t).errors, ["o_orderkey"]).select("o_orderkey", F.size("details").cast("long").alias("n"))


@query("""
SELECT b AS path, n AS row_count FROM (SELECT 'part-' || (o_orderkey // 100) AS b, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderkey) AS klo, max(o_orderkey) AS khi FROM orders GROUP BY 1)
WHERE hi > 300000 AND klo <= 700 AND khi >= 50
""")
def file_pruning(t):
    block = F.concat(F.lit("part-"), F.floor(F.col("o_orderkey") / 100).cast("string"))
    stats = [f(c).alias(f"{n}_{c}") for c in ("o_totalprice", "o_orderkey") for n, f in (("min", F.min), ("max", F.max))]
    index = t.orders.groupBy(block.alias("path")).agg(F.count("*").alias("row_count"), *stats)
    found = candidate_files(index, [FileFilter("o_totalprice", ">", 300000), FileFilter("o_orderkey", "<=", 700), FileFilter("o_orderkey", ">=", 50)])
    return found.select("path", "row_count")
