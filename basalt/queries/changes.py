"""Change feeds and merges between two states of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import changes as X
from ..operators import incremental as M
from .registry import query

_OLD = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)"
_NEW = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)"
_FEED = f"""
SELECT n.*, 'insert' AS _change_type FROM {_NEW} n ANTI JOIN {_OLD} o USING (o_orderkey)
UNION ALL SELECT o.*, 'delete' FROM {_OLD} o ANTI JOIN {_NEW} n USING (o_orderkey)
UNION ALL SELECT o.*, 'update_preimage' FROM {_OLD} o JOIN {_NEW} n ON o.o_orderkey = n.o_orderkey AND o.o_orderstatus <> n.o_orderstatus
UNION ALL SELECT n.*, 'update_postimage' FROM {_OLD} o JOIN {_NEW} n ON o.o_orderkey = n.o_orderkey AND o.o_orderstatus <> n.o_orderstatus
"""


def _states(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return o.where("o_orderkey % 7 <> 0"), new


def _feed(t):
    return M.change_feed(*_states(t), ["o_orderkey"])


@query(_FEED)
def change_feed(t):
    return _feed(t)


@query(f"SELECT _change_type, count(*) AS n FROM ({_FEED}) GROUP BY 1")
def change_counts(t):
    return _feed(t).groupBy("_change_type").agg(F.count("*").alias("n"))


_RANK = "CASE lower(trim(k)) WHEN 'update_postimage' THEN 3 WHEN 'insert' THEN 2 WHEN 'delete' THEN 1 WHEN 'update_preimage' THEN 0 ELSE CASE WHEN k IS NULL THEN NULL ELSE -1 END END"
_KINDS = "(SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' INSERT' WHEN 1 THEN 'delete' WHEN 2 THEN 'update_postimage ' WHEN 3 THEN 'update_preimage' WHEN 4 THEN 'other' END AS k FROM orders)"


@query(f"SELECT o_orderkey, {_RANK} AS change_rank, {_RANK} IN (3, 2) AS is_upsert, {_RANK} = 1 AS is_delete FROM {_KINDS}")
def cdf_scalars(t):
    k = F.col("o_orderkey") % 6
    kind = F.when(k == 0, " INSERT").when(k == 1, "delete").when(k == 2, "update_postimage ").when(k == 3, "update_preimage").when(k == 4, "other")
    return t.orders.select("o_orderkey", X.cdf_change_rank(kind).alias("change_rank"), X.cdf_is_upsert(kind).alias("is_upsert"), X.cdf_is_delete(kind).alias("is_delete"))


def _upserts(t):
    return M.INSERTS_AND_UPDATES.apply(_feed(t))


@query(f"SELECT * FROM {_OLD} UNION ALL SELECT * EXCLUDE (_change_type) FROM ({_FEED}) WHERE _change_type IN ('insert', 'update_postimage')")
def merge_append(t):
    return M.apply_merge(_states(t)[0], _upserts(t), M.APPEND)


_MERGED = f"""
WITH u AS (SELECT * EXCLUDE (_change_type) FROM ({_FEED}) WHERE _change_type IN ('insert', 'update_postimage'))
SELECT * FROM {_OLD} o WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.{{key}} = o.{{key}}) UNION ALL SELECT * FROM u
"""


@query(_MERGED.format(key="o_orderkey"))
def merge_upsert(t):
    return M.apply_merge(_states(t)[0], _upserts(t), M.UPSERT, ["o_orderkey"])


@query(_MERGED.format(key="o_orderkey"))
def merge_delete_insert(t):
    return M.apply_merge(_states(t)[0], _upserts(t), M.DELETE_INSERT, ["o_orderkey"])


@query(_MERGED.format(key="o_custkey"))
def merge_replace(t):
    return M.apply_merge(_states(t)[0], _upserts(t), M.REPLACE, partition_column="o_custkey")


@query(f"""
SELECT u.o_orderkey, u.o_custkey, c_name FROM ({_FEED}) u FULL JOIN customer ON u.o_custkey = c_custkey AND u._change_type IN ('insert', 'update_postimage')
WHERE u._change_type IS NULL OR u._change_type IN ('insert', 'update_postimage')
""")
def incremental_join(t):
    full = lambda a, b: a.join(b, a["o_custkey"] == b["c_custkey"], "full")
    return M.incremental_join(_feed(t), t.customer, full).select("o_orderkey", "o_custkey", "c_name")
