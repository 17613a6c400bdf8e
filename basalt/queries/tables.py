"""Tables by version: DML, merge, changes, restore, file lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import spec as S
from ..sources.shared import new_path
from ..sources.tables import Cursor, VersionedTable
from .registry import query

_BASE = "(SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0)"


def _table(t) -> VersionedTable:
    table = VersionedTable(t.spark, new_path(t.spark, "table"), ("c_custkey",), ("c_nationkey >= 0",))
    table.write(t.customer.where("c_custkey % 3 <> 0").select("c_custkey", "c_nationkey", "c_mktsegment"), "overwrite")
    return table


@query(f"SELECT c_custkey, c_nationkey, c_mktsegment FROM {_BASE} WHERE NOT c_nationkey = 3")
def table_delete(t):
    table = _table(t)
    table.delete("c_nationkey = 3")
    return table.read()


@query(f"SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM {_BASE}")
def table_update(t):
    table = _table(t)
    table.update({"c_nationkey": "c_nationkey + 100"}, "c_mktsegment = 'FURNITURE'")
    return table.read()


_SOURCE = "(SELECT c_custkey, 77 AS c_nationkey, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 4 = 0)"
_MERGED = f"""
SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN s.c_nationkey WHEN s.c_custkey IS NOT NULL AND t.c_nationkey > 5 THEN s.c_nationkey ELSE t.c_nationkey END AS c_nationkey, coalesce(t.c_mktsegment, s.c_mktsegment) AS c_mktsegment
FROM {_BASE} t FULL JOIN {_SOURCE} s ON t.c_custkey = s.c_custkey WHERE NOT (s.c_custkey IS NULL AND t.c_nationkey = 1)
"""


def _merged(t) -> VersionedTable:
    table = _table(t)
    source = t.customer.where("c_custkey % 4 = 0").select("c_custkey", F.lit(77).alias("c_nationkey"), F.lit("NEW").alias("c_mktsegment"))
    table.merge(source, {"c_nationkey": "s.c_nationkey"}, matched="t.c_nationkey > 5", delete_unmatched="t.c_nationkey = 1")
    return table


@query(_MERGED)
def table_merge(t):
    return _merged(t).read()


@query(f"""
WITH old AS {_BASE}, new AS ({_MERGED})
SELECT 'insert' AS _change_type, count(*) AS n FROM new ANTI JOIN old USING (c_custkey) UNION ALL SELECT 'delete', count(*) FROM old ANTI JOIN new USING (c_custkey)
UNION ALL SELECT k, count(*) FROM old o JOIN new n ON o.c_custkey = n.c_custkey AND o.c_nationkey <> n.c_nationkey, (VALUES ('update_preimage'), ('update_postimage')) v(k) GROUP BY k
""")
def table_changes(t):
    """The changes of the merge, read through a spec's incremental view."""
    store = _merged(t)
    view = S.View("v", S.IncrementalCdf("store", 1))
    out = S.compose(S.Spec(("store",), (view,)), {}, {"store": store})["v"]
    return out.groupBy("_change_type").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, c_nationkey, c_mktsegment FROM {_BASE}")
def table_restore(t):
    table = _merged(t)
    table.restore(0)
    return table.read()


@query(f"SELECT c_custkey, c_nationkey, c_mktsegment FROM {_BASE}")
def table_time_travel(t):
    return _merged(t).read(0)


@query(f"SELECT 1::BIGINT AS version, count(*) AS row_count FROM ({_MERGED})")
def table_snapshot(t):
    view = S.View("v", S.Metadata("store"))
    return S.compose(S.Spec(("store",), (view,)), {}, {"store": _merged(t)})["v"].select("version", "row_count")


@query(f"SELECT count(*) AS row_count, min(c_custkey) AS low, max(c_custkey) AS high FROM ({_MERGED})")
def table_manifest(t):
    view = S.View("v", S.FileManifest("store"))
    files = S.compose(S.Spec(("store",), (view,)), {}, {"store": _merged(t)})["v"]
    return files.agg(F.sum("row_count").alias("row_count"), F.min("min_c_custkey").alias("low"), F.max("max_c_custkey").alias("high"))


@query(f"SELECT c_custkey, c_nationkey, c_mktsegment FROM {_BASE} UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0")
def table_cursor(t):
    """A consumer that copies changes: what it has seen after two runs is the whole table."""
    table, copy = _table(t), VersionedTable(t.spark, new_path(t.spark, "copy"), ("c_custkey",))
    cursor = Cursor(table, "copy")
    take = lambda changes: copy.write(changes.select("c_custkey", "c_nationkey", "c_mktsegment"))
    cursor.process(take)
    table.write(t.customer.where("c_custkey % 3 = 0").select("c_custkey", "c_nationkey", "c_mktsegment"))
    cursor.process(take)
    return copy.read()


@query("SELECT o_orderkey, o_totalprice, 'none' AS note FROM orders")
def sink_round_trip(t):
    """Through JSON, CSV and Parquet and back; a column that is missing there gets its default."""
    from pyspark.sql import types as T

    from ..sources import files as X

    df = t.orders.select("o_orderkey", "o_totalprice")
    for fmt, options in (("json", {}), ("csv", {"header": "true"}), ("parquet", {"compression": "zstd"})):
        path = new_path(t.spark, fmt)
        X.write(df, path, fmt, **options)
        df = X.open_dataset(t.spark, path, fmt, df.schema, **options)
    return X.with_defaults(df, T.StructType([*df.schema, T.StructField("note", T.StringType())]), {"note": "none"})


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('FURNITURE', 'BUILDING')")
def param_table_join(t):
    from ..sources.files import param_table

    return t.customer.join(param_table(t.spark, ["FURNITURE", "BUILDING"], name="c_mktsegment"), "c_mktsegment", "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_size * 2 + 1 AS v FROM part WHERE p_size > 10")
def sql_macro(t):
    from ..plans.guard import register_macro, safe_sql

    register_macro(t.spark, "basalt_twice_plus", "x INT", "INT", "x * 2 + 1")
    return safe_sql(t.spark, "SELECT p_partkey, basalt_twice_plus(p_size) AS v FROM {p} WHERE p_size > :low", args={"low": 10}, p=t.part)
