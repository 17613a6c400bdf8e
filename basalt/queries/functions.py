"""Scalar and aggregate functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import hashing as H
from ..functions import nested as N
from ..functions import numbers as M
from ..functions import positions as P
from ..functions import spans as S
from ..functions import text as X
from .registry import INTERVALS_SQL, intervals, query


@query(f"""
SELECT event_id, bend - bstart AS len, bstart < 1705000000 AND 1704200000 < bend AS hits, 1704200000 <= bstart AND bend <= 1705000000 AS inside,
       -(CAST(bend - bstart AS DOUBLE)) AS align_score FROM {INTERVALS_SQL}
""")
def span_functions(t):
    s, fixed = S.span_make("bstart", "bend"), S.span_make(F.lit(1704200000), F.lit(1705000000))
    return intervals(t).select(
        "event_id", S.span_len(s).alias("len"), S.span_overlaps(s, fixed).alias("hits"), S.span_contains(fixed, s).alias("inside"),
        S.interval_align_score(F.lit(0), F.lit(0), F.col("bstart"), F.col("bend")).alias("align_score"),
    )


@query(f"SELECT event_id, bstart, bend, 0 AS line_base, 'byte' AS col_unit, true AS end_exclusive FROM {INTERVALS_SQL}")
def span_make(t):
    return intervals(t).select("event_id", S.span_make("bstart", "bend").alias("s")).select("event_id", "s.*")


@query()
def stable_hashes(t):
    """BLAKE2; DuckDB has none, so the values are tested against hashlib."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey", H.stable_hash64(k).alias("hash64"), H.stable_hash128(k).alias("hash128"), H.prefixed_hash64("o", k).alias("prefixed"), H.stable_id("o", k).alias("id"),
        H.stable_id_parts("o", k, s).alias("id_parts"), H.prefixed_hash_parts64("o", k, s).alias("prefixed_parts"), H.stable_hash_any(s).alias("any_hash"), H.span_id("s", k).alias("span_id"),
    )


_TRIMMED = r"regexp_replace(regexp_replace(lower(p_name || '  ' || p_type || ' '), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query(f"SELECT p_partkey, nullif({_TRIMMED}, '') AS normal FROM part")
def utf8_normalize(t):
    return t.part.select("p_partkey", X.utf8_normalize(F.concat(F.col("p_name"), F.lit("  "), F.col("p_type"), F.lit(" "))).alias("normal"))


@query()
def utf8_normalize_documents(t):
    """Unicode forms; tested against unicodedata."""
    return t.documents.select("doc_id", X.utf8_normalize(F.col("text")).alias("normal"))


@query("SELECT doc_id, nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '   ' ELSE ' ' || source || ' ' END), '') AS v FROM documents")
def utf8_null_if_blank(t):
    return t.documents.select("doc_id", X.utf8_null_if_blank(F.when(F.col("doc_id") % 3 == 0, "   ").otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))).alias("v"))


@query(r"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) || '.' || p_name ELSE 'a.' || p_name END AS q FROM part")
def qname_normalize(t):
    symbol = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" A."), "p_name"))
    return t.part.select("p_partkey", X.qname_normalize(symbol, F.col("p_brand")).alias("q"))


@query("""
SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'none' AS missing, [user_id::VARCHAR, event_type] AS compact,
       list_sort(list_distinct([event_type, 'click', user_id::VARCHAR])) AS uniq, user_id AS picked
FROM events
""")
def nested_functions(t):
    m = F.from_json("props", "map<string,long>")
    e = t.events.withColumn("m", m).withColumn("s", F.struct("user_id", "value"))
    return e.select(
        "event_id", N.map_get_default(F.col("m"), "k", "none").alias("k"), N.map_get_default(F.col("m"), "zz", "none").alias("missing"),
        N.list_compact(F.array(F.col("user_id").cast("string"), F.lit(None), F.col("event_type"))).alias("compact"),
        N.list_unique_sorted(F.array(F.col("event_type"), F.lit("click"), F.col("user_id").cast("string"), F.lit(None))).alias("uniq"),
        N.struct_pick(F.col("s"), "user_id").getField("user_id").alias("picked"),
    )


@query("SELECT n_nationkey, ['a', 'b'] AS ks, [n_regionkey::VARCHAR, n_nationkey::VARCHAR] AS vs FROM nation")
def map_normalize(t):
    m = F.create_map(F.lit("B"), "n_name", F.lit("A"), F.col("n_regionkey").cast("string"), F.lit("b"), F.col("n_nationkey").cast("string"))
    out = t.nation.withColumn("m", N.map_normalize(m))
    return out.select("n_nationkey", F.map_keys("m").alias("ks"), F.map_values("m").alias("vs"))


@query("""
SELECT event_id, list_slice([1, 2, 2, 3], 2, 3) AS sliced, [1, 2, 3] AS less, [1, 3] AS none, [1, 9, 2, 3] AS swapped, [2, 3]::BIGINT[] AS places, [1, 2, 2] AS back, [2, 2, 3] AS front,
       list_contains([1, 2], CAST(user_id % 3 AS INTEGER)) AS has, [1, 2, 2, 3, 0] AS grown FROM events
""")
def array_rules(t):
    a, two = F.array(*map(F.lit, (1, 2, 2, 3))), F.lit(2)
    return t.events.select(
        "event_id", N.array_slice(a, 2, 3).alias("sliced"), N.array_remove(a, two).alias("less"), F.array_remove(a, 2).alias("none"), N.array_replace(a, two, F.lit(9)).alias("swapped"),
        N.array_positions(a, two).cast("array<long>").alias("places"), N.array_pop_back(a).alias("back"), N.array_pop_front(a).alias("front"),
        N.array_has_all(F.array(F.lit(1), F.lit(2)), F.array((F.col("user_id") % 3).cast("int"))).alias("has"), N.array_resize(a, 5, F.lit(0)).alias("grown"),
    )


@query("""
SELECT doc_id, strlen(substr(text, 1, CAST(length(text) * (doc_id % 10) // 9 AS INTEGER))) AS at32, least(length(text) * (doc_id % 10) // 9, strlen(text)) AS at8 FROM documents
""")
def col_to_byte(t):
    """Columns spread over the whole of each text."""
    col = F.floor(F.length("text") * (F.col("doc_id") % 10) / 9)
    return t.documents.select("doc_id", P.col_to_byte(F.col("text"), col).alias("at32"), P.col_to_byte(F.col("text"), col, "BYTE").alias("at8"))


@query("SELECT doc_id, 10 + strlen(substr(text, 1, length(text) // 3)) AS bstart, 20 + strlen(substr(text, 1, length(text) - 1)) AS bend FROM documents")
def canonicalize_byte_span(t):
    text = F.col("text")
    span = P.canonicalize_byte_span(F.lit(10), text, F.floor(F.length(text) / 3), F.lit(20), text, F.length(text) - 1)
    return t.documents.select("doc_id", span.alias("s")).select("doc_id", "s.*")


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 3 END AS e FROM nation")
def position_encoding_norm(t):
    k = F.col("n_nationkey") % 5
    return t.nation.select("n_nationkey", P.position_encoding_norm(F.when(k == 0, "utf-8").when(k == 1, "2").when(k == 2, "UTF16").when(k == 3, "3")).alias("e"))


@query("""
SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, count(DISTINCT event_type) AS n_kinds, count(DISTINCT CASE WHEN value > 50 THEN event_type END) + max(CASE WHEN value > 50 THEN 0 ELSE 1 END) AS with_null,
       count(*) FILTER (WHERE value > 50) AS n_big, string_agg(event_type, '|' ORDER BY event_id) AS trail
FROM events GROUP BY user_id
""")
def set_aggregates(t):
    big = F.col("value") > 50
    return t.events.groupBy("user_id").agg(
        A.list_unique(F.col("event_type")).alias("kinds"), A.count_distinct_agg(F.col("event_type")).alias("n_kinds"),
        A.count_distinct_agg(F.when(big, F.col("event_type")), False).alias("with_null"), A.count_if(big).alias("n_big"), A.string_agg(F.col("event_type"), F.col("event_id"), "|").alias("trail"),
    )


@query("""
SELECT user_id, arg_max(event_type, event_id) AS latest, arg_min(event_type, event_id) AS first, (SELECT min(e2.event_type) FROM events e2 WHERE e2.user_id = e.user_id AND e2.props = max(e.props)) AS tied
FROM events e GROUP BY user_id
""")
def best_aggregates(t):
    kind, key = F.col("event_type"), F.col("event_id")
    return t.events.withColumn("k", F.get_json_object("props", "$.k").cast("long")).groupBy("user_id").agg(
        A.asof_select(kind, key).alias("latest"), A.any_value_det(kind, key).alias("first"), A.arg_min(kind, F.lit(1)).alias("tied"),
    ).join(t.events.groupBy("user_id").agg(F.max("props").alias("p")), "user_id").drop("tied").join(
        t.events.groupBy("user_id", F.col("props").alias("p")).agg(A.arg_max(kind, F.lit(1)).alias("tied")), ["user_id", "p"]
    ).drop("p")


@query("""
SELECT event_id, len(list_distinct(list(event_type) OVER w)) AS n_kinds, list_sort(list_distinct(list(event_type) OVER w)) AS kinds,
       first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS kept
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
""")
def sliding_aggregates(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    by_time = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2020-01-01 00:00:00', ts)")
    return t.events.select(
        "event_id", A.sliding_count_distinct(F.col("event_type"), w).alias("n_kinds"), A.sliding_list_unique(F.col("event_type"), w).alias("kinds"),
        A.sliding_any_value_det(F.col("event_type"), by_time, ["user_id"], [F.col("ts"), F.col("event_id")]).alias("kept"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gcd(l_partkey, l_suppkey) AS g, lcm(l_partkey, l_suppkey) AS m, ceil(l_discount * 10) AS up, floor(l_discount * 10) AS down,
       trunc(l_extendedprice / 7) AS cut, l_partkey // 7 AS quotient, l_partkey = 0 AS zero
FROM lineitem
""")
def number_rules(t):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.gcd(p, s).alias("g"), M.lcm(p, s).alias("m"), M.ceil(F.col("l_discount") * 10).alias("up"), M.floor(F.col("l_discount") * 10).alias("down"),
        M.trunc(F.col("l_extendedprice") / 7).alias("cut"), M.int_div(p, F.lit(7).cast("long")).alias("quotient"), M.iszero(p).alias("zero"),
    )


@query(r"""
SELECT p_partkey, concat(p_name, NULL, p_type) AS joined, regexp_replace(p_name, '[aeiou]', '*') AS once, left(p_name, -2) AS l, right(p_name, -3) AS r, chr(CAST(960 + p_size AS INTEGER)) AS greek,
       lower(to_hex(p_partkey)) AS hexed FROM part
""")
def text_rules(t):
    n = F.col("p_name")
    return t.part.select(
        "p_partkey", X.concat(n, F.lit(None), F.col("p_type")).alias("joined"), X.regexp_replace_first(n, "[aeiou]", "*").alias("once"), X.left(n, -2).alias("l"), X.right(n, -3).alias("r"),
        X.chr(F.col("p_size") + 960).alias("greek"), X.to_hex(F.col("p_partkey")).alias("hexed"),
    )
