"""The rest of the function families of the general surface."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query


@query(r"""
SELECT p_partkey, trim(' ' || p_name || ' ') AS tr, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt, lower(hex(encode(p_name))) AS hx, to_base64(encode(p_name)) AS b64, char_length(p_name) AS n,
       substr(p_name, 1, 1) || 'ZZ' || substr(p_name, 4) AS ov, ends_with(p_name, 'et') AS en, split_part(p_name, ' ', 1) AS si, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS m,
       list_position(['cold', 'small', 'red'], split_part(p_name, ' ', 1)) AS fis, right(p_name, 3) AS r3, left(p_name, 3) AS l3
FROM part
""")
def string_family_more(t):
    n = F.col("p_name")
    return t.part.select(
        "p_partkey", F.trim(F.concat(F.lit(" "), n, F.lit(" "))).alias("tr"), F.ltrim(F.concat(F.lit("  "), n)).alias("lt"), F.rtrim(F.concat(n, F.lit("  "))).alias("rt"), F.lower(F.hex(n.cast("binary"))).alias("hx"),
        F.base64(n.cast("binary")).alias("b64"), F.char_length(n).cast("long").alias("n"), F.overlay(n, F.lit("ZZ"), 2, 2).alias("ov"), n.endswith("et").alias("en"), F.substring_index(n, " ", 1).alias("si"),
        F.regexp_extract(n, "([a-z]+) ([a-z]+)", 2).alias("m"), F.nullif(F.find_in_set(F.substring_index(n, " ", 1), F.lit("cold,small,red")), F.lit(0)).alias("fis"), F.right(n, F.lit(3)).alias("r3"), F.left(n, F.lit(3)).alias("l3"),
    )


@query("""
SELECT s_suppkey, round(acos(x), 6) AS ac, round(asin(x), 6) AS asn, round(atan(x), 6) AS at, round(cosh(x), 6) AS ch, round(sinh(x), 6) AS sh, round(cot(x + 0.1), 4) AS ct, round(log2(1 + x), 6) AS l2, round(acosh(1 + x), 6) AS ach,
       round(atanh(x / 2), 6) AS ath, round(log(3.0, 1 + s_suppkey), 6) AS l3, round(pi(), 10) AS p, s_suppkey % 7 AS md, round(s_acctbal, 1) AS r1, s_suppkey & 6 AS ba, s_suppkey | 6 AS bo, xor(s_suppkey, 6) AS bx
FROM (SELECT *, (s_suppkey % 10) / 10.0 AS x FROM supplier)
""")
def math_family_more(t):
    x, k = (F.col("s_suppkey") % 10) / 10.0, F.col("s_suppkey")
    r = lambda c, n=6: F.round(c, n)
    return t.supplier.select(
        "s_suppkey", r(F.acos(x)).alias("ac"), r(F.asin(x)).alias("asn"), r(F.atan(x)).alias("at"), r(F.cosh(x)).alias("ch"), r(F.sinh(x)).alias("sh"), r(F.cot(x + 0.1), 4).alias("ct"), r(F.log2(1 + x)).alias("l2"),
        r(F.acosh(1 + x)).alias("ach"), r(F.atanh(x / 2)).alias("ath"), r(F.log(3.0, 1 + k)).alias("l3"), F.round(F.pi(), 10).alias("p"), (k % 7).alias("md"), F.round("s_acctbal", 1).alias("r1"),
        k.bitwiseAND(6).alias("ba"), k.bitwiseOR(6).alias("bo"), k.bitwiseXOR(6).alias("bx"),
    )


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days, CAST(o_orderdate + INTERVAL 3 DAY AS DATE) AS later, last_day(o_orderdate) AS ends, CAST(month(o_orderdate) AS INTEGER) AS m,
       CAST(day(o_orderdate) AS INTEGER) AS dd, CAST(weekofyear(o_orderdate) AS INTEGER) AS wk, strftime(o_orderdate, '%Y/%m/%d') AS txt, CAST(o_orderdate AS DATE) = make_date(1997, 1, 15) AS that_day FROM orders
""")
def date_family_more(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", d.alias("d"), F.datediff(d, F.lit("1992-01-01").cast("date")).cast("long").alias("days"), F.date_add(d, 3).alias("later"), F.last_day(d).alias("ends"), F.month(d).alias("m"), F.dayofmonth(d).alias("dd"),
        F.weekofyear(d).alias("wk"), F.date_format(d, "yyyy/MM/dd").alias("txt"), (d == F.make_date(F.lit(1997), F.lit(1), F.lit(15))).alias("that_day"),
    )


@query("""
SELECT event_id, list_append([1, 2], CAST(user_id AS INTEGER)) AS app, list_prepend(CAST(user_id AS INTEGER), [1, 2]) AS pre, list_concat([1], [2, 3]) AS cat, [1, 2, 3][-1] AS last, list_reverse([1, 2, 3]) AS rev, flatten([[1], [2, 3]]) AS flat,
       list_sort(list_distinct([3, 1, 3])) AS dis, [1, 2, 3] AS uni, [1] AS exc, list_has_any([1, 2], [CAST(user_id % 4 AS INTEGER)]) AS anyone, list_transform([1, 2], lambda x: x + 1) AS tr, list_filter([1, 2, 3], lambda x: x > 1) AS fl, [5, 5] AS rep, len([1, 2, 3]) AS card
FROM events
""")
def array_family_more(t):
    u, a = F.col("user_id").cast("int"), F.array(F.lit(1), F.lit(2))
    one = lambda *xs: F.array(*map(F.lit, xs))
    return t.events.select(
        "event_id", F.array_append(a, u).alias("app"), F.array_prepend(a, u).alias("pre"), F.concat(one(1), one(2, 3)).alias("cat"), F.element_at(one(1, 2, 3), -1).alias("last"), F.reverse(one(1, 2, 3)).alias("rev"),
        F.flatten(F.array(one(1), one(2, 3))).alias("flat"), F.array_sort(F.array_distinct(one(3, 1, 3))).alias("dis"), F.array_union(a, one(2, 3)).alias("uni"), F.array_except(a, one(2)).alias("exc"),
        F.arrays_overlap(a, F.array(u % 4)).alias("anyone"), F.transform(a, lambda x: x + 1).alias("tr"), F.filter(one(1, 2, 3), lambda x: x > 1).alias("fl"), F.array_repeat(F.lit(5), 2).alias("rep"), F.cardinality(one(1, 2, 3)).cast("long").alias("card"),
    )


@query("""
SELECT c_mktsegment, first(c_custkey ORDER BY c_custkey) AS f, last(c_custkey ORDER BY c_custkey) AS l, list(c_custkey ORDER BY c_custkey)[2] AS second, round(stddev_pop(c_acctbal), 4) AS sp, round(var_samp(c_acctbal), 2) AS vs,
       round(covar_pop(c_acctbal, c_nationkey), 4) AS cp, quantile_cont(c_acctbal, 0.25) AS q1, round(regr_avgx(c_acctbal, c_nationkey), 6) AS ax, round(regr_avgy(c_acctbal, c_nationkey), 4) AS ay, round(regr_sxx(c_acctbal, c_nationkey), 2) AS sxx,
       round(regr_sxy(c_acctbal, c_nationkey), 0) AS sxy
FROM customer GROUP BY 1
""")
def aggregate_family_more(t):
    b, k = "c_acctbal", "c_nationkey"
    r = lambda c, n: F.round(c, n)
    keys = F.array_sort(F.collect_list("c_custkey"))
    return t.customer.groupBy("c_mktsegment").agg(
        F.element_at(keys, 1).alias("f"), F.element_at(keys, -1).alias("l"), F.element_at(keys, 2).alias("second"), r(F.stddev_pop(b), 4).alias("sp"), r(F.var_samp(b), 2).alias("vs"), r(F.covar_pop(b, k), 4).alias("cp"),
        F.percentile(b, 0.25).alias("q1"), r(F.regr_avgx(b, k), 6).alias("ax"), r(F.regr_avgy(b, k), 4).alias("ay"), r(F.regr_sxx(b, k), 2).alias("sxx"), r(F.regr_sxy(b, k), 0).alias("sxy"),
    )


@query("SELECT o_orderstatus, true AS near_count, true AS near_median FROM orders GROUP BY 1")
def approximate_aggregates(t):
    """Sketches: within five percent of the exact values, which are counted by aggregates of their own.

    In one aggregate with a distinct count, Spark keeps the sketches and the list of all prices for each customer.
    """
    k, same = "o_orderstatus", lambda df: df.withColumnRenamed("o_orderstatus", "_k")
    near = t.orders.groupBy(k).agg(F.approx_count_distinct("o_custkey", 0.01).alias("c"), F.percentile_approx("o_totalprice", 0.5, 10000).alias("m"))
    exact = same(t.orders.groupBy(k, "o_custkey").agg(F.lit(1)).groupBy(k).agg(F.count("o_custkey").alias("exact")))
    out = near.join(F.broadcast(exact), F.col(k).eqNullSafe(F.col("_k"))).drop("_k")
    out = out.join(F.broadcast(same(exact_median(t.orders, k, "o_totalprice"))), F.col(k).eqNullSafe(F.col("_k")), "left")
    return out.select(k, (F.abs(F.col("c") - F.col("exact")) <= F.col("exact") * 0.05).alias("near_count"), (F.abs(F.col("m") - F.col("mid")) <= F.col("mid") * 0.05).alias("near_median"))


def exact_median(df, key: str, value: str, buckets: int = 4096):
    """(key, mid): the median, from the counts of the distinct values in the buckets that hold the middle rows."""
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = seen.groupBy(F.col("_g").alias("_e")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("all"))
    placed = seen.join(F.broadcast(ends), F.col("_g").eqNullSafe(F.col("_e"))).withColumn("b", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)).otherwise(0))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    sums = placed.groupBy(F.col("_g").alias("_h"), F.col("b").alias("_b"), "all").agg(F.sum("n").alias("here"))
    sums = sums.withColumn("upto", F.sum("here").over(Window.partitionBy("_h").orderBy("_b")))
    middle = sums.where((F.col("upto") >= low) & (F.col("upto") - F.col("here") < high)).select("_h", "_b", (F.col("upto") - F.col("here")).alias("before"))
    inner = placed.join(F.broadcast(middle), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("b") == F.col("_b")))
    ranked = inner.withColumn("rank", F.col("before") + F.sum("n").over(Window.partitionBy("_g", "b").orderBy("v")))
    pick = lambda at: F.min(F.when(F.col("rank") >= at, F.col("v")))
    return ranked.groupBy(F.col("_g").alias(key)).agg(((pick(low) + pick(high)) / 2).alias("mid"))


@query("SELECT event_id, ts FROM events")
def timestamp_units(t):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    back = F.expr("timestampadd(MICROSECOND, m, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return t.events.withColumn("m", micros).select("event_id", back.alias("ts"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def window_values(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", F.first_value("o_orderkey").over(w).alias("f"), F.last_value("o_orderkey").over(w.rowsBetween(0, 2)).alias("l"))


@query("SELECT n_name, r_name, n_nationkey + r_regionkey AS k FROM nation CROSS JOIN region")
def cross_join_small(t):
    """A product of two fixed small tables, as SQL allows it."""
    return t.spark.sql("SELECT n_name, r_name, n_nationkey + r_regionkey AS k FROM {n} CROSS JOIN {r}", n=t.nation, r=t.region)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, key, v FROM lineitem, (VALUES ('q'), ('d')) k(key), LATERAL (SELECT CASE WHEN key = 'q' THEN l_quantity ELSE l_discount END AS v)")
def unpivot_rows(t):
    out = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return out.unpivot(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["q", "d"], "key", "v")
