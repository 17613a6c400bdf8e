"""The general SQL and DataFrame surface: sets, groupings, windows, subqueries, function families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import date_bin, day_of_week
from .registry import money, query


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(t):
    pick = lambda s: t.orders.where(F.col("o_orderstatus") == s).select("o_custkey")
    return pick("F").intersect(pick("O"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_except_all(t):
    pick = lambda s: t.orders.where(F.col("o_orderstatus") == s).select("o_custkey")
    return pick("F").exceptAll(pick("O"))


_GROUPED = """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS total, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level
FROM orders GROUP BY {}
"""


def _grouped(g):
    return g.agg(F.count("*").alias("n"), money("o_totalprice").alias("total"), F.grouping_id().cast("long").alias("level"))


@query(_GROUPED.format("CUBE (o_orderstatus, o_orderpriority)"))
def cube(t):
    return _grouped(t.orders.cube("o_orderstatus", "o_orderpriority"))


@query(_GROUPED.format("ROLLUP (o_orderstatus, o_orderpriority)"))
def rollup(t):
    return _grouped(t.orders.rollup("o_orderstatus", "o_orderpriority"))


@query(_GROUPED.format("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
def grouping_sets(t):
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return _grouped(t.orders.groupingSets(sets, "o_orderstatus", "o_orderpriority"))


@query("""
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER s AS rk, dense_rank() OVER s AS dr, percent_rank() OVER s AS pr, cume_dist() OVER s AS cd, ntile(4) OVER w AS nt,
       lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, 0.0) OVER w AS after, nth_value(o_orderkey, 2) OVER w AS second
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), s AS (PARTITION BY o_custkey ORDER BY o_orderstatus)
""")
def window_rank_family(t):
    w, s = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return t.orders.select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(s).alias("rk"), F.dense_rank().over(s).alias("dr"), F.percent_rank().over(s).alias("pr"), F.cume_dist().over(s).alias("cd"),
        F.ntile(4).over(w).alias("nt"), F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2, 0.0).over(w).alias("after"), F.nth_value("o_orderkey", 2).over(w).alias("second"),
    )


@query("""
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n,
       max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high,
       count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS near
FROM orders
""")
def window_frames(t):
    rows = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 1)
    upto = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("o_orderstatus").orderBy("o_custkey").rangeBetween(-10, 0)
    return t.orders.select("o_orderkey", F.count("*").over(rows).alias("n"), F.max("o_totalprice").over(upto).alias("high"), F.count("*").over(near).alias("near"))


_RECURSIVE = "WITH RECURSIVE r(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM r WHERE n < 30) SELECT n, total FROM r"


@query(_RECURSIVE)
def recursive_cte(t):
    return t.spark.sql(_RECURSIVE)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def exists_subquery(t):
    return t.customer.join(t.orders.where("o_totalprice > 250000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def in_subquery(t):
    return t.spark.sql("SELECT p_partkey FROM {p} WHERE p_partkey IN (SELECT l_partkey FROM {l} WHERE l_quantity > 49)", p=t.part, l=t.lineitem)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.5 * (SELECT median(o_totalprice) FROM orders)")
def scalar_subquery(t):
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM {o} WHERE o_totalprice > 1.5D * (SELECT median(o_totalprice) FROM {o})", o=t.orders)


@query("""
SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, year(o_orderdate) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofweek(o_orderdate) AS INTEGER) AS dow, dayofyear(o_orderdate) AS doy,
       make_date(year(o_orderdate), 1, 1) AS newyear, epoch_us(o_orderdate) // 1000000 AS unix
FROM orders
""")
def date_family(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.expr("cast(trunc(o_orderdate, 'MM') as timestamp_ntz)").alias("month"), F.year(d).alias("y"), F.quarter(d).alias("q"), day_of_week(d).alias("dow"), F.dayofyear(d).alias("doy"),
        F.make_date(F.year(d), F.lit(1), F.lit(1)).alias("newyear"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").alias("unix"),
    )


@query("SELECT event_id, (epoch_us(ts) // 900000000) * 900 AS bin FROM events")
def date_bin_query(t):
    from .registry import seconds

    binned = date_bin(900, F.timestamp_seconds(seconds("ts")))
    return t.events.select("event_id", F.unix_seconds(binned).alias("bin"))


@query(r"""
SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, reverse(p_name) AS rev, lpad(p_brand, 12, '.') AS lp, rpad(p_brand, 12, '.') AS rp, replace(p_name, ' ', '_') AS rep, split_part(p_name, ' ', 2) AS second,
       strpos(p_name, 'w') AS at, translate(p_name, 'abc', 'xyz') AS tr, repeat(p_type, 2) AS twice, md5(p_name) AS m5, sha256(p_name) AS s256, levenshtein(p_name, p_type) AS lev, starts_with(p_name, 'c') AS c,
       regexp_matches(p_name, '^[a-m]') AS early, ascii(p_name) AS code, concat_ws('-', p_brand, p_type) AS ws, substr(p_name, 2, 3) AS sub, bit_length(p_name) AS bits, strlen(p_name) AS bytes, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels
FROM part
""")
def string_family(t):
    n, b = F.col("p_name"), F.col("p_brand")
    return t.part.select(
        "p_partkey", F.upper(n).alias("up"), F.length(n).cast("long").alias("len"), F.reverse(n).alias("rev"), F.lpad(b, 12, ".").alias("lp"), F.rpad(b, 12, ".").alias("rp"), F.replace(n, F.lit(" "), F.lit("_")).alias("rep"),
        F.split_part(n, F.lit(" "), F.lit(2)).alias("second"), F.instr(n, "w").cast("long").alias("at"), F.translate(n, "abc", "xyz").alias("tr"), F.repeat("p_type", 2).alias("twice"), F.md5(n).alias("m5"), F.sha2(n, 256).alias("s256"),
        F.levenshtein(n, "p_type").cast("long").alias("lev"), n.startswith("c").alias("c"), n.rlike("^[a-m]").alias("early"), F.ascii(n).alias("code"), F.concat_ws("-", b, "p_type").alias("ws"), F.substring(n, 2, 3).alias("sub"),
        F.bit_length(n).cast("long").alias("bits"), F.octet_length(n).cast("long").alias("bytes"), F.regexp_count(n, F.lit("[aeiou]")).cast("long").alias("vowels"),
    )


@query("""
SELECT s_suppkey, abs(s_acctbal) AS a, sign(s_acctbal) AS sg, round(sqrt(abs(s_acctbal)), 6) AS sq, round(ln(1 + abs(s_acctbal)), 6) AS l, round(log10(1 + abs(s_acctbal)), 6) AS l10, round(exp(s_suppkey / 1000.0), 6) AS e,
       round(sin(s_suppkey), 6) AS sn, round(cos(s_suppkey), 6) AS cs, round(tan(s_suppkey), 4) AS tn, round(atan2(s_suppkey, 3), 6) AS a2, round(degrees(s_suppkey), 6) AS dg, round(radians(s_suppkey), 6) AS rd, power(s_suppkey, 2.0) AS p,
       round(cbrt(s_suppkey), 6) AS cb, factorial(CAST(s_suppkey % 10 AS INTEGER))::BIGINT AS f, isnan(s_acctbal) AS nn, round(tanh(s_suppkey), 6) AS th, round(asinh(s_suppkey), 6) AS ash
FROM supplier
""")
def math_family(t):
    b, k = F.col("s_acctbal"), F.col("s_suppkey")
    r = lambda c, n=6: F.round(c, n)
    return t.supplier.select(
        "s_suppkey", F.abs(b).alias("a"), F.signum(b).cast("int").alias("sg"), r(F.sqrt(F.abs(b))).alias("sq"), r(F.ln(1 + F.abs(b))).alias("l"), r(F.log10(1 + F.abs(b))).alias("l10"), r(F.exp(k / 1000.0)).alias("e"),
        r(F.sin(k)).alias("sn"), r(F.cos(k)).alias("cs"), r(F.tan(k), 4).alias("tn"), r(F.atan2(k.cast("double"), F.lit(3.0))).alias("a2"), r(F.degrees(k)).alias("dg"), r(F.radians(k)).alias("rd"), F.pow(k, F.lit(2.0)).alias("p"),
        r(F.cbrt(k)).alias("cb"), F.factorial((k % 10).cast("int")).alias("f"), F.isnan(b).alias("nn"), r(F.tanh(k)).alias("th"), r(F.asinh(k)).alias("ash"),
    )


@query("""
SELECT o_custkey, list_sort(list(o_orderkey)) AS keys, len(list(o_orderkey)) AS n, list_contains(list(o_orderstatus), 'F') AS has_f, list_sort(list_intersect(list(DISTINCT o_orderstatus), ['F', 'P'])) AS both,
       array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS joined
FROM orders GROUP BY o_custkey
""")
def array_family(t):
    keys, states = F.array_sort(F.collect_list("o_orderkey")), F.array_sort(F.collect_set("o_orderstatus"))
    return t.orders.groupBy("o_custkey").agg(
        keys.alias("keys"), F.size(keys).cast("long").alias("n"), F.array_contains(states, "F").alias("has_f"),
        F.array_sort(F.array_intersect(states, F.array(F.lit("F"), F.lit("P")))).alias("both"), F.array_join(states, ",").alias("joined"),
    )


@query("""
SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 0) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
       round(corr(l_extendedprice, l_quantity), 6) AS c, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(covar_samp(l_quantity, l_discount), 6) AS cv, median(l_quantity) AS med
FROM lineitem GROUP BY l_returnflag
""")
def regr_family(t):
    y, x = "l_extendedprice", "l_quantity"
    r = lambda c, n=6: F.round(c, n)
    return t.lineitem.groupBy("l_returnflag").agg(
        F.regr_count(y, x).alias("n"), r(F.regr_slope(y, x), 2).alias("slope"), r(F.regr_intercept(y, x), 0).alias("intercept"), r(F.regr_r2(y, x)).alias("r2"), r(F.corr(y, x)).alias("c"),
        r(F.stddev_samp(x)).alias("sd"), r(F.var_pop(x)).alias("vp"), r(F.covar_samp(x, "l_discount")).alias("cv"), F.median(x).alias("med"),
    )


@query("""
SELECT l_linestatus, bit_and(l_linenumber) AS ba, bit_or(l_linenumber) AS bo, bit_xor(l_linenumber) AS bx, bool_and(l_quantity > 0) AS every, bool_or(l_quantity > 49) AS any_big, CAST(sum(l_linenumber) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS flagged,
       count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_linestatus
""")
def aggregate_family(t):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    return t.lineitem.groupBy("l_linestatus").agg(
        F.bit_and(n).alias("ba"), F.bit_or(n).alias("bo"), F.bit_xor(n).alias("bx"), F.bool_and(q > 0).alias("every"), F.bool_or(q > 49).alias("any_big"),
        F.sum(F.when(F.col("l_returnflag") == "A", n)).alias("flagged"), F.count_distinct("l_suppkey").alias("suppliers"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def top_k_offset(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10)


@query("SELECT v.k, v.name FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(k, name)")
def values_rows(t):
    return t.spark.sql("SELECT k, name FROM VALUES (1, 'a'), (2, 'b'), (3, CAST(NULL AS STRING)) AS v(k, name)")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'low' ELSE 'high' END AS class, coalesce(nullif(c_mktsegment, 'FURNITURE'), 'none') AS segment, c_mktsegment ILIKE '%o%' AS has_o FROM customer")
def conditional_family(t):
    b, s = F.col("c_acctbal"), F.col("c_mktsegment")
    kind = F.when(b < 0, "debt").when(b.between(0, 1000), "low").otherwise("high")
    return t.customer.select("c_custkey", kind.alias("class"), F.coalesce(F.nullif(s, F.lit("FURNITURE")), F.lit("none")).alias("segment"), s.ilike("%o%").alias("has_o"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DOUBLE) AS sum_base, count(*) AS n, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def pricing_summary(t):
    rows = t.lineitem.where("l_shipdate <= TIMESTAMP_NTZ'2000-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), money("l_extendedprice").alias("sum_base"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query("""
SELECT n_name, CAST(sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY n_name
""")
def nation_revenue(t):
    rows = (
        t.lineitem.join(t.orders.where("o_orderdate >= TIMESTAMP_NTZ'1997-01-01 00:00:00'"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.groupBy("n_name").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue"))


@query("SELECT c_mktsegment, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def pivot_counts(t):
    out = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return out.fillna(0, ["F", "O", "P"])
