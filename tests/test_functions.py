"""Functions against independent implementations; nulls, ties, Unicode."""

from __future__ import annotations

import hashlib
import unicodedata

import pytest
from basalt.functions import aggregates as A
from basalt.functions import hashing as H
from basalt.functions import nested as N
from basalt.functions import numbers as M
from basalt.functions import positions as P
from basalt.functions import spans as S
from basalt.functions import text as X
from pyspark.sql import Window
from pyspark.sql import functions as F


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def b64(s):
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big") & (2**63 - 1)


def b128(s):
    return hashlib.blake2b(s.encode(), digest_size=16).hexdigest()


def test_hashes(spark):
    null = F.lit(None).cast("string")
    got = one(
        spark, a=H.stable_hash64(F.lit("alpha")), b=H.stable_hash128(F.lit("beta")), c=H.prefixed_hash64("ns", F.lit("gamma")), d=H.stable_id("ns", F.lit("delta")), e=H.stable_id_parts("p", F.lit(1), null),
        f=H.stable_hash64(null), g=H.stable_id("p", null), h=H.stable_hash_any(F.lit(" ﬁ ")), i=H.stable_hash_any(null), j=H.prefixed_hash_parts64("q", F.lit("x"), F.lit(True)), k=H.stable_id(null, F.lit("x")),
    )
    assert got == {
        "a": b64("alpha"), "b": b128("beta"), "c": f"ns:{b64('gamma')}", "d": f"ns:{b128('delta')}", "e": "p:" + b128("1\x1f__NULL__"), "f": None, "g": None, "h": b128("fi"), "i": b128("__NULL__"),
        "j": f"q:{b64('x' + chr(31) + 'true')}", "k": None,
    }


def normal(v, form="NFKC", fold=True, collapse=True):
    v = unicodedata.normalize(form, v.strip())
    v = v.lower() if fold else v
    return (" ".join(v.split()) if collapse else v) or None


@pytest.mark.parametrize("value", ["  Hello \t World\n", "", " \n ", "ÀÉ  ß", "ﬁx　y", "İstanbul", "a\x1cb", "plain"])
def test_utf8_normalize(spark, value):
    assert one(spark, v=X.utf8_normalize(F.lit(value)))["v"] == normal(value)


def test_utf8_normalize_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", X.utf8_normalize(F.col("text")).alias("v")).collect()
    assert all(r.v == normal(r.text) for r in rows)


def test_text_rules(spark):
    got = one(
        spark, a=X.initcap(F.lit("hello wORLD-foo_bar2x")), b=X.chr(F.lit(8364)), c=X.regexp_replace_first(F.lit("aXbX"), "X", "-"), d=X.concat(F.lit("a"), F.lit(None), F.lit("b")),
        e=X.qname_normalize(F.lit(" Foo "), F.lit("Mod")), f=X.qname_normalize(F.lit("a.B"), F.lit("m")), g=X.qname_normalize(F.lit("  "), F.lit("m")), h=X.left(F.lit("abc"), -5), i=X.utf8_null_if_blank(F.lit("  ")),
    )
    assert got == {"a": "Hello World-Foo_Bar2x", "b": "€", "c": "a-bX", "d": "ab", "e": "mod.foo", "f": "a.b", "g": None, "h": "", "i": None}


def test_positions(spark):
    line = F.lit("aé日😀z")
    got = one(
        spark, b=P.col_to_byte(F.lit("abcdef"), F.lit(3), "BYTE"), c=P.col_to_byte(line, F.lit(4)), d=P.col_to_byte(line, F.lit(5), "UTF16"), e=P.col_to_byte(line, F.lit(3), "UTF8"), f=P.col_to_byte(line, F.lit(-2)),
        g=P.canonicalize_byte_span(F.lit(10), F.lit("abcdef"), F.lit(3), F.lit(20), F.lit("ghijkl"), F.lit(2), "BYTE"),
    )
    assert (got["b"], got["c"], got["d"], got["e"], got["f"], tuple(got["g"])) == (3, 10, 10, 3, 0, (13, 22))
    with pytest.raises(ValueError):
        P.unit_offset("😀", 1, "UTF16")


def test_spans(spark):
    s = lambda a, b, **k: S.span_make(F.lit(a), F.lit(b), **k)
    got = one(
        spark, a=S.span_overlaps(s(0, 5), s(5, 9)), b=S.span_overlaps(s(0, 5, end_exclusive=False), s(5, 9)), c=S.span_contains(s(0, 9), s(0, 9)), d=S.span_contains(s(0, 9), s(3, None)),
        e=S.span_len(s(2, 7)), f=S.interval_align_score(*map(F.lit, (0, 5, 10, 20))),
    )
    assert got == {"a": False, "b": True, "c": True, "d": None, "e": 5, "f": -10.0}


def test_nested(spark):
    m = F.create_map(F.lit("B"), F.lit(1), F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))
    a = F.array(*map(F.lit, (5, 1, 5, 5)))
    got = one(
        spark, a=N.map_normalize(m), b=N.array_remove_n(a, F.lit(5), 2), c=N.array_replace(a, F.lit(5), F.lit(0)), d=N.array_position(a, F.lit(9)), e=N.array_slice(a, -2, -1), f=N.range_exclusive(F.lit(1), F.lit(4)),
        g=N.list_unique_sorted(F.array(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b"))), h=N.map_get_default(m, "zz", "d"), i=N.array_resize(a, 2, F.lit(0)), j=N.range_exclusive(F.lit(4), F.lit(4)),
    )
    assert got == {"a": {"a": "2", "b": "3"}, "b": [1, 5], "c": [0, 1, 5, 5], "d": None, "e": [5, 5], "f": [1, 2, 3], "g": ["a", "b"], "h": "d", "i": [5, 1], "j": []}


def test_numbers(spark):
    got = one(spark, a=M.gcd(F.lit(-12), F.lit(18)), b=M.lcm(F.lit(4), F.lit(6)), c=M.lcm(F.lit(0), F.lit(0)), d=M.trunc(F.lit(-1.57), 1), e=M.int_div(F.lit(-7), F.lit(2)), f=M.day_of_week(F.lit("2024-01-07").cast("date")))
    assert got == {"a": 6, "b": 12, "c": 0, "d": -1.5, "e": -3, "f": 0}


def test_best_aggregates_skip_nulls_and_break_ties(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2), ("x", 3), (None, 9), ("z", None), ("m", 1)], "v string, k long")
    r = df.agg(A.asof_select(F.col("v"), F.col("k")).alias("a"), A.arg_min(F.col("v"), F.col("k")).alias("b"), A.arg_max(F.lit(None).cast("string"), F.col("k")).alias("c")).first()
    assert tuple(r) == ("b", "a", None)


def test_set_aggregates_and_nulls(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "v string")
    v = F.col("v")
    r = df.agg(A.list_unique(v).alias("a"), A.list_unique(v, False).alias("b"), A.count_distinct_agg(v, False).alias("c"), A.array_agg(v).alias("d"), A.string_agg(v, v).alias("e")).first()
    assert (r.a, r.b, r.c, len(r.d), r.e) == (["a", "b"], ["a", "b", None], 3, 4, "a,b,b")
    empty = df.where("false").agg(A.count_distinct_agg(v, False).alias("c"), A.string_agg(v, v).alias("e"), A.count_if(v == "a").alias("n")).first()
    assert tuple(empty) == (0, None, 0)


def test_sliding_count(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("abbb")], "i long, v string")
    w = Window.orderBy("i").rowsBetween(-1, 0)
    assert [r[0] for r in df.select(A.sliding_count_distinct(F.col("v"), w)).collect()] == [1, 2, 1, 1]


@pytest.mark.parametrize(
    ("text", "pattern", "new", "want"),
    [
        ("xab", "a(?=b)", "-", "x-b"), ("a.b a", r"\ba\b", "-", "-.b a"), ("xyx", "^x", "-", "-yx"), ("yx", "^x", "-", "yx"), ("aab", "(?<=a)a", "-", "a-b"), ("abab", "(a)(b)", "$2$1", "baab"), ("xaab", r"(a)\1", "<$1>", "x<a>b"),
        ("a\nb.c", ".b", "-", "a\nb.c"), ("a\nxbc", ".b", "-", "a\n-c"), ("cost 5", r"\d", r"\$1", "cost $1"), ("AbA", "(?i)a", "-", "-bA"), ("", "a*", "-", "-"), ("zz", "a", "-", "zz"),
    ],
)
def test_regexp_replace_first(spark, text, pattern, new, want):
    """The match sees what is around it; groups keep their numbers."""
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(X.regexp_replace_first(F.col("v"), pattern, new)).first()[0] == want


def best(spark, rows, schema, kind="number"):
    df = spark.createDataFrame(rows, schema)
    return df.agg(A.arg_max(F.col("v"), F.col("k"), kind).alias("a")).first().a


def test_arg_max_of_any_key(spark):
    import datetime as dt

    assert best(spark, [("a", 1e-8), ("b", 9e-8)], "v string, k double") == "b"
    assert best(spark, [("a", 1e40), ("b", -1e40), ("c", 1e40), (None, 1e50), ("d", None)], "v string, k double") == "a"
    assert best(spark, [("a", 1.0), ("b", float("nan")), ("c", float("inf"))], "v string, k double") == "b"
    assert best(spark, [("a", -(1 << 63)), ("b", (1 << 63) - 1)], "v string, k long", "integer") == "b"
    assert best(spark, [("a", -(1 << 63)), ("b", -(1 << 63))], "v string, k long", "integer") == "a"
    assert best(spark, [("a", "x"), ("b", "xé"), ("c", "x\x00"), ("d", "")], "v string, k string", "text") == "b"
    assert best(spark, [("a", dt.date(1960, 1, 1)), ("b", dt.date(2020, 1, 1))], "v string, k date", "date") == "b"
    assert best(spark, [("a", dt.datetime(2020, 1, 1, 0, 0, 0, 1)), ("b", dt.datetime(2020, 1, 1))], "v string, k timestamp", "timestamp") == "a"
    assert best(spark, [(1, False), (2, True), (3, True)], "v int, k boolean", "boolean") == 2
    with pytest.raises(ValueError):
        A.descending(F.col("k"), "colour")


def test_list_unique_keeps_the_type_of_its_elements(spark):
    for schema, values in (("v int", [3, None, 1, 3]), ("v date", [None]), ("v struct<a:int>", [((1,)), None])):
        df = spark.createDataFrame([(v,) for v in values], schema)
        out = df.agg(A.list_unique(F.col("v"), ignore_nulls=False).alias("l"))
        assert out.schema["l"].dataType.elementType == df.schema["v"].dataType
        assert out.first().l[-1] is None and len(out.first().l) == len({str(v) for v in values})


def test_best_by_a_time_that_the_zone_skips(spark):
    """New York's clocks go from 2:00 to 3:00 on that day: 2:30 is still before 3:10; of equal times the smallest value."""
    rows = [(1, "2024-03-10 02:30:00"), (3, "2024-03-10 03:10:00.000001"), (2, "2024-03-10 03:10:00.000001"), (9, None)]
    df = spark.createDataFrame(rows, "k long, ts string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ts = F.col("ts").cast("timestamp_ntz")
        found = df.agg(A.arg_max(F.col("k"), ts, "local_timestamp").alias("best")).first().best
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == 2


def test_best_by_any_key_in_a_zone_that_skips_an_hour(spark, tmp_path):
    from basalt import queries as Q

    rows = [(1, "2024-03-10 02:30:00", 7, "view", 1.0), (2, "2024-03-10 03:10:00", 7, "click", 2.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert Q.queries()["best_by_any_key"](spark, str(tmp_path)).first().by_time == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_exact_median_and_its_plan(spark, sf):
    from basalt import queries as Q
    from basalt.queries.families import exact_median

    rows = [("a", float(v)) for v in (5, 1, 1, 9, 2, 100)] + [("b", 3.0), ("b", None), (None, 4.0), (None, 8.0)] + [("c", 7.0)] * 4 + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect() if r.m is not None}
    for buckets in (1, 3, 4096):
        assert {r.k: r.mid for r in exact_median(df, "k", "v", buckets).collect()} == want
    plan = Q.queries()["approximate_aggregates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan and "distinct o_custkey" not in plan
