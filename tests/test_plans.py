"""Specs, guards, inference, relationships, streams."""

from __future__ import annotations

import pytest
from basalt.plans import guard as G
from basalt.plans import spec as S
from basalt.semantic import exprs as E
from basalt.semantic import inference as J
from basalt.semantic import relationships as R
from basalt.semantic import scopes as C
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frame(spark, *data):
    return spark.createDataFrame(list(data), "id long, bstart long, bend long")


def test_containment_join(spark):
    left, right = frame(spark, (1, 0, 20), (2, 10, 30)), frame(spark, (10, 5, 15), (20, 15, 25))
    view = S.View("v", S.Relate("l", "r", "inner", (("bstart", "bstart"), ("bend", "bend"))))
    out = S.compose(S.Spec(("l", "r"), (view,)), {"l": left, "r": right})["v"]
    assert sorted((r.id, r.id__r) for r in out.collect()) == [(1, 10), (2, 20)]


@pytest.mark.parametrize(
    "spec",
    [
        S.Spec(("a",), (S.View("a", S.Project("a", ("id",))),)),
        S.Spec(("a",), (S.View("v", S.Project("zz", ("id",))),)),
        S.Spec((), (S.View("v", S.Project("w", ("id",))), S.View("w", S.Project("v", ("id",))))),
        S.Spec(("a",), (S.View("v", S.Relate("a", "a")),)),
        S.Spec(("a",), (S.View("v", S.Aggregate("a", (), (S.Aggregation("id", "median", "m"),))),)),
        S.Spec(("a",), (S.View("v", S.CpgEmit("nodes", ())),)),
        S.Spec(("a",), (S.View("v", S.Project("a", ("id",)), ("id", "missing")),)),
        S.Spec(("b",), ()),
        S.Spec(("a",), (), (S.Output("o", "nothing"),)),
    ],
)
def test_broken_specs(spark, spec):
    with pytest.raises(S.SpecError):
        S.compose(spec, {"a": frame(spark, (1, 0, 1))})


def test_params():
    with pytest.raises(S.SpecError):
        S.positional((S.Param("int64", 1, 1), S.Param("int64", 2, 3)))
    with pytest.raises(S.SpecError):
        S.positional((S.Param("int64", 1, 1), S.Param("int64", 2, 1)))
    assert S.positional((S.Param("utf8", "b", 2), S.Param("null", "x", 1))) == [None, "b"]


@pytest.mark.parametrize(("kind", "value"), [("int64", "abc"), ("int64", True), ("int64", 1 << 63), ("utf8", 1), ("float64", "1"), ("boolean", 1), ("date", "2020-13-01"), ("timestamp", 5), ("other", 1)])
def test_params_of_another_type(kind, value):
    with pytest.raises(S.SpecError):
        S.positional((S.Param(kind, value, 1),))


def test_param_values():
    import datetime as dt

    found = S.positional((S.Param("date", "2020-02-01", 1), S.Param("timestamp", "2020-02-01T03:04:05", 2), S.Param("float64", 2, 3), S.Param("utf8", None, 4)))
    assert found == [dt.date(2020, 2, 1), dt.datetime(2020, 2, 1, 3, 4, 5), 2.0, None]


def test_spec_round_trip_and_fingerprint(spark, tmp_path):
    spec = S.Spec(("a",), (S.View("v", S.Filter("a", "id > 1")),), (S.Output("out", "v", ("id",), "append"),))
    data = {"a": frame(spark, (1, 0, 1), (2, 0, 1), (3, 0, 1))}
    for n in (2, 4):
        path = S.write_outputs(spec, data, str(tmp_path))["out"]
        assert spark.read.parquet(path).count() == n
    other = S.Spec(("a",), (S.View("v", S.Filter("a", "id > 2")),), spec.outputs)
    assert spec.fingerprint() == S.Spec(spec.inputs, spec.views, spec.outputs).fingerprint() != other.fingerprint()


def test_cache_choice():
    join = S.View("j", S.Relate("a", "b", "inner", (("x", "y"),)))
    views = (join, S.View("p", S.Project("j", ("x",))), S.View("q", S.Project("j", ("x",))), S.View("r", S.Project("p", ("x",))), S.View("s", S.Project("p", ("x",))))
    assert S.cache_choice(S.Spec(("a", "b"), views)) == {"j": True, "p": False, "q": False, "r": False, "s": False}


@pytest.mark.parametrize(("sql", "kind"), [("SELECT 1", "query"), ("WITH a AS (SELECT 1) SELECT * FROM a", "query"), ("CREATE TABLE t (a INT)", "ddl"), ("DROP TABLE t", "ddl"), ("INSERT INTO t VALUES (1)", "dml"), ("DELETE FROM t", "dml")])
def test_guard(spark, sql, kind):
    assert G.statement_kind(spark, sql) == kind
    if kind != "query":
        with pytest.raises(G.PolicyError):
            G.safe_sql(spark, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "EXECUTE IMMEDIATE 'CREATE TEMPORARY VIEW sneaked AS SELECT 1'", "BEGIN CREATE TEMPORARY VIEW sneaked AS SELECT 1; END", "CALL sys.run()", "SET x = 1", "EXPLAIN SELECT 1", "SHOW TABLES", "DESCRIBE t",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "FROM t INSERT INTO u SELECT *", "SELECT 1; DROP TABLE t", "/* SELECT */ DROP TABLE t", "-- SELECT\nDROP TABLE t", "SELECT 1) -- ", "ADD JAR 'x.jar'",
    ],
)
def test_guard_takes_nothing_but_queries(spark, sql):
    with pytest.raises(G.PolicyError):
        G.safe_sql(spark, sql).collect()
    assert not spark.catalog.tableExists("sneaked")


@pytest.mark.parametrize("sql", ["SELECT 1 AS a;", "-- first\nSELECT 1 AS a -- last", "(SELECT 1 AS a) UNION ALL SELECT 2", "VALUES (1)", "/* a */ WITH b AS (SELECT 1 AS a) SELECT * FROM b ORDER BY a"])
def test_guard_takes_queries_of_any_form(spark, sql):
    assert G.safe_sql(spark, sql).count() >= 1


def test_guard_runs_what_is_allowed(spark):
    G.safe_sql(spark, "CREATE OR REPLACE TEMPORARY VIEW allowed_here AS SELECT 1 AS a", frozenset({"ddl"}))
    assert spark.table("allowed_here").count() == 1


def test_wide_plans(spark):
    """What stands beyond the columns that Spark prints counts too; words in literals do not."""
    wide = [F.lit(i).alias(f"c{i}") for i in range(60)]
    with pytest.raises(G.PolicyError):
        G.require_deterministic(spark.range(1).select(*wide, F.rand().alias("r")))
    G.require_deterministic(spark.range(1).select(F.lit("rand(").alias("x"), F.lit("now()").alias("y")), strict=True)
    one, two = spark.range(1).select(*wide), spark.range(1).select(*wide[:59], F.lit(-1).alias("c59"))
    assert G.plan_fingerprint(one) != G.plan_fingerprint(two) and G.plan_fingerprint(one) == G.plan_fingerprint(spark.range(1).select(*wide))


def test_guard_runs_queries(spark):
    assert G.safe_sql(spark, "SELECT * FROM {t} WHERE id > :low", args={"low": 3}, t=spark.range(6)).count() == 2
    with pytest.raises(G.PolicyError):
        G.safe_sql(spark, "SELEC 1")


def test_determinism(spark):
    with pytest.raises(G.PolicyError):
        G.require_deterministic(spark.range(1).select(F.rand()))
    now = spark.range(1).select(F.current_timestamp())
    G.require_deterministic(now)
    with pytest.raises(G.PolicyError):
        G.require_deterministic(now, strict=True)


def test_pushdown_and_fingerprint(spark, sf):
    rows = lambda: spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey = 5").select("o_orderkey")
    assert any("EqualTo(o_custkey,5)" in p for p in G.pushed_filters(rows()))
    assert G.plan_fingerprint(rows()) == G.plan_fingerprint(rows())


def test_macros(spark):
    G.register_macro(spark, "twice", "x INT", "INT", "x * 2")
    G.register_macro(spark, "upto", "n BIGINT", "TABLE (k BIGINT)", "SELECT explode(sequence(1L, n))")
    assert spark.sql("SELECT twice(4) + (SELECT count(*) FROM upto(3))").first()[0] == 11


def schema(text):
    return T._parse_datatype_string(text)


@pytest.mark.parametrize(
    ("left", "right", "kind"),
    [
        ("file_id string, bstart long, bend long", "file_id string, bstart long, bend long", "span_overlap"),
        ("def_id string, name string", "entity_id string, path string", "foreign_key"),
        ("symbol string, file_id string", "symbol string, definition string", "symbol_match"),
        ("file_id string, x int", "file_id string, y int", "equi_join"),
        ("name string", "value int", None),
    ],
)
def test_inference(spark, left, right, kind):
    found = J.infer_join(schema(left), schema(right))
    assert (found.kind if found else None) == kind
    if kind is None:
        with pytest.raises(J.JoinInferenceError):
            J.require_join(schema(left), schema(right))


def test_inference_by_hint(spark):
    a = schema("file_id string, bstart long, bend long")
    assert J.infer_join(a, a, "span_contains").kind == "span_contains"
    assert J.infer_join(a, a, "symbol_match") is None


def test_grouped_relationship_equals_direct(spark):
    left = spark.createDataFrame([("file_a", "left_1", "def_1"), ("file_a", "left_2", "def_2"), ("file_b", "left_3", "def_3")], "file_id string, entity_id string, owner_def_id string")
    right = spark.createDataFrame([("file_a", "def_1"), ("file_a", "def_2"), ("file_b", "def_3")], "file_id string, entity_id string")
    spec = R.Relationship("r", ("file_id",), ("file_id",), hard=(E.eq("l__owner_def_id", "r__entity_id"),), rank=R.Rank(E.c("l__entity_id"), (E.sort_expr("score", "desc"),)), select=(("a", E.c("l__entity_id")), ("b", E.c("r__entity_id"))))
    out = R.compile_relationship(R.join_group(left, right, spec), spec)
    assert sorted((r.a, r.b) for r in out.collect()) == [("left_1", "def_1"), ("left_2", "def_2"), ("left_3", "def_3")]


def test_normalize(spark):
    df = spark.createDataFrame([("p", 1, 4, 2, 5), ("p", None, 4, 2, 5)], "path string, s long, byte_len long, ds long, de long")
    out = R.normalize(df, "ref", "s", "byte_len", foreign={"def_id": ("def", "ds", "de")}).orderBy(F.col("s").desc()).collect()
    assert (out[0].bstart, out[0].bend, out[0].span.bend) == (1, 5, 5)
    assert out[0].entity_id.startswith("ref:") and out[0].def_id.startswith("def:") and out[1].entity_id is None


def test_exprs(spark):
    df = spark.createDataFrame([(1, None, "TRUE"), (5, 2, "no")], "a int, b int, c string")
    show = lambda e: [r[0] for r in df.select(e()).collect()]
    assert show(E.clamp("b", 0, 1)) == [None, 1]
    assert show(E.truthy("c")) == [True, False]
    assert show(E.or_(E.gt("a", E.v(4)), E.is_null("b"))) == [True, True]
    assert show(E.and_()) == [True, True] and show(E.case_eq("a", "b")) == [0, 0]
    assert show(E.add_columns("a", E.coalesce_default("b", 0))) == [1, 7]
    assert E.missing_columns(E.eq("a", "zz"), df) == {"zz"}
    assert df.where(E.in_set(F.col("a"), [])).count() == 0
    spec = E.QuerySpec(("a",), (("d", E.mul("a", 2)),), E.gt("d", E.v(5)))
    assert [tuple(r) for r in spec.apply(df).collect()] == [(5, 10)]


def test_binding_resolutions(spark):
    scopes = spark.createDataFrame([("m", "MODULE", "p"), ("f", "FUNCTION", "p"), ("g", "FUNCTION", "p")], "scope_id string, scope_type string, path string")
    edges = spark.createDataFrame([("f", "m"), ("g", "f")], "child_id string, parent_id string")
    flags = ("nonlocal", "global", "free", "param", "import", "namespace", "annot_only", "assigned")
    row = lambda b, s, n, *on: (b, s, n, *[f in on for f in flags])
    symbols = spark.createDataFrame([row("b1", "m", "x", "assigned"), row("b2", "f", "x", "assigned"), row("b3", "g", "x", "nonlocal"), row("b4", "g", "y", "global"), row("b5", "m", "y", "assigned")], "binding_id string, scope_id string, name string, " + ", ".join(f"is_{f} boolean" for f in flags))
    out = C.binding_resolutions(C.bindings(symbols, scopes), edges)
    assert sorted((r.binding_id, r.target_id, r.reason) for r in out.collect()) == [("b3", "b2", "nonlocal"), ("b4", "b5", "global")]
