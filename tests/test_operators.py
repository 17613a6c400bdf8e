"""Kernels, joins, contracts, change feeds and tables on small inputs with known results."""

from __future__ import annotations

import random

import pytest
from basalt.operators import contracts as C
from basalt.operators import incremental as M
from basalt.operators import intervals as I
from basalt.operators import kernels as K
from basalt.operators import unions as U
from basalt.operators.closure import ancestor_closure
from basalt.sources import files as FS
from basalt.sources.tables import ConstraintError, Cursor, VersionedTable
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_interval_align(spark):
    left = spark.createDataFrame([("a.py", 10, 20, 1), ("b.py", 20, 30, 2)], "path string, bstart long, bend long, left_value long")
    right = spark.createDataFrame([("a.py", 0, 25, 7), ("a.py", 8, 50, 3)], "path string, bstart long, bend long, score long")
    out = I.interval_align(left, right, I.AlignSpec(how="left"))
    assert out.columns == ["path", "bstart", "bend", "left_value", "path__r", "bstart__r", "bend__r", "score", "match_kind", "match_score"]
    assert rows(out) == [("a.py", 10, 20, 1, "a.py", 0, 25, 7, "CONTAINED_BEST", 10.0), ("b.py", 20, 30, 2, None, None, None, None, "NO_MATCH", None)]


def test_interval_align_keeps_equal_left_rows(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 1, 5)], "path string, bstart long, bend long")
    assert I.interval_align(left, left, I.AlignSpec("EXACT")).count() == 2


@pytest.mark.parametrize("condition", ["contains", "overlaps"])
@pytest.mark.parametrize("most_bins", [4, 64])
def test_range_join_against_all_pairs(spark, condition, most_bins):
    rng = random.Random(7)
    make = lambda n, longest: [(i, (s := rng.randint(-500, 500)), s + rng.choice([0, 1, 5, 30, longest])) for i in range(n)]
    a, b = make(60, 900), make(80, 400)
    left, right = spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, s long, e long")
    got = I.range_join(left, right, ("s", "e"), ("s", "e"), condition, width=7, most_bins=most_bins).select("i", "j")
    fits = (lambda x, y: x[1] <= y[1] and y[2] <= x[2]) if condition == "contains" else (lambda x, y: y[1] < x[2] and x[1] < y[2])
    assert rows(got) == sorted(((x[0], y[0]) for x in a for y in b if fits(x, y)), key=repr)


def test_asof_join_ties_and_gaps(spark):
    left = spark.createDataFrame([("u", 5), ("u", 1), ("v", 5)], "k string, at long")
    right = spark.createDataFrame([("u", 2, "x"), ("u", 5, "y")], "k string, at long, w string")
    assert rows(I.asof_join(left, right, "at", ["k"], ["w"])) == [("u", 1, None), ("u", 5, "y"), ("v", 5, None)]


def test_winner_is_the_same_for_any_order(spark):
    data = [("g1", 1.0, "b", 20), ("g1", 1.0, "a", 10), ("g2", 2.0, "c", 5), ("g2", 2.0, "a", 1)]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "g string, score double, path string, bstart long").repartition(seed + 1)
        assert [r[2] for r in rows(K.winner_select(df, ("g",), tie_breakers=(K.SortKey("path"), K.SortKey("bstart"))))] == ["a", "a"]


def test_explode_list(spark):
    df = spark.createDataFrame([("p1", [1, 2]), ("p2", None), ("p3", [3])], "parent_id string, children array<long>")
    assert [tuple(r) for r in K.explode_list(df, ("parent_id",), "children").select("parent_id", "value", "idx").collect()] == [("p1", 1, 0), ("p1", 2, 1), ("p2", None, None), ("p3", 3, 0)]


def test_dedupe_rules(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (2, 1, "c")], "k int, s int, v string")
    with pytest.raises(ValueError):
        K.dedupe(df, K.DedupeSpec(("k",)))
    assert rows(K.semantic_dedupe(df, ["k"], "s")) == [(1, None, "a"), (2, 1, "c")]  # a null score wins
    assert rows(K.winner_select(df, ("k",), "s")) == [(1, 5, "b"), (2, 1, "c")]
    lists = K.dedupe(df, K.DedupeSpec(("k",), (), K.Keep.COLLAPSE_LIST)).where("k = 1").first()
    assert sorted(lists.s, key=repr) == [5, None] and sorted(lists.v) == ["a", "b"]


def test_unnest_columns(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a"]), (2, None, None)], "k int, x array<int>, y array<string>")
    assert rows(K.unnest_columns(df, ["x", "y"])) == [(1, 1, "a"), (1, 2, None), (2, None, None)]


def test_unions(spark):
    a = spark.createDataFrame([(1, "alice")], "id long, name string")
    b = spark.createDataFrame([(5, "eve", "extra")], "id long, name string, extra string")
    assert U.union_by_name({"a": a, "b": b}).columns == ["extra", "id", "name"]
    with pytest.raises(ValueError):
        U.union_with_discriminator({"a": a, "b": b})
    with pytest.raises(ValueError):
        U.union_by_name({})
    nodes = U.union_nodes({"f": spark.createDataFrame([("x", "p")], "entity_id string, path string")})
    assert rows(nodes) == [("x", "p", None, None, "f")]


def test_contract(spark):
    schema = T.StructType().add("k", "long").add("v", "double").add("new", "string")
    df = spark.createDataFrame([("1", "2.5", 0), ("2", "bad", 0), (None, "9", 0)], "k string, v string, extra int")
    contract = C.Contract(schema, ("k",), ("k", "v"), (C.Invariant("BIG", "v > 5"),))
    out = C.finalize(df, contract)
    assert out.alignment == {"missing": ["new"], "dropped": ["extra"], "casted": ["k", "v"]}
    assert rows(out.good) == [(1, 2.5, None)]
    assert rows(out.stats) == [("BIG", 1), ("REQUIRED_NON_NULL", 2)]
    with pytest.raises(C.ContractError):
        C.finalize(df, C.Contract(schema, required_non_null=("k",), strict=True))


def test_merges(spark):
    base = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (None, "n", "q")], "id long, v string, part string")
    new = spark.createDataFrame([(2, "B", "q", "update_postimage"), (3, "c", "r", "insert"), (None, "N", "q", "insert")], "id long, v string, part string, _change_type string")
    values = lambda s, **k: sorted(r.v for r in M.apply_merge(base, new, s, **k).collect())
    assert values("append") == ["B", "N", "a", "b", "c", "n"]
    assert values("upsert", keys=["id"]) == ["B", "N", "a", "c", "n"]  # null keys match nothing
    assert values("replace", partition_column="part") == ["B", "N", "a", "c"]
    for bad in ({"strategy": "upsert"}, {"strategy": "replace"}, {"strategy": "other"}):
        with pytest.raises(ValueError):
            M.apply_merge(base, new, **bad)


def test_change_feed_rebuilds_the_new_state(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "id long, v string")
    feed = M.change_feed(old, new, ["id"])
    assert rows(feed) == [(1, "a", "delete"), (2, "B", "update_postimage"), (2, "b", "update_preimage"), (4, "d", "insert")]


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ("id",), ("v > 0",))
    frame = lambda *r: spark.createDataFrame(list(r), "id long, v long")
    assert t.version() == -1
    assert t.write(frame((1, 10), (2, 20)), "overwrite") == 0
    assert t.write(frame((3, 30)), app=("job", 1)) == 1 and t.write(frame((3, 30)), app=("job", 1)) == 1
    assert t.update({"v": "v + 1"}, "id = 1") == 2
    assert t.delete("id = 2") == 3
    assert t.merge(frame((1, 99), (7, 70)), delete_unmatched="t.id = 3") == 4
    assert rows(t.read()) == [(1, 99), (7, 70)] and rows(t.read(0)) == [(1, 10), (2, 20)]
    kinds = [(r._commit_version, r.id, r._change_type) for r in t.changes(3, 4).orderBy("_commit_version", "id", "_change_type").collect()]
    assert kinds == [(3, 2, "delete"), (4, 1, "update_postimage"), (4, 1, "update_preimage"), (4, 3, "delete"), (4, 7, "insert")]
    with pytest.raises(ConstraintError):
        t.write(frame((9, -1)))
    with pytest.raises(ValueError):
        t.delete(" ")
    assert t.restore(0) == 5 and t.compact(1) == 6 and rows(t.read()) == [(1, 10), (2, 20)]
    assert t.snapshot().first().row_count == 2 and t.files().first().max_id == 2
    assert t.vacuum(2) == [4, 3, 2, 1, 0] and rows(t.read(0)) == [(1, 10), (2, 20)]


def test_cursor_moves_after_success(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ("id",))
    t.write(spark.createDataFrame([(1, 1)], "id long, v long"), "overwrite")
    c, seen = Cursor(t, "reader"), []

    def fail(df):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        c.process(fail)
    assert c.position() == -1
    assert c.process(lambda df: seen.append(df.count())) == 0 and seen == [1]
    assert c.process(fail) is None


def test_append_only_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ("id",), append_only=True)
    t.write(spark.createDataFrame([(1,)], "id long"))
    t.write(spark.createDataFrame([(2,)], "id long"))
    with pytest.raises(PermissionError):
        t.delete("id = 1")


def test_closure_is_bounded(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 0)], "c long, p long")
    out = ancestor_closure(edges, "c", "p", 5)
    assert out.agg(F.max("depth")).first()[0] == 5 and out.count() == 21 * 5


def test_files(spark, tmp_path):
    df = FS.open_dataset(spark, {"a": [1, 2], "b": ["x", None]})
    FS.write(df, str(tmp_path / "j"), "json")
    with pytest.raises(ValueError):
        FS.write(df, str(tmp_path / "c"), "csv", partition_by=("a",))
    with pytest.raises(Exception, match="(?i)exist"):
        FS.write(df, str(tmp_path / "j"), "json")
    assert rows(FS.open_dataset(spark, str(tmp_path / "j"), "json", schema=df.schema)) == [(1, "x"), (2, None)]
    assert FS.size_tier(None) == "medium" and FS.size_tier(5) == "small" and FS.size_tier(2_000_000) == "large"
    index = spark.createDataFrame([("f1", 1, 5), ("f2", 6, 9), ("f3", None, None)], "path string, min_a long, max_a long")
    pick = lambda *f: [r.path for r in FS.candidate_files(index, [FS.FileFilter("a", *f)]).orderBy("path").collect()]
    assert pick("=", 7) == ["f2", "f3"] and pick("in", [1, 2]) == ["f1", "f3"] and pick("<", 6) == ["f1", "f3"]


def test_spread_join_parts_hot_values(spark, monkeypatch):
    """One value with nearly all pairs is made in several tasks, and no pair is lost or doubled; nulls do not meet."""
    monkeypatch.setattr(K, "PIECE_PAIRS", 1000)
    left = spark.createDataFrame([(i, "p", None if i % 50 == 49 else i % 7 // 6) for i in range(600)] + [(0, "p", 0)] * 2, "a long, path string, name long")
    right = spark.createDataFrame([(i, "p", None if i % 50 == 49 else i % 11 // 10, f"r{i}") for i in range(90)], "b long, path string, name long, c string")
    out = K.spread_join(left, right, ["path", "name"])
    want = left.join(right, ["path", "name"])
    assert out.columns == want.columns and rows(out) == rows(want)
    tasks = out.groupBy(F.spark_partition_id(), "name").count().where("name = 0").count()
    assert tasks > 3


@pytest.mark.parametrize("condition", ["contains", "overlaps"])
@pytest.mark.parametrize("sections", [3, 4096])
def test_left_range_join_makes_no_pairs_to_tell_who_is_alone(spark, condition, sections, monkeypatch):
    """Against all pairs: points, equal times, intervals that end before they start, nulls, equal left rows; no shuffle by a row's number."""
    monkeypatch.setattr(I, "SECTIONS", sections)
    rng = random.Random(8)
    make = lambda n, span: [(i, (s := rng.randint(-500, 500)), s + rng.choice([0, 0, 1, 5, 30, 200])) for i in range(n)]
    a, b = make(90, 900), make(25, 400)
    a += [(100, 5, 4), (101, None, 3), (102, 3, None), (103, b[0][1], b[0][2]), (103, b[0][1], b[0][2]), (104, b[1][2], b[1][2] + 1), (105, b[1][1] - 4, b[1][1])]
    b += [(30, 7, 6), (31, None, 1)]
    left, right = spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, s long, e long")
    out = I.range_join(left, right, ("s", "e"), ("s", "e"), condition, "left", width=7, most_bins=4)
    assert out.columns == ["i", "s", "e", "j", "s__r", "e__r"]
    good = lambda x: None not in x and x[1] <= x[2]
    fits = (lambda x, y: x[1] <= y[1] and y[2] <= x[2]) if condition == "contains" else (lambda x, y: y[1] < x[2] and x[1] < y[2])
    want = []
    for x in a:
        met = [y for y in b if good(x) and good(y) and fits(x, y)]
        want += [x + y for y in met] or [(*x, None, None, None)]
    assert rows(out) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_row" not in plan and "monotonically_increasing_id" not in plan
    none = I.range_join(left, right.where("j < 0"), ("s", "e"), ("s", "e"), condition, "left")
    assert rows(none) == sorted(((*x, None, None, None) for x in a), key=repr)
