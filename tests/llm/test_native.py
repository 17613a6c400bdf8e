"""Exact dedup, mixing and sharding against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys

import pytest
from basalt.llm import common, exact_dedup, mixing, queries, sharding, simhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from compare import duck, rows_of  # noqa: E402


def brute_dedup(texts, ids=None):
    ids = ids or list(range(len(texts)))
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    out = []
    for i, n in enumerate(norm):
        same = [j for j in range(len(texts)) if norm[j] == n]
        best = min(same, key=lambda j: (-len(texts[j] or ""), ids[j]))
        out.append((ids[i], ids[best], len(same), ids[i] == ids[best] and len(texts[i] or "") == len(texts[best] or ""), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def run_dedup(df, **how):
    return sorted(tuple(r)[:5] for r in exact_dedup.exact_dedup(df, **how).collect())


def test_exact_dedup(spark, make, odd_texts):
    texts = [*odd_texts, "a b", "ab", "a\tb ", "a b", "ab  "]
    assert run_dedup(make(spark, texts)) == brute_dedup(texts)


def test_collisions_are_told_apart_by_their_bytes(spark, make, odd_texts):
    """A hash of two bits: every group holds several texts."""
    weak = lambda c: F.substring(F.md5(c.cast("binary")), 1, 1).isin(*"01234567").cast("string").cast("binary")
    assert run_dedup(make(spark, odd_texts), hash_fn=weak) == brute_dedup(odd_texts)


def test_exact_dedup_of_repeated_ids(spark, make):
    texts, ids = ["x y", "xy", "xy", None, "", "xy  "], [1, 1, 2, 3, 3, 1]
    assert run_dedup(make(spark, texts, ids)) == brute_dedup(texts, ids)
    assert run_dedup(make(spark, [])) == []
    kept = exact_dedup.drop_copies(make(spark, texts, ids)).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, "xy  "), (3, "")]


def test_many_copies(spark, make):
    texts = ["the same text"] * 3000 + [f"text {i}" for i in range(50)]
    rows = exact_dedup.exact_dedup(make(spark, texts)).collect()
    assert sum(r.kept for r in rows) == 51 and {r.group_size for r in rows} == {1, 3000}


def brute_targets(sizes, weights, total, most=2.0):
    clamped = set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(most * sizes[s] for s in clamped)
        level = left / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if level * weights[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in clamped else level * weights[s] for s in sizes}
        clamped |= over


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing(spark, make, odd_texts):
    texts = odd_texts * 6
    source = [["big", "é", "mid", "Zed", None, "tiny", "\U0001f600"][min(6, i % 9)] for i in range(len(texts))]
    rows = mixing.mix_sources(make(spark, texts, source=source)).collect()
    assert len(rows) == len(texts)
    sizes = {}
    for t, s in zip(texts, source, strict=True):
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    want = brute_targets(sizes, weights, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.size == size(texts[r.doc_id]) and r.source == source[r.doc_id] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    longest = {s: max(size(t) for t, x in zip(texts, source, strict=True) if x == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    again = mixing.mix_sources(make(spark, texts, source=source).repartition(5)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def test_mixing_edge_cases(spark, make):
    assert mixing.mix_sources(make(spark, [])).collect() == []
    rows = mixing.mix_sources(make(spark, [None, "", " \n"])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3
    (one,) = mixing.mix_sources(make(spark, ["a b c d"], source=["s"])).collect()
    assert (one.target, one.taken) in {(6.0, 4), (6.0, 8)}


def test_oracles(spark, sf):
    con = duck(sf)
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        cur = con.execute(sql)
        assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall()), name


def brute_shards(rows, limit):
    """rows: (id, bytes, hash).  The directory: buckets split on the next bit while they are too large."""
    out, open_buckets = {}, [(0, 0, rows)]
    while open_buckets:
        depth, prefix, members = open_buckets.pop()
        total = sum(b for _, b, _ in members)
        if total <= limit or len({h for _, _, h in members}) == 1:
            for i, _, _ in members:
                out.setdefault(i, []).append((depth, f"{prefix:0{depth}b}" if depth else "", total, len(members)))
        else:
            for bit in (0, 1):
                part = [m for m in members if m[2] >> (62 - depth) & 1 == bit]
                if part:
                    open_buckets.append((depth + 1, prefix * 2 + bit, part))
    return out


@pytest.mark.parametrize("limit", [1 << 30, 9000, 1500, 60])
def test_sharding(spark, make, odd_texts, limit):
    docs = make(spark, odd_texts * 3, ids=[7] * 4 + list(range(len(odd_texts) * 3 - 4)))
    got = sharding.shard_documents(docs, limit_bytes=limit).collect()
    text = F.coalesce("text", F.lit(""))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(29), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text)), 1)
    rows = [(r.doc_id, r.n, r.h) for r in docs.select("doc_id", F.octet_length(text).alias("n"), h.alias("h")).collect()]
    want = brute_shards(rows, limit)
    mine = {}
    for r in got:
        mine.setdefault(r.doc_id, []).append((r.depth, r.shard, r.shard_bytes, r.shard_docs))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}


def test_sharding_edge_cases(spark, make, tmp_path):
    assert sharding.shard_documents(make(spark, [])).collect() == []
    same = sharding.shard_documents(make(spark, ["x" * 100] * 5, ids=[1] * 5), limit_bytes=50).collect()
    assert {(r.depth, r.shard_docs, r.shard_bytes) for r in same} == {(0, 5, 500)}  # repeats cannot be parted
    docs = make(spark, [f"text number {i} " * 9 for i in range(40)]).select("doc_id", "text")
    sharding.write_shards(docs, sharding.shard_documents(docs, limit_bytes=1000), str(tmp_path / "s"))
    back = spark.read.option("inferSchema", "false").parquet(str(tmp_path / "s"))
    assert back.count() == 40 and back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0] <= 1000


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(5, i) for i in range(6, 120)] + [(400, 400), (None, 3)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 200 for i in range(200, 261)} | {i: 5 for i in range(5, 120)}


def brute_parts(edges):
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        lo, hi = sorted((root[a], root[b]))
        root = {k: lo if v == hi else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("most", [1 << 18, 64, 7])
def test_components_of_any_share_of_edges_in_a_task(spark, most, monkeypatch):
    """Chains, hubs, repeats and random edges over several tasks: in one task, contracted, and by rounds of stars."""
    rng = random.Random(3)
    monkeypatch.setattr(common, "MOST_EDGES", most)
    chain = list(range(1000, 1150))
    rng.shuffle(chain)
    edges = list(zip(chain[:-1], chain[1:], strict=True)) + [(-5, i) for i in range(200, 300)] + [(290, 1000)] * 3
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    edges = [e for e in edges if e[0] != e[1]]
    rng.shuffle(edges)
    found = common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == brute_parts(edges)


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """A long chain that fits a task is written twice and never shuffled: rounds of tiny files filled the disk of many partitions."""
    written, real = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, kind: written.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, kind))
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in common.connected_components(edges).collect()} == {0}
    assert len(written) == 2 and not any("Exchange" in plan for plan in written)


def test_word_count(spark):
    texts = ["a b", "", None, "  x\ty\n", " ", "one\x0btwo\x0cthree\r", "é" * 5]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [size(t) for t in texts]


def test_null_id_that_stays(spark, make):
    """The longest text has no id: the others know that they go, and to whom."""
    got = sorted(map(tuple, exact_dedup.exact_dedup(make(spark, ["a b ", "ab", "c"], [None, 1, 2])).select("doc_id", "keep_id", "group_size", "kept").collect()), key=repr)
    assert got == sorted([(None, None, 2, True), (1, None, 2, False), (2, 2, 1, True)], key=repr)
    assert [r.doc_id for r in exact_dedup.drop_copies(make(spark, ["a b ", "ab"], [None, 1])).collect()] == [None]


NAMES = "_th int, _copy int, _repeats int, _key_id int, _key_th int, `dotted.name` int"


def test_clashing_names_keep_their_values(spark):
    """Columns named like those that the operators add come back as they were, from every stage that keeps rows."""
    rows = [(i, f"text number {i % 6} of some length here", "s", 7, 8, 9, 10 + i, 11, 12) for i in range(12)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {NAMES}")
    for kept in (exact_dedup.drop_copies(docs), simhash.drop_near_copies(docs), simhash.drop_near_copies(docs, size=5, similarity=0.8), mixing.repeat_rows(docs, mixing.mix_sources(docs))):
        assert kept.columns == docs.columns
        found = [tuple(r) for r in kept.collect()]
        assert found and set(found) <= set(rows)


def test_prefix_sums_of_any_step(spark, make, monkeypatch):
    docs = make(spark, [f"text {i} " * (i % 9) for i in range(150)])
    whole = sorted(map(tuple, sharding.shard_documents(docs, limit_bytes=300).collect()))
    deep = sharding._prefix_sums
    monkeypatch.setattr(sharding, "_prefix_sums", lambda cells, low, bits: deep(cells, low, bits, 1))
    assert sorted(map(tuple, sharding.shard_documents(docs, limit_bytes=300).collect())) == whole
