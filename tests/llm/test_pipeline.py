"""The corpus pipeline against brute force, stage by stage, on small tables."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest
from basalt.llm import toxicity

from .test_similar_sets import brute_groups


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with a few toxic ones, copies, near copies, nulls, repeated rows; labels for two thirds."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["vileword", "scumbag", "trashtalk"]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text), "en", f"s{i % 4}" if i % 5 else None, 0))
        if i % 3 != 1:
            labels.append((i, 1, int(toxic)))
    rows += [(300 + i, rows[i * 6 + 1][1], "en", "s1", 0) for i in range(10)]  # copies
    rows += [(320 + i, rows[i * 6 + 2][1].replace(" ", "  \n"), "en", "s2", 0) for i in range(5)]
    rows += [(330 + i, rows[i * 6 + 3][1] + " tail", "en", "s2", 0) for i in range(5)]
    rows += [(400, None, None, None, None), (401, "", None, "s1", 0), (402, "x", None, "s1", 1), (402, "x", None, "s1", 1), (None, "no id at all here", None, None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def run_stage(spark, at, docs, path):
    return corpus_pipeline.STAGES[at][1](spark, docs, path)


def as_set(df, columns=("doc_id", "text", "lang", "source", "n_chars")):
    assert df.columns == list(columns)
    return sorted(map(tuple, df.collect()), key=repr)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]


def test_toxicity_drops_what_it_predicts(spark, tables):
    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = as_set(run_stage(spark, 0, docs, path))
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()
    called = {r.doc_id for r in scored if r.predicted == 1}
    assert kept == sorted((r for r in rows if r[0] not in called), key=repr)
    toxic = {i for i in range(0, 240, 6)}
    assert len(called & toxic) >= 0.8 * len(toxic) and len(called - toxic) <= 3


def test_exact_dedup_keeps_one_of_each_text(spark, tables):
    path, rows = tables
    got = as_set(run_stage(spark, 1, spark.read.parquet(f"{path}/documents.parquet"), path))
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    assert got == sorted((r for _, r in best.values()), key=repr)


def test_near_dedup_keeps_one_of_each_component(spark, tables):
    path, rows = tables
    got = as_set(run_stage(spark, 2, spark.read.parquet(f"{path}/documents.parquet"), path))
    comp = brute_groups([r[1] for r in rows])  # the stage's rule: five words a shingle, Jaccard 0.8 or more
    best = {}
    for i, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0)
        if comp[i] not in best or rank < best[comp[i]][0]:
            best[comp[i]] = (rank, r)
    assert [r[0] for r in got] == [r[0] for r in sorted((r for _, r in best.values()), key=repr)]


def test_mixing_repeats_documents(spark, tables):
    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = as_set(run_stage(spark, 3, docs, path))
    assert as_set(run_stage(spark, 3, docs, path)) == got
    size = lambda t: len((t or "").split())
    total = sum(size(r[1]) for r in rows)
    assert abs(sum(size(r[1]) for r in got) - 1.5 * total) < 300
    assert set(got) <= set(rows) and max(got.count(r) for r in set(got)) <= 4  # a repeated row counts for each


def test_pipeline_end_to_end(spark, tables):
    path, rows = tables
    out = corpus_pipeline.run(spark, path)
    found = out.collect()
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert found and all(r.lossless for r in found)
    assert {r.doc_id for r in found} <= {r[0] for r in rows}
