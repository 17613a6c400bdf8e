"""Near copies of the pipeline by exact Jaccard, against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from basalt.llm import similar_sets, simhash


def brute_groups(texts, size=5, similarity=0.8):
    """For each text the first one of its group; texts without words are one group."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= similarity * (len(a) + len(sets[j]) - both) - 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    """Copies with changed words, a large group of such, chains, a common line, short and empty texts."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line, base, out = say(12), say(110), []

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = rng.choice(vocabulary)
        return words

    for _ in range(30):
        text = say(rng.randint(20, 120))
        out += [text, changed(text, 1), changed(text, rng.randint(1, 4)), text + say(rng.randint(1, 30))]
    out += [changed(base, rng.randint(0, 3)) for _ in range(90)]
    out += [say(rng.randint(3, 30)) + line for _ in range(60)]
    at = say(100)
    for _ in range(12):
        at = changed(at, 2)
        out.append(at)
    out = [" ".join(t) for t in out]
    rng.shuffle(out)
    return [*out, "", None, " \n", "x", "X", "two words", "Two  words", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize(("short_run", "block"), [(8, 4096), (2, 7)])
def test_stage_links_every_alike_pair(spark, make, texts, short_run, block, monkeypatch):
    """Whatever the runs that are compared pair by pair, and the blocks of the groups of the others."""
    monkeypatch.setattr(similar_sets, "SHORT_RUN", short_run)
    monkeypatch.setattr(similar_sets, "BLOCK", block)
    kept = corpus_pipeline.drop_near_copies(spark, make(spark, texts), "")
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(brute_groups(texts))


def test_blocks_lose_no_alike_pair():
    """All alike pairs of different parts, few others, none inside a part; of two sides, only pairs of both."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = []
    for k in range(80):
        own = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        most = base[: 150 + 150 * (k % 2)]
        sets.append(np.unique(np.concatenate([most[rng.random(len(most)) > rng.choice([0.02, 0.1])], own[: rng.integers(0, 30)]])))
    sets.append(sets[0][:0])
    fps, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    bins = np.stack([np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) for s in sets]).astype(np.uint8)
    alike = {(j, i) for i in range(len(sets)) for j in range(i) if (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9}
    for parts, sides in ((fps, fps * 0), (fps % 3, fps * 0), (fps, fps % 2)):
        found = set(zip(*(x.tolist() for x in similar_sets.block_pairs(fps, parts, sides, sizes, bins, 0.8)), strict=True))
        apart = {(a, b) for a, b in alike if parts[a] != parts[b] and (not sides.any() or sides[a] != sides[b])}
        assert apart <= found and all(parts[a] != parts[b] for a, b in found)
        assert len(found) < 3 * len(apart) + 20


@pytest.mark.parametrize("sides", [False, True])
def test_tree_of_alike_members_has_a_pair_for_each_part(sides):
    """Members that are all alike: as many pairs as connect them, and one part of them; parts far apart give none."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) > 0.02], rng.integers(0, 1 << 60, 4).astype(np.uint64)])) for _ in range(200)]
    sets += [rng.integers(0, 1 << 60, 400).astype(np.uint64) for _ in range(3)]
    fps, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    bins = np.stack([np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) for s in sets]).astype(np.uint8)
    a, b = similar_sets.block_pairs(fps, fps, fps % 2 if sides else fps * 0, sizes, bins, 0.8, tree=True)
    assert len(a) == 199 and set(a.tolist()) | set(b.tolist()) == set(range(200))
    root = list(range(200))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root = [root[y] if r == root[x] else r for r in root]
    assert len(set(root)) == 1


def test_recall_on_the_test_tables(spark, sf):
    """Every pair of documents that differ in more than white space and are alike by all pairs' Jaccard is joined."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert kept == {rows[k][0] for k in set(brute_groups([t for _, t in rows]))}


def test_stage_takes_golay_links_first(spark, make, texts, monkeypatch):
    """The fingerprints' links within three bits are found by Golay keys and checked by the sets; what they connect is not tried again."""
    seen, real = {}, simhash.checked_links

    def checked(distinct, docs, size, similarity, text_col="text"):
        seen["sets"] = {r.fp: r.bits for r in distinct.select("fp", "bits").collect()}
        out = real(distinct, docs, size, similarity, text_col)
        seen["links"] = {(r.a, r.b) for r in out.collect()}
        return out

    monkeypatch.setattr(simhash, "checked_links", checked)
    apart = similar_sets._apart
    monkeypatch.setattr(similar_sets, "_apart", lambda pairs, links: seen.setdefault("apart", apart(pairs, links)))
    simhash.drop_near_copies(make(spark, texts), size=5, similarity=0.8).collect()
    groups, near = brute_groups(texts), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
    marks = {}
    for i, t in enumerate(texts):
        s = similar_sets.shingle_set((t or "").encode(), 5)
        marks.setdefault(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 64) * (xxhash.xxh3_64_intdigest(s.tobytes()) >> 63), (groups[i], s))
    assert set(marks) == set(seen["sets"]) and seen["links"]
    alike = lambda s, t: len(np.intersect1d(s, t)) >= 0.8 * (len(s) + len(t) - len(np.intersect1d(s, t))) - 1e-9
    heads = {}
    for fp, bits in seen["sets"].items():
        heads[bits] = min(fp, heads.get(bits, fp))
    want = {tuple(sorted((heads[bits], fp))) for fp, bits in seen["sets"].items() if heads[bits] != fp}
    want |= {tuple(sorted((heads[a], heads[b]))) for a in heads for b in heads if a < b and near(a, b)}
    assert seen["links"] == {(a, b) for a, b in want if alike(marks[a][1], marks[b][1])}
    root = {fp: fp for fp in marks}
    for a, b in seen["links"]:
        root = {k: root[b] if v == root[a] else v for k, v in root.items()}
    tried = {(r.a, r.b) for r in seen["apart"].collect()}
    assert tried and all(root[a] != root[b] for a, b in tried)
