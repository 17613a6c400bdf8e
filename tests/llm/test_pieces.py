"""Sampled segmentations: exact probabilities, reproducible draws, lossless round trips."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from basalt.llm import pieces


@pytest.fixture(scope="module")
def lat():
    return pieces.Lattice()


def segmentations(lat, word):
    """Every segmentation of a word with its probability."""
    ids = {b.decode(): i for i, b in enumerate(lat.bytes_of) if b and i >= 259}

    @lru_cache(None)
    def rest(at):
        if at == len(word):
            return [((), 1.0)]
        out = []
        for to in range(at + 1, len(word) + 1):
            part = word[at:to]
            if part in ids:
                out += [((ids[part], *r), lat.weight[ids[part]] * p) for r, p in rest(to)]
            elif to == at + 1:
                raw = tuple(int(lat.byte_ids[b]) for b in part.encode())
                out += [((*raw, *r), lat.fallback * p) for r, p in rest(to)]
        return out

    found = rest(0)
    total = sum(p for _, p in found)
    return {s: p / total for s, p in found}


def test_samples_follow_the_lattice(lat):
    """Frequencies over many keys agree with all segmentations enumerated."""
    n = 20000
    flat, offsets = pieces.encode_batch(lat, pa.array(["thereéก"] * n), np.arange(n), 3)
    drawn = Counter(tuple(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True))
    want = segmentations(lat, " thereéก")
    assert set(drawn) <= set(want)
    for s, p in want.items():
        assert abs(drawn[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_round_trip(spark, make, odd_texts, lat):
    texts = [*odd_texts, " leading", "trailing ", "two  spaces", "\n\n", "▁mark ▁", "x" * 1000, "\U0001f600 ok", "\t\x00\x7f", "ﬁ 　"]
    docs = make(spark, texts)
    encoded = pieces.encode(docs)
    assert encoded.columns == ["doc_id", "piece_ids"]
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    rows = pieces.encode_and_decode(docs).collect()
    assert all(r.lossless for r in rows) and len(rows) == len(texts)
    assert all(r.n_pieces == len(r.piece_ids) for r in rows)


def test_draws_do_not_depend_on_partitions(spark, make, odd_texts, monkeypatch):
    one = {r.doc_id: r.piece_ids for r in pieces.encode(make(spark, odd_texts).coalesce(1)).collect()}
    many = {r.doc_id: r.piece_ids for r in pieces.encode(make(spark, odd_texts).repartition(7)).collect()}
    other = {r.doc_id: r.piece_ids for r in pieces.encode(make(spark, odd_texts), seed=8).collect()}
    assert one == many and one != other


def test_long_texts_in_chunks(lat, monkeypatch):
    text = pa.array(["word by word " * 300 + "z" * 500])
    whole = pieces.encode_batch(lat, text, np.array([5]), 7)[0].tolist()
    monkeypatch.setattr(pieces, "CHUNK", 200)
    assert pieces.encode_batch(lat, text, np.array([5]), 7)[0].tolist() == whole


def test_empty_table(spark, make):
    assert pieces.encode_and_decode(make(spark, [])).collect() == []
    (row,) = pieces.encode_and_decode(make(spark, [None])).collect()
    assert (row.n_pieces, row.lossless, row.n_chars) == (0, True, 0)


def log_marginals(lat, word):
    """log P(a piece begins at each place) for a word of any length, by forward and backward sums of logarithms."""
    ids = {b.decode("utf-8", "ignore"): i for i, b in enumerate(lat.bytes_of) if b and i >= 259}
    n = len(word)

    def arcs(at):
        for to in range(at + 1, min(n, at + 16) + 1):
            if word[at:to] in ids:
                yield to, math.log(lat.weight[ids[word[at:to]]])
            elif to == at + 1:
                yield to, math.log(lat.fallback)

    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
    ahead, behind = [-math.inf] * n + [0.0], [0.0] + [-math.inf] * n
    for at in range(n):
        for to, w in arcs(at):
            behind[to] = add(behind[to], behind[at] + w)
    for at in reversed(range(n)):
        for to, w in arcs(at):
            ahead[at] = add(ahead[at], w + ahead[to])
    return [behind[at] + ahead[at] - ahead[0] for at in range(n)]


@pytest.mark.parametrize("segment", [1 << 14, 40])
def test_long_words_follow_the_exact_lattice(lat, segment, monkeypatch):
    """No border is forced inside a word of 300 points: each place begins a piece as often as the whole lattice says."""
    monkeypatch.setattr(pieces, "SEGMENT", segment)
    rng, n = np.random.default_rng(3), 1200
    word = " " + "".join(rng.choice(list("thereandingous"), 299))
    points = np.array([ord(c) for c in word], np.uint32)
    assert len(pieces.word_starts(lat, points, np.array([300]))) == 1
    begins = np.zeros(300)
    for _ in range(n):
        draws = rng.random(300)
        begins += pieces.sample_long(lat, points, lambda lo, hi, d=draws: d[lo:hi]) != -1
    want = np.minimum(np.exp(log_marginals(lat, word)), 1.0)
    assert (np.abs(begins / n - want) < 5.5 * np.sqrt(want * (1 - want) / n) + 2e-3).all()
    assert 0 < begins[[64, 128, 192, 256]].min() < n or (want[[64, 128, 192, 256]] < 0.5).any()


def test_long_words_at_any_segment_agree(lat, monkeypatch):
    text = pa.array(["ab" * 700 + " " + "cde" * 900])
    whole = pieces.encode_batch(lat, text, np.array([5]), 7)[0].tolist()
    for size in (17, 64, 1000):
        monkeypatch.setattr(pieces, "SEGMENT", size)
        monkeypatch.setattr(pieces, "CHUNK", 3 * size)
        assert pieces.encode_batch(lat, text, np.array([5]), 7)[0].tolist() == whole


def test_runs_of_spaces_use_their_pieces(lat):
    flat, _ = pieces.encode_batch(lat, pa.array(["a" + " " * 40 + "b"]), np.array([1]), 7)
    assert any(set(lat.bytes_of[i]) == {32} and len(lat.bytes_of[i]) > 1 for i in flat.tolist())
    assert pieces.decode_ids(lat, flat) == "a" + " " * 40 + "b"


def test_repetitions_get_samples_of_their_own(spark, make):
    docs = make(spark, ["the quick brown fox jumps over the lazy dog, thereinafter unquestionably " * 20] * 3 + ["other"], [4, 4, 4, 5]).coalesce(1)
    found = [tuple(r.piece_ids) for r in pieces.with_pieces(docs, copies=True).collect()]
    assert len(set(found)) == 4
    alike = [tuple(r.piece_ids) for r in pieces.with_pieces(docs).collect()]
    assert len(set(alike)) == 2 and alike[0] == found[0]
