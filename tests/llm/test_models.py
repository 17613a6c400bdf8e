"""Language identification and toxicity: held-out accuracy, edge cases, what is learned from."""

from __future__ import annotations

import binascii
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from basalt.llm import codes, langid, toxicity


def test_folds(spark, make):
    rows = langid.identify(make(spark, ["a"] * 30)).collect()
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in got if got[i].held_out]
    assert len(got) == len(want) and np.mean([got[i].lang_pred == want[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(20 + i, "der hund und die katze", "de") for i in range(20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 ... \n", "de"), (103, "und die der " * 30000, None), (None, "der hund", "de"), (104, "é", None)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, held_out string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"} and got[100].score == 0
    assert got[103].lang_pred == "de" and got[None].lang_pred == "de" and got[104].lang_pred in ("de", "en")
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.where("lang is null")).collect()} == {"und"}


def test_language_uses_text_alone(spark):
    """Held-out rows whose language and source are wrong get the same prediction."""
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(60)]
    lie = [(i, t, ("de" if g == "en" else "en") if binascii.crc32(str(i).encode()) % 3 == 1 else g) for i, t, g in rows]
    schema = "doc_id long, text string, lang string"
    one = sorted(map(tuple, langid.identify(spark.createDataFrame(rows, schema)).collect()))
    assert one == sorted(map(tuple, langid.identify(spark.createDataFrame(lie, schema)).collect()))


def test_word_ids_depend_on_the_word_alone():
    words, at = toxicity.word_ids(pa.array(["One two, ONE", None, "two", "zwölf one"]))
    w = words.tolist()
    assert at.tolist() == [0, 3, 3, 4, 6]
    assert w[0] == w[2] == w[5] and w[1] == w[3] and len({w[0], w[1], w[4]}) == 3


def corpus(n=300):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    bad = ["awfulword", "nastyword", "rudeword"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(10, 90))]
        if i % 5 == 0:
            text[rng.randrange(len(text))] = rng.choice(bad)
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    rows += [(1000, None, None), (1001, "", None), (1002, "awfulword " * 50000, None), (None, "plain text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (1, None), (5000, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks).collect()}
    held = [i for i in range(300) if got[i].held_out]
    right = [got[i].predicted == int(i % 5 == 0) for i in held]
    assert np.mean(right) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[1000].score == got[1001].score and got[1000].predicted == 0 and got[1002].predicted == 1


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    rows, labels = corpus(120)
    lie = [(i, 1 - t if binascii.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (sorted(map(tuple, toxicity.score_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, lie))
    assert one == two


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity.score_toxicity(docs, none).select("score", "predicted").collect()] == [(0.0, 0)]
    assert toxicity.score_toxicity(docs.limit(0), none).collect() == []


def test_gradient_of_the_net():
    """One small step lowers the loss of its batch."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, 30).astype(np.int32) for _ in range(16)]
    y = (np.arange(16) % 2).astype(np.float32)
    net = toxicity.Net.new(texts, 3)
    flat, at = np.concatenate(texts), np.arange(0, 481, 30)
    loss = lambda: -np.mean(np.where(y > 0, np.log(net.score(flat, at)), np.log(1 - net.score(flat, at))))
    before = loss()
    for _ in range(300):
        net.step(flat, at, y, np.ones(16))
    assert loss() < 0.7 * before


def test_scores_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 60, n).astype(np.int32) for n in (0, 1, 2, 3, 50, 500, 7)]
    net = toxicity.Net.new(texts, 3)
    flat, at = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = net.score(flat, at)
    for size in (1, 3, 64):
        monkeypatch.setattr(toxicity, "PIECE_WORDS", size)
        assert np.allclose(net.score(flat, at), whole)


def test_long_texts_are_read_in_pieces(monkeypatch):
    """Words and n-grams over the cuts of a text count as in the whole text."""
    column = pa.array(["One two, ONE", None, "", "zwölf one", "x" * 300 + " yé 日本 " + "z" * 500, "a b" * 200, "日本語" * 90])
    rng = np.random.default_rng(0)
    table = np.concatenate([rng.normal(size=(langid.BUCKETS, 2)), np.zeros((1, 2))]).astype(np.float32)
    model = langid.Model(("a", "b"), np.log([0.3, 0.7]), table)
    words, logits = toxicity.word_ids(column), model.logits(column)
    for size in (1, 2, 3, 7, 64, 501):
        monkeypatch.setattr(codes, "PIECE", size)
        again = toxicity.word_ids(column)
        assert (again[0] == words[0]).all() and (again[1] == words[1]).all()
        assert np.allclose(model.logits(column), logits)


def brute_grams(text):
    """Buckets of the text's 1- to 3-grams, one point at a time."""
    fold = codes.fold_table()
    points = [int(fold[ord(c)]) for c in text or ""] + [0]
    out = []
    for n in langid.ORDERS:
        for i in range(len(points) - n + 1):
            gram = points[i : i + n]
            if (n == 1 and gram == [0]) or (n > 1 and gram[:2] == [0, 0]):
                continue
            h = n * 0x85EBCA6B & 0xFFFFFFFF
            for p in gram:
                h = ((h ^ p) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h >> 16)
    return out


def test_language_against_brute_force(spark):
    """The table of log probabilities and the posterior, recomputed from counts in plain Python."""
    say = ["the cat, and the dog", "der Hund und die Katze!", "le chat et le chien é", "x 1 2 3"]
    rows = [(i, say[i % 3] + " " + say[(i // 3) % 4], "edf"[i % 3]) for i in range(45)] + [(100, None, "e"), (101, say[1], None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learned = [(t, g) for i, t, g in rows if t and g and binascii.crc32(str(i).encode()) % 3 != 1]
    counts = {g: Counter(x for t, k in learned if k == g for x in brute_grams(t)) for g in "def"}
    total = {g: sum(c.values()) + langid.SMOOTH * langid.BUCKETS for g, c in counts.items()}
    for i, text, _ in rows:
        if text:
            z = {g: math.log(sum(k == g for _, k in learned) / len(learned)) for g in "def"}
            for g in z:
                z[g] += sum(math.log((counts[g][x] + langid.SMOOTH) / total[g]) for x in brute_grams(text))
            best = max(z, key=z.get)
            assert got[i].lang_pred == best
            assert abs(got[i].score - 1 / sum(math.exp(v - z[best]) for v in z.values())) < 1e-4


def test_rare_languages_are_sampled_whole():
    assert langid.share_each([10, 1000, 5000], 600) == 295.0
    assert langid.share_each([3, 4], 100) >= 4


def test_net_against_brute_force():
    """The score of each text, one filter and one place at a time."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 40, n).astype(np.int32) for n in (0, 1, 2, 5, 30, 80)]
    net = toxicity.Net.new(texts * 4, 3)
    net.params["E"][1:-1] = rng.normal(size=net.params["E"][1:-1].shape)
    flat, at = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for text, score in zip(texts, net.score(flat, at), strict=True):
        pooled = []
        vectors = [net.params["E"][net.row[w]].astype(float) for w in text]
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                best = 0.0
                for i in range(len(text)):
                    z = float(net.params[f"c{w}"][f]) + sum(float(vectors[i + k] @ net.params[f"W{w}"][k][:, f]) for k in range(w) if i + k < len(text))
                    best = max(best, z)
                pooled.append(best)
        z = float(np.dot(pooled, net.params["o"]) + net.params["b"][0])
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-4


def test_labels_have_no_part_in_the_start():
    texts = [np.arange(k, k + 9, dtype=np.int32) for k in range(12)]
    one, two = toxicity.Net.new(texts, 1), toxicity.Net.new(texts, 1)
    assert all((one.params[k] == two.params[k]).all() for k in one.params)


def test_word_bound_takes_whole_texts(spark):
    """With few words allowed, texts are taken in their seeded order; long ones are passed over, both labels stay."""
    rows, labels = corpus(120)
    docs = spark.createDataFrame([*rows, (999, "awfulword " * 20000, "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (999, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, marks, most_words=3000) is not None
    assert toxicity.fit(docs, marks, most_words=1) is None
