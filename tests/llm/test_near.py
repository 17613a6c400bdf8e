"""SimHash, Order MinHash and repeated substrings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash
from basalt.llm import golay, order_minhash, simhash, substring_dedup
from basalt.llm.suffix_array import suffix_array


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    parent = dict(zip(ids, ids, strict=True))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                x, y = sorted((find(a), find(ids[j])))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, make, odd_texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(make(spark, odd_texts)).collect()}
    fps = [brute_fingerprint(t) for t in odd_texts]
    want = brute_components(list(range(len(fps))), fps)
    assert len(got) == len(odd_texts)
    for i, fp in enumerate(fps):
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == want[i]


def test_simhash_long_texts_are_read_in_pieces(monkeypatch):
    text = "Alpha beta\tgamma " * 500
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 97)
    assert simhash.fingerprint(text.encode()) == whole
    assert whole & (2**64 - 1) == brute_fingerprint(text)


def test_simhash_empty_table(spark, make):
    assert simhash.near_duplicates(make(spark, [])).collect() == []


def flipped(rng, x, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        x ^= 1 << b
    return x


def test_golay_keys_lose_no_link():
    rng = random.Random(3)
    xs = [rng.getrandbits(64) for _ in range(3000)]
    ys = [flipped(rng, x, 3) for x in xs]
    a, b = (np.array(v, np.uint64).view(np.int64) for v in (xs, ys))
    filed = set(zip(*(v.tolist() for v in simhash.keys_of(b, False)), strict=True))
    met = {r for r, k in zip(*(v.tolist() for v in simhash.keys_of(a, True)), strict=True) if (r, k) in filed}
    assert len(met) == len(xs)


def test_golay_is_perfect():
    code = golay.Golay()
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    index, _ = code.decode(words)
    assert (np.bitwise_count(words ^ ((index << 11) | code.parity[index])) <= 3).all()


def test_clusters_of_fingerprints(spark):
    """Dense balls and long chains: the components are those of all pairs."""
    rng = random.Random(9)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        fps |= {flipped(rng, centre, 5) for _ in range(150)}
    at = rng.getrandbits(64)
    for _ in range(60):
        at = flipped(rng, at, 3)
        fps.add(at)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    links = [(r.a, r.b) for r in simhash.fingerprint_links(frame).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links)
    from basalt.llm.common import connected_components

    edges = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups = defaultdict(set)
    for i, root in want.items():
        groups[root].add(signed[i])
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_link_run_connects_what_pairs_connect():
    rng = random.Random(2)
    fps = sorted({flipped(rng, 12345678901234567890, 4) for _ in range(200)})
    a, b = simhash.link_run(np.array(fps, np.uint64).view(np.int64))
    assert len(a) < len(fps)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True):
        parent[find(x)] = find(y)
    want = brute_components(fps, fps)
    assert {frozenset(f for f in fps if find(f) == r) for r in map(find, fps)} == {frozenset(f for f in fps if want[f] == r) for r in want.values()}


def test_long_runs_are_parted(spark, monkeypatch):
    """Keys with more rows than a task holds: the same components, and every pair of a key shares a part."""
    rng = random.Random(19)
    centre = rng.getrandbits(64)
    near = np.array([flipped(rng, centre, 3) for _ in range(400)], np.uint64).view(np.int64)
    other = np.array([x ^ 0b111 << 40 for x in near.tolist()], np.int64)
    for kind in range(8):
        a, b = (simhash.part_run(np.full(len(x), kind << 40), x)[0].reshape(4, -1) for x in (near, other))
        assert (a == b).any(0).all()
    fps = sorted({flipped(rng, centre, 6) for _ in range(500)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")

    def groups():
        from basalt.llm.common import connected_components

        parts = connected_components(simhash.fingerprint_links(frame)).collect()
        out = defaultdict(set)
        for r in parts:
            out[r.component].add(r.node)
        return sorted(map(sorted, out.values()))

    whole = groups()
    monkeypatch.setattr(simhash, "MOST_RUN", 5)
    assert groups() == whole
    want = defaultdict(set)
    for i, root in brute_components(list(range(len(fps))), fps).items():
        want[root].add(signed[i])
    assert whole == sorted(sorted(v) for v in want.values() if len(v) > 1)


def brute_signature(text):
    if not text:
        return np.zeros(order_minhash.SKETCHES, np.uint32)
    points = np.array([ord(c) for c in text], np.uint32)
    h = order_minhash.kmer_hashes(points)
    seen, numbered = defaultdict(int), []
    for x in h.tolist():
        n = seen[x]
        seen[x] += 1
        one = np.array([x], np.uint64)
        numbered.append(int((one if n == 0 else order_minhash.mix64(one + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93)))[0]))
    out = []
    for mul, add in zip(order_minhash._MUL.tolist(), order_minhash._ADD.tolist(), strict=True):
        ranked = sorted(range(len(numbered)), key=lambda i: ((((numbered[i] >> 32) * mul + add) & 0xFFFFFFFF), i))[: order_minhash.TUPLE]
        value = np.array([0x9E3779B97F4A7C15], np.uint64)
        for i in sorted(ranked):
            value = order_minhash.mix64(value * np.uint64(3) + np.uint64(numbered[i]))
        out.append(int(value[0]) >> 32)
    return np.array(out, np.uint32)


def test_order_minhash_matches_brute_force(spark, make, odd_texts):
    ids = [3 * i + 1 for i in range(len(odd_texts))]
    got = {r.doc_id: r for r in order_minhash.order_minhash(make(spark, odd_texts, ids), rows_each=7).collect()}
    assert len(got) == len(odd_texts)
    hexed = lambda s: s.astype(">u4").tobytes().hex()
    for i, doc_id in enumerate(ids):
        text, after = odd_texts[i] or "", odd_texts[(i + 1) % len(ids)] or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        if len(text) < 3000:
            sig, other = brute_signature(text), brute_signature(new)
            assert (r.fingerprint, r.edited_fingerprint) == (hexed(sig), hexed(other))
            assert r.near_edited == (sig == other).mean()
            assert r.near_next == (sig == order_minhash.signature(after)).mean()


def test_order_minhash_blocks_agree(monkeypatch):
    text = "".join(random.Random(1).choice("abcd ") for _ in range(5000))
    whole = order_minhash.signature(text)
    monkeypatch.setattr(order_minhash, "BLOCK", 333)
    assert (order_minhash.signature(text) == whole).all()


def test_order_minhash_long_texts_take_turns(monkeypatch):
    """k-mers of a very long text are taken by the first bits of their hash: the same signature."""
    texts = ["".join(random.Random(2).choice("abcd ") for _ in range(4000)), "ab" * 900, "the end " * 300 + "x", "日本語" * 200]
    whole = [order_minhash.signature(t) for t in texts]
    for size in (50, 333, 1024):
        monkeypatch.setattr(order_minhash, "MOST_KMERS", size)
        for t, w in zip(texts, whole, strict=True):
            assert (order_minhash.signature(t) == w).all()


def test_order_minhash_numbers_equal_kmers_alone():
    """Hashes that begin alike are different k-mers."""
    h = np.array([1 << 63, (1 << 63) | 1, 1 << 63, (1 << 63) | 1, 5], np.uint64)
    out = order_minhash.numbered(h)
    assert out[[0, 1, 4]].tolist() == h[[0, 1, 4]].tolist() and (out[[2, 3]] != h[[2, 3]]).all()


def test_order_minhash_sees_order():
    rng = random.Random(8)
    blocks = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(20)]
    text, moved = "".join(blocks), "".join(blocks[10:] + blocks[:10])
    same, other = order_minhash.signature(text), order_minhash.signature(moved)
    assert 0.2 < order_minhash.likeness(same, other) < 0.9
    assert order_minhash.likeness(same, same) == 1.0


def test_order_minhash_small_tables(spark, make):
    assert order_minhash.order_minhash(make(spark, [])).collect() == []
    (one,) = order_minhash.order_minhash(make(spark, ["abcdefghijkl"])).collect()
    assert one.near_next == 1.0
    rows = order_minhash.order_minhash(make(spark, ["one text", "one text", None], [None, None, 5])).collect()
    assert len(rows) == 3 and sum(r.near_next == 1.0 for r in rows) == 1


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(4)
    for size, kinds in ((0, 2), (1, 2), (500, 2), (500, 200), (300, 1)):
        symbols = rng.integers(1, kinds + 1, size).astype(np.int16)
        sa, rank = suffix_array(symbols)
        assert sa.tolist() == sorted(range(size), key=lambda i: symbols[i:].tolist())
        assert (rank[sa] == np.arange(size)).all()


def brute_removal(texts, match):
    raw = [(t or "").encode() for t in texts]
    at = defaultdict(int)
    for r in raw:
        for i in range(len(r) - match + 1):
            at[r[i : i + match]] += 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - match + 1):
            if at[r[i : i + match]] > 1:
                gone[i : i + match] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check_removal(spark, make, texts, match):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeated(make(spark, texts), match=match).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, match)


def test_removal_matches_brute_force(spark, make, odd_texts):
    check_removal(spark, make, odd_texts, 200)
    check_removal(spark, make, odd_texts, 50)


def test_removal_over_many_shards_and_pieces(spark, make, odd_texts, monkeypatch):
    """Anchors in several shards, small pieces of texts: the same result."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdef ") for _ in range(260))
    noise = lambda n: "".join(rng.choice("uvwxyz ") for _ in range(n))
    texts = odd_texts + [noise(150) + passage[rng.randint(0, 40) :] + noise(150) for _ in range(60)]
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "PIECE", 301)
    check_removal(spark, make, texts, 200)


def test_removal_small_tables(spark, make):
    assert substring_dedup.remove_repeated(make(spark, [])).collect() == []
    rows = substring_dedup.remove_repeated(make(spark, ["a" * 201, None, ""])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(0, 0, 0), (0, 0, 0), (201, 201, 1)]
    twice = substring_dedup.remove_repeated(make(spark, ["the same " * 40, "the same " * 40, "z" * 10], [7, 7, 8])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(7, 360), (7, 360), (8, 0)]
