from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, c long, v long, fp string, k int, n int"


def frame(spark, texts, ids=None, source=None):
    """Documents with extra columns whose names clash with names that the operators use inside."""
    rows = [
        (ids[i] if ids else i, t, None, source[i] if source else None, len(t) if t else None, "x", 1, 2, "y", 3, 4)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def make():
    return frame


@pytest.fixture(scope="session")
def odd_texts():
    """Copies, near copies, shared passages, empty, null, very long, non-ASCII."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    base = [say(rng.randint(5, 120)) for _ in range(14)]
    texts = [*base, base[0], base[0], base[1].replace(" ", "\n"), base[1] + "  ", base[2] + " extra", "X" + base[3]]
    texts += [say(30) + " " + passage + " " + say(20) for _ in range(3)] + [passage, passage]
    texts += ["", None, None, " \t\n", "ab", "ab" * 300, "ab" * 300 + "c", "é" * 250, "日本語のテキスト" * 40, say(3000), "a\x00b " * 80]
    near = base[5].split()
    for i in range(6):
        w = list(near)
        w[i * 3 % len(w)] = "changed"
        texts.append(" ".join(w))
    return texts
