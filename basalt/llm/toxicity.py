"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid
from .codes import Pieces, by_bytes, folded_pieces
from .common import crc_fold, materialize

#: Bits of a word's hash; the embedding's width, filter widths, filters of each width.
HASH_BITS, DIM, WIDTHS, FILTERS = 22, 16, (1, 2, 3), 16
#: Buckets with words in fewer texts, of each so many that train, share one embedding, as have buckets never seen.
LEAST_TEXTS, TEXTS_EACH = 3, 700
#: Labelled documents that the model learns from, at most, and the words that it sees of all of them together.
MOST_TRAINING, MOST_WORDS = 8000, 8_000_000
#: Steps of training and texts in each; passes over the texts, at least and at most; passes without gain that end it.
STEPS, BATCH, EPOCHS, PATIENCE = 3000, 16, (6, 40), 6
#: Rates of the embeddings (plain gradient) and of all else (Adam), decay of the embeddings, words left out of a step.
EMBED_RATE, RATE, DECAY, DROPOUT = 6.0, 5e-3, 2e-3, 0.5
#: How much of the running average of all weights a step keeps.
AVERAGE = 0.998
#: Words whose filter outputs are in memory at a time.
PIECE_WORDS = 1 << 16
#: Score at which a text counts as toxic.
THRESHOLD = 0.7
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _word_sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, sum) of each run of letters, marks and digits.

    The sum is that of the run's code points times powers of an odd number, from the first power on: a difference of
    running sums, shifted back by the inverse power.  So it depends on the run alone, and sums of two parts add up.
    """
    n = len(points)
    power = np.cumprod(np.full(n, _BASE, np.uint64))
    back = np.cumprod(np.full(n, np.uint64(_inverse(int(_BASE))), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points.astype(np.uint64) * power)])
    edge = np.diff(np.concatenate([[0], (points > 0).astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return a, b, (sums[b] - sums[a]) * back[a]


def _bucket(sums: np.ndarray) -> np.ndarray:
    h = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int32)


class Words:
    """The buckets of the words of texts whose cuts come in order; a word may go over from one cut to the next."""

    def __init__(self, rows: int) -> None:
        self.parts: list[np.ndarray] = []
        self.counts = np.zeros(rows, np.int64)
        self.open: tuple[int, int, int] | None = None  # row, sum and length of a word that its cut did not end

    def _close(self) -> None:
        if self.open:
            self.parts.append(_bucket(np.array([self.open[1]], np.uint64)))
            self.counts[self.open[0]] += 1
            self.open = None

    def add(self, cuts: Pieces) -> None:
        points = cuts.points.copy()
        place = np.arange(len(points)) - np.repeat(cuts.offsets[:-1], np.diff(cuts.offsets))
        points[place >= np.repeat(cuts.own, np.diff(cuts.offsets))] = 0
        a, b, sums = _word_sums(points)
        lengths, stop, last = b - a, len(a), len(cuts.rows) - 1
        if self.open and (not stop or a[0] > 0):
            self._close()
        elif self.open:  # the first word goes on
            _, so_far, length = self.open
            sums[0] = np.uint64((so_far + int(sums[0]) * pow(int(_BASE), length, 1 << 64)) & ((1 << 64) - 1))
            lengths[0] += length
            self.open = None
        # Only the last cut can leave its text unfinished; the 0 after a text's last cut is the cut's own.
        end = cuts.offsets[last] + cuts.own[last]
        if stop and b[-1] == end and end < cuts.offsets[last + 1]:
            stop -= 1
            self.open = (int(cuts.rows[last]), int(sums[-1]), int(lengths[-1]))
        self.parts.append(_bucket(sums[:stop]))
        cut = np.searchsorted(cuts.offsets, a[:stop], "right") - 1
        self.counts += np.bincount(cuts.rows[cut], minlength=len(self.counts))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each word, offsets of words by text)."""
        self._close()
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(self.counts)])


def word_ids(column) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, offsets of words by text) of an Arrow string column."""
    words = Words(len(column))
    for cuts in folded_pieces(column):
        words.add(cuts)
    return words.result()


@dataclass
class Net:
    """Embeddings, filters, output weights; what Adam remembers of each.

    ``row`` gives a bucket's row of the embeddings: 0 for those that share one, the last row is padding.
    """

    params: dict[str, np.ndarray]
    row: np.ndarray
    seen: dict[str, list] = field(default_factory=dict)

    @classmethod
    def new(cls, texts: list[np.ndarray], seed: int) -> Net:
        """Small random weights; labels have no part in them."""
        rng = np.random.default_rng(seed)
        among = np.zeros(1 << HASH_BITS, np.int32)
        for t in texts:
            among[np.unique(t)] += 1
        used = np.flatnonzero(among >= max(LEAST_TEXTS, len(texts) // TEXTS_EACH))
        row = np.zeros(1 << HASH_BITS, np.int32)
        row[used] = np.arange(1, len(used) + 1)
        p = {"E": rng.normal(0, 0.02, (len(used) + 2, DIM)), "o": rng.normal(0, 0.3, FILTERS * len(WIDTHS)), "b": np.full(1, -2.0)}
        p["E"][0], p["E"][-1] = 0, 0
        for w in WIDTHS:
            p[f"W{w}"] = rng.normal(0, (DIM * w) ** -0.5, (w, DIM, FILTERS))
            p[f"c{w}"] = np.zeros(FILTERS)
        return cls({k: v.astype(np.float32) for k, v in p.items()}, row)

    def activations(self, words: np.ndarray, width: int) -> np.ndarray:
        """Filter outputs at each word; the words are padded so that a filter may run over the end."""
        e = self.params["E"]
        n = len(words) - width + 1
        out = np.tile(self.params[f"c{width}"], (n, 1))
        for k in range(width):
            out += e[words[k : k + n]] @ self.params[f"W{width}"][k]
        return out

    def pooled(self, words: np.ndarray, offsets: np.ndarray, where: bool = False, count: np.ndarray | None = None):
        """Each text's largest output of each filter, at least 0; with ``where``, also the word it comes from.

        With ``count``, only filters that start at a text's first ``count`` words are taken.
        """
        n = len(offsets) - 1
        most = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        arg = np.full(most.shape, -1, np.int64)
        pad = max(WIDTHS) - 1
        # Texts are parted by padding, so that no filter reads two of them.
        sizes = np.diff(offsets)
        last = len(self.params["E"]) - 1
        spread = np.full(len(words) + pad * n, last, np.int32)
        starts = offsets[:-1] + pad * np.arange(n)
        spread[np.arange(len(words)) + pad * np.repeat(np.arange(n), sizes)] = self.row[words]
        full = np.flatnonzero(sizes > 0)
        if len(full):
            for f, w in enumerate(WIDTHS):
                z = self.activations(np.append(spread, np.full(pad, last, np.int32)), w)
                cut = slice(f * FILTERS, (f + 1) * FILTERS)
                # The stretch up to the next text holds its padding, which only repeats the ends of the text.
                bounds = np.stack([starts[full], starts[full] + (sizes if count is None else count)[full]], 1).ravel()
                best = np.maximum.reduceat(z, bounds, axis=0)[::2]
                most[full, cut] = np.maximum(best, 0)
                if where:
                    for r, a, m in zip(full.tolist(), starts[full].tolist(), sizes[full].tolist(), strict=True):
                        arg[r, cut] = z[a : a + m].argmax(0) + a
        return (most, arg, spread) if where else most

    def pieces(self, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Cuts (text, start, end, end with what filters read beyond) of about PIECE_WORDS words, in order."""
        reach = max(WIDTHS) - 1
        out = []
        for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for at in range(a, b, PIECE_WORDS):
                to = min(b, at + PIECE_WORDS)
                out.append((r, at, to, min(b, to + reach)))
        return out

    def score(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text; PIECE_WORDS words are in work at a time, and a longer text takes the largest of its pieces."""
        most = np.zeros((len(offsets) - 1, FILTERS * len(WIDTHS)), np.float32)
        held: list[tuple[int, int, int, int]] = []

        def flush():
            sizes = [e - a for _, a, _, e in held]
            own = np.concatenate([words[a:e] for _, a, _, e in held])
            got = self.pooled(own, np.concatenate([[0], np.cumsum(sizes)]), count=np.array([b - a for _, a, b, _ in held]))
            np.maximum.at(most, [r for r, *_ in held], got)
            held.clear()

        gathered = 0
        for cut in self.pieces(offsets):
            held.append(cut)
            gathered += cut[3] - cut[1]
            if gathered >= PIECE_WORDS:
                flush()
                gathered = 0
        if held:
            flush()
        z = most @ self.params["o"] + self.params["b"]
        return 1.0 / (1.0 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def step(self, words: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step on the weighted logistic loss; only the pooled places have a gradient.

        Embeddings go down the plain gradient and decay, so that a word counts by the texts that it tells apart; a rate
        that adapts to each word would move rare ones as far as frequent ones.
        """
        p = self.params
        most, arg, spread = self.pooled(words, offsets, where=True)
        last = len(p["E"]) - 1
        spread = np.append(spread, np.full(max(WIDTHS), last, np.int32))
        z = most @ p["o"] + p["b"]
        g = (weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / weight.sum()).astype(np.float32)
        grads = {"o": most.T @ g, "b": g.sum(keepdims=True)}
        down = np.where(most > 0, g[:, None] * p["o"], 0).astype(np.float32)
        rows, vecs = [], []
        for f, w in enumerate(WIDTHS):
            cut = slice(f * FILTERS, (f + 1) * FILTERS)
            d, at = down[:, cut], arg[:, cut]
            live = (d != 0) & (at >= 0)
            r, c = np.nonzero(live)
            d, at = d[r, c], at[r, c]
            grads[f"c{w}"] = np.bincount(c, d, FILTERS).astype(np.float32)
            gw = np.zeros_like(p[f"W{w}"])
            for k in range(w):
                ids = spread[at + k]
                e = p["E"][ids]
                np.add.at(gw[k].T, c, d[:, None] * e)
                rows.append(ids)
                vecs.append(d[:, None] * p[f"W{w}"][k][:, c].T)
            grads[f"W{w}"] = gw
        ids, back = np.unique(np.concatenate(rows), return_inverse=True)
        ge = np.zeros((len(ids), DIM), np.float32)
        np.add.at(ge, back, np.concatenate(vecs))
        for k, grad in grads.items():
            self._adam(k, slice(None), grad)
        keep = (ids > 0) & (ids < last)
        p["E"] *= np.float32(1 - DECAY)
        p["E"][ids[keep]] -= np.float32(EMBED_RATE) * ge[keep]

    def _adam(self, k, at, grad) -> None:
        if k not in self.seen:
            self.seen[k] = [np.zeros_like(self.params[k]), np.zeros_like(self.params[k]), 0]
        m, v, t = self.seen[k]
        t = self.seen[k][2] = t + 1
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad**2
        self.params[k][at] -= RATE * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.999**t)) + 1e-8)


@dataclass(frozen=True)
class Classifier:
    """The net, the language model, and a threshold on the net's output for each language (the last for none)."""

    net: Net
    langs: langid.Model | None
    thresholds: np.ndarray

    def read(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word buckets, offsets, language) of texts that are folded once for both."""
        words = Words(len(column))
        logits = self.langs.start(len(column)) if self.langs else np.zeros((len(column), 1))
        for cuts in folded_pieces(column):
            words.add(cuts)
            if self.langs:
                self.langs.add(logits, cuts)
        return *words.result(), logits.argmax(1)

    def score(self, column) -> np.ndarray:
        """Calibrated: the threshold of the text's language, as read from the text, lies at THRESHOLD."""
        words, at, lang = self.read(column)
        p, t = self.net.score(words, at), self.thresholds[lang]
        return np.where(p < t, THRESHOLD * p / t, THRESHOLD + (1 - THRESHOLD) * (p - t) / (1 - t))


def train(texts: list[np.ndarray], y: np.ndarray, held: list[np.ndarray], held_y: np.ndarray, seed: int = 5) -> Net:
    """Learns from the word buckets of texts and their labels, from small random weights on.

    Labels are weighed so that both have a like share.  Each step leaves out words at random.  What counts is the running
    average of the weights, after the pass with the least loss on ``held``.
    """
    net, rng = Net.new(texts, seed), np.random.default_rng(seed)
    share = max(1, int(y.sum())) / max(1, len(y))
    weight = np.where(y > 0, min(10.0, 0.5 / max(share, 1e-3)), 1.0)
    mean = Net({k: v.copy() for k, v in net.params.items()}, net.row)
    best, kept, since, steps = np.inf, mean.params, 0, 0
    flat, at = np.concatenate(held), np.concatenate([[0], np.cumsum([len(t) for t in held])])
    for _ in range(int(np.clip(STEPS * BATCH // max(1, len(texts)), *EPOCHS))):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            take = order[lo : lo + BATCH]
            left = [texts[i][rng.random(len(texts[i])) >= DROPOUT] for i in take]
            net.step(np.concatenate(left), np.concatenate([[0], np.cumsum([len(t) for t in left])]), y[take], weight[take])
            steps += 1
            part = np.float32(1 - min(AVERAGE, steps / (steps + 10)))
            for k, v in net.params.items():
                mean.params[k] += part * (v - mean.params[k])
        p = np.clip(mean.score(flat, at), 1e-6, 1 - 1e-6)
        loss = -(np.where(held_y > 0, np.log(p), np.log(1 - p)) * np.where(held_y > 0, weight.max(), 1.0)).mean()
        since += 1
        if loss < best:
            best, kept, since = loss, {k: v.copy() for k, v in mean.params.items()}, 0
        elif since >= PATIENCE:
            break
    return Net(kept, net.row)


def best_threshold(p: np.ndarray, y: np.ndarray, fall_back: float) -> float:
    """The cut with the best F1, in the middle of the gap around it; ``fall_back`` with too few rows of a label."""
    if y.sum() < 8 or (y == 0).sum() < 8:
        return fall_back
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = np.flatnonzero(f1 == f1.max())[0]
    low = p[order[best + 1]] if best + 1 < len(y) else 0.0
    return float(np.clip((p[order[best]] + low) / 2, 0.05, 0.95))


def _words(langs):
    """Rows (doc_id, text, toxic) to (doc_id, words as bytes, toxic, language as the model reads it)."""

    def work(batches):
        import pyarrow as pa

        reader = Classifier(None, langs.value, None)
        for batch in by_bytes(batches):
            words, at, lang = reader.read(batch.column(1))
            out = [words[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2), pa.array(lang, pa.int32())], ["doc_id", "words", "toxic", "lang"])

    return work


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_TRAINING, most_words: int = MOST_WORDS
) -> Classifier | None:
    """Learns from labelled rows outside fold 1, a seeded sample of at most ``most`` if there are more.

    Rows with a null label are left out.  Of six sampled texts four train the net, one says which pass over them counts,
    and one sets the thresholds by the language that the language model reads from the text; with very few labels, all do
    all.  The sampled texts reach the driver as word buckets.  In the seeded order of their ids, each text is taken that
    fits into what is left of ``most_words`` words; whole texts, never parts.  None without both labels.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("toxic").isin(0, 1) & (crc_fold(F.col("_id")) != 1))
    marked = marked.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    marked = materialize(langid.bounded_sample(marked, "_id", most, seed=13), "toxic-labels")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = rows.join(F.broadcast(marked), F.col("doc_id") == F.col("_id"))  # at most ``most`` labels
    sample = sample.where(F.col("text").isNotNull()).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")
    lang_model = langid.fit(docs, id_col, text_col, lang_col)
    langs = docs.sparkSession.sparkContext.broadcast(lang_model)
    sample = materialize(sample.mapInArrow(_words(langs), "doc_id long, words binary, toxic int, lang int"), "toxic-sample")
    sizes = sample.select("doc_id", (F.octet_length("words") / 4).cast("long").alias("n")).orderBy(F.xxhash64("doc_id")).collect()
    left, taken = most_words, []
    for r in sizes:  # at most ``most`` rows
        if r.n <= left:
            left -= r.n
            taken.append(r.doc_id)
    if len(taken) < len(sizes):
        sample = sample.where(F.col("doc_id").isin(taken))
    got = sample.orderBy(F.xxhash64("doc_id")).collect()
    y = np.array([r.toxic for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    texts = [np.frombuffer(r.words, np.int32) for r in got]
    lang = np.array([r.lang for r in got])
    part = np.arange(len(y)) % 6
    stop, check = part == 0, part == 1
    if min(y[stop].sum(), y[check].sum(), y[~stop & ~check].sum()) < 1:  # too few to set some aside
        stop, check, teach = [np.ones(len(y), bool)] * 3
    else:
        teach = ~stop & ~check
    pick = lambda mask: [t for t, m in zip(texts, mask, strict=True) if m]
    net = train(pick(teach), y[teach], pick(stop), y[stop])
    p = np.concatenate([net.score(t, np.array([0, len(t)])) for t in pick(check)])
    overall = best_threshold(p, y[check], 0.5)
    kinds = len(lang_model.langs) if lang_model else 1
    cuts = [best_threshold(p[lang[check] == k], y[check][lang[check] == k], overall) for k in range(kinds)]
    return Classifier(net, lang_model, np.array(cuts))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_training: int = MOST_TRAINING) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    Whole texts are scored by the net; the score is bent so that the threshold of the text's language, which is
    read from the text, lies at THRESHOLD, and ``predicted`` is 1 from there on.  Labels, language, source and id
    are no inputs of a score.  The model that is broadcast is bounded: a number for each of 2^HASH_BITS buckets,
    embeddings for the buckets that MOST_WORDS words can reach, and the language table.

    Null texts count as empty and get the score of a text without words.  Rows of fold 1 and unlabelled rows are
    not learned from; a null id counts as fold 0.  Of several labels for an id the largest counts.  Without rows
    of both labels to learn from, every score is 0.  An empty table gives an empty result.  Other columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col, lang_col, most_training)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(crc_fold(F.col("doc_id")), F.lit(0)) == 1)

    def work(batches):
        import pyarrow as pa

        for batch in by_bytes(batches):
            score = held.value.score(batch.column(1)) if held.value else np.zeros(batch.num_rows)
            called = (score >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array(called)], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_training: int = MOST_TRAINING) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    model = fit(docs, labels, id_col, text_col, lang_col, most_training)
    if model is None:
        return docs
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batches):
        import pyarrow as pa

        for batch in by_bytes(batches, column=at):
            yield batch.filter(pa.array(held.value.score(batch.column(at)) < THRESHOLD))

    return docs.mapInArrow(work, docs.schema)
