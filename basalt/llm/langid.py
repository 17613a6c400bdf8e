"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import Pieces, by_bytes, folded_pieces, sum_by
from .common import crc_fold, materialize

#: Code points in an n-gram, and buckets for all n-grams.
ORDERS, BUCKETS = (1, 2, 3), 1 << 16
#: Documents that the model learns from, at most; a seeded sample by language when there are more.
MOST_TRAINING = 8000
#: Languages that are learned, at most.
MOST_LANGS = 1000
#: Added to each count.
SMOOTH = 0.05
_MUL = np.uint32(0x9E3779B1)


def ngram_buckets(cuts: Pieces):
    """Yields, for each order, the bucket of the n-gram that starts at each point of the cuts' own, BUCKETS for none.

    White space, punctuation and symbols all count as one mark, and so do runs of them.
    """
    points, offsets = cuts.points, cuts.offsets
    place = np.arange(len(points)) - np.repeat(offsets[:-1], np.diff(offsets))
    beyond = place >= np.repeat(cuts.own, np.diff(offsets))
    for n in ORDERS:
        h = np.full(len(points), np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF))
        for k in range(n):
            h[: len(points) - k] = (h[: len(points) - k] ^ points[k:]) * _MUL
            h ^= h >> np.uint32(15)
        at = (h >> np.uint32(16)).astype(np.int32)
        if n == 1:
            at[points == 0] = BUCKETS
        else:  # only n-grams inside a text, and not of two marks
            for k in range(n - 1):
                at[offsets[1:] - 1 - k] = BUCKETS
            at[:-1][(points[:-1] == 0) & (points[1:] == 0)] = BUCKETS
        at[beyond] = BUCKETS
        yield at


@dataclass(frozen=True)
class Model:
    """Languages, and log probabilities of buckets (rows; the last is zeros) by language."""

    langs: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray

    def add(self, out: np.ndarray, cuts: Pieces) -> None:
        """Adds the cuts' log likelihoods to their texts' rows: a sparse row of n-grams times the table."""
        for at in ngram_buckets(cuts):
            np.add.at(out, cuts.rows, sum_by(self.table[at], cuts.offsets))

    def start(self, n: int) -> np.ndarray:
        return np.tile(self.prior, (n, 1))

    def logits(self, column) -> np.ndarray:
        """Log likelihood of each text, by language; a long text is read in pieces."""
        out = self.start(len(column))
        for cuts in folded_pieces(column):
            self.add(out, cuts)
        return out

    def predict(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its posterior probability)."""
        out = self.logits(column)
        out -= out.max(1, keepdims=True)
        best = out.argmax(1)
        return best, 1.0 / np.exp(out).sum(1)


def _place(id_col: str, seed: int):
    """A seeded random number below 1 for each id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, id_col: str, most: int, seed: int = 11) -> DataFrame:
    """A seeded sample by id of about ``most`` rows, or all if there are no more."""
    n = rows.count()
    return rows if n <= most else rows.where(_place(id_col, seed) < most / n)


def share_each(counts: list[int], most: int) -> float:
    """How many rows each language may give so that all give ``most``: those that have fewer give all."""
    left = float(most)
    for k, n in enumerate(sorted(counts)):
        each = left / (len(counts) - k)
        if n > each:
            return each
        left -= n
    return float(max(counts))


def _counts(batches):
    """(lang, bucket, n) of the texts of a task."""
    import pyarrow as pa

    held: dict[str, np.ndarray] = {}
    for batch in by_bytes(batches):
        langs = np.array(batch.column(2).to_pylist(), object)
        for cuts in folded_pieces(batch.column(1)):
            own = np.repeat(langs[cuts.rows], np.diff(cuts.offsets))
            for at in ngram_buckets(cuts):
                for lang in set(langs[cuts.rows].tolist()):
                    total = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    total += np.bincount(at[own == lang], minlength=BUCKETS + 1)
    for lang, total in held.items():
        full = np.flatnonzero(total[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], ["lang", "bucket", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_TRAINING) -> Model | None:
    """Learns from rows outside fold 1 that have a language and a text; None if there are none.

    If there are more than ``most``, a seeded sample is learned from in which rare languages keep all their rows and the
    others share the rest alike; the prior is that of all rows.  The MOST_LANGS most frequent languages are learned.  What
    comes to the driver is a count for each language, and one for each language and bucket.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((F.coalesce(crc_fold(F.col("doc_id")), F.lit(0)) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not per:
        return None
    each = share_each([r.n for r in per], most)
    rate = docs.sparkSession.createDataFrame([(r.lang, min(1.0, each / r.n)) for r in per], "known string, rate double")
    sample = rows.join(F.broadcast(rate), F.col("lang") == F.col("known")).where(_place("doc_id", 11) < F.col("rate"))  # MOST_LANGS rows
    sample = materialize(sample.select("doc_id", "text", "lang"), "langid-sample")
    counts = sample.coalesce(8).mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(r.lang for r in per))
    place = {lang: k for k, lang in enumerate(langs)}
    table = np.full((BUCKETS + 1, len(langs)), SMOOTH)
    if len(counts):
        table[counts["bucket"].to_numpy(), counts["lang"].map(place).to_numpy()] += counts["n"].to_numpy()
    table = np.log(table) - np.log(table[:BUCKETS].sum(0))
    table[BUCKETS] = 0
    size = np.zeros(len(langs))
    size[[place[r.lang] for r in per]] = [r.n for r in per]
    return Model(langs, np.log(size / size.sum()), table.astype(np.float32))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_training: int = MOST_TRAINING) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is a language that was learned, or ``und`` for a null text and one without a letter; ``score`` is its
    posterior probability, 0 for ``und``.  Whole texts are scored; id, source and language are no inputs.  The table
    of log probabilities, BUCKETS x languages, is broadcast.

    Rows of fold 1 (crc32 of the id as text, modulo 3) and rows without a language are not learned from; a null id
    counts as fold 0.  Without rows to learn from, all are ``und``.  An empty table gives an empty result.
    """
    model = fit(docs, id_col, text_col, lang_col, most_training)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fold = F.coalesce(crc_fold(F.col("doc_id")), F.lit(0)) == 1
    rows = rows.withColumn("held_out", fold).withColumn("known", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        for batch in by_bytes(batches):
            known = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), bool)
            if held.value is None:
                best, score, names = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.array(["und"], object)
            else:
                best, score = held.value.predict(batch.column(1))
                names = np.array(held.value.langs, object)
            lang, score = np.where(known, names[best], "und"), np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")
