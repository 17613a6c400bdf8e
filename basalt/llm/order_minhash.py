"""Order MinHash: minimal occurrence-numbered k-mers, kept in text order and hashed as tuples."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import by_bytes

#: Code points in a k-mer, k-mers in a tuple, tuples in a signature.
KMER, TUPLE, SKETCHES = 8, 2, 32
#: Columns of the (sketch x k-mer) table that are in work at a time.
BLOCK = 1 << 15
#: k-mers that are in work at a time; those of a longer text are taken in turns, by the first bits of their hash.
MOST_KMERS = 1 << 21
#: Most ranges of ids; their lower bounds are sent to every task, so 8 bytes each bound the broadcast.  With more rows
#: than ranges x ``rows_each`` the ranges grow; a task streams its range, so its memory does not.
MOST_RANGES = 100_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:SKETCHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[SKETCHES:] >> np.uint64(32)).astype(np.uint32)


_MUL, _ADD = _permutations()


def kmer_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each k-mer of code points; a shorter text is one k-mer."""
    h = mix64(points.astype(np.uint64) + np.uint64(1))
    width = 1
    while width < KMER and len(h) > width:  # doubling: 8 is a power of two
        h = mix64(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
        width *= 2
    if width < KMER and len(h) > 1:
        h = h[:1] * np.uint64(31) + h[-1:]
    return h


def numbered(h: np.ndarray) -> np.ndarray:
    """Each k-mer's hash mixed with how often it has occurred before in the text."""
    n = len(h)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    keys = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
    pos = (keys & low).astype(np.int64)
    group = keys >> bits
    new = np.concatenate([[True], group[1:] != group[:-1]])
    if new.all():
        return h
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    if (h[pos] != h[pos[first]]).any():  # different k-mers whose hashes begin alike
        pos = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[pos[1:]] != h[pos[:-1]]])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    out = h.copy()
    again = ~new
    out[pos[again]] = mix64(h[pos[again]] + (np.arange(n) - first)[again].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def _kmers(text: str, turn: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the text's k-mers whose hash starts with the bits of ``turn``, in text order."""
    found, places = [], []
    step = MOST_KMERS if bits else len(text)
    for at in range(0, max(1, len(text) - KMER + 1), step):
        points = np.frombuffer(text[at : at + step + KMER - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = kmer_hashes(points)
        own = np.flatnonzero(h >> np.uint64(64 - bits) == turn) if bits else np.arange(len(h))
        found.append(h[own])
        places.append(own + at)
    return np.concatenate(found), np.concatenate(places)


def signature(text: str) -> np.ndarray:
    """SKETCHES hashes of 32 bits; zeros for the empty text.

    Equal k-mers fall in the same turn, so their numbers do not depend on the turns, and neither do the minima.
    """
    if not text:
        return np.zeros(SKETCHES, np.uint32)
    bits = max(0, (len(text) // MOST_KMERS).bit_length())
    rows = np.arange(SKETCHES)
    value, place, chosen = np.zeros((SKETCHES, 0), np.uint32), np.zeros((SKETCHES, 0), np.int64), np.zeros((SKETCHES, 0), np.uint64)
    for turn in range(1 << bits):
        h, where = _kmers(text, turn, bits)
        if not len(h):
            continue
        h = numbered(h)
        small = (h >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(small), BLOCK):
            part = small[None, at : at + BLOCK] * _MUL[:, None] + _ADD[:, None]
            for _ in range(min(TUPLE, part.shape[1])):
                best = part.argmin(1)
                value = np.concatenate([value, part[rows, best][:, None]], 1)
                place = np.concatenate([place, where[best + at][:, None]], 1)
                chosen = np.concatenate([chosen, h[best + at][:, None]], 1)
                part[rows, best] = np.uint32(0xFFFFFFFF)
            if value.shape[1] > TUPLE:  # the smallest values, of equal ones the first places
                keep = np.lexsort((place, value))[:, :TUPLE]
                value, place, chosen = (np.take_along_axis(x, keep, 1) for x in (value, place, chosen))
    chosen = np.take_along_axis(chosen, np.argsort(place, 1), 1)  # in text order
    out = np.full(SKETCHES, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(chosen.shape[1]):
        out = mix64(out * np.uint64(3) + chosen[:, k])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuple hashes."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by as many from the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def id_ranges(docs: DataFrame, id_col: str, each: int) -> list:
    """Lower bounds of ranges of about so many rows: the smallest id of each, ascending.  At most MOST_RANGES."""
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    n = ids.count()
    parts = min(MOST_RANGES, max(1, -(-n // each)))
    cuts = [k / parts for k in range(1, parts)]
    found = ids.agg(F.percentile_approx("i", cuts, F.lit(10 * parts)).alias("q"), F.min("i").alias("lo")).first() if cuts else None
    bounds = sorted({*(found.q or [])} - {found.lo}) if found else []
    if not bounds:
        return []
    own = ids.where("i is not null").groupBy(_range_of(F.col("i"), bounds).alias("k")).agg(F.min("i").alias("lo"))
    return [r.lo for r in own.orderBy("k").collect()][1:]


def _range_of(column, bounds: list):
    """Which range an id lies in; null ids lie in the first, as they sort first."""
    at = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(at, ids[known].to_numpy(np.int64), "right")
        return pd.Series(out)

    return find(column)


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 2000) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the start of the next document's text, by ascending id; after the last comes the
    first.  Fingerprints are SKETCHES x 8 hex digits; equal texts have equal ones.  ``near_*`` is the share of
    equal tuples, from 0 to 1.

    Ids alone give the bounds of ranges of rows.  Each range's documents go to one task, and the first document
    of a range goes to the range before too, so every document meets the next one after a single shuffle of the
    texts.  A task streams its sorted rows and holds two texts.

    Null texts count as empty: their fingerprint is zeros, as like another empty text as can be.  Null ids come
    first.  Rows that repeat an id follow one another in the order of their texts' hashes.  A single document
    is its own next.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bounds = id_ranges(docs, id_col, rows_each)
    last = len(bounds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    first_id = rows.agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).first()
    if first_id[0] is None and not first_id[1]:
        return spark.createDataFrame([], _SCHEMA)
    rows = rows.withColumn("k", _range_of(F.col("doc_id"), bounds)).withColumn("tie", F.xxhash64("text"))
    opens = _opens(F.col("doc_id"), bounds) if bounds else F.lit(False)
    start = F.col("doc_id").isNull() if first_id[1] else F.col("doc_id") == F.lit(first_id[0])
    to = F.array(F.struct(F.col("k").alias("k"), F.lit(0).alias("guest")))
    to = F.when(opens, F.concat(to, F.array(F.struct((F.col("k") - 1).alias("k"), F.lit(1).alias("guest"))))).otherwise(to)
    to = F.when(start, F.concat(to, F.array(F.struct(F.lit(last).alias("k"), F.lit(1).alias("guest"))))).otherwise(to)
    dealt = rows.withColumn("to", F.explode(to)).select("to.k", "to.guest", "doc_id", "tie", "text")
    dealt = dealt.repartition(max(1, last + 1), "k").sortWithinPartitions("k", "guest", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.mapInArrow(_pairs, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _opens(column, bounds: list):
    known = np.array(bounds, np.int64)

    @F.pandas_udf("boolean")
    def find(ids: pd.Series) -> pd.Series:
        return ids.isin(known)

    return find(column)


def _pairs(batches):
    """Each document with the row after it in its range; guests only follow."""
    import pyarrow as pa

    held = None  # (range, id, text, signature) of the document that waits for its next
    lone = None  # the range whose guest has already been met
    for batch in by_bytes(batches, column=4):
        out: list[list] = [[] for _ in range(7)]
        ks, guests, ids, _, texts = (c.to_pylist() for c in batch.columns)
        for k, guest, doc_id, text in zip(ks, guests, ids, texts, strict=True):
            if guest and (held is None or held[0] != k or lone == k):
                continue
            sig = signature(text)
            if held is not None and held[0] == k:
                new = edited(held[2], text)
                own, other = held[3], signature(new)
                row = (held[1], len(held[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(own, other), likeness(own, sig))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            if guest:
                lone, held = k, None
            else:
                held = (k, doc_id, text, sig)
        if out[0]:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [c.split()[0] for c in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
