"""Content-hash identifiers: BLAKE2b over text, computed on Arrow batches.

Spark has no BLAKE2, so the digest itself is a pandas UDF; prefixes, separators and null rules stay native.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What joins the parts of an id, and what stands for a null part.
PART_SEPARATOR = "\x1f"
NULL_SENTINEL = "__NULL__"


def blake64(value: str) -> int:
    """64 bits of BLAKE2b, big-endian, without the top bit."""
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big") & 0x7FFFFFFFFFFFFFFF


def blake128(value: str) -> str:
    return hashlib.blake2b(value.encode(), digest_size=16).hexdigest()


@F.pandas_udf(T.LongType())
def _hash64(values: pd.Series) -> pd.Series:
    return values.map(blake64, na_action="ignore").astype("Int64")


@F.pandas_udf(T.StringType())
def _hash128(values: pd.Series) -> pd.Series:
    return values.map(blake128, na_action="ignore")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _prefix(p: Column | str) -> Column:
    return F.lit(p) if isinstance(p, str) else p


def stable_hash64(value: Column | str) -> Column:
    """Null stays null."""
    return _hash64(_text(value))


def stable_hash128(value: Column | str) -> Column:
    return _hash128(_text(value))


def prefixed_hash64(prefix: Column | str, value: Column | str) -> Column:
    """``prefix:`` and the decimal hash; null if either is."""
    return F.concat(_prefix(prefix), F.lit(":"), stable_hash64(value).cast("string"))


def stable_id(prefix: Column | str, value: Column | str) -> Column:
    """``prefix:`` and the 128-bit hash; null if either is."""
    return F.concat(_prefix(prefix), F.lit(":"), stable_hash128(value))


def joined_parts(*parts: Column | str) -> Column:
    """Parts as text with nulls spelled out, joined by the separator."""
    return F.concat_ws(PART_SEPARATOR, *[F.coalesce(_text(p), F.lit(NULL_SENTINEL)) for p in parts])


def stable_id_parts(prefix: Column | str, *parts: Column | str) -> Column:
    """An id over several parts; null parts count, a null prefix gives null."""
    return F.concat(_prefix(prefix), F.lit(":"), _hash128(joined_parts(*parts)))


def prefixed_hash_parts64(prefix: Column | str, *parts: Column | str) -> Column:
    return F.concat(_prefix(prefix), F.lit(":"), _hash64(joined_parts(*parts)).cast("string"))


def span_id(prefix: Column | str, *parts: Column | str) -> Column:
    return stable_id_parts(prefix, *parts)


def stable_hash_any(value: Column | str, canonical: bool = True, null_sentinel: str = NULL_SENTINEL) -> Column:
    """128-bit hash of the value as text; never null.  ``canonical`` normalises to NFKC and trims first."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        values = values.fillna(null_sentinel)
        if canonical:
            values = values.map(lambda v: unicodedata.normalize("NFKC", v).strip())
        return values.map(blake128)

    return digest(_text(value))
