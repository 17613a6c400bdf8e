"""Text normalisation, and the built-in functions whose semantics differ from Spark's."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII = "^[\\x00-\\x7F]*$"
_SPACE = re.compile(r"\s+")


def normalize_text(value: str, form: str, casefold: bool, collapse: bool) -> str | None:
    value = unicodedata.normalize(form, value.strip())
    value = value.lower() if casefold else value
    value = _SPACE.sub(" ", value) if collapse else value
    return value or None


def utf8_normalize(value: Column, form: str = "NFKC", casefold: bool = True, collapse_ws: bool = True) -> Column:
    """Trim, Unicode form, lower case, one space for a run of white space; an empty result is null.

    ASCII texts, where normal forms change nothing, take native expressions; only others go through Arrow.
    """

    @F.pandas_udf("string")
    def unicode_form(values: pd.Series) -> pd.Series:
        return values.map(lambda v: normalize_text(v, form, casefold, collapse_ws), na_action="ignore")

    ascii_form = F.regexp_replace(value, r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    ascii_form = F.lower(ascii_form) if casefold else ascii_form
    ascii_form = F.regexp_replace(ascii_form, r"[\s\x1C-\x1F]+", " ") if collapse_ws else ascii_form
    plain = value.rlike(_ASCII)
    return F.when(plain, F.nullif(ascii_form, F.lit(""))).otherwise(unicode_form(F.when(~plain, value)))


def utf8_null_if_blank(value: Column) -> Column:
    """The trimmed value, or null if nothing is left."""
    return F.nullif(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), F.lit(""))


def qname_normalize(symbol: Column, module: Column | None = None) -> Column:
    """A normalised qualified name: a dotted symbol as it is, else after its module; null for a blank symbol."""
    name = utf8_normalize(symbol)
    if module is None:
        return name
    owner = utf8_normalize(module)
    return F.when(name.contains(".") | owner.isNull(), name).otherwise(F.concat(owner, F.lit("."), name))


def concat(*parts: Column) -> Column:
    """Null parts count as empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _shifted(text: str, mark: str) -> str:
    """Group numbers after a mark, one higher; what follows a backslash stays, except a number after the mark itself."""
    return re.sub(r"\\\\|\\\$|" + re.escape(mark) + r"(\d+)", lambda m: f"{mark}{int(m[1]) + 1}" if m[1] else m[0], text)


def regexp_replace_first(value: Column, pattern: str, replacement: str) -> Column:
    """Replaces the first match only, as the engine does without the flag g.

    The text up to the match is a group of its own, from the start of the text on, so the match sees all that is around it.
    """
    return F.regexp_replace(value, r"\A([\s\S]*?)(?:" + _shifted(pattern, "\\") + ")", "$1" + _shifted(replacement, "$"))


def initcap(value: Column) -> Column:
    """Upper case after any character that is no letter or digit, lower case elsewhere."""
    words = F.regexp_extract_all(value, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def left(value: Column, n: int) -> Column:
    """The first n characters; a negative n drops so many from the end."""
    return F.substring(value, F.lit(1), F.lit(n)) if n >= 0 else F.substring(value, F.lit(1), F.greatest(F.length(value) + n, F.lit(0)))


def right(value: Column, n: int) -> Column:
    """The last n characters; a negative n drops so many from the start."""
    if n < 0:
        return F.substring(value, F.lit(1 - n), F.length(value))
    return F.substring(value, F.greatest(F.length(value) - n + 1, F.lit(1)), F.lit(n))


def chr(code: Column) -> Column:  # noqa: A001
    """The character of a code point, beyond 255 too."""
    raw = F.lpad(F.hex(code.cast("long")), 8, "0")
    return F.decode(F.unhex(raw), "UTF-32")


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))
