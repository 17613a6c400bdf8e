"""Maps, lists and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_get_default(m: Column, key: str, default: str) -> Column:
    """The entry as text, or the default where the map, the entry or its value is missing."""
    return F.coalesce(F.try_element_at(m, F.lit(key)).cast("string"), F.lit(default))


def map_normalize(m: Column, key_case: str = "lower", sort_keys: bool = True) -> Column:
    """Keys in one case, values as text, entries by key; of keys that become equal the last one counts.

    Spark's maps cannot hold a key twice, so the last one counts without ``sort_keys`` too.
    """
    case = {"lower": F.lower, "upper": F.upper, "none": lambda c: c}[key_case]
    entries = F.transform(F.map_entries(m), lambda e: F.struct(case(e["key"]).alias("key"), e["value"].cast("string").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(last) if sort_keys else last)


def list_compact(a: Column) -> Column:
    return F.array_compact(F.transform(a, lambda x: x.cast("string")))


def list_unique_sorted(a: Column) -> Column:
    return F.array_sort(F.array_distinct(list_compact(a)))


def struct_pick(s: Column, *names: str) -> Column:
    """The struct with those fields alone; null stays null."""
    return F.when(s.isNotNull(), F.struct(*[s[n].alias(n) for n in names]))


def get_field(value: Column, key: str) -> Column:
    """``value -> key`` for structs and maps."""
    return value.getField(key) if not isinstance(key, Column) else value[key]


def array_has_all(a: Column, b: Column) -> Column:
    """``a @> b``: every element of b is in a."""
    return F.size(F.array_except(b, a)) == 0


def array_remove_n(a: Column, element: Column, most: int) -> Column:
    """Without the first ``most`` elements that equal the given one."""
    return F.filter(a, lambda x, i: ~(x.eqNullSafe(element) & (F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y.eqNullSafe(element))) <= most)))


def array_remove(a: Column, element: Column) -> Column:
    """Without the first equal element; Spark's own removes all."""
    return array_remove_n(a, element, 1)


def array_replace_n(a: Column, old: Column, new: Column, most: int) -> Column:
    seen = lambda i: F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y.eqNullSafe(old)))
    return F.transform(a, lambda x, i: F.when(x.eqNullSafe(old) & (seen(i) <= most), new).otherwise(x))


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return array_replace_n(a, old, new, 1)


def array_replace_all(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def array_positions(a: Column, element: Column) -> Column:
    """All places, from 1, of an element."""
    return F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(element), i + 1)), lambda i: i.isNotNull())


def array_pop_back(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def array_pop_front(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def array_slice(a: Column, begin: int, end: int, stride: int = 1) -> Column:
    """Elements from ``begin`` to ``end``, both counted from 1 and included; negatives count from the end."""
    place = lambda k: F.lit(k) if k > 0 else F.size(a) + 1 + k
    return F.filter(a, lambda x, i: (i + 1 >= place(begin)) & (i + 1 <= place(end)) & ((i + 1 - place(begin)) % stride == 0))


def array_resize(a: Column, size: int, fill: Column) -> Column:
    return F.slice(F.concat(a, F.array_repeat(fill, F.greatest(F.lit(size) - F.size(a), F.lit(0)))), 1, size)


def array_position(a: Column, element: Column) -> Column:
    """Null, not 0, where the element is missing."""
    return F.nullif(F.array_position(a, element), F.lit(0).cast("long"))


def range_exclusive(start: Column, stop: Column, step: int = 1) -> Column:
    """The engine's range: the end is left out."""
    return F.when(stop > start, F.sequence(start, stop - 1, F.lit(step))).otherwise(F.array().cast("array<long>"))
