"""Lists are arrays, sets are sorted arrays of distinct values with unknown first, dicts are maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_set(values: Column) -> Column:
    return F.sort_array(F.array_distinct(values))


def make_dict(keys: Column, values: Column) -> Column:
    """A repeated key is an error."""
    twice = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.map_from_arrays(F.when(twice, F.array_repeat(F.element_at(keys, F.raise_error(F.lit("duplicate key in dict")).cast("int")), 1)).otherwise(keys), values)


def set_union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def set_intersection(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def set_difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def set_symmetric_difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def subset(a: Column, b: Column) -> Column:
    """a <= b for sets."""
    return F.size(F.array_except(a, b)) == 0


def proper_subset(a: Column, b: Column) -> Column:
    """a < b for sets."""
    return subset(a, b) & (F.size(a) < F.size(b))


def list_concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def dict_merge(a: Column, b: Column) -> Column:
    """Of a key in both, b's value stays; independent of the session's map policy."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def dict_without(a: Column, keys: Column) -> Column:
    return F.map_filter(a, lambda k, _: ~F.array_contains(keys, k))


def dict_equal(a: Column, b: Column) -> Column:
    return F.sort_array(F.map_entries(a)) == F.sort_array(F.map_entries(b))


def dict_get(d: Column, key: Column) -> Column:
    """Raises if the key is missing."""
    return index_at(d, key, "dict")


def list_put(x: Column, i: Column, value: Column) -> Column:
    """x with value at place i, from 0; a place outside raises. No lambda, so that all three may hold subqueries."""
    at = F.when((i < 0) | (i >= F.size(x)), F.raise_error(F.lit("index out of bounds")).cast("int")).otherwise(i.cast("int"))
    return F.concat(F.slice(x, F.lit(1), at), F.array(value), F.slice(x, at + 2, F.size(x)))


def dict_put(d: Column, key: Column, value: Column) -> Column:
    """d with value at key, new or not. No lambda, as in list_put."""
    keys, at = F.map_keys(d), F.array_position(F.map_keys(d), key).cast("int")
    return F.when(at == 0, F.map_from_arrays(F.concat(keys, F.array(key)), F.concat(F.map_values(d), F.array(value)))).otherwise(
        F.map_from_arrays(keys, list_put(F.map_values(d), F.greatest(at - 1, F.lit(0)), value))
    )


def has(container: Column, x: Column, kind: str) -> Column:
    """x in container, for kind str, list, set or dict. An empty container holds nothing, not even an unknown; otherwise an
    unknown x, or no match beside an unknown element, is unknown."""
    if kind == "str":
        return F.when(container == "", x == "").otherwise(F.contains(container, x))
    if kind == "dict":
        return F.when(F.size(container) == 0, False).otherwise(F.array_contains(F.map_keys(container), x))
    return F.when(F.size(container) == 0, False).otherwise(F.array_contains(container, x))


def is_empty(x: Column, kind: str) -> Column:
    return x == "" if kind == "str" else F.size(x) == 0


def length_of(x: Column, kind: str) -> Column:
    return (F.octet_length(x) if kind == "str" else F.size(x)).cast("long")


def reverse_of(x: Column) -> Column:
    return F.reverse(x)


def _bytes(s: Column, start: Column, length: Column) -> Column:
    return F.substring(F.encode(s, "UTF-8"), start.cast("int") + 1, length.cast("int")).cast("string")


def index_at(x: Column, i: Column, kind: str) -> Column:
    """x[i], from 0; a place outside raises."""
    if kind == "dict":
        return F.when(F.map_contains_key(x, i), F.element_at(x, i)).otherwise(F.element_at(F.map_values(x), F.when(~F.map_contains_key(x, i), F.raise_error(F.lit("key not in dict")).cast("int"))))
    size = length_of(x, kind)
    at = F.when((i < 0) | (i >= size), F.raise_error(F.lit("index out of bounds")).cast("int")).otherwise(i.cast("int"))
    return _bytes(x, at, F.lit(1)) if kind == "str" else F.element_at(x, at + 1)


def slice_of(x: Column, start: Column | None, end: Column | None, kind: str) -> Column:
    """x[start:end], from 0, either end optional; places outside raise."""
    size = length_of(x, kind)
    a, b = F.lit(0).cast("long") if start is None else start, size if end is None else end
    bad = (a < 0) | (a > size) | (b < a) | (b > size)
    a = F.when(bad, F.raise_error(F.lit("slice out of bounds")).cast("long")).otherwise(a)
    return _bytes(x, a, b - a) if kind == "str" else F.slice(x, (a + 1).cast("int"), (b - a).cast("int"))
