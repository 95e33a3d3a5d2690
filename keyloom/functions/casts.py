"""Conversions of the postfix ``as``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.containers import make_set


def as_int(x: Column) -> Column:
    """From real: truncates. From str: must be a number."""
    return x.cast("long")


def as_real(x: Column) -> Column:
    return x.cast("double")


def as_str(x: Column, kind: str) -> Column:
    """A real has five digits after the point."""
    return F.format_string("%.5f", x) if kind == "real" else as_bool_text(x) if kind == "bool" else x.cast("string")


def as_bool_text(x: Column) -> Column:
    return F.when(x, "true").when(~x, "false")


def as_list(x: Column) -> Column:
    return F.array(x)


def as_set(xs: Column) -> Column:
    return make_set(xs)


def as_pairs(d: Column) -> Column:
    """A dict's (key, value) pairs in the order of keys."""
    return F.transform(F.sort_array(F.map_entries(d)), lambda e: F.struct(e["key"].alias("_0"), e["value"].alias("_1")))
