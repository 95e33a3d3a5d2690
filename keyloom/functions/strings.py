"""Strings. Lengths and slices of strings count bytes (see containers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_upper(s: Column) -> Column:
    return F.upper(s)


def to_lower(s: Column) -> Column:
    return F.lower(s)


def replace(s: Column, regex: Column, new: Column) -> Column:
    """Replaces each match; new is literal text."""
    quoted = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(s, regex, quoted)


def match(s: Column, regex: Column) -> Column:
    """All matches, in order."""
    return F.regexp_extract_all(s, regex, F.lit(0))


def split(s: Column, regex: Column) -> Column:
    """[(piece, delimiter)] in order; the last piece has no delimiter."""
    return F.transform(F.arrays_zip(F.split(s, regex, -1).alias("p"), match(s, regex).alias("d")), lambda x: F.struct(x["p"].alias("_0"), x["d"].alias("_1")))
