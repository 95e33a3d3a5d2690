"""Three-valued logic over optional values; an unknown is a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kleene_and(a: Column, b: Column) -> Column:
    return a & b


def kleene_or(a: Column, b: Column) -> Column:
    return a | b


def kleene_xor(a: Column, b: Column) -> Column:
    """Unknown if either side is."""
    return a != b


def kleene_not(a: Column) -> Column:
    return ~a


def and_then(a: Column, b: Column) -> Column:
    """b is evaluated only where a holds."""
    return F.when(a, b).otherwise(a)


def or_else(a: Column, b: Column) -> Column:
    """b is evaluated only where a does not hold."""
    return F.when(a, a).otherwise(b)


def is_known(a: Column) -> Column:
    return a.isNotNull()


def is_unknown(a: Column) -> Column:
    return a.isNull()


def is_known_as(a: Column, v: Column) -> Column:
    """Known and equal to v; never unknown itself."""
    return F.coalesce(a == v, F.lit(False))


def known(a: Column, kind: str) -> Column:
    """The value, of Spark type kind; raises where it is unknown."""
    return F.when(a.isNull(), F.raise_error(F.lit("known: value is unknown")).cast(kind)).otherwise(a)
