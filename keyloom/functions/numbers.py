"""Arithmetic: integers are 64-bit and truncate, division by zero raises for both kinds of number, powers are real."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column, integral: bool) -> Column:
    """int / int truncates towards zero; real / real. Zero divisors raise."""
    if integral:
        return F.call_function("div", a, b)
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(a / F.when(b != 0, b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of a."""
    return a % b


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def negate(a: Column) -> Column:
    return -a


def floor(a: Column) -> Column:
    return F.floor(a).cast("double")


def ceiling(a: Column) -> Column:
    return F.ceil(a).cast("double")


def sin(a: Column) -> Column:
    return F.sin(a)


def cos(a: Column) -> Column:
    return F.cos(a)


def tan(a: Column) -> Column:
    return F.tan(a)


def asin(a: Column) -> Column:
    return F.asin(a)


def acos(a: Column) -> Column:
    return F.acos(a)


def atan(a: Column) -> Column:
    return F.atan(a)


def atan2(a: Column, b: Column) -> Column:
    return F.atan2(a, b)


def log(a: Column) -> Column:
    return F.log(a.cast("double"))


def log2(a: Column) -> Column:
    return F.log(a.cast("double")) / F.lit(math.log(2))


def log10(a: Column) -> Column:
    return F.log10(a.cast("double"))


def random_int(seed: int, gen_id: Column, low: Column, high: Column, idx: Column) -> Column:
    """The idx-th value of generator gen_id in [low, high]: the same for the same seed, whatever the layout of the data."""
    return F.pmod(F.xxhash64(F.lit(seed), gen_id, idx), high - low + 1) + low
