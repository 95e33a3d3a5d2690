"""Points in time are UTC timestamps, differences are day-time intervals. Dates are lenient: day 30 of February is March."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_pnt(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, utc_offset: Column | None = None) -> Column:
    """utc_offset is in minutes east of UTC. Needs a session time zone of UTC, as all of this module."""
    i = lambda c: c.cast("int")
    date = F.date_add(F.make_date(i(year), i(month), F.lit(1)), i(day) - 1)
    off = F.lit(0) if utc_offset is None else i(utc_offset)
    return date.cast("timestamp") + F.make_dt_interval(F.lit(0), i(hour), i(minute) - off, second.cast("decimal(18,6)"))


def time_diff(day: Column, hour: Column, minute: Column, second: Column, is_forward: Column | None = None) -> Column:
    i = lambda c: c.cast("int")
    d = F.make_dt_interval(i(day), i(hour), i(minute), second.cast("decimal(18,6)"))
    return d if is_forward is None else F.when(is_forward, d).otherwise(-d)


def time_pnt_fields(t: Column) -> Column:
    part = lambda f: f(t).cast("long")
    return F.struct(
        part(F.year).alias("year"), part(F.month).alias("month"), part(F.dayofmonth).alias("day"), part(F.hour).alias("hour"), part(F.minute).alias("minute"), part(F.second).alias("second"),
        (F.pmod(F.unix_micros(t), F.lit(1_000_000)) * 1000).alias("nanosecond"), F.lit(0).cast("long").alias("utc_offset"),
    )


def time_diff_fields(d: Column) -> Column:
    zero = F.expr("INTERVAL '0' SECOND")
    a = F.when(d < zero, -d).otherwise(d)
    part = lambda f: F.extract(F.lit(f), a).cast("long")
    return F.struct((d >= zero).alias("is_forward"), part("DAY").alias("day"), part("HOUR").alias("hour"), part("MINUTE").alias("minute"), part("SECOND").alias("second"))
