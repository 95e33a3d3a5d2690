"""Running values over the order of a whole table, without sorting it in one task: ranges of the leading order column are
handled apart, and one row a range carries over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges, at most: what is carried over is so many rows.
RANGES = 256


def with_range(df: DataFrame, order: Sequence[tuple[str, bool]], name: str = "_range") -> DataFrame:
    """Adds the range that a row is in, rising along order ([(column, ascending)]); one range for columns that have no quantiles."""
    col, asc = order[0]
    kind = df.schema[col].dataType
    if not isinstance(kind, (T.NumericType, T.TimestampType, T.DateType)):
        return df.withColumn(name, F.lit(0))
    number = F.col(col).cast("double") if isinstance(kind, T.NumericType) else F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    cuts = df.agg(F.percentile_approx(number, F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), 10_000)).first()[0] or []
    if not cuts:
        return df.withColumn(name, F.lit(0))
    up = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: number > c)), F.lit(-1))
    return df.withColumn(name, up if asc else -up)


def _by(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order]


def with_previous(df: DataFrame, order: Sequence[tuple[str, bool]], value: str, name: str) -> DataFrame:
    """Adds value of the row before, a struct (v) that is null for the first row."""
    df = with_range(df, order)
    own = W.partitionBy("_range").orderBy(*_by(order))
    df = df.withColumn("_lag", F.lag(F.struct(F.col(value).alias("v"))).over(own)).withColumn("_next", F.row_number().over(own))
    last = df.withColumn("_n", F.count("*").over(W.partitionBy("_range"))).where("_next = _n").select("_range", F.struct(F.col(value).alias("v")).alias("_last"))
    carried = last.select("_range", F.lag("_last").over(W.orderBy("_range")).alias("_carried"))  # RANGES rows
    df = df.join(F.broadcast(carried), "_range", "left")
    return df.withColumn(name, F.when(F.col("_next") == 1, F.col("_carried")).otherwise(F.col("_lag"))).drop("_range", "_lag", "_next", "_carried")


def with_running_sum(df: DataFrame, order: Sequence[tuple[str, bool]], value: Column, name: str) -> DataFrame:
    """Adds the sum of value up to and with the row."""
    df = with_range(df.withColumn("_x", value), order)
    sums = df.groupBy("_range").agg(F.sum("_x").alias("_s"))
    before = sums.select("_range", F.coalesce(F.sum("_s").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # RANGES rows
    own = W.partitionBy("_range").orderBy(*_by(order)).rowsBetween(W.unboundedPreceding, 0)
    return df.join(F.broadcast(before), "_range", "left").withColumn(name, F.sum("_x").over(own) + F.col("_before")).drop("_range", "_before", "_x")
