"""Sequences: a DataFrame together with the columns that order it. All operators are lazy and compose."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators.ordered import with_previous, with_running_sum

Order = Sequence[tuple[str, bool]]
_sources = itertools.count()


class UncorrelatedError(TypeError):
    """Sequences of different origin in one map: that would be a product, and has to be asked for by name."""


class Seq:
    """df in the order of ``order``: [(column, ascending)]. Sequences of one ``source`` may be used in one map."""

    def __init__(self, df: DataFrame, order: Order, source: int | None = None) -> None:
        self.df, self.order = df, list(order)
        self.source = next(_sources) if source is None else source

    def _with(self, df: DataFrame, order: Order | None = None) -> Seq:
        return Seq(df, self.order if order is None else order, self.source)

    def _sort(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in self.order]

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    # -- sources -----------------------------------------------------------

    @staticmethod
    def range(spark: SparkSession, start: int, end: int | None = None, second: int | None = None, closed: bool = True) -> Seq:
        """start, second, ... to end. The second element sets the stride, else it is one towards the end; a stride away from the
        end is an error. Without an end the sequence is infinite and must be cut by take before it is read."""
        step = second - start if second is not None else (1 if end is None or end >= start else -1)
        if step == 0 or end is not None and end != start and (end > start) != (step > 0):
            raise ValueError("range: stride leads away from the end")
        if end is None:
            return _Endless(spark, start, step)
        stop = end + (1 if step > 0 else -1) if closed else end
        df = spark.range(start, stop, step).withColumnRenamed("id", "v")
        return Seq(df, [("v", step > 0)])

    @staticmethod
    def of_list(df: DataFrame, values: Column, keep: Sequence[str] = ()) -> Seq:
        """The elements of a list column, in order, beside the columns in keep."""
        out = df.select(*keep, F.posexplode(values).alias("pos", "v"))
        return Seq(out, [*[(c, True) for c in keep], ("pos", True)])

    @staticmethod
    def of_set(df: DataFrame, values: Column, keep: Sequence[str] = ()) -> Seq:
        return Seq.of_list(df, F.sort_array(values), keep)

    @staticmethod
    def of_dict(df: DataFrame, values: Column, keep: Sequence[str] = ()) -> Seq:
        """(key, value) pairs in the order of keys."""
        return Seq.of_list(df, F.sort_array(F.map_entries(values)), keep)

    # -- one by one --------------------------------------------------------

    def map(self, **columns: Column | Callable[[], Column]) -> Seq:
        """These columns instead of the others; the order stays, in hidden columns where need be."""
        hidden = [(f"_o{k}" if c not in columns else f"_o{k}", asc) for k, (c, asc) in enumerate(self.order)]
        order = [F.col(c).alias(h) for (c, _), (h, _) in zip(self.order, hidden, strict=True)]
        return self._with(self.df.select(*[e.alias(n) for n, e in columns.items()], *order), hidden)

    def zip(self, other: Seq, **columns: Column) -> Seq:
        """A map over two sequences, which must be the same one at heart."""
        if other.source != self.source:
            raise UncorrelatedError("sequences in one map must have one definition")
        return self.map(**columns)

    def with_columns(self, **columns: Column) -> Seq:
        return self._with(self.df.withColumns(columns))

    def beside(self, **columns: Column) -> Seq:
        """As with_columns, for new names; it leaves a frame that refers to an outer one unanalyzed."""
        return self._with(self.df.select("*", *[c.alias(n) for n, c in columns.items()]))

    def filter(self, pred: Column) -> Seq:
        """Elements for which pred is true. An unknown is no truth value: test it with is_known_as."""
        return self._with(self.df.filter(pred))

    def take_while(self, pred: Column) -> Seq:
        """The longest prefix on which pred is true."""
        bad = self.df.filter(~F.coalesce(pred, F.lit(False)))
        ways = {asc for _, asc in self.order}
        if len(ways) == 1:  # the first failing place is a least or a greatest one: no sort
            key = lambda: F.struct(*[F.col(c) for c, _ in self.order])
            edge = bad.agg((F.min(key()) if ways == {True} else F.max(key())).alias("_edge"))
            ok = key() < F.col("_edge") if ways == {True} else key() > F.col("_edge")
            return self._with(self.df.crossJoin(F.broadcast(edge)).where(F.col("_edge").isNull() | ok).drop("_edge"))  # one row
        place = F.struct(*[F.col(c).alias(f"o{k}") for k, (c, _) in enumerate(self.order)])
        edge = bad.orderBy(*self._sort()).limit(1).agg(F.first(place).alias("_edge"))  # each task keeps one row, and sorts none
        ahead = self.df.crossJoin(F.broadcast(edge)).where(F.col("_edge").isNull() | (self._comparator(place, F.col("_edge")) < 0))  # one row
        return self._with(ahead.drop("_edge"))

    def take(self, n: int) -> Seq:
        return self._with(self.df.orderBy(*self._sort()).limit(max(0, n)))

    def skip(self, n: int) -> Seq:
        return self._with(self.df.orderBy(*self._sort()).offset(max(0, n)))

    # -- order -------------------------------------------------------------

    def sorted_by(self, *keys: tuple[str, bool]) -> Seq:
        """By (column, ascending), ties in the order before."""
        return self._with(self.df, [*keys, *[o for o in self.order if o[0] not in {k for k, _ in keys}]])

    def reversed(self) -> Seq:
        return self._with(self.df, [(c, not asc) for c, asc in self.order])

    # -- folds -------------------------------------------------------------

    def reduce(self, **aggs: Column) -> DataFrame:
        """Folds whose operator is a known monoid, as Spark's aggregates, with partial aggregation: one row."""
        return self.df.agg(*[e.alias(n) for n, e in aggs.items()])

    def fold(self, value: Column, start: Column, merge: Callable[[Column, Column], Column], name: str = "v") -> DataFrame:
        """Any other left fold, in order: one row. The elements are gathered in one list, so this is for short sequences."""
        return self.df.agg(F.aggregate(self.gathered(value), start, lambda acc, x: merge(acc, x["v"])).alias(name))

    def gathered(self, value: Column) -> Column:
        """An aggregate: the values in order, as field v of structs."""
        return F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{k}") for k, (c, _) in enumerate(self.order)], value.alias("v"))), self._comparator)

    def _comparator(self, a: Column, b: Column) -> Column:
        out = F.lit(0)
        for k, (_, asc) in reversed(list(enumerate(self.order))):
            x, y = a[f"o{k}"], b[f"o{k}"]
            lo, hi = (-1, 1) if asc else (1, -1)
            out = F.when((x < y) | (x.isNull() & y.isNotNull()), lo).when((x > y) | (x.isNotNull() & y.isNull()), hi).otherwise(out)
        return out

    def collated_by(self, key: str, **aggs: Column) -> Seq:
        """Runs of consecutive elements of one key, each folded; a key comes as often as it has runs."""
        df = with_previous(self.df, self.order, key, "_prev")
        starts = F.when(F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col(key)), 1).otherwise(0)
        df = with_running_sum(df, self.order, starts, "run")
        return Seq(df.groupBy("run", key).agg(*[e.alias(n) for n, e in aggs.items()]), [("run", True)])

    def collected_by(self, key: str, **aggs: Column) -> Seq:
        """All elements of one key folded, by a monoid; in the order of keys."""
        return Seq(self.df.groupBy(key).agg(*[e.alias(n) for n, e in aggs.items()]), [(key, True)])

    def collected_in_order(self, key: str, value: Column, merge: Callable[[Column, Column], Column], name: str = "v") -> Seq:
        """As collected_by for a merge that does not commute: the first value of a key seeds, the others follow in order."""
        items = self.gathered(value)
        df = self.df.groupBy(key).agg(F.transform(items, lambda x: x["v"]).alias("_l"))
        return Seq(df.select(key, F.aggregate(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), F.get("_l", F.lit(0)), merge).alias(name)), [(key, True)])

    def union_map(self, elements: Column, name: str = "v") -> Seq:
        """The union of the sets that elements gives."""
        return Seq(self.df.select(F.explode(elements).alias(name)).distinct(), [(name, True)])

    # -- values ------------------------------------------------------------

    def to_frame(self) -> DataFrame:
        """The elements in order."""
        return self.df.orderBy(*self._sort())

    def to_list(self, value: Column, name: str = "v") -> DataFrame:
        items = self.gathered(value)
        return self.df.agg(F.transform(items, lambda x: x["v"]).alias(name))

    def to_set(self, value: Column, name: str = "v") -> DataFrame:
        """Unknown stays, once, and comes first."""
        d = self.df.select(value.alias("v")).distinct()
        return d.agg(F.transform(F.sort_array(F.collect_list(F.struct("v"))), lambda x: x["v"]).alias(name))

    def to_dict(self, key: Column, value: Column, name: str = "v") -> DataFrame:
        """Of a repeated key the last value stays."""
        rows = self.df.select(key.alias("k"), value.alias("v"), *[F.col(c).alias(f"o{j}") for j, (c, _) in enumerate(self.order)])
        place, ways = F.struct(*[f"o{j}" for j in range(len(self.order))]), {asc for _, asc in self.order}
        if len(ways) == 1:  # the last is a greatest or a least one: no sort
            d = rows.groupBy("k").agg((F.max_by if ways == {True} else F.min_by)("v", place).alias("v"))
        else:
            back = [F.col(f"o{j}").desc_nulls_last() if asc else F.col(f"o{j}").asc_nulls_first() for j, (_, asc) in enumerate(self.order)]
            d = rows.withColumn("_r", F.row_number().over(W.partitionBy("k").orderBy(*back))).where("_r = 1").select("k", "v")
        return d.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(name))


class _Endless(Seq):
    def __init__(self, spark: SparkSession, start: int, step: int) -> None:
        self.spark, self.start, self.step = spark, start, step
        super().__init__(spark.createDataFrame([], T.StructType([T.StructField("v", T.LongType())])), [("v", step > 0)])

    def take(self, n: int) -> Seq:
        return Seq(self.spark.range(self.start, self.start + max(0, n) * self.step, self.step).withColumnRenamed("id", "v"), self.order)

    def skip(self, n: int) -> Seq:
        return _Endless(self.spark, self.start + max(0, n) * self.step, self.step)

    def to_frame(self) -> DataFrame:
        raise ValueError("an endless range must be cut by take")
