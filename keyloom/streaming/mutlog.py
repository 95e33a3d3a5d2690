"""Mutations are kept as a log and folded when they are read.

A log table has a row for each mutation: pov_id, seq (long, rising), update_id, the key columns, mutator, op (the operand, of the
index's value type) and tombstone. Reading a key takes its newest row as anchor: a tombstone means there is no value, an assignment is
the value, and a commutative mutator is folded with the older rows of the same mutator, down to an assignment, which is the fold's
base, or to a tombstone or another mutator, which it stops before. Rows of one update count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mutators by how they are kept: folded on reading, or resolved to an assignment when written.
DEFERRED = ("add", "mult", "min", "max", "and", "or", "xor", "union", "intersection", "symmetric_diff")
RESOLVED = ("sub", "div", "mod", "exp")
ASSIGN = "assign"


def folded(mutator: str, kind: T.DataType, op: str = "op") -> Column:
    """The aggregate that folds the operands of one deferred mutator; partial where the operation has a partial form."""
    x = F.col(op)
    in_order = lambda: F.transform(F.sort_array(F.collect_list(F.struct("seq", x.alias("op")))), lambda r: r["op"])
    if mutator == "add":
        if isinstance(kind, T.ArrayType):
            return F.flatten(in_order())
        if isinstance(kind, T.StringType):
            return F.array_join(in_order(), "")
        if isinstance(kind, T.MapType):
            entries = F.transform(F.sort_array(F.collect_list(F.struct("seq", F.map_entries(x).alias("op")))), lambda r: r["op"])
            return F.aggregate(entries, F.create_map().cast(kind), lambda a, e: F.map_concat(F.map_filter(a, lambda k, _: ~F.exists(e, lambda y: y["key"] == k)), F.map_from_entries(e)))
        return F.sum(x).cast(kind)
    if mutator == "mult":
        return F.product(x) if isinstance(kind, T.DoubleType) else F.aggregate(F.collect_list(x), F.lit(1).cast(kind), lambda a, v: a * v)
    if mutator in ("union", "intersection", "symmetric_diff"):
        sets = F.collect_list(x)
        if mutator == "union":
            return F.sort_array(F.array_distinct(F.flatten(F.collect_set(x))))
        if mutator == "intersection":
            return F.sort_array(F.aggregate(F.slice(sets, 2, F.greatest(F.size(sets) - 1, F.lit(0))), F.get(sets, F.lit(0)), F.array_intersect))
        return F.sort_array(F.aggregate(sets, F.array().cast(kind), lambda a, v: F.array_union(F.array_except(a, v), F.array_except(v, a))))
    return {"min": F.min(x), "max": F.max(x), "and": F.bool_and(x), "or": F.bool_or(x), "xor": F.sum(x.cast("int")) % 2 == 1}[mutator]


def combine(mutator: str, base: Column, acc: Column, kind: T.DataType) -> Column:
    """base OP acc for one pair."""
    if mutator == "add":
        if isinstance(kind, T.MapType):
            return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(acc), k)), acc)
        return F.concat(base, acc) if isinstance(kind, (T.ArrayType, T.StringType)) else base + acc
    if mutator in ("union", "intersection", "symmetric_diff"):
        return F.sort_array({"union": F.array_union, "intersection": F.array_intersect, "symmetric_diff": lambda a, b: F.array_union(F.array_except(a, b), F.array_except(b, a))}[mutator](base, acc))
    if mutator == "div":
        return F.call_function("div", base, acc) if isinstance(kind, T.LongType) else base / acc
    if mutator == "exp":
        return F.pow(base.cast("double"), acc.cast("double")).cast(kind)
    return {
        "mult": lambda: base * acc, "min": lambda: F.least(base, acc), "max": lambda: F.greatest(base, acc), "and": lambda: base & acc,
        "or": lambda: base | acc, "xor": lambda: base != acc, "sub": lambda: base - acc, "mod": lambda: base % acc,
    }[mutator]()


def fold(log: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """key and value of each key that has one. One shuffle on the key: the fold's rows, the stop and the result all
    follow from windows and an aggregate over the same partitioning."""
    kind = log.schema["op"].dataType
    place = [F.col("seq").desc(), F.col("update_id").desc()]
    by = W.partitionBy(*key)
    rows = log.withColumn("_m", F.when(F.col("tombstone"), "tombstone").otherwise(F.col("mutator")))
    once = W.partitionBy(*key, "update_id").orderBy(*place)
    rows = rows.withColumn("_dup", F.when(F.col("update_id").isNull(), 1).otherwise(F.row_number().over(once))).where("_dup = 1")
    newest = by.orderBy(*place)
    rows = rows.withColumn("_anchor", F.first("_m").over(newest.rowsBetween(W.unboundedPreceding, 0)))
    stop = F.when(F.col("_m") != F.col("_anchor"), 1).otherwise(0)
    rows = rows.withColumn("_stops", F.sum(stop).over(newest.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(newest))
    anchor = F.col("_anchor")
    in_run = (F.col("_stops") == 0) & ((anchor != ASSIGN) | (F.col("_n") == 1))
    is_base = (F.col("_stops") == 1) & (F.col("_m") == ASSIGN) & anchor.isin(*DEFERRED)
    prev_stops = F.lag("_stops", 1, 0).over(newest)
    rows = rows.withColumn("_base", is_base & (prev_stops == 0)).where((anchor != "tombstone") & (in_run | F.col("_base")))
    # one grouped pass for every mutator at once: each aggregate sees only its own rows
    used = [m for m in DEFERRED if _fits(m, kind)]
    aggs = [folded(m, kind, f"_op_{m}").alias(f"_f_{m}") for m in used]
    wide = rows.withColumns({f"_op_{m}": F.when((anchor == m) & ~F.col("_base"), F.col("op")) for m in used})
    wide = wide.groupBy(*key).agg(F.first("_anchor").alias("_anchor"), F.first(F.when(anchor == ASSIGN, F.struct(F.col("op").alias("v"))), ignorenulls=True).alias("_assigned"), F.first(F.when(F.col("_base"), F.struct(F.col("op").alias("v"))), ignorenulls=True).alias("_b"), *aggs)
    out = F.when(F.col("_anchor") == ASSIGN, F.col("_assigned.v"))
    for m in used:
        f = F.col(f"_f_{m}")
        out = out.when(F.col("_anchor") == m, F.when(F.col("_b").isNotNull(), combine(m, F.col("_b.v"), f, kind)).otherwise(f))
    return wide.select(*key, out.alias(value))


def _fits(mutator: str, kind: T.DataType) -> bool:
    if mutator in ("and", "or", "xor"):
        return isinstance(kind, T.BooleanType)
    if mutator in ("union", "intersection", "symmetric_diff"):
        return isinstance(kind, T.ArrayType)
    if mutator in ("mult", "min", "max"):
        return isinstance(kind, T.NumericType)
    return isinstance(kind, (T.NumericType, T.ArrayType, T.StringType, T.MapType))


def resolve(values: DataFrame, key: Sequence[str], changes: DataFrame, mutator: str, value: str = "value") -> DataFrame:
    """Read-modify-write mutators as assignments: changes (key columns, op) over the present values; an absent key is an error."""
    kind = values.schema[value].dataType
    both = changes.join(values.withColumn("_has", F.lit(True)), list(key), "left")
    old = F.when(F.col("_has").isNull(), F.raise_error(F.lit(f"{mutator}: no value at key")).cast(kind)).otherwise(F.col(value))
    return both.select(*key, combine(mutator, old, F.col("op"), kind).alias("op"))


def compact(log: DataFrame, key: Sequence[str], whole: bool = True) -> DataFrame:
    """A log that reads as this one, now and after any later rows, with fewer rows: each run of a mutator becomes one row of it. Of
    a whole history what no read reaches goes too: all below a key's newest run, but for an assignment right below it."""
    kind = log.schema["op"].dataType
    m = F.when(F.col("tombstone"), "tombstone").otherwise(F.col("mutator"))
    w = W.partitionBy(*key).orderBy("seq")
    once = W.partitionBy(*key, "update_id").orderBy(F.col("seq").desc())
    log = log.withColumn("_dup", F.when(F.col("update_id").isNull(), 1).otherwise(F.row_number().over(once))).where("_dup = 1").drop("_dup")
    rows = log.withColumn("_m", m).withColumn("_new", F.when(F.lag("_m").over(w).eqNullSafe(F.col("_m")), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    used = [x for x in DEFERRED if _fits(x, kind)]
    wide = rows.withColumns({f"_op_{x}": F.when(F.col("_m") == x, F.col("op")) for x in used})
    g = wide.groupBy(*key, "_run").agg(F.max("seq").alias("last_seq"), F.first("_m").alias("_m"), F.max("pov_id").alias("pov_id"), F.max_by("op", "seq").alias("_last"), *[folded(x, kind, f"_op_{x}").alias(f"_f_{x}") for x in used])
    if whole:
        top = W.partitionBy(*key).orderBy(F.col("_run").desc())
        g = g.withColumn("_n", F.row_number().over(top)).withColumn("_above", F.lag("_m").over(top))
        g = g.where(((F.col("_n") == 1) & (F.col("_m") != "tombstone")) | ((F.col("_n") == 2) & (F.col("_m") == ASSIGN) & F.col("_above").isin(*DEFERRED)))
    out = F.col("_last")
    for x in used:
        out = F.when(F.col("_m") == x, F.col(f"_f_{x}")).otherwise(out)
    return g.select("pov_id", F.col("last_seq").alias("seq"), F.lit(None).cast("string").alias("update_id"), *key, F.when(F.col("_m") != "tombstone", F.col("_m")).alias("mutator"), F.when(F.col("_m") != "tombstone", out).alias("op"), (F.col("_m") == "tombstone").alias("tombstone"))
