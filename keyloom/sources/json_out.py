"""Results as JSON texts: sets and lists as arrays, records and dicts as objects, variants as {tag: payload}, integers as reals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(c: Column, kind: T.DataType) -> Column:
    """c in types whose JSON is that of the language."""
    if isinstance(kind, T.IntegralType):
        return c.cast("double")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, _: k.cast("string")), lambda _, v: plain(v, kind.valueType))
    if isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields]
        if names[:1] == ["tag"] and len(names) > 1:
            arms = [F.when(c["tag"] == f.name, F.struct((F.struct() if isinstance(f.dataType, T.BooleanType) else plain(c[f.name], f.dataType)).alias(f.name))) for f in kind.fields[1:]]
            return F.coalesce(*[F.to_json(a) for a in arms])
        return F.struct(*[plain(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return c


def to_json(df: DataFrame, column: str) -> DataFrame:
    """A column of JSON texts."""
    kind = df.schema[column].dataType
    c = plain(F.col(column), kind)
    is_variant = isinstance(kind, T.StructType) and kind.fieldNames()[:1] == ["tag"]
    if is_variant:
        return df.withColumn(column, c)
    nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
    return df.withColumn(column, F.to_json(c) if nested else F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"^\{\"v\":(.*)\}$", 1))
