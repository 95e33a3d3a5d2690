"""Table files in and out: typed CSV, JSON objects, bulk images and a small table DDL."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators.catalog import Catalog

TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "real": T.DoubleType(), "str": T.StringType(), "id": T.StringType(), "time_pnt": T.TimestampType()}


@dataclass
class TableDef:
    """columns: (name, type, nullable); primary: [(column, ascending)]; secondary: further keys by name; text: free-text columns."""

    name: str
    columns: list[tuple[str, str, bool]] = field(default_factory=list)
    primary: list[tuple[str, bool]] = field(default_factory=list)
    secondary: dict[str, list[tuple[str, bool]]] = field(default_factory=dict)
    text: list[str] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, TYPES[t], null) for n, t, null in self.columns])


def parse_ddl(source: str) -> dict[str, TableDef]:
    """``table name { col type [not] null; primary key (a, b desc); other key (c); text col; }`` for each table."""
    out = {}
    for name, body in re.findall(r"\btable\s+(\w+)\s*\{(.*?)\}", source, re.S):
        t = TableDef(name)
        for item in filter(None, map(str.strip, body.split(";"))):
            if m := re.fullmatch(r"(\w+)\s+key\s*\((.*)\)", item, re.S):
                key = [(c, way != "desc") for c, way in re.findall(r"(\w+)(?:\s+(asc|desc))?", m[2])]
                if m[1] == "primary":
                    t.primary = key
                else:
                    t.secondary[m[1]] = key
            elif m := re.fullmatch(r"text\s+(\w+)", item):
                t.text.append(m[1])
            elif m := re.fullmatch(r"(\w+)\s+(\w+)(?:\s+(not\s+)?null)?", item):
                if m[2] not in TYPES:
                    raise ValueError(f"no type {m[2]}")
                t.columns.append((m[1], m[2], not m[3]))
            else:
                raise ValueError(f"can't read {item!r} of table {name}")
        names = {c for c, _, _ in t.columns}
        for key in [t.primary, *t.secondary.values()]:
            if unknown := {c for c, _ in key} - names:
                raise ValueError(f"key of {name} names {sorted(unknown)}")
        out[name] = t
    return out


def read_csv(spark: SparkSession, path: str, table: TableDef, delimiter: str = ",", quote: str = '"', escape: str = "\\", null: str = "", header: bool = False, true: str = "true", false: str = "false", multi_line: bool = False) -> DataFrame:
    """Rows with the table's types; a row that does not fit, or a null where there may be none, raises. Quoted fields may hold line
    ends if multi_line is set; a file is then read by one task."""
    as_text = T.StructType([T.StructField(n, T.StringType() if t == "bool" else TYPES[t], True) for n, t, _ in table.columns])
    df = spark.read.csv(path, schema=as_text, sep=delimiter, quote=quote, escape=escape, nullValue=null, header=header, mode="FAILFAST", multiLine=multi_line)
    for n, t, nullable in table.columns:
        c = F.col(n)
        if t == "bool":
            c = F.when(c == true, True).when(c == false, False).when(c.isNotNull(), F.raise_error(F.concat(F.lit(f"{n}: no truth value "), c)).cast("boolean"))
        if not nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{n} is null")).cast(TYPES[t])).otherwise(c)
        df = df.withColumn(n, c)
    return df


def read_json(spark: SparkSession, path: str, schema: T.StructType, fields: dict[str, str] | None = None) -> DataFrame:
    """Objects of these fields; fields maps a column to the name it has in the objects. A mismatch of type raises."""
    names = {f.name: (fields or {}).get(f.name, f.name) for f in schema.fields}
    raw = T.StructType([T.StructField(names[f.name], f.dataType, f.nullable) for f in schema.fields])
    return spark.read.schema(raw).json(path, mode="FAILFAST").select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()])


def register_table(catalog: Catalog, table: TableDef, df: DataFrame) -> None:
    """The primary key's index holds the record; each further key's holds the primary key; each text column's words lead to it."""
    primary = [c for c, _ in table.primary]
    rest = [n for n, _, _ in table.columns if n not in primary]
    catalog.register(table.name, "record", df, table.primary, rest)
    for name, key in table.secondary.items():
        more = [(c, True) for c in primary if c not in dict(key)]
        catalog.register(f"{table.name}.{name}", "key", df, [*key, *more], primary)
    for c in table.text:
        words = df.select(F.explode(F.array_distinct(F.split(F.lower(c), r"\W+"))).alias("word"), *primary).where("word <> ''")
        catalog.register(f"{table.name}.{c}", "key", words, [("word", True), *table.primary], primary)


def write_index(df: DataFrame, path: str, key: list[str], partition_by: list[str] | None = None, partitions: int | None = None) -> None:
    """Key-sorted Parquet files, so a scan of a key prefix prunes by the files' statistics."""
    dealt = df.repartitionByRange(partitions, *key) if partitions else df.repartitionByRange(*key)
    w = dealt.sortWithinPartitions(*key).write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def import_images(spark: SparkSession, glob: str, base: str) -> DataFrame:
    """Bulk load: appends the files that match to the base table, and rereads it."""
    spark.read.parquet(glob).write.mode("append").parquet(base)
    return spark.read.parquet(base)
