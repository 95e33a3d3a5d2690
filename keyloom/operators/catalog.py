"""Indexes: every pair of a key type and a value type is a table of its own, scanned in the order of its key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.seq import Seq

FREE = object()


@dataclass(frozen=True)
class Index:
    """A table of entries: key columns with their directions, and the value's columns."""

    df: DataFrame
    key: tuple[tuple[str, bool], ...]
    value: tuple[str, ...]

    @property
    def key_names(self) -> list[str]:
        return [c for c, _ in self.key]


class Catalog:
    def __init__(self) -> None:
        self._indexes: dict[tuple[str, str], Index] = {}

    def register(self, name: str, value_type: str, df: DataFrame, key: Sequence[str | tuple[str, bool]], value: Sequence[str]) -> Index:
        """key: column names, ascending unless given as (name, False). An index is found by name and value type alone."""
        made = Index(df, tuple((k, True) if isinstance(k, str) else k for k in key), tuple(value))
        self._indexes[name, value_type] = made
        return made

    def index(self, name: str, value_type: str) -> Index:
        if (name, value_type) not in self._indexes:
            raise KeyError(f"no entries {name} of type {value_type}")
        return self._indexes[name, value_type]

    def list_schema(self) -> list[tuple[str, str, str]]:
        return sorted((n, v, i.df.select(*i.key_names, *i.value).schema.simpleString()) for (n, v), i in self._indexes.items())

    def keys(self, name: str, value_type: str, **members: object) -> Seq:
        """Keys whose members equal those given; members given as FREE or left out are free. In key order."""
        return self._scan(name, value_type, members, False)

    def values(self, name: str, value_type: str, **members: object) -> Seq:
        """Keys with their values: the read of each scanned key, from the same scan."""
        return self._scan(name, value_type, members, True)

    def _scan(self, name: str, value_type: str, members: Mapping[str, object], values: bool) -> Seq:
        i = self.index(name, value_type)
        if unknown := set(members) - set(i.key_names):
            raise KeyError(f"no key members {sorted(unknown)}")
        df = i.df
        for k, v in members.items():
            if v is not FREE:
                df = df.where(F.col(k) == (v if isinstance(v, Column) else F.lit(v)))
        return Seq(df.select(*i.key_names, *(i.value if values else ())), i.key)

    def keys_of_each(self, name: str, value_type: str, outer: Seq, on: Mapping[str, str], values: bool = False) -> Seq:
        """A scan for each element of a sequence, as one join: on maps key members to columns of outer."""
        i = self.index(name, value_type)
        inner = i.df.select(*i.key_names, *(i.value if values else ()))
        left = outer.df.withColumns({f"_o_{k}": F.col(c) for k, c in on.items()})
        cond = [F.col(f"_o_{k}") == inner[k] for k in on]
        clash = [c for c in outer.columns if c in inner.columns]
        df = left.drop(*clash).join(inner, cond).drop(*[f"_o_{k}" for k in on])
        order = [o for o in outer.order if o[0] not in clash] + list(i.key)
        return Seq(df, order, outer.source)

    def read(self, name: str, value_type: str, optional: bool = False, **key: object) -> DataFrame:
        """The value of one key, a row: if it is absent, unknown for an optional read, else an error."""
        i = self.index(name, value_type)
        if set(key) != set(i.key_names):
            raise KeyError(f"a read needs all of {i.key_names}")
        row = self._scan(name, value_type, key, True).df.select(*i.value)
        out = row.agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in i.value])
        if not optional:
            out = out.where(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no value at {key}")).cast("boolean")).otherwise(True))
        return out.drop("_n")

    def exists(self, name: str, value_type: str, **key: object) -> DataFrame:
        if (name, value_type) not in self._indexes:
            raise KeyError(f"no entries {name} of type {value_type}")
        return self._scan(name, value_type, key, False).df.limit(1).agg((F.count("*") > 0).alias("exists"))
