"""Tagged unions: a struct of the tag and one nullable field an arm, of which the tag's is set."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class Variant:
    """arms: Spark type of each arm's payload, or None for an arm that is only a tag."""

    def __init__(self, arms: Mapping[str, str | None]) -> None:
        self.arms = dict(sorted(arms.items()))

    @property
    def spark_type(self) -> str:
        return f"struct<tag:string,{','.join(f'{k}:{t or 'boolean'}' for k, t in self.arms.items())}>"

    def make(self, tag: str, payload: Column | None = None) -> Column:
        self._arm(tag)
        if (payload is None) != (self.arms[tag] is None):
            raise TypeError(f"{tag} takes {'a' if self.arms[tag] else 'no'} payload")
        own = F.lit(True) if payload is None else payload
        return F.struct(F.lit(tag).alias("tag"), *[(own if k == tag else F.lit(None)).cast(t or "boolean").alias(k) for k, t in self.arms.items()])

    def is_(self, v: Column, tag: str) -> Column:
        self._arm(tag)
        return v["tag"] == tag

    def get(self, v: Column, tag: str) -> Column:
        """The payload; raises where the value is of another arm."""
        self._arm(tag)
        return F.when(v["tag"] == tag, v[tag]).otherwise(F.raise_error(F.concat(F.lit(f"not {tag} but "), v["tag"])).cast(self.arms[tag] or "boolean"))

    def when(self, v: Column, cases: Mapping[str, Callable[[Column], Column]]) -> Column:
        """One case for every arm."""
        if set(cases) != set(self.arms):
            raise TypeError(f"cases {sorted(cases)} don't match arms {sorted(self.arms)}")
        out = None
        for tag, f in cases.items():
            cond = v["tag"] == tag
            out = F.when(cond, f(v[tag])) if out is None else out.when(cond, f(v[tag]))
        return out

    def widen(self, v: Column, to: Variant) -> Column:
        if not set(self.arms.items()) <= set(to.arms.items()):
            raise TypeError("a variant widens to one that has all its arms")
        return F.when(v.isNotNull(), F.struct(v["tag"].alias("tag"), *[(v[k] if k in self.arms else F.lit(None)).cast(t or "boolean").alias(k) for k, t in to.arms.items()]))

    def _arm(self, tag: str) -> None:
        if tag not in self.arms:
            raise TypeError(f"no arm {tag} in {sorted(self.arms)}")
