"""Points of view: a tree of branches of one mutation log, and sessions that call functions in them.

A branch reads its own rows and its ancestors'. Promotion moves a child's updates into its parent, oldest first. An update whose function
recorded predicate results is replayed: the predicates must give the same results on the parent; a branch that fails so
MAX_FAILURES times is given up. Updates without predicates commute and are moved together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.streaming.mutlog import ASSIGN, DEFERRED, RESOLVED, compact, fold, resolve

MAX_FAILURES = 10
GLOBAL = "global"


@dataclass
class Update:
    """One atomic transaction: its rows (key values, mutator, operand), the predicates it saw and the function that can replay it."""

    update_id: str
    rows: list[tuple[tuple, str, object]]
    predicates: list[bool]
    replay: Callable[[Call], object] | None = None
    age: int = 0


@dataclass
class Pov:
    pov_id: str
    parent: str | None
    safe: bool = True
    shared: bool = False
    paused: bool = False
    failures: int = 0
    failed: bool = False
    updates: list[Update] = field(default_factory=list)


class Store:
    """One index's mutation log: a DataFrame for what was committed in bulk, and updates that wait in branches.

    What waits is a driver-side list of updates, as a session makes them one by one; bulk writes are appended as DataFrames.
    """

    def __init__(self, spark: SparkSession, key: Sequence[tuple[str, str]], value_type: str) -> None:
        self.spark, self.key = spark, [k for k, _ in key]
        fields = [("pov_id", "string"), ("seq", "long"), ("update_id", "string"), *key, ("mutator", "string"), ("op", value_type), ("tombstone", "boolean")]
        self.schema = ", ".join(f"{n} {t}" for n, t in fields)
        self.log: DataFrame = spark.createDataFrame([], self.schema)
        self.povs: dict[str, Pov] = {GLOBAL: Pov(GLOBAL, None, shared=True)}
        self.seq, self.events = 0, []

    # -- branches ----------------------------------------------------------

    def new_pov(self, parent: str = GLOBAL, safe: bool = True, shared: bool = False) -> str:
        pov = Pov(uuid.uuid4().hex, self._pov(parent).pov_id, safe, shared)
        self.povs[pov.pov_id] = pov
        return pov.pov_id

    def _pov(self, pov_id: str) -> Pov:
        if pov_id not in self.povs:
            raise KeyError(f"no point of view {pov_id}")
        if self.povs[pov_id].failed:
            raise RuntimeError(f"point of view {pov_id} has failed")
        return self.povs[pov_id]

    def chain(self, pov_id: str) -> list[str]:
        """The branch and its ancestors."""
        out, at = [], self._pov(pov_id)
        while True:
            out.append(at.pov_id)
            if at.parent is None:
                return out
            at = self.povs[at.parent]

    def pause(self, pov_id: str) -> None:
        self._pov(pov_id).paused = True

    def unpause(self, pov_id: str) -> None:
        self._pov(pov_id).paused = False

    # -- reading -----------------------------------------------------------

    def entries(self, pov_id: str = GLOBAL) -> DataFrame:
        """The log rows that a branch sees."""
        chain = self.chain(pov_id)
        waiting = [(p, u.age, u.update_id, *k, None if m == "tombstone" else m, op, m == "tombstone") for p in chain for u in self.povs[p].updates for k, m, op in u.rows]
        rows = self.log.where(F.col("pov_id").isin(chain))
        return rows.union(self.spark.createDataFrame(waiting, self.schema)) if waiting else rows

    def read(self, pov_id: str = GLOBAL) -> DataFrame:
        return fold(self.entries(pov_id), self.key)

    # -- writing -----------------------------------------------------------

    def append(self, rows: DataFrame, pov_id: str = GLOBAL) -> None:
        """A bulk load: a row for each mutation, with the key's columns, mutator, op and tombstone; one update."""
        self._pov(pov_id)
        self.seq += 1
        names = [f.split(" ")[0] for f in self.schema.split(", ")]
        self.log = self.log.union(rows.withColumns({"pov_id": F.lit(pov_id), "seq": F.lit(self.seq).cast("long"), "update_id": F.lit(uuid.uuid4().hex)}).select(*names))

    def call(self, pov_id: str, f: Callable[[Call], object]) -> object:
        """f(call) reads and writes through call; its writes are one update. Several deferred ones of a key and mutator
        join; mixed ones are an error."""
        return self.batch(pov_id, [f])[0]

    def batch(self, pov_id: str, fs: Sequence[Callable[[Call], object]]) -> list[object]:
        """Several calls as one transaction: all read the state before it."""
        pov, call = self._pov(pov_id), Call(self, pov_id)
        results = [f(call) for f in fs]
        self.seq += 1
        rows = call.finish()
        if rows:
            replay = (lambda c: [f(c) for f in fs]) if call.predicates else None
            pov.updates.append(Update(uuid.uuid4().hex, rows, call.predicates, replay, self.seq))
        return results

    # -- promotion ---------------------------------------------------------

    def promote(self, pov_id: str) -> int:
        """Moves what it can of a branch's updates into its parent; returns how many."""
        pov = self._pov(pov_id)
        if pov.parent is None:
            raise ValueError("the global point of view has no parent")
        if pov.paused:
            return 0
        parent, moved = self.povs[pov.parent], 0
        while pov.updates:
            update = pov.updates[0]
            if update.replay is not None:
                call = Call(self, parent.pov_id)
                update.replay(call)
                if call.predicates != update.predicates:
                    pov.failures += 1
                    if pov.failures >= MAX_FAILURES:
                        pov.failed = True
                        self.events.append(("pov_failure", pov_id))
                    break
                update.rows = call.finish()
            pov.updates.pop(0)
            self.seq += 1
            update.age = self.seq
            parent.updates.append(update)
            self.events.append(("update_progress", update.update_id))
            moved += 1
        return moved

    def flush(self) -> None:
        """Appends the global branch's waiting updates to the log table."""
        self.log, self.povs[GLOBAL].updates = self.entries(GLOBAL), []

    def compact(self) -> None:
        self.flush()
        self.log = compact(self.log, self.key)


class Call:
    """What a function sees: reads of its branch's state before the transaction, and writes that are kept until its end."""

    def __init__(self, store: Store, pov_id: str) -> None:
        self.store, self.pov_id = store, pov_id
        self.writes: dict[tuple, list[tuple[str, object]]] = {}
        self.predicates: list[bool] = []

    def get(self, *key: object, default: object = None) -> object:
        df = self.store.entries(self.pov_id)
        for c, v in zip(self.store.key, key, strict=True):
            df = df.where(F.col(c) == F.lit(v))
        rows = fold(df, self.store.key).select("value").collect()  # one key
        return rows[0][0] if rows else default

    def check(self, predicate: bool) -> bool:
        """Records a condition that the caller branches on; promotion replays it."""
        self.predicates.append(bool(predicate))
        return bool(predicate)

    def mutate(self, key: tuple, mutator: str, op: object) -> None:
        if mutator not in (*DEFERRED, *RESOLVED, ASSIGN, "new", "tombstone"):
            raise ValueError(f"no mutator {mutator}")
        self.writes.setdefault(tuple(key), []).append((mutator, op))

    def assign(self, key: tuple, value: object) -> None:
        self.mutate(key, ASSIGN, value)

    def new(self, key: tuple, value: object) -> None:
        self.mutate(key, "new", value)

    def delete(self, key: tuple) -> None:
        self.mutate(key, "tombstone", None)

    def finish(self) -> list[tuple[tuple, str, object]]:
        out = []
        for key, ops in self.writes.items():
            kinds = {m for m, _ in ops}
            if len(ops) > 1 and (len(kinds) > 1 or kinds & {"new", "tombstone", ASSIGN}):
                raise ValueError(f"mutations of {key} in one transaction don't combine: {sorted(kinds)}")
            m = ops[0][0]
            if m in RESOLVED:
                out.append((key, ASSIGN, self._resolved(key, ops)))
            else:
                out += [(key, ASSIGN if m == "new" else m, op) for op in ([ops[0][1]] if len(ops) == 1 else [self._joined(m, [o for _, o in ops])])]
        return out

    def _resolved(self, key: tuple, ops: list[tuple[str, object]]) -> object:
        spark, names, value = self.store.spark, self.store.key, self.get(*key)
        kind = self.store.log.schema["op"].dataType
        if value is None:
            raise KeyError(f"{ops[0][0]}: no value at {key}")
        schema = T.StructType([*[self.store.log.schema[k] for k in names], T.StructField("value", kind)])
        for m, op in ops:
            values = spark.createDataFrame([(*key, value)], schema)
            value = resolve(values, names, values.select(*names).withColumn("op", F.lit(op).cast(kind)), m).first()["op"]
        return value

    @staticmethod
    def _joined(m: str, ops: list) -> object:
        from functools import reduce
        from operator import and_, mul, or_, xor

        merge = {"add": lambda a, b: a | b if isinstance(a, dict) else a + b, "mult": mul, "min": min, "max": max, "and": and_, "or": or_, "xor": xor}
        sets = {"union": or_, "intersection": and_, "symmetric_diff": xor}
        return sorted(reduce(sets[m], map(set, ops))) if m in sets else reduce(merge[m], ops)
