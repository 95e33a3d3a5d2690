"""Programs to plans: scalar expressions become Columns, sequences become array columns or, from the store, ordered DataFrames.

Functions are expanded where they are called. A condition on constants is decided while a call is expanded, so recursion
over constants ends; reads become scalar subqueries, which the optimizer turns into joins. A sequence whose map, condition or
fold reads the store becomes a DataFrame of its elements, as no subquery can stand in a lambda.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom import functions as K
from keyloom import types as T
from keyloom.operators.seq import Seq, UncorrelatedError
from keyloom.plans.syntax import parse_expr, parse_package
from keyloom.streaming.mutlog import fold
from keyloom.types import ANY, BOOL, DIFF, INT, PNT, REAL, STR, Type, TypeMismatch, bare

_NONE = object()
_fresh = itertools.count()
_wanted: list[list[tuple[str, Column]]] = []


def _over(s: Seq, f: Callable[[], Val]) -> tuple[Seq, Val]:
    """f's value over the elements of s, and s beside the columns that it takes: what keys of its reads have read themselves."""
    _wanted.append([])
    try:
        v = f()
    finally:
        wanted = _wanted.pop()
    for name, col in wanted:  # a column that is not deterministic stays where it is: a condition pushed below it would nest the reads
        s = s.beside(**{name: F.when(F.monotonically_increasing_id() >= 0, col)})
    return s, v


@dataclass
class Val:
    """A scalar: its type, its Column, its Python value if that is known already, an address's members, and for a read that must
    find its key a Column that is unknown where it doesn't. Of a scanned key held has its type, its value's type and its value's
    Column; part is what such a key's member has of it: the key's held, and the member's place."""

    type: Type
    col: Column
    const: object = _NONE
    members: tuple[Val, ...] = ()
    soft: Column | None = None
    held: tuple | None = None
    part: tuple | None = None


@dataclass(eq=False)
class Base:
    """Where a sequence's elements come from: an array column, or a Seq whose elements are in column name. That is a name of its
    own, so that no inner sequence's elements are taken for them. A Seq that stands in a read of an outer element can't be
    analyzed by itself; where and select alone leave it as it is. Where the elements are scanned keys, held is as a Val's."""

    type: Type
    array: Column | None = None
    frame: Seq | None = None
    name: str = field(default_factory=lambda: f"_v{next(_fresh)}")
    held: tuple | None = None

    @staticmethod
    def of(t: Type, s: Seq) -> Base:
        """Elements in column v of s."""
        name = f"_v{next(_fresh)}"
        return Base(t, None, Seq(s.df.withColumnRenamed("v", name), [(name if c == "v" else c, up) for c, up in s.order], s.source), name)

    def element(self) -> Val:
        return Val(self.type, F.col(self.name), held=self.held)


@dataclass(eq=False)
class SeqVal:
    """A sequence: base elements, and what the map makes of each."""

    base: Base
    map: Callable[[Val], Val]
    endless: tuple[int, int] | None = None

    @property
    def type(self) -> Type:
        return self.map(self.base.element()).type

    def array(self) -> Column:
        if self.endless:
            raise TypeMismatch("an endless range must be cut by take or while")
        if self.base.frame is not None:
            return self._gathered()
        return F.transform(self.base.array, lambda x: self.map(Val(self.base.type, x)).col)

    def _gathered(self) -> Column:
        """All elements in one list, as an uncorrelated scalar subquery; for results that a caller asked for as one value."""
        return self.settled().to_list(F.col("v"), "v").scalar()

    def over(self, frame: Seq) -> SeqVal:
        """Of a sequence without a map, the elements that frame has left."""
        return SeqVal(Base(self.type, frame=frame, name=self.base.name, held=self.base.held), lambda x: x)

    def settled(self, name: str = "v") -> Seq:
        """The mapped elements in one column of an ordered DataFrame."""
        return self.anew(name).frame

    def anew(self, name: str) -> Base:
        """The mapped elements as a base of their own."""
        s, v = _over(self.base.frame, lambda: self.map(self.base.element()))
        hidden = [(f"_o{k}", up) for k, (_, up) in enumerate(s.order)]
        kept = [] if v.held is None else [v.held[-1].alias(f"{name}_held")]
        held = None if v.held is None else (*v.held[:-1], F.col(f"{name}_held"))
        df = s.df.select(v.col.alias(name), *kept, *[F.col(c).alias(h) for (c, _), (h, _) in zip(s.order, hidden, strict=True)])
        return Base(v.type, None, Seq(df, hidden, s.source), name, held)


@dataclass
class Func:
    """A definition with given parameters, in the scope that it was made in."""

    params: dict[str, Type]
    body: tuple
    scope: Scope
    made: SeqVal | None = None


@dataclass
class Scope:
    names: dict[str, object] = field(default_factory=dict)
    up: Scope | None = None

    def find(self, name: str) -> object:
        at = self
        while at is not None:
            if name in at.names:
                return at.names[name]
            at = at.up
        raise NameError(f"no name {name}")


class Database:
    """Entries by key type and value type: each an index of its own, with a mutation log."""

    def __init__(self, spark: SparkSession, parent: Database | None = None) -> None:
        self.spark, self.parent = spark, parent
        self.rows, self.tables, self.seq = {}, {}, itertools.count(1) if parent is None else parent.seq

    def add(self, key_type: Type, value_type: Type, key: tuple, mutator: str, value: object) -> None:
        self.rows.setdefault((key_type, value_type), []).append((next(self.seq), key, mutator, value))

    def attach(self, key_type: Type, value_type: Type, df: DataFrame) -> None:
        """A table of entries with columns k0, k1, ... and v."""
        self.tables[key_type, value_type] = df

    def index(self, key_type: Type, value_type: Type) -> DataFrame:
        n = len(key_type.args)
        ks = [f"k{i}" for i in range(n)]
        names = ", ".join(f"{k} {T.to_spark(m)}" for k, (m, _) in zip(ks, key_type.args, strict=True))
        kind = T.to_spark(value_type)
        rows, table, at = [], None, self
        while at is not None:  # a branch sees its ancestors' entries
            rows += at.rows.get((key_type, value_type), [])
            table = table if table is not None else at.tables.get((key_type, value_type))
            at = at.parent
        if not rows and table is not None:
            return table
        data = [("global", s, str(s), *key, None if m == "tombstone" else m, v, m == "tombstone") for s, key, m, v in rows]
        log = self.spark.createDataFrame(data, f"pov_id string, seq bigint, update_id string, {names}, mutator string, op {kind}, tombstone boolean")
        if table is not None:
            log = log.union(table.select(F.lit("global"), F.lit(0).cast("long"), F.lit(None).cast("string"), *ks, F.lit("assign"), "v", F.lit(False)))
        return fold(log, ks, "v") if rows else log.select(*ks, F.col("op").alias("v"))


FOLD = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "xor": operator.ne, "and_then": lambda a, b: a and b, "or_else": lambda a, b: a or b,
}


class Lowering:
    """Lowers expressions against a database; one for each call, so that now is one time."""

    DEPTH = 200

    def __init__(self, db: Database, user: str | None = None, session: str | None = None) -> None:
        self.db, self.spark = db, db.spark
        self.user, self.session = user, session
        self.depth = 0
        self.effects: list[tuple] = []
        self.predicates: list[Val] = []

    # -- helpers -----------------------------------------------------------

    def const(self, t: Type, v: object) -> Val:
        return Val(t, F.lit(v).cast(T.to_spark(t)), v)

    def lift(self, f: Callable[..., Val], *operands: object) -> object:
        """f over scalars, or element by element over one sequence's maps."""
        seqs = [x for x in operands if isinstance(x, SeqVal)]
        if not seqs:
            return f(*operands)
        base = seqs[0].base
        if any(s.base is not base for s in seqs):
            raise UncorrelatedError("sequences in one map must have one definition")
        return SeqVal(base, lambda e: f(*[x.map(e) if isinstance(x, SeqVal) else x for x in operands]), seqs[0].endless)

    def type_of(self, t: Type, scope: Scope) -> Type:
        """t with names of types replaced."""
        if t.kind == "ref":
            found = scope.find(t.args[0])
            if not isinstance(found, Type):
                raise TypeMismatch(f"{t.args[0]} is no type")
            return self.type_of(found, scope)
        inner = lambda x: self.type_of(x, scope) if isinstance(x, Type) else tuple(inner(y) for y in x) if isinstance(x, tuple) else x
        return Type(t.kind, tuple(inner(x) for x in t.args))

    def eval(self, node: tuple, scope: Scope) -> object:
        return getattr(self, "_" + node[0])(scope, *node[1:])

    def scalar(self, node: tuple, scope: Scope) -> Val:
        v = self.eval(node, scope)
        if not isinstance(v, Val):
            raise TypeMismatch("a single value is needed here")
        return v

    @staticmethod
    def reads(v: Val) -> bool:
        """Whether its Column reads the store."""
        nodes = [v.col._jc.node()]
        while nodes:
            at = nodes.pop()
            if at.getClass().getSimpleName() == "SubqueryExpression":
                return True
            inner = at.children()
            nodes += [inner.apply(i) for i in range(inner.size())]
        return False

    def framed(self, q: SeqVal, *bodies: Callable[[Val], Val], always: bool = False) -> SeqVal:
        """q over an ordered DataFrame if its map, or one of bodies over its elements, reads the store."""
        if q.base.frame is not None or q.endless:
            return q
        e = q.map(q.base.element())
        if not always and not self.reads(e) and not any(self.reads(body(Val(e.type, F.col(q.base.name)))) for body in bodies):
            return q
        return SeqVal(Base.of(q.base.type, Seq.of_list(self.spark.range(1), q.base.array)), q.map)

    def let(self, v: Val, f: Callable[[Column], Column]) -> Column:
        """f of v; if v reads the store, by a column, as no subquery can stand in a higher-order function."""
        if not self.reads(v):
            return f(v.col)
        return self.spark.range(1).select(v.col.alias("_x")).select(f(F.col("_x")).alias("v")).scalar()

    def sequence(self, node: tuple, scope: Scope, *bodies: Callable[[Val], Val]) -> SeqVal:
        """One that reads the store comes without a map, over a DataFrame."""
        v = self.eval(node, scope)
        if isinstance(v, SeqVal):
            q = self.framed(v, *bodies)
            return q if q.base.frame is None else SeqVal(q.anew(f"_v{next(_fresh)}"), lambda x: x)
        raise TypeMismatch(f"a sequence is needed here, not {v.type}")

    # -- leaves ------------------------------------------------------------

    def _const(self, scope, t, v):
        return self.const(t, v)

    def _pnt(self, scope, text):
        import re

        y, mo, d, h, mi, s, z = re.fullmatch(r"(\d+)-(\d+)-(\d+)T(\d+):(\d+):([\d.]+)(Z|[-+]\d+:\d+)", text).groups()
        off = 0 if z == "Z" else (1 if z[0] == "+" else -1) * (int(z[1:].split(":")[0]) * 60 + int(z[1:].split(":")[1]))
        i = F.lit
        return Val(PNT, K.time_pnt(i(int(y)), i(int(mo)), i(int(d)), i(int(h)), i(int(mi)), i(s), i(off)))

    def _diff(self, scope, text):
        back = text[0] == "-"
        day, rest = text.lstrip("+-").split("T")
        h, m, s = rest.split(":")
        return Val(DIFF, K.time_diff(F.lit(int(day)), F.lit(int(h)), F.lit(int(m)), F.lit(s), F.lit(not back)))

    def _ref(self, scope, name):
        found = scope.find(name)
        if isinstance(found, Func):
            if found.params:
                return found
            if found.made is None:
                out = self.call(found, {})
                if not isinstance(out, SeqVal):
                    return out
                found.made = out  # wherever its name stands, it is one sequence
            return found.made
        if isinstance(found, Type):
            return found
        return found

    def _that(self, scope):
        return scope.find("that")

    def _lhs(self, scope):
        return scope.find("lhs")

    def _rhs(self, scope):
        return scope.find("rhs")

    def _start(self, scope, e):
        return scope.find("start")

    def _now(self, scope):
        return Val(PNT, F.current_timestamp())

    def _user_id(self, scope):
        return Val(T.opt(T.ID), F.lit(self.user).cast("string"), self.user)

    def _session_id(self, scope):
        return Val(T.ID, F.lit(self.session).cast("string"), self.session)

    def _given(self, scope, t):
        raise TypeMismatch("given stands alone in a definition")

    # -- constructors ------------------------------------------------------

    def _items(self, items, scope):
        vals = [self.scalar(x, scope) for x in items]
        t = vals[0].type
        for v in vals[1:]:
            t = T.unify(t, v.type)
        return t, F.array(*[v.col.cast(T.to_spark(t)) for v in vals])

    def _list(self, scope, items):
        t, c = self._items(items, scope)
        return Val(T.list_of(t), c)

    def _set(self, scope, items):
        t, c = self._items(items, scope)
        return Val(T.set_of(t), K.make_set(c))

    def _dict(self, scope, pairs):
        kt, ks = self._items([k for k, _ in pairs], scope)
        vt, vs = self._items([v for _, v in pairs], scope)
        return Val(T.dict_of(kt, vt), K.make_dict(ks, vs))

    def _addr(self, scope, members):
        made = [(up, self.eval(e, scope)) for up, e in members]

        def f(*vals):
            t = T.addr(*[(v.type, up) for (up, _), v in zip(made, vals, strict=True)])
            const = tuple(v.const for v in vals)
            held = vals[0].part[0] if vals and vals[0].part else None
            own = held is not None and held[0] == t and all(v.part and v.part[0] is held and v.part[1] == k for k, v in enumerate(vals))
            return Val(t, F.struct(*[v.col.alias(f"_{k}") for k, v in enumerate(vals)]), _NONE if _NONE in const else const, vals, held=held if own else None)

        return self.lift(f, *[v for _, v in made])

    def _obj(self, scope, members):
        made = sorted((n, self.eval(e, scope)) for n, e in members)
        names = [n for n, _ in made]
        return self.lift(lambda *vals: Val(T.obj({n: v.type for n, v in zip(names, vals, strict=True)}), F.struct(*[v.col.alias(n) for n, v in zip(names, vals, strict=True)])), *[v for _, v in made])

    def _range(self, scope, start, second, end, closed):
        a = self.scalar(start, scope)
        b = None if second is None else self.scalar(second, scope)
        e = None if end is None else self.scalar(end, scope)
        if e is None:
            if a.const is _NONE or b is not None and b.const is _NONE:
                raise TypeMismatch("an endless range starts at a constant")
            step = b.const - a.const if b else 1
            return SeqVal(Base(INT, F.array().cast("array<bigint>")), lambda x: x, (a.const, step))
        step = b.col - a.col if b is not None else F.when(a.col <= e.col, F.lit(1)).otherwise(F.lit(-1)).cast("long")
        bad = (step == 0) | ((e.col != a.col) & ((e.col > a.col) != (step > 0)))
        step = F.when(bad, F.raise_error(F.lit("range: stride leads away from the end")).cast("long")).otherwise(step)
        whole = F.sequence(a.col, e.col, step)
        return SeqVal(Base(INT, whole if closed else F.filter(whole, lambda x: x != e.col)), lambda x: x)

    def _empty(self, scope, t):
        t = self.type_of(t, scope)
        if t.kind == "str":
            return self.const(STR, "")
        return Val(t, (F.create_map() if t.kind == "dict" else F.array()).cast(T.to_spark(t)))

    def _unknown(self, scope, t):
        t = self.type_of(t, scope)
        return Val(T.opt(t), F.lit(None).cast(T.to_spark(t)), None)

    def _tag(self, scope, t, tag):
        t = self.type_of(t, scope)
        if dict(t.args).get(tag, _NONE) is None:
            return Val(t, self._variant(t).make(tag))
        return ("arm", t, tag)

    @staticmethod
    def _variant(t: Type) -> K.Variant:
        return K.Variant({n: T.to_spark(m) if m else None for n, m in t.args})

    def _construct(self, scope, callee, arg):
        made = self.eval(callee, scope)
        if not (isinstance(made, tuple) and made[0] == "arm"):
            raise TypeMismatch("only a variant's arm takes a bare argument")
        _, t, tag = made
        return self.lift(lambda p: Val(t, self._variant(t).make(tag, p.col)), self.eval(arg, scope))

    # -- operators ---------------------------------------------------------

    def _unary(self, scope, op, e):
        def f(v):
            if bare(v.type).kind not in ("int", "real", "time_diff"):
                raise TypeMismatch(f"{op}{v.type}")
            if op == "+":
                return v
            return Val(v.type, -v.col, -v.const if v.const is not _NONE and v.const is not None else _NONE)

        return self.lift(f, self.eval(e, scope))

    def _not(self, scope, e):
        return self.lift(lambda v: Val(v.type, ~v.col, (None if v.const is None else not v.const) if v.const is not _NONE else _NONE), self.eval(e, scope))

    def _binary(self, scope, op, a, b):
        return self.lift(lambda x, y: self.operate(op, x, y), self.eval(a, scope), self.eval(b, scope))

    def operate(self, op: str, a: Val, b: Val) -> Val:
        t = T.binary(op, a.type, b.type)
        x, y, kind = a.col, b.col, bare(a.type).kind
        const = _NONE
        if op in FOLD and _NONE not in (a.const, b.const) and a.const is not None and b.const is not None and kind in ("int", "real", "bool", "str"):
            const = FOLD[op](a.const, b.const)
            if isinstance(const, int) and not isinstance(const, bool) and abs(const) >= 1 << 63:
                raise OverflowError(f"{a.const} {op} {b.const}")
            return self.const(t if t.kind != "opt" else t.args[0], const)
        if bare(t) == REAL and op in ("+", "-", "*"):
            x, y = x.cast("double"), y.cast("double")
        if op == "in":
            return Val(t, K.has(y, x, bare(b.type).kind))
        if op in ("|", "&", "^") or op == "-" and kind == "set":
            return Val(t, {"|": K.set_union, "&": K.set_intersection, "^": K.set_symmetric_difference, "-": K.set_difference}[op](x, y))
        if kind == "set" and op in ("<", "<=", ">", ">="):
            return Val(t, {"<": lambda: K.proper_subset(x, y), "<=": lambda: K.subset(x, y), ">": lambda: K.proper_subset(y, x), ">=": lambda: K.subset(y, x)}[op]())
        if kind == "dict" and op in ("==", "!=", "-", "+"):
            return Val(t, {"==": lambda: K.dict_equal(x, y), "!=": lambda: ~K.dict_equal(x, y), "-": lambda: K.dict_without(x, y), "+": lambda: K.dict_merge(x, y)}[op]())
        if op == "*" and kind == "int" and bare(b.type) == STR:
            return Val(t, F.repeat(y, x.cast("int")))
        if op == "/":
            return Val(t, K.divide(x, y, kind == "int"))
        simple = {
            "+": lambda: F.concat(x, y) if kind in ("str", "list") else x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % y, "**": lambda: K.power(x, y), "and": lambda: x & y, "or": lambda: x | y,
            "xor": lambda: x != y, "and_then": lambda: K.and_then(x, y), "or_else": lambda: K.or_else(x, y), "==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y,
        }
        return Val(t, simple[op]())

    def _is_known(self, scope, e):
        return self.lift(lambda v: Val(BOOL, v.col.isNotNull(), v.const is not None if v.const is not _NONE else _NONE), self.eval(e, scope))

    def _is_unknown(self, scope, e):
        return self.lift(lambda v: Val(BOOL, v.col.isNull(), v.const is None if v.const is not _NONE else _NONE), self.eval(e, scope))

    def _is_known_as(self, scope, e, v):
        return self.lift(lambda a, b: Val(BOOL, F.coalesce(self.operate("==", a, b).col, F.lit(False))), self.eval(e, scope), self.eval(v, scope))

    def _known(self, scope, e):
        return self.lift(lambda v: Val(bare(v.type), K.known(v.col, T.to_spark(v.type)), v.const if v.const is not None else _NONE), self.eval(e, scope))

    def _is_empty(self, scope, e):
        return self.lift(lambda v: Val(BOOL, K.is_empty(v.col, bare(v.type).kind)), self.eval(e, scope))

    def _is_tag(self, scope, e, tag):
        return self.lift(lambda v: Val(BOOL, self._variant(v.type).is_(v.col, tag)), self.eval(e, scope))

    def _length_of(self, scope, e):
        return self.lift(lambda v: Val(INT, K.length_of(v.col, bare(v.type).kind)), self.eval(e, scope))

    def _reverse_of(self, scope, e):
        return self.lift(lambda v: Val(v.type, F.reverse(v.col)), self.eval(e, scope))

    def _time_obj(self, scope, e):
        def f(v):
            if bare(v.type) == PNT:
                return Val(T.obj({n: INT for n in ("year", "month", "day", "hour", "minute", "second", "nanosecond", "utc_offset")}), K.time_pnt_fields(v.col))
            return Val(T.obj({"is_forward": BOOL} | {n: INT for n in ("day", "hour", "minute", "second")}), K.time_diff_fields(v.col))

        return self.lift(f, self.eval(e, scope))

    def _addr_of(self, scope, e):
        if e[0] != "read":
            raise TypeMismatch("& takes a stored value")
        return self.eval(e[1], scope)

    def _apply(self, scope, name, args):
        def f(*vals):
            ok = {"floor", "ceiling", "sin", "cos", "tan", "asin", "acos", "atan", "atan2"}
            if name in ok and any(bare(v.type) != REAL for v in vals):
                raise TypeMismatch(f"{name} takes reals")
            return Val(STR if name.startswith("to_") else REAL, getattr(K, name)(*[v.col for v in vals]))

        return self.lift(f, *[self.eval(a, scope) for a in args])

    def _named(self, scope, name, args):
        names, vals = list(args), [self.eval(e, scope) for e in args.values()]

        def f(*got):
            a = {n: v.col for n, v in zip(names, got, strict=True)}
            if name == "replace":
                return Val(STR, K.replace(a["oldstr"], a["regex"], a["newstr"]))
            if name == "random_int":
                return Val(INT, K.random_int(0, a["gen_id"], a["min"], a["max"], a["idx"]))
            at = [a.get(n, F.lit(0)) for n in ("day", "hour", "minute", "second")]
            if name == "time_diff":
                return Val(DIFF, K.time_diff(*at, a.get("is_forward", F.lit(True))))
            return Val(PNT, K.time_pnt(a["year"], a.get("month", F.lit(1)), a.get("day", F.lit(1)), *at[1:], a.get("utc_offset", F.lit(0))))

        return self.lift(f, *vals)

    def _member(self, scope, e, name):
        made = self.eval(e, scope)
        if isinstance(made, Type):
            return self._tag(scope, made, name)

        def f(v):
            t = bare(v.type)
            if t.kind == "addr":
                return Val(t.args[name][0], v.col[f"_{name}"], v.const[name] if v.const is not _NONE else _NONE, part=v.held and (v.held, name))
            found = dict(t.args).get(name, _NONE)
            if found is _NONE:
                raise TypeMismatch(f"{t} has no member {name}")
            return Val(found or BOOL, self._variant(t).get(v.col, name) if t.kind == "variant" else v.col[name])

        return self.lift(f, made)

    def _index(self, scope, e, i):
        def f(v, k):
            t = bare(v.type)
            return Val(t if t == STR else t.args[-1], K.index_at(v.col, k.col, t.kind))

        return self.lift(f, self.eval(e, scope), self.eval(i, scope))

    def _slice(self, scope, e, a, b):
        ends = [None if x is None else self.eval(x, scope) for x in (a, b)]
        given = [x for x in ends if x is not None]

        def f(v, *got):
            it = iter(got)
            lo, hi = (None if x is None else next(it).col for x in ends)
            return Val(v.type, K.slice_of(v.col, lo, hi, bare(v.type).kind))

        return self.lift(f, self.eval(e, scope), *given)

    def _if_else(self, scope, yes, pred, no):
        p = self.eval(pred, scope)
        if isinstance(p, Val):
            self.predicates.append(p)
        if isinstance(p, Val) and p.const is not _NONE:
            return self.eval(yes if p.const else no, scope)

        def f(c, a, b):
            t = T.unify(a.type, b.type)
            kind = T.to_spark(t)
            return Val(t, F.when(c.col, a.col.cast(kind)).otherwise(b.col.cast(kind)))

        a, b = self.eval(yes, scope), self.eval(no, scope)
        if isinstance(p, Val) and isinstance(a, SeqVal) and isinstance(b, SeqVal) and a.base is not b.base:
            return SeqVal(Base(a.type, F.when(p.col, self.framed(a).array()).otherwise(self.framed(b).array())), lambda x: x)
        return self.lift(f, p, a, b)

    def _when(self, scope, e, arms):
        def f(v):
            t = bare(v.type)
            if set(arms) != {n for n, _ in t.args}:
                raise TypeMismatch(f"arms {sorted(arms)} for {t}")
            out, kind = None, None
            for tag, (binder, body) in arms.items():
                inner = Scope({binder: Val(dict(t.args)[tag] or BOOL, v.col[tag])} if binder else {}, scope)
                r = self.scalar(body, inner)
                kind = r.type if kind is None else T.unify(kind, r.type)
                out = F.when(v.col["tag"] == tag, r.col) if out is None else out.when(v.col["tag"] == tag, r.col)
            return Val(kind, out)

        return self.lift(f, self.eval(e, scope))

    def _where(self, scope, e, defs):
        return self.eval(e, self.define(defs, Scope({}, scope)))

    def _assert(self, scope, e, claims):
        out = self.eval(e, scope)
        for label, claim in claims:
            c = self.scalar(claim, Scope({"that": out}, scope))
            if c.const is False:
                raise AssertionError(label or "assertion failed")
            if c.const is _NONE and isinstance(out, Val):
                out = Val(out.type, F.when(c.col, out.col).otherwise(F.raise_error(F.lit(f"assertion {label or 'failed'}")).cast(T.to_spark(out.type))))
        return out

    def _as(self, scope, e, t):
        t = self.type_of(t, scope)
        v = self.eval(e, scope)
        if isinstance(v, SeqVal):
            v, elem = self.framed(v), v.type
            if v.base.frame is not None and t.kind in ("set", "dict"):
                x, rows = F.col("v"), v.settled()
                return Val(T.set_of(elem), rows.to_set(x).scalar()) if t.kind == "set" else Val(T.dict_of(elem.args[0][0], elem.args[1][0]), rows.to_dict(x["_0"], x["_1"]).scalar())
            a = v.array()
            if t.kind == "list":
                return Val(T.list_of(elem), a)
            if t.kind == "set":
                return Val(T.set_of(elem), K.make_set(a))
            if t.kind == "dict":
                ks = F.transform(a, lambda x: x["_0"])
                last = F.filter(a, lambda x, i: ~F.array_contains(F.slice(ks, i + 2, F.size(ks)), x["_0"]))
                return Val(T.dict_of(elem.args[0][0], elem.args[1][0]), F.map_from_entries(F.sort_array(F.transform(last, lambda x: F.struct(x["_0"].alias("key"), x["_1"].alias("value"))))))
        return self.lift(lambda x: self.cast(x, t), v)

    def cast(self, v: Val, t: Type) -> Val:
        a, b = bare(v.type), bare(t)
        if a == b:
            return Val(t, v.col, v.const)
        if b == STR and a.kind in ("int", "real", "bool", "id"):
            return Val(t, K.as_str(v.col, a.kind))
        if b == STR and a == PNT:
            return Val(t, F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        if {a.kind, b.kind} <= {"int", "real", "str", "id", "time_pnt"}:
            return Val(t, v.col.cast(T.to_spark(b)))
        if b.kind == "dict" and a.kind == "addr" and len(a.args) == 2:
            k, x = (self.cast(Val(m, v.col[f"_{i}"]), want).col for i, ((m, _), want) in enumerate(zip(a.args, b.args, strict=True)))
            return Val(t, F.create_map(k, x))
        if b.kind in ("list", "set") and a == b.args[0]:
            return Val(t, F.array(v.col))
        if b.kind in ("list", "set") and a.kind in ("list", "set"):
            inner = self.let(v, lambda c: F.transform(c, lambda x: self.cast(Val(a.args[0], x), b.args[0]).col))
            return Val(t, K.make_set(inner) if b.kind == "set" else inner)
        if a.kind == "variant" == b.kind:
            return Val(t, self._variant(a).widen(v.col, self._variant(b)))
        raise TypeMismatch(f"{v.type} as {t}")

    # -- sequences ---------------------------------------------------------

    def _sequence(self, scope, e):
        v = self.scalar(e, scope)
        t = bare(v.type)
        if t.kind not in ("list", "set", "dict"):
            raise TypeMismatch(f"**{t}")
        elem = T.addr((t.args[0], True), (t.args[1], True)) if t.kind == "dict" else t.args[0]
        if self.reads(v):  # a stored container
            rows, pairs = self.spark.range(1).select(v.col.alias("_all")), t.kind == "dict"
            return SeqVal(Base.of(elem, Seq.of_list(rows, K.as_pairs(F.col("_all")) if pairs else F.col("_all"))), lambda x: x)
        return SeqVal(Base(elem, K.as_pairs(v.col) if t.kind == "dict" else v.col), lambda x: x)

    def _match(self, scope, a, b):
        return SeqVal(Base(STR, K.match(self.scalar(a, scope).col, self.scalar(b, scope).col)), lambda x: x)

    def _split(self, scope, a, b):
        return SeqVal(Base(T.addr((STR, True), (T.opt(STR), True)), K.split(self.scalar(a, scope).col, self.scalar(b, scope).col)), lambda x: x)

    def _pred(self, node, scope, v: Val) -> Column:
        p = self.scalar(node, Scope({"that": v}, scope))
        if p.type != BOOL:
            raise TypeMismatch(f"a condition is bool, not {p.type}; use is known")
        return p.col

    def _filter(self, scope, s, pred):
        q = self.sequence(s, scope, lambda v: Val(BOOL, self._pred(pred, scope, v)))
        if q.base.frame is not None:
            f, ok = _over(q.base.frame, lambda: Val(BOOL, self._pred(pred, scope, q.base.element())))
            return q.over(f.beside(_ok=ok.col).filter(F.col("_ok")))
        return SeqVal(Base(q.type, F.filter(q.array(), lambda x: self._pred(pred, scope, Val(q.type, x)))), lambda x: x)

    def _while(self, scope, s, pred):
        q = self.sequence(s, scope, lambda v: Val(BOOL, self._pred(pred, scope, v)))
        if q.base.frame is not None:
            f, ok = _over(q.base.frame, lambda: Val(BOOL, self._pred(pred, scope, q.base.element())))
            return q.over(f.beside(_ok=ok.col).take_while(F.col("_ok")))
        a = q.array()
        bad = F.array_position(F.transform(a, lambda x: ~self._pred(pred, scope, Val(q.type, x))), F.lit(True))
        return SeqVal(Base(q.type, F.when(bad == 0, a).otherwise(F.slice(a, 1, (bad - 1).cast("int")))), lambda x: x)

    def _take(self, scope, s, n):
        q, k = self.sequence(s, scope), self.scalar(n, scope)
        if q.endless:
            a, step = q.endless
            return SeqVal(Base(INT, F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(k.col, F.lit(0))), lambda i: i < k.col), lambda i: i * step + a)), q.map)
        if q.base.frame is not None:
            if k.const is _NONE:
                raise TypeMismatch("take from the store needs a constant")
            return q.over(q.base.frame.take(k.const))
        return SeqVal(Base(q.type, F.slice(q.array(), F.lit(1), F.greatest(k.col, F.lit(0)).cast("int"))), lambda x: x)

    def _skip(self, scope, s, n):
        q, k = self.sequence(s, scope), self.scalar(n, scope)
        if q.endless and k.const is not _NONE:
            return SeqVal(q.base, q.map, (q.endless[0] + max(0, k.const) * q.endless[1], q.endless[1]))
        if q.base.frame is not None:
            return q.over(q.base.frame.skip(k.const))
        a = q.array()
        return SeqVal(Base(q.type, F.slice(a, (F.greatest(k.col, F.lit(0)) + 1).cast("int"), F.size(a))), lambda x: x)

    def _starts(self, node) -> list[tuple]:
        if not isinstance(node, (tuple, list)):
            return []
        own = [node] if node[:1] == ("start",) else []
        return own + [x for part in node for x in self._starts(part)]

    def _folder(self, node, scope) -> tuple[Val, Callable[[Val, Val], Val]]:
        starts = self._starts(node)
        if len(starts) != 1:
            raise TypeMismatch("a fold has one start")
        start = self.scalar(starts[0][1], scope)
        start = Val(start.type, start.col)
        return start, lambda acc, x: self.scalar(node, Scope({"that": x, "start": acc}, scope))

    def _body(self, node, scope) -> Callable[[Val], Val]:
        """A body over an element, tried to see whether it reads."""

        def f(v):
            start = {"start": Val((x := self.scalar(self._starts(node)[0][1], scope)).type, x.col)} if self._starts(node) else {}
            return self.scalar(node, Scope({"that": v} | start, scope))

        return f

    def _folding(self, s: Seq, e: Val, body: tuple, scope: Scope) -> tuple[Seq, Val]:
        """A fold over the elements e of s: s with the columns that it takes, and the fold as an aggregate.

        start OP g(that), or g(that) OP start where OP commutes, is an aggregate with partial results; g may read the store. Any
        other fold gathers its elements in one list.
        """
        start, f = self._folder(body, scope)
        sides = (body[2], body[3]) if body[0] == "binary" else ()
        own = [k for k, x in enumerate(sides) if x[0] == "start" and not self._starts(x[1])]
        if len(own) == 1 and body[1] in ("+", "|", "and", "or") and not self._starts(sides[1 - own[0]]):
            s, g = _over(s, lambda: self.scalar(sides[1 - own[0]], Scope({"that": e}, scope)))
            x, kind, total = F.col("_g"), g.type.kind, None
            if body[1] == "+" and kind in ("int", "real"):
                total = F.coalesce(F.sum(x), F.lit(0)).cast(T.to_spark(g.type))
            elif body[1] == "|" and kind == "set":
                total = F.array_distinct(F.flatten(F.collect_set(x)))
            elif body[1] in ("and", "or") and kind == "bool":
                total = F.coalesce(F.bool_and(x), F.lit(True)) if body[1] == "and" else F.coalesce(F.bool_or(x), F.lit(False))
            if total is not None:
                return s.beside(_g=g.col), self.operate(body[1], start, Val(g.type, total))
        kind = T.to_spark(start.type)
        return s, Val(start.type, F.aggregate(s.gathered(e.col), start.col.cast(kind), lambda acc, x: f(Val(start.type, acc), Val(e.type, x["v"])).col.cast(kind)))

    def _reduce(self, scope, s, body):
        start, f = self._folder(body, scope)
        q = self.sequence(s, scope, self._body(body, scope))
        if q.base.frame is not None:
            rows, fold = self._folding(q.base.frame, q.base.element(), body, scope)
            return Val(fold.type, rows.df.select(fold.col.alias("v")).scalar())
        kind = T.to_spark(start.type)
        return Val(start.type, F.aggregate(q.array(), start.col.cast(kind), lambda acc, x: f(Val(start.type, acc), Val(q.type, x)).col.cast(kind)))

    def _collated_by(self, scope, s, body, having):
        q = self.sequence(s, scope, self._body(body, scope), self._body(having, scope))
        start, f = self._folder(body, scope)
        key = lambda x: self.scalar(having, Scope({"that": Val(q.type, x)}, scope))
        kt = key(F.col("v")).type
        if q.base.frame is not None:
            rows, k = _over(q.base.frame, lambda: self.scalar(having, Scope({"that": q.base.element()}, scope)))
            rows, fold = self._folding(rows.beside(_k=k.col), q.base.element(), body, scope)
            runs = rows.collated_by("_k", _fold=fold.col)
            pairs = F.struct(F.col("_k").alias("_0"), F.col("_fold").alias("_1"))
            return SeqVal(Base.of(T.addr((kt, True), (fold.type, True)), runs.with_columns(v=pairs)), lambda x: x)
        t = T.addr((kt, True), (start.type, True))
        pair = lambda k, v: F.struct(k.alias("_0"), v.cast(T.to_spark(start.type)).alias("_1"))

        def step(acc, x):
            k, last = key(x).col, F.get(acc, F.size(acc) - 1)
            go_on = (F.size(acc) > 0) & last["_0"].eqNullSafe(k)
            before = F.when(go_on, last["_1"]).otherwise(start.col.cast(T.to_spark(start.type)))
            kept = F.when(go_on, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
            return F.concat(kept, F.array(pair(k, f(Val(start.type, before), Val(q.type, x)).col)))

        return SeqVal(Base(t, F.aggregate(q.array(), F.array().cast(f"array<{T.to_spark(t)}>"), step)), lambda x: x)

    def _collected_by(self, scope, s, body):
        q = self.sequence(s, scope)
        if q.type.kind != "addr" or len(q.type.args) != 2:
            raise TypeMismatch("collected_by takes pairs")
        (kt, _), (vt, _) = q.type.args
        kind = T.to_spark(vt)
        merge = lambda x, y: self.scalar(body, Scope({"lhs": Val(vt, x), "rhs": Val(vt, y)}, scope)).col.cast(kind)
        if q.base.frame is not None:
            v = F.col(q.base.name)
            rows = q.base.frame.beside(_k=v["_0"], _x=v["_1"])
            if body[0] == "binary" and body[1] == "+" and {body[2][0], body[3][0]} == {"lhs", "rhs"} and vt.kind in ("int", "real"):
                folded = rows.collected_by("_k", _x=F.sum("_x"))
            else:
                folded = rows.collected_in_order("_k", F.col("_x"), merge, "_x")
            return Val(T.dict_of(kt, vt), folded.to_dict(F.col("_k"), F.col("_x")).scalar())
        a = q.array()
        keys = K.make_set(F.transform(a, lambda x: x["_0"]))

        def one(k):
            own = F.transform(F.filter(a, lambda x: x["_0"] == k), lambda x: x["_1"])
            return F.struct(k.alias("key"), F.aggregate(F.slice(own, F.lit(2), F.size(own)), F.element_at(own, 1), merge).alias("value"))

        return Val(T.dict_of(kt, vt), F.map_from_entries(F.transform(keys, one)))

    def _union_map(self, scope, s, body):
        q = self.sequence(s, scope, self._body(body, scope))
        rows, of = _over(q.base.frame, lambda: self.scalar(body, Scope({"that": Val(q.type, F.col(q.base.name), held=q.base.held)}, scope)))
        t = of.type
        if t.kind != "set":
            raise TypeMismatch("union_map takes sets")
        if q.base.frame is not None:
            return Val(t, rows.beside(_e=of.col).union_map(F.col("_e")).to_set(F.col("v")).scalar())
        return Val(t, K.make_set(F.flatten(F.transform(q.array(), lambda x: self.scalar(body, Scope({"that": Val(q.type, x)}, scope)).col))))

    def _sorted_by(self, scope, e, body):
        v = self.scalar(e, scope)
        t = bare(v.type)
        if t.kind != "list":
            raise TypeMismatch(f"{t} can't be sorted")
        less = lambda x, y: self.scalar(body, Scope({"lhs": Val(t.args[0], x), "rhs": Val(t.args[0], y)}, scope)).col
        return Val(v.type, self.let(v, lambda c: F.array_sort(c, lambda x, y: F.when(less(x, y), -1).when(less(y, x), 1).otherwise(0))))

    # -- store -------------------------------------------------------------

    def _outer(self, v: Val, gone: list[Column]) -> Column:
        """v as an index's column is held against it. An outer sequence's element is an outer reference; what was read for it
        comes in a column of its own first, and gone has the condition that the read found nothing."""
        if v.const is not _NONE:
            return v.col
        if not _wanted or not self.reads(v):
            return v.col.outer()
        name = f"_read{next(_fresh)}"
        _wanted[-1].append((name, v.col if v.soft is None else v.soft))
        if v.soft is not None:
            gone.append(F.col(name).isNull())
        return F.col(name).outer()

    def _members(self, key: Val) -> list[Val]:
        known = key.const is not _NONE
        return list(key.members) or [Val(m, F.lit(key.const[i]).cast(T.to_spark(m)) if known else key.col[f"_{i}"], key.const[i] if known else _NONE) for i, (m, _) in enumerate(key.type.args)]

    def _entries(self, key_type: Type, value_type: Type) -> tuple[DataFrame, list[str], str]:
        """An index under names of its own: of the key's columns and the value's."""
        n = next(_fresh)
        ks, v = [f"_k{n}_{i}" for i in range(len(key_type.args))], f"_value{n}"
        return self.db.index(key_type, bare(value_type)).toDF(*ks, v), ks, v

    def _at(self, key: Val, value_type: Type, of: Callable[[Column], Column]) -> Column:
        """An aggregate of the values at a key; it raises if a read that the key takes has found nothing."""
        df, ks, v = self._entries(key.type, value_type)
        gone: list[Column] = []
        for k, m in zip(ks, self._members(key), strict=True):
            df = df.where(F.col(k) == self._outer(m, gone))
        found = df.select(of(F.col(v)).alias("v")).scalar()
        for missing in gone:
            found = F.when(missing, F.raise_error(F.lit("no value at key"))).otherwise(found)
        return found

    def _read(self, scope, key, t):
        t = self.type_of(t, scope)

        def f(k):
            kind = T.to_spark(t)
            if k.held and k.held[:2] == (k.type, bare(t)):
                return Val(t, k.held[2])  # the scan holds the values
            found = self._at(k, t, F.first)  # no stored value is unknown
            return Val(t, found) if t.kind == "opt" else Val(t, F.coalesce(found, F.raise_error(F.lit("no value at key")).cast(kind)), soft=found)

        return self.lift(f, self.eval(key, scope))

    def _exists(self, scope, t, key):
        t = self.type_of(t, scope)
        return self.lift(lambda k: Val(BOOL, self._at(k, t, lambda v: F.count(F.lit(1)) > 0)), self.eval(key, scope))

    def _keys(self, scope, t, key):
        t = self.type_of(t, scope)
        if key[0] != "addr":
            raise TypeMismatch("keys takes an address")
        fixed = [(up, None if e[0] == "free" else self.eval(e, scope), self.type_of(e[1], scope) if e[0] == "free" else None) for up, e in key[1]]
        lifted = [(i, v) for i, (_, v, _) in enumerate(fixed) if isinstance(v, SeqVal)]
        if len(lifted) > 1:
            raise UncorrelatedError("one member of a scanned address may be a sequence")
        kt = T.addr(*[(v.type if v else free, up) for up, v, free in fixed])
        df, ks, value = self._entries(kt, t)
        order = [(k, up) for k, (up, _, _) in zip(ks, fixed, strict=True)]
        for i, v in lifted:  # a scan for each element, in their order
            s = self.framed(v, always=True).settled()
            each = s.df.select(F.col("v").alias("_each"), *[F.col(c).alias(f"_s{j}") for j, (c, _) in enumerate(s.order)])
            df = each.join(df, F.col("_each") == F.col(ks[i]))
            order = [*[(f"_s{j}", up) for j, (_, up) in enumerate(s.order)], *order]
        df = df.select(F.struct(*[F.col(k).alias(f"_{i}") for i, k in enumerate(ks)]).alias("v"), value, *[c for c, _ in order])
        base = Base.of(kt, Seq(df, order))
        base.held = (kt, bare(t), F.col(value))
        for k, (_, v, _) in zip(ks, fixed, strict=True):
            if isinstance(v, Val):
                base.frame = Seq(base.frame.df.where(F.col(k) == self._outer(v, [])), base.frame.order)
        return SeqVal(base, lambda x: x)

    # -- functions ---------------------------------------------------------

    def define(self, defs: list[tuple], scope: Scope) -> Scope:
        for d in defs:
            kind, name = d[0], d[1]
            if kind == "type":
                scope.names[name] = d[2]
            elif kind in ("value", "sequence"):
                scope.names[name] = self.function(d[2], scope)
        return scope

    def function(self, body: tuple, scope: Scope) -> Func:
        """Its parameters are the definitions of its own where that are given."""
        params = {d[1]: d[2][1] for d in body[2] if d[0] == "value" and d[2][0] == "given"} if body[0] == "where" else {}
        if body[0] in ("effecting", "assert") and body[1][0] == "where":
            params = {d[1]: d[2][1] for d in body[1][2] if d[0] == "value" and d[2][0] == "given"}
        return Func(params, body, scope)

    def call(self, f: Func, args: dict[str, object]) -> object:
        if set(args) != set(f.params):
            raise TypeMismatch(f"arguments {sorted(args)} for parameters {sorted(f.params)}")
        self.depth += 1
        if self.depth > self.DEPTH:
            raise RecursionError("recursion on values that are not known while the plan is made")
        try:
            if f.params:
                body, kept = f.body, f.body
                inner = body if body[0] == "where" else body[1]
                rest = [d for d in inner[2] if not (d[0] == "value" and d[2][0] == "given")]
                kept = ("where", inner[1], rest)
                body = kept if body[0] == "where" else (body[0], kept, *body[2:])
                scope = Scope(dict(args), f.scope)
                if body[0] != "where":  # statements see the where's names too
                    return self.eval((body[0], kept[1], *body[2:]), self.define(rest, scope))
                return self.eval(body, scope)
            return self.eval(f.body, f.scope)
        finally:
            self.depth -= 1

    def _call(self, scope, callee, args):
        f = self.eval(callee, scope)
        if not isinstance(f, Func):
            if not args:
                return f
            raise TypeMismatch("only functions are called")
        names, vals = list(args), [self.eval(e, scope) for e in args.values()]
        lifted = [not (isinstance(v, SeqVal) and self.type_of(f.params[n], scope).kind == "seq") if n in f.params else True for n, v in zip(names, vals, strict=True)]
        whole = {n: v for n, v, up in zip(names, vals, lifted, strict=True) if not up}
        parts = [(n, v) for n, v, up in zip(names, vals, lifted, strict=True) if up]
        if not any(isinstance(v, SeqVal) for _, v in parts):
            return self.call(f, dict(zip(names, vals, strict=True)))
        return self.lift(lambda *got: self.call(f, whole | {n: v for (n, _), v in zip(parts, got, strict=True)}), *[v for _, v in parts])

    # -- effects -----------------------------------------------------------

    def _effecting(self, scope, e, statements):
        out = self.eval(e, scope)
        self.run(statements, scope)
        return out

    def run(self, statements: list[tuple], scope: Scope) -> None:
        for s in statements:
            if s[0] == "if":
                for pred, block in s[1]:
                    p = self.scalar(pred, scope)
                    self.predicates.append(p)
                    if self.fetch(p):
                        self.run(block, scope)
                        break
                else:
                    self.run(s[2], scope)
            elif s[0] == "new":
                key, value = self.scalar(s[1], scope), self.scalar(s[2], scope)
                self.effects.append((key.type, bare(value.type), self.key_of(key), "new", self.fetch(value)))
            elif s[0] == "delete":
                key = self.scalar(s[2], scope)
                self.effects.append((key.type, bare(self.type_of(s[1], scope)), self.key_of(key), "tombstone", None))
            else:
                self.mutate(s[1], s[2], s[3], scope)

    def mutate(self, target: tuple, mutator: str, rhs: tuple, scope: Scope) -> None:
        from keyloom.streaming.mutlog import DEFERRED, combine

        path, at = [], target
        while at[0] in ("member", "index"):
            path.insert(0, at[2])
            at = at[1]
        if at[0] != "read":
            raise TypeMismatch("only stored values can be changed")
        key, t, value = self.scalar(at[1], scope), bare(self.type_of(at[2], scope)), self.scalar(rhs, scope)
        if value.type.kind == "opt":
            raise TypeMismatch("a stored value can't be changed by an unknown")
        if not path and mutator in (*DEFERRED, "assign"):
            if mutator != "assign":
                T.unify(t, value.type)
            elif t != value.type:
                raise TypeMismatch(f"{t} <- {value.type}")
            self.effects.append((key.type, t, self.key_of(key), mutator, self.fetch(value)))
            return
        old = self.scalar(("read", at[1], t), scope)
        part, kinds = old, []
        for p in path:
            kinds.append(part)
            pt = bare(part.type)
            if pt.kind == "obj":
                part = Val(dict(pt.args)[p], part.col[p])
            elif pt.kind == "addr":
                part = Val(pt.args[p][0], part.col[f"_{p}"])
            else:
                k = self.scalar(p, scope)
                part = Val(pt.args[-1], K.index_at(part.col, k.col, pt.kind))
        from pyspark.sql.types import DataType, _parse_datatype_string

        kind: DataType = _parse_datatype_string(T.to_spark(part.type))
        new = value.col if mutator == "assign" else combine(mutator, part.col, value.col, kind)
        for p, whole in reversed(list(zip(path, kinds, strict=True))):
            wt = bare(whole.type)
            if wt.kind in ("obj", "addr"):
                new = whole.col.withField(p if wt.kind == "obj" else f"_{p}", new)
            else:
                new = (K.list_put if wt.kind == "list" else K.dict_put)(whole.col, self.scalar(p, scope).col, new)
        self.effects.append((key.type, t, self.key_of(key), "assign", self.fetch(Val(t, new))))

    def key_of(self, key: Val) -> tuple:
        return key.const if key.const is not _NONE else tuple(self.fetch(key))

    def seen(self) -> list[bool | None]:
        """What the conditions came to that are about one value; those inside maps are none of a transaction's."""
        from pyspark.errors import PySparkException

        out = []
        for p in self.predicates:
            try:
                out.append(self.fetch(p))
            except PySparkException:
                out.append(None)
        return out

    def fetch(self, v: Val) -> object:
        """One value, to the driver."""
        return v.const if v.const is not _NONE and not isinstance(v.const, tuple) else self.spark.range(1).select(v.col.alias("v")).first()[0]


@dataclass
class Program:
    """A package: definitions to call, and tests to run."""

    spark: SparkSession
    source: str
    db: Database | None = None
    imports: dict[str, Program] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.db = self.db or Database(self.spark)
        self.defs = parse_package(self.source)
        self.version = next((d[2] for d in self.defs if d[0] == "version"), 1)

    def scope(self, low: Lowering) -> Scope:
        s = low.define([d for d in self.defs if d[0] in ("value", "sequence", "type")], Scope())
        for d in self.defs:
            if d[0] == "import":
                ref = d[4] if isinstance(d[4], str) else d[4][0]
                alias = next((x[2] for x in self.defs if x[0] == "package" and x[1] == ref), ref)
                s.names[d[1]] = self.imports[alias].scope(low).find(d[3])
        return s

    def lower(self, expr: str, **args: object) -> tuple[object, Lowering]:
        low = Lowering(self.db)
        scope = Scope({n: self._python(low, v) for n, v in args.items()}, self.scope(low))
        return low.eval(parse_expr(expr), scope), low

    @staticmethod
    def _python(low: Lowering, v: object) -> Val:
        kinds = {bool: BOOL, int: INT, float: REAL, str: STR}
        return low.const(kinds[type(v)], v)

    def value(self, expr: str, **args: object) -> object:
        """The value of an expression; a sequence comes as a list. Its effects, if any, are applied as one transaction."""
        v, low = self.lower(expr, **args)
        out = self.result(v, low)
        self.apply(low)
        return out

    def frame(self, expr: str, **args: object) -> DataFrame:
        """The plan of an expression: a row for each element of a sequence, in column v, else one row."""
        v, low = self.lower(expr, **args)
        if isinstance(v, SeqVal):
            v = low.framed(v)
            if v.base.frame is not None:
                return v.settled().to_frame().select("v")
            return self.spark.range(1).select(F.explode(v.array()).alias("v"))
        return self.spark.range(1).select(v.col.alias("v"))

    def result(self, v: object, low: Lowering) -> object:
        if isinstance(v, SeqVal):
            v = low.framed(v)
            if v.base.frame is not None:
                return [r[0] for r in v.settled().to_frame().select("v").collect()]
            v = Val(T.list_of(v.type if v.type != ANY else INT), v.array())
        return low.fetch(v)

    def call(self, name: str, **args: object) -> object:
        return self.value(f"{name}({', '.join(f'.{n}: {n}' for n in args)})", **args) if args else self.value(name)

    def apply(self, low: Lowering) -> None:
        for kt, vt, key, mutator, value in low.effects:
            self.db.add(kt, vt, key, "assign" if mutator == "new" else mutator, value)

    def load(self, entries: list[tuple]) -> None:
        low = Lowering(self.db)
        scope = self.scope(low)
        for k, v in entries:
            key, value = low.scalar(k, scope), low.scalar(v, scope)
            self.db.add(key.type, bare(value.type), low.key_of(key), "assign", low.fetch(value))

    def run_tests(self) -> list[tuple[str, bool]]:
        """(name, passed) of each case. A case's effects hold for the cases inside it."""
        out: list[tuple[str, bool]] = []
        number = itertools.count(1)

        def run(program: Program, cases: list[tuple], prefix: str) -> None:
            for label, e, inner in cases:
                name = f"{prefix}{label or next(number)}"
                low = Lowering(program.db)
                try:
                    passed = bool(program.result(low.eval(e, program.scope(low)), low))
                except Exception as problem:
                    out.append((f"{name}: {problem}"[:300], False))
                    continue
                out.append((name, passed))
                if inner:
                    then = Program(self.spark, self.source, Database(self.spark), self.imports)
                    then.db.rows = {k: list(v) for k, v in program.db.rows.items()}
                    then.db.seq, then.db.tables = program.db.seq, program.db.tables
                    then.apply(low)
                    run(then, inner, name + ".")

        for d in self.defs:
            if d[0] == "test":
                fresh = Program(self.spark, self.source, Database(self.spark), self.imports)
                fresh.load(d[2])
                run(fresh, d[3], "")
        return out


class Packages:
    """Installed packages by name; versions only rise."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.db = spark, Database(spark)
        self.installed: dict[str, Program] = {}

    def install(self, name: str, source: str, test: bool = True) -> Program:
        p = Program(self.spark, source, self.db, self.installed)
        if name in self.installed and p.version < self.installed[name].version:
            raise ValueError(f"{name} is at version {self.installed[name].version}")
        if test and (bad := [n for n, ok in p.run_tests() if not ok]):
            raise ValueError(f"tests of {name} fail: {bad}")
        self.installed[name] = p
        return p

    def uninstall(self, name: str) -> None:
        del self.installed[name]

    def list_packages(self) -> list[tuple[str, int]]:
        return sorted((n, p.version) for n, p in self.installed.items())

    def get_source(self, name: str) -> str:
        return self.installed[name].source
