"""Types of the language: what Spark holds them as, and which operand types an operator takes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Type:
    """kind, with args: element types; for addr (type, ascending) members; for obj (name, type) and variant (tag, type or None) ones by name."""

    kind: str
    args: tuple = ()

    def __str__(self) -> str:
        k, a = self.kind, self.args
        if k == "list":
            return f"[{a[0]}]"
        if k == "set":
            return f"{{{a[0]}}}"
        if k == "dict":
            return f"{{{a[0]}: {a[1]}}}"
        if k in ("opt", "seq"):
            return f"{a[0]}{'?' if k == 'opt' else '*'}"
        if k == "addr":
            return f"<[{', '.join(('' if up else 'desc ') + str(t) for t, up in a)}]>"
        if k == "obj":
            return f"<{{{', '.join(f'.{n}: {t}' for n, t in a)}}}>"
        if k == "variant":
            return f"<|{' | '.join(n + (f'({t})' if t else '') for n, t in a)}|>"
        return k


INT, REAL, STR, BOOL, ID, PNT, DIFF, ANY = (Type(k) for k in ("int", "real", "str", "bool", "id", "time_pnt", "time_diff", "any"))
ATOMS = {t.kind: t for t in (INT, REAL, STR, BOOL, ID, PNT, DIFF)}
SPARK = {"int": "bigint", "real": "double", "str": "string", "bool": "boolean", "id": "string", "time_pnt": "timestamp", "time_diff": "interval day to second", "any": "void"}


class TypeMismatch(TypeError):
    pass


def list_of(t: Type) -> Type:
    return Type("list", (t,))


def set_of(t: Type) -> Type:
    return Type("set", (t,))


def dict_of(k: Type, v: Type) -> Type:
    return Type("dict", (k, v))


def opt(t: Type) -> Type:
    return t if t.kind == "opt" else Type("opt", (t,))


def seq(t: Type) -> Type:
    return Type("seq", (t,))


def addr(*members: tuple[Type, bool]) -> Type:
    return Type("addr", members)


def obj(members: dict[str, Type]) -> Type:
    return Type("obj", tuple(sorted(members.items())))


def variant(arms: dict[str, Type | None]) -> Type:
    return Type("variant", tuple(sorted(arms.items())))


def bare(t: Type) -> Type:
    return t.args[0] if t.kind == "opt" else t


def to_spark(t: Type) -> str:
    k, a = t.kind, t.args
    if k == "opt":
        return to_spark(a[0])
    if k in ("list", "set", "seq"):
        return f"array<{to_spark(a[0])}>"
    if k == "dict":
        return f"map<{to_spark(a[0])},{to_spark(a[1])}>"
    if k == "addr":
        return f"struct<{','.join(f'_{n}:{to_spark(m)}' for n, (m, _) in enumerate(a))}>"
    if k == "obj":
        return f"struct<{','.join(f'{n}:{to_spark(m)}' for n, m in a)}>"
    if k == "variant":
        return f"struct<tag:string,{','.join(f'{n}:{to_spark(m) if m else 'boolean'}' for n, m in a)}>"
    if k not in SPARK:
        raise TypeMismatch(f"{t} can't be stored")
    return SPARK[k]


def unify(a: Type, b: Type) -> Type:
    """The type of a value that is of one type or the other."""
    if a == b or b.kind == "any":
        return a
    if a.kind == "any":
        return b
    if "opt" in (a.kind, b.kind):
        return opt(unify(bare(a), bare(b)))
    if a.kind == b.kind and a.kind in ("list", "set", "dict"):
        return Type(a.kind, tuple(unify(x, y) for x, y in zip(a.args, b.args, strict=True)))
    raise TypeMismatch(f"{a} and {b} don't agree")


def _lifted(result: Type, *operands: Type) -> Type:
    return opt(result) if any(t.kind == "opt" for t in operands) else result


def binary(op: str, a: Type, b: Type) -> Type:
    """The result's type; raises for operands that the operator does not take. Unknown operands make the result optional."""
    x, y = bare(a), bare(b)
    kinds = (x.kind, y.kind)
    numbers = {"int", "real"}
    result = None
    if op in ("+", "-", "*"):
        if set(kinds) <= numbers:
            result = INT if kinds == ("int", "int") else REAL
        elif op == "+" and x.kind == y.kind and x.kind in ("str", "list", "dict"):
            result = x if x.kind == "str" else unify(x, y)
        elif op == "-" and kinds == ("set", "set"):
            result = unify(x, y)
        elif op == "-" and kinds == ("dict", "set"):
            result = x
        elif kinds == ("time_diff", "time_diff") and op in "+-":
            result = DIFF
        elif kinds == ("time_pnt", "time_diff") and op in "+-" or kinds == ("time_diff", "time_pnt") and op == "+":
            result = PNT
        elif kinds == ("time_pnt", "time_pnt") and op == "-":
            result = DIFF
        elif op == "*" and kinds == ("int", "str"):
            result = STR
    elif op == "/" and kinds in (("int", "int"), ("real", "real")):
        result = x
    elif op == "%" and kinds == ("int", "int"):
        result = INT
    elif op == "**" and set(kinds) <= numbers:
        result = REAL
    elif op in ("|", "&", "^") and kinds == ("set", "set"):
        result = unify(x, y)
    elif op in ("and", "or", "xor", "and_then", "or_else") and kinds == ("bool", "bool"):
        result = BOOL
    elif op in ("==", "!="):
        if set(kinds) <= numbers or _comparable(x, y):
            result = BOOL
    elif op in ("<", "<=", ">", ">="):
        if set(kinds) <= numbers or _comparable(x, y) and x.kind not in ("bool", "id", "dict", "obj", "variant"):
            result = BOOL
    elif op == "in":
        if kinds == ("str", "str") or y.kind in ("list", "set", "dict"):
            if y.kind != "str":
                unify(x, bare(y.args[0]))
            inner = y.kind in ("list", "set") and y.args[0].kind == "opt"
            return opt(BOOL) if inner else _lifted(BOOL, a, b)
    if result is None:
        raise TypeMismatch(f"{a} {op} {b}")
    return _lifted(result, a, b)


def _comparable(x: Type, y: Type) -> bool:
    if x.kind == y.kind == "addr" and [up for _, up in x.args] != [up for _, up in y.args]:
        return False
    try:
        unify(x, y)
    except TypeMismatch:
        return False
    return True
