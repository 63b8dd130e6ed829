"""Syntax tree, and its way back to text (names of unnamed columns, stored views)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object
    type: str | None


@dataclass(frozen=True)
class Param:
    n: int


@dataclass(frozen=True)
class Ref:
    table: str | None
    name: str


@dataclass(frozen=True)
class Unary:
    op: str  # - + not
    e: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Is:
    e: object
    what: object  # None, True, False
    negated: bool


@dataclass(frozen=True)
class Like:
    e: object
    pattern: object
    fold: bool
    negated: bool


@dataclass(frozen=True)
class Case:
    operand: object
    branches: tuple
    default: object


@dataclass(frozen=True)
class Cast:
    e: object
    type: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False
    distinct: bool = False


@dataclass(frozen=True)
class Scalar:
    query: object


@dataclass(frozen=True)
class Exists:
    query: object


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None
    columns: tuple = ()


@dataclass(frozen=True)
class Function:
    name: str
    args: tuple
    alias: str | None = None
    columns: tuple = ()


@dataclass(frozen=True)
class Derived:
    query: object
    alias: str | None = None
    columns: tuple = ()


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    on: object = None
    using: tuple = ()


@dataclass(frozen=True)
class Select:
    items: tuple  # (expression or "*", alias)
    source: object = None
    where: object = None
    group: tuple = ()
    having: object = None
    distinct: bool = False
    distinct_on: tuple = ()


@dataclass(frozen=True)
class Values:
    rows: tuple


@dataclass(frozen=True)
class Union:
    left: object
    right: object
    all: bool


@dataclass(frozen=True)
class Query:
    body: object
    order: tuple = ()  # (expression, ascending, nulls_first or None)
    limit: object = None
    offset: object = None


@dataclass(frozen=True)
class Statement:
    kind: str
    args: dict = field(default_factory=dict, hash=False)


def text_of(e) -> str:
    """SQL text of an expression or query."""
    if isinstance(e, Lit):
        if e.value is None:
            return "NULL"
        return "'" + e.value.replace("'", "''") + "'" if isinstance(e.value, str) else str(e.value).upper() if isinstance(e.value, bool) else str(e.value)
    if isinstance(e, Param):
        return f"${e.n}"
    if isinstance(e, Ref):
        return f"{e.table}.{e.name}" if e.table else e.name
    if isinstance(e, Unary):
        return f"({'NOT ' if e.op == 'not' else e.op}{text_of(e.e)})"
    if isinstance(e, Binary):
        return f"({text_of(e.left)} {e.op.upper()} {text_of(e.right)})"
    if isinstance(e, Is):
        return f"({text_of(e.e)} IS {'NOT ' * e.negated}{'NULL' if e.what is None else str(e.what).upper()})"
    if isinstance(e, Like):
        return f"({text_of(e.e)} {'NOT ' * e.negated}{'ILIKE' if e.fold else 'LIKE'} {text_of(e.pattern)})"
    if isinstance(e, Case):
        return "CASE" + (f" {text_of(e.operand)}" if e.operand else "") + "".join(f" WHEN {text_of(a)} THEN {text_of(b)}" for a, b in e.branches) + (f" ELSE {text_of(e.default)}" if e.default else "") + " END"
    if isinstance(e, Cast):
        return f"CAST({text_of(e.e)} AS {e.type})"
    if isinstance(e, Call):
        return f"{e.name}({'*' if e.star else 'DISTINCT ' * e.distinct + ', '.join(map(text_of, e.args))})"
    if isinstance(e, Scalar):
        return f"({text_of(e.query)})"
    if isinstance(e, Exists):
        return f"EXISTS ({text_of(e.query)})"
    if isinstance(e, Table | Function | Derived):
        base = e.name if isinstance(e, Table) else f"{e.name}({', '.join(map(text_of, e.args))})" if isinstance(e, Function) else f"({text_of(e.query)})"
        return base + (f" AS {e.alias}" if e.alias else "") + (f"({', '.join(e.columns)})" if e.columns else "")
    if isinstance(e, Join):
        cond = f" ON {text_of(e.on)}" if e.on else f" USING ({', '.join(e.using)})" if e.using else ""
        return f"{text_of(e.left)} {'JOIN' if cond else 'CROSS JOIN'} {text_of(e.right)}{cond}"
    if isinstance(e, Select):
        head = f"DISTINCT ON ({', '.join(map(text_of, e.distinct_on))}) " if e.distinct_on else "DISTINCT " * e.distinct
        out = "SELECT " + head + ", ".join("*" if x == "*" else text_of(x) + (f" AS {a}" if a else "") for x, a in e.items)
        for word, part in (("FROM", e.source), ("WHERE", e.where)):
            out += f" {word} {text_of(part)}" if part is not None else ""
        out += f" GROUP BY {', '.join(map(text_of, e.group))}" if e.group else ""
        return out + (f" HAVING {text_of(e.having)}" if e.having is not None else "")
    if isinstance(e, Values):
        return "VALUES " + ", ".join("(" + ", ".join(map(text_of, r)) + ")" for r in e.rows)
    if isinstance(e, Union):
        return f"({text_of(e.left)}) UNION {'ALL ' * e.all}({text_of(e.right)})"
    if isinstance(e, Query):
        out = text_of(e.body)
        if e.order:
            out += " ORDER BY " + ", ".join(text_of(x) + (" ASC" if asc else " DESC") + ("" if nf is None else f" NULLS {'FIRST' if nf else 'LAST'}") for x, asc, nf in e.order)
        return out + (f" LIMIT {text_of(e.limit)}" if e.limit is not None else "") + (f" OFFSET {text_of(e.offset)}" if e.offset is not None else "")
    raise TypeError(e)
