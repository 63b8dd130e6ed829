"""SQL text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from brindle.errors import ParseError

KEYWORDS = frozenset(
    """all analyze and as asc begin bigint blob boolean bpchar by bytea case cast char commit create cross cycle deallocate decimal
    default delete desc describe distinct drop else end execute exists explain false first from group having if ilike in increment
    index inner insert int integer into is join key last like limit maxvalue minvalue no not null nulls offset on or order prepare primary
    real reindex rollback select sequence set show smallint start table tables text then transaction true truncate union unique update
    using values varchar view when where with""".split()
)
_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<number>\d[\d.]*)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<param>\$\d+)
    |(?P<word>[^\W\d]\w*)|(?P<op>\|\||<>|!=|<=|>=|[-+*/%=<>(),;.])""",
    re.S | re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, name, keyword, param, op, end
    value: object
    start: int
    end: int


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None:
            raise ParseError(f"unexpected character {sql[at]!r} at {at}")
        kind, text, start, at = m.lastgroup, m.group(), at, m.end()
        if kind == "space":
            continue
        if kind == "number":
            value: object
            try:
                value = int(text)
                if value >= 1 << 63:
                    value = float(text)
            except ValueError:
                try:
                    value = float(text)
                except ValueError:
                    raise ParseError(f"bad number {text}") from None
        elif kind in ("string", "quoted"):
            value = text[1:-1].replace(text[0] * 2, text[0])
            kind = "string" if kind == "string" else "name"
        elif kind == "param":
            value = int(text[1:])
            if value < 1:
                raise ParseError("parameters start at $1")
        elif kind == "word":
            value = "".join(c.lower() if c.isascii() else c for c in text)
            kind = "keyword" if value in KEYWORDS else "name"
        else:
            value = "<>" if text == "!=" else text
        out.append(Token(kind, value, start, at))
    out.append(Token("end", None, len(sql), len(sql)))
    return out


def split_statements(sql: str) -> list[str]:
    """Statements of a script, without the semicolons."""
    out, start = [], 0
    for t in tokenize(sql):
        if t.kind == "end" or t.kind == "op" and t.value == ";":
            if sql[start : t.start].strip():
                out.append(sql[start : t.start].strip())
            start = t.end
    return out
