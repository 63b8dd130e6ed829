"""Tokens to statements: recursive descent, precedence climbing for expressions."""

from __future__ import annotations

from brindle.errors import ParseError
from brindle.plans import tree as T
from brindle.plans.lexer import tokenize

#: SQL names of the five types: fixed values.
TYPES = {"integer": "INTEGER", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "real": "REAL", "decimal": "REAL", "boolean": "BOOLEAN", "bool": "BOOLEAN", "text": "TEXT", "bpchar": "TEXT", "char": "TEXT", "varchar": "TEXT", "blob": "BLOB", "bytea": "BLOB"}
_LEVELS = {"or": 1, "and": 2, "is": 4, "=": 5, "<>": 5, "<": 5, "<=": 5, ">": 5, ">=": 5, "like": 6, "ilike": 6, "not": 6, "||": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.at = sql, tokenize(sql), 0

    # -- tokens
    @property
    def here(self):
        return self.tokens[self.at]

    def is_(self, *values: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return t.kind in ("keyword", "op") and t.value in values

    def take(self, *values: str) -> bool:
        if self.is_(*values):
            self.at += 1
            return True
        return False

    def need(self, *values: str) -> None:
        for v in values:
            if not self.take(v):
                raise ParseError(f"expected {v.upper()}, got {self.here.value if self.here.kind != 'end' else 'the end'}")

    def name(self) -> str:
        t = self.here
        if t.kind != "name":
            raise ParseError(f"expected a name, got {t.value if t.kind != 'end' else 'the end'}")
        self.at += 1
        return t.value

    def names(self) -> tuple:
        return self.listed(self.name)

    def listed(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    def parens(self, one):
        self.need("(")
        out = one()
        self.need(")")
        return out

    # -- statements
    def statement(self) -> T.Statement:
        out = self._statement()
        while self.take(";"):
            pass
        if self.here.kind != "end":
            raise ParseError(f"unexpected {self.here.value}")
        return out

    def _statement(self) -> T.Statement:
        S = T.Statement
        if self.is_("select", "values", "table", "("):
            return S("query", {"query": self.query()})
        if self.take("explain"):
            return S("explain", {"of": self._statement()})
        if self.take("show"):
            self.need("tables")
            return S("show")
        if self.take("describe"):
            return S("describe", {"name": self.name()})
        for word in ("begin", "commit", "rollback"):
            if self.take(word):
                self.take("transaction")
                return S(word)
        if self.take("prepare"):
            name = self.name()
            self.need("as")
            return S("prepare", {"name": name, "of": self._statement()})
        if self.take("execute"):
            name = self.name()
            return S("execute", {"name": name, "args": self.parens(lambda: () if self.is_(")") else self.listed(self.expr)) if self.is_("(") else ()})
        if self.take("deallocate"):
            self.take("prepare")
            return S("deallocate", {"name": None if self.take("all") else self.name()})
        if self.take("analyze"):
            return S("analyze", {"names": self.names() if self.here.kind == "name" else ()})
        if self.take("reindex"):
            kind = "table" if self.take("table") else (self.need("index"), "index")[1]
            return S("reindex", {"what": kind, "name": self.name()})
        if self.take("truncate"):
            self.take("table")
            return S("truncate", {"names": self.names()})
        if self.take("drop"):
            kind = next((k for k in ("table", "index", "sequence", "view") if self.take(k)), None)
            if kind is None:
                raise ParseError("expected TABLE, INDEX, SEQUENCE or VIEW")
            quiet = bool(self.take("if") and (self.need("exists") or True))
            return S("drop", {"what": kind, "quiet": quiet, "names": self.names()})
        if self.take("create"):
            return self.create()
        if self.take("insert"):
            self.need("into")
            table, columns = self.name(), None
            if self.is_("(") and not self.is_("select", "values", "table", "(", ahead=1):
                columns = self.parens(self.names)
            return S("insert", {"table": table, "columns": columns, "query": self.query()})
        if self.take("update"):
            table = self.name()
            self.need("set")

            def one():
                c = self.name()
                self.need("=")
                return c, self.expr()

            sets = self.listed(one)
            return S("update", {"table": table, "sets": sets, "where": self.expr() if self.take("where") else None})
        if self.take("delete"):
            self.need("from")
            return S("delete", {"table": self.name(), "where": self.expr() if self.take("where") else None})
        raise ParseError(f"unexpected {self.here.value if self.here.kind != 'end' else 'end of statement'}")

    def create(self) -> T.Statement:
        S = T.Statement

        def quiet() -> bool:
            if self.take("if"):
                self.need("not", "exists")
                return True
            return False

        if self.take("table"):
            q, name = quiet(), self.name()
            columns, keys, uniques = [], None, []

            def part():
                nonlocal keys
                if self.take("primary"):
                    self.need("key")
                    if keys is not None:
                        raise ParseError("multiple primary keys")
                    keys = self.parens(self.names)
                elif self.take("unique"):
                    uniques.append(self.parens(self.names))
                else:
                    c = {"name": self.name(), "type": self.type(), "nullable": True, "default": None}
                    while True:
                        if self.take("null"):
                            c["nullable"] = True
                        elif self.take("not"):
                            self.need("null")
                            c["nullable"] = False
                        elif self.take("default"):
                            c["default"] = self.expr()
                        elif self.take("primary"):
                            self.need("key")
                            if keys is not None:
                                raise ParseError("multiple primary keys")
                            keys = (c["name"],)
                        elif self.take("unique"):
                            uniques.append((c["name"],))
                        else:
                            break
                    columns.append(c)

            self.parens(lambda: self.listed(part))
            return S("create_table", {"name": name, "quiet": q, "columns": columns, "keys": keys, "uniques": uniques})
        unique = self.take("unique")
        if self.take("index"):
            name = self.name()
            self.need("on")
            return S("create_index", {"name": name, "table": self.name(), "columns": self.parens(self.names), "unique": unique})
        if unique:
            raise ParseError("expected INDEX")
        if self.take("sequence"):
            q, o = quiet(), {"name": self.name(), "increment": 1, "min": None, "max": None, "start": None, "cycle": False}
            while self.here.kind == "keyword":
                if self.take("increment"):
                    self.take("by")
                    o["increment"] = self.integer()
                elif self.take("minvalue"):
                    o["min"] = self.integer()
                elif self.take("maxvalue"):
                    o["max"] = self.integer()
                elif self.take("start"):
                    self.take("with")
                    o["start"] = self.integer()
                elif self.take("cycle"):
                    o["cycle"] = True
                elif self.take("no"):
                    if self.take("cycle"):
                        o["cycle"] = False
                    elif not self.take("minvalue", "maxvalue"):
                        raise ParseError("expected MINVALUE, MAXVALUE or CYCLE")
                else:
                    break
            return S("create_sequence", {"quiet": q, **o})
        if self.take("view"):
            name = self.name()
            columns = self.parens(self.names) if self.is_("(") else ()
            self.need("as")
            return S("create_view", {"name": name, "columns": columns, "query": self.query()})
        raise ParseError("expected TABLE, INDEX, SEQUENCE or VIEW")

    def integer(self) -> int:
        sign = -1 if self.take("-") else (self.take("+"), 1)[1]
        t = self.here
        if t.kind != "number" or not isinstance(t.value, int):
            raise ParseError("expected an integer")
        self.at += 1
        return sign * t.value

    def type(self) -> str:
        t = self.here
        if t.kind not in ("keyword", "name") or t.value not in TYPES:
            raise ParseError(f"unknown type {t.value}")
        self.at += 1
        if t.value in ("bpchar", "char", "varchar") and self.is_("("):
            self.parens(self.integer)
        return TYPES[t.value]

    # -- queries
    def query(self) -> T.Query:
        left = self.arm()
        while self.take("union"):
            every = self.take("all")
            left = T.Query(T.Union(left, self.arm(), every))
        order = ()
        if self.take("order"):
            self.need("by")
            order = self.listed(self.order_item)
        limit = offset = None
        while self.is_("limit", "offset"):
            if self.take("limit"):
                if limit is not None:
                    raise ParseError("LIMIT given twice")
                limit = self.expr()
            else:
                self.need("offset")
                if offset is not None:
                    raise ParseError("OFFSET given twice")
                offset = self.expr()
        if not (order or limit is not None or offset is not None):
            return left
        if left.order or left.limit is not None or left.offset is not None:
            left = T.Query(T.Select((("*", None),), T.Derived(left)))
        return T.Query(left.body, order, limit, offset)

    def order_item(self):
        e = self.expr()
        asc = not self.take("desc")
        if asc:
            self.take("asc")
        first = None
        if self.take("nulls"):
            first = self.take("first")
            if not first:
                self.need("last")
        return e, asc, first

    def arm(self) -> T.Query:
        if self.is_("("):
            return self.parens(self.query)
        if self.take("table"):
            return T.Query(T.Select((("*", None),), T.Table(self.name())))
        if self.take("values"):
            rows = self.listed(lambda: self.parens(lambda: self.listed(self.expr)))
            if len({len(r) for r in rows}) > 1:
                raise ParseError("rows of VALUES differ in length")
            return T.Query(T.Values(rows))
        self.need("select")
        distinct, on = False, ()
        if self.take("distinct"):
            if self.take("on"):
                on = self.parens(lambda: self.listed(self.expr))
            else:
                distinct = True
        else:
            self.take("all")
        items = self.listed(self.item)
        source = self.source() if self.take("from") else None
        where = self.expr() if self.take("where") else None
        group = ()
        if self.take("group"):
            self.need("by")
            group = self.listed(self.expr)
        having = self.expr() if self.take("having") else None
        return T.Query(T.Select(items, source, where, group, having, distinct, on))

    def item(self):
        if self.take("*"):
            return "*", None
        e = self.expr()
        if self.take("as"):
            return e, self.name()
        return e, self.name() if self.here.kind == "name" else None

    def source(self):
        left = self.joined()
        while self.take(","):
            left = T.Join(left, self.joined())
        return left

    def joined(self):
        left = self.primary_source()
        while True:
            if self.take("cross"):
                self.need("join")
                left = T.Join(left, self.primary_source())
            elif self.is_("join") or self.is_("inner"):
                self.take("inner")
                self.need("join")
                right = self.primary_source()
                if self.take("using"):
                    left = T.Join(left, right, using=self.parens(self.names))
                else:
                    self.need("on")
                    left = T.Join(left, right, on=self.expr())
            else:
                return left

    def alias(self):
        alias, columns = None, ()
        if self.take("as"):
            alias = self.name()
        elif self.here.kind == "name":
            alias = self.name()
        if alias and self.is_("("):
            columns = self.parens(self.names)
        return alias, columns

    def primary_source(self):
        if self.is_("("):
            mark = self.at
            self.at += 1
            depth = 0
            while self.is_("(", ahead=depth):
                depth += 1
            if self.is_("select", "values", "table", ahead=depth):
                self.at = mark
                try:
                    q = self.parens(self.query)
                    return T.Derived(q, *self.alias())
                except ParseError:
                    self.at = mark + 1
                    if not depth:
                        raise
            inner = self.source()
            self.need(")")
            return inner
        name = self.name()
        if self.is_("("):
            args = self.parens(lambda: () if self.is_(")") else self.listed(self.expr))
            return T.Function(name, args, *self.alias())
        return T.Table(name, *self.alias())

    # -- expressions
    def expr(self, least: int = 0):
        left = self.prefix()
        while True:
            t = self.here
            op = t.value if t.kind in ("op", "keyword") else None
            level = _LEVELS.get(op)
            if level is None or level <= least or op == "not" and not self.is_("like", "ilike", ahead=1):
                return left
            self.at += 1
            if op == "is":
                negated = self.take("not")
                what = None if self.take("null") else True if self.take("true") else (self.need("false"), False)[1]
                left = T.Is(left, what, negated)
            elif op in ("like", "ilike", "not"):
                negated = op == "not"
                if negated:
                    op = self.here.value
                    self.at += 1
                left = T.Like(left, self.expr(level), op == "ilike", negated)
            else:
                left = T.Binary(op, left, self.expr(level))

    def prefix(self):
        if self.take("not"):
            return T.Unary("not", self.expr(3))
        for op in "-+":
            if self.take(op):
                t = self.here
                if op == "-" and t.kind == "number" and t.value == float(1 << 63):
                    self.at += 1
                    return T.Lit(-(1 << 63), "INTEGER")
                return T.Unary(op, self.expr(9))
        return self.primary()

    def primary(self):
        t = self.here
        if t.kind == "number":
            self.at += 1
            return T.Lit(t.value, "INTEGER" if isinstance(t.value, int) else "REAL")
        if t.kind == "string":
            self.at += 1
            return T.Lit(t.value, "TEXT")
        if t.kind == "param":
            self.at += 1
            return T.Param(t.value)
        for word, lit in (("null", T.Lit(None, None)), ("true", T.Lit(True, "BOOLEAN")), ("false", T.Lit(False, "BOOLEAN"))):
            if self.take(word):
                return lit
        if self.take("cast"):
            self.need("(")
            e = self.expr()
            self.need("as")
            out = T.Cast(e, self.type())
            self.need(")")
            return out
        if self.take("case"):
            operand = None if self.is_("when") else self.expr()
            branches = []
            while self.take("when"):
                a = self.expr()
                self.need("then")
                branches.append((a, self.expr()))
            if not branches:
                raise ParseError("CASE without WHEN")
            default = self.expr() if self.take("else") else None
            self.need("end")
            return T.Case(operand, tuple(branches), default)
        if self.take("exists"):
            return T.Exists(self.parens(self.query))
        if self.is_("("):
            if self.is_("select", "values", "table", ahead=1):
                return T.Scalar(self.parens(self.query))
            return self.parens(self.expr)
        name = self.name()
        if self.take("."):
            return T.Ref(name, self.name())
        if self.take("("):
            if self.take("*"):
                self.need(")")
                return T.Call(name, (), star=True)
            distinct = self.take("distinct")
            args = () if self.is_(")") else self.listed(self.expr)
            self.need(")")
            return T.Call(name, args, distinct=distinct)
        return T.Ref(None, name)


def parse(sql: str) -> T.Statement:
    return Parser(sql).statement()


def parse_query(sql: str) -> T.Query:
    out = parse(sql)
    if out.kind != "query":
        raise ParseError("not a query")
    return out.args["query"]
