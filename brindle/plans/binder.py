"""Statements' queries to DataFrames: names and strict types are settled here, the rest is left to Catalyst.

Every column gets an internal name of its own, so self joins, equal names and USING need no care later; the names that the user
sees are put on at the root. A typed expression is (Column, type), with type None for an untyped NULL.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.errors import ExecutionError, PlanError
from brindle.functions import scalar as S
from brindle.functions.casts import BOOLEAN, INTEGER, REAL, SPARK, TEXT, cast, type_of_spark
from brindle.operators import dealt_join
from brindle.plans import tree as T

_ids = itertools.count()


@dataclass(frozen=True)
class Col:
    table: str | None
    name: str
    id: str
    type: str | None  # a type's name, "?" for a column that is only passed through
    hidden: bool = False


@dataclass(frozen=True)
class Key:
    """One side of an equality: a column, or an expression to be made one."""

    id: str
    type: str | None
    column: Column | None = None


@dataclass
class Rel:
    df: DataFrame
    cols: list[Col]
    order: tuple[str, ...] = ()  # columns of df, shown or not, by which a scan would bring the rows


def fresh() -> str:
    return f"c{next(_ids)}"


class Binder:
    """``host`` is the session: it resolves tables, views, sequences and table functions."""

    def __init__(self, host, params: tuple = (), dry: bool = False):
        self.host, self.params, self.spark = host, params, host.spark
        self.dry = dry  # only names and types are asked for: no sequence moves
        self.marks: dict | None = None
        self.draws: dict[int, Col] = {}  # calls of nextval, by identity, whose values are columns

    # -- expressions
    def bind(self, e, cols: list[Col], aliases: dict | None = None, groups: dict | None = None) -> tuple[Column, str | None]:
        """groups: printed form of a group key or aggregate -> Col, for expressions above an aggregation."""
        go = lambda x: self.bind(x, cols, aliases, groups)
        if groups is not None and (hit := groups.get(T.text_of(e))) is not None and not isinstance(e, T.Lit | T.Param):
            return F.col(hit.id), hit.type
        if isinstance(e, T.Lit):
            return (F.lit(e.value).cast(SPARK[e.type]) if e.type else F.lit(None)), e.type
        if isinstance(e, T.Param):
            if e.n > len(self.params):
                raise PlanError(f"parameter ${e.n} is missing")
            v = self.params[e.n - 1]
            kind = None if v is None else BOOLEAN if isinstance(v, bool) else INTEGER if isinstance(v, int) else REAL if isinstance(v, float) else TEXT if isinstance(v, str) else "BLOB"
            return (F.lit(bytearray(v) if kind == "BLOB" else v).cast(SPARK[kind]) if kind else F.lit(None)), kind
        if isinstance(e, T.Ref):
            return self.column(e, cols, aliases, groups)
        if isinstance(e, T.Unary):
            c, t = go(e.e)
            if e.op == "not":
                return ~self.truth(c, t), BOOLEAN
            if t not in (INTEGER, REAL, None):
                raise PlanError(f"no operator {e.op} {t}")
            return (c if e.op == "+" or t is None else -c), t
        if isinstance(e, T.Is):
            c, t = go(e.e)
            if e.what is None:
                return (c.isNotNull() if e.negated else c.isNull()), BOOLEAN
            c = self.truth(c, t)
            hit = F.coalesce(c if e.what else ~c, F.lit(False))
            return (~hit if e.negated else hit), BOOLEAN
        if isinstance(e, T.Binary):
            return self.binary(e.op, go(e.left), go(e.right))
        if isinstance(e, T.Like):
            (c, t), (p, pt) = go(e.e), go(e.pattern)
            if t not in (TEXT, None) or pt not in (TEXT, None):
                raise PlanError("LIKE takes texts")
            if t is None or pt is None:
                return F.lit(None).cast("boolean"), BOOLEAN
            constant = e.pattern.value if isinstance(e.pattern, T.Lit) else self.params[e.pattern.n - 1] if isinstance(e.pattern, T.Param) else None
            hit = S.like(c, p, constant, e.fold)
            return (~hit if e.negated else hit), BOOLEAN
        if isinstance(e, T.Case):
            return self.case(e, go)
        if isinstance(e, T.Cast):
            c, t = go(e.e)
            return cast(c, t, e.type), e.type
        if isinstance(e, T.Scalar):
            rel = self.query(e.query)
            if len(rel.cols) != 1:
                raise PlanError("a subquery must have one column")
            one = rel.cols[0]
            return rel.df.select(one.id).scalar(), one.type
        if isinstance(e, T.Exists):
            rel = self.query(e.query)
            return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("e")).scalar(), BOOLEAN
        if isinstance(e, T.Call):
            return self.call(e, go, groups)
        raise PlanError(f"cannot use {e} here")

    def column(self, e: T.Ref, cols, aliases, groups):
        if e.table is None and aliases and e.name in aliases:
            hit = aliases[e.name]
            if isinstance(hit, tuple):
                return hit
        found = [c for c in cols if c.name == e.name and (e.table is None or c.table == e.table)]
        if not found:
            raise PlanError(f"unknown column {T.text_of(e)}")
        if len(found) > 1:
            raise PlanError(f"ambiguous column {T.text_of(e)}")
        c = found[0]
        if groups is not None:
            hit = next((g for g in groups.values() if g.id == c.id), None)
            if hit is None:
                raise PlanError(f"column {T.text_of(e)} is neither grouped nor aggregated")
        return F.col(c.id), c.type

    def truth(self, c: Column, t: str | None) -> Column:
        if t is None:
            return F.lit(None).cast("boolean")
        if t != BOOLEAN:
            raise PlanError(f"expected BOOLEAN, got {t}")
        return c

    def binary(self, op: str, left, right):
        (a, s), (b, t) = left, right
        if op in ("and", "or"):
            a, b = self.truth(a, s), self.truth(b, t)
            return (a & b if op == "and" else a | b), BOOLEAN
        if op in ("=", "<>", "<", "<=", ">", ">="):
            if s is not None and t is not None and s != t:
                raise PlanError(f"no operator {s} {op} {t}")
            if s is None or t is None:
                return F.lit(None).cast("boolean"), BOOLEAN
            out = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            if s == REAL:  # NaN equals nothing and has no place in the order of comparisons (only in that of sorts)
                odd = F.isnan(a) | F.isnan(b)
                out = out | odd if op == "<>" else out & ~odd
            return out, BOOLEAN
        if op == "||":
            if s not in (TEXT, None) or t not in (TEXT, None):
                raise PlanError(f"no operator {s} || {t}")
            return F.concat(a.cast("string"), b.cast("string")), TEXT
        if s not in (INTEGER, REAL, None) or t not in (INTEGER, REAL, None):
            raise PlanError(f"no operator {s} {op} {t}")
        if s is None and t is None:
            return F.lit(None), None
        kind = REAL if REAL in (s, t) else INTEGER
        a, b = a.cast(SPARK[kind]), b.cast(SPARK[kind])
        if op == "/":
            return S.divide(a, b, kind), kind
        if op == "%":
            return S.modulo(a, b, kind), kind
        return {"+": a + b, "-": a - b, "*": a * b}[op], kind

    def case(self, e: T.Case, go):
        tests = [(T.Binary("=", e.operand, a) if e.operand is not None else a, b) for a, b in e.branches]
        bound = [(go(a), go(b)) for a, b in tests]
        default = go(e.default) if e.default is not None else (F.lit(None), None)
        kinds = {t for _, (_, t) in bound if t} | ({default[1]} if default[1] else set())
        if len(kinds) > 1:
            raise PlanError(f"CASE mixes {' and '.join(sorted(kinds))}")
        kind = kinds.pop() if kinds else None
        out = None
        for (c, ct), (v, vt) in bound:
            v = v if vt else F.lit(None).cast(SPARK[kind or INTEGER])
            c = self.truth(c, ct)
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(default[0] if default[1] else F.lit(None).cast(SPARK[kind or INTEGER])), kind

    def call(self, e: T.Call, go, groups):
        if e.name in S.AGGREGATES:
            raise PlanError(f"aggregate {e.name} is not allowed here")
        if e.star or e.distinct:
            raise PlanError(f"{e.name} takes no {'*' if e.star else 'DISTINCT'}")
        if id(e) in self.draws:
            return F.col(self.draws[id(e)].id), INTEGER
        args = [go(a) for a in e.args]
        given = tuple(t for _, t in args)
        if e.name in S.IMPURE:
            if not any(S.fits(types, given) for types, _ in S.IMPURE[e.name]):
                raise PlanError(f"no function {e.name}({', '.join(g or 'NULL' for g in given)})")
            return self.host.impure(e.name, e.args, self)
        types, result, build = S.resolve(e.name, given)
        return build(*[c if t else S.typed_null(k) for (c, t), k in zip(args, types)]), result

    def constant(self, e):
        """Value of an expression without columns."""
        if isinstance(e, T.Lit):
            return e.value
        c, t = self.bind(e, [])
        try:
            return self.spark.range(1).select(c.alias("v")).first()["v"]
        except Exception as x:
            raise ExecutionError(str(x).split("\n")[0]) from x

    # -- sources
    def source(self, s, where=None) -> Rel:
        if isinstance(s, T.Table):
            rel = self.host.relation(s.name, self)
        elif isinstance(s, T.Function):
            rel = self.host.table_function(s.name, tuple(self.constant(a) for a in s.args), self)
        elif isinstance(s, T.Derived):
            rel = self.query(s.query)
            rel = Rel(rel.df, [replace(c, table=None) for c in rel.cols], rel.order)
        else:
            return self.join(s, where)
        if s.alias:
            rel.cols = [replace(c, table=s.alias) for c in rel.cols]
        if s.columns:
            shown = [c for c in rel.cols if not c.hidden]
            if len(s.columns) != len(shown):
                raise PlanError(f"{s.alias} has {len(shown)} columns, not {len(s.columns)}")
            names = dict(zip((c.id for c in shown), s.columns))
            rel.cols = [replace(c, name=names.get(c.id, c.name)) for c in rel.cols]
        return rel

    def join(self, j: T.Join, where=None) -> Rel:
        """``where`` is the condition of the query whose source the join is; it only helps to find keys."""
        a, b = self.source(j.left), self.source(j.right)
        mine, other = {c.table for c in a.cols if c.table}, {c.table for c in b.cols if c.table}
        if mine & other:
            raise PlanError(f"table name {sorted(mine & other)[0]} is used twice")
        cols = a.cols + b.cols
        cond = None
        for n in j.using:
            one = self.binary("=", *[self.column(T.Ref(None, n), r.cols, None, None) for r in (a, b)])[0]
            cond = one if cond is None else cond & one
        equal = [(self.key(T.Ref(None, n), a.cols), self.key(T.Ref(None, n), b.cols)) for n in j.using]
        if j.on is not None:
            c, t = self.bind(j.on, cols)
            cond = self.truth(c, t)
        if not self.dry and (dealt := self.dealt(a, b, equal, j.on, where)) is not None:
            return Rel(dealt, cols, a.order + b.order)
        return Rel(a.df.crossJoin(b.df) if cond is None else a.df.join(b.df, cond, "inner"), cols, a.order + b.order)

    def dealt(self, a: Rel, b: Rel, equal: list[tuple[Key, Key]], on, where) -> DataFrame | None:
        """The join in cells, where an equality of both sides comes with another condition on both and most work is on pairs."""
        cols, ids = a.cols + b.cols, [{c.id for c in r.cols} for r in (a, b)]
        rest, alone, mixed = [], ([], []), False
        for e, given in [(e, True) for e in conjuncts(on)] + [(e, False) for e in conjuncts(where)]:
            read = self.columns_of(e, cols)
            if read and any(read <= own for own in ids):
                alone[0 if read <= ids[0] else 1].append(e)
            elif read and isinstance(e, T.Binary) and e.op == "=" and (given or isinstance(e.left, T.Ref) and isinstance(e.right, T.Ref)):
                parts = [self.columns_of(x, cols) for x in (e.left, e.right)]
                turn = next((i for i in (0, 1) if parts[i] and parts[1 - i] and parts[i] <= ids[0] and parts[1 - i] <= ids[1]), None)
                if turn is not None:
                    x, y = (e.left, e.right) if turn == 0 else (e.right, e.left)
                    if (t := self.bind(x, cols)[1]) == self.bind(y, cols)[1] and t in SPARK:
                        equal.append((self.key(x, cols), self.key(y, cols)))
                        continue
                mixed = True
            else:
                mixed = mixed or bool(read)
            if given:
                rest.append(e)
        equal = list({(x.id, y.id): (x, y) for x, y in equal}.values())
        hashed = [[c.id for c in r.cols if c.type in SPARK] for r in (a, b)]
        if not equal or not mixed or not all(hashed) or any(x.type not in SPARK for x, _ in equal):
            return None
        names = [(x.id, y.id) for x, y in equal]
        made = [{k[i].id: k[i].column for k in equal if k[i].column is not None} for i in (0, 1)]
        sides = [r.df.withColumns(m) if m else r.df for r, m in zip((a, b), made)]
        counted = list(sides)
        for i in (0, 1):
            for e in alone[i]:
                counted[i] = counted[i].filter(self.truth(*self.bind(e, cols)))
        types = [SPARK[x.type] for x, _ in equal]
        try:
            done = dealt_join.deal(*sides, names, types, hashed, dealt_join.counts(*counted, names))
        except PySparkException:  # errors of the rows come when they are read
            return None
        if done is None:
            return None
        left, right, slots = done
        cond = F.lit(True)
        for x, y in equal:
            cond = cond & self.binary("=", (F.col(x.id), x.type), (F.col(y.id), y.type))[0]
        for x, y in slots:
            cond = cond & (F.col(x) == F.col(y))
        for e in rest:
            cond = cond & self.truth(*self.bind(e, cols))
        return left.join(right, cond, "inner").drop(*itertools.chain(*made, *slots))

    def key(self, e, cols: list[Col]) -> Key:
        c, t = self.bind(e, cols)
        return Key(next(iter(self.columns_of(e, cols))), t) if isinstance(e, T.Ref) else Key(fresh(), t, c)

    def columns_of(self, e, cols: list[Col]) -> set[str] | None:
        """Ids of the columns that an expression reads; None where it has subqueries, unclear names or functions that change."""
        if isinstance(e, T.Ref):
            found = {c.id for c in cols if c.name == e.name and (e.table is None or c.table == e.table)}
            return found if len(found) == 1 else None
        if isinstance(e, T.Scalar | T.Exists) or isinstance(e, T.Call) and (e.name in S.IMPURE or e.name in S.AGGREGATES):
            return None
        parts = e if isinstance(e, tuple) else [getattr(e, f.name) for f in fields(e)] if is_dataclass(e) else []
        read = [self.columns_of(x, cols) for x in parts]
        return None if None in read else set().union(*read)

    # -- queries
    def query(self, q: T.Query) -> Rel:
        if isinstance(q.body, T.Select):
            return self.select(q)
        rel = self.values(q.body) if isinstance(q.body, T.Values) else self.union(q.body)
        if q.order:
            rel.df = rel.df.orderBy(*[self.order(*o, rel.cols) for o in q.order])
        rel.df = self.limited(rel.df, q)
        return rel

    def order(self, e, asc, first, cols, aliases=None, groups=None) -> Column:
        c, t = self.bind(e, cols, aliases, groups)
        first = (not asc) if first is None else first
        return (c.asc_nulls_first() if first else c.asc_nulls_last()) if asc else (c.desc_nulls_first() if first else c.desc_nulls_last())

    def limited(self, df: DataFrame, q: T.Query) -> DataFrame:
        for word, e in (("OFFSET", q.offset), ("LIMIT", q.limit)):
            if e is None:
                continue
            n = self.constant(e)
            if n is None:
                continue
            if isinstance(n, bool) or not isinstance(n, int):
                raise PlanError(f"{word} takes an INTEGER")
            if n < 0:
                raise ExecutionError(f"{word} is negative")
            df = df.offset(n) if word == "OFFSET" else df.limit(min(n, (1 << 31) - 1))
        return df

    def values(self, v: T.Values) -> Rel:
        rows = [[self.bind(e, []) for e in r] for r in v.rows]
        kinds = []
        for i in range(len(rows[0])):
            k = {r[i][1] for r in rows if r[i][1]}
            if len(k) > 1:
                raise PlanError(f"VALUES mixes {' and '.join(sorted(k))}")
            kinds.append(k.pop() if k else None)
        cols = [Col(None, f"column{i + 1}", fresh(), k) for i, k in enumerate(kinds)]
        cells = lambda r: F.struct(*[c.cast(SPARK[k or INTEGER]).alias(col.id) for (c, _), k, col in zip(r, kinds, cols)])
        df = self.spark.range(1).select(F.explode(F.array(*[cells(r) for r in rows])).alias("r")).select("r.*")
        return Rel(df, cols)

    def union(self, u: T.Union) -> Rel:
        a, b = self.query(u.left), self.query(u.right)
        if len(a.cols) != len(b.cols):
            raise PlanError(f"UNION of {len(a.cols)} and {len(b.cols)} columns")
        kinds = []
        for x, y in zip(a.cols, b.cols):
            if x.type and y.type and x.type != y.type:
                raise PlanError(f"UNION mixes {x.type} and {y.type}")
            kinds.append(x.type or y.type)
        cols = [Col(None, c.name, fresh(), k) for c, k in zip(a.cols, kinds)]
        as_ = lambda rel: rel.df.select(*[(F.col(c.id) if k == "?" else F.col(c.id).cast(SPARK[k or INTEGER])).alias(o.id) for c, k, o in zip(rel.cols, kinds, cols)])
        df = as_(a).unionAll(as_(b))
        return Rel(df if u.all else df.distinct(), cols)

    def drawn(self, df: DataFrame, exprs) -> DataFrame:
        """``df`` with a column of values for each call of nextval in ``exprs`` that has none yet."""
        calls = [c for e in exprs for c in self.calls(e, lambda x: x.name == "nextval") if id(c) not in self.draws]
        if not calls:
            return df
        df, cols = self.host.draw(df, calls, self)
        self.draws.update((id(call), col) for call, col in zip(calls, cols))
        return df

    def aggregates(self, e) -> list[T.Call]:
        """Aggregate calls within an expression, outermost first."""
        return self.calls(e, lambda x: x.name in S.AGGREGATES)

    def calls(self, e, wanted) -> list[T.Call]:
        if isinstance(e, T.Call) and wanted(e):
            return [e]
        parts = {T.Unary: lambda: [e.e], T.Is: lambda: [e.e], T.Cast: lambda: [e.e], T.Binary: lambda: [e.left, e.right], T.Like: lambda: [e.e, e.pattern], T.Call: lambda: list(e.args), T.Case: lambda: [x for x in (e.operand, e.default, *itertools.chain(*e.branches)) if x is not None]}
        return [a for p in parts.get(type(e), list)() for a in self.calls(p, wanted)]

    def select(self, q: T.Query) -> Rel:
        s: T.Select = q.body
        rel = self.source(s.source, s.where) if s.source is not None else Rel(self.spark.range(1).select(), [])
        items = []
        for e, alias in s.items:
            if e == "*":
                if s.source is None:
                    raise PlanError("* without FROM")
                items += [(c, None) for c in rel.cols if not c.hidden]
            else:
                items.append((e, alias))
        df, cols = rel.df, rel.cols
        if s.where is not None:
            if self.aggregates(s.where):
                raise PlanError("aggregates are not allowed in WHERE")
            df = self.drawn(df, [s.where])
            c, t = self.bind(s.where, cols)
            df = df.filter(self.truth(c, t))
        exprs = [e for e, _ in items if not isinstance(e, Col)]
        calls = [a for e in [*exprs, *([s.having] if s.having is not None else []), *[o[0] for o in q.order], *s.distinct_on] for a in self.aggregates(e)]
        groups = None
        named = {a: e for e, a in items if a and not isinstance(e, Col)}
        if s.source is not None and (calls or s.group or s.having is not None):
            df = self.drawn(df, [*[x for a in calls for x in a.args], *s.group, *[e for a, e in named.items() if T.Ref(None, a) in s.group]])
        elif s.source is not None:
            df = self.drawn(df, [*exprs, *[o[0] for o in q.order], *s.distinct_on])
        if calls or s.group or s.having is not None:
            df, groups = self.grouped(df, cols, s, calls, named)
        # output columns; an alias shadows columns of the same name from the next item on
        aliases: dict[str, tuple] = {}
        out, bound = [], []
        for i, (e, alias) in enumerate(items):
            if isinstance(e, Col):
                if groups is not None and all(g.id != e.id for g in groups.values()):
                    raise PlanError(f"column {e.name} is neither grouped nor aggregated")
                c, t, table, name = F.col(e.id), e.type, e.table, e.name
            else:
                c, t = self.bind(e, cols, {k: v for k, v in aliases.items() if k != alias}, groups)
                table = e.table if isinstance(e, T.Ref) else None
                if isinstance(e, T.Ref) and not alias and table is None:
                    table = next((x.table for x in cols if x.name == e.name), None)
                name = alias or (e.name if isinstance(e, T.Ref) else f"column{i + 1}" if s.source is None else T.text_of(e))
                if alias:
                    aliases[alias] = (c, t)
            col = Col(None if alias else table, name, fresh(), t)
            out.append(col)
            bound.append((c if t else F.lit(None).cast("bigint")).alias(col.id))
        if s.having is not None:
            c, t = self.bind(s.having, cols, aliases, groups)
            df = df.filter(self.truth(c, t))
        if s.distinct_on:
            keys = [self.bind(e, cols, aliases, groups)[0].alias(fresh()) for e in s.distinct_on]
            kept = df.select("*", *keys, F.monotonically_increasing_id().alias("arrival"))
            names = kept.columns[len(df.columns) : -1]
            # files of a scan may come in any order, so that arrival decides only where no key does
            df = kept.withColumn("nth", F.row_number().over(Window.partitionBy(*names).orderBy(*(rel.order if groups is None else ()), "arrival"))).filter("nth = 1")
        if s.distinct:
            df = df.select(*bound).distinct()
            if q.order:
                df = df.orderBy(*[self.order(*self.shown(o, items, out), out) for o in q.order])
            return Rel(self.limited(df, q), out)
        if q.order:
            df = df.orderBy(*[self.order(*o, cols, aliases, groups) for o in q.order])
        order = rel.order if groups is None and not q.order else ()
        return Rel(self.limited(df, q).select(*bound, *order), out, order)

    def shown(self, o, items, out):
        """An ORDER BY item of SELECT DISTINCT in terms of the output."""
        for (e, alias), col in zip(items, out):
            if not isinstance(e, Col) and (e == o[0] or isinstance(o[0], T.Ref) and o[0].table is None and o[0].name == alias):
                return T.Ref(col.table, col.name), o[1], o[2]
        return o

    def grouped(self, df, cols, s: T.Select, calls, named):
        groups: dict[str, Col] = {}
        keys = []
        for e in s.group:
            target = named.get(e.name, e) if isinstance(e, T.Ref) and e.table is None else e
            if self.aggregates(target):
                raise PlanError("aggregates are not allowed in GROUP BY")
            c, t = self.bind(target, cols)
            id_ = fresh()
            name = target.name if isinstance(target, T.Ref) else T.text_of(target)
            col = Col(None, name, id_, t)
            if isinstance(target, T.Ref):
                hit = next(x for x in cols if x.name == target.name and target.table in (None, x.table))
                col = Col(hit.table, hit.name, hit.id, hit.type)
                keys.append(F.col(hit.id))
                groups[f"{hit.table}.{hit.name}"] = col
            else:
                keys.append((c if t else F.lit(None).cast("bigint")).alias(id_))
            groups[T.text_of(target)] = col
            groups.setdefault(T.text_of(e), col)
        aggs = []
        for a in calls:
            text = T.text_of(a)
            if text in groups:
                continue
            if a.star and a.name != "count" or not a.star and len(a.args) != 1:
                raise PlanError(f"no function {text}")
            if any(self.aggregates(x) for x in a.args):
                raise PlanError("aggregates can't be nested")
            c, t = (F.lit(1), INTEGER) if a.star else self.bind(a.args[0], cols)
            c, t = S.aggregate(a.name, c if t else F.lit(None).cast("bigint"), t, a.distinct)
            col = Col(None, text, fresh(), t)
            groups[text] = col
            aggs.append(c.alias(col.id))
        if keys:
            df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        else:
            df = df.agg(*(aggs or [F.count(F.lit(1)).alias(fresh())]))
        return df, groups


def conjuncts(e) -> list:
    return [] if e is None else [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, T.Binary) and e.op == "and" else [e]


def external(df: DataFrame, table: str) -> Rel:
    """A DataFrame as a relation: int and float widths are widened, other types pass through."""
    cols, out = [], []
    for name, kind in df.dtypes:
        t = type_of_spark(kind)
        col = Col(table, name, fresh(), t or "?")
        cols.append(col)
        out.append((F.col(f"`{name}`").cast(SPARK[t]) if t else F.col(f"`{name}`")).alias(col.id))
    return Rel(df.select(*out), cols)
