"""Databases and sessions: statements in, DataFrames or row counts out."""

from __future__ import annotations

import copy
import itertools
import threading
import uuid
from dataclasses import fields, is_dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import ExecutionError, ParseError, PlanError
from brindle.functions import scalar as S
from brindle.functions.casts import BOOLEAN, INTEGER, SPARK, TEXT, cast
from brindle.operators.numbering import with_positions
from brindle.plans import tree as T
from brindle.plans.binder import Binder, Col, Rel, external, fresh
from brindle.plans.lexer import KEYWORDS, split_statements
from brindle.plans.parser import parse, parse_query
from brindle.sources.delimited import read_delimited
from brindle.sources.store import ParquetStore

_EMPTY = {"tables": {}, "indexes": {}, "sequences": {}, "views": {}}
_ROWID = {"name": "rowid", "type": INTEGER, "nullable": False, "default": None, "hidden": True}
_PREFIX = "engine_"
#: So many commits later a replaced snapshot's files go, so that results still being read have theirs.
KEEP_COMMITS = 8
#: A table of so many folders is written anew as one by the next INSERT.
MAX_FOLDERS = 32


class Database:
    """A catalog over a store. Sessions see committed state; one transaction that writes runs at a time. A second session waits for
    its turn, or is refused where the first one is of the same thread and so can't end meanwhile."""

    def __init__(self, spark: SparkSession, path: str | None = None, store=None):
        self.spark = spark
        self.store = store or ParquetStore(spark, path)
        self.state = self.store.load() or copy.deepcopy(_EMPTY)
        self.external: dict[str, DataFrame] = {}
        self.turn = threading.Condition()
        self.owner: Session | None = None
        self.garbage: list[list[str]] = []  # files that each of the last commits replaced
        for k, v in {"spark.sql.ansi.enabled": "true", "spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.adaptive.enabled": "true"}.items():
            spark.conf.set(k, v)

    def attach(self, name: str, df: DataFrame) -> None:
        """Offer a DataFrame (a Parquet scan, say) as a read-only table."""
        self.external[name] = df

    def attach_parquet(self, sf_dir: str, *names: str) -> None:
        for n in names:
            self.attach(n, self.spark.read.parquet(f"{sf_dir}/{n}.parquet"))

    def connect(self) -> Session:
        return Session(self)


class Session:
    def __init__(self, db: Database):
        self.db, self.spark = db, db.spark
        self.work: dict | None = None  # the transaction's catalog
        self.explicit = self.failed = False
        self.prepared: dict[str, T.Statement] = {}
        self.current: dict[str, int] = {}
        self.seed, self.draws = None, itertools.count()

    # -- public
    def execute(self, sql: str, params=()) -> int:
        """Run a statement; rows written, or 0."""
        out = self.run(parse(sql), _tuple(params))
        return out if isinstance(out, int) else 0

    def query(self, sql: str, params=()) -> DataFrame:
        """The rows of a statement; none for those that only write."""
        out = self.run(parse(sql), _tuple(params))
        return out if isinstance(out, DataFrame) else self.spark.range(0).select()

    def script(self, sql: str) -> None:
        for one in split_statements(sql):
            self.run(parse(one), ())

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self, parse(sql))

    def inserter(self, table: str, flush_rows: int = 16384) -> Inserter:
        return Inserter(self.db, table, flush_rows)

    def load_file(self, table: str, path: str, form: str = "csv", skip_header: bool = False, escape: str | None = None, multi_line: bool = True) -> int:
        """Append a delimited file to a table."""

        def go() -> int:
            cols = self.visible(self.table(table))
            df = read_delimited(self.spark, path, [c["name"] for c in cols], form, skip_header, escape, multi_line)
            rel = external(df, None)
            return self.insert(table, None, rel)

        return self.within(go)

    # -- transactions
    @property
    def state(self) -> dict:
        return self.work if self.work is not None else self.db.state

    def begin(self, explicit: bool) -> None:
        with self.db.turn:
            while self.db.owner is not None:
                if self.db.owner.thread == threading.get_ident():
                    raise ExecutionError("another session of this thread has a transaction open")
                self.db.turn.wait()
            self.db.owner, self.thread = self, threading.get_ident()
        self.work, self.explicit, self.failed, self.written, self.drawn = copy.deepcopy(self.db.state), explicit, False, [], []

    def finish(self, keep: bool) -> None:
        keep = keep and not self.failed
        files = lambda state: {p for t in state["tables"].values() for p in t["paths"]}
        old, new = files(self.db.state), files(self.work)
        try:
            if keep:
                self.db.state = self.work
                self.db.store.save(self.work)
                self.db.garbage.append([*(old - new), *self.drawn])
            stale = [p for p in self.written if p not in (new if keep else old)]
            while len(self.db.garbage) > KEEP_COMMITS:
                stale += self.db.garbage.pop(0)
            for p in stale:
                self.db.store.drop(p)
        finally:
            self.work, self.explicit = None, False
            with self.db.turn:
                self.db.owner = None
                self.db.turn.notify_all()

    def within(self, go):
        own = self.work is None
        if not own and self.failed:
            raise ExecutionError("the transaction has failed; ROLLBACK ends it")
        if own:
            self.begin(False)
        try:
            out = go()
        except (ParseError, PlanError):
            if own:
                self.finish(False)
            raise
        except (ExecutionError, PySparkException) as x:
            if own:
                self.finish(False)
            else:
                self.failed = True
            raise x if isinstance(x, ExecutionError) else ExecutionError(str(x).split("\n")[0]) from x
        except BaseException:
            if own:
                self.finish(False)
            raise
        if own:
            self.finish(True)
        return out

    def run(self, st: T.Statement, params: tuple):
        k, a = st.kind, st.args
        if k == "begin":
            if self.work is not None:
                raise PlanError("a transaction is open already")
            return self.begin(True)
        if k in ("commit", "rollback"):
            if self.work is None:
                raise PlanError("no transaction is open")
            return self.finish(k == "commit")
        if k == "prepare":
            if a["name"] in self.prepared:
                raise PlanError(f"{a['name']} is prepared already")
            self.prepared[a["name"]] = a["of"]
            return None
        if k == "execute":
            if a["name"] not in self.prepared:
                raise PlanError(f"{a['name']} isn't prepared")
            b = Binder(self, params)
            return self.run(self.prepared[a["name"]], tuple(b.constant(e) for e in a["args"]))
        if k == "deallocate":
            if a["name"] is None:
                self.prepared.clear()
            elif self.prepared.pop(a["name"], None) is None:
                raise PlanError(f"{a['name']} isn't prepared")
            return None
        if k in ("query", "show", "describe", "explain") and not self.moves(st.args.get("query")):
            return self.within(lambda: self.checked(self.rows(st, params))) if self.work is not None else self.rows(st, params)
        if k == "query":
            return self.within(lambda: self.rows(st, params))
        return self.within(lambda: getattr(self, f"do_{k}")(params=params, **a))

    def checked(self, df: DataFrame) -> DataFrame:
        """A query of an explicit transaction is run once here, so that an error ends the transaction."""
        df.write.format("noop").mode("overwrite").save()
        return df

    def rows(self, st: T.Statement, params: tuple) -> DataFrame:
        b = Binder(self, params)
        if st.kind == "show":
            q = parse_query("SELECT name FROM engine_tables() ORDER BY name")
        elif st.kind == "describe":
            self.table(st.args["name"])
            q = parse_query("SELECT column_name, type, is_nullable, is_primary_key, default_value FROM engine_columns() WHERE table_name = $1")
            b = Binder(self, (st.args["name"],))
        elif st.kind == "explain":
            of = st.args["of"]
            b.dry = True
            lines = [of.kind.upper()] if of.kind != "query" else _named(b.query(of.args["query"]))._jdf.queryExecution().toString().split("\n")
            return self.spark.createDataFrame([(x,) for x in lines], "plan string")
        else:
            q = st.args["query"]
        return _named(b.query(q))

    # -- what binders ask for
    def table(self, name: str) -> dict:
        if name not in self.state["tables"]:
            raise PlanError(f"unknown table {name}")
        return self.state["tables"][name]

    @staticmethod
    def visible(t: dict) -> list[dict]:
        return [c for c in t["columns"] if not c.get("hidden")]

    def relation(self, name: str, binder: Binder) -> Rel:
        view = self.state["views"].get(name)
        if view is not None:
            rel = Binder(self, dry=binder.dry).query(parse_query(view["sql"]))
            names = view["columns"] or [c.name for c in rel.cols]
            return Rel(rel.df, [replace(c, table=name, name=n) for c, n in zip(rel.cols, names)], rel.order)
        if name not in self.state["tables"]:
            if name in self.db.external:
                return external(self.db.external[name], name)
            raise PlanError(f"unknown table {name}")
        t = self.table(name)
        cols = [Col(name, c["name"], fresh(), c["type"], bool(c.get("hidden"))) for c in t["columns"]]
        df = self.db.store.read(tuple(t["paths"]), t["columns"])
        by = t["keys"] or ["rowid"]  # tables are kept in the order of their keys
        return Rel(df.select(*[F.col(f"`{c.name}`").alias(c.id) for c in cols]), cols, tuple(c.id for k in by for c in cols if c.name == k))

    def table_function(self, name: str, args: tuple, binder: Binder) -> Rel:
        if name == "generate_series":
            if len(args) != 2 or any(x is not None and (isinstance(x, bool) or not isinstance(x, int)) for x in args):
                raise PlanError("generate_series takes two INTEGERs")
            col = Col(None, "generate_series", fresh(), INTEGER)
            lo, hi = args if None not in args else (1, 0)
            return Rel(self.spark.range(lo, hi + 1).select(F.col("id").alias(col.id)), [replace(col, table="generate_series")], (col.id,))
        bare = name.removeprefix(_PREFIX) if name.startswith(_PREFIX) else None
        if bare not in S.TABLE_FUNCTIONS or args:
            raise PlanError(f"no table function {name}")
        schema, rows = getattr(self, f"_{bare}")()
        rel = external(self.spark.createDataFrame(rows, schema), name)
        return rel

    def _columns(self):
        rows = [(n, c["name"], c["type"], c["nullable"], c["name"] in (t["keys"] or ()), c["default"]) for n, t in sorted(self.state["tables"].items()) for c in t["columns"]]
        return "table_name string, column_name string, type string, is_nullable boolean, is_primary_key boolean, default_value string", rows

    def _functions(self):
        kinds = [("scalar", [*S.SCALARS, *S.IMPURE]), ("aggregate", S.AGGREGATES), ("table", ["generate_series", *(f"engine_{n}" for n in S.TABLE_FUNCTIONS[1:])])]
        return "name string, type string", [(n, k) for k, names in kinds for n in sorted(names)]

    def _indexes(self):
        return "table_name string, index_name string, is_unique boolean", [(x["table"], n, x["unique"]) for n, x in sorted(self.state["indexes"].items())]

    def _keywords(self):
        return "keyword string", [(k.upper(),) for k in sorted(KEYWORDS)]

    def _sequences(self):
        rows = [(n, s["increment"], s["min"], s["max"], s["start"], s["cycle"]) for n, s in sorted(self.state["sequences"].items())]
        return "name string, increment_by long, min_value long, max_value long, start_value long, cycle boolean", rows

    def _tables(self):
        return "name string", [(n,) for n in sorted(self.state["tables"])]

    def _views(self):
        return "name string, columns string, sql string", [(n, ", ".join(v["columns"] or ()), v["sql"]) for n, v in sorted(self.state["views"].items())]

    def impure(self, name: str, args: tuple, binder: Binder):
        if name == "random":
            return F.rand(hash((self.seed, next(self.draws))) & 0x7FFFFFFF if self.seed is not None else None), S.REAL
        if name == "setseed":
            self.seed, self.draws = binder.constant(args[0]), itertools.count()
            return F.lit(None).cast("double"), S.REAL
        seq = binder.constant(args[0])
        if seq not in self.state["sequences"]:
            raise PlanError(f"unknown sequence {seq}")
        if name == "currval":
            if seq not in self.current:
                raise ExecutionError(f"{seq} has no current value in this session")
            return F.lit(self.current[seq]).cast("bigint"), INTEGER
        if binder.marks is not None:  # one value a row, put in when the rows are written
            mark = f"__seq{len(binder.marks)}"
            binder.marks[mark] = seq
            return F.lit(0).cast("bigint").alias(mark), INTEGER
        return F.lit(0 if binder.dry else self.take(seq, 1)[0]).cast("bigint"), INTEGER

    def moves(self, node, function: str = "nextval") -> bool:
        """Whether a syntax tree, or a view that it reads, calls a function; with nextval it needs a transaction."""
        if isinstance(node, T.Call) and node.name == function:
            return True
        if isinstance(node, T.Table) and node.name in self.state["views"]:
            return self.moves(parse_query(self.state["views"][node.name]["sql"]), function)
        if isinstance(node, tuple | list):
            return any(self.moves(x, function) for x in node)
        return is_dataclass(node) and any(self.moves(getattr(node, f.name), function) for f in fields(node))

    def draw(self, df: DataFrame, calls: list[T.Call], binder: Binder) -> tuple[DataFrame, list[Col]]:
        """``df``, written and numbered, with a column for each call of nextval: a value a row; calls of one sequence take turns."""
        cols = [Col(None, "nextval", fresh(), INTEGER) for _ in calls]
        if binder.dry:
            return df.select("*", *[F.lit(0).cast("bigint").alias(c.id) for c in cols]), cols
        names = [binder.constant(c.args[0]) if len(c.args) == 1 else None for c in calls]
        if bad := [n for n in names if n not in self.state["sequences"]]:
            raise PlanError(f"unknown sequence {bad[0]}")
        df = df.select("*", F.lit(0).alias("__any"))  # a row may have no column
        path = self.db.store.write(df)
        self.drawn.append(path)
        df = with_positions(self.spark.read.schema(df.schema).parquet(path), "__at")
        n = df.count()
        for seq in dict.fromkeys(names):
            own = [c for c, s in zip(cols, names) if s == seq]
            for j, c in enumerate(own):
                if j == 0 and n:
                    value = self.block(seq, n * len(own), None)
                df = df.withColumn(c.id, value(F.col("__at") * len(own) + j) if n else F.lit(None).cast("bigint"))
        return df.drop("__at", "__any"), cols

    def take(self, name: str, n: int) -> list[int]:
        """The next n values of a sequence, for statements of few rows."""
        s = self.state["sequences"][name]
        out = []
        for _ in range(n):
            v = s["start"] if s["next"] is None and not s["done"] else s["next"]
            if v is None:
                if not s["cycle"]:
                    raise ExecutionError(f"sequence {name} is used up")
                v = s["start"]
            out.append(v)
            after = v + s["increment"]
            s["next"], s["done"] = (after, False) if s["min"] <= after <= s["max"] else (None, True)
        if out:
            self.current[name] = out[-1]
        return out

    # -- definitions
    def _fresh_name(self, kind: str, name: str, quiet: bool = False) -> bool:
        if name in self.state[kind]:
            if quiet:
                return False
            raise PlanError(f"{name} exists already")
        return True

    def do_create_table(self, name, quiet, columns, keys, uniques, params):
        if not self._fresh_name("tables", name, quiet):
            return 0
        names = [c["name"] for c in columns]
        if len(set(names)) != len(names) or "rowid" in names:
            raise PlanError("column names must differ, and rowid is reserved")
        for group in ([keys] if keys else []) + list(uniques):
            if len(set(group)) != len(group) or any(n not in names for n in group):
                raise PlanError(f"unknown or repeated column in key of {name}")
        cols = []
        for c in columns:
            default = None
            if c["default"] is not None:
                b = Binder(self)
                b.marks = {}
                cast(*b.bind(c["default"], []), c["type"])
                default = T.text_of(c["default"])
            cols.append({"name": c["name"], "type": c["type"], "nullable": c["nullable"] and c["name"] not in (keys or ()), "default": default})
        if not keys:
            cols.append(dict(_ROWID))
        self.state["tables"][name] = {"columns": cols, "keys": list(keys) if keys else None, "paths": [], "rows": 0, "next_rowid": 1}
        for group in uniques:
            self.state["indexes"][self._index_name(name, group)] = {"table": name, "columns": list(group), "unique": True}
        return 0

    def _index_name(self, table, columns) -> str:
        base = f"{table}_{'_'.join(columns)}_key"
        return next(n for n in itertools.chain([base], (f"{base}{i}" for i in itertools.count(1))) if n not in self.state["indexes"])

    def do_create_index(self, name, table, columns, unique, params):
        self._fresh_name("indexes", name)
        t = self.table(table)
        if any(c not in [x["name"] for x in t["columns"]] for c in columns):
            raise PlanError(f"unknown column in index {name}")
        if unique:
            self.check_unique(self.db.store.read(tuple(t["paths"]), t["columns"]), list(columns), name)
        self.state["indexes"][name] = {"table": table, "columns": list(columns), "unique": unique}
        return 0

    def do_create_sequence(self, name, quiet, increment, min, max, start, cycle, params):
        if not self._fresh_name("sequences", name, quiet):
            return 0
        if increment == 0:
            raise PlanError("INCREMENT is 0")
        top, bottom = (1 << 63) - 1, -(1 << 63)
        low = min if min is not None else (1 if increment > 0 else bottom)
        high = max if max is not None else (top if increment > 0 else -1)
        first = start if start is not None else (low if increment > 0 else high)
        if low > high or not low <= first <= high:
            raise PlanError("the bounds of the sequence don't fit")
        self.state["sequences"][name] = {"increment": increment, "min": low, "max": high, "start": first, "cycle": cycle, "next": None, "done": False}
        return 0

    def do_create_view(self, name, columns, query, params):
        self._fresh_name("views", name)
        rel = Binder(self, params, dry=True).query(query)
        if columns and len(columns) != len(rel.cols):
            raise PlanError(f"{name} has {len(rel.cols)} columns")
        self.state["views"][name] = {"columns": list(columns) or None, "sql": T.text_of(query)}
        return 0

    def do_drop(self, what, quiet, names, params):
        kind = {"table": "tables", "index": "indexes", "sequence": "sequences", "view": "views"}[what]
        for n in names:
            if n not in self.state[kind]:
                if quiet:
                    continue
                raise PlanError(f"unknown {what} {n}")
            del self.state[kind][n]
            if what == "table":
                self.state["indexes"] = {k: x for k, x in self.state["indexes"].items() if x["table"] != n}
        return 0

    def do_analyze(self, names, params):
        for n in names or list(self.state["tables"]):
            t = self.table(n)
            t["rows"] = self.db.store.read(tuple(t["paths"]), t["columns"]).count()
        return 0

    def do_reindex(self, what, name, params):
        x = self.table(name) if what == "table" else self.state["indexes"].get(name)
        if x is None:
            raise PlanError(f"unknown index {name}")
        for n, i in self.state["indexes"].items():
            if i["unique"] and (n == name or what == "table" and i["table"] == name):
                t = self.table(i["table"])
                self.check_unique(self.db.store.read(tuple(t["paths"]), t["columns"]), i["columns"], n)
        return 0

    # -- changes
    def do_insert(self, table, columns, query, params):
        return self.insert(table, columns, Binder(self, params).query(query))

    def insert(self, table: str, columns, rel: Rel) -> int:
        t = self.table(table)
        shown = self.visible(t)
        given = [c.name for c in rel.cols]
        if columns is not None:
            if len(set(columns)) != len(columns) or len(columns) != len(given):
                raise PlanError("INSERT columns don't fit the query")
            unknown = [c for c in columns if c not in [x["name"] for x in t["columns"]]]
            if unknown:
                raise PlanError(f"unknown column {unknown[0]}")
            targets = list(columns)
        else:
            if len(given) > len(shown):
                raise PlanError(f"{table} has {len(shown)} columns, got {len(given)}")
            targets = [c["name"] for c in shown][: len(given)]
        source = dict(zip(targets, rel.cols))
        out, sequences = [], {}
        b = Binder(self)
        for c in t["columns"]:
            if c["name"] in source:
                col = source[c["name"]]
                if col.type == "?":
                    raise PlanError(f"column {c['name']} can't take this type")
                v = cast(F.col(col.id), col.type, c["type"])
            elif c.get("hidden"):
                v = F.lit(None).cast("bigint")
            elif c["default"] is not None:
                b.marks = {}
                e = parse_query(f"SELECT {c['default']}").body.items[0][0]
                v = cast(*b.bind(e, []), c["type"])
                if b.marks:
                    if not (isinstance(e, T.Call) and e.name == "nextval"):
                        raise PlanError("a DEFAULT with nextval must be nextval alone")
                    sequences[c["name"]] = next(iter(b.marks.values()))
            else:
                v = F.lit(None).cast(SPARK[c["type"]])
            out.append(v.cast(SPARK[c["type"]]).alias(c["name"]))
        path = self.stage(rel.df.select(*out))
        new = self.db.store.read((path,), t["columns"])
        n = new.count()
        hidden = [c["name"] for c in t["columns"] if c.get("hidden") and c["name"] not in source]
        if n and (hidden or sequences):
            new = with_positions(new, "__at")
            for h in hidden:
                new = new.withColumn(h, F.col("__at") + t["next_rowid"])
            t["next_rowid"] += n if hidden else 0
            for c, s in sequences.items():
                new = new.withColumn(c, self.block(s, n, F.col("__at")))
            path = self.stage(new.select(*[x["name"] for x in t["columns"]]))
            new = self.db.store.read((path,), t["columns"])
        self.check_nulls(new, t)
        for keys, label in self.keys_of(table):
            self.check_unique(new, keys, label)
            old = self.db.store.read(tuple(t["paths"]), t["columns"])
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
            cond = same[0]
            for x in same[1:]:
                cond = cond & x
            if n and t["paths"] and new.alias("n").join(old.alias("o"), cond, "left_semi").limit(1).count():
                raise ExecutionError(f"duplicate key for {label}")
        if n:
            t["paths"] = [*t["paths"], path]
            if len(t["paths"]) > MAX_FOLDERS:
                t["paths"] = [self.stage(self.db.store.read(tuple(t["paths"]), t["columns"]))]
        return n

    def block(self, seq: str, n: int, at):
        """The next n values of a sequence as an expression of the row's position (a function of it if ``at`` is None)."""
        s = self.state["sequences"][seq]
        first = s["start"] if s["next"] is None and not s["done"] else s["next"]
        if first is None and not s["cycle"]:
            raise ExecutionError(f"sequence {seq} is used up")
        first = s["start"] if first is None else first
        left = abs((s["max"] if s["increment"] > 0 else s["min"]) - first) // abs(s["increment"]) + 1
        if n > left and not s["cycle"]:
            raise ExecutionError(f"sequence {seq} is used up")
        lap = abs((s["max"] if s["increment"] > 0 else s["min"]) - s["start"]) // abs(s["increment"]) + 1

        def value(at):
            if n <= left:
                return (F.lit(first) + at * s["increment"]).cast("bigint")
            return F.when(at < left, F.lit(first) + at * s["increment"]).otherwise(F.lit(s["start"]) + ((at - left) % lap) * s["increment"]).cast("bigint")

        last = first + (n - 1) * s["increment"] if n <= left else s["start"] + (n - 1 - left) % lap * s["increment"]
        after = last + s["increment"]
        s["next"], s["done"] = (after, False) if s["min"] <= after <= s["max"] else (None, True)
        self.current[seq] = last
        return value if at is None else value(at)

    def stage(self, df: DataFrame) -> str:
        path = self.db.store.write(df)
        self.written.append(path)
        return path

    def keys_of(self, table: str) -> list[tuple[list[str], str]]:
        t = self.table(table)
        own = [(t["keys"], f"the primary key of {table}")] if t["keys"] else []
        return own + [(x["columns"], n) for n, x in self.state["indexes"].items() if x["table"] == table and x["unique"]]

    def check_nulls(self, df: DataFrame, t: dict, among: set[str] | None = None) -> None:
        must = [c["name"] for c in t["columns"] if not c["nullable"] and (among is None or c["name"] in among)]
        if must:
            counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in must]).first()
            for c in must:
                if counts[c]:
                    raise ExecutionError(f"column {c} can't be NULL")

    def check_unique(self, df: DataFrame, keys: list[str], label: str) -> None:
        if df.groupBy(*[F.col(f"`{k}`") for k in keys]).count().filter("count > 1").limit(1).count():
            raise ExecutionError(f"duplicate key for {label}")

    def by_folder(self, table: str) -> Rel:
        """A table's rows with __folder, the place of their folder among the table's paths."""
        t, df = self.table(table), None
        cols = [Col(table, c["name"], fresh(), c["type"], bool(c.get("hidden"))) for c in t["columns"]]
        for i, p in enumerate(t["paths"] or [None]):
            one = self.db.store.read((p,) if p is not None else (), t["columns"])
            one = one.select(*[F.col(f"`{c.name}`").alias(c.id) for c in cols], F.lit(i).alias("__folder"))
            df = one if df is None else df.unionByName(one)
        return Rel(df, cols)

    def touched(self, table: str, hits: DataFrame, exprs) -> tuple[int, list[int]]:
        """How many rows a change hits, and the folders that hold them (at most MAX_FOLDERS); all folders where the condition
        draws random numbers, which are the same again only in the same scan."""
        counts = {r["__folder"]: r["count"] for r in hits.groupBy("__folder").count().collect()}
        folders = range(len(self.table(table)["paths"])) if self.moves(exprs, "random") else sorted(counts)
        return sum(counts.values()), list(folders)

    def replaced(self, table: str, df: DataFrame, folders: list[int], changed: set[str]) -> None:
        """Write ``df`` in place of some folders. Only columns that were set can break NOT NULL or a key."""
        t = self.table(table)
        path = self.stage(df)
        paths = [path if i == folders[0] else p for i, p in enumerate(t["paths"]) if i == folders[0] or i not in folders]
        self.check_nulls(self.db.store.read((path,), t["columns"]), t, changed)
        for keys, label in self.keys_of(table):
            if changed & set(keys):
                self.check_unique(self.db.store.read(tuple(paths), t["columns"]), keys, label)
        t["paths"] = paths

    def within_folders(self, df: DataFrame, table: str, folders: list[int]) -> DataFrame:
        return df if len(folders) == len(self.table(table)["paths"]) else df.filter(F.col("__folder").isin(folders))

    def do_update(self, table, sets, where, params):
        t, b = self.table(table), Binder(self, params)
        rel = self.by_folder(table)
        names = [n for n, _ in sets]
        if len(set(names)) != len(names):
            raise PlanError("a column is set twice")
        types = {c["name"]: c["type"] for c in t["columns"]}
        if bad := [n for n in names if n not in types]:
            raise PlanError(f"unknown column {bad[0]}")
        rel.df = b.drawn(rel.df, [*([where] if where is not None else []), *[e for _, e in sets]])
        hit = F.lit(True) if where is None else F.coalesce(b.truth(*b.bind(where, rel.cols)), F.lit(False))
        values = {n: cast(*b.bind(e, rel.cols), types[n]) for n, e in sets}
        n, folders = self.touched(table, rel.df.filter(hit), (where, sets))
        if n:
            out = [(F.when(hit, values[c.name]).otherwise(F.col(c.id)) if c.name in values else F.col(c.id)).cast(SPARK[c.type]).alias(c.name) for c in rel.cols]
            self.replaced(table, self.within_folders(rel.df, table, folders).select(*out), folders, set(names))
        return n

    def do_delete(self, table, where, params):
        t, b = self.table(table), Binder(self, params)
        rel = self.by_folder(table)
        if where is None:
            n = rel.df.count()
            t["paths"] = []
            return n
        rel.df = b.drawn(rel.df, [where])
        hit = F.coalesce(b.truth(*b.bind(where, rel.cols)), F.lit(False))
        n, folders = self.touched(table, rel.df.filter(hit), where)
        if n:
            stays = self.within_folders(rel.df, table, folders).filter(~hit)
            self.replaced(table, stays.select(*[F.col(c.id).alias(c.name) for c in rel.cols]), folders, set())
        return n

    def do_truncate(self, names, params):
        for n in names:
            self.table(n)["paths"] = []
        return 0


class Prepared:
    """A parsed statement, bound anew at each use."""

    def __init__(self, session: Session, statement: T.Statement):
        self.session, self.statement = session, statement

    def execute(self, params=()) -> int:
        out = self.session.run(self.statement, _tuple(params))
        return out if isinstance(out, int) else 0

    def query(self, params=()) -> DataFrame:
        out = self.session.run(self.statement, _tuple(params))
        return out if isinstance(out, DataFrame) else self.session.spark.range(0).select()


class Inserter:
    """Bulk insert in a transaction of its own; an error rolls it back and ends it. A context manager."""

    def __init__(self, db: Database, table: str, flush_rows: int):
        self.session, self.name, self.flush_rows, self.buffer, self.dead = Session(db), table, flush_rows, [], False
        self.columns = Session.visible(self.session.table(table))
        self.session.begin(True)

    def insert(self, row) -> None:
        if self.dead:
            raise ExecutionError("the inserter has failed")
        row = _tuple(row)
        if len(row) != len(self.columns):
            self.fail()
            raise PlanError(f"{self.name} has {len(self.columns)} columns, got {len(row)}")
        self.buffer.append(row)
        if len(self.buffer) >= self.flush_rows:
            self.flush()

    def flush(self) -> None:
        rows, self.buffer = self.buffer, []
        if not rows:
            return
        try:
            values = T.Query(T.Values(tuple(tuple(T.Cast(T.Param(i + 1), c["type"]) for i, c in enumerate(self.columns)) for _ in range(1))))
            kinds = [{_kind(r[i]) for r in rows} - {None} for i in range(len(self.columns))]
            if all(len(k) <= 1 for k in kinds):
                types = [next(iter(k), None) for k in kinds]
                names = [fresh() for _ in types]
                df = self.session.spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} {SPARK[t or INTEGER]}" for n, t in zip(names, types)))
                self.session.insert(self.name, None, Rel(df, [Col(None, c["name"], n, t) for c, n, t in zip(self.columns, names, types)]))
            else:  # a column of mixed types: row by row
                for r in rows:
                    self.session.insert(self.name, None, Binder(self.session, r).query(values))
        except Exception as x:
            self.fail()
            raise x if isinstance(x, PlanError | ExecutionError) else ExecutionError(str(x).split("\n")[0]) from x

    def fail(self) -> None:
        if not self.dead:
            self.dead = True
            self.session.finish(False)

    def close(self) -> None:
        if not self.dead:
            self.flush()
            self.dead = True
            self.session.finish(True)

    def __enter__(self) -> Inserter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.fail()
        else:
            self.close()


def _kind(v) -> str | None:
    return None if v is None else BOOLEAN if isinstance(v, bool) else INTEGER if isinstance(v, int) else S.REAL if isinstance(v, float) else TEXT if isinstance(v, str) else "BLOB"


def _tuple(params) -> tuple:
    return tuple(params) if isinstance(params, list | tuple) else (params,)


def _named(rel: Rel) -> DataFrame:
    """The DataFrame under the names that the user gave; untyped NULLs are INTEGERs."""
    return rel.df.select(*[(F.col(c.id) if c.type else F.col(c.id).cast("bigint")).alias(c.name) for c in rel.cols])

