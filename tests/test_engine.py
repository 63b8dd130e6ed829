"""The SQL engine: semantics by small cases, one group for each area."""

import math
import threading

import pytest

from brindle.errors import ExecutionError, ParseError, PlanError
from brindle.plans import tree as T
from brindle.plans.lexer import split_statements
from brindle.plans.parser import parse, parse_query
from brindle.session import Database
from brindle.sources.store import BlackholeStore


@pytest.fixture()
def s(spark):
    return Database(spark).connect()


def rows(s, sql, *params):
    return [tuple(r) for r in s.query(sql, params).collect()]


def one(s, expr, *params):
    return rows(s, f"SELECT {expr}", *params)[0][0]


def test_parse_and_print_round_trip():
    for q in ("SELECT a.b, count(*) AS n FROM t AS a JOIN u ON ((a.x = u.y) AND (NOT (a.z IS NULL))) GROUP BY a.b HAVING (count(*) > 1) ORDER BY n DESC NULLS LAST LIMIT 5 OFFSET 2", "VALUES (1, 'it''s'), (NULL, TRUE)", "(SELECT 1) UNION ALL (SELECT 2)"):
        assert T.text_of(parse_query(q)) == q
    assert split_statements("select ';'; -- a;\nselect 2 /* ; */") == ["select ';'", "-- a;\nselect 2 /* ; */"]
    for bad in ("SELECT", "SELECT 1 FROM", "VALUES (1), (1, 2)", "SELECT 'x", "INSERT t VALUES (1)", "SELECT 1 2"):
        with pytest.raises(ParseError):
            parse(bad)


@pytest.mark.parametrize(
    "expr,value",
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("1 + 2 * 3", 7), ("2 - 3 - 4", -5), ("1.0 / 0.0", math.inf), ("-1.0 / 0.0", -math.inf),
        ("CAST(2.5 AS INTEGER)", 3), ("CAST(-2.5 AS INTEGER)", -3), ("CAST('on' AS BOOLEAN)", True), ("CAST(1.0 AS TEXT)", "1"), ("CAST(0.00001 AS TEXT)", "0.00001"),
        ("CAST(12345678.9 AS TEXT)", "12345678.9"), ("CAST(1e AS TEXT)", None), ("NULL AND false", False), ("NULL OR true", True), ("NOT NULL IS NULL", False),
        ("(NULL IS TRUE)", False), ("'a_c' LIKE 'a\\_c'", True), ("'abc' LIKE 'a\\_c'", False), ("'ABC' ILIKE '%b%'", True), ("'a' || NULL", None),
        ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("CASE WHEN NULL THEN 1 ELSE 2 END", 2), ("log(100.0)", 2.0), ("ln(0.0)", -math.inf), ("sign(0.0)", 0.0),
        ("trunc(-1.5)", -1.0), ("round(2.5)", 3.0), ("replace('abc', '', 'x')", "xaxbxcx"), ("repeat('ab', 2)", "abab"), ("length('\U0001f600')", 1), ("octet_length('\U0001f600')", 4),
        ("NULL * 0", None), ("power(2.0, 10.0)", 1024.0), ("mod(-7, 3)", -1), ("ceil(1.2)", 2.0), ("9223372036854775807", 2**63 - 1), ("-9223372036854775808", -(2**63)),
    ],
)
def test_expressions(s, expr, value):
    if expr == "CAST(1e AS TEXT)":
        with pytest.raises(ParseError):
            one(s, expr)
        return
    assert one(s, expr) == value


@pytest.mark.parametrize("expr", ["1 = 1.0", "sqrt(4)", "'a' + 1", "NOT 1", "CAST(1.5 AS BOOLEAN)", "CASE WHEN true THEN 1 ELSE 'a' END", "nope(1)", "$1", "x", "count(count(1))", "'a' LIKE 'b\\'"])
def test_plan_errors(s, expr):
    with pytest.raises(PlanError):
        one(s, expr)


@pytest.mark.parametrize("expr", ["1 / 0", "9223372036854775807 + 1", "CAST('1x' AS INTEGER)", "CAST(' 1' AS INTEGER)", "repeat('a', -1)", "CAST('maybe' AS BOOLEAN)", "(SELECT * FROM (VALUES (1), (2)) v)"])
def test_run_errors(s, expr):
    with pytest.raises(Exception):  # noqa: B017
        one(s, expr)


def test_queries(s):
    s.script("CREATE TABLE t (x INT, y INT); INSERT INTO t SELECT g, g % 3 FROM generate_series(1, 9) a(g); INSERT INTO t VALUES (NULL, NULL)")
    assert rows(s, "SELECT y, count(*), count(x), sum(x), avg(x) FROM t GROUP BY y ORDER BY y") == [(0, 3, 3, 18, 6.0), (1, 3, 3, 12, 4.0), (2, 3, 3, 15, 5.0), (None, 1, 0, None, None)]
    assert rows(s, "SELECT x FROM t ORDER BY x DESC LIMIT 2") == [(None,), (9,)]
    assert rows(s, "SELECT x FROM t ORDER BY x OFFSET 8 LIMIT 5") == [(9,), (None,)]
    assert rows(s, "SELECT x + 1 AS k, count(*) AS n FROM t GROUP BY k HAVING n > 0 ORDER BY k LIMIT 1") == [(2, 1)]
    assert rows(s, "SELECT count(*), sum(x), max(x) FROM t WHERE false") == [(0, None, None)]
    assert rows(s, "SELECT -x AS x FROM t WHERE x > 8 ORDER BY x") == [(-9,)]
    assert rows(s, "SELECT DISTINCT ON (y) y, x FROM t WHERE y IS NOT NULL ORDER BY y") == [(0, 3), (1, 1), (2, 2)]
    assert rows(s, "SELECT a.x, b.x FROM t a JOIN t b ON a.x + 7 = b.x ORDER BY a.x") == [(1, 8), (2, 9)]
    assert s.query("SELECT * FROM t a JOIN t b USING (x)").columns == ["x", "y", "x", "y"]
    assert rows(s, "SELECT x FROM t WHERE x > 7 UNION SELECT 8 UNION ALL SELECT 8 ORDER BY x") == [(8,), (8,), (9,)]
    assert rows(s, "SELECT count(*) FROM t WHERE NULL") == [(0,)]
    assert rows(s, "SELECT (SELECT max(x) FROM t), EXISTS (SELECT 1 FROM t WHERE x > 9)") == [(9, False)]
    assert rows(s, "SELECT abs(sum(x)) AS s, sum(DISTINCT y) AS d FROM t") == [(45, 3)]
    assert s.query("SELECT x, x + 1, count(*) FROM t GROUP BY x").columns == ["x", "(x + 1)", "count(*)"]
    for bad in ("SELECT x FROM t a JOIN t b USING (x)", "SELECT x, sum(y) FROM t", "SELECT 1 FROM t WHERE sum(x) > 1", "SELECT 1 UNION SELECT 1.0", "SELECT * FROM nope", "SELECT 1 FROM t, t"):
        with pytest.raises(PlanError):
            rows(s, bad)


def test_changes_and_constraints(s):
    s.script("CREATE TABLE t (a INT PRIMARY KEY, b TEXT DEFAULT 'd' UNIQUE, c REAL)")
    assert s.execute("INSERT INTO t VALUES (1, 'x', 1.5), (2, NULL, 2.0)") == 2
    assert s.execute("INSERT INTO t (c, a) VALUES ('2.5', 3)") == 1
    for bad in ("INSERT INTO t VALUES (1, 'z')", "INSERT INTO t VALUES (9, 'd')", "INSERT INTO t VALUES (NULL)", "INSERT INTO t (a, b) VALUES (8, NULL)", "UPDATE t SET a = 1"):
        with pytest.raises(ExecutionError):
            s.execute(bad)
    assert s.execute("UPDATE t SET a = a + 1, b = b || '!'") == 3
    assert rows(s, "SELECT * FROM t ORDER BY a") == [(2, "x!", 1.5), (3, None, 2.0), (4, "d!", 2.5)]
    assert s.execute("DELETE FROM t WHERE a = (SELECT max(a) FROM t)") == 1
    assert s.execute("TRUNCATE TABLE t") == 0 and rows(s, "SELECT count(*) FROM t") == [(0,)]
    with pytest.raises(PlanError):
        s.execute("CREATE TABLE t (a INT)")
    s.execute("CREATE TABLE IF NOT EXISTS t (a INT)")
    s.script("DROP TABLE t; DROP TABLE IF EXISTS t")


def test_transactions_and_sessions(spark, s):
    s.script("CREATE TABLE t (a INT PRIMARY KEY); INSERT INTO t VALUES (1)")
    s.execute("BEGIN")
    s.execute("INSERT INTO t VALUES (2)")
    assert rows(s, "SELECT count(*) FROM t") == [(2,)] and rows(s.db.connect(), "SELECT count(*) FROM t") == [(1,)]
    with pytest.raises(PlanError):
        s.execute("INSERT INTO nope VALUES (1)")
    s.execute("COMMIT")
    assert rows(s, "SELECT count(*) FROM t") == [(2,)]
    s.execute("BEGIN")
    with pytest.raises(ExecutionError):
        s.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(ExecutionError):
        s.query("SELECT 1")
    s.execute("COMMIT")
    s.script("BEGIN; DROP TABLE t; ROLLBACK")
    assert rows(s, "SHOW TABLES") == [("t",)]


def test_sequences_views_prepared(s):
    s.script("CREATE SEQUENCE q START 5 INCREMENT 2 MAXVALUE 9 CYCLE; CREATE TABLE t (id INT DEFAULT nextval('q'), n TEXT); INSERT INTO t (n) VALUES ('a'), ('b'), ('c'), ('d')")
    assert rows(s, "SELECT id, n FROM t ORDER BY n") == [(5, "a"), (7, "b"), (9, "c"), (5, "d")]
    assert rows(s, "SELECT nextval('q'), currval('q')") == [(7, 7)]
    assert sorted(r[0] for r in rows(s, "SELECT nextval('q') AS v FROM generate_series(1, 3) g")) == [5, 7, 9]
    with pytest.raises(ExecutionError):
        s.db.connect().query("SELECT currval('q')")
    s.execute("CREATE VIEW v (k) AS SELECT id * 10 FROM t")
    assert rows(s, "SELECT v.k FROM v ORDER BY k LIMIT 1") == [(50,)]
    s.execute("PREPARE p AS SELECT n FROM t WHERE id = $1 ORDER BY n")
    assert rows(s, "EXECUTE p(5)") == [("a",), ("d",)]
    s.execute("DEALLOCATE p")
    with pytest.raises(PlanError):
        s.query("EXECUTE p(5)")
    p = s.prepare("INSERT INTO t VALUES ($1, $2)")
    assert p.execute((100, "z")) == 1
    assert rows(s, "SELECT name FROM engine_sequences()") == [("q",)] and ("count", "aggregate") in rows(s, "SELECT * FROM engine_functions()")
    assert [r[0] for r in rows(s, "DESCRIBE t")] == ["id", "n", "rowid"]
    assert rows(s, "EXPLAIN SELECT 1")[0][0].startswith("==")


def test_sessions_of_one_thread_are_kept_apart(spark, s):
    s.script("CREATE TABLE t (a INT); BEGIN; INSERT INTO t VALUES (1)")
    other = s.db.connect()
    with pytest.raises(ExecutionError):
        other.execute("INSERT INTO t VALUES (2)")
    assert rows(other, "SELECT count(*) FROM t") == [(0,)]
    s.execute("COMMIT")
    other.execute("INSERT INTO t VALUES (3)")
    assert rows(s, "SELECT a FROM t ORDER BY a") == [(1,), (3,)]


def test_sessions_of_two_threads_take_turns(spark, s):
    s.script("CREATE TABLE t (a INT); BEGIN; INSERT INTO t VALUES (1)")
    other = threading.Thread(target=lambda: s.db.connect().execute("INSERT INTO t VALUES (2)"))
    other.start()
    s.execute("COMMIT")
    other.join(60)
    assert rows(s, "SELECT a FROM t ORDER BY a") == [(1,), (2,)]


def test_an_error_of_a_select_ends_its_transaction(s):
    s.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (0); BEGIN; INSERT INTO t VALUES (5)")
    with pytest.raises(ExecutionError):
        s.query("SELECT 1 % a FROM t")
    with pytest.raises(ExecutionError):
        s.query("SELECT 1")
    s.execute("COMMIT")
    assert rows(s, "SELECT a FROM t") == [(0,)]


def test_nextval_has_a_value_for_each_row_anywhere(s):
    s.script("CREATE SEQUENCE q; CREATE TABLE t (a INT); INSERT INTO t VALUES (10), (20), (30); CREATE VIEW v (n) AS SELECT nextval('q') FROM t")
    assert rows(s, "SELECT nextval('q')") == [(1,)]  # the view's definition moved nothing
    assert sorted(rows(s, "SELECT n FROM v")) == [(2,), (3,), (4,)]
    assert rows(s, "SELECT count(*) FROM t WHERE nextval('q') % 2 = 1") == [(2,)]  # 5, 6, 7
    assert rows(s, "SELECT sum(nextval('q') * 100) FROM t") == [(2700,)]  # 8, 9, 10
    assert sorted(rows(s, "SELECT nextval('q') - nextval('q') AS d FROM t")) == [(-1,)] * 3
    assert rows(s, "SELECT 'nextval(' || 'x' FROM t LIMIT 1") == [("nextval(x",)] and rows(s, "SELECT currval('q')") == [(16,)]


def test_old_snapshots_go(spark, s):
    from brindle.session import KEEP_COMMITS

    s.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    first = s.state["tables"]["t"]["paths"][0]
    for _ in range(KEEP_COMMITS + 1):
        s.execute("UPDATE t SET a = a + 1")
    where = s.db.store._path(first)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    assert rows(s, "SELECT a FROM t") == [(KEEP_COMMITS + 2,)]


def test_changes_rewrite_only_folders_with_hits(s):
    s.script("CREATE TABLE t (a INT PRIMARY KEY, b TEXT NOT NULL); INSERT INTO t VALUES (1, 'x'), (2, 'y'); INSERT INTO t VALUES (3, 'z'); INSERT INTO t VALUES (4, 'w')")
    first, second, third = s.state["tables"]["t"]["paths"]
    assert s.execute("UPDATE t SET b = b || '!' WHERE a = 3") == 1
    paths = s.state["tables"]["t"]["paths"]
    assert paths[0] == first and paths[1] != second and paths[2] == third
    for bad in ("UPDATE t SET a = 1 WHERE a = 3", "UPDATE t SET b = NULL WHERE a = 4"):  # a key of a folder that stays
        with pytest.raises(ExecutionError):
            s.execute(bad)
    assert s.execute("DELETE FROM t WHERE a = 2 OR b = 'w'") == 2
    assert rows(s, "SELECT * FROM t ORDER BY a") == [(1, "x"), (3, "z!")] and paths[1] in s.state["tables"]["t"]["paths"]
    assert s.execute("DELETE FROM t WHERE a > 100") == 0 and s.execute("UPDATE t SET a = a + 2") == 2
    assert rows(s, "SELECT a FROM t ORDER BY a") == [(3,), (5,)]
    assert s.execute("DELETE FROM t") == 2 and rows(s, "SELECT count(*) FROM t") == [(0,)]
    assert s.execute("DELETE FROM t") == 0 and s.execute("UPDATE t SET b = 'q'") == 0


def test_changes_by_chance_are_counted_right(s):
    s.script("CREATE TABLE t (a INT)")
    for k in range(3):
        s.execute(f"INSERT INTO t SELECT g FROM generate_series({1000 * k + 1}, {1000 * k + 1000}) x(g)")
    gone = s.execute("DELETE FROM t WHERE a > 1000 AND random() < 0.1")
    assert 0 < gone < 2000 and rows(s, "SELECT count(*) FROM t") == [(3000 - gone,)]


def test_shell_completes_words(s):
    from brindle.__main__ import completions

    s.script("CREATE TABLE selection (a INT); CREATE VIEW seldom AS SELECT a FROM selection")
    assert completions(s, "sel") == ["seldom", "select", "selection"] and "SELECT" in completions(s, "SEL")
    assert completions(s, ".im") == [".import"] and completions(s, "zzz") == []


def test_names_that_are_no_keywords(s):
    s.execute("CREATE TABLE t (bool BOOL, escape INT)")
    s.execute("INSERT INTO t VALUES (true, 1)")
    assert rows(s, "SELECT bool, escape FROM t") == [(True, 1)]


def test_inserter_files_and_stores(spark, s, tmp_path):
    s.execute("CREATE TABLE t (a INT, b TEXT)")
    with s.inserter("t", flush_rows=4) as ins:
        for i in range(10):
            ins.insert((i, str(i)))
    assert rows(s, "SELECT count(*), sum(a) FROM t") == [(10, 45)]
    with pytest.raises(PlanError), s.inserter("t") as ins:
        ins.insert((1,))
    (tmp_path / "a.csv").write_text('a,b\n1,"x, ""y"""\n2,z\n')
    (tmp_path / "a.txt").write_text("3\x1fp\x1e4\x1fq\x1e")
    assert s.load_file("t", str(tmp_path / "a.csv"), "csv", skip_header=True) == 2
    assert s.load_file("t", str(tmp_path / "a.txt"), "ascii") == 2
    assert rows(s, "SELECT b FROM t WHERE a = 1 ORDER BY b") == [("1",), ('x, "y"',)] and rows(s, "SELECT b FROM t WHERE b = 'q'") == [("q",)]
    db = Database(spark, f"file://{tmp_path}/db")
    db.connect().script("CREATE TABLE k (a INT PRIMARY KEY); INSERT INTO k VALUES (7)")
    assert rows(Database(spark, f"file://{tmp_path}/db").connect(), "SELECT a FROM k") == [(7,)]
    hole = Database(spark, store=BlackholeStore(spark)).connect()
    hole.execute("CREATE TABLE k (a INT)")
    hole.execute("INSERT INTO k VALUES (1)")
    assert rows(hole, "SELECT count(*) FROM k") == [(0,)]


def test_driver_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_pairs_of_few_keys_are_shared_among_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    n = 9000
    spark.range(n).select("id", (F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("seg")).coalesce(1).write.parquet(f"{tmp_path}/c.parquet")
    db = Database(spark)
    db.attach_parquet(str(tmp_path), "c")
    q = db.connect().query("SELECT a.id AS x, b.id AS y FROM c a JOIN c b ON a.k = b.k AND a.id < b.id WHERE a.seg = b.seg")
    got = q.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).collect()
    groups = {}
    for i in range(n):
        groups.setdefault((i % 2, i % 3 == 0), []).append(i)
    expected = [(len(g) * (len(g) - 1) // 2, sum(v * (len(g) - 1 - i) for i, v in enumerate(g)), sum(v * i for i, v in enumerate(g))) for g in groups.values()]
    assert [sum(r[c] for r in got) for c in ("n", "x", "y")] == [sum(e[c] for e in expected) for c in range(3)]
    assert max(r["n"] for r in got) < 0.6 * sum(r["n"] for r in got)


def test_dealt_joins_give_what_plain_ones_give(spark, s, monkeypatch):
    from brindle.operators import dealt_join

    s.script("CREATE TABLE t (k INT, r REAL, x TEXT, v INT); INSERT INTO t SELECT g % 4, CAST(g % 7 AS REAL), CAST(g % 3 AS TEXT), g FROM generate_series(1, 60) x(g)")
    s.execute("INSERT INTO t VALUES (NULL, 1.0, 'a', 70), (1, NULL, NULL, 71), (2, CAST('nan' AS REAL), 'b', 72), (2, CAST('nan' AS REAL), 'b', 73), (3, -0.0, '0', 74), (1, 5.0, '1', 1), (1, 5.0, '1', 1)")
    s.execute("INSERT INTO t SELECT * FROM t WHERE v < 9")
    queries = (
        "SELECT a.v, b.v FROM t a JOIN t b ON a.k = b.k AND a.r > b.r",
        "SELECT a.v, b.v, b.x FROM t a JOIN t b ON a.r = b.r AND a.v <> b.v WHERE a.x = b.x AND a.v > 5",
        "SELECT a.v, b.v FROM t a, t b WHERE b.k = a.k AND a.v <= b.v AND b.r < 5.0",
        "SELECT a.v, b.v FROM t a JOIN t b USING (k, x) WHERE a.v < b.v",
        "SELECT a.v, b.v FROM t a JOIN t b ON a.k + 1 = b.v % 3 AND a.x || 'q' < b.x || 'r' AND a.v > 3",
        "SELECT a.v, b.v, c.v FROM t a JOIN t b ON a.k = b.k AND a.v < b.v JOIN t c ON c.x = b.x AND c.v + a.v < 30",
        "SELECT a.k, count(*), sum(b.n) FROM t a JOIN (SELECT k AS j, v AS n FROM t WHERE v > 2) b ON a.k = b.j AND (a.v < b.n OR a.r = 3.0) GROUP BY a.k",
    )
    ordered = lambda q: sorted(rows(s, q), key=str)
    plain = [ordered(q) for q in queries]
    for name, value in (("FEW_PAIRS", 0), ("FEW_A_ROW", 0), ("LEAST_CUT", 1), ("LEAST_ROWS", 3), ("MOST_ROWS", 3)):
        monkeypatch.setattr(dealt_join, name, value)
    for q, rows_before in zip(queries, plain):
        assert len(rows_before) > 3 and ordered(q) == rows_before, q
        plan = s.query(q)._jdf.queryExecution().toString()
        assert "__slot" in plan, q


def test_errors_of_counted_joins_come_when_rows_are_read(s):
    s.script("CREATE TABLE t (k INT, v TEXT); INSERT INTO t VALUES (1, 'x'), (1, '2')")
    q = s.query("SELECT a.k FROM t a JOIN t b ON CAST(a.v AS INT) = b.k AND a.v < b.v")
    with pytest.raises(Exception, match="x"):
        q.collect()


def test_distinct_on_takes_the_first_row_by_key(s):
    s.script("CREATE TABLE t (a INT, k INT, c INT, PRIMARY KEY (k, a)); CREATE TABLE u (c INT, v INT)")
    s.execute("INSERT INTO t VALUES (1, 7, 1), (2, 7, 1), (1, 9, 0)")
    s.execute("INSERT INTO t SELECT 0, g, g % 3 FROM generate_series(100, 5000) x(g)")  # more bytes: scanned first
    s.execute("INSERT INTO t VALUES (3, 4, 2), (2, 4, 2), (0, 7, 1)")
    s.execute("INSERT INTO u VALUES (1, 20), (0, 30), (1, 10)")
    first = [(0, 9, 1), (1, 7, 0), (2, 4, 2)]
    assert sorted(rows(s, "SELECT DISTINCT ON (c) c, k, a FROM t")) == first
    assert sorted(rows(s, "SELECT DISTINCT ON (c) c, k, a FROM (SELECT a, c, k FROM t WHERE k > 0) x")) == first
    s.execute("CREATE VIEW w AS SELECT c, a, k FROM t")
    assert sorted(rows(s, "SELECT DISTINCT ON (c) c, k, a FROM w WHERE k <> 4")) == [*first[:2], (2, 101, 0)]
    assert sorted(rows(s, "SELECT DISTINCT ON (u.c) u.c, v, k FROM u JOIN t ON u.c = t.c")) == [(0, 30, 9), (1, 20, 7)]
    assert rows(s, "SELECT DISTINCT ON (x % 2) x FROM generate_series(1, 9) g(x) ORDER BY x") == [(1,), (2,)]
    assert len(rows(s, "SELECT DISTINCT ON (count(*)) c FROM t GROUP BY c")) in (1, 2, 3)


def test_pairs_of_a_small_side_are_shared_among_tasks(spark, tmp_path):
    from bisect import bisect_left

    from pyspark.sql import functions as F

    balance = lambda step: ((F.col("id") * step) % 10007).cast("double")
    spark.range(1500).select("id", (F.col("id") % 2).alias("sk"), balance(37).alias("sb")).coalesce(1).write.parquet(f"{tmp_path}/s.parquet")
    spark.range(30000).select("id", F.when(F.col("id") > 9, F.col("id") % 2).alias("ck"), F.when(F.col("id") < 20, float("nan")).otherwise(balance(91)).alias("cb")).coalesce(1).write.parquet(f"{tmp_path}/c.parquet")
    db = Database(spark)
    db.attach_parquet(str(tmp_path), "s", "c")
    q = db.connect().query("SELECT s.id AS x, c.id AS y FROM s JOIN c ON sk = ck AND sb > cb")
    got = q.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("x").alias("x")).collect()
    balances = [sorted((i * 91) % 10007 for i in range(20, 30000) if i % 2 == k) for k in (0, 1)]
    below = [bisect_left(balances[i % 2], (i * 37) % 10007) for i in range(1500)]
    assert [sum(r[c] for r in got) for c in ("n", "x")] == [sum(below), sum(i * n for i, n in enumerate(below))]
    assert max(r["n"] for r in got) < 0.6 * sum(r["n"] for r in got)
