"""Queries of the SQL engine for the driver: one for each family of operators, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.errors import ExecutionError
from brindle.session import Database, Session
from brindle.sources.store import BlackholeStore, scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def connect(spark: SparkSession, sf_dir: str) -> Session:
    db = Database(spark)
    db.attach_parquet(sf_dir, *TABLES)
    return db.connect()


def _add(name: str, sql: str, oracle: str | None = None, params: tuple = (), before: tuple = ()) -> None:
    """A query in the engine's SQL after the statements ``before``, and the SQL that DuckDB runs instead (None: the same)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = connect(spark, sf_dir)
        for one in before:
            s.query(one) if one.lower().startswith(("select", "execute")) else s.execute(one)
        return s.query(sql, params)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or sql


_L = "CAST({} AS BIGINT)".format

_add("scan_project", "SELECT l_orderkey, l_partkey, l_extendedprice * (1.0 - l_discount) AS net FROM lineitem")
_add("table_statement", "TABLE region", "SELECT r_name, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM region")
_add("filter_cmp", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 10.0 AND l_quantity < 25.0 AND l_returnflag = 'R'")
_add("index_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 900")
_add("filter_3vl", "SELECT p_partkey FROM part WHERE NOT (CASE WHEN p_size > 25 THEN NULL ELSE p_size = 10 END) OR p_size = 50")
_add("arith_int_div", "SELECT o_orderkey, (o_orderkey - 500) / 7 AS q, (o_orderkey - 500) % 7 AS r, -o_orderkey * 3 + 2 AS m FROM orders", "SELECT o_orderkey, (o_orderkey - 500) // 7 AS q, (o_orderkey - 500) % 7 AS r, -o_orderkey * 3 + 2 AS m FROM orders")
_add("arith_real", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, l_extendedprice % 100.0 AS rest, (l_tax + 1.0) * 2.0 - 0.5 AS k FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice / l_quantity AS unit, l_extendedprice % 100.0::DOUBLE AS rest, (l_tax + 1.0::DOUBLE) * 2.0::DOUBLE - 0.5::DOUBLE AS k FROM lineitem")
_add("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS s FROM orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS BIGINT) AS s FROM orders")
_add("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind FROM part")
_add("like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_type NOT LIKE '_x%'")
_add("ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%AR%' AND p_brand NOT ILIKE 'brand#1_'")
_add("is_null", "SELECT c_custkey FROM customer WHERE CASE WHEN c_acctbal > 0.0 THEN c_acctbal END IS NULL AND c_name IS NOT NULL")
_add("is_true", "SELECT c_custkey, (CASE WHEN c_acctbal > 0.0 THEN true END) IS TRUE AS a, (CASE WHEN c_acctbal > 0.0 THEN NULL ELSE false END) IS FALSE AS b, (c_acctbal > 5000.0) IS NOT TRUE AS c FROM customer", "SELECT c_custkey, coalesce(c_acctbal > 0, false) AS a, NOT (c_acctbal > 0) AS b, NOT (c_acctbal > 5000) AS c FROM customer")
_add("cast_matrix", "SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS i, CAST(CAST(o_orderkey AS TEXT) AS INTEGER) AS t, CAST(o_orderkey % 2 AS BOOLEAN) AS b, CAST(o_orderkey AS REAL) AS r, CAST(o_orderkey % 2 = 0 AS TEXT) AS bt, CAST(CAST(o_totalprice AS TEXT) AS REAL) AS rt, CAST('on' AS BOOLEAN) AS word FROM orders", "SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS i, o_orderkey AS t, o_orderkey % 2 <> 0 AS b, CAST(o_orderkey AS DOUBLE) AS r, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS bt, o_totalprice AS rt, true AS word FROM orders")
_add("concat", "SELECT c_custkey, c_name || ':' || c_mktsegment || NULL AS n, c_mktsegment || '/' || CAST(c_custkey AS TEXT) AS k FROM customer", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS n, c_mktsegment || '/' || CAST(c_custkey AS VARCHAR) AS k FROM customer")
_add("math_fns", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal) AS r, trunc(c_acctbal) AS t, sign(c_acctbal) AS s, sqrt(abs(c_acctbal)) AS q, power(c_acctbal, 2.0) AS p, mod(c_custkey, 7) AS m, exp(c_acctbal / 10000.0) AS e FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal) AS r, trunc(c_acctbal) AS t, CAST(sign(c_acctbal) AS DOUBLE) AS s, sqrt(abs(c_acctbal)) AS q, pow(c_acctbal, 2) AS p, c_custkey % 7 AS m, exp(c_acctbal / 10000) AS e FROM customer")
_add("log_fns", "SELECT o_orderkey, ln(o_totalprice) AS a, log(o_totalprice) AS b, log10(o_totalprice) AS c, log(2.0, o_totalprice) AS d FROM orders", "SELECT o_orderkey, ln(o_totalprice) AS a, log10(o_totalprice) AS b, log10(o_totalprice) AS c, ln(o_totalprice) / ln(2) AS d FROM orders")
_trig = "sin({0}) AS a, cos({0}) AS b, tan({0}) AS c, atan({0}) AS d, asin({0} / 100.0) AS e, acos({0} / 100.0) AS f, atan2({0}, 3.0) AS g, sinh({0} / 10.0) AS h, cosh({0} / 10.0) AS i, tanh({0} / 10.0) AS j, asinh({0}) AS k, acosh({0} + 1.0) AS l, atanh({0} / 100.0) AS m, degrees({0}) AS n, radians({0}) AS o, pi() AS p"
_add("trig_fns", "SELECT p_partkey, " + _trig.format("CAST(p_size AS REAL)") + " FROM part", "SELECT p_partkey, " + _trig.format("CAST(p_size AS DOUBLE)") + " FROM part")
_add("string_fns", "SELECT p_partkey, length(p_name) AS n, lower(p_brand) AS l, upper(p_name) AS u, octet_length(p_name) AS o, repeat(p_brand, 2) AS r, replace(p_name, 'a', '<a>') AS x FROM part", "SELECT p_partkey, length(p_name) AS n, lower(p_brand) AS l, upper(p_name) AS u, CAST(strlen(p_name) AS BIGINT) AS o, repeat(p_brand, 2) AS r, replace(p_name, 'a', '<a>') AS x FROM part")
_add("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_add("join_using", "SELECT a.o_orderkey AS k, b.n FROM orders a JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) b USING (o_orderkey)")
_add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_add("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
_add("join_theta", "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
_add("join_mixed", "SELECT s_name, c_name FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal")
_add("join_nway", "SELECT r_name, count(*) AS n, sum(o_orderkey) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name", "SELECT r_name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name")
_add("join_expr_key", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey + 5 = b.n_nationkey * 2", "SELECT CAST(a.n_nationkey AS BIGINT) AS x, CAST(b.n_nationkey AS BIGINT) AS y FROM nation a JOIN nation b ON a.n_nationkey + 5 = b.n_nationkey * 2")
_add("self_join", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE a.c_mktsegment = b.c_mktsegment")
_add("agg_ungrouped", "SELECT count(*) AS n, sum(l_linenumber) AS s, avg(l_quantity) AS a, min(l_shipmode_) AS lo, max(l_discount) AS hi FROM (SELECT l_linenumber, l_quantity, l_returnflag AS l_shipmode_, l_discount FROM lineitem) t", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_quantity) AS a, min(l_returnflag) AS lo, max(l_discount) AS hi FROM lineitem")
_add("agg_empty", "SELECT count(*) AS n, sum(o_orderkey) AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0 AND false", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, avg(o_totalprice) AS a FROM orders WHERE false")
_add("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, round(avg(l_extendedprice)) AS p FROM lineitem GROUP BY l_returnflag, l_linestatus")
_add("agg_expr_over", "SELECT o_orderstatus, round(sum(o_totalprice) / CAST(count(*) AS REAL) + 1.0) AS k, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS size, abs(min(o_orderkey) - max(o_orderkey)) AS span FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(sum(o_totalprice) / count(*) + 1) AS k, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS size, abs(min(o_orderkey) - max(o_orderkey)) AS span FROM orders GROUP BY o_orderstatus")
_add("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, sum(DISTINCT l_linenumber) AS d, avg(DISTINCT l_linenumber) AS a, count(*) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS d, avg(DISTINCT l_linenumber) AS a, count(*) AS n FROM lineitem GROUP BY l_returnflag")
_add("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 3 AND sum(o_totalprice) > 1000.0", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 3 AND sum(o_totalprice) > 1000")
_add("group_by_alias", "SELECT o_orderkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY bucket")
_add("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_add("sort_nulls", "SELECT c_custkey, CASE WHEN c_acctbal > 0.0 THEN c_acctbal END AS b FROM customer ORDER BY b DESC NULLS LAST, c_custkey LIMIT 100", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer ORDER BY b DESC NULLS LAST, c_custkey LIMIT 100")
_add("sort_default_nulls", "SELECT c_custkey FROM customer ORDER BY CASE WHEN c_acctbal > 0.0 THEN c_acctbal END DESC, c_custkey LIMIT 20", "SELECT c_custkey FROM customer ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS FIRST, c_custkey LIMIT 20")
_add("topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 + 5 LIMIT 20")
_add("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
_add("union_distinct", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) ORDER BY k LIMIT 30", "SELECT CAST(k AS BIGINT) AS k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) ORDER BY k LIMIT 30")
_add("scalar_subquery", "SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) AS d FROM customer WHERE c_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
_add("exists", "SELECT r_name, EXISTS (SELECT 1 FROM nation WHERE n_name LIKE 'A%') AS e, EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 0) AS f FROM region")
_add("derived_table", "SELECT big.k, round(big.t) AS t FROM (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey) AS big(k, t) WHERE big.t > 100000.0")
_add("values", "SELECT column1 AS a, column2 AS b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) v", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) v(a, b)")
_add("select_no_from", "SELECT 1 + 2 AS a, 'it''s' AS b, NULL IS NULL AS c", "SELECT CAST(3 AS BIGINT) AS a, 'it''s' AS b, true AS c")
_add("generate_series", "SELECT x, x * x AS y FROM generate_series(-5, 1000) g(x)", "SELECT x, x * x AS y FROM generate_series(-5, 1000) g(x)")
_add("view", "SELECT seg, n FROM per_segment WHERE n > 0", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment", before=("CREATE VIEW per_segment (seg, n) AS SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment",))
_add("params", "SELECT o_orderkey FROM orders WHERE o_orderkey < $1 AND o_orderstatus = $2", "SELECT o_orderkey FROM orders WHERE o_orderkey < 200 AND o_orderstatus = 'O'", params=(200, "O"))
_add("prepare_execute", "EXECUTE p(5, 'BUILDING')", "SELECT c_custkey FROM customer WHERE c_nationkey = 5 AND c_mktsegment = 'BUILDING'", before=("PREPARE p AS SELECT c_custkey FROM customer WHERE c_nationkey = $1 AND c_mktsegment = $2",))
_TMP = "CREATE TABLE t (k INTEGER PRIMARY KEY, price REAL, status TEXT DEFAULT 'new')"
_add("insert_select", "SELECT k, price, status FROM t", "SELECT o_orderkey AS k, o_totalprice AS price, 'new' AS status FROM orders WHERE o_orderstatus = 'F'", before=(_TMP, "INSERT INTO t (k, price) SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"))
_FILL = (_TMP, "INSERT INTO t SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
_add("update", "SELECT k, price, status FROM t", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '!' ELSE o_orderstatus END AS status FROM orders", before=(*_FILL, "UPDATE t SET price = price * 2.0, status = status || '!' WHERE k % 3 = 0"))
_add("delete", "SELECT k, price FROM t", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE NOT o_totalprice > 100000", before=(*_FILL, "DELETE FROM t WHERE price > 100000.0"))
_add("truncate", "SELECT count(*) AS n FROM t", "SELECT CAST(0 AS BIGINT) AS n", before=(*_FILL, "TRUNCATE t"))
_add("sequence", "SELECT id, name FROM s ORDER BY id", "SELECT 10 + 5 * (row_number() OVER (ORDER BY r_name) - 1) AS id, r_name AS name FROM region", before=("CREATE SEQUENCE ids START 10 INCREMENT 5", "CREATE TABLE s (id INTEGER DEFAULT nextval('ids'), name TEXT)", "INSERT INTO s (name) SELECT r_name FROM region ORDER BY r_name"))
_add("txn_rollback", "SELECT count(*) AS n FROM t", "SELECT count(*) AS n FROM orders", before=(*_FILL, "BEGIN", "DELETE FROM t", "ROLLBACK"))
_add("show_tables", "SHOW TABLES", "SELECT 't' AS name", before=(_TMP,))
_add("describe", "DESCRIBE t", "SELECT * FROM (VALUES ('k', 'INTEGER', false, true, NULL), ('price', 'REAL', true, false, NULL), ('status', 'TEXT', true, false, '''new''')) v(column_name, type, is_nullable, is_primary_key, default_value)", before=(_TMP,))
_add("leaderboard_q1", "SELECT x, y FROM (SELECT g % 100 AS x, g / 100 AS y FROM generate_series(0, 999999) s(g)) t WHERE x >= 90 AND y = 10", "SELECT g % 100 AS x, g // 100 AS y FROM generate_series(0, 999999) s(g) WHERE g % 100 >= 90 AND g // 100 = 10")
_add("leaderboard_q4", "SELECT a.x AS x FROM (SELECT g AS x FROM generate_series(1, 10000) s(g)) a JOIN (SELECT -g AS x FROM generate_series(1, 1000000) s(g)) b ON a.x = b.x", "SELECT CAST(0 AS BIGINT) AS x WHERE false")


_ROWS = ("CREATE TABLE t (k INTEGER PRIMARY KEY, c INTEGER NOT NULL, price REAL)", "INSERT INTO t SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey")
_add("star", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
_add("values_statement", "VALUES (1, 'a', 2.5), (2, NULL, -1.0) ORDER BY column1 DESC", "SELECT CAST(column1 AS BIGINT) AS column1, column2, CAST(column3 AS DOUBLE) AS column3 FROM (VALUES (1, 'a', 2.5), (2, NULL, -1.0)) v(column1, column2, column3)")
_add("order_by_aggregate", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, sum(o_orderkey) DESC, o_custkey LIMIT 25", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, sum(o_orderkey) DESC, o_custkey LIMIT 25")
_add("distinct_on", "SELECT DISTINCT ON (c) c, k, price FROM t", "SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", before=_ROWS)
_add("mod_real", "SELECT p_partkey, mod(p_retailprice, 7.5) AS m FROM part", "SELECT p_partkey, p_retailprice % 7.5::DOUBLE AS m FROM part")
_add("real_by_zero", "SELECT c_custkey, (c_acctbal + 1.0) / 0.0 AS q, c_acctbal * 0.0 = 0.0 AS z FROM customer WHERE c_acctbal <> -1.0", "SELECT c_custkey, CASE WHEN c_acctbal + 1 > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS q, true AS z FROM customer WHERE c_acctbal <> -1")
_add("like_column_pattern", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name LIKE '%' || 'A' || '%'", "SELECT n_name FROM nation WHERE n_name LIKE '%A%'")
_add("random_in_range", "SELECT count(*) AS n FROM (SELECT random() AS r FROM generate_series(1, 1000) g) t WHERE r >= 0.0 AND r < 1.0", "SELECT CAST(1000 AS BIGINT) AS n")
_add("setseed_repeats", "SELECT a.x = b.x AS same FROM one a, two b", "SELECT true AS same", before=("CREATE TABLE one (x REAL)", "CREATE TABLE two (x REAL)", "SELECT setseed(0.5)", "INSERT INTO one SELECT random()", "SELECT setseed(0.5)", "INSERT INTO two SELECT random()"))
_IDS = "CREATE SEQUENCE ids START 100 INCREMENT 2"
_add("sequence_expr", "SELECT v FROM d", "SELECT (100 + 2 * n) * 10 + 1 AS v FROM range(25) r(n)", before=(_IDS, "CREATE TABLE d (v INTEGER)", "INSERT INTO d SELECT nextval('ids') * 10 + 1 FROM nation"))
_add("sequence_view", "SELECT v FROM numbered", "SELECT 100 + 2 * n AS v FROM range(25) r(n)", before=(_IDS, "CREATE VIEW numbered (v) AS SELECT nextval('ids') FROM nation"))
_add("sequence_where", "SELECT count(*) AS n, currval('ids') AS newest FROM t", "SELECT CAST(10 AS BIGINT) AS n, CAST(148 AS BIGINT) AS newest", before=(_IDS, "CREATE TABLE t (x INTEGER)", "INSERT INTO t SELECT n_nationkey FROM nation WHERE nextval('ids') < 120"))
_add("sequence_derived", "SELECT sum(v) AS s, count(*) AS n FROM (SELECT nextval('ids') AS v, nextval('ids') AS w FROM region) t", "SELECT CAST(sum(100 + 4 * n) AS BIGINT) AS s, count(*) AS n FROM range(5) r(n)", before=(_IDS,))
_add("currval", "SELECT currval('ids') AS v", "SELECT CAST(102 AS BIGINT) AS v", before=(_IDS, "SELECT nextval('ids')", "SELECT nextval('ids')"))
_add("columns_function", "SELECT column_name, type, is_nullable, is_primary_key FROM engine_columns() WHERE table_name = 't' AND column_name <> 'rowid'", "SELECT * FROM (VALUES ('k', 'INTEGER', false, true), ('c', 'INTEGER', false, false), ('price', 'REAL', true, false)) v(column_name, type, is_nullable, is_primary_key)", before=_ROWS[:1])
_add("functions_function", "SELECT type, name FROM engine_functions() WHERE name = 'sqrt' OR name = 'count' OR name = 'generate_series'", "SELECT * FROM (VALUES ('scalar', 'sqrt'), ('aggregate', 'count'), ('table', 'generate_series')) v(type, name)")
_add("indexes_function", "SELECT table_name, index_name, is_unique FROM engine_indexes()", "SELECT * FROM (VALUES ('t', 'by_c', false), ('t', 'by_price', true)) v(table_name, index_name, is_unique)", before=(*_ROWS[:1], "CREATE INDEX by_c ON t (c)", "CREATE UNIQUE INDEX by_price ON t (price)"))
_add("keywords_function", "SELECT count(*) > 50 AS many, max(CASE WHEN keyword = 'SELECT' THEN 1 ELSE 0 END) AS has FROM engine_keywords()", "SELECT true AS many, CAST(1 AS BIGINT) AS has")
_add("sequences_function", "SELECT name, start_value, increment_by FROM engine_sequences()", "SELECT 'ids' AS name, CAST(100 AS BIGINT) AS start_value, CAST(2 AS BIGINT) AS increment_by", before=(_IDS,))
_add("views_function", "SELECT name, columns FROM engine_views()", "SELECT 'big' AS name, 'k, n' AS columns", before=("CREATE VIEW big (k, n) AS SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey",))
_add("drop_index_reindex", "SELECT index_name FROM engine_indexes()", "SELECT 'b' AS index_name", before=(*_ROWS, "CREATE INDEX a ON t (c)", "CREATE UNIQUE INDEX b ON t (k, c)", "REINDEX TABLE t", "DROP INDEX a"))
_add("analyze", "SELECT count(*) AS n FROM t", "SELECT count(*) AS n FROM orders", before=(*_ROWS, "ANALYZE t"))
_add("insert_values_default", "SELECT k, price, status FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(2.5 AS DOUBLE), 'new'), (2, NULL, 'old')) v(k, price, status)", before=(_TMP, "INSERT INTO t (k, price) VALUES (1, 2.5)", "INSERT INTO t VALUES (2, NULL, 'old')"))
_add("deallocate", "EXECUTE p", "SELECT 'EUROPE' AS r_name", before=("PREPARE p AS SELECT r_name FROM region", "DEALLOCATE p", "PREPARE p AS SELECT r_name FROM region WHERE r_name = 'EUROPE'"))
_add("txn_commit", "SELECT count(*) AS n, sum(k) AS s FROM t", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey % 2 = 0", before=(*_FILL, "BEGIN", "DELETE FROM t WHERE k % 2 = 1", "COMMIT"))
_RING = "(SELECT (g + {0}) % 500000 AS x, ((g + {0}) % 500000) * 10 AS y FROM generate_series(0, 999999) s(g))".format
_add("leaderboard_q2", f"SELECT count(*) AS n, max(a.x) AS ax, max(a.y) AS ay, max(b.x) AS bx, max(c.y) AS cy FROM {_RING(0)} a, {_RING(30000)} b, {_RING(60000)} c WHERE a.x = b.x AND c.y = b.y AND a.y >= 1000000 AND a.y < 1500000 AND c.x < 150000 AND c.x >= 100000", "SELECT CAST(400000 AS BIGINT) AS n, CAST(149999 AS BIGINT) AS ax, CAST(1499990 AS BIGINT) AS ay, CAST(149999 AS BIGINT) AS bx, CAST(1499990 AS BIGINT) AS cy")


def txn_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second session is refused while the first one's transaction is open, and loses nothing after it."""
    db = Database(spark)
    db.attach_parquet(sf_dir, *TABLES)
    a, b = db.connect(), db.connect()
    a.script("CREATE TABLE t (x INTEGER); BEGIN; INSERT INTO t VALUES (1)")
    try:
        b.execute("INSERT INTO t VALUES (2)")
    except ExecutionError:
        a.execute("INSERT INTO t VALUES (10)")
    a.execute("COMMIT")
    b.execute("INSERT INTO t VALUES (3)")
    return b.query("SELECT x FROM t")


def bulk_inserter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = connect(spark, sf_dir)
    s.execute("CREATE TABLE t (k INTEGER, name TEXT)")
    with s.inserter("t", flush_rows=4) as rows:
        for i in range(10):
            rows.insert((i, f"row {i}"))
    return s.query("SELECT k, name FROM t")


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = connect(spark, sf_dir)
    s.script("CREATE TABLE t (x INTEGER); -- a comment; with a semicolon\nINSERT INTO t VALUES (1), (2);\nUPDATE t SET x = x * 10")
    return s.query("SELECT x FROM t")


def blackhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, store=BlackholeStore(spark))
    db.attach_parquet(sf_dir, *TABLES)
    s = db.connect()
    s.script("CREATE TABLE t (x INTEGER); INSERT INTO t SELECT o_orderkey FROM orders")
    return s.query("SELECT count(*) AS n FROM t")


def _import(form: str, field: str, record: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Writes a small table as delimited text and imports it."""
        s = connect(spark, sf_dir)
        s.execute("CREATE TABLE r (k INTEGER, name TEXT)")
        path = scratch(spark, f"brindle-{form}") + "/in"
        spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").write.option("sep", field).option("lineSep", record).csv(path, header=form != "ascii")
        s.load_file("r", path, form, skip_header=form != "ascii", multi_line=False)
        return s.query("SELECT k, name FROM r")

    return run


for _f in (txn_conflict, bulk_inserter, script, blackhole):
    QUERIES[_f.__name__] = _f
ORACLES |= {
    "txn_conflict": "SELECT CAST(x AS BIGINT) AS x FROM (VALUES (1), (10), (3)) v(x)",
    "bulk_inserter": "SELECT n AS k, 'row ' || n AS name FROM range(10) r(n)",
    "script": "SELECT CAST(x AS BIGINT) AS x FROM (VALUES (10), (20)) v(x)",
    "blackhole": "SELECT CAST(0 AS BIGINT) AS n",
}
for _form, _field, _record in (("csv", ",", "\n"), ("tsv", "\t", "\n"), ("ascii", "\x1f", "\x1e")):
    QUERIES[f"{_form}_import"] = _import(_form, _field, _record)
    ORACLES[f"{_form}_import"] = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connect(spark, sf_dir).query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 10.0 GROUP BY l_returnflag ORDER BY l_returnflag")
