"""Named queries over the test tables, one or more for each operator, each with SQL for DuckDB.

A query is a script in the dialect: statements that make small managed tables, then one SELECT over
them or over the registered Parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.engine import Engine
from loomline.errors import CodecError, LoomlineError
from loomline.sources.store import Store

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

FLAGSHIP = """
SELECT n.n_name, COUNT(*) AS orders, SUM(o.o_totalprice) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = 'F' GROUP BY n.n_name HAVING COUNT(*) > 1 ORDER BY revenue DESC LIMIT 10
"""

#: Two managed tables in which both sides of a join have rows without a partner, and NULL keys.
PEOPLE = """
CREATE TABLE people(id INT, name TEXT, team INT);
INSERT INTO people(id, name, team) VALUES (1, 'ann', 10), (2, 'bob', 20), (3, 'cy', NULL), (4, 'di', 40);
CREATE TABLE teams(team INT, title TEXT, boss INT);
INSERT INTO teams(team, title, boss) VALUES (10, 'core', 1), (20, 'apps', NULL), (30, 'web', 9), (NULL, 'none', 2);
"""
PEOPLE_SQL = """
WITH people(id, name, team) AS (VALUES (1, 'ann', 10), (2, 'bob', 20), (3, 'cy', NULL), (4, 'di', 40)),
teams(team, title, boss) AS (VALUES (10, 'core', 1), (20, 'apps', NULL), (30, 'web', 9), (NULL, 'none', 2))
"""

#: name: (script, SELECT, DuckDB SQL; None where the SELECT itself is what DuckDB runs).
SPECS: dict[str, tuple[str, str, str | None]] = {
    "flagship": ("", FLAGSHIP, None),
    # Projection and filters
    "select_star": ("", "SELECT * FROM nation", None),
    "select_cols_alias": ("", "SELECT p_partkey AS k, p_brand, p_size AS size FROM part", None),
    "where_eq_int": ("", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3", None),
    "where_eq_bigint": ("", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7", None),
    "where_eq_text": ("", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", None),
    "where_eq_double": ("", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 17.0", None),
    "where_eq_timestamp": ("", "SELECT o_orderkey FROM orders WHERE o_orderdate = TIMESTAMP '1995-03-15 00:00:00'", None),
    "where_and_or_paren": ("", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_orderpriority = '1-URGENT'", None),
    "where_not": ("", "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F' AND NOT (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')", None),
    "where_range_ops": ("", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10.0 AND l_quantity < 12.0 AND l_discount != 0.05 AND l_tax <= 0.04", None),
    "where_no_match": ("", "SELECT n_name FROM nation WHERE n_nationkey = 999", None),
    # Joins
    "join_inner": ("", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_on_reversed": ("", "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey", None),
    "join_left": ("", "SELECT d.doc_id AS doc_id, l.quality AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", None),
    "join_right": ("", "SELECT d.doc_id AS doc_id, l.quality AS quality FROM labels l RIGHT OUTER JOIN documents d ON d.doc_id = l.doc_id", None),
    "join_full": (PEOPLE, "SELECT name, title FROM people p FULL JOIN teams t ON p.team = t.team", PEOPLE_SQL + "SELECT name, title FROM people p FULL JOIN teams t ON p.team = t.team"),
    "join_cross": ("", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "join_using": ("", "SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id)", None),
    "join_using_full": (PEOPLE, "SELECT team, name, title FROM people FULL JOIN teams USING (team)", PEOPLE_SQL + "SELECT team, name, title FROM people FULL JOIN teams USING (team)"),
    "join_using_sides": (
        PEOPLE,
        "SELECT team, people.team AS l, teams.team AS r FROM people FULL JOIN teams USING (team)",
        PEOPLE_SQL + "SELECT coalesce(p.team, t.team) AS team, p.team AS l, t.team AS r FROM people p FULL JOIN teams t ON p.team = t.team",
    ),
    "join_natural": ("", "SELECT doc_id, toxic, source FROM labels NATURAL JOIN documents", None),
    "join_natural_left": (PEOPLE, "SELECT team, name, title FROM people NATURAL LEFT JOIN teams", PEOPLE_SQL + "SELECT team, name, title FROM people NATURAL LEFT JOIN teams"),
    "join_natural_no_common": ("", "SELECT r_name, p_brand FROM region NATURAL JOIN part WHERE p_size = 7", "SELECT r_name, p_brand FROM region CROSS JOIN part WHERE p_size = 7"),
    "join_chain3": (
        "",
        "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
        None,
    ),
    "join_self_alias": ("", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 1", None),
    "join_on_lt": ("", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey", None),
    "join_on_compound": (
        "",
        "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND (o.o_orderstatus = 'F' OR NOT l.l_returnflag = 'N')",
        None,
    ),
    "join_where": ("", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'MACHINERY' AND o_orderstatus = 'O'", None),
    # Aggregates
    "agg_count_star": ("", "SELECT COUNT(*) FROM lineitem", "SELECT count(*) AS count FROM lineitem"),
    "agg_count_col": (PEOPLE, "SELECT COUNT(team) FROM people", PEOPLE_SQL + "SELECT count(team) AS count_team FROM people"),
    "agg_sum_int": ("", "SELECT SUM(p_size) FROM part", "SELECT CAST(sum(p_size) AS BIGINT) AS sum_p_size FROM part"),
    "agg_sum_double": ("", "SELECT SUM(l_quantity) AS s FROM lineitem", None),
    "agg_avg": ("", "SELECT AVG(l_quantity) AS a, AVG(l_linenumber) AS b FROM lineitem", None),
    "agg_min_max": ("", "SELECT MIN(o_orderdate) AS a, MAX(o_orderdate) AS b, MIN(o_orderpriority) AS c, MAX(o_totalprice) AS d FROM orders", None),
    "agg_global_empty": (
        "",
        "SELECT COUNT(*) AS n, SUM(p_size) AS s, AVG(p_size) AS a, MIN(p_name) AS m FROM part WHERE p_size = 0",
        "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a, min(p_name) AS m FROM part WHERE p_size = 0",
    ),
    "group_single": ("", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_returnflag", None),
    "group_multi": ("", "SELECT l_returnflag, l_linestatus, MAX(l_extendedprice) AS top, MIN(l_shipdate) AS since FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_null_key": (PEOPLE, "SELECT team, COUNT(*) AS n FROM people GROUP BY team", PEOPLE_SQL + "SELECT team, count(*) AS n FROM people GROUP BY team"),
    "group_no_agg": ("", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "group_empty": ("", "SELECT p_brand, COUNT(*) AS n FROM part WHERE p_size = 0 GROUP BY p_brand", None),
    "having_alias": ("", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n >= 15", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15"),
    "having_agg": ("", "SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 3000000", None),
    "having_group_col": ("", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING n_regionkey != 2", None),
    "join_group_having": (
        "",
        "SELECT c.c_mktsegment, COUNT(*) AS n, AVG(o.o_totalprice) AS a FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment HAVING COUNT(*) > 10",
        None,
    ),
    # Order and limit
    "order_asc": ("", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 20", None),
    "order_desc": ("", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 20", None),
    "order_multi": ("", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 25", None),
    "order_text_desc": ("", "SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 7", None),
    "order_hidden_column": ("", "SELECT p_name FROM part ORDER BY p_partkey DESC LIMIT 5", None),
    "limit": ("", "SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 2", None),
    "limit_zero": ("", "SELECT r_regionkey FROM region LIMIT 0", None),
    "offset_only": ("", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", None),
    "limit_offset": ("", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30", None),
    "topk_join": (
        "",
        "SELECT c.c_name, SUM(o.o_totalprice) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_name ORDER BY total DESC LIMIT 5",
        None,
    ),
    "order_nulls": (
        PEOPLE,
        "SELECT id, team FROM people ORDER BY team DESC, id LIMIT 2",
        PEOPLE_SQL + "SELECT id, team FROM people ORDER BY team DESC NULLS FIRST, id LIMIT 2",
    ),
    "order_nulls_last": (
        PEOPLE,
        "SELECT id, team FROM people ORDER BY team LIMIT 3",
        PEOPLE_SQL + "SELECT id, team FROM people ORDER BY team ASC NULLS LAST LIMIT 3",
    ),
    # Changes, constraints and transactions on managed tables
    "insert_select_back": (PEOPLE, "SELECT id, name, team FROM people", PEOPLE_SQL + "SELECT * FROM people"),
    "insert_omitted_null": (
        "CREATE TABLE t(a INT, b TEXT); INSERT INTO t(b) VALUES ('x'); INSERT INTO t(a) VALUES (2)",
        "SELECT a, b FROM t",
        "SELECT * FROM (VALUES (NULL, 'x'), (2, NULL)) t(a, b)",
    ),
    "update_where": (
        PEOPLE + "UPDATE people SET team = 99, name = 'moved' WHERE team = 10 OR id = 3",
        "SELECT id, name, team FROM people",
        "SELECT * FROM (VALUES (1, 'moved', 99), (2, 'bob', 20), (3, 'moved', 99), (4, 'di', 40)) t(id, name, team)",
    ),
    "delete_where": (PEOPLE + "DELETE FROM people WHERE team > 15", "SELECT id FROM people", "SELECT * FROM (VALUES (1), (3)) t(id)"),
    "drop_recreate": (
        "CREATE TABLE t(a INT); INSERT INTO t(a) VALUES (1); DROP TABLE t; CREATE TABLE t(a TEXT); INSERT INTO t(a) VALUES ('new')",
        "SELECT a FROM t",
        "SELECT 'new' AS a",
    ),
    "txn_commit": (
        "CREATE TABLE t(a INT); BEGIN; INSERT INTO t(a) VALUES (1); UPDATE t SET a = 5 WHERE a = 1; COMMIT",
        "SELECT a FROM t",
        "SELECT 5 AS a",
    ),
    "txn_rollback": (
        "CREATE TABLE t(a INT); INSERT INTO t(a) VALUES (1); BEGIN; DELETE FROM t; INSERT INTO t(a) VALUES (2); ROLLBACK",
        "SELECT a FROM t",
        "SELECT 1 AS a",
    ),
    "not_keeps_null": (
        PEOPLE,
        "SELECT id FROM people WHERE NOT team = 10",
        PEOPLE_SQL + "SELECT id FROM people WHERE team IS DISTINCT FROM 10",
    ),
    "unique_rejected_rollback": (
        "CREATE TABLE t(a INT PRIMARY KEY, b TEXT UNIQUE); INSERT INTO t(a, b) VALUES (1, 'x'); INSERT INTO t(a, b) VALUES (2, 'y'), (3, 'x')",
        "SELECT a, b FROM t",
        "SELECT 1 AS a, 'x' AS b",
    ),
    "pk_composite_rejected": (
        "CREATE TABLE t(a INT PRIMARY KEY, b INT PRIMARY KEY, c TEXT); INSERT INTO t(a, b, c) VALUES (1, 1, 'x'), (1, 2, 'y'); INSERT INTO t(a, b, c) VALUES (2, 1, 'z'), (1, 2, 'w')",
        "SELECT a, b, c FROM t",
        "SELECT * FROM (VALUES (1, 1, 'x'), (1, 2, 'y')) t(a, b, c)",
    ),
    "not_null_rejected": (
        "CREATE TABLE t(a INT NOT NULL, b TEXT); INSERT INTO t(a, b) VALUES (1, 'x'); INSERT INTO t(a, b) VALUES (2, 'y'), (NULL, 'z')",
        "SELECT a, b FROM t",
        "SELECT 1 AS a, 'x' AS b",
    ),
    "txn_error_undone": (
        "CREATE TABLE t(a INT); INSERT INTO t(a) VALUES (1); BEGIN; INSERT INTO t(a) VALUES (2); SELECT missing FROM t",
        "SELECT a FROM t",
        "SELECT 1 AS a",
    ),
    "strict_value_rejected": (
        "CREATE TABLE t(a SMALLINT, b VARCHAR(3)); INSERT INTO t(a, b) VALUES (1, 'abc'); INSERT INTO t(a, b) VALUES (2, 'ok'), (40000, 'no')",
        "SELECT a, b FROM t",
        "SELECT CAST(1 AS SMALLINT) AS a, 'abc' AS b",
    ),
    "agg_avg_decimal": (
        "CREATE TABLE t(k TEXT, d DECIMAL(8, 2)); INSERT INTO t(k, d) VALUES ('a', 1.25), ('a', 2.75), ('b', 10.5), ('b', NULL), ('c', NULL)",
        "SELECT k, AVG(d) AS a FROM t GROUP BY k",
        "SELECT k, avg(CAST(d AS DOUBLE)) AS a FROM (VALUES ('a', 1.25), ('a', 2.75), ('b', 10.5), ('b', NULL), ('c', NULL)) t(k, d) GROUP BY k",
    ),
    "where_time": (
        "CREATE TABLE t(id INT, tm TIME); INSERT INTO t(id, tm) VALUES (1, TIME '08:30:00'), (2, TIME '12:00:00'), (3, TIME '23:59:59'), (4, NULL)",
        "SELECT id FROM t WHERE tm >= TIME '12:00:00'",
        "SELECT id FROM (VALUES (1, TIME '08:30:00'), (2, TIME '12:00:00'), (3, TIME '23:59:59'), (4, NULL)) t(id, tm) WHERE tm >= TIME '12:00:00'",
    ),
    "where_date": (
        "CREATE TABLE t(id INT, d DATE); INSERT INTO t(id, d) VALUES (1, DATE '2024-02-29'), (2, DATE '2024-03-01'), (3, NULL)",
        "SELECT id, d FROM t WHERE NOT d = DATE '2024-03-01'",
        "SELECT id, d FROM (VALUES (1, DATE '2024-02-29'), (2, DATE '2024-03-01'), (3, NULL)) t(id, d) WHERE d IS DISTINCT FROM DATE '2024-03-01'",
    ),
    "where_not_nested": (
        "",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 45.0 OR NOT (l_discount <= 0.02 AND l_returnflag = 'R'))",
        None,
    ),
    "unique_null_repeats": (
        "CREATE TABLE t(a INT UNIQUE, b TEXT); INSERT INTO t(a, b) VALUES (NULL, 'x'), (NULL, 'y'), (1, 'z')",
        "SELECT a, COUNT(*) AS n FROM t GROUP BY a",
        "SELECT * FROM (VALUES (NULL, CAST(2 AS BIGINT)), (1, CAST(1 AS BIGINT))) t(a, n)",
    ),
    "parts_after_many_inserts": (
        "CREATE TABLE t(id INT PRIMARY KEY, g INT);" + "".join(f"INSERT INTO t(id, g) VALUES {', '.join(f'({i}, {i % 7})' for i in range(s, s + 500))};" for s in range(0, 3500, 500)) + "DELETE FROM t WHERE g = 3; UPDATE t SET g = 100 WHERE id = 700",
        "SELECT g, COUNT(*) AS n, MAX(id) AS m FROM t GROUP BY g",
        "SELECT CAST(CASE WHEN i = 700 THEN 100 ELSE i % 7 END AS INTEGER) AS g, count(*) AS n, CAST(max(i) AS INTEGER) AS m FROM range(3500) r(i) WHERE i % 7 <> 3 GROUP BY 1",
    ),
    "types_roundtrip": (
        """CREATE TABLE t(a SMALLINT, b BIGINT, c DOUBLE, d VARCHAR(8), e CHAR(5), f BOOLEAN, g DATE, h TIMESTAMP, i DECIMAL(10, 2), j REAL);
        INSERT INTO t(a, b, c, d, e, f, g, h, i, j) VALUES
        (7, 9000000000, 1.5, 'abc', 'ab', TRUE, DATE '2024-02-29', TIMESTAMP '2024-02-29 12:30:00', 1.125, 0.5)""",
        "SELECT a, b, c, d, e, f, g, h, i, j FROM t WHERE e = 'ab' AND i = 1.12",
        """SELECT CAST(7 AS SMALLINT) AS a, 9000000000 AS b, CAST(1.5 AS DOUBLE) AS c, 'abc' AS d, 'ab   ' AS e, TRUE AS f, DATE '2024-02-29' AS g,
        TIMESTAMP '2024-02-29 12:30:00' AS h, CAST(1.12 AS DECIMAL(10, 2)) AS i, CAST(0.5 AS REAL) AS j""",
    ),
}


#: Ends of the names of scripts whose last statement fails.
FAILING = ("_rejected", "_rejected_rollback", "_undone")


def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that one engine has written to a warehouse folder, read by another."""
    folder = Store(spark, None).new_folder()
    with Engine(spark, folder) as first:
        first.execute(REOPENED + "BEGIN; INSERT INTO t(a, s, d) VALUES (9, 'open', NULL)")
    return Engine(spark, folder).query_df("SELECT a, s, d FROM t")


#: More rows than a tail holds, then some that stay in it.
REOPENED = "CREATE TABLE t(a INT PRIMARY KEY, s TEXT, d DECIMAL(6, 2));" + "".join(
    f"INSERT INTO t(a, s, d) VALUES {', '.join(f'({i}, {chr(39)}s{i}{chr(39)}, {i}.5)' for i in range(start, start + 600))};" for start in (1000, 2000, 3000)
)
REOPENED_SQL = "SELECT CAST(a AS INTEGER) AS a, 's' || a AS s, CAST(a + 0.5 AS DECIMAL(6, 2)) AS d FROM range(1000, 3600) r(a) WHERE a % 1000 < 600"


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    script, select, _ = SPECS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for table in TABLES:
            if f" {table}" in select:
                engine.register_parquet(table, f"{sf_dir}/{table}.parquet")
        try:
            engine.execute(script)
        except (LoomlineError, CodecError):
            # A script whose last statement fails shows that nothing of it, or of its transaction, stays.
            if not name.endswith(FAILING):
                raise
        return engine.query_df(select)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query("flagship")(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in SPECS} | {"warehouse_reopened": _reopened}


def oracle_sql() -> dict[str, str]:
    return {name: sql or select for name, (_, select, sql) in SPECS.items()} | {"warehouse_reopened": REOPENED_SQL}
