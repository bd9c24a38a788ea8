"""Queries over profiles, lineage, SQL texts and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators import lineage, mining, profile
from tablemill.plans import fixtures
from tablemill.plans.quality import dirty
from tablemill.plans.registry import query, table

TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query("table_stats", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, COUNT(*) AS rows, {width} AS columns FROM {name}" for name, width in TABLES.items()))
def table_stats(spark, folder):
    return profile.table_stats({name: table(spark, folder, name) for name in TABLES})


_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query("column_nulls", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, COUNT(*) - COUNT({c}) AS nulls, COUNT(*) AS rows, COUNT({c}) < COUNT(*) AS has_nulls "
    f"FROM ({fixtures.duck(fixtures.DIRTY)}) d" for c, t in _TYPES.items()))
def column_nulls(spark, folder):
    return profile.column_nulls(dirty(spark, folder))


@query("first_rows", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 3")
def first_rows(spark, folder):
    """The sample shown beside a profile; three rows are the feature."""
    return profile.first_rows(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])


def records(spark, folder):
    """Lineage records down to single keys: orders come from customers, they and suppliers from nations, those from regions."""
    def of(name, column, up_name, up_column, kind):
        up = F.array(F.struct(F.lit(up_name).alias("dataset"), F.col(up_column).cast("string").alias("column")))
        return table(spark, folder, name).select(F.lit(name).alias("dataset"), F.col(column).cast("string").alias("column"),
                                                 F.lit(kind).alias("transformation"), up.alias("upstream"))

    return (of("orders", "o_orderkey", "customer", "o_custkey", "join")
            .unionByName(of("customer", "c_custkey", "nation", "c_nationkey", "rename"))
            .unionByName(of("supplier", "s_suppkey", "nation", "s_nationkey", "select"))
            .unionByName(of("nation", "n_nationkey", "region", "n_regionkey", "compute")))


_EDGES = " UNION ALL ".join(
    f"SELECT concat('{up}.', CAST({up_column} AS VARCHAR)) AS source, concat('{name}.', CAST({column} AS VARCHAR)) AS target, '{kind}' AS type FROM {name}"
    for name, column, up, up_column, kind in (
        ("orders", "o_orderkey", "customer", "o_custkey", "join"), ("customer", "c_custkey", "nation", "c_nationkey", "rename"),
        ("supplier", "s_suppkey", "nation", "s_nationkey", "select"), ("nation", "n_nationkey", "region", "n_regionkey", "compute")))


@query("lineage_edges", _EDGES)
def lineage_edges(spark, folder):
    return lineage.edges(records(spark, folder))


@query("lineage_nodes", """SELECT DISTINCT target AS id, 'column' AS type, split_part(target, '.', 2) AS label, split_part(target, '.', 1) AS dataset,
 kind AS transformation FROM (SELECT target, type AS kind FROM (""" + _EDGES + """) e) n UNION ALL
 SELECT d, 'dataset', d, d, NULL FROM (VALUES ('orders'), ('customer'), ('supplier'), ('nation')) v(d)""")
def lineage_nodes(spark, folder):
    return lineage.nodes(records(spark, folder))


@query("lineage_upstream", f"""WITH RECURSIVE e AS ({_EDGES}), up AS (SELECT target AS node, source AS ancestor, 1 AS depth FROM e
 UNION ALL SELECT up.node, e.source, up.depth + 1 FROM up JOIN e ON e.target = up.ancestor)
 SELECT node, ancestor, MIN(depth) AS depth FROM up
 WHERE node IN (SELECT concat('orders.', CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_totalprice > 300000) GROUP BY node, ancestor""")
def lineage_upstream(spark, folder):
    starts = table(spark, folder, "orders").where("o_totalprice > 300000").select(
        F.concat(F.lit("orders."), F.col("o_orderkey").cast("string")).alias("node"))
    return lineage.upstream(lineage.edges(records(spark, folder)), starts)


@query("lineage_downstream", f"""SELECT source AS node, target AS dependant FROM ({_EDGES}) e
 WHERE source IN (SELECT concat('customer.', CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_acctbal > 5000)""")
def lineage_downstream(spark, folder):
    starts = table(spark, folder, "customer").where("c_acctbal > 5000").select(
        F.concat(F.lit("customer."), F.col("c_custkey").cast("string")).alias("node"))
    return lineage.downstream(lineage.edges(records(spark, folder)), starts)


_STATEMENTS = fixtures.STATEMENTS
_NAME = r"([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)?)\b"


def statements(spark, folder):
    return fixtures.derive(spark, folder, _STATEMENTS, "orders")


@query("sql_tables_referenced", rf"""SELECT DISTINCT o_orderkey, UNNEST(regexp_extract_all(statement, '(?i)\b(?:FROM|JOIN)\s+{_NAME}', 1)) AS table_name
 FROM ({_STATEMENTS}) s""")
def sql_tables_referenced(spark, folder):
    return mining.tables_referenced(statements(spark, folder), "statement", "o_orderkey")


@query("sql_tables_created", rf"""SELECT DISTINCT o_orderkey, UNNEST(regexp_extract_all(statement,
 '(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}', 1)) AS table_name FROM ({_STATEMENTS}) s""")
def sql_tables_created(spark, folder):
    return mining.tables_created(statements(spark, folder), "statement", "o_orderkey")


@query("sql_lint", f"""SELECT o_orderkey, statement, CASE WHEN trim(statement) = '' THEN 'empty'
 WHEN NOT regexp_matches(upper(statement), 'SELECT|CREATE|INSERT|UPDATE|DELETE|ALTER|DROP|WITH') THEN 'no keyword'
 WHEN length(replace(statement, '(', '')) <> length(replace(statement, ')', '')) THEN 'unbalanced parentheses'
 WHEN (length(statement) - length(replace(statement, '''', ''))) % 2 <> 0 THEN 'unterminated string' END AS problem FROM ({_STATEMENTS}) s""")
def sql_lint(spark, folder):
    return mining.lint(statements(spark, folder), "statement")


@query("sql_strip_comments", rf"""SELECT o_orderkey, regexp_replace(regexp_replace(statement, '/\*[\s\S]*?\*/', '', 'g'), '--[^\n]*', '', 'g') AS bare
 FROM ({_STATEMENTS}) s""")
def sql_strip_comments(spark, folder):
    return mining.strip_comments(statements(spark, folder), "statement", "bare").drop("statement")


@query("parse_log_lines", f"""SELECT event_id, line, CASE WHEN event_id % 4 = 0 THEN 'info' WHEN event_type = 'error' THEN 'error'
 WHEN event_type = 'click' THEN 'warning' WHEN event_type = 'signup' THEN 'success' ELSE 'info' END AS type,
 CASE WHEN event_id % 4 = 0 THEN line ELSE concat('user ', CAST(user_id AS VARCHAR)) END AS message,
 CASE WHEN event_id % 4 <> 0 THEN concat('t', CAST(event_id AS VARCHAR)) END AS timestamp, CAST(NULL AS VARCHAR) AS metadata
 FROM ({fixtures.duck(fixtures.LOG_LINES)}) l JOIN events USING (event_id)""")
def parse_log_lines(spark, folder):
    return mining.parse_logs(fixtures.derive(spark, folder, fixtures.LOG_LINES, "events"), "line")


@query("parse_model_log", """SELECT p_partkey, concat('part_', CAST(p_partkey AS VARCHAR)) AS model_name,
 concat('landing.part_', CAST(p_partkey AS VARCHAR)) AS full_path, CASE WHEN p_partkey % 5 = 3 THEN 'error' ELSE 'ok' END AS status,
 'sql' AS model_type, CASE WHEN p_partkey % 2 = 0 THEN 'table' ELSE 'view' END AS object_type, CAST(p_size + 0.25 AS DOUBLE) AS seconds
 FROM part WHERE p_partkey % 5 <> 4""")
def parse_model_log(spark, folder):
    """Lines of other kinds are left out; every part gives one line."""
    lines = fixtures.derive(spark, folder, fixtures.MODEL_LINES, "part")
    return mining.model_runs(lines, "line").drop("line")
