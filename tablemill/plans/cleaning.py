"""Queries over the row and column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators import cleaning, headers
from tablemill.operators.chain import apply_chain, chain_deltas
from tablemill.operators.filters import filter_rows
from tablemill.operators.sqlsteps import sql_over
from tablemill.plans import fixtures
from tablemill.plans.registry import query, table


@query("normalize_headers", """SELECT c_custkey AS cust_key, c_name AS cust_name, c_nationkey AS nation_key,
 c_acctbal AS acct_bal, c_mktsegment AS acct_bal_1 FROM customer""")
def normalize_headers(spark, folder):
    return headers.normalize_headers(fixtures.headers_messy(spark, folder))


@query("drop_empty_rows", f"""SELECT * FROM ({fixtures.BLANKS}) b WHERE NOT (c_custkey IS NULL
 AND (c_name IS NULL OR trim(c_name, ' ' || chr(9)) = '') AND (c_mktsegment IS NULL OR trim(c_mktsegment) = ''))""")
def drop_empty_rows(spark, folder):
    return cleaning.drop_empty_rows(fixtures.derive(spark, folder, fixtures.BLANKS, "customer"))


_FILLED = """SELECT o_orderkey, o_orderstatus, {0}(CASE WHEN o_orderpriority NOT IN ('', '-', 'NULL') THEN o_orderpriority END
 IGNORE NULLS) OVER ({1} ORDER BY o_orderkey ROWS BETWEEN {2}) AS o_orderpriority FROM (""" + fixtures.GAPS + ") g"


@query("fill_down", _FILLED.format("last_value", "", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def fill_down(spark, folder):
    """Over the whole table in key order, without a partition key."""
    gaps = fixtures.derive(spark, folder, fixtures.GAPS, "orders")
    return cleaning.fill_gaps(gaps, ["o_orderpriority"], order_by=["o_orderkey"])


@query("fill_up", _FILLED.format("first_value", "PARTITION BY o_orderstatus", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def fill_up(spark, folder):
    gaps = fixtures.derive(spark, folder, fixtures.GAPS, "orders")
    return cleaning.fill_gaps(gaps, ["o_orderpriority"], order_by=["o_orderkey"], partition_by=["o_orderstatus"],
                              direction="up")


@query("type_cast", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
 CAST(o_custkey AS INTEGER) AS customer, CASE WHEN o_orderkey % 2 = 0 THEN TRUE END AS flag FROM orders""")
def type_cast(spark, folder):
    texts = fixtures.derive(spark, folder, fixtures.STRINGS, "orders")
    return cleaning.type_cast(texts, {"price": "float", "customer": "int32", "flag": "bool", "absent": "int",
                                      "o_orderkey": "no such type"})


@query("add_constants", "SELECT s_suppkey, 'IN' AS s_name, s_nationkey, s_acctbal, 7 AS batch, TRUE AS live FROM supplier")
def add_constants(spark, folder):
    return cleaning.add_constants(table(spark, folder, "supplier"), {"s_name": "IN", "batch": 7, "live": True})


@query("require_columns", """SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment FROM customer""")
def require_columns(spark, folder):
    messy = headers.dedupe_headers(fixtures.headers_messy(spark, folder))
    return headers.require_columns(
        messy, {"customer key|cust key": "customer_id", "CUST NAME": "name"},
        optional={"acct bal_1": "segment", "missing": "gone"})


@query("require_columns_empty", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand FROM part")
def require_columns_empty(spark, folder):
    """Two tables under one rule; the customers lack a column, so they give no rows instead of an error."""
    needs = {"c_custkey|p_partkey": "id", "p_brand": "brand"}
    found = [headers.require_columns(table(spark, folder, name), needs, mode="empty") for name in ("customer", "part")]
    return found[0].unionByName(found[1].withColumn("id", F.col("id").cast("string")))


@query("filter_simple", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filter_simple(spark, folder):
    return filter_rows(table(spark, folder, "orders"),
                       {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "absent": 1})


@query("filter_compare", """SELECT * FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 40 AND l_discount >= 0.03
 AND l_tax < 0.07 AND l_returnflag <> 'N' AND l_linestatus = 'F'""")
def filter_compare(spark, folder):
    tests = [("l_quantity", ">", 10), ("l_quantity", "<=", 40), ("l_discount", ">=", 0.03), ("l_tax", "<", 0.07),
             ("l_returnflag", "!=", "N"), ("l_linestatus", "=", "F")]
    return filter_rows(table(spark, folder, "lineitem"), [{"column": c, "operator": o, "value": v} for c, o, v in tests])


@query("filter_string_ops", """SELECT * FROM part WHERE regexp_matches(p_name, 'e[dl]') AND starts_with(p_brand, 'Brand#')
 AND (ends_with(p_name, 'widget') OR regexp_matches(CAST(p_size AS VARCHAR), '^[1-3]'))""")
def filter_string_ops(spark, folder):
    return filter_rows(table(spark, folder, "part"), [
        {"column": "p_name", "operator": "contains", "value": "e[dl]"},
        {"column": "p_brand", "operator": "starts_with", "value": "Brand#"},
        {"type": "or", "conditions": [{"column": "p_name", "operator": "ends_with", "value": "widget"},
                                      {"column": "p_size", "operator": "regex", "value": "^[1-3]"}]},
    ])


@query("filter_in", f"""SELECT * FROM ({fixtures.duck(fixtures.DIRTY)}) d WHERE c_nationkey IN (1, 2, 3, 5, 8, 13)
 AND c_mktsegment NOT IN ('UNKNOWN') AND c_custkey NOT IN (1, 2)""")
def filter_in(spark, folder):
    return filter_rows(fixtures.derive(spark, folder, fixtures.DIRTY, "customer"), [
        {"column": "c_nationkey", "operator": "in", "value": [1, 2, 3, 5, 8, 13]},
        {"column": "c_mktsegment", "operator": "not_in", "value": "UNKNOWN"},
        {"column": "c_custkey", "operator": "not_in", "value": [1, 2]},
    ])


@query("filter_column_compare", "SELECT * FROM lineitem WHERE l_discount < l_tax AND l_suppkey <> l_partkey")
def filter_column_compare(spark, folder):
    return filter_rows(table(spark, folder, "lineitem"), [
        {"type": "column_compare", "left": "l_discount", "operator": "<", "right": "l_tax"},
        {"type": "column_compare", "left": "l_suppkey", "operator": "!=", "right": "l_partkey"},
    ])


@query("filter_nested", """SELECT * FROM orders WHERE (o_orderstatus = 'P' AND o_totalprice > 200000)
 OR NOT (o_orderpriority = '5-LOW')""")
def filter_nested(spark, folder):
    return filter_rows(table(spark, folder, "orders"), [
        {"type": "and", "conditions": [{"column": "o_orderstatus", "value": "P"},
                                       {"column": "o_totalprice", "operator": ">", "value": 200000}]},
        {"type": "not", "conditions": [{"column": "o_orderpriority", "value": "5-LOW"}]},
    ], operator="or")


@query("filter_regex", "SELECT doc_id, lang, source, n_chars FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{2}')")
def filter_regex(spark, folder):
    """Over whole document texts."""
    return filter_rows(table(spark, folder, "documents"), [
        {"type": "regex", "column": "text", "pattern": "[0-9]{3}-[0-9]{2}"}]).drop("text")


@query("filter_expression", "SELECT * FROM customer WHERE length(c_name) > 5 AND c_mktsegment <> 'BUILDING' AND c_acctbal > 0")
def filter_expression(spark, folder):
    return filter_rows(table(spark, folder, "customer"), [
        {"type": "expression", "eval": "length(c_name) > 5 AND c_mktsegment != 'BUILDING'"},
        {"column": "c_acctbal", "operator": ">", "value": 0},
    ])


@query("select_columns", "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem")
def select_columns(spark, folder):
    return headers.select_columns(table(spark, folder, "lineitem"), ["l_*key", "^l_ship", "l_quantity"], ["l_supp*"])


@query("rename_columns", "SELECT n_nationkey AS nation, n_name AS name, n_regionkey FROM nation")
def rename_columns(spark, folder):
    return headers.rename_columns(table(spark, folder, "nation"), {"n_nationkey": "nation", "n_name": "name"})


@query("dynamic_select", "SELECT o_orderkey, o_orderstatus AS configuration FROM orders")
def dynamic_select(spark, folder):
    wide = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("configuration_a"),
        F.col("o_orderstatus").alias("configuration_b"), F.col("o_custkey").cast("string").alias("configuration_c"))
    return headers.dynamic_select(
        wide, pattern="configuration_*", output_name="configuration", order_by=["o_orderdate", "o_orderkey"],
        match_row={"configuration_b": "F"}, condition={"operator": "==", "value": "F"}, keep_columns=["o_orderkey"])


@query("sql_over_input", """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000)
 SELECT o_orderstatus AS status, COUNT(*) AS n FROM big GROUP BY o_orderstatus""")
def sql_over_input(spark, folder):
    return sql_over(table(spark, folder, "orders"), """WITH big AS (SELECT * FROM input WHERE o_totalprice > :low)
        SELECT o_orderstatus AS status, COUNT(*) AS n FROM big GROUP BY o_orderstatus;""", params={"low": 100000.0})


_CHAIN = [
    "normalize_headers",
    "drop_empty_rows",
    {"name": "type_cast", "type_cast": {"c_acctbal": "float32", "c_nationkey": "str"}},
    {"name": "filter", "rows": {"conditions": [{"column": "c_mktsegment", "operator": "!=", "value": "UNKNOWN"}]},
     "columns": {"exclude": ["c_name"], "rename": {"c_nationkey": "nation"}}},
    {"name": "add_constants", "add_constants": {"direction": "IN"}},
]


@query("processor_chain", f"""SELECT CAST(c_acctbal AS FLOAT) AS c_acctbal, c_custkey, c_mktsegment,
 CAST(c_nationkey AS VARCHAR) AS nation, 'IN' AS direction FROM ({fixtures.duck(fixtures.DIRTY)}) d
 WHERE c_mktsegment <> 'UNKNOWN'""")
def processor_chain(spark, folder):
    return apply_chain(fixtures.derive(spark, folder, fixtures.DIRTY, "customer"), _CHAIN)


_DELTA = """SELECT {0} AS step, '{1}' AS processor, {2} AS rows_before, {3} AS rows_after, {2} - {3} AS rows_removed,
 {4} AS columns_before, {5} AS columns_after FROM counts"""


@query("row_deltas", f"""WITH rows_in AS ({fixtures.duck(fixtures.DIRTY)}),
 counts AS (SELECT COUNT(*) AS a, COUNT(*) FILTER (WHERE c_mktsegment <> 'UNKNOWN') AS b FROM rows_in)
 {_DELTA.format(1, 'normalize_headers', 'a', 'a', 5, 5)} UNION ALL {_DELTA.format(2, 'drop_empty_rows', 'a', 'a', 5, 5)}
 UNION ALL {_DELTA.format(3, 'type_cast', 'a', 'a', 5, 5)} UNION ALL {_DELTA.format(4, 'filter', 'a', 'b', 5, 4)}
 UNION ALL {_DELTA.format(5, 'add_constants', 'b', 'b', 4, 5)}""")
def row_deltas(spark, folder):
    return chain_deltas(fixtures.derive(spark, folder, fixtures.DIRTY, "customer"), _CHAIN)


@query("null_tokens", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS VARCHAR) END AS price,
 CAST(o_custkey AS VARCHAR) AS customer, CASE WHEN o_orderkey % 2 = 0 THEN 'true' END AS flag FROM orders""")
def null_tokens(spark, folder):
    return cleaning.null_tokens(fixtures.derive(spark, folder, fixtures.STRINGS, "orders"), ["n/a", "maybe"])
