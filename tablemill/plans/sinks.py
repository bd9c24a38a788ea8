"""Queries over the file sinks: each writes, reads its own output back, and returns that."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.plans import fixtures
from tablemill.plans.registry import query, table
from tablemill.session import scratch_path
from tablemill.sinks import documents, files
from tablemill.sources.delimited import read_csv
from tablemill.sources.documents import json_at, read_jsonl, yaml_to_json
from tablemill.sources.markup import xml_fields


@query("sink_csv", "SELECT o_orderkey, o_orderpriority, o_totalprice, concat('a \"b\", ', o_orderstatus) AS note FROM orders")
def sink_csv(spark, folder):
    path = scratch_path(spark, "csv")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice",
                                                 F.concat(F.lit('a "b", '), "o_orderstatus").alias("note"))
    files.write_csv(rows, path)
    return read_csv(spark, path, delimiter=",")


@query("sink_parquet", "SELECT * FROM lineitem")
def sink_parquet(spark, folder):
    path = scratch_path(spark, "parquet")
    files.write_parquet(table(spark, folder, "lineitem"), path)
    return spark.read.parquet(path)


@query("sink_jsonl", fixtures.duck(fixtures.DIRTY))
def sink_jsonl(spark, folder):
    path = scratch_path(spark, "jsonl")
    rows = fixtures.derive(spark, folder, fixtures.DIRTY, "customer")
    files.write_jsonl(rows, path, gzip=True)
    return read_jsonl(spark, path, "*.gz", schema=rows.schema)


@query("sink_jsonl_ascii", "SELECT doc_id, lang, text FROM documents")
def sink_jsonl_ascii(spark, folder):
    """Whole texts in four languages with everything outside ASCII escaped."""
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(table(spark, folder, "documents").select("doc_id", "lang", "text"), path, ensure_ascii=True)
    lines = spark.read.text(path).where(~F.col("value").rlike(r"[^\x00-\x7F]"))
    return lines.select(F.from_json("value", "doc_id bigint, lang string, text string").alias("r")).select("r.*")


_ROWS = "array<struct<c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string>>"


@query("json_records", fixtures.duck(fixtures.DIRTY))
def json_records(spark, folder):
    rows = fixtures.derive(spark, folder, fixtures.DIRTY, "customer")
    docs = documents.json_documents(rows, ["c_name"], rows_per_document=400)
    return json_at(docs, "json", _ROWS)


@query("json_columns", fixtures.duck(fixtures.DIRTY))
def json_columns(spark, folder):
    """One list per column and document; the lists are zipped back to rows."""
    rows = fixtures.derive(spark, folder, fixtures.DIRTY, "customer")
    docs = documents.json_documents(rows, ["c_name"], orient="columns", rows_per_document=400)
    shape = ("c_custkey array<bigint>, c_name array<string>, c_nationkey array<int>, c_acctbal array<double>, "
             "c_mktsegment array<string>")
    parsed = docs.select(F.from_json("json", shape).alias("d")).select("d.*")
    return parsed.select(F.inline(F.arrays_zip(*rows.columns)))


@query("sink_xml", """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance FROM (
 SELECT c_custkey, c_name, CASE WHEN c_custkey % 23 <> 0 THEN c_acctbal END AS c_acctbal FROM customer) c""")
def sink_xml(spark, folder):
    from tablemill.sources.markup import read_xml

    path = scratch_path(spark, "xml")
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 23 != 0, F.col("c_acctbal")).alias("balance"))
    files.write_xml(rows, path, root="customers", row="customer", as_attr=True)
    return read_xml(spark, path, row_xpath="customer", fields={c: f"@{c}" for c in rows.columns})


@query("xml_nested", """SELECT CAST(c_custkey AS VARCHAR) AS customer, CAST(part AS VARCHAR) AS part, COALESCE(first_order, '') AS first_order,
 CAST(orders AS VARCHAR) AS orders FROM (SELECT c_custkey, COALESCE(part, 0) AS part, CAST(MIN(o_orderkey) AS VARCHAR) AS first_order,
 COUNT(o_orderkey) AS orders FROM customer LEFT JOIN (SELECT *, (ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS part
 FROM orders) o ON o_custkey = c_custkey GROUP BY c_custkey, COALESCE(part, 0)) g""")
def xml_nested(spark, folder):
    """Customers with their orders as child elements, at most five to a document; facts are read from the XML."""
    parents = table(spark, folder, "customer").select("c_custkey", "c_name")
    children = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("_id"), F.col("o_totalprice").alias("price"))
    nested = documents.nest(parents, children, ["c_custkey"], ["_id"], "order", max_children=5)
    docs = documents.xml_documents(nested, "customer", ["c_custkey"], attributes=["c_custkey", "part"])
    facts = xml_fields(docs, "xml", {"customer": "@c_custkey", "part": "@part", "first_order": "order/@id"}, ["xml"])
    elements = F.size(F.split("xml", "<order ")) - 1
    return facts.select("customer", "part", F.coalesce("first_order", F.lit("")).alias("first_order"),
                        elements.cast("string").alias("orders"))


@query("xml_nested_range", """SELECT s_suppkey AS supplier, COALESCE(n // 5, 0) AS part, CAST(MIN(c_custkey) AS VARCHAR) AS first_customer,
 COUNT(c_custkey) AS customers, COALESCE(CAST(SUM(orders) AS BIGINT), 0) AS orders FROM (SELECT s_suppkey, c_custkey, orders,
 ROW_NUMBER() OVER (PARTITION BY s_suppkey ORDER BY c_custkey) - 1 AS n FROM supplier LEFT JOIN (SELECT c_custkey, c_nationkey, c_acctbal,
 COUNT(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) c
 ON c_nationkey = s_nationkey AND c_acctbal BETWEEN s_acctbal - 900 AND s_acctbal + 100) g GROUP BY s_suppkey, COALESCE(n // 5, 0)""")
def xml_nested_range(spark, folder):
    """Suppliers with the customers of their nation whose balance is near theirs, and these with their orders: two levels, the first by condition."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("_id"), F.col("o_orderkey").alias("_key"), F.col("o_totalprice").alias("price"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("_id"), "c_nationkey", "c_acctbal")
    clients = documents.nest(customers, orders, ["_id"], ["_key"], "order").drop("part")
    suppliers = table(spark, folder, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("c_nationkey"), (F.col("s_acctbal") - 900).alias("low"), (F.col("s_acctbal") + 100).alias("high"))
    nested = documents.nest_between(suppliers, clients, "low", "high", "c_acctbal", ["_id"], "customer", on=["c_nationkey"], max_children=5, as_xml=True)
    docs = documents.xml_documents(nested.drop("low", "high"), "supplier", ["s_suppkey", "part"], attributes=["s_suppkey", "part"], written=["customer"])
    facts = xml_fields(docs, "xml", {"first_customer": "customer/@id", "customers": "count(customer/@id)", "orders": "count(customer/order/@key)"},
                       ["s_suppkey", "part"], shared=True)
    return facts.select(F.col("s_suppkey").alias("supplier"), F.col("part").cast("long").alias("part"), "first_customer", "customers", "orders")


@query("sink_yaml", fixtures.duck(fixtures.DIRTY))
def sink_yaml(spark, folder):
    path = scratch_path(spark, "yaml")
    rows = fixtures.derive(spark, folder, fixtures.DIRTY, "customer")
    documents.write_yaml(rows, path)
    return yaml_to_json(spark.read.text(path, wholetext=True), "value").transform(json_at, "json", _ROWS)


@query("html_rows", r"""SELECT doc_id, concat('<tr><td>', CAST(doc_id AS VARCHAR), '</td><td>', COALESCE(CASE WHEN doc_id % 4 <> 0 THEN
 replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') END, ''),
 '</td></tr>') AS html FROM documents""")
def html_rows(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("text"))
    return files.html_rows(rows, keep=["doc_id"])


@query("sink_split", """SELECT o_orderpriority AS category, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
 FROM orders GROUP BY o_orderpriority""")
def sink_split(spark, folder):
    path = scratch_path(spark, "split")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("category"))
    files.write_split(rows, path, "category")
    back = spark.read.schema("o_orderkey bigint, o_totalprice double, category string").csv(path, header=True)
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("user_export", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def user_export(spark, folder):
    def export(df, params):
        df.where(F.col("o_orderstatus") == params["status"]).select("o_orderkey", "o_totalprice").write.orc(params["output_dir"])
        return params["output_dir"]

    path = files.run_export(export, table(spark, folder, "orders"), {"status": "F", "output_dir": scratch_path(spark, "export")})
    return spark.read.orc(path)
