"""Queries over the readers. Files are written from the given tables first and then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.functions.text import named
from tablemill.operators.headers import dedupe_headers, normalize_headers, pick_by_alias
from tablemill.plans import fixtures
from tablemill.plans.registry import query, table
from tablemill.session import scratch_path
from tablemill.sinks.documents import json_documents, nest, write_documents, yaml_documents
from tablemill.sinks.files import html_header, html_row, write_xml
from tablemill.sources import delimited, documents, markup, tables, workbooks


@query("src_csv", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
 CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS priority FROM orders""")
def src_csv(spark, folder):
    path = scratch_path(spark, "csv")
    table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_orderpriority").alias("priority"),
    ).write.csv(path, sep=";", header=True)
    return delimited.read_csv(spark, path)


@query("src_csv_late_type", """SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT MAX(o_orderkey) FROM orders) THEN 'unknown'
 ELSE CAST(o_custkey AS VARCHAR) END AS customer, CASE WHEN o_orderkey = (SELECT MAX(o_orderkey) FROM orders) THEN 0.5
 ELSE CAST(o_shippriority AS DOUBLE) END AS priority FROM (SELECT *, o_orderkey % 3 AS o_shippriority FROM orders) o""")
def src_csv_late_type(spark, folder):
    """Numbers in every row but the last, which makes one column text and another one fractional."""
    path = scratch_path(spark, "csv")
    orders = table(spark, folder, "orders")
    last = F.col("o_orderkey") == F.lit(orders.agg(F.max("o_orderkey")).head()[0])
    orders.select(
        "o_orderkey", F.when(last, "unknown").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(last, "0.5").otherwise((F.col("o_orderkey") % 3).cast("string")).alias("priority"),
    ).orderBy("o_orderkey").write.csv(path, header=True)
    return delimited.read_csv(spark, path)


@query("src_csv_multiline", """SELECT c_custkey, c_name || chr(10) || '"' || c_mktsegment || '", ' || chr(10) || CAST(c_nationkey AS VARCHAR) AS note,
 c_acctbal FROM customer""")
def src_csv_multiline(spark, folder):
    """Quoted cells with line breaks, quotes and separators inside."""
    path = scratch_path(spark, "csv")
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", \n'), F.col("c_nationkey").cast("string"))
    table(spark, folder, "customer").select("c_custkey", note.alias("note"), "c_acctbal").write.option("escape", '"').csv(path, header=True)
    return delimited.read_csv(spark, path, delimiter=",", multi_line=True)


@query("src_csv_layouts", """SELECT 'orders' AS kind, o_orderkey AS id, o_custkey AS customer, NULL AS name FROM orders
 UNION ALL SELECT 'customers', c_custkey, NULL, c_name FROM customer""")
def src_csv_layouts(spark, folder):
    """Two layouts in one folder, told apart by their headers."""
    path = scratch_path(spark, "csv")
    table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")).write.csv(
        f"{path}/orders", header=True)
    table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")).write.csv(
        f"{path}/customers", header=True)
    rows = delimited.read_csv_layouts(spark, path, recursive=True)
    return rows.select(F.element_at(F.split("_file", "/"), -2).alias("kind"), "id", "customer", "name")


@query("src_json_path", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def src_json_path(spark, folder):
    """Documents of 5,000 keys each; the rows lie two levels down."""
    path = scratch_path(spark, "json")
    row = F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    docs = table(spark, folder, "orders").groupBy(F.floor(F.col("o_orderkey") / 5000).alias("doc_no")).agg(
        F.to_json(F.struct(F.struct(F.collect_list(row).alias("items")).alias("data"))).alias("json"))
    write_documents(docs, path, "json")
    return documents.read_json(
        spark, path, "*.txt", json_path="data.items", recursive=True,
        schema="data struct<items:array<struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>>>")


@query("src_jsonl", "SELECT event_id, event_type, value, props FROM events WHERE event_id % 10 > 2")
def src_jsonl(spark, folder):
    path = scratch_path(spark, "jsonl")
    kind = F.col("event_id") % 10
    line = (F.when(kind == 0, "# a comment").when(kind == 1, '{"event_id": ').when(kind == 2, "")
            .otherwise(F.to_json(F.struct("event_id", "event_type", "value", "props"))))
    table(spark, folder, "events").select(line).write.text(path, compression="gzip")
    return documents.read_jsonl(spark, path, "*.txt.gz", columns=["event_id", "event_type", "value", "props", "absent"])


@query("src_parquet", "SELECT l_orderkey, l_quantity FROM lineitem")
def src_parquet(spark, folder):
    return tables.read_parquet(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_quantity", "absent"])


@query("src_xml", """SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance,
 NULLIF(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END, '') AS segment FROM customer""")
def src_xml(spark, folder):
    path = scratch_path(spark, "xml")
    rows = table(spark, folder, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" "))))
    write_xml(rows, path, root="customers", row="customer")
    return markup.read_xml(spark, path, row_xpath="./customer", fields={
        "custkey": "c_custkey", "name": "c_name/text()", "balance": "./c_acctbal", "segment": "c_mktsegment"})


_XML_PATHS = """SELECT 'open' AS path, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_totalprice AS VARCHAR) AS total FROM orders WHERE o_orderstatus = 'O'
 UNION ALL SELECT 'urgent', CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR) FROM orders
 WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
 UNION ALL SELECT 'first', CAST(MIN(o_orderkey) AS VARCHAR), CAST(ARG_MIN(o_totalprice, o_orderkey) AS VARCHAR) FROM orders
 WHERE o_orderstatus = 'F' GROUP BY o_custkey"""


@query("src_xml_paths", _XML_PATHS)
def src_xml_paths(spark, folder):
    """Orders of the same tag below different elements of their customer, by path, by attribute and by place."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("_id"), F.col("o_orderpriority").alias("_priority"),
        F.col("o_totalprice").alias("total"), "o_orderstatus")
    nested = nest(table(spark, folder, "customer").select("c_custkey"), orders, ["c_custkey"], ["_id"], "orders")

    def those(status):
        kept = F.filter("orders", lambda o: o["o_orderstatus"] == status)
        return F.struct(F.transform(kept, lambda o: F.struct(o["_id"].alias("_id"), o["_priority"].alias("_priority"), o["total"].alias("total"))).alias("order"))

    path = scratch_path(spark, "xml")
    customers = nested.select("c_custkey", those("O").alias("open"), those("F").alias("closed"))
    customers.write.format("xml").option("rootTag", "customers").option("rowTag", "customer").save(path)
    fields, reads = {"id": "@id", "total": "./total/text()"}, {
        "open": "./customer/open/order", "urgent": "customer/closed/order[@priority='1-URGENT']", "first": ".//closed/order[1]"}
    found = [markup.read_xml(spark, path, row_xpath=x, fields=fields).select(F.lit(name).alias("path"), "id", "total") for name, x in reads.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("src_html_table", """SELECT page_id, 0 AS row_no, 'page' AS first_cell, 'address' AS second_cell FROM pages
 UNION ALL SELECT page_id, 1, CAST(page_id AS VARCHAR), url FROM pages""")
def src_html_table(spark, folder):
    """Whole raw pages, each with a table appended; the first table of the page is not the one asked for."""
    header = html_header(["page", "address"])
    pages = table(spark, folder, "pages").select(
        "page_id", F.concat("html", F.lit("<table><tr><td>decoy</td></tr></table><table>" + header),
                            html_row(["page_id", "url"]), F.lit("</table>")).alias("html"))
    cells = markup.html_tables(pages, "html", ["page_id"], table_index=0, match="^address$")
    return cells.select("page_id", "row_no", F.col("cells")[0].alias("first_cell"), F.col("cells")[1].alias("second_cell"))


@query("src_yaml", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def src_yaml(spark, folder):
    path = scratch_path(spark, "yaml")
    rows = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    docs = yaml_documents(json_documents(rows, ["p_partkey"], rows_per_document=1000), wrap="parts")
    write_documents(docs, path, "yaml")
    return documents.yaml_to_json(spark.read.text(path, wholetext=True), "value").transform(
        documents.json_at, "json",
        "array<struct<p_partkey:bigint,p_name:string,p_brand:string,p_size:int,p_retailprice:double>>", "parts")


@query("src_xlsx", """SELECT 'Rows' AS sheet, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
 CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def src_xlsx(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 6 == 0, "nan").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    parsed = workbooks.parse_workbooks(fixtures.workbooks(rows, "c_custkey"), sheets=["Rows"])
    return workbooks.sheet_table(parsed, ["c_custkey", "c_name", "c_mktsegment"], keep=["sheet"])


@query("src_table_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def src_table_query(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("tm_src_orders")
    return tables.read_table(
        spark, sql="SELECT o_orderkey, o_totalprice FROM IDENTIFIER(:source) WHERE o_totalprice > :low AND o_orderstatus = :status",
        params={"source": "tm_src_orders", "low": 250000.0, "status": "F"})


@query("src_headers_dedup", """SELECT c_custkey AS "Cust Key", c_name AS "Cust  Name", c_nationkey AS "Nation-Key.",
 c_acctbal AS "ACCT BAL", c_mktsegment AS "acct bal_1" FROM customer""")
def src_headers_dedup(spark, folder):
    return dedupe_headers(fixtures.headers_messy(spark, folder))


@query("col_alias_regex", "SELECT c_custkey AS customer_key, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def col_alias_regex(spark, folder):
    return pick_by_alias(dedupe_headers(fixtures.headers_messy(spark, folder)), [
        {"alias": ["customer key", "CUST   KEY."], "rename": "customer_key", "required": True},
        {"alias": [{"regex": "nation.*"}], "as": "nation", "required": True},
        {"alias": [{"regex": r"acct bal_\d"}], "as": "segment"},
        {"alias": ["not there"], "optional": True},
    ])


@query("src_user_extract", "SELECT c_nationkey AS nation, COUNT(*) AS customers FROM customer GROUP BY c_nationkey")
def src_user_extract(spark, folder):
    def extract(session):
        customers = table(session, folder, "customer")
        return {"by_nation": customers.groupBy(F.col("c_nationkey").alias("Nation"))
                .agg(F.count(F.lit(1)).alias("Customers ")), "raw": customers}

    return tables.run_extract(spark, extract, {"by_nation": "nations"}, normalize_headers)["nations"]


_SPREAD = "(i * {0} + {0} % 97) % {1}"


@query("src_synthetic", f"""SELECT i AS order_id, customer_id,
 CAST(DATE '2024-01-01' - CAST({_SPREAD.format(71, 181)} AS INTEGER) AS DATE) AS order_date,
 {_SPREAD.format(7919, 49001)} / 100.0 + 10 AS amount,
 (['pending', 'completed', 'cancelled'])[{_SPREAD.format(37, 9949)} % 3 + 1] AS status,
 (['Electronics', 'Clothing', 'Books', 'Home', 'Sports'])[{_SPREAD.format(53, 9941)} % 5 + 1] AS product_category
 FROM (SELECT c_custkey AS customer_id, c_custkey * 3 + k AS i FROM customer, (VALUES (0), (1), (2)) v(k)) s""")
def src_synthetic(spark, folder):
    """Three generated orders for every customer of the table."""
    return tables.synthetic_orders(table(spark, folder, "customer"), "c_custkey")


@query("src_files", "SELECT 'orders.parquet' AS file, COUNT(*) AS rows FROM orders")
def src_files(spark, folder):
    """Discovery by a name in the wrong case, then the rows per file found."""
    from tablemill.sources.files import source_paths, with_file

    paths = source_paths(spark, folder, ["ORDERS.parquet"])
    rows = with_file(spark.read.parquet(*paths).select("o_orderkey", "_metadata"), "_file")
    return rows.groupBy(F.element_at(F.split(named("_file"), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
