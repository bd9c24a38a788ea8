"""Inputs derived from the given tables, each as a DataFrame and as the same SQL text."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.plans.registry import table

# What an order brings in: open orders are booked at a tenth less, orders below 1,000 are left out.
NET = "CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 0.9 END"
SETTLED = (
    f"SELECT o_orderkey AS order_id, split_part(o_orderpriority, '-', 2) AS urgency, {NET} AS net_price, o_orderdate AS placed "
    "FROM orders WHERE o_totalprice >= 1000"
)
TURNOVER = f"SELECT urgency, COUNT(*) AS orders_n, SUM(net_price) AS turnover, AVG(net_price) AS mean_price FROM ({SETTLED}) b GROUP BY urgency"


def settled(orders: DataFrame) -> DataFrame:
    net = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.col("o_totalprice") * 0.9)
    return orders.where("o_totalprice >= 1000").select(
        F.col("o_orderkey").alias("order_id"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("urgency"),
        net.alias("net_price"), F.col("o_orderdate").alias("placed"),
    )


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return settled(table(spark, folder, "orders"))


def turnover(rows: DataFrame) -> DataFrame:
    return rows.groupBy("urgency").agg(
        F.count(F.lit(1)).alias("orders_n"), F.sum("net_price").alias("turnover"), F.avg("net_price").alias("mean_price"))


MESSY_NAMES = ("Cust Key", "Cust  Name", "Nation-Key.", "ACCT BAL", "acct bal")


def headers_messy(spark: SparkSession, folder: str) -> DataFrame:
    """Headers as people type them; the last two differ in case only."""
    return table(spark, folder, "customer").toDF(*MESSY_NAMES)


GAPS = """SELECT o_orderkey, o_orderstatus, CASE o_orderkey % 5 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN '-'
 WHEN 4 THEN 'NULL' ELSE o_orderpriority END AS o_orderpriority FROM orders"""
BLANKS = r"""SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS c_custkey,
 CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE chr(9) || ' ' END AS c_name,
 CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN '' END AS c_mktsegment FROM customer"""
STRINGS = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS {text}) END AS price,
 CAST(o_custkey AS {text}) AS customer, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'maybe' END AS flag FROM orders"""
DIRTY = """SELECT CASE WHEN c_custkey % 13 <> 0 THEN c_custkey END AS c_custkey,
 CASE WHEN c_custkey % 17 = 0 THEN concat('Dup#', CAST(c_custkey % 34 AS {text})) ELSE c_name END AS c_name, c_nationkey,
 CASE WHEN c_custkey % 23 <> 0 THEN c_acctbal END AS c_acctbal,
 CASE WHEN c_custkey % 19 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS c_mktsegment FROM customer"""
TARGET = "SELECT * FROM customer WHERE c_nationkey < 17"
BATCH = """SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment, 1 AS seq
 FROM customer WHERE c_nationkey >= 8 UNION ALL
 SELECT c_custkey, c_name, c_nationkey, c_acctbal + 2, c_mktsegment, 2
 FROM customer WHERE c_nationkey >= 8 AND c_mktsegment = 'BUILDING'"""
BATCH_LAST = f"""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY seq DESC) AS rn FROM ({BATCH}) b) r WHERE rn = 1"""
STATEMENTS = """SELECT o_orderkey, CASE o_orderkey % 6
 WHEN 0 THEN concat('SELECT * FROM sales.orders_', o_orderpriority_no, ' o join customer c ON o.k = c.k')
 WHEN 1 THEN concat('CREATE OR REPLACE TABLE staging.t_', o_orderpriority_no, ' AS SELECT a FROM landing.raw -- from here')
 WHEN 2 THEN concat('/* FROM hidden */ SELECT 1 FROM x_', o_orderpriority_no, ' WHERE (a = 1')
 WHEN 3 THEN concat('SELECT ''open FROM y WHERE b = ', o_orderpriority_no)
 WHEN 4 THEN '   ' ELSE concat('hello world ', o_orderpriority_no) END AS statement
 FROM (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS o_orderpriority_no FROM orders) o"""
LOG_LINES = """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('plain ', event_type, ' line')
 ELSE concat('{"level": "', CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'Warning' WHEN 'view' THEN 'DEBUG'
 WHEN 'signup' THEN 'SUCCESS' ELSE 'odd' END, '", "message": "user ', CAST(user_id AS {text}), '", "timestamp": "t',
 CAST(event_id AS {text}), '"}') END AS line FROM events"""
MODEL_LINES = """SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN concat('Compiling model landing.', p_name)
 ELSE concat(CAST(p_size AS {text}), ' of 50 ', CASE WHEN p_partkey % 5 = 3 THEN 'ERROR creating' ELSE 'OK created' END,
 ' sql ', CASE WHEN p_partkey % 2 = 0 THEN 'table' ELSE 'view' END, ' model landing.part_', CAST(p_partkey AS {text}),
 ' .... [OK] in ', CAST(p_size AS {text}), '.25s') END AS line FROM part"""


def derive(spark: SparkSession, folder: str, sql: str, *names: str) -> DataFrame:
    """Run fixture SQL in Spark over the named tables, without leaving views behind."""
    text = sql.replace("{text}", "STRING").replace("{", "{{").replace("}", "}}")
    for name in names:
        text = re.sub(rf"\bFROM {name}\b", f"FROM {{{name}}}", text)
    return spark.sql(text, **{name: table(spark, folder, name) for name in names})


def duck(sql: str) -> str:
    """The same fixture SQL for the oracle."""
    return sql.replace("{text}", "VARCHAR")


def workbook_bytes(rows: list[list[object]], sheet: str) -> bytes:
    """A minimal .xlsx file: one sheet with inline strings."""
    lines = []
    for number, row in enumerate(rows, start=1):
        cells = "".join(
            f'<c r="{chr(65 + i)}{number}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
            for i, v in enumerate(row) if v is not None
        )
        lines.append(f'<row r="{number}">{cells}</row>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
                                         f'<sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels",
                      '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml",
                      f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(df: DataFrame, key: str, rows_per_book: int = 500) -> DataFrame:
    """The table as workbooks of at most ``rows_per_book`` rows; ``key`` must be a unique whole number."""
    columns = df.columns

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["__book"].iloc[0])
        rows = [columns, *pdf[columns].sort_values(key).values.tolist()]
        return pd.DataFrame({"path": [f"book-{number}.xlsx"], "content": [workbook_bytes(rows, "Rows")]})

    numbered = df.select(*[F.col(c).cast("string") if c != key else F.col(c) for c in columns],
                         F.floor(F.col(key) / rows_per_book).alias("__book"))
    return numbered.groupBy("__book").applyInPandas(build, "path string, content binary")
