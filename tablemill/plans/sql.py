"""Queries over the SQL surface: staging, steps, joins, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.functions.casting import parse_date
from tablemill.functions.text import snake_case
from tablemill.operators import sqlsteps
from tablemill.operators.membership import not_in
from tablemill.plans import fixtures
from tablemill.plans.registry import query, table

# How large an order is, by its net price.
SIZES = ((400_000, "bulk"), (200_000, "large"), (80_000, "usual"))
SIZES_SQL = f"""SELECT placed, order_id, CASE {' '.join(f"WHEN net_price >= {low} THEN '{name}'" for low, name in SIZES)} ELSE 'small' END
 AS order_size, urgency, net_price FROM {{source}} WHERE urgency IS NOT NULL"""


def _with_clean(sql: str) -> str:
    return f"WITH settled_orders AS ({fixtures.SETTLED}) {sql}"


@query("stage_tables", """SELECT c_mktsegment AS segment, COUNT(*) AS customers, COUNT(DISTINCT n_regionkey) AS regions
 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment""")
def stage_tables(spark, folder):
    sqlsteps.stage_tables(
        {"customer": table(spark, folder, "customer"), "2024 nation-list": table(spark, folder, "nation")},
        schema="landing", table_mapping={"customer": "clients"})
    return spark.sql("""SELECT c_mktsegment AS segment, COUNT(*) AS customers, COUNT(DISTINCT n_regionkey) AS regions
        FROM landing_clients JOIN landing_t_2024_nation_list ON c_nationkey = n_nationkey GROUP BY c_mktsegment""")


_SCRIPT = f"""
-- what orders bring in; open ones are booked at a tenth less
CREATE OR REPLACE TABLE tm_settled AS {fixtures.SETTLED.replace("FROM orders", "FROM tm_orders")};
/* by urgency; the dearest first */
CREATE OR REPLACE TABLE tm_turnover AS
SELECT urgency, ROUND(SUM(net_price), 4) AS turnover, COUNT(*) AS orders_n, ROUND(AVG(net_price), 4) AS mean_price
 FROM tm_settled GROUP BY urgency;
"""


def _script(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("tm_orders")
    return sqlsteps.run_script(spark, _SCRIPT)


@query("sql_clean_data", fixtures.SETTLED)
def sql_clean_data(spark, folder):
    return _script(spark, folder)["tm_settled"]


@query("sql_category_summary", f"""SELECT urgency, orders_n, ROUND(mean_price, 4) AS mean_price,
 ROUND(turnover, 4) AS turnover FROM ({fixtures.TURNOVER}) s""")
def sql_category_summary(spark, folder):
    return _script(spark, folder)["tm_turnover"]


# Per urgency, the orders above its mean price: on how many days, how many, how far apart, from where to where.
_ABOVE_MEAN = """SELECT t.urgency, t.orders_n, COUNT(DISTINCT o.placed) AS days_above, COUNT(o.order_id) AS orders_above,
 ROUND(STDDEV(o.net_price), 4) AS spread_above, MIN(o.net_price) AS least_above, MAX(o.net_price) AS most_above
 FROM {summary} t LEFT JOIN {rows} o ON t.urgency = o.urgency AND o.net_price > t.mean_price GROUP BY t.urgency, t.orders_n"""


@query("sql_steps", _with_clean(f"""SELECT order_size, MAX(net_price) AS largest, COUNT(*) AS orders
 FROM ({SIZES_SQL.format(source='settled_orders')}) t GROUP BY order_size"""))
def sql_steps(spark, folder):
    fixtures.clean(spark, folder).createOrReplaceTempView("settled_orders")
    made = sqlsteps.run_steps(spark, [
        {"name": "sizes", "sql": f"CREATE OR REPLACE TABLE tm_sizes AS {SIZES_SQL.format(source='settled_orders')}",
         "tables_created": ["tm_sizes"], "depends_on": ["settled_orders"], "tags": ["sizes"]},
        {"name": "report", "sql": """CREATE TABLE tm_report AS SELECT order_size, MAX(net_price) AS largest,
            COUNT(*) AS orders FROM tm_sizes GROUP BY order_size""", "tables_created": ["tm_report"], "depends_on": ["tm_sizes"]},
    ])
    return made["tm_report"]


@query("value_tiers", _with_clean(SIZES_SQL.format(source="settled_orders")))
def value_tiers(spark, folder):
    size = F.lit("small")
    for low, name in reversed(SIZES):
        size = F.when(F.col("net_price") >= low, name).otherwise(size)
    return fixtures.clean(spark, folder).where("urgency is not null").withColumn("order_size", size)


@query("category_metrics", f"""SELECT urgency, COUNT(*) AS total_records, ROUND(AVG(net_price), 4) AS avg_adjusted_value,
 MIN(net_price) AS min_value, MAX(net_price) AS max_value, ROUND(SUM(net_price), 4) AS turnover
 FROM ({fixtures.SETTLED}) c GROUP BY urgency ORDER BY turnover DESC""")
def category_metrics(spark, folder):
    value = F.col("net_price")
    return fixtures.clean(spark, folder).groupBy("urgency").agg(
        F.count(F.lit(1)).alias("total_records"), F.round(F.avg(value), 4).alias("avg_adjusted_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.round(F.sum(value), 4).alias("turnover"),
    ).orderBy(F.desc("turnover"))


@query("category_metrics_detailed", _ABOVE_MEAN.format(summary=f"({fixtures.TURNOVER})", rows=f"({fixtures.SETTLED})"))
def category_metrics_detailed(spark, folder):
    """The few rows of the summary meet every order; what is above the mean is aggregated map-side."""
    rows = fixtures.clean(spark, folder)
    summary = fixtures.turnover(rows).select("urgency", "orders_n", "mean_price")
    price = F.col("net_price")
    above = rows.join(summary, "urgency").where(price > F.col("mean_price")).groupBy("urgency").agg(
        F.count_distinct("placed").alias("days_above"), F.count("order_id").alias("orders_above"),
        F.round(F.stddev_samp(price), 4).alias("spread_above"), F.min(price).alias("least_above"), F.max(price).alias("most_above"))
    none = F.lit(0).cast("long")
    return summary.join(above, "urgency", "left").select(
        "urgency", "orders_n", F.coalesce("days_above", none).alias("days_above"), F.coalesce("orders_above", none).alias("orders_above"),
        "spread_above", "least_above", "most_above")


@query("having_model", f"""SELECT c_mktsegment AS column_a, c_nationkey AS column_b, COUNT(*) AS record_count,
 MAX(c_acctbal) AS max_value, MIN(c_acctbal) AS min_value FROM ({fixtures.duck(fixtures.DIRTY)}) d
 WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY c_mktsegment, c_nationkey HAVING COUNT(*) > 3""")
def having_model(spark, folder):
    rows = fixtures.derive(spark, folder, fixtures.DIRTY, "customer")
    return (
        rows.where("c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL")
        .groupBy(F.col("c_mktsegment").alias("column_a"), F.col("c_nationkey").alias("column_b"))
        .agg(F.count(F.lit(1)).alias("record_count"), F.max("c_acctbal").alias("max_value"), F.min("c_acctbal").alias("min_value"))
        .where("record_count > 3")
    )


@query("sql_params", """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
 AND o_totalprice >= 150000 AND o_orderstatus = 'O'""")
def sql_params(spark, folder):
    """Values, identifiers and lists are bound, never pasted."""
    table(spark, folder, "orders").createOrReplaceTempView("tm_param_orders")
    return spark.sql(
        """SELECT o_orderkey, IDENTIFIER(:key), o_orderpriority FROM IDENTIFIER(:source)
           WHERE array_contains(:urgent, o_orderpriority) AND o_totalprice >= :low AND o_orderstatus = :status""",
        args={"key": "o_custkey", "source": "tm_param_orders", "urgent": F.array(F.lit("1-URGENT"), F.lit("2-HIGH")),
              "low": 150000.0, "status": "O"})


@query("snake_case", r"""SELECT p_partkey, translate(lower(regexp_replace(regexp_replace(raw, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'),
 '([a-z\d])([A-Z])', '\1_\2', 'g')), '- ', '__') AS name FROM (SELECT p_partkey,
 concat('part', p_type, 'ID-', upper(substr(p_name, 1, 1)), substr(p_name, 2)) AS raw FROM part) p""")
def snake_case_names(spark, folder):
    raw = F.concat(F.lit("part"), "p_type", F.lit("ID-"), F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)"))
    return table(spark, folder, "part").select("p_partkey", snake_case(raw).alias("name"))


@query("user_transform", """SELECT c_custkey, CASE WHEN total_spent > 1500000 THEN 'gold' ELSE 'other' END AS tier FROM customer
 LEFT JOIN (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS total_spent FROM orders GROUP BY o_custkey) o
 ON c_custkey = o_custkey""")
def user_transform(spark, folder):
    def transform(customers_df, orders_df):
        spent = orders_df.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total_spent"))
        joined = customers_df.join(spent, F.col("C_Custkey") == F.col("o_custkey"), "left")
        gold = F.when(F.col("total_spent") > 1500000, "gold").otherwise("other")
        return {"tiers": joined.select(F.col("c_custkey").alias("C Custkey"), gold.alias("Tier"))}

    made = sqlsteps.run_transform(
        transform, {"customers_df": table(spark, folder, "customer"), "orders_df": table(spark, folder, "orders")},
        processors=lambda df: df.toDF("c_custkey", "tier"))
    return made["tiers"]


@query("join_inner_gold", """SELECT c_mktsegment AS segment, COUNT(*) AS orders,
 CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey
 WHERE c_acctbal > 5000 GROUP BY c_mktsegment""")
def join_inner_gold(spark, folder):
    gold = table(spark, folder, "customer").where("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    orders = table(spark, folder, "orders").select("o_custkey", "o_totalprice")
    return orders.join(gold, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("semi_anti", """SELECT 'idle' AS kind, c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
 UNION ALL SELECT 'no urgent', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
 UNION ALL SELECT 'supplier pair', c_custkey FROM customer WHERE (c_custkey, c_nationkey) IN (SELECT s_suppkey, s_nationkey FROM supplier)""")
def semi_anti(spark, folder):
    customers = table(spark, folder, "customer")
    orders = table(spark, folder, "orders")
    suppliers = table(spark, folder, "supplier")
    owner = F.col("o_custkey") == F.col("c_custkey")
    idle = customers.join(orders, owner, "left_anti")
    calm = not_in(customers, orders.where("o_orderpriority = '1-URGENT'"), ["c_custkey"], ["o_custkey"])
    pair = (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    both = customers.join(suppliers, pair, "left_semi")
    tagged = [df.select(F.lit(kind).alias("kind"), "c_custkey") for kind, df in
              (("idle", idle), ("no urgent", calm), ("supplier pair", both))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


_NULL_KEYS = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS k,
 CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS n FROM customer),
 s AS (SELECT CASE WHEN s_acctbal > -900 THEN s_suppkey END AS k, CASE WHEN s_suppkey % 4 <> 1 THEN s_nationkey END AS n FROM supplier
 WHERE s_acctbal > -900 OR s_suppkey % 4 <> 1)"""


@query("not_in_nulls", f"""{_NULL_KEYS} SELECT 'keys' AS kind, c_custkey FROM c WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
 UNION ALL SELECT 'null in list', c_custkey FROM c WHERE k NOT IN (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END FROM orders)
 UNION ALL SELECT 'empty list', c_custkey FROM c WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0)
 UNION ALL SELECT 'pairs', c_custkey FROM c WHERE NOT EXISTS (SELECT 1 FROM s
 WHERE (s.k = c.k OR s.k IS NULL OR c.k IS NULL) AND (s.n = c.n OR s.n IS NULL OR c.n IS NULL))""")
def not_in_nulls(spark, folder):
    """Nulls on both sides, a list without rows, and pairs, in which nulls leave some pairs undecided."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("k"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("n"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.col("o_custkey").alias("k"))
    paid, named = F.col("s_acctbal") > -900, F.col("s_suppkey") % 4 != 1
    suppliers = table(spark, folder, "supplier").where(paid | named).select(
        F.when(paid, F.col("s_suppkey")).alias("k"), F.when(named, F.col("s_nationkey")).alias("n"))
    found = {
        "keys": not_in(customers, orders.where("o_orderpriority = '1-URGENT'"), ["k"]),
        "null in list": not_in(customers, orders.withColumn("k", F.when(F.col("o_orderkey") % 3 != 0, F.col("k"))), ["k"]),
        "empty list": not_in(customers, orders.where("o_totalprice < 0"), ["k"]),
        "pairs": not_in(customers, suppliers, ["k", "n"]),
    }
    tagged = [df.select(F.lit(kind).alias("kind"), "c_custkey") for kind, df in found.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])


@query("set_ops", """SELECT 'union' AS kind, k FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer) u
 UNION ALL SELECT 'both', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') i
 UNION ALL SELECT 'minus', k FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders) e""")
def set_ops(spark, folder):
    customers, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    nations = table(spark, folder, "supplier").select(F.col("s_nationkey").cast("long").alias("k")).union(
        customers.select(F.col("c_nationkey").cast("long"))).distinct()
    keys = customers.select(F.col("c_custkey").alias("k"))
    both = keys.intersect(orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))
    minus = keys.exceptAll(orders.select(F.col("o_custkey").alias("k")))
    frames = [df.select(F.lit(kind).alias("kind"), "k") for kind, df in (("union", nations), ("both", both), ("minus", minus))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("capped_query", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10000")
def capped_query(spark, folder):
    """An ad-hoc query without a limit of its own; the cap is the feature."""
    table(spark, folder, "orders").createOrReplaceTempView("tm_capped_orders")
    return sqlsteps.capped(spark, "SELECT o_orderkey, o_custkey FROM tm_capped_orders ORDER BY o_orderkey;")


@query("distinct_values", """SELECT o_orderstatus AS status, o_orderpriority AS priority, COUNT(DISTINCT o_custkey) AS customers
 FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def distinct_values(spark, folder):
    return table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(
        F.count_distinct("o_custkey").alias("customers"))


@query("parse_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS order_date,
 CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price FROM orders""")
def parse_dates(spark, folder):
    texts = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("p"))
    return texts.select("o_orderkey", parse_date(F.col("d")).alias("order_date"), F.col("p").try_cast("double").alias("price"))


@query("email_domain", """SELECT c_custkey AS user_id, split_part(concat(replace(c_name, '#', '.'), '@', lower(c_mktsegment), '.example.com'), '@', 2)
 AS email_domain FROM customer""")
def email_domain(spark, folder):
    email = F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.split_part(email, F.lit("@"), F.lit(2)).alias("email_domain"))
