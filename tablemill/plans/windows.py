"""Queries over ranks, quantiles, running values and group statistics; the flagship query is here."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.functions.text import named
from tablemill.operators import windows
from tablemill.operators.cleaning import drop_empty_rows
from tablemill.operators.headers import normalize_headers
from tablemill.plans import fixtures
from tablemill.plans.registry import query, table

_RANK = """RANK() OVER (PARTITION BY urgency ORDER BY net_price)
 + (COUNT(*) OVER (PARTITION BY urgency, net_price) - 1) / 2.0"""
_P75 = """SELECT urgency, MAX(CASE WHEN rn = CAST(ROUND(0.75 * (n - 1)) AS BIGINT) + 1 THEN net_price END) AS p75_value
 FROM (SELECT urgency, net_price, ROW_NUMBER() OVER (PARTITION BY urgency ORDER BY net_price) AS rn,
 COUNT(*) OVER (PARTITION BY urgency) AS n FROM settled) q GROUP BY urgency"""
_TIER = "CASE WHEN net_price > p75_value THEN 'high' WHEN net_price > p75_value * 0.5 THEN 'medium' ELSE 'low' END"


def _clean(sql: str) -> str:
    return f"WITH settled AS ({fixtures.SETTLED}), summary AS ({fixtures.TURNOVER}), p AS ({_P75}) {sql}"


_ENRICHED = f"""SELECT order_id, c.urgency, net_price, placed, {_RANK.replace('urgency', 'c.urgency')} AS category_rank,
 p75_value, {_TIER} AS value_tier, orders_n, ROUND(mean_price, 4) AS mean_price, ROUND(turnover, 4) AS turnover,
 ROUND(net_price / turnover * 100, 2) AS pct_of_category
 FROM settled c JOIN p ON c.urgency = p.urgency LEFT JOIN summary s ON c.urgency = s.urgency"""


def enriched(spark, folder, ranges: int | None = None):
    """Read orders under headers as people type them, price them, rank and tier them, and relate each to its urgency."""
    typed = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").toDF(
        "O OrderKey", "O OrderStatus ", "O-TotalPrice", "o orderdate", "O.OrderPriority")
    rows = fixtures.settled(drop_empty_rows(normalize_headers(typed)).toDF("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    placed = windows.rank_with_quantiles(rows, "net_price", ["urgency"], "category_rank", {"p75_value": 0.75}, ranges)
    value = F.col("net_price")
    return windows.join_groups(placed, fixtures.turnover(rows), ["urgency"]).select(
        "order_id", "urgency", "net_price", "placed", "category_rank", "p75_value",
        windows.quantile_tier(value, F.col("p75_value")).alias("value_tier"), "orders_n",
        F.round("mean_price", 4).alias("mean_price"), F.round("turnover", 4).alias("turnover"),
        windows.percent_of(value, F.col("turnover")).alias("pct_of_category"))


@query("enriched_data", _clean(_ENRICHED))
def enriched_data(spark, folder):
    return enriched(spark, folder)


@query("rank_avg", _clean(f"SELECT order_id, urgency, net_price, {_RANK} AS category_rank FROM settled"))
def rank_avg(spark, folder):
    rows = fixtures.clean(spark, folder).select("order_id", "urgency", "net_price")
    return windows.rank_average(rows, "net_price", ["urgency"], "category_rank")


_RANK_NULLS = """SELECT l_orderkey, l_linenumber, l_returnflag, q, CASE WHEN q IS NOT NULL THEN
 RANK() OVER (PARTITION BY l_returnflag ORDER BY q NULLS LAST) + (COUNT(*) OVER (PARTITION BY l_returnflag, q) - 1) / 2.0 END
 AS quantity_rank FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q FROM lineitem) l"""


@query("rank_ties", _RANK_NULLS)
def rank_ties(spark, folder):
    """Fifty distinct values over all line items: nearly every row is a tie, and some values are null."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"))
    return windows.rank_average(rows, "q", ["l_returnflag"], "quantity_rank")


@query("p75_nearest", _clean("SELECT order_id, c.urgency, net_price, p75_value FROM settled c JOIN p ON c.urgency = p.urgency"))
def p75_nearest(spark, folder):
    rows = fixtures.clean(spark, folder).select("order_id", "urgency", "net_price")
    return windows.with_group_quantile(rows, "net_price", ["urgency"], 0.75, "p75_value")


@query("value_tier", _clean(f"SELECT order_id, c.urgency, {_TIER} AS value_tier FROM settled c JOIN p ON c.urgency = p.urgency"))
def value_tier(spark, folder):
    rows = fixtures.clean(spark, folder).select("order_id", "urgency", "net_price")
    placed = windows.with_group_quantile(rows, "net_price", ["urgency"], 0.75, "p75_value")
    return placed.select("order_id", "urgency", windows.quantile_tier(F.col("net_price"), F.col("p75_value")).alias("value_tier"))


@query("pct_of_category", _clean("""SELECT order_id, c.urgency, ROUND(net_price / turnover * 100, 2) AS pct_of_category
 FROM settled c LEFT JOIN summary s ON c.urgency = s.urgency"""))
def pct_of_category(spark, folder):
    rows = fixtures.clean(spark, folder)
    joined = windows.join_groups(rows, fixtures.turnover(rows), ["urgency"])
    return joined.select("order_id", "urgency", windows.percent_of(F.col("net_price"), F.col("turnover")).alias("pct_of_category"))


@query("pct_vs_avg", _clean(f"""SELECT order_id, c.urgency, ROUND((net_price - mean_price) / mean_price * 100, 2) AS pct_vs_category_avg,
 CASE {_TIER} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS tier_score
 FROM settled c JOIN p ON c.urgency = p.urgency LEFT JOIN summary s ON c.urgency = s.urgency"""))
def pct_vs_avg(spark, folder):
    rows = fixtures.clean(spark, folder)
    quantiles = windows.group_quantiles(rows, "net_price", ["urgency"], {"p75_value": 0.75})
    groups = fixtures.turnover(rows).join(quantiles, "urgency")
    value, tier = F.col("net_price"), windows.quantile_tier(F.col("net_price"), F.col("p75_value"))
    return windows.join_groups(rows, groups, ["urgency"]).select(
        "order_id", "urgency", windows.percent_above(value, F.col("mean_price")).alias("pct_vs_category_avg"),
        windows.tier_score(tier).alias("tier_score"))


@query("cum_sum", _clean("""SELECT order_id, urgency, net_price, CAST(SUM(CAST(net_price AS DECIMAL(18, 3))) OVER
 (PARTITION BY urgency ORDER BY order_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_value FROM settled"""))
def cum_sum(spark, folder):
    """In decimals, which are exact whatever the order of the additions."""
    rows = fixtures.clean(spark, folder).select("order_id", "urgency", "net_price",
                                                F.col("net_price").cast("decimal(18,3)").alias("exact"))
    summed = windows.cumulative_sum(rows, "exact", ["urgency"], ["order_id"], "cumulative_value")
    return summed.withColumn("cumulative_value", F.col("cumulative_value").cast("double")).drop("exact")


@query("seq_in_group", _clean("SELECT order_id, urgency, ROW_NUMBER() OVER (PARTITION BY urgency ORDER BY order_id) AS record_sequence FROM settled"))
def seq_in_group(spark, folder):
    rows = fixtures.clean(spark, folder).select("order_id", "urgency")
    return windows.sequence_number(rows, ["urgency"], ["order_id"], "record_sequence")


@query("group_stats", _clean("""SELECT urgency, COUNT(*) AS total_records, ROUND(AVG(net_price), 4) AS mean_value,
 ROUND(MEDIAN(net_price), 4) AS median_value, ROUND(STDDEV_SAMP(net_price), 4) AS std_value,
 MIN(net_price) AS min_value, MAX(net_price) AS max_value FROM settled GROUP BY urgency"""))
def group_stats(spark, folder):
    stats = windows.group_stats(fixtures.clean(spark, folder), "net_price", ["urgency"])
    return stats.withColumns({c: F.round(named(c), 4) for c in ("mean_value", "median_value", "std_value")})


@query("tier_distribution", _clean(f"""SELECT urgency, value_tier, COUNT(*) AS n FROM (SELECT c.urgency, {_TIER} AS value_tier
 FROM settled c JOIN p ON c.urgency = p.urgency) t GROUP BY urgency, value_tier"""))
def tier_distribution(spark, folder):
    """Counted, listed per urgency in bounded lists, and unfolded again for comparison."""
    lists = windows.value_distribution_lists(value_tier(spark, folder), "value_tier", ["urgency"])
    return lists.select("urgency", F.inline("counts")).select("urgency", F.col("value").alias("value_tier"), "n")


@query("customer_tiers", """SELECT c_custkey, c_name, total_spent, order_count, last_order_date,
 CASE WHEN total_spent > 3000000 THEN 'gold' WHEN total_spent > 2000000 THEN 'silver' ELSE 'bronze' END AS tier
 FROM customer LEFT JOIN (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total_spent,
 COUNT(o_orderkey) AS order_count, MAX(o_orderdate) AS last_order_date FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""")
def customer_tiers(spark, folder):
    spent = F.col("total_spent")
    stats = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_spent"),
        F.count("o_orderkey").alias("order_count"), F.max("o_orderdate").alias("last_order_date"))
    return table(spark, folder, "customer").join(stats, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_name", "total_spent", "order_count", "last_order_date",
        F.when(spent > 3000000, "gold").when(spent > 2000000, "silver").otherwise("bronze").alias("tier"))
