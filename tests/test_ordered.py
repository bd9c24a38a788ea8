"""Running values cut into ranges must equal those of a plain pass, whatever the skew."""

import random

import pytest
from pyspark.sql import functions as F

from tablemill.operators.cleaning import fill_gaps
from tablemill.operators.ordered import in_ranges, running


def rows_with(seed, groups, n=600, copies=0):
    rng = random.Random(seed)
    rows = [(rng.choice(groups), rng.randrange(40), i, rng.choice([None, 1.5, -2.0, 7.0]), rng.choice([None, "a", "b", "c"]))
            for i in range(n)]
    return rows + [("hot", 3, -1, 2.0, None)] * copies


SCHEMA = "g string, o int, id int, v double, t string"


def brute(rows, descending=False):
    """Order within the group by (o, id, v, t), nulls first."""
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[1], r[2])) + (
        (r[3] is not None, r[3] or 0.0), (r[4] is not None, r[4] or ""))
    out = []
    for group in {r[0] for r in rows}:
        total, number, last = 0.0, 0, None
        for r in sorted((r for r in rows if r[0] == group), key=key, reverse=descending):
            total += r[3] or 0.0
            number += 1
            last = r[4] if r[4] is not None else last
            out.append((*r, None if r[3] is None else total, last, number))
    return sorted(out, key=repr)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("groups", [["only"], ["a", "b", None], ["hot"] * 9 + ["x", "y", "z"]])
@pytest.mark.parametrize("ranges", [None, 1, 12])
def test_ranges_equal_brute_force(spark, groups, descending, ranges):
    rows = rows_with(len(groups), groups)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = running(df, group_by=["g"], order_by=["o", "id", "v", "t"], sums={"s": F.col("v")}, fills={"last": F.col("t")},
                  numbers=["no"], descending=descending, ranges=ranges)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, descending)


def test_copies_that_fill_many_ranges(spark):
    rows = rows_with(5, ["hot", "b"], n=200, copies=500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    order = ["o", "id", "v", "t"]
    cut = in_ranges(df, ["g"], order, ranges=10)
    assert cut.where("id = -1").select("__range").distinct().count() > 4
    got = running(df, group_by=["g"], order_by=order, sums={"s": F.col("v")}, fills={"last": F.col("t")}, numbers=["no"], ranges=10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_no_group_and_no_rows(spark):
    df = spark.range(500).withColumn("v", F.lit(2))
    got = running(df, order_by=["id"], sums={"s": F.col("v")}, numbers=["no"], ranges=16)
    assert {(r.id, r.s, r.no) for r in got.collect()} == {(i, 2 * i + 2, i + 1) for i in range(500)}
    assert running(df.where("false"), order_by=["id"], numbers=["no"], ranges=4).count() == 0


def test_ranges_are_balanced_when_one_order_value_is_hot(spark):
    """All rows share the group, and a third of them the order; ranges cut through both."""
    df = spark.range(3000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id").cast("int")).alias("o"))
    sizes = [r["count"] for r in in_ranges(df, ["g"], ["o"], ranges=30).groupBy("__range").count().collect()]
    assert max(sizes) < 3000 / 6 and sum(sizes) == 3000


@pytest.mark.parametrize("kind", ["int", "decimal(12,2)", "double"])
def test_types_and_width_of_sums(spark, kind):
    df = spark.range(300).selectExpr("id", f"cast(2000000000 as {kind}) as v")
    plain = running(df, order_by=["id"], sums={"s": F.col("v")}, ranges=1)
    ranged = running(df, order_by=["id"], sums={"s": F.col("v")}, ranges=8)
    assert plain.dtypes == ranged.dtypes and ranged.agg(F.max("s")).head()[0] == 300 * 2000000000
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))


def test_one_carry_row_per_range_and_one_more_exchange(spark):
    """The second pass shuffles the rows once, by group and range; carries are broadcast."""
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    plan = running(df, group_by=["g"], order_by=["id"], numbers=["no"], ranges=10)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "SinglePartition" not in text
    assert text.count("Exchange hashpartitioning(g") == 3  # rows; one row per group and range, twice


@pytest.mark.parametrize("direction", ["down", "up"])
def test_fill_in_ranges_without_a_key(spark, direction):
    rows = [(i, ["-", None, "NULL", " ", f"v{i}"][i % 5 if i % 7 else 0]) for i in range(300)]
    got = fill_gaps(spark.createDataFrame(rows, "i int, c string").repartition(4), ["c"], order_by=["i"],
                    direction=direction, ranges=12)
    expected, last = {}, None
    for i, c in (rows if direction == "down" else reversed(rows)):
        if c is not None and c.strip() and c not in ("-", "NULL"):
            last = c
        expected[i] = last
    assert {r.i: r.c for r in got.collect()} == expected


def test_gaps_longer_than_a_range_are_filled(spark):
    df = spark.range(400).selectExpr("id", "case when id in (3, 390) then concat('v', id) end as c")
    got = {r.id: r.c for r in fill_gaps(df, ["c"], order_by=["id"], ranges=20).collect()}
    assert all(got[i] == (None if i < 3 else "v3" if i < 390 else "v390") for i in range(400))


@pytest.mark.parametrize("kind", ["date", "timestamp_ntz", "timestamp", "decimal(20,4)", "string", "double", "boolean"])
def test_every_order_type(spark, kind):
    source = {"date": "date_add(date'2020-01-01', cast(id as int))", "timestamp_ntz": "timestamp_ntz'2020-01-01 00:00:00.123456' + make_interval(0,0,0,0,id)",
              "timestamp": "timestamp'2020-01-01 00:00:00.5' + make_interval(0,0,0,0,id)", "decimal(20,4)": "cast(id as decimal(20,4)) / 3",
              "string": "concat('ü', id)", "double": "id / 7", "boolean": "id % 2 = 0"}[kind]
    df = spark.range(200).selectExpr(f"cast({source} as {kind}) as k", "id")
    got = running(df, order_by=["k", "id"], numbers=["no"], ranges=10)
    plain = running(df, order_by=["k", "id"], numbers=["no"], ranges=1)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_ties_are_broken_by_the_other_columns(spark):
    """Most rows share the order column, which alone could not cut them into ranges."""
    df = spark.range(900).select(F.when(F.col("id") < 800, 5).otherwise(9).alias("o"), (F.col("id") * 7 % 900).alias("x"))
    plain = running(df, order_by=["o"], numbers=["no"], ranges=1)
    ranged = running(df, order_by=["o"], numbers=["no"], ranges=15)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))
