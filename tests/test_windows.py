import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablemill.operators import windows
from tablemill.plans import windows as plans


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.0, 1.0, 2.5, rng.random()]), i) for i in range(400)]
    return rows, spark.createDataFrame(rows, "g string, v double, id int")


@pytest.mark.parametrize("limit", [None, 7])
def test_rank_shares_places(data, limit):
    rows, df = data
    got = {r.id: r.rank for r in windows.rank_average(df, "v", ["g"], ranges=limit).collect()}
    for g, v, i in rows:
        peers = [x for h, x, _ in rows if h == g and x is not None]
        expected = None if v is None else sum(x < v for x in peers) + (sum(x == v for x in peers) + 1) / 2
        assert got[i] == expected


@pytest.mark.parametrize("limit", [None, 7])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_nearest_quantile(data, limit, q):
    rows, df = data
    got = {r.g: r.q for r in windows.group_quantiles(df, "v", ["g"], {"q": q}, ranges=limit).collect()}
    for g in {r[0] for r in rows}:
        values = sorted(v for h, v, _ in rows if h == g and v is not None)
        place = q * (len(values) - 1)
        assert got[g] == values[int(place + 0.5)]


@pytest.mark.parametrize("limit", [None, 7])
def test_group_stats(data, limit):
    rows, df = data
    got = {r.g: r for r in windows.group_stats(df, "v", ["g"], ranges=limit).collect()}
    for g in {r[0] for r in rows}:
        values = [v for h, v, _ in rows if h == g and v is not None]
        assert got[g].median_value == pytest.approx(statistics.median(values))
        assert got[g].std_value == pytest.approx(statistics.stdev(values))
        assert got[g].total_records == sum(h == g for h, _, _ in rows)


def test_quantile_without_groups(data):
    rows, df = data
    values = sorted(v for _, v, _ in rows if v is not None)
    got = windows.with_group_quantile(df, "v", [], 0.75, "p", ranges=7)
    assert {r.p for r in got.collect()} == {values[int(0.75 * (len(values) - 1) + 0.5)]}
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_distribution_lists_are_bounded_and_whole(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), (F.col("id") % 37).alias("v"))
    lists = windows.value_distribution_lists(df, "v", ["g"], list_size=10, ranges=5).collect()
    assert [len(r.counts) for r in sorted(lists, key=lambda r: r.part)] == [10, 10, 10, 7]
    assert sum(entry.n for r in lists for entry in r.counts) == 1000


def test_flagship_in_ranges_equals_plain(spark):
    folder = "/root/testdata/sf0.001"
    plain = plans.enriched(spark, folder)
    ranged = plans.enriched(spark, folder, ranges=9)
    assert plain.columns == ranged.columns
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))


def test_cumulative_null_and_sequence(frame):
    df = frame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 1.0), ("b", 1, 2.0)], "g string, i int, v double")
    got = windows.sequence_number(windows.cumulative_sum(df, "v", ["g"], ["i"], "c"), ["g"], ["i"], "no")
    assert {(r.g, r.i): (r.c, r.no) for r in got.collect()} == {
        ("a", 1): (5.0, 1), ("a", 2): (None, 2), ("a", 3): (6.0, 3), ("b", 1): (2.0, 1)}


def test_quantiles_sort_a_sliver_only(spark):
    """One group holds all rows; the band round the median holds a few of a hundred of them."""
    df = spark.range(40_000).selectExpr("'g' as g", "(id * 7919) % 40000 as v")
    counts = windows._band_counts(df, "v", ["g"], [0.5])
    assert counts.count() < 1500 and counts.agg(F.sum("n")).head()[0] == 40_000
    for q in (0.0, 0.013, 0.5, 0.75, 1.0):
        assert windows.group_quantiles(df, "v", ["g"], {"q": q}).head().q == int(q * 39_999 + 0.5)


def test_quantiles_with_heavy_ties_and_odd_numbers(spark):
    nan = float("nan")
    rows = [("t", 5.0)] * 700 + [("t", float(i)) for i in range(300)] + [("n", nan)] * 3 + [("m", 1.0), ("m", nan), ("m", nan)] + [("e", None)]
    got = {r.g: r for r in windows.group_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], {"a": 0.5, "b": 0.95}).collect()}
    assert (got["t"].a, got["t"].b) == (5.0, sorted(v for g, v in rows if g == "t")[int(0.95 * 999 + 0.5)])
    assert str(got["n"].a) == "nan" and str(got["m"].b) == "nan" and "e" not in got
    assert windows.group_quantiles(spark.createDataFrame([], "g string, v double"), "v", ["g"], {"a": 0.5}).count() == 0


def test_a_rank_outside_its_band_is_found_all_the_same(spark, monkeypatch):
    monkeypatch.setattr(windows, "BAND", -0.3)  # edges change places: no band holds a value
    df = spark.range(1000).selectExpr("id % 3 as g", "id as v")
    got = {r.g: r.q for r in windows.group_quantiles(df, "v", ["g"], {"q": 0.5}).collect()}
    assert got == {g: sorted(range(g, 1000, 3))[int(0.5 * (len(range(g, 1000, 3)) - 1) + 0.5)] for g in range(3)}
