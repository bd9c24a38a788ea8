"""Interval joins against a nested loop in Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tablemill.operators.ranges import join_between, lists_between
from tablemill.sinks import documents
from tablemill.sources import markup


def pairs(intervals, points):
    return sorted((i, p) for k, lo, hi, i in intervals for g, at, p in points
                  if None not in (k, g, lo, hi, at) and k == g and lo <= at <= hi)


@pytest.mark.parametrize("kind", ["double", "long", "decimal(12,2)", "date", "timestamp", "timestamp_ntz"])
def test_pairs_are_those_of_a_nested_loop(spark, kind):
    rng = random.Random(kind)

    def value(x):
        if x is None:
            return None
        if kind in ("long", "date", "timestamp", "timestamp_ntz"):
            x = int(x)
        return {"date": lambda: datetime.date(2020, 1, 1) + datetime.timedelta(days=x), "decimal(12,2)": lambda: round(x, 2)}.get(
            kind, lambda: datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=x) if "time" in kind else x)()

    intervals, points = [], []
    for i in range(60):
        lo = rng.uniform(-500, 500)
        width = rng.choice([0, 0.3, 1, 2, 8, 64, 700, -1])
        intervals.append((rng.choice(["a", "b", None]), value(lo if i % 9 else None), value(lo + width if i % 11 else None), i))
    for p in range(150):
        points.append((rng.choice(["a", "b", "c", None]), value(rng.uniform(-520, 520) if p % 13 else None), p))
    points += [(k, lo, 200 + i) for k, lo, _, i in intervals] + [(k, hi, 300 + i) for k, _, hi, i in intervals]
    typed = kind if kind != "decimal(12,2)" else "double"
    a = spark.createDataFrame(intervals, f"k string, lo {typed}, hi {typed}, i int").withColumns({"lo": F.col("lo").cast(kind), "hi": F.col("hi").cast(kind)})
    b = spark.createDataFrame(points, f"k string, at {typed}, p int").withColumn("at", F.col("at").cast(kind))
    got = join_between(a, b, "lo", "hi", "at", ["k"])
    assert sorted((r.i, r.p) for r in got.collect()) == pairs(intervals, points)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and got.columns == ["k", "lo", "hi", "i", "at", "p"]


def test_extreme_bounds_and_empty_sides(spark):
    a = spark.createDataFrame([(1e-200, 2e-200, 1), (-1e300, 1e300, 2), (5.0, 5.0, 3), (float("-inf"), 0.0, 4)], "lo double, hi double, i int")
    b = spark.createDataFrame([(1.5e-200, 1), (5.0, 2), (1e299, 3), (float("nan"), 4), (5.000000001, 5)], "at double, p int")
    got = {(r.i, r.p) for r in join_between(a.where("i < 4"), b, "lo", "hi", "at").collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (2, 3), (2, 5), (3, 2)}
    assert join_between(a.where("false"), b, "lo", "hi", "at").count() == 0 and join_between(a.where("i < 4"), b.where("false"), "lo", "hi", "at").count() == 0
    with pytest.raises(ValueError):
        join_between(a.withColumn("lo", F.lit("x")), b, "lo", "hi", "at")


def test_children_between_bounds(spark):
    parents = spark.createDataFrame([(1, 0, 9), (1, 0, 9), (2, 5, 25), (3, 50, 60), (4, None, 3)], "k int, lo int, hi int")
    children = spark.range(30).selectExpr("cast(id as int) as at", "id * 10 as c")
    rows = documents.nest_between(parents, children, "lo", "hi", "at", ["at"], "kids", max_children=8).collect()
    found = sorted((r.k, r.part, tuple(x["at"] for x in r.kids)) for r in rows)
    one = [(1, 0, tuple(range(8))), (1, 1, (8, 9))]
    assert found == sorted(one * 2 + [(2, 0, tuple(range(5, 13))), (2, 1, tuple(range(13, 21))), (2, 2, tuple(range(21, 26))), (3, 0, ()), (4, 0, ())])


def in_lists(parents, children, size):
    """A nested loop: (k, part, children in the order of c)."""
    out = []
    for k, g, lo, hi in parents:
        kids = sorted(c for h, at, c in children if None not in (g, h, lo, hi, at) and g == h and lo <= at <= hi)
        out += [(k, p, tuple(kids[p * size:(p + 1) * size])) for p in range(max(1, -(-len(kids) // size)))]
    return sorted(out)


@pytest.mark.parametrize("block,share,size", [(3, 2, 5), (7, 100, 3), (4_096, 1, 8), (1, 1, 1)])
def test_lists_over_the_ends_of_blocks(spark, block, share, size):
    rng = random.Random(block)
    parents = [(k, rng.choice(["a", "b", None]), rng.choice([None, lo, lo, lo]), lo + rng.choice([-1, 0, 0.5, 30, 64, 500]))
               for k, lo in enumerate(rng.uniform(-99, 99) for _ in range(50))]
    children = [(rng.choice("abbc"), rng.choice([None, float("nan"), *[rng.uniform(-120, 120)] * 9]), c) for c in range(150)]
    children += [("a", lo, 200 + k) for k, _, lo, _ in parents] + [("b", hi, 300 + k) for k, _, _, hi in parents] + [("b", 1.5, 400)] * 9
    got = lists_between(spark.createDataFrame(parents, "k int, g string, lo double, hi double"), spark.createDataFrame(children, "g string, at double, c int"),
                        "lo", "hi", "at", ["g"], "k", ["c"], size, "kids", block=block, share=share)
    assert got.columns == ["k", "g", "lo", "hi", "part", "kids"] and got.schema["part"].dataType.simpleString() == "int"
    real = [c for c in children if c[1] == c[1]]
    assert sorted((r.k, r.part, tuple(x["c"] for x in r.kids)) for r in got.collect()) == in_lists(parents, real, size)


def test_an_interval_a_hair_wider_than_its_power_of_two(spark):
    a = spark.createDataFrame([(1, -1e-20, 1.0)], "k int, lo double, hi double")
    b = spark.createDataFrame([(-1e-20,), (0.5,), (1.0,)], "at double")
    assert [len(r.kids) for r in lists_between(a, b, "lo", "hi", "at", [], "k", ["at"], 9, "kids").collect()] == [3]


def test_pairs_are_not_written(spark, monkeypatch):
    """40 parents of all 900 children: rows written grow with the rows, not with the pairs."""
    from tablemill.operators import ordered, ranges

    written = []

    def counted(df, write=ordered.staged):
        written.append((out := write(df)).count())
        return out

    for module in (ordered, ranges, documents):
        if hasattr(module, "staged"):
            monkeypatch.setattr(module, "staged", counted)
    parents = spark.range(40).selectExpr("id as k", "-1L as lo", "2000L as hi")
    rows = documents.nest_between(parents, spark.range(900).selectExpr("id as at"), "lo", "hi", "at", ["at"], "kids", max_children=100).collect()
    assert len(rows) == 360 and all([x["at"] for x in r.kids] == list(range(r.part * 100, r.part * 100 + 100)) for r in rows)
    assert sum(written) < 40 * 900 / 3


@pytest.mark.parametrize("columns", [["k", "note", "part", "kid", "z"], ["kid", "part"], ["kid"]])
def test_children_written_once_make_the_same_documents(spark, columns):
    """Children that are made XML before they meet their parents stand in the documents as those that are written with them."""
    children = spark.sql("""SELECT 1 g, id AS at, id * 10 AS _id, IF(id % 3 = 0, NULL, IF(id % 3 = 1, 'a<b & "c"\\n    <kid></kid>', '')) AS t,
     IF(id % 4 = 0, array(), IF(id % 4 = 1, NULL, array(named_struct('_k', id, 'v', NULL, 'kid', ''), named_struct('_k', NULL, 'v', ' é😀 ', 'kid', NULL)))) AS sub
     FROM range(12) UNION ALL SELECT 1, NULL, 5, 't', NULL UNION ALL SELECT 1, 4, NULL, NULL, NULL""")
    parents = spark.sql("SELECT id AS k, 1 g, IF(id = 2, '\\n    <kid></kid>', IF(id = 1, '', NULL)) AS note, id * 3 AS lo, id * 3 + 4 AS hi, 'z' AS z FROM range(6)")

    def made(as_xml):
        nested = documents.nest_between(parents, children, "lo", "hi", "at", ["_id"], "kid", on=["g"], max_children=2, as_xml=as_xml).select(columns)
        docs = documents.xml_documents(nested, "par", [], [c for c in ("k", "part") if c in columns], written=["kid"] if as_xml else [])
        return sorted(r.xml for r in docs.collect())

    assert made(True) == made(False) and any("<kid id=" in x for x in made(True)) and any("<kid" not in x for x in made(True))


def test_a_child_is_turned_into_xml_once_for_all_its_parents(spark):
    """40 parents of all 300 children: the lists hold texts that were made before the parents came."""
    parents, children = spark.range(40).selectExpr("id as k", "-1L as lo", "500L as hi"), spark.range(300).selectExpr("id as at", "id as _id")
    nested = documents.nest_between(parents, children, "lo", "hi", "at", ["at"], "kid", max_children=50, as_xml=True)
    assert nested.schema["kid"].dataType.simpleString() == "array<string>" and "to_xml" not in nested._jdf.queryExecution().optimizedPlan().toString()
    docs = documents.xml_documents(nested, "par", ["k"], ["k", "part"], written=["kid"])
    facts = markup.xml_fields(docs, "xml", {"first": "kid/@id", "kids": "count(kid/@id)"}, ["k"], shared=True)
    assert sorted((r.k, int(r.first), r.kids) for r in facts.collect()) == [(k, 50 * p, 50) for k in range(40) for p in range(6)]
