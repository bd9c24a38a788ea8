import datetime

import pytest
from conftest import bag

from tablemill.operators import cleaning
from tablemill.operators.chain import apply_chain, chain_deltas, filter_table
from tablemill.operators.filters import filter_rows


@pytest.fixture
def people(frame):
    return frame([(1, "Ann", 10.0, "x"), (2, "bob", None, "y"), (3, None, 30.0, "x"), (4, "Cy.d", 40.0, None)],
                 "id int, name string, v double, k string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_drop_empty_rows(frame):
    df = frame([(None, " \t  "), (None, None), (1, ""), (None, "x")], "n int, s string")
    assert bag(cleaning.drop_empty_rows(df)) == sorted([(1, ""), (None, "x")], key=repr)
    assert cleaning.drop_empty_rows(df, ["s"]).count() == 1
    assert cleaning.drop_empty_rows(df, ["absent"]).count() == 4


def test_fill_tokens_ignore_case(frame):
    df = frame([(1, "A", "p"), (2, " null ", "p"), (3, "-", "p"), (4, "B", "p"), (5, None, "q"), (6, "C", "q")], "i int, c string, k string")
    down = {r.i: r.c for r in cleaning.fill_gaps(df, ["c", "absent"], order_by=["i"], partition_by=["k"]).collect()}
    up = {r.i: r.c for r in cleaning.fill_gaps(df, ["c"], order_by=["i"], partition_by=["k"], direction="up").collect()}
    assert down == {1: "A", 2: "A", 3: "A", 4: "B", 5: None, 6: "C"}
    assert up == {1: "A", 2: "B", 3: "B", 4: "B", 5: "C", 6: "C"}
    with pytest.raises(ValueError):
        cleaning.fill_gaps(df, ["c"], order_by=["i"], direction="left")


def test_casts_give_null_instead_of_errors(frame):
    df = frame([("7", "1.5", "yes", "2024-02-30", "2024-01-02 03:04:05"), (" 8 ", "x", "true", "2024-02-03", "?")],
               "a string, b string, c string, d string, e string")
    got = cleaning.type_cast(df, {"a": "int", "b": "INT32", "c": "bool", "d": "date", "e": "datetime", "zz": "int"})
    assert dict(got.dtypes) == {"a": "bigint", "b": "int", "c": "boolean", "d": "date", "e": "timestamp_ntz"}
    assert bag(got) == sorted([(7, None, True, None, datetime.datetime(2024, 1, 2, 3, 4, 5)),
                               (8, None, True, datetime.date(2024, 2, 3), None)], key=repr)


def test_constants_replace(people):
    assert {tuple(r)[1:] for r in cleaning.add_constants(people.select("id", "k"), {"k": 5, "n": None}).collect()} == {(5, None)}


def test_comparisons_and_null(people):
    test = lambda *c, **o: ids(filter_rows(people, [{"column": a, "operator": b, "value": v} for a, b, v in c], **o))
    assert test(("v", ">=", 30)) == [3, 4]
    assert test(("v", "!=", 10)) == [3, 4]
    assert test(("k", "not_in", ["x"])) == [2]
    assert test(("k", "in", "x")) == [1, 3]
    assert test(("name", "contains", "^[AB]"), ("name", "ends_with", "d"), operator="or") == [1, 4]
    assert test(("name", "starts_with", "Cy.")) == [4]
    assert test(("id", "regex", "[13]")) == [1, 3]
    with pytest.raises(ValueError):
        test(("id", "~", 1))
    with pytest.raises(ValueError):
        test(("id", "=", 1), operator="xor")


def test_regex_and_expression_types_work(people):
    assert ids(filter_rows(people, [{"type": "regex", "column": "name", "pattern": "^b"}])) == [2]
    assert ids(filter_rows(people, [{"type": "expression", "eval": "length(name) > 2 AND v IS NOT NULL"}])) == [1, 4]
    with pytest.raises(ValueError):
        filter_rows(people, [{"type": "mystery"}])


def test_absent_columns_are_ignored_unless_strict(people):
    assert ids(filter_rows(people, {"absent": 1})) == [1, 2, 3, 4]
    assert ids(filter_rows(people, {"absent": 1, "k": "x"})) == [1, 3]
    with pytest.raises(KeyError):
        filter_rows(people, {"absent": 1}, strict=True)


def test_nested_not_takes_its_first_child(people):
    spec = [{"type": "not", "conditions": [{"column": "k", "value": "x"}, {"column": "id", "value": 2}]}]
    assert ids(filter_rows(people, spec)) == [2]
    assert ids(filter_rows(people, [{"type": "column_compare", "left": "v", "operator": ">", "right": "id"}])) == [1, 3, 4]


def test_filter_reaches_the_scan(spark):
    df = filter_rows(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), {"o_orderstatus": "F"}).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_chain_and_deltas(frame):
    df = frame([(1, "a"), (None, " "), (3, "b")], "`The Id` int, `The Name` string")
    steps = ["normalize_headers", "drop_empty_rows",
             {"name": "filter", "rows": {"conditions": {"the_name": "b"}}, "columns": {"select": ["the_id"], "rename": {"the_id": "id"}}}]
    assert bag(apply_chain(df, steps)) == [(3,)]
    deltas = {r.processor: (r.rows_before, r.rows_after, r.columns_after) for r in chain_deltas(df, steps).collect()}
    assert deltas == {"normalize_headers": (3, 3, 2), "drop_empty_rows": (3, 2, 2), "filter": (2, 1, 1)}
    assert apply_chain(df, [{"name": "require_columns", "required": ["zz"], "mode": "skip_table"}]) is None
    with pytest.raises(KeyError):
        apply_chain(df, ["no such step"])


def test_filter_table_order(people):
    got = filter_table(people, {"conditions": {"k": "x"}, "operator": "OR"}, {"select": ["id", "name"], "rename": {"name": "n"}})
    assert got.columns == ["id", "n"] and ids(got) == [1, 3]
