import pytest
from conftest import bag
from pyspark.sql import functions as F

from tablemill.operators import contracts, quality
from tablemill.operators.contracts import ColumnContract, Contract, ContractError
from tablemill.operators.quality import Expectation, QualityError


@pytest.fixture
def df(frame):
    return frame([(1, "a", 5.0), (1, "b", None), (None, "c", 50.0), (None, "zz", -1.0), (4, None, 7.0)], "id int, s string, v double")


def results(df, *checks):
    return {r.name: r for r in quality.evaluate(df, checks).collect()}


def test_null_passes_everything_but_not_null_and_unique_skips_it(df):
    got = results(df, Expectation("nn", "not_null", "id"), Expectation("u", "unique", "id"),
                  Expectation("in", "in_set", "s", {"values": ["a", "b", "c"]}),
                  Expectation("bt", "between", "v", {"min": 0, "max": 7}),
                  Expectation("low", "between", "v", {"min": 0}), Expectation("none", "between", "v"),
                  Expectation("rx", "regex_match", "s", {"pattern": "^.$"}),
                  Expectation("cu", "custom", predicate=lambda d: F.col("v") > F.col("id")))
    assert {n: r.rows_failed for n, r in got.items()} == {"nn": 2, "u": 2, "in": 1, "bt": 2, "low": 1, "none": 0, "rx": 1, "cu": 2}
    assert all(r.rows_evaluated == 5 for r in got.values())
    assert got["nn"].failure_pct == 40.0 and not got["nn"].passed and got["none"].passed
    assert got["u"].message == "Column 'id' has 1 duplicate values affecting 2 rows"


def test_table_level_checks(df):
    got = results(df, Expectation("rows", "row_count_between", config={"min": 6}), Expectation("ok", "row_count_between", config={"min": 1, "max": 5}),
                  Expectation("col", "column_exists", "nope"), Expectation("has", "column_exists", "s"),
                  Expectation("gone", "not_null", "nope"), Expectation("gone_u", "unique", "nope"), Expectation("cu", "custom"))
    assert (got["rows"].passed, got["rows"].rows_failed, got["rows"].failure_pct) == (False, 5, 100.0)
    assert got["rows"].message == "Row count 5 not in range [6, inf]"
    assert got["ok"].passed and got["ok"].rows_failed == 0
    assert not got["col"].passed and got["has"].passed
    assert (got["gone"].passed, got["gone"].rows_evaluated) == (False, 0) and not got["gone_u"].passed
    assert "not callable" in got["cu"].message


def test_empty_table_passes(df):
    got = results(df.where("false"), Expectation("nn", "not_null", "id"), Expectation("u", "unique", "id"))
    assert all(r.passed and r.failure_pct == 0.0 for r in got.values())


def test_row_checks_share_one_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    checks = [Expectation("a", "not_null", "o_orderkey"), Expectation("b", "in_set", "o_orderstatus", {"values": ["F"]}),
              Expectation("c", "between", "o_totalprice", {"min": 1}), Expectation("d", "regex_match", "o_orderpriority", {"pattern": "^[1-5]"}),
              Expectation("e", "row_count_between", config={"min": 1})]
    plan = quality.evaluate(orders, checks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "o_custkey" not in plan


def test_quarantine_takes_the_failing_rows_of_every_check(df):
    checks = [Expectation("nn", "not_null", "id", action="quarantine"), Expectation("u", "unique", "id", action="quarantine"),
              Expectation("rx", "regex_match", "s", {"pattern": "^.$"}, action="quarantine"), Expectation("w", "not_null", "s", action="warn")]
    clean, caught = quality.quarantine(df, checks, "r1", "people")
    assert bag(clean) == [(4, None, 7.0)]
    assert sorted((r.s, r._quality_check, r._check_type, r._run_id, r._dataset) for r in caught.collect()) == [
        ("a", "u", "unique", "r1", "people"), ("b", "u", "unique", "r1", "people"), ("c", "nn", "not_null", "r1", "people"),
        ("zz", "nn", "not_null", "r1", "people"), ("zz", "rx", "regex_match", "r1", "people")]


def test_tolerance_keeps_rows(df, tmp_path):
    tolerant = [Expectation("nn", "not_null", "id", action="quarantine", threshold_pct=40.0)]
    clean, caught = quality.quarantine(df, tolerant)
    assert clean.count() == 5 and caught.count() == 0 and "_quality_check" in caught.columns
    strict = [Expectation("nn", "not_null", "id", action="quarantine", threshold_pct=39.0)]
    clean, caught = quality.quarantine(df, strict)
    assert clean.count() == 3
    quality.write_quarantine(caught, str(tmp_path / "q"))
    assert (tmp_path / "q" / "_quality_check=nn").is_dir()


def test_enforce(df):
    ok = quality.enforce(df, [Expectation("w", "not_null", "id", action="warn"), Expectation("f", "column_exists", "id")])
    assert [r["passed"] for r in ok] == [False, True]
    with pytest.raises(QualityError, match="nn .not_null.*40.00%"):
        quality.enforce(df, [Expectation("nn", "not_null", "id")])
    row = quality.summary(quality.evaluate(df, [Expectation("a", "not_null", "id"), Expectation("b", "column_exists", "id")])).head()
    assert tuple(row) == (2, 1, 1, 50.0)
    with pytest.raises(ValueError):
        Expectation("x", "no_such_type")


def test_contract(df):
    contract = Contract("people", [
        ColumnContract("id", "int", nullable=False, unique=True, min_value=2), ColumnContract("s", "string", allowed_values=["a", "b"], pattern="^.$"),
        ColumnContract("v", "int", max_value=10), ColumnContract("phone", "string")],
        primary_keys=["id", "s"], unique_constraints=[["id"], ["nope"]], check_constraints=["v > 0"])
    found = {(r.rule, r.column): r.violations for r in contracts.violations(df, contract).collect()}
    assert found == {("missing_column", "phone"): 1, ("type", "v"): 1, ("not_null", "id"): 2, ("unique", "id"): 1, ("min_value", "id"): 2,
                     ("allowed_values", "s"): 2, ("pattern", "s"): 1, ("max_value", "v"): 1, ("primary_key_null", "id"): 2,
                     ("primary_key_null", "s"): 1, ("unique_columns", "id"): 2, ("unique_columns", "nope"): 1, ("check", "v > 0"): 1}
    assert [r.value for r in contracts.offenders(df, contract.columns[1]).collect()] == ["c", "zz"]
    with pytest.raises(ContractError, match="people v1.0"):
        contracts.require(df, contract)


def test_extra_columns_warn_or_fail(df):
    contract = Contract("c", [ColumnContract("id", "int")])
    assert {r.severity for r in contracts.violations(df, contract, strict=False).collect()} == {"warning"}
    assert contracts.require(df, contract, strict=False) is df
    with pytest.raises(ContractError):
        contracts.require(df, contract)


def test_contract_schema_reads_and_creates(spark, database):
    contract = Contract("people", [ColumnContract("id", "int", nullable=False), ColumnContract("at", "datetime"), ColumnContract("raw", "binary"),
                                   ColumnContract("ok", "boolean"), ColumnContract("day", "date"), ColumnContract("v", "float")])
    spark.sql(contract.ddl(f"{database}.people") + " USING parquet")
    created = spark.table(f"{database}.people").schema
    assert [f.dataType for f in created.fields] == [f.dataType for f in contract.schema().fields]
    assert "NOT NULL" in contract.ddl()


def test_a_null_in_a_value_list_hides_nothing(frame):
    df = frame([(1, "a"), (2, "x"), (3, None)], "id int, kind string")
    rows = quality.evaluate(df, [Expectation("kinds", "in_set", "kind", {"values": ["a", None]})]).collect()
    assert [r.rows_failed for r in rows] == [1]
    only_null = quality.evaluate(df, [Expectation("kinds", "in_set", "kind", {"values": [None]})]).collect()
    assert [r.rows_failed for r in only_null] == [2]


def test_checks_with_equal_names_are_refused(frame):
    df = frame([(1, "a")], "id int, kind string")
    checks = [Expectation("same", "not_null", "id"), Expectation("same", "in_set", "kind", {"values": ["b"]}, "fail")]
    for run in (quality.evaluate, quality.enforce, quality.quarantine):
        with pytest.raises(ValueError, match="share names"):
            run(df, checks)


def test_offenders_are_shown_in_the_violations(frame):
    df = frame([(i, v) for i, v in enumerate(["a", "x", "y", "x", None])], "id int, kind string")
    contract = Contract("kinds", [ColumnContract("id", "int"), ColumnContract("kind", "string", allowed_values=["a", None])])
    found = contracts.violations(df, contract).collect()
    assert [(r.rule, r.violations, r.detail) for r in found] == [("allowed_values", 3, "x, y")]
