"""Queries over expectations and quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators import quality
from tablemill.operators.quality import Expectation
from tablemill.plans import fixtures
from tablemill.plans.registry import query

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_SEGMENT_LIST = ", ".join(f"'{s}'" for s in SEGMENTS)
_DIRTY = fixtures.duck(fixtures.DIRTY)


def dirty(spark, folder):
    return fixtures.derive(spark, folder, fixtures.DIRTY, "customer")


def _oracle(name: str, kind: str, bad: str, message: str, threshold: float = 0.0) -> str:
    return f"""SELECT '{name}' AS name, '{kind}' AS type, rows_failed / rows_evaluated * 100 <= {threshold} AS passed,
 rows_evaluated, rows_failed, rows_failed / rows_evaluated * 100 AS failure_pct, {message} AS message
 FROM (SELECT COUNT(*) AS rows_evaluated, COUNT(*) FILTER (WHERE {bad}) AS rows_failed FROM ({_DIRTY}) d) r"""


CHECKS = {
    "not_null": Expectation("key_there", "not_null", "c_custkey", action="quarantine"),
    "unique": Expectation("name_once", "unique", "c_name", action="quarantine"),
    "in_set": Expectation("segment_known", "in_set", "c_mktsegment", {"values": SEGMENTS}, "quarantine"),
    "between": Expectation("balance_range", "between", "c_acctbal", {"min": -500, "max": 9000}, "warn", 15.0),
    "regex": Expectation("name_form", "regex_match", "c_name", {"pattern": "^Customer#[0-9]+$"}, "warn"),
    "custom": Expectation("no_poor_builders", "custom", action="quarantine",
                          predicate=lambda df: (F.col("c_acctbal") < 0) & (F.col("c_mktsegment") == "BUILDING")),
}
_BAD = {
    "not_null": "c_custkey IS NULL",
    "in_set": f"c_mktsegment NOT IN ({_SEGMENT_LIST})",
    "between": "c_acctbal < -500 OR c_acctbal > 9000",
    "regex": "NOT regexp_matches(c_name, '^Customer#[0-9]+$')",
    "custom": "c_acctbal < 0 AND c_mktsegment = 'BUILDING'",
}
_COUNTED = "concat('Column ''{0}'' has ', CAST(rows_failed AS VARCHAR), '{1}')"


@query("dq_not_null", _oracle("key_there", "not_null", _BAD["not_null"], _COUNTED.format("c_custkey", " null values")))
def dq_not_null(spark, folder):
    return quality.evaluate(dirty(spark, folder), [CHECKS["not_null"]])


_UNIQUE = f"""SELECT 'name_once' AS name, 'unique' AS type, bad = 0 AS passed, n AS rows_evaluated, bad AS rows_failed,
 bad / n * 100 AS failure_pct, concat('Column ''c_name'' has ', CAST(again AS VARCHAR), ' duplicate values affecting ',
 CAST(bad AS VARCHAR), ' rows') AS message FROM (SELECT CAST(SUM(k) AS BIGINT) AS n,
 CAST(COALESCE(SUM(k) FILTER (WHERE k > 1 AND c_name IS NOT NULL), 0) AS BIGINT) AS bad,
 COUNT(*) FILTER (WHERE k > 1 AND c_name IS NOT NULL) AS again
 FROM (SELECT c_name, COUNT(*) AS k FROM ({_DIRTY}) d GROUP BY c_name) g) r"""


@query("dq_unique", _UNIQUE)
def dq_unique(spark, folder):
    return quality.evaluate(dirty(spark, folder), [CHECKS["unique"]])


_IN_SET = _oracle("segment_known", "in_set", _BAD["in_set"],
                  _COUNTED.format("c_mktsegment", " values not in " + str(SEGMENTS).replace("'", "''")))
_BETWEEN = _oracle("balance_range", "between", _BAD["between"], _COUNTED.format("c_acctbal", " values outside [-500, 9000]"), 15.0)
_REGEX = _oracle("name_form", "regex_match", _BAD["regex"],
                 _COUNTED.format("c_name", " values not matching pattern ''^Customer#[0-9]+$''"))
_CUSTOM = _oracle("no_poor_builders", "custom", _BAD["custom"],
                  "concat(CAST(rows_failed AS VARCHAR), ' rows fail no_poor_builders')")


@query("dq_in_set", _IN_SET)
def dq_in_set(spark, folder):
    return quality.evaluate(dirty(spark, folder), [CHECKS["in_set"]])


@query("dq_between", _BETWEEN)
def dq_between(spark, folder):
    return quality.evaluate(dirty(spark, folder), [CHECKS["between"]])


@query("dq_regex", _REGEX)
def dq_regex(spark, folder):
    return quality.evaluate(dirty(spark, folder), [CHECKS["regex"]])


@query("dq_row_count", f"""SELECT 'enough_rows' AS name, 'row_count_between' AS type, n >= 100 AS passed, n AS rows_evaluated,
 CASE WHEN n >= 100 THEN 0 ELSE n END AS rows_failed, CAST(CASE WHEN n >= 100 THEN 0 ELSE 100 END AS DOUBLE) AS failure_pct,
 concat('Row count ', CAST(n AS VARCHAR), CASE WHEN n >= 100 THEN ' in ' ELSE ' not in ' END, 'range [100, inf]') AS message
 FROM (SELECT COUNT(*) AS n FROM ({_DIRTY}) d) r UNION ALL
 SELECT 'few_rows', 'row_count_between', n <= 10, n, CASE WHEN n <= 10 THEN 0 ELSE n END,
 CAST(CASE WHEN n <= 10 THEN 0 ELSE 100 END AS DOUBLE), concat('Row count ', CAST(n AS VARCHAR),
 CASE WHEN n <= 10 THEN ' in ' ELSE ' not in ' END, 'range [0, 10]') FROM (SELECT COUNT(*) AS n FROM ({_DIRTY}) d) r""")
def dq_row_count(spark, folder):
    return quality.evaluate(dirty(spark, folder), [
        Expectation("enough_rows", "row_count_between", config={"min": 100}),
        Expectation("few_rows", "row_count_between", config={"max": 10}, action="warn")])


_EXISTS = f"""SELECT 'has_name' AS name, 'column_exists' AS type, TRUE AS passed, COUNT(*) AS rows_evaluated,
 CAST(0 AS BIGINT) AS rows_failed, CAST(0 AS DOUBLE) AS failure_pct, 'Column ''c_name'' exists' AS message FROM ({_DIRTY}) d
 UNION ALL SELECT 'has_phone', 'column_exists', FALSE, COUNT(*), 0, 0, 'Column ''c_phone'' missing' FROM ({_DIRTY}) d"""


@query("dq_column_exists", _EXISTS)
def dq_column_exists(spark, folder):
    return quality.evaluate(dirty(spark, folder), [
        Expectation("has_name", "column_exists", "c_name"), Expectation("has_phone", "column_exists", "c_phone")])


@query("dq_custom", _CUSTOM)
def dq_custom(spark, folder):
    return quality.evaluate(dirty(spark, folder), [CHECKS["custom"]])


@query("dq_missing_column", f"""SELECT 'phone_there' AS name, 'not_null' AS type, FALSE AS passed, CAST(0 AS BIGINT) AS rows_evaluated,
 CAST(0 AS BIGINT) AS rows_failed, CAST(0 AS DOUBLE) AS failure_pct, 'Column ''c_phone'' not found in DataFrame' AS message
 FROM (SELECT COUNT(*) FROM ({_DIRTY}) d) one""")
def dq_missing_column(spark, folder):
    return quality.evaluate(dirty(spark, folder), [Expectation("phone_there", "not_null", "c_phone")])


@query("dq_all", " UNION ALL ".join([_oracle("key_there", "not_null", _BAD["not_null"], _COUNTED.format("c_custkey", " null values")),
                                     _UNIQUE, _IN_SET, _BETWEEN, _REGEX, _CUSTOM]))
def dq_all(spark, folder):
    """Five row checks in one aggregate over one scan, and a keyed aggregate for uniqueness."""
    return quality.evaluate(dirty(spark, folder), list(CHECKS.values()))


@query("dq_summary", f"""SELECT COUNT(*) AS total_checks, COUNT(*) FILTER (WHERE passed) AS passed,
 COUNT(*) FILTER (WHERE NOT passed) AS failed, COUNT(*) FILTER (WHERE passed) / COUNT(*) * 100 AS pass_rate
 FROM ({_UNIQUE} UNION ALL {_IN_SET} UNION ALL {_BETWEEN} UNION ALL {_REGEX}) r""")
def dq_summary(spark, folder):
    checks = [CHECKS[k] for k in ("unique", "in_set", "between", "regex")]
    return quality.summary(quality.evaluate(dirty(spark, folder), checks))


@query("dq_fail", f"""SELECT concat('key_there (not_null): Column ''c_custkey'' has ', CAST(bad AS VARCHAR), ' null values, ',
 printf('%.2f', bad / n * 100), '% failed') AS error
 FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE c_custkey IS NULL) AS bad FROM ({_DIRTY}) d) r""")
def dq_fail(spark, folder):
    """The error that stops a run at its first failing check."""
    checks = [CHECKS["between"], Expectation("key_there", "not_null", "c_custkey"),
              Expectation("name_once", "unique", "c_name")]
    try:
        quality.enforce(dirty(spark, folder), checks)
    except quality.QualityError as error:
        return spark.createDataFrame([(str(error),)], "error string")
    return spark.createDataFrame([], "error string")


_HITS = f"""WITH d AS ({_DIRTY}), twice AS (SELECT c_name FROM d WHERE c_name IS NOT NULL GROUP BY c_name HAVING COUNT(*) > 1),
 marked AS (SELECT d.*, COALESCE({_BAD['not_null']}, FALSE) AS b1, d.c_name IN (SELECT c_name FROM twice) AS b2,
 COALESCE({_BAD['in_set']}, FALSE) AS b3, COALESCE({_BAD['custom']}, FALSE) AS b4 FROM d)"""
_COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
_QUARANTINED = [CHECKS[k] for k in ("not_null", "unique", "in_set", "custom")]


@query("dq_clean", f"{_HITS} SELECT {_COLUMNS} FROM marked WHERE NOT (b1 OR b2 OR b3 OR b4)")
def dq_clean(spark, folder):
    return quality.quarantine(dirty(spark, folder), _QUARANTINED)[0]


@query("dq_quarantine", f"{_HITS} " + " UNION ALL ".join(
    f"SELECT {_COLUMNS}, '{c.name}' AS _quality_check, '{c.type}' AS _check_type, 'run-1' AS _run_id, 'customers' AS _dataset "
    f"FROM marked WHERE b{i}" for i, c in enumerate(_QUARANTINED, start=1)))
def dq_quarantine(spark, folder):
    return quality.quarantine(dirty(spark, folder), _QUARANTINED, "run-1", "customers")[1]
