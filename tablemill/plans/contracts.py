"""Queries over schema contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators import contracts
from tablemill.operators.contracts import ColumnContract, Contract
from tablemill.plans import fixtures
from tablemill.plans.quality import SEGMENTS, dirty
from tablemill.plans.registry import query

_DIRTY = fixtures.duck(fixtures.DIRTY)
_LIST = ", ".join(f"'{s}'" for s in SEGMENTS)

CUSTOMERS = Contract(
    name="customers",
    columns=[
        ColumnContract("c_custkey", "int", nullable=False, unique=True),
        ColumnContract("c_name", "string", pattern="^Customer#", unique=True),
        ColumnContract("c_nationkey", "int", min_value=2, max_value=20),
        ColumnContract("c_acctbal", "float", nullable=False, min_value=0),
        ColumnContract("c_mktsegment", "string", allowed_values=[*SEGMENTS, None]),
    ],
    primary_keys=["c_custkey", "c_name"],
    unique_constraints=[["c_nationkey", "c_mktsegment"]],
    check_constraints=["c_acctbal < 9000 OR c_nationkey > 5"],
)
_RULES = [
    ("not_null", "c_custkey", "c_custkey IS NULL"),
    ("pattern", "c_name", "NOT regexp_matches(c_name, '^Customer#')"),
    ("min_value", "c_nationkey", "c_nationkey < 2"),
    ("max_value", "c_nationkey", "c_nationkey > 20"),
    ("not_null", "c_acctbal", "c_acctbal IS NULL"),
    ("min_value", "c_acctbal", "c_acctbal < 0"),
    ("allowed_values", "c_mktsegment", f"c_mktsegment NOT IN ({_LIST})"),
    ("primary_key_null", "c_custkey", "c_custkey IS NULL"),
    ("primary_key_null", "c_name", "c_name IS NULL"),
    ("check", "c_acctbal < 9000 OR c_nationkey > 5", "NOT (c_acctbal < 9000 OR c_nationkey > 5)"),
]
_VALUES = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, '{column}' AS \"column\", 'error' AS severity, COUNT(*) FILTER (WHERE {bad}) AS violations, "
    f"CAST(NULL AS VARCHAR) AS detail FROM ({_DIRTY}) d" for rule, column, bad in _RULES)


def _repeats(rule: str, columns: str, where: str = "TRUE") -> str:
    return (f"SELECT '{rule}' AS rule, '{columns}' AS \"column\", 'error' AS severity, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS violations, "
            f"CAST(NULL AS VARCHAR) AS detail FROM (SELECT COUNT(*) AS n FROM ({_DIRTY}) d WHERE {where} GROUP BY {columns}) g")


_UNIQUE = [_repeats("unique", "c_custkey", "c_custkey IS NOT NULL"), _repeats("unique", "c_name", "c_name IS NOT NULL")]
_KEY = _repeats("primary_key", "c_custkey,c_name")
_MULTI = _repeats("unique_columns", "c_nationkey,c_mktsegment")


@query("contract_values", _VALUES)
def contract_values(spark, folder):
    return contracts.value_violations(dirty(spark, folder), CUSTOMERS)


@query("contract_offenders", f"SELECT DISTINCT c_mktsegment AS value FROM ({_DIRTY}) d WHERE c_mktsegment NOT IN ({_LIST}) ORDER BY 1 LIMIT 5")
def contract_offenders(spark, folder):
    """The first five values that are not allowed; showing five is the feature."""
    return contracts.offenders(dirty(spark, folder), CUSTOMERS.columns[4])


@query("contract_unique", " UNION ALL ".join(_UNIQUE))
def contract_unique(spark, folder):
    return contracts.key_violations(dirty(spark, folder), Contract("unique", CUSTOMERS.columns))


@query("contract_pk", _KEY)
def contract_pk(spark, folder):
    return contracts.key_violations(dirty(spark, folder), Contract("pk", [], primary_keys=CUSTOMERS.primary_keys))


@query("contract_unique_multi", _MULTI)
def contract_unique_multi(spark, folder):
    return contracts.key_violations(dirty(spark, folder), Contract("multi", [], unique_constraints=CUSTOMERS.unique_constraints))


@query("contract_check", _VALUES.split(" UNION ALL ")[-1])
def contract_check(spark, folder):
    return contracts.value_violations(dirty(spark, folder), Contract("check", [], check_constraints=CUSTOMERS.check_constraints))


_SHOWN = f"""(SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT DISTINCT c_mktsegment AS s FROM ({_DIRTY}) d
 WHERE c_mktsegment NOT IN ({_LIST}) ORDER BY s LIMIT 5) o)"""


@query("contract_result", f"""SELECT rule, "column", severity, violations, CASE WHEN rule = 'allowed_values' THEN {_SHOWN} ELSE detail END AS detail FROM ({_VALUES} UNION ALL {' UNION ALL '.join(_UNIQUE)} UNION ALL {_KEY} UNION ALL {_MULTI}) v
 WHERE violations > 0""")
def contract_result(spark, folder):
    return contracts.violations(dirty(spark, folder), CUSTOMERS)


_MESSY_BALANCE = "CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END"


def _reshaped(spark, folder):
    """A column under another name, and a column of text that is not always a number."""
    text = F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return dirty(spark, folder).withColumnRenamed("c_name", "full_name").withColumn("c_acctbal", text)


@query("contract_columns", f"""SELECT 'missing_column' AS rule, 'c_name' AS "column", 'error' AS severity, COUNT(*) AS violations,
 CAST(NULL AS VARCHAR) AS detail FROM ({_DIRTY}) d UNION ALL SELECT 'extra_column', 'full_name', 'error', COUNT(c_name), NULL FROM ({_DIRTY}) d""")
def contract_columns(spark, folder):
    return contracts.column_violations(_reshaped(spark, folder), CUSTOMERS, count_rows=True).where("rule != 'type'")


@query("contract_types", f"""SELECT 'type' AS rule, 'c_acctbal' AS "column", 'error' AS severity,
 COUNT(*) FILTER (WHERE {_MESSY_BALANCE} = 'n/a') AS violations, 'expected float, got string' AS detail FROM ({_DIRTY}) d""")
def contract_types(spark, folder):
    return contracts.column_violations(_reshaped(spark, folder), CUSTOMERS, count_rows=True).where("rule = 'type'")


@query("contract_schema", " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, '{kind}' AS data_type, {nullable} AS nullable, COUNT({name}) AS values_read FROM ({_DIRTY}) d"
    for name, kind, nullable in (("c_custkey", "bigint", "FALSE"), ("c_name", "string", "TRUE"), ("c_nationkey", "bigint", "TRUE"),
                                 ("c_acctbal", "double", "FALSE"), ("c_mktsegment", "string", "TRUE"))))
def contract_schema(spark, folder):
    """The Spark schema a contract stands for, and the values of the table that read under it."""
    schema = CUSTOMERS.schema()
    rows = dirty(spark, folder).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    entries = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                        F.lit(f.nullable).alias("nullable"), F.col(f"n_{f.name}").alias("values_read")) for f in schema.fields]
    return rows.agg(*[F.count(f.name).alias(f"n_{f.name}") for f in schema.fields]).select(F.inline(F.array(*entries)))
