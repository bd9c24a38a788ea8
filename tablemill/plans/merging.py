"""Queries over merges and table sinks; each returns the table as it is afterwards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablemill.functions.rowhash import row_hash
from tablemill.operators import merge
from tablemill.plans import fixtures
from tablemill.plans.registry import query, table
from tablemill.session import scratch_path
from tablemill.sinks.tables import write_idempotent, write_table

_KEYS, _ORDER = ["c_custkey"], ["seq"]
_COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
_OLD, _NEW = f"(SELECT {_COLUMNS} FROM ({fixtures.TARGET}) t)", f"({fixtures.BATCH_LAST})"
_KEPT = f"SELECT {_COLUMNS} FROM {_OLD} o WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE n.c_custkey = o.c_custkey)"
_FRESH = f"SELECT {_COLUMNS} FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE n.c_custkey = o.c_custkey)"
_MERGED = f"{_KEPT} UNION ALL SELECT {_COLUMNS} FROM {_NEW} n"


def target(spark, folder):
    return fixtures.derive(spark, folder, fixtures.TARGET, "customer")


def batch(spark, folder):
    """Later versions of rows the target holds and rows it lacks, some keys twice."""
    return fixtures.derive(spark, folder, fixtures.BATCH, "customer")


def _catalog(spark) -> str:
    """A database of its own below the shared scratch folder."""
    name = f"tm_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'db')}'")
    return name


@query("dedupe_last", f"""SELECT {_COLUMNS}, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY seq DESC) AS rn
 FROM ({fixtures.BATCH}) b) r WHERE rn = 1""")
def dedupe_last(spark, folder):
    return merge.dedupe_last(batch(spark, folder), _KEYS, _ORDER)


@query("merge_update", _MERGED)
def merge_update(spark, folder):
    return merge.merge(target(spark, folder), batch(spark, folder), _KEYS, "update", _ORDER)


@query("merge_ignore", f"SELECT {_COLUMNS} FROM {_OLD} o UNION ALL {_FRESH}")
def merge_ignore(spark, folder):
    return merge.merge(target(spark, folder), batch(spark, folder), _KEYS, "ignore", _ORDER)


@query("merge_delete_insert", _MERGED)
def merge_delete_insert(spark, folder):
    return merge.merge(target(spark, folder), batch(spark, folder), _KEYS, "delete_insert", _ORDER)


def _stats(strategy: str) -> str:
    hit = f"(SELECT COUNT(*) FROM {_NEW} n WHERE EXISTS (SELECT 1 FROM {_OLD} o WHERE n.c_custkey = o.c_custkey))"
    new, every = f"(SELECT COUNT(*) FROM ({_FRESH}) f)", f"(SELECT COUNT(*) FROM {_NEW} n)"
    a, b, c = {"update": (new, hit, "0"), "ignore": (new, "0", "0"), "delete_insert": (every, "0", hit)}[strategy]
    return f"SELECT '{strategy}' AS strategy, {a} AS rows_inserted, {b} AS rows_updated, {c} AS rows_deleted"


@query("merge_stats", " UNION ALL ".join(_stats(s) for s in merge.STRATEGIES))
def merge_stats(spark, folder):
    frames = [merge.merge_stats(target(spark, folder), batch(spark, folder), _KEYS, s, _ORDER)
              .select(F.lit(s).alias("strategy"), "*") for s in merge.STRATEGIES]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


_NULLED = "SELECT c_custkey, c_name, c_nationkey, c_acctbal{0} AS c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer"
_CELLS = [f"COALESCE(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in _COLUMNS.split(", ")]
_HASH, _NAMED_HASH = (f"md5({' || '.join(cells)})" for cells in (_CELLS, [c for _, c in sorted(zip(_COLUMNS.split(", "), _CELLS))]))


@query("row_hash", f"SELECT c_custkey, {_HASH} AS _row_hash FROM ({_NULLED.format('')}) n")
def row_hash_query(spark, folder):
    rows = fixtures.derive(spark, folder, _NULLED.format(""), "customer")
    return rows.select("c_custkey", row_hash(rows.columns).alias("_row_hash"))


# Of the batch, every second nation changed nothing, so its rows are already there; a third of all rows holds a null.
_INC_TARGET = _NULLED.format("") + " WHERE c_nationkey < 17"
_INC_BATCH = _NULLED.format(" + c_nationkey % 2") + " WHERE c_nationkey >= 8"


@query("incremental_append", f"""SELECT *, {_NAMED_HASH} AS _row_hash FROM ({_INC_TARGET}) t UNION ALL SELECT * FROM
 (SELECT *, {_NAMED_HASH} AS _row_hash FROM ({_INC_BATCH}) b) h WHERE _row_hash NOT IN (SELECT {_NAMED_HASH} FROM ({_INC_TARGET}) t)""")
def incremental_append(spark, folder):
    return merge.incremental(fixtures.derive(spark, folder, _INC_TARGET, "customer"),
                             fixtures.derive(spark, folder, _INC_BATCH, "customer"))


@query("sink_append", "SELECT * FROM customer WHERE c_nationkey < 17 UNION ALL SELECT * FROM customer WHERE c_nationkey >= 8")
def sink_append(spark, folder):
    name = f"{_catalog(spark)}.customers"
    write_idempotent(target(spark, folder), name, "append")
    write_idempotent(table(spark, folder, "customer").where("c_nationkey >= 8"), name, "append")
    return spark.table(name)


@query("sink_overwrite", "SELECT * FROM customer WHERE c_nationkey >= 8")
def sink_overwrite(spark, folder):
    name = f"{_catalog(spark)}.customers"
    write_idempotent(target(spark, folder), name, "overwrite")
    write_idempotent(table(spark, folder, "customer").where("c_nationkey >= 8"), name, "overwrite")
    return spark.table(name)


@query("sink_merge", _MERGED)
def sink_merge(spark, folder):
    """The stored table after a merge, merged twice to show that a repeated run changes nothing."""
    name = f"{_catalog(spark)}.customers"
    write_idempotent(target(spark, folder), name, "append")
    for _ in range(2):
        write_idempotent(batch(spark, folder), name, "merge", keys=_KEYS, order_by=_ORDER)
    return spark.table(name)


@query("sink_merge_partitioned", _MERGED)
def sink_merge_partitioned(spark, folder):
    """As above with a partitioned table: only the nations of the batch are rewritten."""
    name = f"{_catalog(spark)}.customers"
    keys = ["c_custkey", "c_nationkey"]
    write_idempotent(target(spark, folder), name, "append", partition_by=["c_nationkey"])
    write_idempotent(batch(spark, folder), name, "merge", keys=keys, order_by=_ORDER, partition_by=["c_nationkey"])
    return spark.table(name)


@query("sink_merge_touched", """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 1 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders
 UNION ALL SELECT -o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 1""")
def sink_merge_touched(spark, folder):
    """One customer's orders, changed and added; the table lies in files by customer, all but one of which stay."""
    name = f"{_catalog(spark)}.orders"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    write_idempotent(orders.repartitionByRange(8, "o_custkey"), name, "append")
    mine = orders.where("o_custkey = 1")
    added = mine.withColumn("o_orderkey", -F.col("o_orderkey"))
    changed = mine.withColumn("o_totalprice", F.lit(0.0))
    write_idempotent(changed.unionByName(added), name, "merge", keys=["o_orderkey"], order_by=["o_totalprice"])
    return spark.table(name)


@query("sink_incremental", f"""SELECT *, {_NAMED_HASH} AS _row_hash FROM ({_INC_TARGET}) t UNION ALL SELECT * FROM
 (SELECT *, {_NAMED_HASH} AS _row_hash FROM ({_INC_BATCH}) b) h WHERE _row_hash NOT IN (SELECT {_NAMED_HASH} FROM ({_INC_TARGET}) t)""")
def sink_incremental(spark, folder):
    name = f"{_catalog(spark)}.customers"
    for part in (_INC_TARGET, _INC_BATCH, _INC_BATCH):
        write_idempotent(fixtures.derive(spark, folder, part, "customer"), name, "incremental")
    return spark.table(name)


@query("sink_append_aligned", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
 CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey < 17 UNION ALL
 SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, CAST(s_acctbal AS VARCHAR), NULL FROM supplier""")
def sink_append_aligned(spark, folder):
    """Suppliers appended to customers: three columns in common, everything as text."""
    name = f"{_catalog(spark)}.parties"
    write_table(target(spark, folder), name, "fail")
    write_table(table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("c_acctbal"), F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("unknown_column")), name, "append", all_varchar=True)
    return spark.table(name)
