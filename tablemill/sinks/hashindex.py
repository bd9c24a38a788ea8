"""Row hashes of a table, kept beside it, so that a batch meets only the part of them that it may find itself in.

Hashes lie in a table that is partitioned by bucket; a second table has a bitmap for each bucket in which every hash sets one bit. A row
whose bit is not set is new without looking further. The others are compared with the hashes of their buckets; no other
bucket is read, and the table itself is not read at all.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.text import named
from tablemill.operators.merge import keyed_semi
from tablemill.session import staged
from tablemill.sinks.files import spread

BUCKETS = 16
BITS = 32_768  # of a bitmap, as Spark's bitmap functions make them
FILES = "tablemill.files"  # property of the hash table: the state of the indexed table
_SHAPE = "tablemill.buckets"


def hash_table(table: str) -> str:
    return f"{table}__hashes"


def bit_table(table: str) -> str:
    return f"{table}__bits"


def _state(spark: SparkSession, table: str) -> str:
    """Changes with every write to the table."""
    spark.catalog.refreshTable(table)
    return hashlib.md5("\n".join(sorted(spark.table(table).inputFiles())).encode()).hexdigest()


def _placed(rows: DataFrame, hash_column: str, buckets: int) -> DataFrame:
    number = F.conv(F.substring(named(hash_column), 1, 12), 16, 10).cast("long") % (buckets * BITS)
    return rows.withColumns({"__bucket": F.floor(number / BITS).cast("int"), "__bit": number % BITS})


def _keep(rows: DataFrame, table: str, hash_column: str, buckets: int, mode: str) -> None:
    """Add the hashes of rows to both tables."""
    placed = staged(_placed(rows.select(named(hash_column).alias("hash")), "hash", buckets).withColumnRenamed("__bucket", "bucket"))
    spread(placed.select("hash", "bucket"), ["bucket"]).write.mode(mode).format("parquet").partitionBy("bucket").saveAsTable(hash_table(table))
    placed.groupBy("bucket").agg(F.bitmap_construct_agg("__bit").alias("bitmap")).write.mode(mode).format("parquet").saveAsTable(bit_table(table))


def _current(spark: SparkSession, table: str, hash_column: str, buckets: int) -> None:
    """Build the index anew where the table has changed since, or where it has another number of buckets."""
    state, index = _state(spark, table), hash_table(table)
    if spark.catalog.tableExists(index) and spark.catalog.tableExists(bit_table(table)):
        held = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {index}").collect()}
        if held.get(FILES) == state and held.get(_SHAPE) == str(buckets):
            return
    for name in (index, bit_table(table)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _keep(spark.table(table), table, hash_column, buckets, "errorifexists")
    spark.sql(f"ALTER TABLE {index} SET TBLPROPERTIES ('{FILES}' = '{state}', '{_SHAPE}' = '{buckets}')")


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def unseen(table: str, batch: DataFrame, hash_column: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a batch with hashes that the table does not hold. The table has a hash column; an index that is missing or that the
    table has left behind is built first. Buckets, and so the bitmaps' size, should grow with the table: about one for 10,000 rows."""
    spark = batch.sparkSession
    _current(spark, table, hash_column, buckets)
    bitmaps = spark.table(bit_table(table)).groupBy(F.col("bucket").alias("__bucket")).agg(F.bitmap_or_agg("bitmap").alias("__bitmap"))
    placed = _placed(batch, hash_column, buckets).join(bitmaps, "__bucket", "left")
    marked = staged(placed.withColumn("__may", _is_set(F.col("__bitmap"), F.col("__bit"))).drop("__bitmap", "__bit"))
    asked = sorted(r["__bucket"] for r in marked.where("__may").select("__bucket").distinct().collect())
    known = spark.table(hash_table(table)).where(F.col("bucket").isin(asked)).select(F.col("hash").alias(hash_column))
    maybe = keyed_semi(marked.where("__may"), known, [hash_column], "left_anti")
    return marked.where("not __may").unionByName(maybe).select(*[named(c) for c in batch.columns])


def remember(table: str, rows: DataFrame, hash_column: str, buckets: int = BUCKETS) -> None:
    """Add rows that were just appended to the table; until then, and if it fails, the index counts as left behind."""
    spark = rows.sparkSession
    _keep(rows, table, hash_column, buckets, "append")
    spark.sql(f"ALTER TABLE {hash_table(table)} SET TBLPROPERTIES ('{FILES}' = '{_state(spark, table)}')")
