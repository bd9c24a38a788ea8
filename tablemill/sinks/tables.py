"""Idempotent writes to catalog tables.

Plain Parquet tables know no MERGE. A merge finds the files that hold a key of the batch, writes their rows anew beside them and then
puts the new files in their place; all other files stay as they are. A merge whose keys include the partition columns replaces the
partitions of the batch. Other replacements write a new folder and point the table there; the old files stay for one more replacement,
so that readers that have listed them can finish. Tables keep their properties and comments.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import named
from tablemill.operators.merge import (
    HASH_COLUMN,
    HIT,
    after_merge,
    aligned,
    dedupe_last,
    duplicate_batch_keys,
    keyed_semi,
    merge_parts,
    with_row_hash,
)
from tablemill.session import staged, unstage
from tablemill.sinks import hashindex
from tablemill.sinks.files import spread

MODES = ("append", "overwrite", "merge", "incremental")
WORK = "_merge-"  # begins the names of folders of merges under way; readers pass over names with an underscore
SUPERSEDED = "tablemill.superseded"  # table property: the folder before the last replacement


def _stats(mode: str, inserted: int, updated: int = 0, deleted: int = 0) -> dict[str, object]:
    return {"mode": mode, "rows_inserted": inserted, "rows_updated": updated, "rows_deleted": deleted}


def _create(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)


def _partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def _location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def _property(spark: SparkSession, table: str, name: str) -> str | None:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}.get(name)


def _path(spark: SparkSession, place: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _plain(spark: SparkSession, uri: str) -> str:
    """The path of a file that Spark names as a URI, in which some signs are escaped."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()


def _remove_files(spark: SparkSession, files: Sequence[str]) -> None:
    """Delete the files named, and nothing else."""
    for name in files:
        path, system = _path(spark, name)
        system.delete(path, False)


def _data_files(spark: SparkSession, folder: str) -> list[str]:
    path, system = _path(spark, folder)
    if not system.exists(path):
        return []
    return [_plain(spark, f) for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).inputFiles()]


def _same_columns(df: DataFrame, table: str) -> bool:
    """Whether the frame has the table's columns first, with their types: further ones can be added in place."""
    held = df.sparkSession.table(table).schema.fields
    return [(f.name, f.dataType) for f in df.schema.fields[: len(held)]] == [(f.name, f.dataType) for f in held]


def replace_contents(df: DataFrame, table: str) -> None:
    """Replace the contents of a table with a frame that may read that table and may have further columns.

    A plain table is pointed at a new folder beside the old one, whose data files go with the next replacement. Catalogs keep the folder of every partition, so a
    partitioned table is overwritten from a written copy of the frame; if that is cut off, the copy in the scratch folder is
    complete. A frame with other columns or types than the table's makes a new table of that name.
    """
    spark = df.sparkSession
    exists = spark.catalog.tableExists(table)
    if exists and _partition_columns(spark, table):
        held = {f.name: f.dataType for f in spark.table(table).schema.fields}
        changed = [f.name for f in df.schema.fields if f.name in held and f.dataType != held[f.name]]
        if changed:
            raise ValueError(f"columns of a partitioned table keep their types: {changed}")
        copy = staged(df)
        _add_columns(spark, table, [f for f in df.schema.fields if f.name not in held])
        _overwrite(copy, table, "static")
        unstage(copy)
    elif exists and _same_columns(df, table):
        old = _location(spark, table)
        new = f"{old.rstrip('/')}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(new)
        known = set(spark.table(table).columns)
        _add_columns(spark, table, [f for f in df.schema.fields if f.name not in known])
        superseded = _property(spark, table, SUPERSEDED)
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{new}'")
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{SUPERSEDED}' = '{old}')")
        spark.catalog.refreshTable(table)
        if superseded and superseded not in (old, new):
            _remove_files(spark, _data_files(spark, superseded))
    else:
        copy = staged(df) if exists else df
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        _create(copy, table)
        if exists:
            unstage(copy)


def _add_columns(spark: SparkSession, table: str, fields: Sequence[T.StructField]) -> None:
    if fields:
        new = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({new})")


def _overwrite(df: DataFrame, table: str, partitions: str) -> None:
    """Overwrite the whole table (``static``) or the partitions the frame has rows for (``dynamic``)."""
    spark = df.sparkSession
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, partitions)
    try:
        rows = aligned(df, spark.table(table))
        spread(rows, _partition_columns(spark, table)).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(key, before)


def write_idempotent(
    df: DataFrame,
    table: str,
    mode: str = "append",
    *,
    keys: Sequence[str] = (),
    order_by: Sequence[str] | None = None,
    strategy: str = "update",
    create_if_missing: bool = True,
    partition_by: Sequence[str] = (),
    hash_column: str = HASH_COLUMN,
    hash_buckets: int = hashindex.BUCKETS,
) -> dict[str, object]:
    """Write a batch and return its statistics.

    With keys and ``order_by`` the batch is first reduced to the last row of each key. ``merge`` needs keys;
    ``incremental`` appends the rows whose hash the table does not hold; its hashes are kept in ``hash_buckets`` buckets beside it (see
    ``hashindex``). ``partition_by`` partitions a table that
    is created; a merge whose keys include those columns rewrites only the partitions of the batch, any other only the
    files that hold a key of the batch.

    Rows are counted by observers in the stage that writes them, which counts every task once even if executors
    are lost, so the statistics cost no pass of their own.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "merge" and not keys:
        raise ValueError("merge needs keys")
    spark = df.sparkSession
    if keys and order_by is not None:
        df = dedupe_last(df, keys, order_by)
    if mode == "merge":
        # Both halves of a merge read the batch: compute it once, so that they see the same rows.
        df = staged(df)
        if order_by is None and not duplicate_batch_keys(df, keys).isEmpty():
            raise ValueError("the batch repeats a key; pass order_by to keep the last row of each")

    if not spark.catalog.tableExists(table):
        if not create_if_missing:
            raise ValueError(f"table {table} does not exist")
        first = with_row_hash(df, output=hash_column) if mode == "incremental" else df
        counted, rows = _counted(spread(first, partition_by))  # counted after the shuffle, in the writing stage
        _create(counted, table, partition_by)
        return _stats(mode, rows.get["n"])
    target = spark.table(table)
    unknown = [c for c in df.columns if c not in target.columns and c not in (order_by or ())]
    if unknown:
        raise ValueError(f"table {table} has no columns {unknown}")
    if mode == "merge":
        stats = _merge(df, target, table, keys, strategy)
        unstage(df)
        return stats
    if mode == "incremental":
        if hash_column not in target.columns:
            replace_contents(with_row_hash(target, df.columns, hash_column), table)
            target = spark.table(table)
        df = staged(hashindex.unseen(table, with_row_hash(df, output=hash_column), hash_column, hash_buckets))
    counted, rows = _counted(aligned(df, target))
    if mode == "overwrite":  # of the whole table, whatever the session says of partitions, and also from a frame that reads it
        copy = staged(counted)
        _overwrite(copy, table, "static")
        unstage(copy)
    else:
        counted.write.insertInto(table)
    if mode == "incremental":
        hashindex.remember(table, df, hash_column, hash_buckets)
        unstage(df)
    return _stats(mode, rows.get["n"])


def _counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, Observation]:
    watcher = Observation()
    return df.observe(watcher, (F.count(F.lit(1)) if what is None else F.count_if(what)).alias("n")), watcher


def _merge(df: DataFrame, target: DataFrame, table: str, keys: Sequence[str], strategy: str) -> dict[str, object]:
    parts = _partition_columns(df.sparkSession, table)
    if not parts or not set(parts) <= set(keys):
        return _merge_files(df, target, table, keys, strategy, parts)
    held, added = merge_parts(_touched(target, df, parts), df, keys, strategy)
    held, hits = _counted(held, F.col(HIT))
    added, new = _counted(added)
    copy = staged(after_merge(held, strategy).unionByName(added))  # read before it is overwritten
    _overwrite(copy, table, "dynamic")
    unstage(copy)
    return _merge_stats(strategy, hits.get["n"], new.get["n"])


def _merge_stats(strategy: str, matched: int, new: int) -> dict[str, object]:
    return _stats("merge", new, matched if strategy == "update" else 0, matched if strategy == "delete_insert" else 0)


def touched_files(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> list[str]:
    """The files of the target that hold a key of the batch. Only key columns are read; as many names reach the driver as files are rewritten."""
    held = target.select(*[named(k) for k in keys], F.col("_metadata.file_path").alias("__file"))
    return [_plain(target.sparkSession, r["__file"]) for r in keyed_semi(held, batch, keys, "left_semi").select("__file").distinct().collect()]


def _merge_files(batch: DataFrame, target: DataFrame, table: str, keys: Sequence[str], strategy: str, parts: Sequence[str]) -> dict[str, object]:
    """Merge by rewriting the files that hold a key of the batch; new keys come as further files.

    The new files are written into a folder that readers do not see, together with the list of the files they replace, then moved
    in, and then the old ones go. What is cut off in between is finished before the next merge of the table reads it.
    """
    spark = batch.sparkSession
    folder = _location(spark, table)
    if _finish_merges(spark, folder):
        spark.catalog.refreshTable(table)
        target = spark.table(table)
    files = touched_files(target, batch, keys) if strategy != "ignore" else []
    held = spark.read.schema(target.schema).option("basePath", folder).parquet(*files) if files else target.where("false")
    held = merge_parts(held, batch, keys, strategy)[0]
    added = merge_parts(target, batch, keys, strategy)[1]
    held, hits = _counted(held, F.col(HIT))
    added, new = _counted(added)
    work = f"{folder.rstrip('/')}/{WORK}{uuid.uuid4().hex[:12]}"
    result = spread(after_merge(held, strategy).unionByName(added), parts)
    (result.write.partitionBy(*parts) if parts else result.write).parquet(f"{work}/new")
    spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.text(f"{work}/old")
    _finish_merges(spark, folder)
    if parts:
        spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")
    spark.catalog.refreshTable(table)
    return _merge_stats(strategy, hits.get["n"], new.get["n"])


def _finish_merges(spark: SparkSession, folder: str) -> bool:
    """Move in the files of merges that are completely written and delete those they replace; drop what is incomplete."""
    place, system = _path(spark, folder)
    waiting = [s.getPath() for s in system.listStatus(place) if s.getPath().getName().startswith(WORK)] if system.exists(place) else []
    for work in waiting:
        if system.exists(_path(spark, f"{work.toString()}/old/_SUCCESS")[0]):  # written last
            moved = system.listFiles(_path(spark, f"{work.toString()}/new")[0], True)
            while moved.hasNext():
                source = moved.next().getPath()
                if source.getName().endswith(".parquet"):
                    inside = source.toString().split("/new/", 1)[1]
                    goal = _path(spark, f"{folder.rstrip('/')}/{inside}")[0]
                    system.mkdirs(goal.getParent())
                    system.rename(source, goal)
            old = [r["value"] for r in spark.read.text(f"{work.toString()}/old").collect()]
            _remove_files(spark, old)
            for parent in {_path(spark, f)[0].getParent().toString() for f in old}:  # partitions without a file left
                left = _path(spark, parent)[0]
                if not left.equals(system.makeQualified(place)) and system.exists(left) and not len(system.listStatus(left)):
                    system.delete(left, False)
        system.delete(work, True)
    return bool(waiting)


def _touched(target: DataFrame, batch: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The target's rows in the partitions that the batch names; the join prunes the others' files when it runs."""
    values = batch.select(*[named(c).alias(f"__p{i}") for i, c in enumerate(parts)]).distinct()
    same = reduce(lambda a, b: a & b, [target[f"`{c}`"].eqNullSafe(values[f"__p{i}"]) for i, c in enumerate(parts)])
    return target.join(values, same, "left_semi")


def write_table(df: DataFrame, table: str, if_exists: str = "replace", all_varchar: bool = False) -> None:
    """Replace, append to, or create (``fail``) a table.

    An append keeps the columns both sides have, in the table's order. ``all_varchar`` writes text and first turns
    the other columns of an existing table into text.
    """
    if if_exists not in ("replace", "append", "fail"):
        raise ValueError(f"if_exists must be replace, append or fail, not {if_exists!r}")
    spark = df.sparkSession
    if all_varchar:
        df = df.select(*[named(c).cast("string").alias(c) for c in df.columns])
    exists = spark.catalog.tableExists(table)
    if if_exists == "replace" and exists:
        replace_contents(df, table)
    elif if_exists == "append" and exists:
        target = spark.table(table)
        if all_varchar and any(not isinstance(f.dataType, T.StringType) for f in target.schema.fields):
            replace_contents(target.select(*[named(c).cast("string").alias(c) for c in target.columns]), table)
            target = spark.table(table)
        aligned(df, target).write.insertInto(table)
    else:
        _create(df, table)
