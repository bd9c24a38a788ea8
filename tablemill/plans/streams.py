"""Queries that read a given table as a stream and run it to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators.chain import apply_chain
from tablemill.plans.merging import _MERGED, _catalog, target
from tablemill.plans.registry import query, table
from tablemill.session import scratch_path
from tablemill.streaming.batches import merge_batches
from tablemill.streaming.incoming import take_new_files
from tablemill.streaming.keyed import first_of_each, with_repeats


def _stream(spark, folder, name):
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query("stream_clean", """SELECT event_id, user_id, event_type, CAST(value AS FLOAT) AS value, 'stream' AS origin FROM events
 WHERE event_type IN ('click', 'purchase') AND value > 5""")
def stream_clean(spark, folder):
    """A chain of stateless operators on a stream, written as Parquet."""
    chained = apply_chain(_stream(spark, folder, "events"), [
        "normalize_headers", "drop_empty_rows",
        {"name": "filter", "rows": {"conditions": [{"column": "event_type", "operator": "in", "value": ["click", "purchase"]},
                                                   {"column": "value", "operator": ">", "value": 5}]},
         "columns": {"exclude": ["props", "ts"]}},
        {"name": "type_cast", "type_cast": {"value": "float32"}},
        {"name": "add_constants", "add_constants": {"origin": "stream"}},
    ])
    path = scratch_path(spark, "stream")
    chained.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(
        availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path).select("event_id", "user_id", "event_type", "value", "origin")


@query("stream_merge", _MERGED)
def stream_merge(spark, folder):
    """The merge of ``merge_update`` with its batch arriving as a stream."""
    name = f"{_catalog(spark)}.customers"
    target(spark, folder).write.saveAsTable(name)
    rows = _stream(spark, folder, "customer").where("c_nationkey >= 8")
    versions = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    batch = rows.withColumn("seq", F.explode(versions)).withColumn("c_acctbal", F.col("c_acctbal") + F.col("seq"))
    batch.writeStream.foreachBatch(merge_batches(name, ["c_custkey"], ["seq"])).option(
        "checkpointLocation", scratch_path(spark, "merge-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _in_batches(spark, folder, change, output):
    """The events, a part per micro-batch, through a keyed operator; a last event far ahead ends what still waits."""
    events = table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.to_date("ts").alias("day"))
    source, path, state = (scratch_path(spark, name) for name in ("events", "stream", "stream-state"))
    closing = events.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.to_date("ts").alias("day"))
    for part in (events.repartition(4), closing):  # the second run goes on from the first one's checkpoint
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        change(stream).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path).where("event_id >= 0").select(*output)


_KEY = ["user_id", "event_type", "day"]


@query("stream_unique", """SELECT event_id, user_id, event_type, COUNT(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) > 1 AS repeated FROM events""")
def stream_unique(spark, folder):
    """The unique check over all micro-batches: each event tells whether its user did the same on that day again."""
    return _in_batches(spark, folder, lambda s: with_repeats(s, _KEY, "ts", "100 days"), ["event_id", "user_id", "event_type", "repeated"])


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def stream_dedupe(spark, folder):
    """One event per user, kind and day over all micro-batches."""
    return _in_batches(spark, folder, lambda s: first_of_each(s, _KEY, "ts", "100 days"), _KEY)


@query("src_new_files", """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS run FROM orders""")
def src_new_files(spark, folder):
    """Two deliveries of JSON Lines in folders of their own; each run takes what is new, a third one nothing."""
    source, state, out = (scratch_path(spark, name) for name in ("incoming", "incoming-state", "taken"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    deliveries = [orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), None]
    for run, rows in enumerate(deliveries, 1):
        if rows is not None:
            rows.drop("o_orderstatus").repartition(3).write.json(f"{source}/delivery{run}")

        def keep(batch, epoch, run=run):
            batch.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        take_new_files(spark, source, state, keep, schema="o_orderkey long, o_totalprice double", pattern="*.json", recursive=True, files_per_batch=2)
    return spark.read.parquet(out).select("o_orderkey", "o_totalprice", "run")
