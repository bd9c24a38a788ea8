"""Column lineage as rows: edges, direct dependants, and all ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.session import staged

def node_id(dataset: Column, column: Column) -> Column:
    return F.concat_ws(".", dataset, column)


def edges(records: DataFrame) -> DataFrame:
    """Edges (source, target, type) from records (dataset, column, transformation, upstream array of structs)."""
    up = F.col("up")
    return records.select("dataset", "column", "transformation", F.explode("upstream").alias("up")).select(
        node_id(up["dataset"], up["column"]).alias("source"),
        node_id(F.col("dataset"), F.col("column")).alias("target"),
        F.coalesce(F.col("transformation"), F.lit("unknown")).alias("type"),
    )


def nodes(records: DataFrame) -> DataFrame:
    """One node per dataset and one per column."""
    columns = records.select(
        node_id(F.col("dataset"), F.col("column")).alias("id"), F.lit("column").alias("type"),
        F.col("column").alias("label"), "dataset", "transformation",
    )
    datasets = records.select("dataset").distinct().select(
        F.col("dataset").alias("id"), F.lit("dataset").alias("type"), F.col("dataset").alias("label"), "dataset",
        F.lit(None).cast("string").alias("transformation"),
    )
    return datasets.unionByName(columns)


def downstream(edge_rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Direct dependants (target) of each node in ``starts`` (one column ``node``)."""
    return starts.join(edge_rows, F.col("node") == F.col("source")).select("node", F.col("target").alias("dependant"))


def upstream(edge_rows: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All ancestors of the nodes in ``starts`` (one column ``node``), as (node, ancestor, depth) with the smallest depth. Cycles end
    by themselves.

    Paths double in length with each round: what the starts reach in exactly that many steps goes on by all pairs up to as many steps
    apart, and so do these pairs themselves, so that the rounds grow with the logarithm of the depth and a join makes little more than
    its new pairs. Both are written in each round, so that neither the plan nor a lost executor's work grows.
    """
    step = edge_rows.select(F.col("target").alias("node"), F.col("source").alias("ancestor")).distinct().withColumn("depth", F.lit(1))
    jumps = staged(step)
    found = staged(jumps.join(starts.select("node").distinct(), "node", "left_semi"))
    reached, length = found.count(), 1
    while reached and (max_depth is None or length < max_depth):
        found = staged(_doubled(found, jumps, length, max_depth))
        before, reached = reached, found.count()
        if reached == before:  # no path is longer
            break
        length *= 2
        if max_depth is None or length < max_depth:
            jumps = staged(_doubled(jumps, jumps, length // 2, max_depth))
    return found


def _doubled(paths: DataFrame, jumps: DataFrame, length: int, max_depth: int | None) -> DataFrame:
    """The paths of up to ``length`` steps and those that a jump from their far ends makes longer; of each pair the shortest. A shortest path
    of more steps passes a node that is ``length`` steps away."""
    onward = jumps.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
    longer = paths.where(F.col("depth") == length).join(onward, "ancestor").select("node", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
    if max_depth is not None:
        longer = longer.where(F.col("depth") <= max_depth)
    return paths.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
