"""``foreachBatch`` handlers. Each gives the same table when a micro-batch is replayed after a failure.

A stream writes in a session of its own; other sessions that have the table open refresh it before they read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from tablemill.operators.quality import Expectation, quarantine
from tablemill.sinks.tables import write_idempotent

Handler = Callable[[DataFrame, int], None]


def merge_batches(table: str, keys: Sequence[str], order_by: Sequence[str], strategy: str = "update",
                  partition_by: Sequence[str] = ()) -> Handler:
    """Merge each micro-batch into a table; the last row of a key wins within a batch."""

    def handle(batch: DataFrame, epoch: int) -> None:
        write_idempotent(batch, table, "merge", keys=keys, order_by=order_by, strategy=strategy,
                         partition_by=partition_by)

    return handle


def incremental_batches(table: str) -> Handler:
    """Append the rows of each micro-batch that the table does not hold."""

    def handle(batch: DataFrame, epoch: int) -> None:
        write_idempotent(batch, table, "incremental")

    return handle


def quarantine_batches(checks: Sequence[Expectation], clean: Handler, quarantine_path: str, run_id: str = "stream",
                       dataset: str = "unknown") -> Handler:
    """Send failing rows of each micro-batch to ``quarantine_path`` (one folder per epoch), the rest to ``clean``."""

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()  # both halves read it
        try:
            good, bad = quarantine(batch, checks, run_id, dataset)
            bad.write.mode("overwrite").parquet(f"{quarantine_path}/epoch={epoch}")
            clean(good, epoch)
        finally:
            batch.unpersist()

    return handle
