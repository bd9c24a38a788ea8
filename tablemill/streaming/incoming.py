"""Files that have not been read before: the file source as a stream, whose checkpoint remembers what it has seen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tablemill.sources.files import file_path
from tablemill.streaming.batches import Handler

FILES_PER_BATCH = 10_000


def take_new_files(
    spark: SparkSession,
    path: str,
    state: str,
    handle: Handler,
    *,
    schema: T.StructType | str,
    file_format: str = "json",
    pattern: str | None = None,
    recursive: bool = False,
    file_column: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
    options: Mapping[str, str] | None = None,
) -> int:
    """Hand the rows of all files below ``path`` that no earlier call with this ``state`` folder has taken to ``handle``, a bounded number
    of files at a time, and return how many batches there were.

    The checkpoint lists files as they are seen; no list reaches the caller. A call that is cut off goes on with the batch it was at,
    so handlers give the same result for a batch that comes again, as those of ``batches`` do. A changed file is not read again.
    """
    reader = spark.readStream.format(file_format).schema(schema).options(**(options or {}))
    reader = reader.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", str(recursive).lower())
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path)
    if file_column:
        rows = rows.select("*", file_path().alias(file_column))
    done: list[int] = []

    def counted(batch, epoch: int) -> None:
        handle(batch, epoch)
        done.append(epoch)

    rows.writeStream.foreachBatch(counted).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return len(done)
