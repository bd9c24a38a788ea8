"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, **settings: str) -> SparkSession:
    """A session for tests and benches; a cluster passes its own session to the operators."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablemill")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's setting, or a fresh one on a local master.

    A machine-local folder would be lost with its executor, so a cluster without the setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if re.fullmatch(r"local(\[.*\])?", context.master) is None:  # local-cluster has executors with folders of their own
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    current = context.getCheckpointDir()
    if current is not None:
        return current
    folder = tempfile.mkdtemp(prefix="tablemill-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has written yet, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The frame, written below the shared folder and read back: computed once, with its lineage cut.

    Unlike ``checkpoint`` this does not compute the frame twice, and it stays columnar.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "staged")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the files of a ``staged`` frame that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if folder.getName().startswith("staged-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
