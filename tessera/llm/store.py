"""The shared folder: tables written to cut lineage, and files that tasks write for later tasks to read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only where that is unset, as in
    tests on local[n], a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later plans start from the files, so nothing is computed twice and
    a lost executor costs only the tasks it was running."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    # texts are long: the usual ten thousand rows a batch are too many for a Python worker beside the JVM
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(min(int(before or BATCH_ROWS), BATCH_ROWS)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """For tasks that stream bytes: the Arrow file system of a URI and the path within it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else ("file://" + uri.removeprefix("file:")))
