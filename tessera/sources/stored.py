"""Tables written between steps, so that plans stay short and a lost executor costs only the tasks it was running."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir. Only on local masters that don't set
    it, as in tests, a temporary one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df from a Parquet table in the shared folder."""
    path = f"{folder(df.sparkSession)}/tessera-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows of a task where a step holds them all, as sorting does
TASK_ROWS = 200_000


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys to as many tasks as its rows ask for, at least spark.sql.shuffle.partitions, so that what a task
    holds doesn't grow with the table. Rows are counted first. Sizes in bytes would mislead, as columns of equal values
    are nothing where they are shuffled and much where they are sorted."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)
