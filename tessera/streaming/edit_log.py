"""An edit log as a stream: operations are applied to the clips of their projects as they come.

Every micro-batch reads the clips that the last finished one left, applies its operations round by round, all projects at
once, and writes the clips and what became of each operation under its own number. A batch that was cut short is run
again by the stream under the same number and writes the same again, so a restart neither loses nor repeats an operation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators import edits
from tessera.sources.stored import written


def finished(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the batches that are written in whole, rising: outcomes come last, and are marked when complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/outcomes")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    there = [x.getPath() for x in fs.listStatus(path)]
    return sorted(int(p.getName().removeprefix("batch=")) for p in there if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current_clips(spark: SparkSession, folder: str, clips: DataFrame, before: int | None = None) -> DataFrame:
    """Clips after the last finished batch (of those before a number), else clips."""
    done = [n for n in finished(spark, folder) if before is None or n < before]
    return spark.read.schema(clips.schema).parquet(f"{folder}/clips/batch={done[-1]}") if done else clips


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of all operations of finished batches: project_id, op_id, op_type, error and batch."""
    done = finished(spark, folder)
    return spark.read.parquet(*[f"{folder}/outcomes/batch={n}" for n in done])


def _applied(clips: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips after the operations of a batch, and their outcomes. Each is a request of its own: one that can't be applied
    is refused, and those behind it go on."""
    order = F.row_number().over(Window.partitionBy("project_id").orderBy("op_id"))
    ops = written(ops.withColumn("seq", order))
    told = ops.select("project_id", "op_id", "op_type", F.lit(None).cast("string").alias("error")).limit(0)
    for k in range(1, (ops.agg(F.max("seq")).first()[0] or 0) + 1):
        now = ops.filter(F.col("seq") == k).drop("seq")
        wrong = written(edits.errors(clips, now))
        clips = written(edits.apply_round(clips, now.join(wrong, "project_id", "left_anti")))
        told = told.unionByName(now.select("project_id", "op_id", "op_type").join(wrong, "project_id", "left"))
    return clips, told


def follow(ops: DataFrame, clips: DataFrame, folder: str) -> DataStreamWriter:
    """A writer of the stream of operations (project_id, op_id, op_type, params), to be started with a checkpoint
    location. clips are those before the first. A project's operations of one batch are applied by op_id; one that comes
    in a later batch is applied then."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if number in finished(spark, folder):
            return
        left, told = _applied(current_clips(spark, folder, clips, number), rows)
        left.write.mode("overwrite").parquet(f"{folder}/clips/batch={number}")
        told.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")

    return ops.writeStream.foreachBatch(batch)
