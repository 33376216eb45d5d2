"""Clips on tracks: ripple, layouts, the operations that edit them as a fold over a log, and its versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scan import before, kept_step, lag, scanned, so_far, spread


def clip_seconds(start: Column | str = "start_sec", end: Column | str = "end_sec", speed: Column | str = "speed") -> Column:
    """A clip's time on the timeline: its source time over its speed (a hundredth at least), never negative."""
    start, end, speed = (F.col(c) if isinstance(c, str) else c for c in (start, end, speed))
    return F.greatest((end - start) / F.greatest(speed, F.lit(0.01)), F.lit(0.0))


def rippled(clips: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Clips of a key one after the other in the given order, without gaps; only the shown starts are rounded."""
    rows = scanned(clips, order, {"_ago": before("sum", clip_seconds())}, key)
    return rows.withColumn("timeline_start_sec", F.round(F.coalesce("_ago", F.lit(0.0)), 3)).drop("_ago")


def relaid(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Source ranges as clips one after the other, by time."""
    rows = scanned(ranges, ["start_sec", "end_sec"], {"_ago": before("sum", F.col("end_sec") - F.col("start_sec"))}, keys)
    return rows.withColumn("timeline_start_sec", F.round(F.coalesce("_ago", F.lit(0.0)), 3)).drop("_ago")


def duration(clips: DataFrame, key: str) -> DataFrame:
    """key, duration_sec: where the last clip ends, rounded."""
    return clips.groupBy(key).agg(F.round(F.coalesce(F.max(F.col("timeline_start_sec") + clip_seconds()), F.lit(0.0)), 3).alias("duration_sec"))


def transition_layout(clips: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Starts of clips that overlap the one before by their transition: its length is raw_sec within [0, 45 % of the
    shorter of the two]. Each start is rounded before the next is added to it; as a start is whole milliseconds, that is
    rounding each step by itself, so starts are running sums of whole numbers, in slices of long keys. Halves of a
    millisecond go up, whatever their last bits."""
    rows = clips.select(F.col(key).alias("key"), *[c for c in order if c != key], "clip_id", clip_seconds().alias("_d"), F.coalesce("raw_sec", F.lit(0.0)).alias("_raw"))
    order = [*order, "clip_id"]
    rows = spread(rows, *order)
    rows = scanned(rows, order, {"_ago": lag("_d")})
    lap = F.when(F.col("_ago").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least("_raw", 0.45 * F.least("_ago.v", "_d"))))
    rows = rows.withColumn("transition_sec", lap)
    step = F.when(F.col("_ago").isNull(), F.lit(0)).otherwise(F.round((F.round(F.col("_ago.v") - F.col("transition_sec") + 1e-9, 3)) * 1000).cast("long"))
    rows = scanned(kept_step(rows.withColumn("_step", step).drop("_ago")), order, {"_sum": so_far("sum", "_step")})
    return rows.select(F.col("key").alias(key), "clip_id", (F.col("_sum") / 1000.0).alias("render_start_sec"), "transition_sec")
