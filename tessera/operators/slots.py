"""Slots and their overlays, and small relational steps of the editor: anchors, choices, tracks, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.intervals import met


def slot_texts(slots: DataFrame, words: DataFrame) -> DataFrame:
    """A slot's text: its anchor words in anchor order, else the words that overlap it, else its concept. Slots have
    slot_id, key, anchors (word ids), start_sec, end_sec and concept."""
    joined = lambda c: F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x.text), " "), F.lit(""))
    anchored = slots.select("slot_id", "key", F.posexplode("anchors").alias("at", "word_id")).join(words.select("key", "word_id", "text"), ["key", "word_id"])
    anchored = anchored.groupBy("slot_id").agg(joined(F.struct("at", "text")).alias("anchored"))
    spoken = words.select("key", "seq", "text", F.col("start_sec").alias("a_from"), F.col("end_sec").alias("a_to"))
    heard = met(spoken, slots.select("key", "slot_id", F.col("start_sec").alias("b_from"), F.col("end_sec").alias("b_to"))).filter("a_from < b_to and a_to > b_from")
    inside = heard.groupBy("slot_id").agg(joined(F.struct("seq", "text")).alias("inside"))
    return slots.join(anchored, "slot_id", "left").join(inside, "slot_id", "left").select("slot_id", F.coalesce("anchored", "inside", "concept").alias("text"))


def chosen_overlays(slots: DataFrame, candidates: DataFrame, assets: DataFrame) -> DataFrame:
    """Overlay clips of slots with a chosen candidate that has an asset; others have none."""
    rows = slots.filter("chosen_id is not null").join(candidates.select(F.col("candidate_id").alias("chosen_id"), "asset_id"), "chosen_id").join(assets.select("asset_id", "duration_sec"), "asset_id")
    return rows.select("slot_id", "asset_id", F.lit(0.0).alias("start_sec"), F.round(F.least(F.col("end_sec") - F.col("start_sec"), "duration_sec"), 3).alias("end_sec"), F.round("start_sec", 3).alias("timeline_start_sec"))


def slot_states(choices: DataFrame) -> DataFrame:
    """Each slot's status and chosen candidate by its last action: choose, reject (none chosen) or lock (as before)."""
    last = choices.filter(F.col("action").isin("choose", "reject")).groupBy("slot_id").agg(F.max_by(F.struct("action", "candidate_id"), "choice_id").alias("l"))
    locked = choices.groupBy("slot_id").agg(F.bool_or(F.col("action") == "lock").alias("locked"))
    chosen = F.col("l.action") == "choose"
    rows = locked.join(last, "slot_id", "left")
    return rows.select("slot_id", F.when(F.col("l").isNull(), "pending").when(chosen, "chosen").otherwise("rejected").alias("status"), F.when(chosen, F.col("l.candidate_id")).alias("candidate_id"), "locked")


def audible(tracks: DataFrame, clips: DataFrame) -> DataFrame:
    """Clips of the tracks that sound, with volume times track volume: if some track of a project is solo only those,
    else those that aren't muted. Muted clips have volume 0."""
    solos = tracks.groupBy("project_id").agg(F.bool_or("solo").alias("any_solo"))
    on = tracks.join(solos, "project_id").filter(F.when(F.col("any_solo"), F.col("solo")).otherwise(~F.col("mute"))).select("project_id", "track", F.col("volume").alias("track_volume"))
    return clips.join(on, ["project_id", "track"]).withColumn("volume", F.when(F.col("mute"), 0.0).otherwise(F.col("volume") * F.col("track_volume"))).drop("track_volume")


def block_toggled(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Words' deleted flag after toggling blocks (key, first_seq, last_seq): all of a block's words are deleted, unless
    all were; then none is. Blocks of a key don't overlap."""
    hit = words.join(blocks, "key", "left").filter("seq between first_seq and last_seq").groupBy("key", "first_seq", "last_seq").agg(F.bool_and("deleted").alias("all_deleted"))
    rows = words.join(hit.select(F.col("key").alias("k"), "first_seq", "last_seq", "all_deleted"), (F.col("key") == F.col("k")) & F.col("seq").between(F.col("first_seq"), F.col("last_seq")), "left")
    return rows.select("key", "seq", F.coalesce(~F.col("all_deleted"), "deleted").alias("deleted"))


def reusable(n_words: Column, least: Column, regenerate: Column) -> Column:
    """Whether a stored transcript serves: it has words, and enough of them if it may be made again."""
    return (n_words > 0) & (~regenerate | (n_words >= least))


def with_missing_assets(clips: DataFrame, wanted: DataFrame) -> DataFrame:
    """Clips (project_id, asset_id, start_sec, end_sec) with one of full length for each wanted asset that has none."""
    missing = wanted.join(clips.select("project_id", "asset_id"), ["project_id", "asset_id"], "left_anti")
    return clips.select("project_id", "asset_id", "start_sec", "end_sec").unionByName(missing.select("project_id", "asset_id", F.lit(0.0).alias("start_sec"), F.round("duration_sec", 3).alias("end_sec")))
