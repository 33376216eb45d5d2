"""From a transcript to overlays: slots, candidates, automatic picks and new rolls, each as one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import ranking as rk
from tessera.operators import segments
from tessera.sources.stored import dealt, written


def slots_of(words: DataFrame, least_words: int = 4, most: int | None = None, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Slots of whole transcripts (words of each key along order; if most is given, the first most of each): slot_id, project_id (the
    key), start_sec, end_sec, slot_sec, slot_text, concept, concepts and queries."""
    chunks = segments.slot_chunks(words, least_words, most, order=order)
    rows = tx.with_concepts(chunks.withColumnRenamed("text", "slot_text"), "slot_text").withColumn("concept", tx.concept_text(F.col("concepts")))
    queries = tx.expanded_queries(F.col("slot_text"), F.col("concept"), F.col("concepts"), tx.entities(F.col("slot_text")))
    # written, as what suggests to slots comes back to them
    return written(rows.select(
        F.concat_ws("/", "key", "chunk").alias("slot_id"), F.col("key").alias("project_id"), F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"),
        F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.1)).alias("slot_sec"), "slot_text", "concept", "concepts", queries.alias("queries"),
    ))


def candidates_of(slots: DataFrame, assets: DataFrame, hits: Callable[[DataFrame], DataFrame] | None, per_slot: int = 5, base: float = 0.42, rerank: bool = True) -> DataFrame:
    """Candidates of slots, per_slot at most: slot_id, rank, asset_id, url, score, confidence and duration_sec. assets:
    project_id, asset_id, filename, duration_sec, created_at and own (the transcript's own). hits gives what providers
    found for slots (slot_id, url, place, total, duration_sec, width, height); without it only assets are ranked.

    Names and durations ride along with the candidates, so that a slot's text is shuffled once, for the few that are left."""
    own = assets.filter("own").groupBy("project_id").agg(F.min("asset_id").alias("own_asset"))
    ranked = rk.local_scores(slots.join(own, "project_id", "left"), assets, per_slot)
    local = ranked.select("slot_id", "asset_id", F.lit(None).cast("string").alias("url"), "score", "rank", F.col("filename").alias("a_name"), "duration_sec")
    external = local.limit(0)
    if hits:
        # hits are dealt by slot before anything is joined to them: what follows keeps to these tasks
        found = dealt(hits(slots), "slot_id").join(slots.select("slot_id", "slot_sec").hint("merge"), "slot_id")
        longest = F.max("duration_sec").over(Window.partitionBy("slot_id", "url"))
        scored = rk.provider_scores(found.withColumn("longest", F.when(F.col("url").isNotNull(), longest)), base, per_slot, dealt_by_slot=True)
        external = scored.select("slot_id", F.lit(None).cast(dict(assets.dtypes)["asset_id"]).alias("asset_id"), "url", "score", "rank", F.lit(None).cast("string").alias("a_name"), F.col("longest").alias("duration_sec"))
    rows = written(rk.mixed(local, external, per_slot, "a_name", "duration_sec")).join(slots.hint("merge"), "slot_id")
    if not rerank:
        return rk.not_reranked(rows.withColumn("base", F.col("score"))).select("slot_id", "rank", "asset_id", "url", "score", "confidence", "duration_sec")
    said = tx.candidate_text(F.col("a_name"), F.when(F.col("source") == 0, "project_asset").otherwise("external"), F.col("concept"), F.col("url"), F.array().cast("array<string>"))
    terms = tx.tokens(F.col("a_name"))
    rows = rows.select("slot_id", "asset_id", "url", "rank", "slot_text", "concept", "concepts", "slot_sec", said.alias("text"), F.col("score").alias("base"), "duration_sec", F.filter("concepts", lambda t: F.array_contains(terms, t)).alias("keyword_hits"))
    again = F.row_number().over(Window.partitionBy("slot_id").orderBy(F.desc("score"), "before"))
    ranked = rk.reranked(rows).withColumnRenamed("rank", "before").withColumn("rank", again)
    return ranked.select("slot_id", "rank", "asset_id", "url", "score", "confidence", "duration_sec")


def chosen_of(candidates: DataFrame, slots: DataFrame, threshold: float = 0.78, fallback: bool = False) -> DataFrame:
    """What automatic picking does with each slot: slot_id, action (auto_choose, auto_skip), rank, asset_id and reason.
    The first candidate by rank that is confident enough is chosen, else the first of all if fallback; a slot whose pick
    has no asset is skipped, as its media isn't here."""
    threshold = max(0.0, min(1.0, threshold))
    item = F.struct("rank", "asset_id", "duration_sec")
    best = candidates.groupBy("slot_id").agg(F.min(F.when(F.col("confidence") >= threshold, item)).alias("sure"), F.min(item).alias("top"))
    pick = F.coalesce("sure", "top") if fallback else F.col("sure")
    rows = slots.select("slot_id", "project_id", "start_sec", "end_sec").join(best.select("slot_id", pick.alias("pick")), "slot_id", "left")
    reason = F.when(F.col("pick").isNull(), "no_candidate_over_threshold").when(F.col("pick.asset_id").isNull(), "materialize_failed")
    chosen = reason.isNull()
    return rows.select(
        "slot_id", "project_id", "start_sec", "end_sec", F.when(chosen, "auto_choose").otherwise("auto_skip").alias("action"), F.when(chosen, F.col("pick.rank")).alias("rank"), F.when(chosen, F.col("pick.asset_id")).alias("asset_id"),
        F.when(chosen, F.col("pick.duration_sec")).alias("duration_sec"), reason.alias("reason"),
    )


def overlays_of(chosen: DataFrame, opacity: float = 1.0) -> DataFrame:
    """Overlay clips of the chosen slots: a clip of the asset from its start, as long as the slot (0.2 s at least) or the
    asset, at the slot's start."""
    size = F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.2))
    long = F.when(F.col("duration_sec") > 0, F.least("duration_sec", size)).otherwise(size)
    return chosen.filter("action = 'auto_choose'").select("project_id", "slot_id", "asset_id", F.lit(0.0).alias("start_sec"), F.round(long, 3).alias("end_sec"), F.round("start_sec", 3).alias("timeline_start_sec"), F.lit(round(min(max(opacity, 0.0), 1.0), 3)).alias("opacity"))


def counters(chosen: DataFrame) -> DataFrame:
    """For each project: the slots, those chosen, those skipped, and the overlays that come of them; a project with an
    overlay gets one new version."""
    n = F.count_if(F.col("action") == "auto_choose")
    return chosen.groupBy("project_id").agg(F.count("*").alias("created_slots"), n.alias("auto_chosen_slots"), n.alias("synced_clip_count"), (F.count("*") - n).alias("skipped_slots"), (n > 0).cast("int").alias("new_versions"))


def rerolled(slots: DataFrame, fresh: DataFrame, shown: DataFrame) -> DataFrame:
    """New candidates of slots that aren't locked: those of fresh whose asset and URL the slot hasn't shown. What was
    chosen stays chosen. Slots have slot_id and locked."""
    return rk.not_shown(fresh.join(slots.filter("not locked").select("slot_id"), "slot_id", "left_semi"), shown)


def unlocked(slots: DataFrame) -> DataFrame:
    """The slots; a locked one fails the query."""
    return slots.filter(F.when(F.col("locked"), F.raise_error(F.concat(F.lit("slot is locked: "), F.col("slot_id").cast("string"))).cast("boolean")).otherwise(True))


def replaced(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """rows after new ones are written in place of all that have their keys."""
    return rows.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def with_assets(clips: DataFrame, assets: DataFrame, must: bool) -> DataFrame:
    """Clips with their assets' columns. A clip whose asset is missing fails the query if it must be there (the video
    track), and is left out otherwise (overlays, audio)."""
    if not must:
        return clips.join(assets, "asset_id")
    rows = clips.join(assets.withColumn("_there", F.lit(True)), "asset_id", "left")
    missing: Column = F.raise_error(F.concat(F.lit("no asset "), F.coalesce(F.col("asset_id").cast("string"), F.lit("null")))).cast("boolean")
    return rows.filter(F.coalesce(F.col("_there"), missing)).drop("_there")


def responses(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(slot_id, response): a slot and its candidates, best first, as the JSON document that a client gets. Both have
    slot_id; candidates have rank and are bounded for each slot."""
    item = F.struct("rank", *[c for c in candidates.columns if c not in ("slot_id", "rank")])
    lists = candidates.groupBy("slot_id").agg(F.sort_array(F.collect_list(item)).alias("candidates"))
    rows = slots.join(lists, "slot_id", "left")
    return rows.select("slot_id", F.to_json(F.struct(*slots.columns, F.coalesce("candidates", F.array()).alias("candidates"))).alias("response"))


def best_gap_fill(candidates: DataFrame, key: str) -> DataFrame:
    """For each key the candidate (ord, filled, max_gap, n_words) that fills most words, leaves the smallest gap, has
    most words, and comes first."""
    order = F.struct("filled", (-F.col("max_gap")).alias("g"), "n_words", (-F.col("ord")).alias("o"))
    return candidates.groupBy(key).agg(F.max_by("ord", order).alias("ord"), F.max("filled").alias("filled"))
