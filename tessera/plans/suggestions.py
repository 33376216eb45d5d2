"""Queries on suggested slots, automatic picks, replaced rows, responses and labels, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import numeric as num
from tessera.functions import text as tx
from tessera.operators import edits
from tessera.operators import suggestions as su
from tessera.operators import transcripts as ts
from tessera.plans.intervals import durations, rounded, words
from tessera.plans.segments import QUERIES as SEGMENTS
from tessera.plans.timeline import clips
from tessera.sources.stored import written
from tessera.sources.tables import sliced_words, table, unnumbered_words


def _assets(spark, sf_dir):
    """Parts as the media of conversations' projects."""
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 100).alias("project_id"), F.col("p_partkey").alias("asset_id"), F.concat("p_name", F.lit(".mp4")).alias("filename"), F.col("p_size").cast("double").alias("duration_sec"), F.col("p_retailprice").alias("created_at"), (F.col("p_partkey") % 7 == 0).alias("own"))


def _hits(slots):
    """What a provider might find: eight clips for each slot."""
    x = F.pmod(F.xxhash64("slot_id", "place"), F.lit(1000))
    return slots.select("slot_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("place")).select("slot_id", F.concat(F.lit("https://v.example.com/"), x.cast("string")).alias("url"), "place", F.lit(8).alias("total"), (x % 45).cast("double").alias("duration_sec"), (x + 400).cast("int").alias("width"), (x * 2).cast("int").alias("height"))


def r7_suggested(spark, sf_dir):
    """Candidates of all slots of conversations: chunks, concepts, local and provider scores, the mix, and the ranking."""
    slots = su.slots_of(sliced_words(table(spark, sf_dir, "conversations")), order=["segment", "i"])
    return su.candidates_of(slots, _assets(spark, sf_dir), _hits)


def r8_auto_applied(spark, sf_dir):
    slots = su.slots_of(sliced_words(table(spark, sf_dir, "conversations")), order=["segment", "i"])
    return su.overlays_of(su.chosen_of(su.candidates_of(slots, _assets(spark, sf_dir), _hits), slots, 0.4, fallback=True), 0.8)


def _given(spark, sf_dir):
    """Suppliers' parts as candidates of parts' slots, so that SQL has the same."""
    line = table(spark, sf_dir, "lineitem")
    slots = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slot_id"), F.col("p_size").alias("project_id"), F.col("p_size").cast("double").alias("start_sec"), (F.col("p_size") + F.col("p_retailprice") / 500).alias("end_sec"), (F.col("p_partkey") % 5 == 0).alias("locked"))
    best = line.groupBy(F.col("l_partkey").alias("slot_id"), F.col("l_suppkey").alias("s")).agg(F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("d"), F.max("l_quantity").alias("q"))
    rank = F.row_number().over(Window.partitionBy("slot_id").orderBy(F.desc("price"), "s"))
    return slots, best.select("slot_id", rank.alias("rank"), F.when(F.col("s") % 4 != 0, F.col("s")).alias("asset_id"), F.when(F.col("s") % 4 == 0, F.concat(F.lit("u"), F.col("s").cast("string"))).alias("url"), (F.col("d") * 10).alias("confidence"), (F.col("q") / 10).alias("duration_sec"))


GIVEN = """slots AS (SELECT p_partkey AS slot_id, p_size AS project_id, p_size::DOUBLE AS a, p_size + p_retailprice / 500 AS b, p_partkey % 5 = 0 AS locked FROM part),
best AS (SELECT l_partkey AS slot_id, l_suppkey AS s, max(l_extendedprice) AS price, max(l_discount) AS d, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
cand AS (SELECT slot_id, row_number() OVER (PARTITION BY slot_id ORDER BY price DESC, s) AS rank, CASE WHEN s % 4 <> 0 THEN s END AS asset_id, CASE WHEN s % 4 = 0 THEN 'u' || s END AS url, d * 10 AS c, q / 10 AS sec FROM best),
sure AS (SELECT slot_id, min(rank) AS r FROM cand WHERE c >= 0.78 GROUP BY slot_id),
pick AS (SELECT slots.*, cand.rank, cand.asset_id, cand.sec, cand.slot_id IS NOT NULL AND cand.asset_id IS NOT NULL AS ok, cand.slot_id IS NOT NULL AS has FROM slots LEFT JOIN sure USING (slot_id) LEFT JOIN cand ON cand.slot_id = slots.slot_id AND cand.rank = sure.r)"""


def r8_l4_choices(spark, sf_dir):
    slots, candidates = _given(spark, sf_dir)
    return su.chosen_of(candidates, slots).select("slot_id", "action", "rank", "asset_id", "reason")


R8 = f"WITH {GIVEN} SELECT slot_id, CASE WHEN ok THEN 'auto_choose' ELSE 'auto_skip' END AS action, CAST(CASE WHEN ok THEN rank END AS INT) AS rank, asset_id, CASE WHEN NOT has THEN 'no_candidate_over_threshold' WHEN NOT ok THEN 'materialize_failed' END AS reason FROM pick"


def r8_overlays(spark, sf_dir):
    slots, candidates = _given(spark, sf_dir)
    return su.overlays_of(su.chosen_of(candidates, slots), 0.7777)


R8_OVERLAYS = f"WITH {GIVEN} SELECT project_id, slot_id, asset_id, 0.0::DOUBLE AS start_sec, round(CASE WHEN sec > 0 THEN least(sec, greatest(b - a, 0.2)) ELSE greatest(b - a, 0.2) END, 3) AS end_sec, round(a, 3) AS timeline_start_sec, 0.778::DOUBLE AS opacity FROM pick WHERE ok"


def a11_counters(spark, sf_dir):
    slots, candidates = _given(spark, sf_dir)
    return su.counters(su.chosen_of(candidates, slots))


A11 = f"WITH {GIVEN} SELECT project_id, count(*) AS created_slots, count(*) FILTER (ok) AS auto_chosen_slots, count(*) FILTER (ok) AS synced_clip_count, count(*) FILTER (NOT ok) AS skipped_slots, CAST(count(*) FILTER (ok) > 0 AS INT) AS new_versions FROM pick GROUP BY project_id"


def r9_p17_rerolled(spark, sf_dir):
    """Candidates beyond the second that the slot hasn't shown among its first two, of slots that aren't locked."""
    slots, candidates = _given(spark, sf_dir)
    return su.rerolled(slots, candidates, candidates.filter("rank <= 2")).select("slot_id", "rank", "asset_id", "url")


R9 = f"WITH {GIVEN} SELECT slot_id, CAST(rank AS INT) AS rank, asset_id, url FROM cand WHERE rank > 2 AND slot_id NOT IN (SELECT slot_id FROM slots WHERE locked)"


def k2_k3_replaced(spark, sf_dir):
    """Orders as slots of customers' transcripts: those of urgent customers are written anew."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", 3).alias("duration_sec"))
    new = o.filter("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.round(F.sum("duration_sec"), 3).alias("duration_sec"))
    return su.replaced(o, new, ["o_custkey"])


K3 = """SELECT o_custkey, o_orderkey, round(o_totalprice, 3) AS duration_sec FROM orders WHERE o_custkey % 3 <> 0
UNION ALL SELECT o_custkey, max(o_orderkey), round(sum(round(o_totalprice, 3)), 3) FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey"""


def p15_responses(spark, sf_dir):
    slots, candidates = _given(spark, sf_dir)
    return su.responses(slots.select("slot_id", "project_id", "locked"), candidates.select("slot_id", "rank", "asset_id", "url"))


P15 = f"""WITH {GIVEN}, l AS (SELECT slot_id, string_agg('{{"rank":' || rank || CASE WHEN asset_id IS NULL THEN '' ELSE ',"asset_id":' || asset_id END || CASE WHEN url IS NULL THEN '' ELSE ',"url":"' || url || '"' END || '}}', ',' ORDER BY rank) AS c FROM cand GROUP BY slot_id)
SELECT slot_id, '{{"slot_id":' || slot_id || ',"project_id":' || project_id || ',"locked":' || CASE WHEN locked THEN 'true' ELSE 'false' END || ',"candidates":[' || coalesce(c, '') || ']}}' AS response FROM slots LEFT JOIN l USING (slot_id)"""


def a8_best_gap_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 4).alias("filled"), (F.col("o_orderkey") % 3).cast("double").alias("max_gap"), (F.col("o_orderkey") % 2).alias("n_words"))
    return su.best_gap_fill(o, "o_custkey")


A8 = """SELECT o_custkey, ord, filled FROM (SELECT o_custkey, o_orderkey AS ord, o_orderkey % 4 AS filled, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderkey % 3, o_orderkey % 2 DESC, o_orderkey) AS k FROM orders) WHERE k = 1"""


def a9_e12_subtitles(spark, sf_dir):
    """One-click subtitles of transcripts as one clip each: the number of captions."""
    w = unnumbered_words(table(spark, sf_dir, "conversations"))
    item = F.struct("segment", "i", "text", "start_sec", "end_sec")
    said = w.groupBy("key").agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x.text.alias("text"), x.start_sec.alias("start_sec"), x.end_sec.alias("end_sec")))).alias("words"))
    said = written(said)  # the round reads its operations several times
    video = durations(w).select(F.col("key").alias("project_id"), F.lit("video").alias("track"), F.lit(1).alias("ord"), F.lit("c1").alias("clip_id"), F.lit("a").alias("asset_id"), F.lit(0.0).alias("start_sec"), (F.col("duration_sec") + 1000.0).alias("end_sec"), F.lit(0.0).alias("timeline_start_sec"), F.lit(1.0).alias("speed"))
    ops = said.select(F.col("key").alias("project_id"), F.lit("set_subtitles").alias("op_type"), F.create_map(F.lit("words"), F.col("words")).alias("params"))
    out = edits.apply_round(edits.new_clips(video), ops)
    return out.filter("track = 'video'").groupBy(F.col("project_id").alias("key")).agg(F.sum(F.size("texts")).alias("captions"))


A9 = f"SELECT key, count(*) AS captions FROM ({SEGMENTS['w14_captions'][1]}) GROUP BY key"


def j2_overlay_assets(spark, sf_dir):
    """Lines as overlay clips: those whose part isn't there are left out."""
    assets = table(spark, sf_dir, "part").filter("p_size <> 7").select(F.col("p_partkey").alias("asset_id"), "p_name")
    return su.with_assets(clips(spark, sf_dir), assets, must=False).groupBy("p_name").agg(F.count("*").alias("n"), F.round(F.sum("end_sec"), 2).alias("seconds"))


J2 = "SELECT p_name, count(*) AS n, round(sum(l_quantity), 2) AS seconds FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <> 7 GROUP BY p_name"


def e10_rescued(spark, sf_dir):
    """Every third word of the events' transcripts as what was heard again in the long gaps of the others."""
    w = words(spark, sf_dir)
    primary = w.filter("text <> 'view'")
    windows = ts.rescue_windows(ts.iv.gaps(primary, durations(w), 50000.0), 30000.0, 12)
    heard = w.select("key", "seq", "text", F.col("start_sec").alias("s"), F.col("end_sec").alias("e"), "confidence").join(windows, "key").filter("s >= start_sec and e <= end_sec and seq % 3 = 0")
    heard = heard.select("key", "window", "seq", "text", (F.col("s") - F.col("start_sec")).alias("start_sec"), (F.col("e") - F.col("start_sec")).alias("end_sec"), "confidence")
    return rounded(ts.gap_rescued(primary, heard, durations(w), 50000.0, 30000.0, 12, 20.0), "key", "seq", "text").drop("seq")


def f7_f12_f20_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    quality = F.get(F.array(*map(F.lit, ("low", "medium", "high", "max", "odd"))), (F.col("p_partkey") % 5).cast("int"))
    return p.select(
        "p_partkey", tx.drawtext(F.concat(F.lit("it's 100%: ["), "p_name", F.lit("]; a\\b"))).alias("drawn"), tx.short_label(F.col("p_partkey") / 1000.0 + 0.0003).alias("short"), tx.fixed_label(F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") / 4.0)).alias("fixed"),
        num.looked_up(quality, num.CRF, 20).alias("crf"), num.looked_up(quality, num.PRESET, "medium").alias("preset"), num.looked_up(F.get(F.array(*map(F.lit, ("zoom", "wipe", "slide_up", "odd"))), (F.col("p_partkey") % 4).cast("int")), num.TRANSITION, "fade").alias("transition"),
        num.not_negative(F.when(F.col("p_partkey") % 3 == 0, F.lit("-1.5")).when(F.col("p_partkey") % 3 == 1, "x").otherwise(F.col("p_size").cast("string"))).alias("safe"),
    )


F7 = r"""SELECT p_partkey, 'its 100\%\: \[' || p_name || '\]\; a\\b' AS drawn, CASE WHEN p_partkey < 1000 THEN p_partkey || 'ms' ELSE printf('%.1f', p_partkey / 1000.0 + 0.0003) || 's' END AS short,
  CASE WHEN p_partkey % 9 <> 0 THEN printf('%.2f', p_size / 4.0) ELSE '0.00' END AS fixed, [30, 25, 20, 16, 20][p_partkey % 5 + 1] AS crf, ['ultrafast', 'veryfast', 'medium', 'slow', 'medium'][p_partkey % 5 + 1] AS preset,
  ['zoomin', 'wipeleft', 'slideup', 'fade'][p_partkey % 4 + 1] AS transition, CASE WHEN p_partkey % 3 = 2 THEN p_size::DOUBLE END AS safe FROM part"""

QUERIES = {
    "r7_suggested": (r7_suggested, None),
    "r8_auto_applied": (r8_auto_applied, None),
    "r8_l4_choices": (r8_l4_choices, R8),
    "r8_overlays": (r8_overlays, R8_OVERLAYS),
    "a11_counters": (a11_counters, A11),
    "r9_p17_rerolled": (r9_p17_rerolled, R9),
    "k2_k3_replaced": (k2_k3_replaced, K3),
    "p15_responses": (p15_responses, P15),
    "a8_best_gap_fill": (a8_best_gap_fill, A8),
    "a9_e12_subtitles": (a9_e12_subtitles, A9),
    "j2_overlay_assets": (j2_overlay_assets, J2),
    "e10_rescued": (e10_rescued, None),
    "f7_f12_f20_labels": (f7_f12_f20_labels, F7),
}
