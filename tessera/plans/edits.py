"""Queries on edit operations, batches, settings and versions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import edits
from tessera.plans.timeline import LINES, _log, _tracks
from tessera.sources.stored import written
from tessera.sources.tables import table

#: an order's clips with its number of clips and, where the order has an operation, z
CLIPS = f"""{LINES}, m AS (SELECT l_orderkey AS p, k, l_partkey AS asset, l_quantity AS q, 1 + l_discount * 10 AS v, count(*) OVER (PARTITION BY l_orderkey) AS n,
  round(coalesce(sum(l_quantity / (1 + l_discount * 10)) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS t,
  CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders) THEN l_orderkey END AS o FROM lines)"""


def _by_order(spark, sf_dir, choices: list[tuple[str, dict]], seq: int = 1) -> DataFrame:
    """An operation for each order, one of the choices in turn by its key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"))
    z = (F.col("project_id") % len(choices)).cast("int")
    kinds = F.get(F.array(*[F.lit(k) for k, _ in choices]), z)
    params = F.get(F.array(*[F.create_map(*[F.lit(x) for kv in p.items() for x in kv]) for _, p in choices]), z)
    return o.select("project_id", F.lit(seq).alias("seq"), kinds.alias("op_type"), params.alias("params"))


SETTING_OPS = [
    ("set_volume", {"clip": "c1", "volume": "0.4", "mute": "true", "fade_in_sec": "-1", "fade_out_sec": "2", "keyframes": '[{"time_sec":2,"volume":-1},{"time_sec":-1,"volume":0.5}]', "track_kind": "audio"}),
    ("set_transition", {"clip": "1", "type": "Dissolve", "duration_sec": "0.75"}),
    ("set_transition", {"clip": "1", "type": "none"}),
    ("rotate_clip", {"clip": "c1", "degrees": "90"}),
    ("rotate_clip", {"clip": "c1", "degrees": "45"}),
    ("flip_clip", {"clip": "01", "direction": "Horizontal"}),
    ("set_adjustments", {"clip": "c1", "brightness": "0.2", "preset": "Warm"}),
    ("crop_resize", {"clip": "1", "x": "1", "y": "2", "width": "30", "height": "40"}),
    ("add_text_overlay", {"text": "hi", "start_sec": "1", "style": "pop"}),
]


def v0_clip_settings(spark, sf_dir):
    out = edits.apply_round(_tracks(spark, sf_dir), _by_order(spark, sf_dir, SETTING_OPS))
    frame, text = F.get("keyframes", F.lit(0)), F.get("texts", F.lit(0))
    return out.select(
        "project_id", "clip_id", "volume", "mute", "fade_in_sec", "fade_out_sec", frame["time_sec"].alias("frame_sec"), frame["volume"].alias("frame_volume"), F.element_at("keyframes", -1)["volume"].alias("last_volume"), "transition", "transition_sec", "rotate", "flip", "brightness", "preset",
        F.col("crop.x").alias("crop_x"), F.col("crop.height").alias("crop_height"), text["text"].alias("text"), text["start_sec"].alias("text_sec"), text["duration_sec"].alias("text_duration"), text["style"].alias("style"),
    )


V0_SETTINGS = f"""WITH {CLIPS}, c AS (SELECT p, k, CASE WHEN k = 1 THEN o % 9 END AS z FROM m)
SELECT p AS project_id, 'c' || k AS clip_id, CASE WHEN z = 0 THEN 0.4 ELSE 1.0 END::DOUBLE AS volume, coalesce(z = 0, false) AS mute, 0.0::DOUBLE AS fade_in_sec, CASE WHEN z = 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS fade_out_sec,
  CASE WHEN z = 0 THEN 0.0 END::DOUBLE AS frame_sec, CASE WHEN z = 0 THEN 0.5 END::DOUBLE AS frame_volume, CASE WHEN z = 0 THEN 0.0 END::DOUBLE AS last_volume,
  CASE WHEN z = 1 THEN 'dissolve' END AS transition, CASE WHEN z = 1 THEN 0.75 END::DOUBLE AS transition_sec, CASE WHEN z = 3 THEN 90 ELSE 0 END AS rotate, CASE WHEN z = 5 THEN 'horizontal' END AS flip,
  CASE WHEN z = 6 THEN 0.2 ELSE 0.0 END::DOUBLE AS brightness, CASE WHEN z = 6 THEN 'Warm' END AS preset, CASE WHEN z = 7 THEN 1 END AS crop_x, CASE WHEN z = 7 THEN 40 END AS crop_height,
  CASE WHEN z = 8 THEN 'hi' END AS text, CASE WHEN z = 8 THEN 1.0 END::DOUBLE AS text_sec, CASE WHEN z = 8 THEN 2.0 END::DOUBLE AS text_duration, CASE WHEN z = 8 THEN 'pop' END AS style FROM c"""

PROJECT_OPS = [
    ("set_aspect_ratio", {"ratio": "16 : 9"}),
    ("set_aspect_ratio", {"ratio": "2:1"}),
    ("set_export_settings", {"resolution": "4k", "fps": "60", "quality": "max", "format": "webm"}),
    ("set_export_settings", {"resolution": "4k", "fps": "25"}),
    ("set_volume", {"volume": "-2", "mute": "true"}),
    ("set_volume", {"track_kind": "video", "solo": "true"}),
    ("crop_resize", {"clip": "1", "width": "300", "height": "400", "apply_to_resolution": "true"}),
    ("set_volume", {"track_kind": "overlay", "volume": "0.3"}),
]


def v0_project_settings(spark, sf_dir):
    projects = edits.default_projects(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id")))
    out = edits.apply_settings(projects, _by_order(spark, sf_dir, PROJECT_OPS))
    heard = F.array_join(F.transform("tracks", lambda t: F.concat_ws(" ", t.track, t.volume.cast("string"), t.mute.cast("string"), t.solo.cast("string"))), ",")
    return out.select("project_id", "width", "height", "fps", "export.format", "export.resolution", F.col("export.fps").alias("export_fps"), "export.quality", heard.alias("tracks"))


V0_PROJECT = """WITH c AS (SELECT o_orderkey AS project_id, o_orderkey % 8 AS z FROM orders)
SELECT project_id, CASE z WHEN 0 THEN 1920 WHEN 6 THEN 300 ELSE 1080 END AS width, CASE z WHEN 0 THEN 1080 WHEN 6 THEN 400 ELSE 1920 END AS height, 30 AS fps, CASE WHEN z = 2 THEN 'webm' ELSE 'mp4' END AS format,
  CASE WHEN z = 2 THEN '4k' ELSE '1080p' END AS resolution, CASE WHEN z = 2 THEN 60 ELSE 30 END AS export_fps, CASE WHEN z = 2 THEN 'max' ELSE 'high' END AS quality,
  'video 1.0 false ' || CASE WHEN z = 5 THEN 'true' ELSE 'false' END || CASE WHEN z = 4 THEN ',audio 0.0 true false' ELSE ',audio 1.0 false false' END || CASE WHEN z = 7 THEN ',overlay 0.3 false false' ELSE ',overlay 1.0 false false' END AS tracks FROM c"""

SECOND_OPS = [("trim_clip", {"clip": "1", "start_sec": "5", "end_sec": "2"}), ("delete_clip", {"clip": "99"}), ("dance", {"clip": "1"}), ("split_clip", {"clip": "1", "at_sec": "1.5"})]


def _batch(spark, sf_dir) -> DataFrame:
    first = _by_order(spark, sf_dir, [("set_speed", {"clip": "1", "speed": "2"})])
    last = _by_order(spark, sf_dir, [("set_volume", {"clip": "c1", "volume": "0.5"})], 3)
    return first.union(_by_order(spark, sf_dir, SECOND_OPS, 2)).union(last)


def v6_batches(spark, sf_dir):
    """Three operations of each order, of which the second often fails."""
    return edits.apply_batch(_tracks(spark, sf_dir), _batch(spark, sf_dir), 3, written)[1]


V6 = f"""WITH {LINES}, c AS (SELECT o_orderkey AS p, o_orderkey % 4 AS z, q FROM orders LEFT JOIN (SELECT l_orderkey, l_quantity AS q FROM lines WHERE k = 1) ON l_orderkey = o_orderkey),
e AS (SELECT p, z, CASE WHEN q IS NULL THEN 'no such clip' END AS e1, CASE z WHEN 0 THEN 'end before start' WHEN 1 THEN 'no such clip' WHEN 2 THEN 'unsupported operation' ELSE CASE WHEN q <= 1.5 THEN 'split outside the clip' END END AS e2 FROM c)
SELECT p AS project_id, 1 AS seq, 'set_speed' AS op_type, e1 AS error, e1 IS NULL AS applied FROM e
UNION ALL SELECT p, 2, ['trim_clip', 'delete_clip', 'dance', 'split_clip'][z + 1], CASE WHEN e1 IS NULL THEN e2 END, e1 IS NULL AND e2 IS NULL FROM e
UNION ALL SELECT p, 3, 'set_volume', NULL, e1 IS NULL AND e2 IS NULL FROM e"""


def v6_batch_results(spark, sf_dir):
    out = edits.apply_batch(_tracks(spark, sf_dir), _batch(spark, sf_dir), 3, written)[0]
    return out.select("project_id", "clip_id", "start_sec", "end_sec", F.round("speed", 6).alias("speed"), "volume")


V6_RESULTS = f"""WITH {CLIPS}, c AS (SELECT *, k = 1 AND o % 4 = 3 AND q > 1.5 AS halved, k = 1 AND o IS NOT NULL AS hit FROM m)
SELECT p AS project_id, 'c' || k AS clip_id, 0.0::DOUBLE AS start_sec, CASE WHEN halved THEN 1.5 ELSE q END AS end_sec, round(CASE WHEN hit THEN 2.0 ELSE v END, 6) AS speed, CASE WHEN halved THEN 0.5 ELSE 1.0 END::DOUBLE AS volume FROM c
UNION ALL SELECT p, 'c1''', 1.5, q, 2.0, 1.0 FROM c WHERE halved"""

ADD_OPS = [
    ("add_clip", {"asset_id": "900", "start_sec": "1", "duration_sec": "2"}),
    ("add_audio_track", {"asset_id": "901", "end_sec": "3"}),
    ("add_broll_clip", {"asset_id": "902", "start_sec": "2", "end_sec": "3.5", "opacity": "1.7"}),
    ("replace_video_track_clips", {"asset_id": "903", "ranges": '[{"start_sec":0,"end_sec":1.2},{"start_sec":2.5,"end_sec":4}]'}),
]


def v0_added_clips(spark, sf_dir):
    out = edits.apply_round(_tracks(spark, sf_dir), _by_order(spark, sf_dir, ADD_OPS))
    return out.select("project_id", "track", "clip_id", "asset_id", "start_sec", "end_sec", "timeline_start_sec", "mute", "opacity")


V0_ADDED = f"""WITH {CLIPS}, f AS (SELECT o_orderkey AS p, o_orderkey % 4 AS z, coalesce(fin, 0.0) AS fin, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT p, round(max(t + q / v), 3) AS fin, max(k) AS n FROM m GROUP BY p) e ON e.p = o_orderkey)
SELECT p AS project_id, 'video' AS track, 'c' || k AS clip_id, asset::VARCHAR AS asset_id, 0.0::DOUBLE AS start_sec, q AS end_sec, t AS timeline_start_sec, false AS mute, 1.0::DOUBLE AS opacity FROM m WHERE o IS NULL OR o % 4 <> 3
UNION ALL SELECT p, 'video', 'new-900-' || (n + 1), '900', 1.0, 3.0, fin, false, 1.0 FROM f WHERE z = 0
UNION ALL SELECT p, 'audio', 'new-901-' || (n + 1), '901', 0.0, 3.0, fin, false, 1.0 FROM f WHERE z = 1
UNION ALL SELECT p, 'overlay', 'new-902-' || (n + 1), '902', 2.0, 3.5, 2.0, true, 1.0 FROM f WHERE z = 2
UNION ALL SELECT p, 'video', 'range-' || i, '903', [0.0, 2.5][i], [1.2, 4.0][i], [0.0, 1.2][i], false, 1.0 FROM f, (SELECT unnest([1, 2]) AS i) WHERE z = 3"""

ORDER_OPS = [
    ("merge_clips", {"clips": "2, 1"}),
    ("reorder_clips", {"clip_order": "c2,nothing,c1"}),
    ("ripple_edit", {"track_kind": "video"}),
    ("move_clip", {"clip": "c1", "timeline_start_sec": "100000", "ripple": "true"}),
]


def v0_ordered_clips(spark, sf_dir):
    out = edits.apply_round(_tracks(spark, sf_dir), _by_order(spark, sf_dir, ORDER_OPS))
    return out.select("project_id", "clip_id", F.col("ord").cast("int").alias("ord"), "timeline_start_sec")


V0_ORDERED = f"""WITH {CLIPS}, w AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY CASE WHEN o % 4 IN (0, 1) AND k <= 2 AND n >= 2 THEN 3 - k WHEN o % 4 = 3 AND k = 1 THEN 1000 ELSE k END) AS ord FROM m)
SELECT p AS project_id, 'c' || k AS clip_id, CAST(ord AS INT) AS ord, round(coalesce(sum(q / v) OVER (PARTITION BY p ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS timeline_start_sec FROM w"""

OVERLAY_OPS = [
    ("move_broll_clip", {"clip": "1", "timeline_start_sec": "0.5"}),
    ("trim_broll_clip", {"clip": "c2", "start_sec": "0.5"}),
    ("delete_broll_clip", {"clip": "1", "ripple": "true"}),
    ("set_broll_opacity", {"clip": "c2", "opacity": "0.33333"}),
]


def v0_overlay_clips(spark, sf_dir):
    """Every second clip as an overlay."""
    clips = _tracks(spark, sf_dir).withColumn("track", F.when(F.col("ord") % 2 == 0, "overlay").otherwise("video"))
    out = edits.apply_round(clips, _by_order(spark, sf_dir, OVERLAY_OPS)).filter("track = 'overlay'")
    return out.select("project_id", "clip_id", F.col("ord").cast("int").alias("ord"), "start_sec", "end_sec", "timeline_start_sec", "opacity")


V0_OVERLAY = f"""WITH {CLIPS}, w AS (SELECT *, o % 4 AS z, row_number() OVER (PARTITION BY p ORDER BY k) AS ord, round(coalesce(sum(q / v) OVER (PARTITION BY p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS laid FROM m WHERE k % 2 = 0 AND NOT coalesce(o % 4 = 2 AND k = 2, false))
SELECT p AS project_id, 'c' || k AS clip_id, CAST(ord AS INT) AS ord, CASE WHEN z = 1 AND k = 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS start_sec, q AS end_sec,
  CASE WHEN z = 0 AND k = 2 THEN 0.5 WHEN z = 2 THEN laid ELSE t END AS timeline_start_sec, CASE WHEN z = 3 AND k = 2 THEN 0.333 ELSE 1.0 END::DOUBLE AS opacity FROM w"""


def k1_live_versions(spark, sf_dir):
    return edits.live_versions(_log(spark, sf_dir)).select("project_id", "version", "saved_seq", "is_head")


K1 = """WITH RECURSIVE l AS (SELECT o_custkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, CASE WHEN o_orderstatus = 'F' THEN 'undo' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'redo' ELSE 'save' END AS x FROM orders),
f AS (SELECT DISTINCT p, 0::BIGINT AS k, 0 AS h, 0 AS t, '' AS x FROM l
  UNION ALL SELECT f.p, l.k, CASE WHEN l.x = 'save' THEN h + 1 WHEN l.x = 'undo' AND h > 0 THEN h - 1 WHEN l.x = 'redo' AND h < t THEN h + 1 ELSE h END, CASE WHEN l.x = 'save' THEN h + 1 ELSE t END, l.x FROM f JOIN l ON l.p = f.p AND l.k = f.k + 1),
e AS (SELECT p, arg_max(h, k) AS head, arg_max(t, k) AS top FROM f GROUP BY p)
SELECT f.p AS project_id, f.h AS version, max(f.k) AS saved_seq, f.h = any_value(e.head) AS is_head FROM f JOIN e ON e.p = f.p WHERE f.x = 'save' AND f.h <= e.top GROUP BY f.p, f.h"""


def k1_saved(spark, sf_dir):
    """The large orders of each customer as saves on top of its log, with the operation that half of them name."""
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    op = F.when(F.col("o_orderkey") % 2 == 0, "trim_clip")
    saves = o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("state"), op.alias("op_type"), F.when(F.col("o_orderkey") % 4 == 0, "prompt").alias("source"), F.col("o_orderstatus").alias("payload"))
    return edits.saved(edits.versions(_log(spark, sf_dir)), saves)


def k1_dropped_versions(spark, sf_dir):
    log = _log(spark, sf_dir)
    saves = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("project_id"))
    return edits.dropped_versions(edits.live_versions(log).select("project_id", "version"), edits.versions(log), saves)


K1_HEADS = """l AS (SELECT o_custkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, CASE WHEN o_orderstatus = 'F' THEN 'undo' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'redo' ELSE 'save' END AS x FROM orders),
f AS (SELECT DISTINCT p, 0::BIGINT AS k, 0 AS h, 0 AS t FROM l
  UNION ALL SELECT f.p, l.k, CASE WHEN x = 'save' THEN h + 1 WHEN x = 'undo' AND h > 0 THEN h - 1 WHEN x = 'redo' AND h < t THEN h + 1 ELSE h END, CASE WHEN x = 'save' THEN h + 1 ELSE t END FROM f JOIN l ON l.p = f.p AND l.k = f.k + 1),
heads AS (SELECT p AS project_id, arg_max(h, k) AS head, arg_max(t, k) AS top FROM f GROUP BY p)"""
K1_SAVED = f"""WITH RECURSIVE {K1_HEADS}, s AS (SELECT o_custkey AS project_id, head + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderkey AS k, o_orderpriority, o_orderstatus FROM orders JOIN heads ON project_id = o_custkey WHERE o_totalprice > 200000)
SELECT 'version' AS kind, project_id, version, o_orderpriority AS state, NULL::VARCHAR AS op_type, NULL::VARCHAR AS source, NULL::VARCHAR AS payload FROM s
UNION ALL SELECT 'operation', project_id, version, NULL, 'trim_clip', CASE WHEN k % 4 = 0 THEN 'prompt' ELSE 'ui' END, o_orderstatus FROM s WHERE k % 2 = 0"""
K1_DROPPED = f"WITH RECURSIVE {K1_HEADS} SELECT project_id, unnest(range(head + 1, top + 1))::INT AS version FROM heads WHERE project_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"


def v7_undo_stacks(spark, sf_dir):
    """Stacks of four, so that some overflow."""
    log = _log(spark, sf_dir).withColumn("action", F.when(F.col("action") == "save", "change").otherwise(F.col("action")))
    return edits.undo_stack(log, 4).select("project_id", F.array_join("undo", ",").alias("undo"), F.array_join("redo", ",").alias("redo"))


V7 = """WITH RECURSIVE l AS (SELECT o_custkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, CASE WHEN o_orderstatus = 'F' THEN 'undo' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'redo' ELSE 'change' END AS x FROM orders),
f AS (SELECT DISTINCT p, 0::BIGINT AS k, []::BIGINT[] AS u, []::BIGINT[] AS r FROM l
  UNION ALL SELECT f.p, l.k, CASE WHEN x = 'change' THEN list_append(u, l.k)[-4:] WHEN x = 'undo' AND len(u) > 0 THEN u[1:len(u) - 1] WHEN x = 'redo' AND len(r) > 0 THEN list_append(u, r[-1]) ELSE u END,
    CASE WHEN x = 'change' THEN []::BIGINT[] WHEN x = 'undo' AND len(u) > 0 THEN list_append(r, u[-1]) WHEN x = 'redo' AND len(r) > 0 THEN r[1:len(r) - 1] ELSE r END FROM f JOIN l ON l.p = f.p AND l.k = f.k + 1)
SELECT p AS project_id, array_to_string(arg_max(u, k), ',') AS undo, array_to_string(arg_max(r, k), ',') AS redo FROM f GROUP BY p"""


def v5_default_timelines(spark, sf_dir):
    projects = edits.default_projects(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id")))
    return edits.states(projects, edits.new_clips(_tracks(spark, sf_dir)).limit(0))


V5 = """SELECT c_custkey AS project_id, '{"fps":30,"size":{"width":1080,"height":1920},"tracks":[{"kind":"video","clips":[],"volume":1.0,"mute":false,"solo":false},{"kind":"audio","clips":[],"volume":1.0,"mute":false,"solo":false},{"kind":"overlay","clips":[],"volume":1.0,"mute":false,"solo":false}],"duration_sec":0.0,"export_settings":{"format":"mp4","resolution":"1080p","fps":30,"quality":"high"}}' AS state FROM customer"""

QUERIES = {
    "v0_clip_settings": (v0_clip_settings, V0_SETTINGS),
    "v0_project_settings": (v0_project_settings, V0_PROJECT),
    "v0_added_clips": (v0_added_clips, V0_ADDED),
    "v0_ordered_clips": (v0_ordered_clips, V0_ORDERED),
    "v0_overlay_clips": (v0_overlay_clips, V0_OVERLAY),
    "v6_batches": (v6_batches, V6),
    "v6_batch_results": (v6_batch_results, V6_RESULTS),
    "k1_live_versions": (k1_live_versions, K1),
    "k1_saved": (k1_saved, K1_SAVED),
    "k1_dropped_versions": (k1_dropped_versions, K1_DROPPED),
    "v7_undo_stacks": (v7_undo_stacks, V7),
    "v5_default_timelines": (v5_default_timelines, V5),
}
