"""Edit operations on clips, as relational updates, and the version log.

Clips have project_id, track, ord (place in the track), clip_id, asset_id, start_sec, end_sec, timeline_start_sec,
speed and the settings in SETTINGS. A round takes at most one operation of each project and updates all projects'
clips at once; a log is applied by as many rounds as the longest project's has operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import segments
from tessera.operators.timeline import clip_seconds
from tessera.sources.stored import TASK_ROWS, dealt

#: settings of a clip and what it starts with
SETTINGS = {
    "volume": 1.0, "mute": False, "fade_in_sec": 0.0, "fade_out_sec": 0.0, "transition": None, "transition_sec": None, "rotate": 0, "flip": None,
    "brightness": 0.0, "contrast": 1.0, "saturation": 1.0, "exposure": 0.0, "temperature": 0.0, "preset": None, "opacity": 1.0, "texts": None,
    "keyframes": None, "crop": None,
}
KINDS = {
    "volume": "double", "mute": "boolean", "fade_in_sec": "double", "fade_out_sec": "double", "transition": "string", "transition_sec": "double", "rotate": "int",
    "flip": "string", "brightness": "double", "contrast": "double", "saturation": "double", "exposure": "double", "temperature": "double", "preset": "string",
    "opacity": "double", "texts": "array<struct<text:string,start_sec:double,duration_sec:double,style:string>>",
    "keyframes": "array<struct<time_sec:double,volume:double>>", "crop": "struct<x:int,y:int,width:int,height:int>",
}
RANGES = "array<struct<start_sec:double,end_sec:double>>"
CLIP = ["project_id", "track", "ord", "clip_id", "asset_id", "start_sec", "end_sec", "timeline_start_sec", "speed", *SETTINGS]
#: fixed values
ASPECTS = {"9:16": (1080, 1920), "16:9": (1920, 1080), "1:1": (1080, 1080), "4:5": (1080, 1350)}
OFF = ("none", "off", "clear", "")
STYLES = ("static", "pop", "bounce", "typewriter", "karaoke", "fade")
EXPORT = {"format": ("mp4", "mov", "webm"), "resolution": ("720p", "1080p", "4k"), "fps": ("24", "30", "60"), "quality": ("low", "medium", "high", "max")}
TRANSITIONS = ("fade", "dissolve", "slide_left", "slide_right", "slide_up", "slide_down", "zoom", "wipe")
ON_CLIPS = (
    "trim_clip", "split_clip", "delete_clip", "move_clip", "set_speed", "set_transition", "rotate_clip", "flip_clip", "set_adjustments", "crop_resize",
    "move_broll_clip", "trim_broll_clip", "delete_broll_clip", "set_broll_opacity",
)
OTHER_OPERATIONS = (
    "merge_clips", "reorder_clips", "add_clip", "add_audio_track", "add_broll_clip", "add_text_overlay", "replace_video_track_clips", "ripple_edit", "set_volume",
    "set_subtitles", "set_aspect_ratio", "set_export_settings", "import_media",
)


def new_clips(rows: DataFrame) -> DataFrame:
    """Rows with the settings of a new clip; settings that they have stay."""
    return rows.withColumns({k: F.lit(v).cast(KINDS[k]) for k, v in SETTINGS.items() if k not in rows.columns}).select(*CLIP)


def _p(name: str, kind: str = "string") -> Column:
    return F.col("params")[name].cast(kind)


def _is(*types: str) -> Column:
    return F.col("op_type").isin(*types)


def _kinds(ops: DataFrame) -> set[str]:
    """The operations that there are among ops, of those that are known: a round makes only what these need."""
    return {r.op_type for r in ops.filter(_is(*ON_CLIPS, *OTHER_OPERATIONS)).select("op_type").distinct().collect()}


def _with_hits(clips: DataFrame, ops: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """Clips with their project's operation, hit: that the operation is about this clip, and place: its place in its track
    by time. A clip is named by its id, or by its place among the video clips; operations on overlays look there. A volume
    looks on the track that it names first, and where that has no such clip, as others do."""
    kinds = _kinds(ops) if kinds is None else kinds
    # a row passes several sorts that a task holds at once. Places come before the join, whose order is by project then
    place = F.row_number().over(Window.partitionBy("project_id", "track").orderBy("timeline_start_sec", "ord"))
    rows = dealt(clips, "project_id", rows=TASK_ROWS // 2).withColumn("place", place.cast("string"))
    named, overlay = _p("clip"), _is("move_broll_clip", "trim_broll_clip", "delete_broll_clip", "set_broll_opacity")
    number = named.rlike("^[0-9]+$")
    wanted = ops.select(
        "project_id", "op_type", "params", F.when(number, F.regexp_replace(named, "^0+(?=.)", "")).alias("_place"), F.when(~number, named).alias("_clip"), F.when(overlay, "overlay").alias("_track"),
        F.when(_is("set_volume"), F.nullif(F.lower(F.trim(_p("track_kind"))), F.lit(""))).alias("_hint"), (named.isNull() & _is("add_text_overlay")).alias("_first"),
    )
    rows = rows.join(wanted, "project_id", "left")

    def found(track: str) -> Column:
        """Whether the clip is named, among those of track (null: any, or the video track for places)."""
        by_place = (F.col("place") == F.col("_place")) & (F.col("track") == F.coalesce(track, F.lit("video")))
        by_id = (F.col("clip_id") == F.col("_clip")) & (F.col(track).isNull() | (F.col("track") == F.col(track)))
        return F.coalesce(by_place, F.lit(False)) | F.coalesce(by_id, F.lit(False))

    hit = found("_track")
    if "set_volume" in kinds:
        rows = rows.withColumn("_hinted", found("_hint"))
        there = F.max(F.col("_hinted").cast("int")).over(Window.partitionBy("project_id")) == 1
        hit = F.when(F.col("_hint").isNotNull() & there, F.col("_hinted")).otherwise(hit)
    if "add_text_overlay" in kinds:
        hit = F.coalesce(F.col("_first") & (F.col("track") == "video") & (F.col("place") == "1"), F.lit(False)) | hit
    return rows.withColumn("hit", hit).drop("_place", "_clip", "_track", "_hint", "_first", "_hinted")


def apply_round(clips: DataFrame, ops: DataFrame) -> DataFrame:
    """Clips after one operation of each project (project_id, op_type, params: map of strings). An operation that
    names no clip of its track or breaks a rule (an end before its start, a split outside the clip) changes nothing;
    errors() tells which. Operations on a project's settings are apply_settings'.

    A clip is named by its id, or by its place among the video clips (or those of the track that params name), by
    time. Deleting ripples the track, as do merging and reordering unless told not to. What no operation of the round
    needs isn't made: most change a column of a clip, and few sort a track."""
    kinds = _kinds(ops)
    on = lambda *types: not kinds.isdisjoint(types)
    rows = _with_hits(clips, ops, kinds).drop("place")

    def put(name: str, value: Column, *types: str, given: str | None = None) -> Column:
        """The column with value where a named clip's operation of these types sets it."""
        asked = F.col("hit") & _is(*types) & (F.lit(True) if given is None else _p(given).isNotNull())
        return F.when(asked, value).otherwise(F.col(name))

    trim = F.col("hit") & _is("trim_clip", "trim_broll_clip")
    a, b = F.round(F.coalesce(_p("start_sec", "double"), "start_sec"), 3), F.round(F.coalesce(_p("end_sec", "double"), "end_sec"), 3)
    moved = F.round(F.coalesce(_p("timeline_start_sec", "double"), "timeline_start_sec"), 3)
    off = lambda x: F.when(F.lower(x).isin(*OFF), None).otherwise(F.lower(x))
    own_track = F.when(F.col("hit") & _is("move_clip"), F.coalesce(_p("track_kind"), "track")).otherwise(F.col("track"))
    opacity = F.coalesce(_p("opacity", "double"), _p("broll_opacity", "double"))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))
    text = F.struct(_p("text").alias("text"), _p("start_sec", "double").alias("start_sec"), F.coalesce(_p("duration_sec", "double"), F.lit(2.0)).alias("duration_sec"), F.coalesce(_p("style"), F.lit("static")).alias("style"))
    frame = lambda x: F.struct(F.greatest(F.coalesce(x.time_sec, F.lit(0.0)), F.lit(0.0)).alias("time_sec"), F.greatest(F.coalesce(x.volume, F.lit(1.0)), F.lit(0.0)).alias("volume"))
    frames = F.array_sort(F.transform(F.from_json(_p("keyframes"), KINDS["keyframes"]), frame))
    box = F.struct(*[_p(k, "int").alias(k) for k in ("x", "y", "width", "height")])
    boxed = F.lit(True)
    for k in ("x", "y", "width", "height"):
        boxed = boxed & _p(k).isNotNull()
    settings = {
        ("move_clip",): {"track": own_track},
        ("trim_clip", "trim_broll_clip"): {
            "start_sec": F.when(trim & (b > a), a).otherwise(F.col("start_sec")),
            "end_sec": F.when(trim & (b > a), b).otherwise(F.col("end_sec")),
        },
        ("move_clip", "move_broll_clip"): {"timeline_start_sec": put("timeline_start_sec", moved, "move_clip", "move_broll_clip")},
        ("set_speed",): {"speed": put("speed", F.greatest(F.lit(0.25), F.least(_p("speed", "double"), F.lit(4.0))), "set_speed")},
        ("set_volume",): {
            "volume": put("volume", _p("volume", "double"), "set_volume", given="volume"),
            "mute": put("mute", _p("mute", "boolean"), "set_volume", given="mute"),
            "fade_in_sec": put("fade_in_sec", F.greatest(F.lit(0.0), _p("fade_in_sec", "double")), "set_volume", given="fade_in_sec"),
            "fade_out_sec": put("fade_out_sec", F.greatest(F.lit(0.0), _p("fade_out_sec", "double")), "set_volume", given="fade_out_sec"),
            "keyframes": put("keyframes", frames, "set_volume", given="keyframes"),
        },
        ("set_transition",): {
            "transition": put("transition", off(F.coalesce(_p("type"), F.lit("fade"))), "set_transition"),
            "transition_sec": put("transition_sec", F.when(~F.lower(F.coalesce(_p("type"), F.lit("fade"))).isin(*OFF), F.coalesce(_p("duration_sec", "double"), F.lit(0.5))), "set_transition"),
        },
        ("rotate_clip",): {"rotate": F.when(F.col("hit") & _is("rotate_clip") & _p("degrees", "int").isin(0, 90, 180, 270), _p("degrees", "int")).otherwise(F.col("rotate"))},
        ("flip_clip",): {"flip": F.when(F.col("hit") & _is("flip_clip") & F.lower(_p("direction")).isin("horizontal", "vertical", "none", "off", "clear"), off(_p("direction"))).otherwise(F.col("flip"))},
        ("crop_resize",): {"crop": F.when(F.col("hit") & _is("crop_resize") & boxed, box).otherwise(F.col("crop"))},
        ("set_broll_opacity",): {"opacity": F.when(F.col("hit") & _is("set_broll_opacity") & opacity.isNotNull(), F.round(unit(opacity), 3)).otherwise(F.col("opacity"))},
        ("add_text_overlay",): {"texts": put("texts", F.concat(F.coalesce("texts", F.array().cast(KINDS["texts"])), F.array(text)), "add_text_overlay")},
        ("set_adjustments",): {
            "preset": put("preset", F.when(~F.lower(_p("preset")).isin(*OFF), _p("preset")), "set_adjustments", given="preset"),
            **{c: put(c, _p(c, "double"), "set_adjustments", given=c) for c in ("brightness", "contrast", "saturation", "exposure", "temperature")},
        },
    }
    rows = rows.withColumns({name: value for types, columns in settings.items() if on(*types) for name, value in columns.items()})

    # a split clip becomes two: at a time within its source, else at a time on the timeline
    rows = rows.withColumn("half", F.lit(0))
    if on("split_clip"):
        at = _p("at_sec", "double")
        within = F.when((at > F.col("start_sec")) & (at < F.col("end_sec")), at).otherwise(F.col("start_sec") + (at - F.col("timeline_start_sec")) * F.col("speed"))
        rows = rows.withColumn("cut", F.when(F.col("hit") & _is("split_clip") & (within > F.col("start_sec")) & (within < F.col("end_sec")), F.round(within, 3)))
        rows = rows.withColumn("half", F.explode(F.when(F.col("cut").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        right = F.col("half") == 1
        later = F.round(F.col("timeline_start_sec") + clip_seconds("start_sec", "cut", "speed"), 3)
        rows = rows.withColumns(
            {
                "timeline_start_sec": F.when(right, later).otherwise(F.col("timeline_start_sec")),
                "clip_id": F.when(right, F.concat("clip_id", F.lit("'"))).otherwise(F.col("clip_id")),
                "end_sec": F.when(F.col("cut").isNotNull() & ~right, F.col("cut")).otherwise(F.col("end_sec")),
                "start_sec": F.when(right, F.col("cut")).otherwise(F.col("start_sec")),
            }
        )
    track = Window.partitionBy("project_id", "track")
    if on("delete_clip", "delete_broll_clip"):
        deleted = F.col("hit") & _is("delete_clip", "delete_broll_clip")
        rows = rows.withColumn("lost", F.max(deleted.cast("int")).over(track) == 1).filter(~F.coalesce(deleted, F.lit(False)))
    else:
        rows = rows.withColumn("lost", F.lit(False))
    if on("replace_video_track_clips"):
        replaced = _is("replace_video_track_clips") & ((F.col("track") == "video") | ((F.col("track") == "audio") & F.coalesce(_p("clear_audio_tracks", "boolean"), F.lit(False))))
        rows = rows.filter(~F.coalesce(replaced, F.lit(False)))
    by_place = F.row_number().over(track.orderBy("ord", "half"))
    if on("delete_clip", "delete_broll_clip", "merge_clips", "reorder_clips", "move_clip", "move_broll_clip", "ripple_edit"):
        rows = _laid_out(rows, track, by_place)
    else:
        rows = rows.withColumn("ord", by_place)
    rows = rows.select(*CLIP)
    rows = _captioned(rows, ops) if on("set_subtitles") else rows
    if not on("add_clip", "add_audio_track", "add_broll_clip", "replace_video_track_clips"):
        return rows
    # new clips are dealt by their own ids, so that no later join relies on both sides of the union being dealt alike, which
    # adaptive execution may change on one side only
    return rows.unionByName(_added(clips, ops).repartition("clip_id"))


def _laid_out(rows: DataFrame, track: Window, by_place: Column) -> DataFrame:
    """Clips (of halves, with their operation, and lost: that their track lost one) in their order within the track: listed
    clips first for a reorder, merged ones together from the first's start; and laid out anew where that ripples."""
    listed = F.split(F.coalesce(_p("clip_order"), _p("clips"), F.lit("")), r"[,\s]+")
    places = F.row_number().over(Window.partitionBy("project_id", "track").orderBy("timeline_start_sec", "ord", "half")).cast("string")
    listing = F.when(_is("merge_clips"), F.when(F.col("track") == "video", F.greatest(F.array_position(listed, places), F.array_position(listed, F.col("clip_id"))))).when(_is("reorder_clips"), F.when(F.col("track") == F.coalesce(_p("track_kind"), F.lit("video")), F.array_position(listed, F.col("clip_id"))))
    rows = rows.withColumn("listed", F.when(listing > 0, listing))
    rows = rows.withColumn("n_listed", F.count("listed").over(track))
    merge = _is("merge_clips") & (F.col("n_listed") >= 2) & F.col("listed").isNotNull()
    begin = F.min(F.when(F.col("listed").isNotNull(), F.col("timeline_start_sec"))).over(track)
    together = F.coalesce(F.sum(F.when(F.col("listed").isNotNull(), clip_seconds())).over(track.orderBy(F.asc_nulls_last("listed")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("timeline_start_sec", F.when(merge, F.round(begin + together, 3)).otherwise(F.col("timeline_start_sec")))
    reorder = _is("reorder_clips") & (F.col("n_listed") > 0)
    by = [F.when(reorder, F.coalesce("listed", F.lit(1 << 30))).otherwise(0), F.when(reorder, F.col("ord").cast("double")).otherwise(F.col("timeline_start_sec")), F.when(F.col("listed").isNotNull(), 1).otherwise(0), F.col("ord"), F.col("half")]
    sorted_now = reorder | (_is("merge_clips") & (F.col("n_listed") >= 2)) | F.coalesce(F.col("lost"), F.lit(False)) | _is("move_clip", "move_broll_clip", "ripple_edit")
    rows = rows.withColumns({"by_time": F.row_number().over(track.orderBy(*by)), "by_place": by_place})
    rows = rows.withColumn("ord", F.when(F.coalesce(sorted_now, F.lit(False)), F.col("by_time")).otherwise(F.col("by_place")))
    wish = lambda name, default: F.coalesce(_p(name, "boolean"), F.lit(default))
    touched = F.max(F.col("hit").cast("int")).over(track) == 1
    ripple = (
        (F.col("lost") & (_is("delete_clip") | wish("ripple", False)))
        | (_is("merge_clips") & (F.col("n_listed") >= 2) & wish("gapless", True))
        | (reorder & wish("ripple", True))
        | (_is("ripple_edit") & (F.col("track") == F.coalesce(_p("track_kind"), F.lit("video"))))
        | (_is("move_clip") & touched & wish("ripple", False))
    )
    laid = F.round(F.coalesce(F.sum(clip_seconds()).over(track.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 3)
    return rows.withColumn("timeline_start_sec", F.when(F.coalesce(ripple, F.lit(False)), laid).otherwise(F.col("timeline_start_sec")))


def _captioned(clips: DataFrame, ops: DataFrame) -> DataFrame:
    """Clips after set_subtitles: the video clips (of an asset, if the operation names one) get captions of the words
    that overlap them; overlays that were there go first, on all video clips, unless told not to."""
    item = "array<struct<text:string,start_sec:double,end_sec:double>>"
    number = lambda name, default, low, high=None: (lambda x: x if high is None else F.least(x, F.lit(high)))(F.greatest(F.coalesce(_p(name, "double"), F.lit(float(default))), F.lit(float(low))))
    mine = ops.filter(_is("set_subtitles")).select(
        "project_id", F.nullif(F.trim(_p("asset_id")), F.lit("")).alias("of_asset"), F.coalesce(_p("clear_existing", "boolean"), F.lit(True)).alias("clear"), F.from_json(_p("words"), item).alias("said"),
        number("max_words_per_caption", 3, 1, 8.0).cast("int").alias("most_words"), number("max_chars_per_caption", 42, 10, 80.0).cast("int").alias("most_chars"), number("max_gap_sec", 0.55, 0.05).alias("gap"),
        F.when(F.lower(F.trim(_p("style"))).isin(*STYLES), F.lower(F.trim(_p("style")))).otherwise("karaoke").alias("style"),
    ).filter(F.size("said") > 0)
    if mine.isEmpty():  # captions are walked, which takes jobs of its own
        return clips
    video = clips.filter("track = 'video'").join(mine, "project_id").filter("of_asset is null or of_asset = asset_id")
    heard = video.select(F.struct("project_id", "clip_id").alias("key"), "start_sec", "end_sec", "most_words", "most_chars", "gap", F.posexplode("said").alias("seq", "w"))
    heard = heard.filter((F.coalesce(F.col("w.end_sec"), F.lit(0.0)) > F.col("start_sec")) & (F.coalesce(F.col("w.start_sec"), F.lit(0.0)) < F.col("end_sec")))
    spoken = heard.select("key", "seq", "most_words", "most_chars", "gap", F.col("w.text").alias("text"), F.greatest(F.coalesce(F.col("w.start_sec"), F.lit(0.0)), "start_sec").alias("start_sec"), F.least(F.coalesce(F.col("w.end_sec"), F.lit(0.0)), "end_sec").alias("end_sec"))
    made = segments.captions(spoken, "most_words", "most_chars", "gap").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("caption", "text", "start_sec", "duration_sec"))).alias("made"))
    made = made.select(F.col("key.project_id").alias("project_id"), F.col("key.clip_id").alias("clip_id"), "made")
    rows = clips.join(mine.select("project_id", "clear", "style"), "project_id", "left").join(made, ["project_id", "clip_id"], "left")
    placed = F.transform("made", lambda c: F.struct(c.text.alias("text"), F.round(F.greatest(c.start_sec - F.col("start_sec"), F.lit(0.0)), 3).alias("start_sec"), c.duration_sec.alias("duration_sec"), F.col("style").alias("style")))
    none = F.array().cast(KINDS["texts"])
    on = F.col("clear").isNotNull() & (F.col("track") == "video")
    old = F.when(F.col("clear"), none).otherwise(F.coalesce("texts", none))
    return rows.withColumn("texts", F.when(on, F.concat(old, F.coalesce(placed, none))).otherwise(F.col("texts"))).select(*CLIP)


def default_projects(projects: DataFrame) -> DataFrame:
    """What a new project (project_id, and width, height and fps if given) starts with: a size, export settings, and a
    video, an audio and an overlay track at full volume; version 0 and no clips."""
    given = {k: F.coalesce(F.col(k), F.lit(v)).cast("int") if k in projects.columns else F.lit(v) for k, v in (("width", 1080), ("height", 1920), ("fps", 30))}
    track = lambda k: F.struct(F.lit(k).alias("track"), F.lit(1.0).alias("volume"), F.lit(False).alias("mute"), F.lit(False).alias("solo"))
    export = F.struct(F.lit("mp4").alias("format"), F.lit("1080p").alias("resolution"), F.lit(30).alias("fps"), F.lit("high").alias("quality"), F.lit(None).cast("string").alias("bitrate"))
    return projects.select("project_id", *[c.alias(k) for k, c in given.items()], export.alias("export"), F.array(track("video"), track("audio"), track("overlay")).alias("tracks"))


def apply_settings(projects: DataFrame, ops: DataFrame) -> DataFrame:
    """Projects (as default_projects makes them) after one operation of each that is about settings: the aspect ratio,
    a crop that is applied to the project's size, export settings, or a track's volume, mute and solo. Others, and
    those that errors() names, change nothing."""
    rows = projects.join(ops.select("project_id", "op_type", "params"), "project_id", "left")
    ratio = F.when(_is("set_aspect_ratio"), F.replace(_p("ratio"), F.lit(" "), F.lit("")))
    sized = _is("crop_resize") & _p("width").isNotNull() & _p("height").isNotNull() & F.coalesce(_p("apply_to_resolution", "boolean"), F.lit(False))
    size = {}
    for i, side in enumerate(("width", "height")):
        value = F.when(F.coalesce(sized, F.lit(False)), _p(side, "int"))
        for name, pixels in ASPECTS.items():
            value = F.when(ratio == name, F.lit(pixels[i])).otherwise(value)
        size[side] = F.coalesce(value, side)
    export = _is("set_export_settings") & _export_ok()
    kept = {k: F.when(export & _p(k).isNotNull(), _p(k)).otherwise(F.col(f"export.{k}").cast("string")) for k in (*EXPORT, "bitrate")}
    field = lambda k: (kept[k].cast("int") if k == "fps" else kept[k]).alias(k)
    loud = F.coalesce(_is("set_volume") & _p("clip").isNull(), F.lit(False))
    kind = F.coalesce(_p("track_kind"), F.lit("audio"))
    fresh = F.struct(kind.alias("track"), F.lit(1.0).alias("volume"), F.lit(False).alias("mute"), F.lit(False).alias("solo"))
    known = F.exists("tracks", lambda t: t.track == kind)
    tracks = F.when(loud & ~known, F.concat("tracks", F.array(fresh))).otherwise(F.col("tracks"))

    def heard(t: Column) -> Column:
        volume = F.coalesce(F.greatest(_p("volume", "double"), F.lit(0.0)), t.volume)
        new = F.struct(t.track.alias("track"), F.when(_p("volume").isNotNull(), volume).otherwise(t.volume).alias("volume"), F.coalesce(_p("mute", "boolean"), t.mute).alias("mute"), F.coalesce(_p("solo", "boolean"), t.solo).alias("solo"))
        return F.when(loud & (t.track == kind), new).otherwise(t)

    return rows.select("project_id", size["width"].alias("width"), size["height"].alias("height"), "fps", F.struct(*[field(k) for k in (*EXPORT, "bitrate")]).alias("export"), F.transform(tracks, heard).alias("tracks"))


def _export_ok() -> Column:
    ok = F.lit(True)
    for k, values in EXPORT.items():
        ok = ok & F.coalesce(_p(k).isin(*values), F.lit(True))
    return ok


def errors(clips: DataFrame, ops: DataFrame) -> DataFrame:
    """(project_id, error) of the operations, one of each project, that can't be applied."""
    kinds = _kinds(ops)
    rows = _with_hits(clips, ops, kinds)
    listed = F.array_distinct(F.filter(F.split(F.coalesce(_p("clips"), F.lit("")), r"[,\s]+"), lambda x: x != ""))
    merged = _is("merge_clips") & (F.col("track") == "video") & (F.array_contains(listed, F.col("place")) | F.array_contains(listed, F.col("clip_id")))
    seen = rows.groupBy("project_id").agg(
        F.max("hit").alias("hit"),
        F.count_if(F.col("track") == "video").alias("n_video"),
        (F.count_if(F.coalesce(merged, F.lit(False))) if "merge_clips" in kinds else F.lit(0)).alias("n_merged"),
        *[F.max(F.when(F.col("hit"), F.col(c))).alias(f"c_{c}") for c in ("start_sec", "end_sec", "timeline_start_sec", "speed")],
    )
    rows = ops.join(seen, "project_id", "left")
    at = _p("at_sec", "double")
    within = F.when((at > F.col("c_start_sec")) & (at < F.col("c_end_sec")), at).otherwise(F.col("c_start_sec") + (at - F.col("c_timeline_start_sec")) * F.col("c_speed"))
    hit = F.coalesce("hit", F.lit(False))
    trimmed = [F.coalesce(_p(k, "double"), F.when(_is("trim_broll_clip"), F.col(f"c_{k}"))) for k in ("start_sec", "end_sec")]
    start = F.coalesce(_p("start_sec", "double"), F.lit(0.0))
    end = F.coalesce(_p("end_sec", "double"), start + F.when(_p("duration_sec", "double") > 0, _p("duration_sec", "double")))
    few = lambda c: F.coalesce(c, F.lit(False))
    no = lambda c: ~few(c)
    rules = [
        ((*ON_CLIPS, "set_volume", "add_text_overlay"), (_is(*ON_CLIPS) | (_is("set_volume", "add_text_overlay") & _p("clip").isNotNull())) & ~hit, "no such clip"),
        (("add_text_overlay",), few(F.coalesce("n_video", F.lit(0)) == 0), "no clip for the text"),
        (("trim_clip", "trim_broll_clip"), no(trimmed[1] > trimmed[0]), "end before start"),
        (("split_clip",), no((within > F.col("c_start_sec")) & (within < F.col("c_end_sec"))), "split outside the clip"),
        (("set_speed",), _p("speed").try_cast("double").isNull(), "no speed"),
        (("set_transition",), ~F.lower(F.coalesce(_p("type"), F.lit("fade"))).isin(*TRANSITIONS, *OFF[:3]), "unknown transition"),
        (("rotate_clip",), no(_p("degrees").isin("0", "90", "180", "270")), "unknown rotation"),
        (("flip_clip",), no(F.lower(_p("direction")).isin("horizontal", "vertical", *OFF[:3])), "unknown direction"),
        (("set_broll_opacity",), F.coalesce(_p("opacity"), _p("broll_opacity")).isNull(), "no opacity"),
        (("merge_clips",), F.size(listed) < 2, "merge needs two clips"),
        (("merge_clips",), few(F.coalesce("n_merged", F.lit(0)) < F.size(listed)), "no such clip"),
        (("reorder_clips",), _p("clip_order").isNull(), "no order"),
        (("add_clip", "add_audio_track", "add_broll_clip"), no(end > start), "end before start"),
        (("replace_video_track_clips",), no(F.trim(_p("asset_id")) != "") | no(F.size(F.from_json(_p("ranges"), RANGES)) > 0), "no ranges"),
        (("set_subtitles",), no(F.size(F.from_json(_p("words"), "array<struct<text:string>>")) > 0), "no words"),
        (("set_aspect_ratio",), no(F.replace(_p("ratio"), F.lit(" "), F.lit("")).isin(*ASPECTS)), "unknown aspect ratio"),
        (("set_export_settings",), ~_export_ok(), "unknown export setting"),
    ]
    error = F.lit(None).cast("string")
    for types, wrong, said in reversed(rules):
        error = error if kinds.isdisjoint(types) else F.when(few(_is(*types) & wrong), said).otherwise(error)
    error = F.when(few(~_is(*ON_CLIPS, *OTHER_OPERATIONS)), "unsupported operation").otherwise(error)
    return rows.select("project_id", error.alias("error")).filter("error is not null")


def apply_batch(clips: DataFrame, log: DataFrame, rounds: int, written=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Clips after a log (project_id, seq, op_type, params) that stops at a project's first error, and what became of
    each operation: project_id, seq, op_type, error, and applied, which is false for the failing one and those behind
    it. What was applied before stays."""
    told, stopped = None, None
    clips = written(clips)  # each round reads them several times
    for k in range(1, rounds + 1):
        ops = log.filter(F.col("seq") == k)
        going = written(ops if stopped is None else ops.join(stopped, "project_id", "left_anti"))
        wrong = written(errors(clips, going))
        # written, as what was joined by project keeps to the tasks of that join, which clips are dealt to more of
        clips = apply_round(clips, written(going.join(wrong, "project_id", "left_anti")))
        clips = clips if k == rounds else written(clips)  # of the last round, what is asked for is made
        now = ops.select("project_id", "seq", "op_type").join(wrong, "project_id", "left")
        late = F.lit(False) if stopped is None else F.col("late").isNotNull()
        now = now if stopped is None else now.join(stopped.withColumn("late", F.lit(True)), "project_id", "left")
        now = now.select("project_id", "seq", "op_type", "error", (F.col("error").isNull() & ~late).alias("applied"))
        told = now if told is None else told.unionByName(now)
        stopped = wrong.select("project_id") if stopped is None else stopped.union(wrong.select("project_id"))
    return clips, told


def states(projects: DataFrame, clips: DataFrame) -> DataFrame:
    """(project_id, state): a project's settings, tracks and clips as one JSON document, as a version keeps it. One
    project's clips fit a row; its tracks come as they are listed, other tracks with clips after them by name."""
    of_track = clips.groupBy("project_id", "track").agg(F.sort_array(F.collect_list(F.struct(*CLIP[2:]))).alias("clips"))
    named = projects.select("project_id", F.posexplode("tracks").alias("i", "t")).select("project_id", "i", "t.*")
    both = named.join(of_track, ["project_id", "track"], "full").withColumns({"i": F.coalesce("i", F.lit(99)), "volume": F.coalesce("volume", F.lit(1.0)), "mute": F.coalesce("mute", F.lit(False)), "solo": F.coalesce("solo", F.lit(False))})
    tracks = both.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("i", "track", "volume", "mute", "solo", "clips"))).alias("tracks"))
    length = clips.groupBy("project_id").agg(F.round(F.max(F.col("timeline_start_sec") + clip_seconds()), 3).alias("duration_sec"))
    rows = projects.drop("tracks").join(tracks, "project_id").join(length, "project_id", "left")
    track = lambda t: F.struct(t.track.alias("kind"), F.coalesce(t.clips, F.array()).alias("clips"), t.volume.alias("volume"), t.mute.alias("mute"), t.solo.alias("solo"))
    return rows.select("project_id", F.to_json(F.struct("fps", F.struct("width", "height").alias("size"), F.transform("tracks", track).alias("tracks"), F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"), F.col("export").alias("export_settings"))).alias("state"))


def _added(clips: DataFrame, ops: DataFrame) -> DataFrame:
    """Clips that operations add; on the video and audio tracks after the project's end unless told where."""
    ends = clips.groupBy("project_id").agg(F.round(F.max(F.col("timeline_start_sec") + clip_seconds()), 3).alias("fin"), F.max("ord").alias("last"))
    rows = ops.join(ends, "project_id", "left")
    start = F.coalesce(_p("start_sec", "double"), F.lit(0.0))
    end = F.coalesce(_p("end_sec", "double"), start + _p("duration_sec", "double"))
    broll = F.col("op_type") == "add_broll_clip"
    track = F.when(broll, "overlay").when(F.col("op_type") == "add_audio_track", "audio").otherwise(F.coalesce(_p("track_kind"), F.lit("video")))
    opacity = F.greatest(F.lit(0.0), F.least(F.coalesce(_p("opacity", "double"), _p("broll_opacity", "double"), F.lit(1.0)), F.lit(1.0)))
    place = F.coalesce(_p("timeline_start_sec", "double"), F.when(broll, F.greatest(start, F.lit(0.0))).otherwise(F.coalesce("fin", F.lit(0.0))))
    one = rows.filter(_is("add_clip", "add_audio_track", "add_broll_clip") & (end > start)).select(
        "project_id", track.alias("track"), (F.coalesce("last", F.lit(0)) + 1).alias("ord"), F.concat(F.lit("new-"), _p("asset_id"), F.lit("-"), (F.coalesce("last", F.lit(0)) + 1).cast("string")).alias("clip_id"), _p("asset_id").alias("asset_id"),
        F.round(start, 3).alias("start_sec"), F.round(end, 3).alias("end_sec"), F.round(place, 3).alias("timeline_start_sec"), F.lit(1.0).alias("speed"), broll.alias("mute"), F.round(opacity, 3).alias("opacity"),
    )
    ranges = F.from_json(_p("ranges"), RANGES)
    each = rows.filter(_is("replace_video_track_clips")).select("project_id", "params", F.posexplode(ranges).alias("i", "r")).filter("r.end_sec > r.start_sec")
    before = Window.partitionBy("project_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.coalesce(F.sum(F.round("r.end_sec", 3) - F.round("r.start_sec", 3)).over(before), F.lit(0.0))
    several = each.select(
        "project_id", F.lit("video").alias("track"), (F.col("i") + 1).alias("ord"), F.concat(F.lit("range-"), (F.col("i") + 1).cast("string")).alias("clip_id"), _p("asset_id").alias("asset_id"),
        F.round("r.start_sec", 3).alias("start_sec"), F.round("r.end_sec", 3).alias("end_sec"), F.round(cursor, 3).alias("timeline_start_sec"), F.lit(1.0).alias("speed"),
    )
    return new_clips(one).unionByName(new_clips(several))


def apply_log(clips: DataFrame, log: DataFrame, rounds: int, written=lambda df: df) -> DataFrame:
    """Clips after a log (project_id, seq, op_type, params), operation by operation; rounds bounds the longest
    project's. written, if given, stores a round's result so that plans stay short."""
    return reduce(lambda state, k: written(apply_round(state, log.filter(F.col("seq") == k))), range(1, rounds + 1), clips)


def _heads(log: DataFrame) -> DataFrame:
    rows = log.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("seq", "action"))).alias("items"))
    start = F.struct(F.lit(0).alias("head"), F.array().cast("array<bigint>").alias("live"))

    def step(s: Column, x: Column) -> Column:
        top = F.size(s.live)
        head = F.when(x.action == "save", s.head + 1).when((x.action == "undo") & (s.head > 0), s.head - 1).when((x.action == "redo") & (s.head < top), s.head + 1).otherwise(s.head)
        return F.struct(head.alias("head"), F.when(x.action == "save", F.array_append(F.slice(s.live, F.lit(1), s.head), x.seq.cast("bigint"))).otherwise(s.live).alias("live"))

    return rows.select("project_id", F.aggregate("items", start, step).alias("v"))


def versions(log: DataFrame) -> DataFrame:
    """Head version and highest live version (top) of each project after a log (project_id, seq, action) of saves, undos
    and redos: a save drops the versions over the head and adds one, undo and redo move the head where there is one. An
    undo past 0 and a redo past the highest do nothing."""
    return _heads(log).select("project_id", "v.head", F.size("v.live").alias("top"))


def live_versions(log: DataFrame) -> DataFrame:
    """The versions that a project has after such a log: project_id, version, saved_seq (the save that made it) and
    is_head."""
    rows = _heads(log).select("project_id", "v.head", F.posexplode("v.live").alias("i", "saved_seq"))
    return rows.select("project_id", (F.col("i") + 1).alias("version"), "saved_seq", (F.col("i") + 1 == F.col("head")).alias("is_head"))


SAVED = "kind string, version long, state string, op_type string, source string, payload string"


def saved(heads: DataFrame, saves: DataFrame) -> DataFrame:
    """What saves add to a store, as one table: kind, project_id, version, state, op_type, source and payload. A save
    (project_id, seq, state, op_type, source, payload) is a version, numbered on from its project's head (project_id,
    head; none: 0), and, if it names an operation, a row of the operation log. Written by one partitioned write, both
    are there or neither is."""
    order = Window.partitionBy("project_id").orderBy("seq")
    rows = saves.join(heads.select("project_id", "head"), "project_id", "left").withColumn("version", F.coalesce("head", F.lit(0)).cast("long") + F.row_number().over(order))
    none = F.lit(None).cast("string")
    version = F.struct(F.lit("version").alias("kind"), "version", "state", none.alias("op_type"), none.alias("source"), none.alias("payload"))
    operation = F.when(F.col("op_type").isNotNull(), F.struct(F.lit("operation").alias("kind"), "version", none.alias("state"), "op_type", F.coalesce("source", F.lit("ui")).alias("source"), "payload"))
    made = F.filter(F.array(version.cast(f"struct<{_typed(SAVED)}>"), operation.cast(f"struct<{_typed(SAVED)}>")), lambda x: x.isNotNull())
    return rows.select("project_id", F.explode(made).alias("r")).select("r.kind", "project_id", "r.version", "r.state", "r.op_type", "r.source", "r.payload")


def _typed(schema: str) -> str:
    return ",".join(":".join(field.split(" ")) for field in schema.split(", "))


def dropped_versions(versions: DataFrame, heads: DataFrame, saves: DataFrame) -> DataFrame:
    """The versions (project_id, version) that go with such saves: those over the head of a project that saves."""
    at = heads.join(saves.select("project_id").distinct(), "project_id", "left_semi")
    return versions.join(at.select("project_id", "head"), "project_id").filter("version > head").drop("head")


def undo_stack(log: DataFrame, depth: int = 80) -> DataFrame:
    """The editor's own stacks after a log (project_id, seq, action: change, undo or redo): project_id, undo and redo
    with the seqs of the changes that can be undone and redone, the latest last. A change empties the redo stack, and
    only the last depth changes are kept."""
    rows = log.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("seq", "action"))).alias("items"))
    none = F.array().cast("array<bigint>")
    but_last = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)

    def step(s: Column, x: Column) -> Column:
        back, again = (x.action == "undo") & (F.size(s.undo) > 0), (x.action == "redo") & (F.size(s.redo) > 0)
        grown = F.array_append(s.undo, x.seq.cast("bigint"))
        changed = F.when(F.size(grown) > depth, F.slice(grown, F.lit(-depth), F.lit(depth))).otherwise(grown)
        undo = F.when(x.action == "change", changed).when(back, but_last(s.undo)).when(again, F.array_append(s.undo, F.element_at(s.redo, -1))).otherwise(s.undo)
        redo = F.when(x.action == "change", none).when(back, F.array_append(s.redo, F.element_at(s.undo, -1))).when(again, but_last(s.redo)).otherwise(s.redo)
        return F.struct(undo.alias("undo"), redo.alias("redo"))

    return rows.select("project_id", F.aggregate("items", F.struct(none.alias("undo"), none.alias("redo")), step).alias("v")).select("project_id", "v.undo", "v.redo")
