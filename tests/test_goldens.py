"""Small cases with known results."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as num
from tessera.functions import text as tx
from tessera.operators import edits, jobs, prompts, ranking, segments, suggestions, timeline, transcripts
from tessera.operators import intervals as iv
from tessera.streaming.sessions import density, replayed

RANGE = "key string, start_sec double, end_sec double"
WORD = "key string, seq int, word_id string, text string, start_sec double, end_sec double"


def words(spark, times, texts=None):
    return spark.createDataFrame([("t", i + 1, str(i + 1), texts[i] if texts else "w", *t) for i, t in enumerate(times)], WORD)


def durations(spark, seconds):
    return spark.createDataFrame([("t", float(seconds))], "key string, duration_sec double")


def ranges(df):
    return sorted((r.start_sec, r.end_sec) for r in df.collect())


@pytest.mark.parametrize(
    "seconds, times, kept, options, want",
    [
        (8, [(0.5, 1.0), (1.0, 1.3), (2.0, 2.4), (2.4, 2.9)], ["1", "4"], {}, [(0.0, 1.0), (2.4, 8.0)]),
        (8, [(0.5, 1.0), (1.0, 1.3), (2.0, 2.4), (2.4, 2.9)], ["1", "4"], {"context": 0.18, "least_removed": 0.35}, [(0.0, 1.18), (2.22, 8.0)]),
        (40, [(0.5, 1.0), (2.0, 2.4), (2.5, 3.0), (30.0, 30.4)], ["1", "3", "4"], {}, [(0.0, 1.0), (2.5, 40.0)]),
    ],
)
def test_text_cut(spark, seconds, times, kept, options, want):
    k = spark.createDataFrame([("t", i) for i in kept], "key string, word_id string")
    assert ranges(iv.text_cut(words(spark, times), k, durations(spark, seconds), **options)) == want


def test_text_cut_of_everything_keeps_nothing(spark):
    assert iv.text_cut(words(spark, [(0.5, 1.0)]), spark.createDataFrame([], "key string, word_id string"), durations(spark, 8)).count() == 0


def test_auto_cut_keeps_three_parts(spark):
    s = spark.createDataFrame([("t", 1.0, 2.0), ("t", 4.0, 4.8)], RANGE)
    kept = iv.complement(iv.merged(s, 0.05), durations(spark, 8), 0.08)
    laid = timeline.relaid(kept, ["key"]).collect()
    assert len(laid) == 3 and round(sum(r.end_sec - r.start_sec for r in laid), 3) == 6.2
    whole = iv.complement(spark.createDataFrame([("t", 0.0, 9.0)], RANGE), durations(spark, 8), 0.08)
    assert ranges(whole) == [(0.0, 8.0)]


def test_trim(spark):
    s = spark.createDataFrame([("t", 0.0, 0.5), ("t", 7.8, 8.0)], RANGE)
    assert ranges(iv.trimmed(words(spark, [(0.7, 1.0), (7.2, 7.4)]), s, durations(spark, 8))) == [(0.64, 7.46)]


def test_merge_equals_a_fold(spark):
    r = random.Random(3)
    rows = [("k%d" % k, float(a), float(a + r.randint(-1, 6))) for k in range(40) for a in (r.randint(0, 60) for _ in range(r.randint(0, 9)))]
    got = sorted(map(tuple, iv.merged(spark.createDataFrame(rows, RANGE), 0.5).select("key", "start_sec", "end_sec").collect()))
    want = []
    for k in sorted({x[0] for x in rows}):
        out = []
        for a, b in sorted(x[1:] for x in rows if x[0] == k and x[2] > x[1]):
            if out and a <= out[-1][1] + 0.5:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        want += [(k, a, b) for a, b in out]
    assert got == sorted(want)


def test_captions(spark):
    w = words(spark, [(0.2, 0.5), (0.5, 0.8), (1.8, 2.2)], ["hello", "world", "again"])
    got = segments.captions(w, max_words=2).orderBy("caption").collect()
    assert [r.text for r in got] == ["hello world", "again"]


def test_slot_chunks(spark):
    w = words(spark, [(i * 0.4, i * 0.4 + 0.3) for i in range(12)], [f"w{i}" + "." * (i % 4 == 3) for i in range(12)])
    assert segments.slot_chunks(w).count() == 3 and segments.slot_chunks(w, most=2).count() == 2


def test_loops_collapse_like_the_rule(spark):
    r = random.Random(5)
    cases = [[r.choice("abAb!c") for _ in range(r.randint(0, 25))] for _ in range(60)]
    rows = [(f"k{k}", i, t) for k, c in enumerate(cases) for i, t in enumerate(c)]
    got: dict = {}
    for x in segments.without_loops(spark.createDataFrame(rows, "key string, seq int, text string")).collect():
        got.setdefault(x.key, []).append(x.seq)
    for k, c in enumerate(cases):
        said, keep, at = [t.lower().strip(".,!?") for t in c], [], 0
        while at < len(c):
            hit = None
            for n in range(1, 5):
                times = 1
                while said[at + n * times : at + n * (times + 1)] == said[at : at + n] and len(said[at + n * times : at + n * (times + 1)]) == n:
                    times += 1
                if times >= 3 and 2 * n <= len(c) - at:
                    hit = (n, times)
                    break
            if hit and len(c) >= 6:
                keep += range(at, at + hit[0])
                at += hit[0] * hit[1]
            else:
                keep.append(at)
                at += 1
        assert sorted(got.get(f"k{k}", [])) == keep, c


def test_confidence_and_script(spark):
    rows = spark.createDataFrame([("1.5",), ("-0.3",), ("NaN",), ("x",)], "x string").select(num.confidence(F.col("x")).alias("c")).collect()
    assert [r.c for r in rows] == [1.0, 0.0, None, None]
    p = words(spark, [(float(i), i + 0.5) for i in range(20)], ["latin"] * 20)
    r = words(spark, [(1.0, 1.2), (2.0, 2.2), (3.0, 3.2)], ["Đăng", "chorus", "line"])
    assert {x.text for x in transcripts.same_script(p, r).collect()} == {"chorus", "line"}


def test_profile(spark):
    s = spark.createDataFrame([("t", a, a + 8.0) for a in (0.0, 20.0, 40.0)], RANGE)
    assert transcripts.profile(s, durations(spark, 100)).first().profile == "speech"
    assert transcripts.profile(s.limit(0), durations(spark, 100)).first().profile == "music"


def clip(spark, *rows):
    return edits.new_clips(spark.createDataFrame([("p", "video", i + 1, f"c{i + 1}", "a", *r) for i, r in enumerate(rows)], "project_id string, track string, ord int, clip_id string, asset_id string, start_sec double, end_sec double, timeline_start_sec double, speed double"))


def op(spark, kind, **params):
    return spark.createDataFrame([("p", 1, kind, {k: str(v) for k, v in params.items()})], "project_id string, seq int, op_type string, params map<string,string>")


def laid(df):
    return [(r.clip_id, r.start_sec, r.end_sec, r.timeline_start_sec) for r in df.orderBy("track", "ord").collect()]


def test_edits(spark):
    one, three = clip(spark, (0.0, 10.0, 0.0, 1.0)), clip(spark, (0.0, 4.0, 0.0, 1.0), (4.0, 6.0, 4.0, 1.0), (0.0, 3.0, 6.0, 1.0))
    assert [x[1:3] for x in laid(edits.apply_round(one, op(spark, "split_clip", clip=1, at_sec=4)))] == [(0.0, 4.0), (4.0, 10.0)]
    assert laid(edits.apply_round(one, op(spark, "split_clip", clip=1, at_sec=40))) == laid(one)
    fast = edits.apply_round(one, op(spark, "set_speed", clip="c1", speed=2))
    assert timeline.duration(fast, "project_id").first().duration_sec == 5.0
    assert laid(edits.apply_round(three, op(spark, "delete_clip", clip=2))) == [("c1", 0.0, 4.0, 0.0), ("c3", 0.0, 3.0, 4.0)]
    assert [x[0] for x in laid(edits.apply_round(three, op(spark, "reorder_clips", clip_order="c3,zz,c1")))] == ["c3", "c1", "c2"]
    assert [(x[0], x[3]) for x in laid(edits.apply_round(three, op(spark, "merge_clips", clips="3,1")))] == [("c3", 0.0), ("c1", 3.0), ("c2", 7.0)]
    added = laid(edits.apply_round(three, op(spark, "add_clip", asset_id="z", start_sec=1, duration_sec=2)))
    assert added[-1][1:] == (1.0, 3.0, 9.0)
    again = laid(edits.apply_round(three, op(spark, "replace_video_track_clips", asset_id="a", ranges='[{"start_sec":0,"end_sec":1.2},{"start_sec":2.5,"end_sec":4}]')))
    assert [x[1:] for x in again] == [(0.0, 1.2, 0.0), (2.5, 4.0, 1.2)]
    assert edits.apply_round(one, op(spark, "add_text_overlay", text="hi", start_sec=1)).first().texts[0].duration_sec == 2.0
    assert laid(edits.apply_round(one, op(spark, "trim_clip", clip=1, start_sec=5, end_sec=2))) == laid(one)


def test_subtitles(spark):
    said = [("hello", 0.2, 0.5), ("world", 0.5, 0.8), ("again.", 1.8, 2.2), ("late", 30, 31), (" ", 0, 1)]
    words = json.dumps([{"text": t, "start_sec": a, "end_sec": b} for t, a, b in said])
    two = clip(spark, (0.0, 2.0, 0.0, 1.0), (1.0, 40.0, 2.0, 1.0))
    old = edits.apply_round(two, op(spark, "add_text_overlay", text="old", start_sec=1))
    got = {r.clip_id: [(t.text, t.start_sec, t.duration_sec, t.style) for t in r.texts] for r in edits.apply_round(old, op(spark, "set_subtitles", words=words, max_words_per_caption=2, style="nope")).collect()}
    assert got == {"c1": [("hello world", 0.2, 0.6, "karaoke"), ("again.", 1.8, 0.2, "karaoke")], "c2": [("again.", 0.8, 0.4, "karaoke"), ("late", 29.0, 1.0, "karaoke")]}
    kept = {r.clip_id: len(r.texts or []) for r in edits.apply_round(old, op(spark, "set_subtitles", words=words, asset_id="zz", clear_existing="false")).collect()}
    assert kept == {"c1": 1, "c2": 0}


def test_what_operations_may_not_do(spark):
    three = clip(spark, (0.0, 4.0, 0.0, 1.0), (4.0, 6.0, 4.0, 1.0), (0.0, 3.0, 6.0, 1.0))
    wrong = {
        "no such clip": [("trim_clip", {"clip": 9}), ("set_volume", {"clip": "zz"}), ("merge_clips", {"clips": "1,9"}), ("set_broll_opacity", {"clip": 1})],
        "merge needs two clips": [("merge_clips", {"clips": "1,1"})],
        "end before start": [("trim_clip", {"clip": 1, "start_sec": 2, "end_sec": 2}), ("add_clip", {"asset_id": "a", "start_sec": 2})],
        "unknown direction": [("flip_clip", {"clip": 1, "direction": "up"})],
        "unknown export setting": [("set_export_settings", {"fps": 25})],
        "no words": [("set_subtitles", {"words": "[]"})],
        "no ranges": [("replace_video_track_clips", {"asset_id": "a", "ranges": "nonsense"})],
        "unsupported operation": [("dance", {})],
    }
    for error, ops in wrong.items():
        for kind, params in ops:
            assert [r.error for r in edits.errors(three, op(spark, kind, **params)).collect()] == [error], (kind, params)
    for kind, params in [("import_media", {}), ("set_volume", {"clip": 2, "track_kind": "audio"}), ("set_volume", {"track_kind": "audio", "mute": "true"}), ("merge_clips", {"clips": "3,1"}), ("set_transition", {"clip": 1, "type": "off"})]:
        assert edits.errors(three, op(spark, kind, **params)).count() == 0, kind


def test_states(spark):
    projects = edits.default_projects(spark.createDataFrame([("p", 720)], "project_id string, width int"))
    state = json.loads(edits.states(projects, clip(spark, (0.0, 4.0, 0.0, 2.0))).first().state)
    assert state["size"] == {"width": 720, "height": 1920} and state["duration_sec"] == 2.0
    assert [(t["kind"], len(t["clips"])) for t in state["tracks"]] == [("video", 1), ("audio", 0), ("overlay", 0)] and state["tracks"][0]["clips"][0]["clip_id"] == "c1"


def test_undo_stack_drops_the_oldest(spark):
    log = spark.createDataFrame([("p", i, "change") for i in range(1, 101)] + [("p", 101, "undo"), ("p", 102, "undo"), ("p", 103, "redo")], "project_id string, seq int, action string")
    got = edits.undo_stack(log).first()
    assert got.undo == list(range(21, 100)) and got.redo == [100]


def test_versions(spark):
    log = [(i + 1, a) for i, a in enumerate(["undo", "save", "save", "undo", "redo", "redo", "undo", "save", "redo"])]
    got = edits.versions(spark.createDataFrame([("p", *x) for x in log], "project_id string, seq int, action string")).first()
    assert (got.head, got.top) == (2, 2)


def test_prompts(spark):
    said = ["please trim first clip from 5 sec to 12 sec", 'add text "Hi there" at 00:02 for 3s', "audio fade out clip 1 1.2s", "trim clip 1 from a to b", "", None, "sing"]
    got = prompts.parsed(spark.createDataFrame([(s,) for s in said], "prompt string")).collect()
    assert got[0].op_type == "trim_clip" and (got[0].params["clip"], got[0].params["start_sec"], got[0].params["end_sec"]) == ("1", "5.0", "12.0")
    assert got[1].params == {"text": "Hi there", "start_sec": "2.0", "duration_sec": "3.0"}
    assert got[2].op_type == "set_volume" and got[2].params["fade_out_sec"] == "1.2"
    assert [g.error for g in got[3:]] == ["invalid timecode", "empty prompt", "empty prompt", "unknown command"]


def test_every_command(spark):
    said = {
        "Kindly cut 2 5s - 0:12!": ("trim_clip", {"clip": "2", "start_sec": "5.0", "end_sec": "12.0"}),
        "join clips 1, 2 3": ("merge_clips", {"clips": "1,2,3"}),
        "add caption 'so it goes' at 1 for 2 secs": ("add_text_overlay", {"text": "so it goes", "start_sec": "1.0", "duration_sec": "2.0"}),
        "add title Big day at 0:03": ("add_text_overlay", {"text": "Big day", "start_sec": "3.0", "duration_sec": "2.0"}),
        "could you set aspect ratio 4:5": ("set_aspect_ratio", {"ratio": "4:5"}),
        "transition clip two Slide_Left 0.5s": ("set_transition", {"clip": "2", "type": "slide_left", "duration_sec": "0.5"}),
        "fade in second clip 1s": ("set_transition", {"clip": "2", "type": "fade", "duration_sec": "1.0", "mode": "in"}),
        "speed of clip 1 2x": ("set_speed", {"clip": "1", "speed": "2.0"}),
        "rotate clip 1 90degrees": ("rotate_clip", {"clip": "1", "degrees": "90"}),
        "flip clip 1 vertically": ("flip_clip", {"clip": "1", "direction": "vertical"}),
        "crop clip 1 0 10 200 300": ("crop_resize", {"clip": "1", "x": "0", "y": "10", "width": "200", "height": "300"}),
        "set exposure clip 1 -0.5": ("set_adjustments", {"clip": "1", "exposure": "-0.5"}),
        "set preset clip 1 WARM": ("set_adjustments", {"clip": "1", "preset": "warm"}),
        "set volume clip 1 .5": None,
        "set volume clip 1 0.5": ("set_volume", {"clip": "1", "volume": "0.5"}),
        "unmute clip 3": ("set_volume", {"clip": "3", "mute": "false"}),
        "audio fade in clip 1 2s": ("set_volume", {"clip": "1", "track_kind": "audio", "fade_in_sec": "2.0"}),
        "set track audio volume to 0.7": ("set_volume", {"track_kind": "audio", "volume": "0.7"}),
        "mute video track": ("set_volume", {"track_kind": "video", "mute": "true"}),
        "unsolo track audio": ("set_volume", {"track_kind": "audio", "solo": "false"}),
        "remove clip abc please": ("delete_clip", {"clip": "abc"}),
        "shift clip 1 at 9": ("move_clip", {"clip": "1", "timeline_start_sec": "9.0", "ripple": "false"}),
        "ripple edit audio": ("ripple_edit", {"track_kind": "audio"}),
        "render 4K 60 fps max quality webm": ("set_export_settings", {"resolution": "4k", "fps": "60", "quality": "max", "format": "webm"}),
        "add video asset a9 from 1 to 2": ("add_clip", {"asset_id": "a9", "start_sec": "1.0", "end_sec": "2.0", "timeline_start_sec": "0.0"}),
        "add audio asset a9 from 1 to 2 at 3": ("add_audio_track", {"asset_id": "a9", "start_sec": "1.0", "end_sec": "2.0", "timeline_start_sec": "3.0"}),
    }
    got = {r.prompt: r for r in prompts.parsed(spark.createDataFrame([(s,) for s in said], "prompt string")).collect()}
    for s, want in said.items():
        assert (want is None and got[s].error == "unknown command" and len(got[s].suggestions) == 12) or (got[s].op_type, got[s].params) == want, s
    tips = prompts.parsed(spark.createDataFrame([(s,) for s in prompts.SUGGESTIONS + [t.removeprefix("Try: ") for t in prompts.FIRST_SUGGESTIONS]], "prompt string"))
    assert tips.filter("op_type is null").count() == 0


def test_suggestions(spark):
    w = words(spark, [(i * 0.4, i * 0.4 + 0.3) for i in range(12)], "rocket launch over the sea. apples grow in green orchards. rocket engines".split() + ["x"])
    assets = spark.createDataFrame([("t", "a1", "rocket_launch.mp4", 30.0, 2, False), ("t", "a2", "apple orchards.mp4", 1.0, 1, False), ("t", "a3", "office.mp4", None, 3, True)], "project_id string, asset_id string, filename string, duration_sec double, created_at int, own boolean")
    slots = suggestions.slots_of(w)
    best = {r.slot_id: r.asset_id for r in suggestions.candidates_of(slots, assets, None).filter("rank = 1").collect()}
    assert best["t/1"] == "a1" and best["t/2"] == "a2"
    found = suggestions.candidates_of(slots, assets, lambda s: s.select("slot_id", F.lit("https://x.org/rocket").alias("url"), F.lit(0).alias("place"), F.lit(1).alias("total"), F.lit(9.0).alias("duration_sec"), F.lit(1080).alias("width"), F.lit(1920).alias("height")))
    assert {r.url for r in found.collect()} == {None, "https://x.org/rocket"} and found.groupBy("slot_id").count().filter("count > 5").count() == 0
    chosen = suggestions.chosen_of(found, slots, 2.0, fallback=True)
    assert chosen.count() == slots.count() and suggestions.chosen_of(found, slots, 2.0).filter("action = 'auto_choose'").count() == 0
    c = suggestions.counters(chosen).first()
    assert c.auto_chosen_slots + c.skipped_slots == slots.count()
    with pytest.raises(Exception, match="locked"):
        suggestions.unlocked(spark.createDataFrame([(1, True)], "slot_id int, locked boolean")).collect()
    clips = spark.createDataFrame([("a1",), ("zz",)], "asset_id string")
    assert suggestions.with_assets(clips, assets, must=False).count() == 1
    with pytest.raises(Exception, match="no asset zz"):
        suggestions.with_assets(clips, assets, must=True).collect()


def test_promising_pairs_hold_the_best(spark):
    """The ranking from a few lists is that of all pairs."""
    r = random.Random(12)
    terms = ["red", "blue", "ring", "bolt", "old", "new"]
    assets = [(k % 3, k, "_".join(r.sample(terms, r.randint(1, 4))) + ".mp4", r.choice([None, 0.0, r.uniform(0.2, 60)]), r.randint(0, 40)) for k in range(150)]
    slots = [(r.randint(0, 3), s, r.sample(terms, r.randint(0, 6)), r.choice([None, r.uniform(0.1, 50)]), r.choice([None, r.randint(0, 149)])) for s in range(80)]
    a = spark.createDataFrame(assets, "project_id int, asset_id int, filename string, duration_sec double, created_at int")
    s = spark.createDataFrame(slots, "project_id int, slot_id int, concepts array<string>, slot_sec double, own_asset int")
    got = {(x.slot_id, x["rank"]): (x.asset_id, x.score) for x in ranking.local_scores(s, a, 4).collect()}
    want = {}
    for project, slot, concepts, sec, own in slots:
        mine = sorted((x for x in assets if x[0] == project), key=lambda x: (-x[4], -x[1]))
        rows = []
        for place, (_, k, name, long, _) in enumerate(mine):
            hit = sum(c in name[:-4].split("_") for c in concepts)
            score = 0.2 + (min(hit / len(concepts) * 0.45, 0.45) if concepts else 0) + (0.06 if k == own else 0.18) + (0.12 if long and long >= max(sec or 1.0, 1.0) else 0.05) + (1 - place / len(mine)) * 0.15
            rows.append((-min(score, 1.0), place, k))
        rows = sorted((-float(f"{-x:.3f}") if abs(x * 1000 % 1 - 0.5) > 1e-6 else x, p, k) for x, p, k in rows)
        want |= {(slot, i + 1): k for i, (_, _, k) in enumerate(rows[:4])}
    assert {k: v[0] for k, v in got.items()} == want


def test_ranking_edges(spark):
    c = spark.createDataFrame([(1, 1, 0.5, 0.5), (1, 2, 0.9, 0.2), (2, 3, 0.9, 0.9)], "slot_id int, candidate_id int, score double, confidence double")
    assert {(r.slot_id, r.candidate_id, r.confident) for r in ranking.picked(c).collect()} == {(1, 2, False), (2, 3, True)}
    got = spark.range(1).select(tx.first_of_each(F.array(*map(F.lit, ["A", " a ", "", "b", "B", "c"])), 2).alias("x"), tx.drawtext(F.lit("it's 5:3, [ok]")).alias("d")).first()
    assert got.x == ["A", "b"] and got.d == "its 5\\:3\\, \\[ok\\]"
    assert num.normalised([0.0, -1.0]) == [0.5, 0.5]


def test_jobs(spark):
    e = spark.createDataFrame([(1, 1, "r", "s", "queued", 1, "2024-01-01"), (1, 1, "r", "s", "completed", 2, "2024-01-02"), (2, 1, "r", "s", "running", 3, "2024-01-01")], "job_id int, project_id int, kind string, stage string, status string, event_id int, created_at string")
    assert [r.job_id for r in jobs.active_jobs(e).collect()] == [2] and [r.job_id for r in jobs.orphans(e).collect()] == [2]


def test_stream_equals_batch(spark, sf_dir):
    from tessera.sources.tables import table

    got = sorted(map(tuple, replayed(spark, sf_dir, "events", density, "density_test").collect()))
    assert got == sorted(map(tuple, density(table(spark, sf_dir, "events")).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_assets_about_as_long_as_a_slot_are_not_all_compared(spark):
    """Assets of one class of length: pairs follow the logarithm of their number, and hold the best."""
    r = random.Random(3)
    a = spark.createDataFrame([(1, k, f"a{k}.mp4", r.uniform(20, 20.7), r.randint(0, 90)) for k in range(600)], "project_id int, asset_id int, filename string, duration_sec double, created_at int")
    placed = a.selectExpr("*", "row_number() over (order by created_at desc, asset_id desc) - 1 as place", "cast(array() as array<string>) as terms")
    s = spark.createDataFrame([(1, k, [], 20 + k / 100, None) for k in range(60)], "project_id int, slot_id int, concepts array<string>, slot_sec double, own_asset int")
    assert ranking._promising(s, placed, 4).count() < 60 * 60
    best = {x.slot_id: x.asset_id for x in ranking.local_scores(s, a, 4).filter("rank = 1").collect()}
    rows = placed.collect()
    score = lambda x, sec: round(0.2 + 0.18 + (0.12 if x.duration_sec >= sec else 0.05) + (1 - x.place / 600) * 0.15 + 1e-9, 3)
    assert best == {k: min(rows, key=lambda x: (-score(x, 20 + k / 100), x.place)).asset_id for k in range(60)}


def test_slots_come_of_whole_transcripts(spark):
    w = words(spark, [(i * 0.4, i * 0.4 + 0.3) for i in range(4 * 55)], "rocket launch over sea.".split() * 55)
    assert suggestions.slots_of(w).count() == 55 and suggestions.slots_of(w, most=40).count() == 40


def test_slots_of_words_that_are_not_numbered(spark):
    from tessera.sources import tables

    c = spark.createDataFrame([(k, t, f"the rocket {k} flies. over seas and far lands " * (t + k)) for k in range(3) for t in range(4)], "conv_id long, turn long, text string")
    rows = lambda df: sorted(map(repr, df.collect()))
    got = rows(suggestions.slots_of(tables.sliced_words(c), order=["segment", "i"]))
    assert got and got == rows(suggestions.slots_of(tables.conversation_words(c)))


def test_slots_without_assets_are_not_compared(spark, monkeypatch):
    seen, promising = [], ranking._promising
    monkeypatch.setattr(ranking, "_promising", lambda slots, placed, k: seen.append({x.project_id for x in slots.collect()}) or promising(slots, placed, k))
    a = spark.createDataFrame([(1, k, f"red{k}.mp4", 9.0, k) for k in range(3)], "project_id int, asset_id int, filename string, duration_sec double, created_at int")
    s = spark.createDataFrame([(p, p, ["red"], 2.0, None) for p in (1, 2, 3, None)], "project_id int, slot_id int, concepts array<string>, slot_sec double, own_asset int")
    got = []
    for most in (10, 0):
        monkeypatch.setattr(ranking, "PROJECTS", most)
        got.append([(x.slot_id, x.asset_id) for x in ranking.local_scores(s, a, 2).orderBy("slot_id", "rank").collect()])
    assert seen == [{1}, {1}] and got == [[(1, 2), (1, 1)]] * 2


def test_a_text_of_a_slot_is_shuffled_once(spark):
    w = words(spark, [(i * 0.4, i * 0.4 + 0.3) for i in range(12)], "rocket launch over the sea. apples grow in green orchards. rocket engines".split() + ["x"])
    assets = spark.createDataFrame([("t", "a1", "rocket_launch.mp4", 30.0, 2, False), ("t", "a2", "sea.mp4", None, 3, True)], "project_id string, asset_id string, filename string, duration_sec double, created_at int, own boolean")
    hits = lambda s: s.select("slot_id", F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(t).alias("duration_sec")) for u, t in [("https://x.org/a", 9.0), ("https://x.org/a", 20.0), (None, 4.0)]])).alias("h")).select("slot_id", "h.*", F.lit(0).alias("place"), F.lit(1).alias("total"), F.lit(1080).alias("width"), F.lit(1920).alias("height"))
    found = suggestions.candidates_of(suggestions.slots_of(w), assets, hits)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {(r.asset_id, r.url, r.duration_sec) for r in found.collect()} == {("a1", None, 30.0), ("a2", None, None), (None, "https://x.org/a", 20.0), (None, None, None)}


def test_slots_are_made_once(spark):
    w = words(spark, [(i * 0.4, i * 0.4 + 0.3) for i in range(12)], "rocket launch over the sea. apples grow in green orchards. rocket engines".split() + ["x"])
    plan = suggestions.slots_of(w)._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and "Aggregate" not in plan
