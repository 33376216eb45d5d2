"""Scans over slices give the rows of windows over keys, for a key that holds most rows too; and what is built on them
gives the rows of plain loops."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals as iv
from tessera.operators import edits, ranking, scan
from tessera.operators import segments as sg
from tessera.operators.timeline import transition_layout
from tessera.plans import ranking as ranking_plans
from tessera.plans import timeline as timeline_plans
from tessera.sources import stored
from tessera.sources.tables import silences_of_log


def lopsided(r, n):
    """Words of which one transcript has most."""
    rows, at = [], {}
    for i in range(n):
        key = 1 if r.random() < 0.6 else r.randint(2, 9)
        start = at.get(key, 0.0) + r.choice([0.0, 0.0, 0.25, 0.5, 3.0])
        at[key] = start
        rows.append((key, start, start + r.choice([0.0, 0.25, 1.0, 7.0]), i, r.choice([None, 1.0, 2.0, 3.0])))
    return rows


WORDS = "key long, start_sec double, end_sec double, seq int, x double"


def test_scans_by_slices(spark):
    rows = spark.createDataFrame(lopsided(random.Random(1), 700), WORDS)
    order = ["start_sec", "seq"]
    scans = {f"{how}_{where}": scan.Scan(F.col("x"), how, where) for how in ("sum", "max", "min", "first", "last") for where in ("before", "so_far", "to_come", "after", "all")}
    scans |= {"ago": scan.lag("x"), "next": scan.lead("x")}
    cut = scan.spread(rows, *order, slices=13)
    assert cut.filter("key = 1").select(scan.SLICE).distinct().count() > 5
    assert cut.groupBy(scan.SLICE).count().agg(F.max("count")).first()[0] < 150
    plain, sliced = (scan.scanned(d, order, scans).select("key", "seq", *scans) for d in (rows, cut))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, sliced.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_by_slices(spark, seed):
    r = random.Random(seed)
    words = spark.createDataFrame(lopsided(r, 500), WORDS).withColumn("word_id", F.col("seq"))
    durations = words.groupBy("key").agg((F.max("end_sec") + 2.0).alias("duration_sec")).union(spark.createDataFrame([(77, 4.0)], "key long, duration_sec double"))
    kept = words.filter("seq % 3 <> 0 and key <> 4").select("key", "word_id")
    cut = scan.spread(words, "start_sec", "end_sec", "seq", slices=11)
    shown = lambda d: sorted(map(repr, d.drop(scan.SLICE).collect()))
    pairs = [
        lambda w: iv.merged(w, 0.3),
        lambda w: iv.complement(iv.merged(w, 0.1, 0.5), durations, 0.2),
        lambda w: iv.gaps(w, durations, 0.5),
        lambda w: iv.deleted_runs(w, kept, durations, 0.1, 1.0),
        lambda w: iv.text_cut(w, kept, durations, 0.1, 0.3, 0.4, 1.0),
    ]
    by_seq = [
        lambda w: iv.pauses(w, 0.25),
        lambda w: sg.slot_chunks(w.withColumn("text", F.lit("a.")), 1, 9, 1.0, 5),
        lambda w: sg.paragraphs(sg.sentences(w.withColumn("text", F.when(F.col("x") == 1, "b.").otherwise("b")))),
    ]
    for table, functions in ((cut, pairs), (scan.spread(words, "seq", slices=11), by_seq)):
        for of in functions:
            rows = shown(of(words))
            assert rows == shown(of(table)) and rows


def test_pairs_of_ranges_meet_once(spark):
    r = random.Random(3)
    ranges = lambda n: [(r.choice([1, 1, 1, 2]), a := r.randrange(400) / 4, a + r.choice([0, 0.5, 3, 90]), i) for i in range(n)]
    a, b = ranges(150), ranges(120)
    got = iv.met(spark.createDataFrame(a, "key long, a_from double, a_to double, i int"), spark.createDataFrame(b, "key long, b_from double, b_to double, j int")).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for k, s, e, i in a for q, t, f, j in b if k == q and s <= f and e >= t)


def test_words_in_gaps_and_near_times(spark):
    r = random.Random(4)
    words = [(*w[:4], w[3]) for w in lopsided(r, 300)]
    frame = spark.createDataFrame(words, "key long, start_sec double, end_sec double, seq int, word_id int")
    gaps = [(r.choice([1, 1, 2, 3]), a := r.randrange(300) / 2, a + r.randrange(9)) for _ in range(40)]
    got = iv.inside_gaps(frame, spark.createDataFrame(gaps, "key long, start_sec double, end_sec double"), 0.25)
    assert sorted(x.seq for x in got.collect()) == sorted(i for k, s, e, i, _ in words if any(k == q and a - 0.25 <= (s + e) / 2 <= b + 0.25 for q, a, b in gaps))
    times = [(r.choice([1, 1, 2, 99]), r.randrange(400) / 2) for _ in range(80)]

    def active(k, t):
        mine = [w for w in words if w[0] == k]
        on = [(w[3], w[4]) for w in mine if w[1] <= t <= w[2]]
        late = [(w[1], w[3], w[4]) for w in mine if w[1] >= t]
        past = [(w[2], w[3], w[4]) for w in mine if w[2] <= t]
        return min(on)[-1] if on else min(late)[-1] if late else max(past)[-1] if past else None

    got = iv.active_words(spark.createDataFrame(times, "key long, t double"), frame.withColumn("deleted", F.lit(False)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k, t, active(k, t))) for k, t in set(times))


def captioned(words, most, chars, gap):
    out, text, n, end = [], "", 0, None
    for t, start, stop in words:
        clause = n >= max(2, most - 1) and text[-1:] in ",;:—–"
        if n and (start - end > gap or n >= most or len(text) + 1 + len(t) > chars or (n >= 2 and text[-1] in ".!?") or clause):
            out.append(text)
            text, n = "", 0
        text, n, end = (text + " " + t).strip(), n + 1, stop
    return out + [text] * bool(n)


@pytest.mark.parametrize("most,chars", [(3, 42), (1, 10), (8, 20)])
def test_captions_of_long_transcripts(spark, monkeypatch, most, chars):
    monkeypatch.setattr(scan, "BLOCK", 16)
    r = random.Random(most)
    rows, at = [], {}
    for i in range(900):
        key = r.choice([1, 1, 1, 2, 3])
        start = at.get(key, 0.0) + r.choice([0.25, 0.25, 0.25, 1.5 if key > 1 else 0.25])
        at[key] = start
        rows.append((key, i, r.choice(["a", "bb", "ccc.", "d,", "e" * 15]), start, start + 0.25))
    got = sg.captions(spark.createDataFrame(rows, "key long, seq int, text string, start_sec double, end_sec double"), most, chars)
    for key in (1, 2, 3):
        texts = [x.text for x in sorted(got.filter(F.col("key") == key).collect(), key=lambda x: x.caption)]
        assert texts == captioned([(t, s, e) for k, _, t, s, e in rows if k == key], most, chars, 0.55)


@pytest.mark.parametrize("slices", [2, 11, 400])
def test_captions_across_slices(spark, monkeypatch, slices):
    """Words go through one shuffle, and captions are the same wherever slices end, also in slices of a word or none."""
    monkeypatch.setattr(sg, "walked", None)
    r = random.Random(slices)
    rows, at = [], {}
    for i in range(700):
        key = r.choice(["long", "long", "long", "b", "c"] + [f"short {i}"] * (i % 9 == 0))
        start = at.get(key, 0.0) + r.choice([0.25, 0.25, 0.25, 1.5 if key != "long" else 0.25])
        at[key] = start
        rows.append((key, i, r.choice(["a", "bb", "ccc.", "d,", "e" * 15]), start, start + 0.25, 8 if key == "long" else 3))
    words = spark.createDataFrame(rows, "key string, seq int, text string, start_sec double, end_sec double, most int")
    got = sg.captions(words, "most", 20, slices=slices).collect()
    assert {x.key for x in got} == set(at)
    for key in at:
        mine = sorted((x for x in got if x.key == key), key=lambda x: x.caption)
        assert [x.caption for x in mine] == list(range(1, len(mine) + 1))
        assert [x.text for x in mine] == captioned([(t, s, e) for k, _, t, s, e, _ in rows if k == key], 8 if key == "long" else 3, 20, 0.55)


def loops_removed(said, longest=4, repeats=3, least=6):
    keep, i, n = [], 0, len(said)
    while i < n:
        for k in range(1, min(longest, (n - i) // 2) + 1):
            copies = 1
            while said[i + copies * k : i + copies * k + k] == said[i : i + k]:
                copies += 1
            if copies >= repeats and n >= least:
                keep += range(i, i + k)
                i += copies * k
                break
        else:
            keep.append(i)
            i += 1
    return keep


def test_loops_of_long_transcripts(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 16)
    r = random.Random(7)
    rows, expected = [], []
    for key in range(60):
        said = []
        while len(said) < (r.randint(0, 40) if key else 500):
            said += [r.choice("ab") for _ in range(r.randint(1, 4))] * r.choice([1, 1, 2, 3, 5])
        rows += [(key, 10 * i, w + r.choice(["", ".", "!"])) for i, w in enumerate(said)]
        expected += [(key, 10 * i) for i in loops_removed(said)]
    got = sg.without_loops(spark.createDataFrame(rows, "key int, seq int, text string"))
    assert sorted((x.key, x.seq) for x in got.collect()) == sorted(expected)


def test_doubles_by_last_kept_word(spark):
    r = random.Random(9)
    rows, expected = [], []
    for key in range(20):
        words = sorted((r.randrange(60) / 50, 0.0, r.choice("aaab"), 0) for _ in range(r.randint(0, 90)))
        words = [(a, a + r.choice([0.5, 0.52, 0.58]), t, i) for i, (a, _, t, _) in enumerate(words)]
        words.sort(key=lambda w: (w[0], w[1], w[2], w[3]))
        rows += [(key, i, t, a, b) for a, b, t, i in words]
        last = None
        for a, b, t, i in words:
            if last is None or t != last[2] or abs(a - last[0]) > 0.05 or abs(b - last[1]) > 0.05:
                last = (a, b, t)
                expected.append((key, i))
    got = sg.without_doubles(spark.createDataFrame(rows, "key int, seq int, text string, start_sec double, end_sec double"))
    assert sorted((x.key, x.seq) for x in got.collect()) == sorted(expected)


def test_transitions_are_rounded_step_by_step(spark):
    r = random.Random(10)
    clips = [(r.choice([1, 1, 2]), i, float(i), 0.0, r.randrange(1, 99999) / 10000, 1.0, r.choice([None, 0.0, 0.3333, 9.0])) for i in range(200)]
    got = transition_layout(spark.createDataFrame(clips, "key long, clip_id long, at double, start_sec double, end_sec double, speed double, raw_sec double"), "key", ["at"])
    expected = []
    for key in (1, 2):
        start, before = 0.0, None
        for _, i, _, _, d, _, raw in (c for c in clips if c[0] == key):
            lap = 0.0 if before is None else max(0.0, min(raw or 0.0, 0.45 * min(before, d)))
            start = 0.0 if before is None else round(int((start + before - lap) * 1000 + 0.5 + 1e-6) / 1000, 3)
            expected.append((key, i, start, round(lap, 9)))
            before = d
    assert sorted((x.key, x.clip_id, x.render_start_sec, round(x.transition_sec, 9)) for x in got.collect()) == sorted(expected)


def test_silence_log_in_order(spark):
    r = random.Random(12)

    def log(rising):
        starts, ends = ([r.randrange(200) / 10 for _ in range(r.randint(0, 25))] for _ in range(2))
        return (sorted(starts), sorted(ends)) if rising else (starts, ends)

    logs, expected = [], []
    for key in range(40):
        starts, ends = log(key % 3 > 0)
        lines = [f"silence_start: {s}" for s in starts] + [f"silence_end: {e} | x" for e in ends]
        logs.append((key, "\n".join(lines)))
        at = 0
        for s in starts:
            while at < len(ends) and ends[at] <= s:
                at += 1
            if at < len(ends):
                expected.append((key, s, ends[at]))
                at += 1
    got = silences_of_log(spark.createDataFrame(logs, "key int, log string"), "key", "log")
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_walks(spark):
    r = random.Random(13)
    rows, expected = [], []
    for key in range(12):
        n = r.choice([1, 7, 90])
        to = [i + r.choice([1, 1, 2, 3, 40]) for i in range(n)]
        rows += [(key, i, t) for i, t in enumerate(to)]
        i = 0
        while i < n:
            expected.append((key, i))
            i = to[i]
    frame = spark.createDataFrame(rows, "key int, _at long, _to long")
    for table in (frame, scan.spread(frame, "_at", slices=9)):
        assert sorted((x.key, x._at) for x in scan.walked(table).filter("visited").collect()) == sorted(expected)


def test_following_rows(spark):
    rows = [(k, i, f"{k}{i}" if i % 4 else None) for k in (1, 2) for i in range(40 if k == 1 else 2)]
    got = scan.with_following(spark.createDataFrame(rows, "key int, _at long, t string"), {"next": "t"}, 3, block=5)
    of = {(k, i): t for k, i, t in rows}
    assert {(x.key, x["_at"]): x.next for x in got.collect()} == {(k, i): [of[k, j] for j in range(i + 1, i + 4) if (k, j) in of] for k, i in itertools.chain(of)}


def test_tasks_grow_in_number_with_their_rows(spark):
    """What tasks hold is bounded by rows, not by bytes of a shuffle."""
    rows = spark.range(4000).selectExpr("id % 500 as k", "'same' as text")
    few, many = (stored.dealt(rows, "k", rows=n) for n in (10_000, 100))
    assert few.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and many.rdd.getNumPartitions() == 40
    assert many.groupBy("k").count().filter("count <> 8").count() == 0


def test_scans_and_walks_are_dealt_by_rows(spark, monkeypatch):
    """What a task of a scan or walk holds is bounded by rows, also where shuffled bytes are few, and rows stay the same."""
    monkeypatch.setattr(scan, "TASK_ROWS", 100)
    r = random.Random(14)
    rows, expected = [], []
    for key, n in ((1, 900), (2, 250), (3, 1)):
        to = [i + r.choice([1, 1, 2, 3, 40]) for i in range(n)]
        rows += [(key, i, t) for i, t in enumerate(to)]
        i = 0
        while i < n:
            expected.append((key, i))
            i = to[i]
    table = scan.spread(spark.createDataFrame(rows, "key int, _at long, _to long"), "_at")
    assert table.groupBy(scan.SLICE).count().agg(F.max("count")).first()[0] < 250
    walk = scan.walked(table)
    assert sorted((x.key, x._at) for x in walk.filter("visited").collect()) == sorted(expected)
    for step in (scan.scanned(table, ["_at"], {"n": scan.so_far("sum", F.lit(1))}), scan.with_following(table, {"next": "_to"}, 2, block=50), walk):
        assert step.rdd.getNumPartitions() == -(-len(rows) // 100)


def test_words_in_slices_are_not_spread_again(spark, sf_dir, monkeypatch):
    from tessera.plans import segments as segment_plans

    monkeypatch.setattr(sg, "spread", None)
    assert segment_plans.w15_loops_collapsed(spark, sf_dir).count() > 0


def test_clips_are_dealt_by_project(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(edits, "TASK_ROWS", 400)
    tracks = timeline_plans._tracks(spark, sf_dir)
    ops = timeline_plans._ops(spark, sf_dir)
    assert edits._with_hits(tracks, ops).rdd.getNumPartitions() == -(-tracks.count() // 200)


def test_sums_of_slices_are_not_broadcast(spark):
    rows = scan.spread(spark.range(2000).selectExpr("id % 700 as key", "id as at"), "at")
    plan = scan.scanned(rows, ["at"], {"n": scan.so_far("sum", F.lit(1))})
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_concepts_shuffle_texts_only(spark, sf_dir):
    plan = ranking_plans.a6_concepts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "token" in x.split("ENSURE")[0]]


def test_hits_are_dealt_before_they_are_sorted(spark):
    hits = spark.range(200).selectExpr("id % 50 as slot_id", "cast(id as string) as url", "cast(id % 4 as int) as place", "4 as total", "5D as duration_sec", "100 as width", "200 as height", "4D as slot_sec")
    plan = ranking.provider_scores(hits, 0.42, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
    assert "Aggregate" not in plan[plan.index("REPARTITION_BY_NUM") :].split("+- Filter")[0]


def test_subtitles_make_their_words_once(spark, sf_dir, monkeypatch):
    """The words of subtitles are put together once, and not for each of the round's readings."""
    from tessera.plans import suggestions

    stored = []
    write = suggestions.written
    monkeypatch.setattr(suggestions, "written", lambda df: stored.append(df.columns) or write(df))
    monkeypatch.setattr(sg, "walked", None)
    plan = suggestions.a9_e12_subtitles(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert stored == [["key", "words"]]
    assert "to_json" not in plan


def test_hits_of_slots_are_made_where_slots_are_dealt(spark, sf_dir):
    from tessera.plans import ranking

    plan = ranking.r6_provider_scores(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.index("Generate explode") < plan.index("Exchange")


def test_vectors_are_multiplied_in_the_memory_of_batches(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.8, 0.6]), (3, [1.0]), (4, []), (5, None), (6, [0.6, 0.8])], "vec_id long, embedding array<double>")
    got = ranking.nearest_vectors(rows.filter("vec_id in (0, 3, 4)").withColumnRenamed("vec_id", "q_id"), rows, 2)
    assert "MapInArrow" in got._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, got.select("q_id", "rank", "vec_id", "cosine").collect())) == [(0, 1, 2, 0.9), (0, 2, 6, 0.8)]


def tracks_of(spark, projects):
    rows = [(p, "video", i + 1, f"c{i + 1}", "a", *c) for p in projects for i, c in enumerate([(0.0, 4.0, 0.0, 1.0), (4.0, 6.0, 4.0, 1.0), (0.0, 3.0, 6.0, 1.0)])]
    return edits.new_clips(spark.createDataFrame(rows, "project_id string, track string, ord int, clip_id string, asset_id string, start_sec double, end_sec double, timeline_start_sec double, speed double"))


OPS = "project_id string, seq int, op_type string, params map<string,string>"


def test_a_round_sorts_no_more_than_its_operations_need(spark):
    clips = tracks_of(spark, ["p", "q"])
    ops = spark.createDataFrame([(p, 1, "set_speed", {"clip": "1", "speed": "2"}) for p in "pq"], OPS)
    plan = edits.apply_round(clips, ops)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "Union" not in plan


def test_what_others_do_in_a_round_changes_no_clip(spark):
    said = [
        ("set_speed", {"clip": "1", "speed": "2"}), ("split_clip", {"clip": "2", "at_sec": "5"}), ("delete_clip", {"clip": "2"}), ("merge_clips", {"clips": "3,1"}),
        ("set_volume", {"clip": "1", "volume": "0.3", "track_kind": "audio"}), ("add_clip", {"asset_id": "z", "start_sec": "1", "duration_sec": "2"}), ("dance", {}), ("delete_clip", {"clip": "99"}),
    ]
    names = [f"p{i:02}" for i in range(len(said) + 1)]
    ops = [(p, 1, *x) for p, x in zip(names, said, strict=False)]
    clips = tracks_of(spark, names)
    rows = lambda df: sorted(map(repr, df.collect()))
    alone = [x for p in names for x in rows(edits.apply_round(clips.filter(F.col("project_id") == p), spark.createDataFrame([o for o in ops if o[0] == p], OPS)))]
    assert rows(edits.apply_round(clips, spark.createDataFrame(ops, OPS))) == sorted(alone)
    wrong = lambda some: {(r.project_id, r.error) for r in edits.errors(clips, spark.createDataFrame(some, OPS)).collect()}
    assert wrong(ops) == set().union(*[wrong([o]) for o in ops]) == {("p06", "unsupported operation"), ("p07", "no such clip")}


def test_a_batch_makes_its_clips_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    clips = tracks_of(spark, ["p", "q"]).withColumn("project_id", F.udf(seen, "string")("project_id"))
    log = spark.createDataFrame([("p", 1, "set_speed", {"clip": "1", "speed": "2"}), ("p", 2, "dance", {}), ("p", 3, "delete_clip", {"clip": "1"}), ("q", 1, "delete_clip", {"clip": "2"}), ("q", 2, "split_clip", {"clip": "1", "at_sec": "1"})], OPS)
    left, told = edits.apply_batch(clips, log, 3, stored.written)
    assert sorted((r.project_id, r.clip_id, r.ord) for r in left.collect()) == [("p", "c1", 1), ("p", "c2", 2), ("p", "c3", 3), ("q", "c1", 1), ("q", "c1'", 2), ("q", "c3", 3)]
    assert {(r.project_id, r.seq, r.error, r.applied) for r in told.collect()} == {("p", 1, None, True), ("p", 2, "unsupported operation", False), ("p", 3, None, False), ("q", 1, None, True), ("q", 2, None, True)}
    assert made.value == 6
