"""Interval algebra on timed words, ranges and clips, one key (transcript) apart from another.

Words have key, seq, start_sec and end_sec; ranges key, start_sec and end_sec. Nothing here compares rows of different
keys. What runs along a key's rows is a scan: on tables that scan.spread() has cut into slices, a key of any length runs
in many tasks; results keep the slices, to run along them further. Joins of times with ranges spread both by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scan import SLICE, after, before, is_spread, kept_step, lag, scanned, so_far, spread, to_come, whole


TIME = ["start_sec", "end_sec"]


def _sliced(*frames: DataFrame) -> list[str]:
    """The column that says where rows are, if they are spread."""
    return [SLICE] if all(map(is_spread, frames)) else []


def pauses(words: DataFrame, least: float) -> DataFrame:
    """Ranges of silence between a word and the next in stored order, of at least that many seconds."""
    rows = scanned(words, ["seq"], {"_next": after("first", "start_sec")})
    return rows.filter(F.col("_next") - F.col("end_sec") >= least).select("key", F.col("end_sec").alias("start_sec"), F.col("_next").alias("end_sec"))


def merged(ranges: DataFrame, gap: float, least: float = 0.0) -> DataFrame:
    """Ranges joined where one starts at most gap after all earlier ones have ended. Empty ranges, and those shorter
    than least, are left out first."""
    kept = ranges.filter((F.col("end_sec") > F.col("start_sec")) & (F.col("end_sec") - F.col("start_sec") >= least))
    rows = scanned(kept, TIME, {"_reach": before("max", "end_sec")})
    rows = kept_step(rows.select("key", *TIME, *_sliced(rows), F.when(F.col("start_sec") <= F.col("_reach") + gap, 1).otherwise(0).alias("_joins")))
    # of equal ranges the one that begins an island comes first
    islands = scanned(rows, [*TIME, "_joins"], {"_island": so_far("sum", 1 - F.col("_joins"))})
    return islands.groupBy("key", "_island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), *[F.min(c).alias(c) for c in _sliced(rows)]).drop("_island")


def complement(cuts: DataFrame, durations: DataFrame, keep_over: float = 0.0, least: float = 0.0, whole_if_none: bool = True) -> DataFrame:
    """What merged cuts leave of [0, duration]: parts longer than keep_over whose rounded length is over least. A key
    without cuts keeps everything; one whose cuts leave nothing keeps everything if whole_if_none, else nothing.
    durations: key, duration_sec."""
    part = _sliced(cuts)
    inside = cuts.join(durations, "key").select("key", *part, *[F.least(F.greatest(c, F.lit(0.0)), "duration_sec").alias(c) for c in TIME]).filter("end_sec > start_sec")
    inside = kept_step(inside)
    before_cut = scanned(inside, TIME, {"_reach": before("max", "end_sec")}).select("key", F.coalesce("_reach", F.lit(0.0)).alias("a"), F.col("start_sec").alias("b"), *part)
    last = inside.groupBy("key").agg(F.max("end_sec").alias("last"), *[F.max(c).alias(c) for c in part])
    tail = durations.join(last, "key", "left").select("key", F.coalesce("last", F.lit(0.0)).alias("a"), F.col("duration_sec").alias("b"), *[F.coalesce(c, F.lit(0)).alias(c) for c in part])
    kept = before_cut.unionByName(tail).filter(F.col("b") > F.col("a") + keep_over)
    kept = kept.select("key", F.round("a", 3).alias("start_sec"), F.round("b", 3).alias("end_sec"), *part).filter(F.col("end_sec") > F.col("start_sec") + least)
    if not whole_if_none:
        return kept
    rest = durations.filter("duration_sec > 0").join(kept.select("key"), "key", "left_anti")
    return kept.union(rest.select("key", F.lit(0.0), F.round("duration_sec", 3), *[F.lit(0) for _ in part]))


def deleted_runs(words: DataFrame, kept: DataFrame, durations: DataFrame, context: float = 0.0, tail: float = 1.0) -> DataFrame:
    """Cuts for the words that aren't kept: a run of them is cut from the kept word before it (plus context) to the
    kept word after it (less context), else from 0 or to the end; a deleted last word followed by more than tail
    seconds is cut only up to its end. kept: key, word_id."""
    marked = words.join(kept.select("key", "word_id").distinct().withColumn("_kept", F.lit(True)), ["key", "word_id"], "left").join(durations, "key")
    marked = marked.withColumn("_kept", F.coalesce("_kept", F.lit(False)))
    order = [*TIME, "seq"]
    on = F.col("_kept")
    marked = scanned(
        kept_step(marked),
        order,
        {
            "_run": so_far("sum", on.cast("int")),
            "_before": so_far("last", F.when(on, F.col("end_sec"))),
            "_after": to_come("first", F.when(on, F.col("start_sec"))),
            "_last": whole("max", "end_sec"),
        },
    )
    part = _sliced(marked)
    runs = marked.filter("not _kept").groupBy("key", "_run").agg(*[F.first(c).alias(c) for c in ("_before", "_after", "duration_sec", "_last")], F.max("end_sec").alias("_end"), *[F.min(c).alias(c) for c in part])
    ends_early = F.col("_after").isNull() & (F.col("_end") == F.col("_last")) & (F.col("duration_sec") - F.col("_last") > tail)
    start = F.when(F.col("_before").isNull(), 0.0).otherwise(F.col("_before") + context)
    end = F.when(ends_early, F.col("_last")).when(F.col("_after").isNull(), F.col("duration_sec")).otherwise(F.col("_after") - context)
    inside = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.col("duration_sec"))
    return runs.select("key", inside(start).alias("start_sec"), inside(end).alias("end_sec"), *part).filter("end_sec > start_sec")


def text_cut(words: DataFrame, kept: DataFrame, durations: DataFrame, context: float = 0.0, gap: float = 0.08, least_removed: float = 0.0, tail: float = 1.0) -> DataFrame:
    """Ranges that stay when only the kept words do. Keys all of whose words go have no range, and so are missing."""
    cuts = merged(deleted_runs(words, kept, durations, context, tail), gap).filter(F.col("end_sec") - F.col("start_sec") >= least_removed)
    some = words.join(kept.select("key", "word_id").distinct(), ["key", "word_id"], "left_semi").select("key").distinct()
    return complement(cuts, durations.join(some, "key", "left_semi"), 0.0, 0.02, whole_if_none=False)


def gaps(words: DataFrame, durations: DataFrame, least: float) -> DataFrame:
    """Stretches without words of at least so many seconds: before the first, between one and the next (by its own
    end, not the latest so far) and after the last; without words, all of it."""
    inner = scanned(words, TIME, {"_ago": lag("end_sec")}).select("key", F.coalesce("_ago.v", F.lit(0.0)).alias("a"), F.col("start_sec").alias("b"))
    ends = words.groupBy("key").agg(F.max_by("end_sec", F.struct("start_sec", "end_sec")).alias("a"))
    tail = durations.join(ends, "key", "left").select("key", F.coalesce("a", F.lit(0.0)).alias("a"), F.col("duration_sec").alias("b"))
    return inner.union(tail).filter((F.col("b") - F.col("a") >= least) & (F.col("b") > F.col("a"))).select("key", F.col("a").alias("start_sec"), F.col("b").alias("end_sec"))


def largest_gap(words: DataFrame, durations: DataFrame) -> DataFrame:
    """key, max_gap: the longest stretch without words, 0 at least."""
    found = gaps(words, durations, 0.0).groupBy("key").agg(F.max(F.col("end_sec") - F.col("start_sec")).alias("g"))
    return durations.join(found, "key", "left").select("key", F.greatest(F.coalesce("g", F.lit(0.0)), F.lit(0.0)).alias("max_gap"))


def suspicious_gaps(words: DataFrame, durations: DataFrame, gap: float = 24.0, least_words: int = 20) -> DataFrame:
    """key, suspicious: at least that many words, a duration of 1.5 gaps or more, and a stretch of a gap or more."""
    counted = durations.join(words.groupBy("key").agg(F.count("*").alias("n")), "key", "left").join(largest_gap(words, durations), "key")
    return counted.select("key", ((F.coalesce("n", F.lit(0)) >= least_words) & (F.col("duration_sec") >= 1.5 * gap) & (F.col("max_gap") >= gap)).alias("suspicious"))


def sparse_windows(words: DataFrame, durations: DataFrame, window: float = 20.0, hop: float = 10.0, least: int = 4) -> DataFrame:
    """Hopping windows with fewer than least words starting in them, empty ones too: key, window_start, n. The first
    starts at max(0, min(window, duration - window)), the last ends by the duration."""
    first = F.greatest(F.lit(0.0), F.least(F.lit(window), F.col("duration_sec") - window))
    n = F.floor((F.col("duration_sec") + 1e-6 - window - first) / hop).cast("int")
    spine = durations.select("key", first.alias("first"), n.alias("n")).filter("n >= 0").select("key", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"), "first").withColumn("window_start", F.col("first") + F.col("k") * hop)
    # a word is in at most ceil(window / hop) windows: it is sent to these and the rest is an equi-join
    k = F.floor((F.col("start_sec") - F.col("first")) / hop).cast("int")
    reach = F.sequence(k - int(-(-window // hop)), k + 1)
    placed = words.join(spine.select("key", "first").distinct(), "key").select("key", "start_sec", F.explode(reach).alias("k"))
    hit = spine.join(placed, ["key", "k"], "left").withColumn("in", (F.col("start_sec") >= F.col("window_start")) & (F.col("start_sec") < F.col("window_start") + window))
    return hit.groupBy("key", "window_start").agg(F.count_if("in").alias("n")).filter(F.col("n") < least)


def trimmed(words: DataFrame, silences: DataFrame, durations: DataFrame, edge: float = 0.08, pad: float = 0.06, least: float = 0.15) -> DataFrame:
    """One range a key, without silence at its edges and tight around its words; everything, if little would be left."""
    at = silences.groupBy("key").agg(F.min(F.struct("start_sec", "end_sec")).alias("s0"), F.max(F.struct("start_sec", "end_sec")).alias("s1"))
    said = words.groupBy("key").agg(F.min("start_sec").alias("w0"), F.max("end_sec").alias("w1"))
    rows = durations.join(at, "key", "left").join(said, "key", "left")
    start = F.when(F.col("s0.start_sec") <= edge, F.col("s0.end_sec")).otherwise(0.0)
    end = F.when(F.col("s1.end_sec") >= F.col("duration_sec") - edge, F.col("s1.start_sec")).otherwise(F.col("duration_sec"))
    start, end = F.greatest(start, F.col("w0") - pad), F.least(end, F.col("w1") + pad)
    rows = rows.select("key", "duration_sec", F.greatest(start, F.lit(0.0)).alias("a"), F.least(end, F.col("duration_sec")).alias("b"))
    tight = F.col("b") > F.col("a") + least
    return rows.select("key", F.round(F.when(tight, F.col("a")).otherwise(0.0), 3).alias("start_sec"), F.round(F.when(tight, F.col("b")).otherwise(F.col("duration_sec")), 3).alias("end_sec"))


def overlaps(a: DataFrame, b: DataFrame, bucket: float) -> DataFrame:
    """Pairs of ranges of one key that overlap (half-open), clipped to their common part: key, the other columns of a
    and b, start_sec and end_sec. Both sides are sent to the time buckets they touch, so the equi-join spreads a long
    key; a pair is kept in the bucket where its common part begins. Columns of a and b other than key and times must
    differ."""
    spread = lambda d, s, e: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / bucket).cast("long"), F.floor(F.col(e) / bucket).cast("long"))))
    left = spread(a.withColumnsRenamed({"start_sec": "_s", "end_sec": "_e"}).filter("_e > _s"), "_s", "_e")
    right = spread(b.withColumnsRenamed({"start_sec": "_t", "end_sec": "_f"}).filter("_f > _t"), "_t", "_f")
    met = left.join(right, ["key", "_b"]).filter("_s < _f and _e > _t").withColumns({"start_sec": F.greatest("_s", "_t"), "end_sec": F.least("_e", "_f")})
    return met.filter(F.floor(F.col("start_sec") / bucket) == F.col("_b")).drop("_b", "_s", "_e", "_t", "_f")


def met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ranges of one key that have a time in common, both ends included: key and the other columns of both. a has
    key, a_from and a_to, b key, b_from and b_to; their other columns must differ, and equal rows count once.

    Begins and ends of both are cut into slices of about equal numbers along (key, time). A range goes to the slices from
    the one where it begins to the one where it ends, and two meet in the first that both are in. So no task holds all
    rows of a long key, and ranges far apart are never compared."""

    def ends(side: str, rows: DataFrame) -> DataFrame:
        own = F.struct(*[F.col(c) for c in rows.columns if c != SLICE]).alias(side)
        each = F.explode(F.array(f"{side}_from", f"{side}_to")).alias("t")
        return rows.filter(F.col(f"{side}_from") <= F.col(f"{side}_to")).select("key", each, own)

    line = spread(ends("a", a).unionByName(ends("b", b), allowMissingColumns=True), "t")

    def placed(side: str) -> DataFrame:
        reach = line.filter(F.col(side).isNotNull()).groupBy(side).agg(F.min(SLICE).alias(f"{side}_first"), F.max(SLICE).alias(f"{side}_last"))
        return reach.select(f"{side}.*", f"{side}_first", F.explode(F.sequence(f"{side}_first", f"{side}_last")).alias(SLICE))

    pairs = placed("a").join(placed("b"), ["key", SLICE]).filter((F.col("a_from") <= F.col("b_to")) & (F.col("a_to") >= F.col("b_from")))
    return pairs.filter(F.col(SLICE) == F.greatest("a_first", "b_first")).drop(SLICE, "a_first", "b_first")


def stabbed(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs of a point (key, t) and a range (key, start_sec, end_sec, ...) of one key that holds it, both ends included."""
    at = points.select("key", F.col("t").alias("a_from"), F.col("t").alias("a_to"))
    return met(at, ranges.withColumnsRenamed({"start_sec": "b_from", "end_sec": "b_to"})).drop("a_to").withColumnsRenamed({"a_from": "t", "b_from": "start_sec", "b_to": "end_sec"})


def inside_gaps(words: DataFrame, gap_ranges: DataFrame, pad: float = 0.18) -> DataFrame:
    """The words whose middle lies in some gap of their key, widened by pad at both ends (both inclusive): those before
    which a gap has begun that reaches as far. A running maximum tells, so words meet no gaps in a join."""
    middle = (F.col("start_sec") + F.col("end_sec")) / 2
    word = F.struct(*words.columns)
    begun = gap_ranges.select("key", (F.col("start_sec") - pad).alias("t"), F.lit(0).alias("side"), (F.col("end_sec") + pad).alias("reach"))
    line = begun.unionByName(words.select("key", middle.alias("t"), F.lit(1).alias("side"), word.alias("word")), allowMissingColumns=True)
    rows = scanned(spread(line, "t", "side"), ["t", "side"], {"_reach": so_far("max", "reach")})
    return rows.filter((F.col("side") == 1) & (F.col("_reach") >= F.col("t"))).select("word.*")


def active_words(times: DataFrame, words: DataFrame) -> DataFrame:
    """For each (key, t): the first word that covers t and isn't deleted, else the first kept word from t on, else the
    last kept word before t: key, t, word_id. words have deleted.

    The covering word is found slice by slice; the nearest on each side by running values along words and times in one
    order."""
    kept = words.filter("not deleted").select("key", "start_sec", "end_sec", "seq", "word_id")
    at = times.select("key", "t").distinct()
    covering = stabbed(at, kept).groupBy("key", "t").agg(F.min_by("word_id", "seq").alias("covering"))
    starts = kept.select("key", F.col("start_sec").alias("t"), F.lit(2).alias("side"), "seq", "word_id")
    ends = kept.select("key", F.col("end_sec").alias("t"), F.lit(0).alias("side"), "seq", "word_id")
    line = starts.union(ends).unionByName(at.withColumn("side", F.lit(1)), allowMissingColumns=True)
    of = lambda side: F.when(F.col("side") == side, F.col("word_id"))
    near = scanned(spread(line, "t", "side", "seq"), ["t", "side", "seq"], {"next": after("first", of(2)), "prev": before("last", of(0))})
    return near.filter("side = 1").join(covering, ["key", "t"], "left").select("key", "t", F.coalesce("covering", "next", "prev").alias("word_id"))


def to_source_time(times: DataFrame, clips: DataFrame) -> DataFrame:
    """Edited times (key, t) as source times: in a clip its place there, before a clip that clip's start, past the
    last its end. clips: key, start_sec, end_sec, timeline_start_sec, speed. Clips that touch share an edge; the
    first counts: of the clips that end at t or later the one that starts first, a running minimum from the end."""
    speed = F.greatest("speed", F.lit(0.01))
    laid = clips.select("key", F.col("timeline_start_sec").alias("a"), (F.col("timeline_start_sec") + (F.col("end_sec") - F.col("start_sec")) / speed).alias("b"), "start_sec", speed.alias("v"))
    line = times.select("key", "t").distinct().withColumn("side", F.lit(0)).unionByName(laid.select("key", F.col("b").alias("t"), F.lit(1).alias("side"), F.struct("a", "b", "start_sec", "v").alias("clip")), allowMissingColumns=True)
    first = scanned(spread(line, "t", "side"), ["t", "side"], {"c": to_come("min", "clip")}).filter("side = 0")
    last = clips.groupBy("key").agg(F.max_by("end_sec", F.struct("timeline_start_sec", "end_sec")).alias("end"))
    at = F.when(F.col("c").isNull(), F.col("end")).when(F.col("t") < F.col("c.a"), F.col("c.start_sec")).otherwise(F.col("c.start_sec") + (F.col("t") - F.col("c.a")) * F.col("c.v"))
    return first.join(last, "key", "left").select("key", "t", F.round(at, 3).alias("source_sec"))


def to_edited_time(times: DataFrame, clips: DataFrame) -> DataFrame:
    """Source times (key, t) as edited times: in a clip its place there (of several the first by clip order), in a removed
    part the nearer clip edge (of equally near ones the first by clip order, start before end). Clips that hold a time are
    found slice by slice, the edges before and after by running values."""
    speed = F.greatest("speed", F.lit(0.01))
    laid = clips.select("key", F.col("timeline_start_sec").alias("a"), "start_sec", "end_sec", speed.alias("v"))
    at = times.select("key", "t").distinct()
    place = F.col("a") + (F.col("t") - F.col("start_sec")) / F.col("v")
    inside = stabbed(at, laid).groupBy("key", "t").agg(F.min(F.struct("a", place.alias("p"))).alias("in"))
    end = F.col("a") + (F.col("end_sec") - F.col("start_sec")) / F.col("v")
    edge = lambda t, e, to: F.struct(t.alias("t"), F.col("a").alias("o"), F.lit(e).alias("e"), to.alias("to"))
    edges = laid.select("key", F.explode(F.array(edge(F.col("start_sec"), 0, F.col("a")), edge(F.col("end_sec"), 1, end))).alias("g"))
    # one edge for each place: the first by clip order
    edges = edges.groupBy("key", F.col("g.t").alias("t")).agg(F.min(F.struct("g.o", "g.e", "g.to")).alias("g")).select("key", "t", F.lit(0).alias("side"), F.struct("t", "g.o", "g.e", "g.to").alias("edge"))
    line = spread(edges.unionByName(at.withColumn("side", F.lit(1)), allowMissingColumns=True), "t", "side")
    near = scanned(line, ["t", "side"], {"back": before("last", "edge"), "on": after("first", "edge")}).filter("side = 1")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("t") - F.col(f"{c}.t")).alias("far"), F.col(f"{c}.o").alias("o"), F.col(f"{c}.e").alias("e"), F.col(f"{c}.to").alias("to")))
    both = near.join(inside, ["key", "t"], "left")
    return both.select("key", "t", F.round(F.coalesce("in.p", F.least(far("back"), far("on")).getField("to")), 3).alias("edited_sec"))
