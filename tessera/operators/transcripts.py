"""Cleaning, checking, choosing and merging transcripts. Words have key, seq, text, start_sec, end_sec, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import clamp
from tessera.functions.text import latin_share, squeezed
from tessera.operators import intervals as iv
from tessera.operators.segments import without_doubles, without_loops


def normalised(words: DataFrame, durations: DataFrame, least_confidence: float = 0.15) -> DataFrame:
    """Words by start, within [0, duration], in milliseconds, with single blanks and clamped confidence. Words without
    text go, and those whose confidence is known and under least_confidence; words without length get 0.05 s (none at
    the very end)."""
    rows = words.join(durations, "key")
    at = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.col(c), F.col("duration_sec"))), 3)
    known = F.when(F.isnan("confidence") | (F.abs("confidence") == float("inf")), None).otherwise(clamp(F.col("confidence")))
    rows = rows.withColumns({"a": at("start_sec"), "b": at("end_sec"), "text": squeezed(F.col("text")), "confidence": known})
    rows = rows.withColumn("b", F.when(F.col("b") <= F.col("a"), F.round(F.least("duration_sec", F.col("a") + 0.05), 3)).otherwise(F.col("b")))
    rows = rows.filter((F.col("text") != "") & (F.col("confidence").isNull() | (F.col("confidence") >= least_confidence)))
    order = Window.partitionBy("key").orderBy("start_sec", "seq")
    return rows.select("key", F.row_number().over(order).alias("seq"), "text", F.col("a").alias("start_sec"), F.col("b").alias("end_sec"), "confidence")


def least_words(duration: Column) -> Column:
    """Words that a transcript of this duration should have."""
    return F.greatest(F.lit(8), F.bround(F.greatest(duration, F.lit(1.0)) * 0.45).cast("int"))


def quality(words: DataFrame, durations: DataFrame, low: float = 0.6, low_ratio: float = 0.18, low_count: int = 30) -> DataFrame:
    """One row a key: words, words with a confidence and with a low one, its mean (1 if none is known), how far words
    reach, the longest gap, and whether coverage or confidence is low."""
    stats = words.groupBy("key").agg(
        F.count("*").alias("n"), F.count("confidence").alias("n_scored"), F.count_if(F.col("confidence") < low).alias("n_low"), F.coalesce(F.avg("confidence"), F.lit(1.0)).alias("avg_confidence"), F.max("end_sec").alias("last")
    )
    rows = durations.join(stats, "key", "left").join(iv.largest_gap(words, durations), "key")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.select("key", "duration_sec", zero("n").alias("n"), zero("n_scored").alias("n_scored"), zero("n_low").alias("n_low"), F.coalesce("avg_confidence", F.lit(1.0)).alias("avg_confidence"), "max_gap", clamp(F.coalesce("last", F.lit(0.0)) / F.greatest("duration_sec", F.lit(0.1))).alias("coverage"))
    return rows.withColumns(
        {
            "low_coverage": F.col("n") < least_words(F.col("duration_sec")),
            "low_confidence": (F.col("n_scored") >= low_count) & (F.col("n_low") / F.greatest("n_scored", F.lit(1)) >= low_ratio),
        }
    )


def profile(silences: DataFrame, durations: DataFrame, most: float = 120.0) -> DataFrame:
    """speech, music or mixed by the share of silence in the first most seconds; overlapping silences count twice."""
    n = F.least("duration_sec", F.lit(most))
    inside = silences.join(durations, "key").withColumn("s", F.greatest(F.lit(0.0), F.least("end_sec", n) - F.greatest("start_sec", F.lit(0.0))))
    sums = inside.groupBy("key").agg(F.sum("s").alias("s"))
    ratio = clamp(F.coalesce("s", F.lit(0.0)) / F.greatest(n, F.lit(0.1)))
    out = durations.join(sums, "key", "left").select("key", ratio.alias("silence"))
    return out.withColumn("profile", F.when(F.col("silence") >= 0.10, "speech").when(F.col("silence") <= 0.04, "music").otherwise("mixed"))


def better(first: DataFrame, second: DataFrame, least: int = 30) -> DataFrame:
    """key, take: "second" if that transcript's quality beats the first's, by the first rule that tells, else "first"."""
    a = first.select("key", *[F.col(c).alias(f"a_{c}") for c in first.columns if c != "key"])
    b = second.select("key", *[F.col(c).alias(f"b_{c}") for c in second.columns if c != "key"])
    both = a.join(b, "key", "full")
    ratio = lambda x: F.col(f"{x}_n_low") / F.greatest(f"{x}_n_scored", F.lit(1))
    scored = (F.col("a_n_scored") >= least) & (F.col("b_n_scored") >= least)
    # the last bits of a mean hang on the order in which it was summed up, so means are compared to nine places
    rule = (
        F.when(F.col("a_n").isNull(), "second")
        .when(F.col("b_n").isNull(), "first")
        .when(F.col("a_low_coverage") & ~F.col("b_low_coverage"), "second")
        .when(F.col("b_n") >= F.col("a_n") + F.greatest(F.lit(12), F.bround(F.col("a_n") * 0.15).cast("int")), "second")
        .when(F.col("b_coverage") >= F.col("a_coverage") + 0.08, "second")
        .when(F.col("b_max_gap") + 5.0 <= F.col("a_max_gap"), "second")
        .when(scored & (ratio("b") + 0.05 <= ratio("a")), "second")
        .when(scored & (ratio("b") <= ratio("a") + 0.01) & (F.round(F.col("b_avg_confidence") - F.col("a_avg_confidence"), 9) >= 0.03), "second")
        .otherwise("first")
    )
    return both.select("key", rule.alias("take"))


def gap_filled(primary: DataFrame, secondary: DataFrame, durations: DataFrame, gap: float = 18.0, pad: float = 0.18) -> DataFrame:
    """Primary words with those of the secondary transcript that lie in the primary's long gaps, without doubles and
    loops, normalised. Keys for which that gives no more words than the primary has keep the primary's."""
    ranges = iv.gaps(primary, durations, gap)
    more = iv.inside_gaps(secondary, ranges, pad)
    columns = ["key", "text", "start_sec", "end_sec", "confidence"]
    touched = more.select("key").distinct()
    every = primary.join(touched, "key", "left_semi").select(*columns).unionByName(more.select(*columns))
    every = every.withColumn("seq", F.row_number().over(Window.partitionBy("key").orderBy("start_sec", "end_sec", F.lower("text"))))
    filled = without_loops(normalised(without_doubles(every), durations))
    sizes = filled.groupBy("key").agg(F.count("*").alias("n")).join(primary.groupBy("key").agg(F.count("*").alias("m")), "key").filter("n > m").select("key")
    return filled.join(sizes, "key", "left_semi").select("seq", *columns).unionByName(primary.join(sizes, "key", "left_anti").select("seq", *columns))


def same_script(primary: DataFrame, rescued: DataFrame, sample: int = 600, letters: int = 40, share: float = 0.65) -> DataFrame:
    """Rescued words without those of another script, for keys whose first sample words are mostly Latin."""
    order = Window.partitionBy("key").orderBy("start_sec", "end_sec", "seq")
    first = primary.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample)
    count = lambda p: F.sum(F.length(F.regexp_replace("text", p, "")))
    latin = first.groupBy("key").agg(count(r"[^\p{L}]").alias("all"), count("[^A-Za-z]").alias("ascii")).filter((F.col("all") >= letters) & (F.col("ascii") >= share * F.col("all"))).select("key", F.lit(True).alias("latin"))
    n = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    foreign = (n >= 2) & ((n > F.length(F.regexp_replace("text", "[^A-Za-z]", ""))) | (latin_share(F.col("text")) < 0.35))
    return rescued.join(latin, "key", "left").filter(~(F.coalesce("latin", F.lit(False)) & foreign)).drop("latin")


def rescue_windows(gaps: DataFrame, longest: float, most: int) -> DataFrame:
    """Windows to transcribe again: the longest gaps first, each cut into pieces of at most longest seconds, and at
    most most windows a key."""
    size = F.col("end_sec") - F.col("start_sec")
    n = F.greatest(F.ceil(size / longest).cast("int"), F.lit(1))
    order = Window.partitionBy("key").orderBy(F.desc("size"), "start_sec", "piece")
    pieces = gaps.withColumns({"size": size, "n": n}).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pieces = pieces.withColumn("window", F.row_number().over(order)).filter(F.col("window") <= most)
    end = F.least(F.col("start_sec") + (F.col("piece") + 1) * longest, F.col("end_sec"))
    return pieces.select("key", "window", (F.col("start_sec") + F.col("piece") * longest).alias("start_sec"), end.alias("end_sec"))


def gap_rescued(primary: DataFrame, rescued: DataFrame, durations: DataFrame, gap: float = 18.0, longest: float = 30.0, most: int = 12, pad: float = 0.18) -> DataFrame:
    """Primary words with those of rescue_windows that were transcribed again. rescued (key, window, seq, text,
    start_sec, end_sec, confidence) has times from each window's start; words of another script than the primary's go."""
    windows = rescue_windows(iv.gaps(primary, durations, gap), longest, most).select("key", "window", F.col("start_sec").alias("_at"))
    columns = ["key", "seq", "text", "start_sec", "end_sec", "confidence"]
    placed = rescued.join(windows, ["key", "window"]).withColumns({"start_sec": F.col("start_sec") + F.col("_at"), "end_sec": F.col("end_sec") + F.col("_at")}).select(*columns)
    return gap_filled(primary, same_script(primary, placed).select(*columns), durations, gap, pad)


def edited_text(words: DataFrame, edits: DataFrame) -> DataFrame:
    """Transcripts' texts after edits (key, seq, new_text): key, text."""
    rows = words.join(edits.select("key", "seq", "new_text"), ["key", "seq"], "left").select("key", "seq", F.coalesce("new_text", "text").alias("text"))
    return rows.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), " ").alias("text"))


def waveform(samples: DataFrame, peaks: int) -> DataFrame:
    """Peaks of samples (key, idx, value): the largest magnitude of each chunk, at most 1, over the key's largest. The
    chunk is the number of samples over peaks, one at least, so a last short chunk may add a peak."""
    sized = samples.join(samples.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("chunk", F.greatest(F.floor(F.col("n") / peaks), F.lit(1)))
    each = sized.groupBy("key", F.floor(F.col("idx") / F.col("chunk")).cast("int").alias("peak")).agg(F.least(F.max(F.abs("value")), F.lit(1.0)).alias("v"))
    top = each.groupBy("key").agg(F.max("v").alias("top"))
    return each.join(top, "key").select("key", "peak", F.when(F.col("top") > 0, F.col("v") / F.col("top")).otherwise(0.0).alias("value"))
