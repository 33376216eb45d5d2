"""Readers of the base tables, and the canonical tables (words, clips, jobs) that operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.scan import SLICE, kept_step, scanned, slices_for, so_far, spread, whole

WORD_ITEM = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start_sec", T.StringType()), T.StructField("end_sec", T.StringType()), T.StructField("confidence", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_words(events: DataFrame, cap: float = 30.0) -> DataFrame:
    """Words (key, seq, word_id, text, start_sec, end_sec, confidence) of an event log: a user's events are the words
    of one transcript, a word lasts as long as its value says, up to cap."""
    rows = events.select(
        F.col("user_id").alias("key"),
        "ts",
        F.col("event_id").alias("word_id"),
        F.col("event_type").alias("text"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_micros"),
        F.least("value", F.lit(cap)).alias("_long"),
        F.when(F.col("event_id") % 10 != 0, F.pmod(F.col("event_id") * 37, F.lit(100)) / F.lit(100.0)).alias("confidence"),
    )
    # users differ much in length: words come in slices, so that what runs along them does so in many tasks
    rows = scanned(spread(rows, "ts", "word_id", slices=slices_for(events)), ["ts", "word_id"], {"seq": so_far("sum", F.lit(1)), "_begun": whole("min", "_micros")})
    start = (F.col("_micros") - F.col("_begun")) / F.lit(1e6)
    return rows.select("key", F.col("seq").cast("int").alias("seq"), "word_id", "text", start.alias("start_sec"), (start + F.col("_long")).alias("end_sec"), "confidence", SLICE)


def spread_words(segments: DataFrame, key: str, order: str, text: Column, start: Column, end: Column) -> DataFrame:
    """Words of timed segments: a segment's words share its time evenly, at least a tenth of a second in all."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    rows = segments.select(F.col(key).alias("key"), F.col(order).alias("segment"), start.alias("s"), F.greatest(end - start, F.lit(0.1)).alias("span"), parts.alias("parts"))
    rows = rows.select("key", "segment", "s", (F.col("span") / F.size("parts")).alias("step"), F.posexplode("parts").alias("i", "text")).filter("text <> ''")
    return rows.select("key", "segment", "i", "text", (F.col("s") + F.col("i") * F.col("step")).alias("start_sec"), (F.col("s") + (F.col("i") + 1) * F.col("step")).alias("end_sec"))


def unnumbered_words(conversations: DataFrame) -> DataFrame:
    """Words of conversations (key, segment, i, text, start_sec, end_sec): turn n begins at ten seconds times n and takes a
    third of a second a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.col("turn") * F.lit(10.0)
    long = F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")) * F.lit(0.33)
    return spread_words(conversations, "conv_id", "turn", text, start, start + long)


def sliced_words(conversations: DataFrame) -> DataFrame:
    """Words of conversations in slices along the turns (segment, i)."""
    rows = unnumbered_words(conversations)
    # counted first, as what is written is else counted and written again
    return spread(rows, "segment", "i", slices=slices_for(rows))


def conversation_words(conversations: DataFrame) -> DataFrame:
    """Words of conversations, numbered along the turns."""
    rows = scanned(sliced_words(conversations), ["segment", "i"], {"seq": so_far("sum", F.lit(1))})
    return rows.select("key", F.col("seq").cast("int").alias("seq"), "text", "start_sec", "end_sec", SLICE)


def words_of_json(transcripts: DataFrame, key: str, words_json: str, strict: bool = False) -> DataFrame:
    """Words of a JSON column. Lenient: items without text, without times or with end <= start are dropped, and words
    come by start; unreadable JSON has none. Strict: any such item, and unreadable JSON, fails the query."""
    parsed = transcripts.select(F.col(key).alias("key"), F.from_json(words_json, T.ArrayType(WORD_ITEM), {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("items"))
    rows = parsed.select("key", F.posexplode("items").alias("i", "w"))
    number = lambda c: F.expr(f"try_cast(w.{c} AS DOUBLE)")
    rows = rows.select("key", "i", F.col("w.id").alias("word_id"), F.trim("w.text").alias("text"), number("start_sec").alias("start_sec"), number("end_sec").alias("end_sec"), number("confidence").alias("confidence"))
    good = F.coalesce((F.col("text") != "") & (F.col("end_sec") > F.col("start_sec")), F.lit(False))
    if strict:
        return rows.withColumn("text", F.when(good, F.col("text")).otherwise(F.raise_error(F.lit("a word has no text or no time"))))
    rows = rows.filter(good)
    return rows.select("key", F.row_number().over(Window.partitionBy("key").orderBy("start_sec", "i")).alias("seq"), "word_id", "text", "start_sec", "end_sec", "confidence")


def mock_words(assets: DataFrame, key: str, duration: str) -> DataFrame:
    """A stand-in transcript for each asset: 2.2 words a second, eight at least, from a fixed sentence gone round."""
    #: fixed values
    sentence = "this is a generated transcript preview edit the text to cut the video automatically".split()
    long = F.greatest(F.col(duration).cast("double"), F.lit(3.0))
    rows = assets.select(F.col(key).alias("key"), long.alias("dur"), F.greatest(F.lit(8), F.bround(long * 2.2).cast("int")).alias("n"))
    rows = rows.select("key", "dur", (F.col("dur") / F.col("n")).alias("step"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    start = F.col("i") * F.col("step")
    return rows.select(
        "key",
        (F.col("i") + 1).alias("seq"),
        F.element_at(F.array(*map(F.lit, sentence)), F.col("i") % len(sentence) + 1).alias("text"),
        start.alias("start_sec"),
        F.least("dur", start + F.greatest(F.lit(0.08), F.col("step") * 0.82)).alias("end_sec"),
    )


def silences_of_log(logs: DataFrame, key: str, line: str) -> DataFrame:
    """Silent ranges from a detector's log: each silence_start meets the first later silence_end; ends are used once
    and in order, ranges need end > start, times are rounded to milliseconds."""
    number = r"\s*([0-9]*\.?[0-9]+)"
    found = logs.select(
        F.col(key).alias("key"),
        F.transform(F.regexp_extract_all(line, F.lit("silence_start:" + number), F.lit(1)), lambda x: x.cast("double")).alias("starts"),
        F.transform(F.regexp_extract_all(line, F.lit("silence_end:" + number), F.lit(1)), lambda x: x.cast("double")).alias("ends"),
    )
    rising = (F.array_sort("starts") == F.col("starts")) & (F.array_sort("ends") == F.col("ends"))
    pairs = _met_in_order(found.filter(rising)).unionByName(_met_one_by_one(found.filter(~rising)))
    return pairs.select("key", *[F.round(c, 3).alias(c) for c in ("start_sec", "end_sec")])


def _met_in_order(found: DataFrame) -> DataFrame:
    """Starts with their ends, both rising. Of the ends, a start's first later one has the number of ends up to the start
    as its place (from 0); and as each end is used once, a start's place is one over that of the start before, if that is
    more: place(i) = i + the greatest of rank(j) - j over the starts up to i."""
    starts = found.select("key", F.posexplode("starts").alias("i", "t")).withColumn("side", F.lit(1))
    ends = found.select("key", F.posexplode("ends").alias("i", "t")).withColumn("side", F.lit(0))
    line = spread(starts.unionByName(ends), "t", "side", "i")
    order = ["t", "side", "i"]
    ranked = kept_step(scanned(line, order, {"rank": so_far("sum", F.when(F.col("side") == 0, 1).otherwise(0))}))
    ahead = scanned(ranked.filter("side = 1"), order, {"most": so_far("max", F.col("rank") - F.col("i"))})
    wanted = ahead.select("key", (F.col("i") + F.col("most")).alias("place"), F.col("t").alias("start_sec"))
    return wanted.join(line.filter("side = 0").select("key", F.col("i").cast("bigint").alias("place"), F.col("t").alias("end_sec")), ["key", "place"]).select("key", "start_sec", "end_sec")


def _met_one_by_one(found: DataFrame) -> DataFrame:
    """The same for logs whose times fall somewhere, which a working detector doesn't write: one start after the other,
    with a pointer into the ends that only moves forward."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_sec:double,end_sec:double>>").alias("out"))

    def step(state: Column, start: Column) -> Column:
        later = F.filter(F.transform("ends", lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda x: (x.i >= state.at) & (x.e > start))
        nearest = F.get(later, F.lit(0))
        pair = F.array(F.struct(start.alias("start_sec"), nearest.e.alias("end_sec")))
        return F.when(nearest.isNull(), F.struct(F.size("ends").alias("at"), state.out.alias("out"))).otherwise(F.struct((nearest.i + 1).alias("at"), F.concat(state.out, pair).alias("out")))

    return found.select("key", F.explode(F.aggregate("starts", empty, step, lambda s: s.out)).alias("r")).select("key", "r.start_sec", "r.end_sec")


def media_type(mime: Column, filename: Column) -> Column:
    """Kind of a file: by its MIME type's prefix, else by its suffix, else unknown."""
    suffix = F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1))
    #: fixed values
    kinds = {"video": [".mp4", ".mov", ".avi", ".mkv", ".webm"], "audio": [".mp3", ".wav", ".aac", ".m4a"], "image": [".png", ".jpg", ".jpeg", ".gif", ".webp"]}
    out = F.lit("unknown")
    for kind, suffixes in reversed(kinds.items()):
        out = F.when(suffix.isin(suffixes), kind).otherwise(out)
    for kind in reversed(kinds):
        out = F.when(F.lower(F.coalesce(mime, F.lit(""))).startswith(kind + "/"), kind).otherwise(out)
    return out


def ingestible(url: Column) -> Column:
    """Whether a URL can be fetched: http or https with a host."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != ""), F.lit(False))
