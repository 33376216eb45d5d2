"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every text becomes hashes of its k-word grams; in each window of grams the least hash is kept (the rightmost of equal
ones). A span of span = window + k - 1 words that a document shares with a benchmark item holds a whole window of
grams, so both keep the same gram of it: fingerprints that meet in a join find every such span. Hits are then extended
to all the spans around them, whose words are compared in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .urlfilter import LOWER, UPPER

#: what separates words, once A-Z are lower-cased
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
_POSITION = (1 << 32) - 1


@dataclass(frozen=True)
class Winnow:
    """span: words of a window of the contamination rule. gram: words a fingerprint. broadcast: up to so many
    benchmark rows (fingerprints or windows, counted first) are broadcast; more are joined by shuffling."""

    span: int = 13
    gram: int = 5
    broadcast: int = 200_000


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none. lower() is used where only ASCII can be in play."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.regexp_extract_all(F.coalesce(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit("")), F.lit(WORD), 1)


def _grams(words: DataFrame, size: int) -> Column:
    """For each position in the column h (word hashes), the gram's hash in the upper 32 bits and the position, counted
    down, in the lower, so that of equal hashes the rightmost is least."""
    gram = lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(size)])
    packed = lambda i: gram(i).bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.lit(_POSITION) - i)
    return F.when(F.size("h") >= size, F.transform(F.sequence(F.lit(0), F.size("h") - size), packed)).otherwise(F.array().cast("array<bigint>"))


def _winnowed(rows: DataFrame, window: int) -> Column:
    """The grams of column g that are least in some window of that many; of fewer grams, none is kept."""
    least = lambda i: F.least(*[F.get("g", i + j) for j in range(window)])
    return F.when(F.size("g") >= window, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("g") - window), least))).otherwise(F.array().cast("array<bigint>"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def _hash(v: Column) -> Column:
    return F.shiftright(v, 32)


def _place(v: Column) -> Column:
    return (F.lit(_POSITION) - v.bitwiseAND(F.lit(_POSITION))).cast("int")


def _window(start: Column, length: int) -> Column:
    """The words of a window as one text; words hold no spaces."""
    return F.concat_ws(" ", *[F.get("words", start + j) for j in range(length)])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rule: Winnow = Winnow(),
) -> DataFrame:
    """For each row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated, and mark (xxhash64 of the text).

    A window is span consecutive words of an item, or all the words of an item with fewer. n_hit counts the document's
    words that lie in an occurrence of a window; n_items the items with one; items_sha256 is the SHA-256 of their ids,
    sorted as strings and comma-joined. contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and wordless texts have
    no words and are clean; items without words have no window; an empty benchmark leaves everything clean. Items with
    a null id count as one item named by the empty string. Repeated rows each get their own result, also where one id
    has different texts. Other columns are not read.

    Items shorter than span have no full window to winnow: each is looked for at every position where its first gram
    (of up to gram words) is, in a pass that is made only if the benchmark has such items.
    """
    gram, window = rule.gram, rule.span - rule.gram + 1
    items = store.written(
        _hashed(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text_col)).alias("words"))).filter(F.size("words") > 0), "items"
    )
    full, short = items.filter(F.size("words") >= rule.span), items.filter(F.size("words") < rule.span)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    key = ["id", "mark"]

    tokens = _hashed(base.select(*key, words_of(F.col("text")).alias("words")))
    tokens = tokens.withColumn("g", _grams(tokens, gram)).select(*key, F.size("words").cast("long").alias("n_words"), "g")
    prints = store.written(tokens.select(*key, "n_words", _winnowed(tokens, window).alias("v")), "fingerprints")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= rule.broadcast else df

    marked = full.withColumn("g", _grams(full, gram))
    item_prints = store.written(marked.select(F.explode(_winnowed(marked, window)).alias("v")).select(_hash(F.col("v")).alias("hash")).distinct(), "item-fingerprints")
    hits = prints.select(*key, F.explode("v").alias("v")).withColumn("hash", _hash(F.col("v"))).join(small(item_prints), "hash", "left_semi")
    hits = hits.select(*key, _place(F.col("v")).alias("place"), F.lit(rule.span).alias("length"))
    lengths = [r.n for r in short.select(F.size("words").alias("n")).distinct().collect()]  # at most span - 1 numbers
    for size in sorted({min(n, gram) for n in lengths}):
        starts = short.filter(F.least(F.size("words"), F.lit(gram)) == size)
        starts = starts.withColumn("g", _grams(starts, size)).select(_hash(F.get("g", F.lit(0))).alias("hash"), F.size("words").alias("length")).distinct()
        dense = _hashed(base.select(*key, words_of(F.col("text")).alias("words")))
        dense = dense.select(*key, F.explode(_grams(dense, size)).alias("v")).withColumn("hash", _hash(F.col("v"))).join(small(starts), "hash")
        hits = hits.unionByName(dense.select(*key, _place(F.col("v")).alias("place"), "length"))

    places = store.written(hits.groupBy(*key, "length").agg(F.collect_set("place").alias("places")), "hits")
    same = base["id"].eqNullSafe(places["id"]) & (base["mark"] == places["mark"])
    found = base.join(places, same).select(base["id"], base["mark"], "text", "length", "places").dropDuplicates([*key, "length"]).select(*key, "length", "places", words_of(F.col("text")).alias("words"))
    found = found.withColumn("n", F.size("words"))
    around = F.transform("places", lambda p: F.sequence(F.greatest(p - (window - 1), F.lit(0)), F.greatest(F.least(p, F.col("n") - rule.span), F.greatest(p - (window - 1), F.lit(0)))))
    candidates = None
    for n in sorted({rule.span, *lengths}):
        at = F.array_distinct(F.flatten(around)) if n == rule.span else F.col("places")
        part = found.filter(F.col("length") == n).withColumn("at", at)
        part = part.select(*key, F.lit(n).alias("length"), F.explode(F.transform("at", lambda s: F.struct(s.alias("start"), _window(s, n).alias("window"), (s + n <= F.col("n")).alias("whole")))).alias("c"))
        part = part.filter("c.whole").select(*key, "length", "c.start", "c.window")
        candidates = part if candidates is None else candidates.unionByName(part)

    windows = full.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - rule.span), lambda s: _window(s, rule.span))).alias("window"))
    windows = windows.union(short.select("item", F.array_join("words", " "))).distinct()
    windows = store.written(windows, "windows")
    spans = store.written(candidates.join(small(windows), "window").select(*key, "start", "length", "item"), "spans")

    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    longer = lambda s, x: F.struct(F.greatest(s.end, x.start + x.length).alias("end"), (s.n + F.greatest(x.start + x.length - F.greatest(s.end, x.start), F.lit(0))).alias("n"))
    hit = spans.groupBy(*key).agg(F.aggregate(F.sort_array(F.collect_set(F.struct("start", "length"))), state, longer, lambda s: s.n).alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    hit = hit.select(F.col("id").alias("hit_id"), F.col("mark").alias("hit_mark"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = prints.join(hit, prints["id"].eqNullSafe(hit["hit_id"]) & (prints["mark"] == hit["hit_mark"]), "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        prints["mark"],
    )
