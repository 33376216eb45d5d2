"""Column functions on text: tokens, fillers, concepts, queries, timecodes, shaping of names and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.params import EDITOR_FILLERS, FILLERS, STOP_WORDS

TOKEN = "[A-Za-z0-9']+"


def squeezed(text: Column) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and apostrophes, lower-cased; null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def first_of_each(items: Column, most: int) -> Column:
    """Items trimmed, without empty ones and without those that an earlier one equals but for case; most at most.
    Order is kept. One pass over the items that holds what it has found, so its time is in proportion to their number."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        new = (F.size(s.k) < most) & ~F.array_contains(s.k, F.lower(x))
        return F.when(new, F.struct(F.array_append(s.v, x).alias("v"), F.array_append(s.k, F.lower(x)).alias("k"))).otherwise(s)

    return F.aggregate(clean, F.struct(none.alias("v"), none.alias("k")), step, lambda s: s.v)


def is_filler(text: Column) -> Column:
    """Whether a word is a filler that automatic cuts remove: trailing punctuation aside."""
    return F.regexp_replace(F.lower(F.trim(text)), "[.,!?;:]+$", "").isin(list(FILLERS))


def is_editor_filler(text: Column) -> Column:
    """Whether the editor marks a word as filler: all but letters and white space aside."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z\s]", "")).isin(list(EDITOR_FILLERS))


def found_in(text: Column, query: str) -> Column:
    """Case-insensitive substring; an empty query finds nothing."""
    return F.lit(False) if not query.strip() else F.contains(F.lower(text), F.lit(query.strip().lower()))


def latin_share(text: Column) -> Column:
    """ASCII letters among all letters; 1 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters == 0, 1.0).otherwise(F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.greatest(letters, F.lit(1)))


def with_concepts(rows: DataFrame, text: str, out: str = "concepts") -> DataFrame:
    """Adds a text's concepts: its four most frequent tokens of three letters or more that aren't stop words, ties by
    first place; else its first three tokens; else "general". Made in steps, so that no step repeats another's work."""
    rows = rows.withColumn("_every", tokens(F.col(text)))
    rows = rows.withColumn("_used", F.filter("_every", lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS)))
    rows = rows.withColumn("_used", F.when(F.size("_used") > 0, F.col("_used")).otherwise(F.slice("_every", 1, 3)))
    # equal tokens lie together in sorted order, the first place first: a run's length is a token's count
    rows = rows.withColumn("_sorted", F.array_sort(F.transform("_used", lambda t, i: F.struct(t.alias("t"), i.alias("at")))))
    begins = F.filter(F.transform("_sorted", lambda x, i: F.when((i == 0) | (F.get("_sorted", i - 1).t != x.t), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_begins", begins)
    run = lambda i, k: F.struct((i - F.coalesce(F.get("_begins", k + 1), F.size("_sorted"))).alias("n"), F.get("_sorted", i).at.alias("at"), F.get("_sorted", i).t.alias("t"))
    rows = rows.withColumn("_ranked", F.transform("_begins", run))
    named = F.transform(F.slice(F.array_sort("_ranked"), 1, 4), lambda r: r.t)
    return rows.withColumn(out, F.when(F.size("_used") == 0, F.array(F.lit("general"))).otherwise(named)).drop("_every", "_used", "_sorted", "_begins", "_ranked")


def concept_text(concepts: Column) -> Column:
    return F.when(concepts == F.array(F.lit("general")), "general scene").otherwise(F.array_join(concepts, " "))


def entities(text: Column) -> Column:
    """Up to eight runs of one to three capitalised words, three letters at least, each once but for case."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b"), F.lit(1))
    return first_of_each(F.filter(found, lambda x: F.length(F.trim(x)) >= 3), 8)


def expanded_queries(chunk: Column, concept: Column, concepts: Column, named: Column, most: int = 6) -> Column:
    """Search queries for a chunk: concept, its first three tokens, three of its entities (named) alone and with two
    tokens, and the chunk's first four tokens; each once."""
    with_tokens = lambda e: F.when(F.size(concepts) > 0, F.array(e, F.concat_ws(" ", e, F.array_join(F.slice(concepts, 1, 2), " ")))).otherwise(F.array(e))
    named = F.flatten(F.transform(F.slice(named, 1, 3), with_tokens))
    return first_of_each(F.concat(F.array(concept, F.array_join(F.slice(concepts, 1, 3), " ")), named, F.array(F.array_join(F.slice(tokens(chunk), 1, 4), " "))), most)


def search_queries(concept: Column, concepts: Column, hints: Column, most: int = 3, in_all: int = 6) -> Column:
    """Provider queries: concept and its first three, two and one tokens, most of them; then hints, up to in_all."""
    own = first_of_each(F.concat(F.array(concept), F.transform(F.array(*map(F.lit, (3, 2, 1))), lambda n: F.array_join(F.slice(concepts, F.lit(1), n), " "))), most)
    return first_of_each(F.concat(own, hints), in_all)


def token_overlap(base: Column, other: Column) -> Column:
    """Share of base's distinct tokens that other has; 0 without any."""
    distinct = F.array_distinct(base)
    return F.when(F.size(distinct) == 0, 0.0).otherwise(F.size(F.array_intersect(distinct, other)) / F.greatest(F.size(distinct), F.lit(1)))


def timecode(text: Column, strict: bool = True) -> Column:
    """Seconds of `[h:]m:ss[.fraction]` or of a number with an optional unit of seconds. Other texts fail the query if
    strict, else are null."""
    t = F.trim(text)
    clock, plain = r"^(?:(\d+):)?(\d{1,2}):(\d{2})(?:\.(\d+))?$", r"(?i)^(\d+(?:\.\d+)?)\s*(?:s|sec|secs|second|seconds)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, clock, i), F.lit("")).cast("double"), F.lit(0.0))
    fraction = F.coalesce(F.concat(F.lit("0."), F.nullif(F.regexp_extract(t, clock, 4), F.lit(""))).cast("double"), F.lit(0.0))
    wrong = F.raise_error(F.concat(F.lit("invalid timecode: "), t)) if strict else F.lit(None)
    return F.when(t.rlike(clock), part(1) * 3600 + part(2) * 60 + part(3) + fraction).when(t.rlike(plain), F.regexp_extract(t, plain, 1).cast("double")).otherwise(wrong.cast("double"))


def clock_label(seconds: Column) -> Column:
    """m:ss; unknown times are 0:00."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 1e15)
    s = F.when(ok, seconds).otherwise(0.0)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.floor(s % 60).cast("string"), 2, "0"))


def short_label(seconds: Column) -> Column:
    """Under a second in milliseconds, else in seconds with one decimal."""
    return F.when(seconds < 1, F.concat(F.round(seconds * 1000).cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", seconds), F.lit("s")))


def fixed_label(seconds: Column) -> Column:
    """Seconds with two decimals; unknown times are 0.00."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 1e15)
    return F.format_string("%.2f", F.when(ok, seconds).otherwise(0.0))


def file_name_of(url: Column, default: str = "broll") -> Column:
    """A safe file name from a URL's path: runs of other characters become _, and an unknown suffix .mp4."""
    last = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"([^/]*)/*$", 1)
    suffix = F.lower(F.regexp_extract(last, r"[^.](\.[^.]+)$", 1))
    stem = F.when(last.rlike(r"[^.]\.[^.]+$"), F.regexp_replace(last, r"\.[^.]+$", "")).otherwise(last)
    clean = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.concat(F.when(clean == "", default).otherwise(clean), F.when(suffix.isin(".mp4", ".mov", ".m4v", ".webm", ".mkv"), suffix).otherwise(".mp4"))


def public_path(path: Column) -> Column:
    """Where an uploaded file is served."""
    return F.concat(F.lit("/static/uploads/"), path)


def resolved_path(path: Column, root: str) -> Column:
    """Where a stored file lies: absolute paths are their own, others are under root."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def source_tag(source_type: Column) -> Column:
    return F.when(source_type == "pexels_video", "Pexels").when(source_type == "pixabay_video", "Pixabay").when(source_type == "project_asset", "Library").otherwise(source_type)


def breakdown_chips(parts: dict[str, Column]) -> Column:
    """The first three known parts of a score, as labels with percentages."""
    chips = F.array(*[F.when(v.isNotNull() & ~F.isnan(v), F.concat(F.lit(k + " "), F.round(v * 100).cast("long").cast("string"), F.lit("%"))) for k, v in parts.items()])
    return F.slice(F.filter(chips, lambda c: c.isNotNull()), 1, 3)


def drawtext(text: Column) -> Column:
    """Text with apostrophes removed and the renderer's special characters escaped."""
    return F.regexp_replace(F.replace(text, F.lit("'"), F.lit("")), r"([\\:,%\[\];])", r"\\$1")


def candidate_text(label: Column, source: Column, query: Column, url: Column, hits: Column, page: Column | None = None, tags: Column | None = None, filename: Column | None = None, metadata: Column | None = None) -> Column:
    """What a candidate says of itself: label, source, query, page, tags, keyword hits, its URL's host and path, its
    asset's file name and the text of its metadata (operators.documents); what isn't known is left out."""
    part = lambda p: F.translate(F.coalesce(F.try_parse_url(url, F.lit(p)), F.lit("")), "/", " ")
    spaced = lambda items: F.lit(None).cast("string") if items is None else F.array_join(F.coalesce(items, F.array().cast("array<string>")), " ")
    known = lambda c: F.lit(None).cast("string") if c is None else c
    return squeezed(F.concat_ws(" ", label, source, query, known(page), spaced(tags), spaced(hits), part("HOST"), part("PATH"), known(filename), known(metadata)))


def confidence_label(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x >= 0.78, "high").when(x >= 0.55, "medium").otherwise("low")


def truthy(text: Column, default: bool = False) -> Column:
    """A setting's text as a boolean: 1, true, yes, on or 0, false, no, off; anything else is the default."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False).otherwise(default)


def number_setting(text: Column, kind: str, default: float, least: float) -> Column:
    """A setting's text as a number of at least least; unreadable ones have the default."""
    return F.greatest(F.coalesce(text.try_cast(kind), F.lit(default).cast(kind)), F.lit(least).cast(kind))


def listed(text: Column) -> Column:
    """The non-empty items of a comma-separated setting."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
