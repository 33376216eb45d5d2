"""Personal data in texts, in DataFrame operations only: patterns of four kinds, and bootstrapped contexts.

Matches of the four patterns are seeds; for the fifth kind, secrets, seeds are long strings that mix letters and digits,
wherever they stand. What stands around a seed (the word before with its punctuation, two words, or one on each side),
with the class of the seed's shape, makes its lexical patterns. Patterns and values then score each other for a few
rounds: a pattern's belief is the part of its values that are sure, a value's score that of its surest pattern. Patterns
that have gained enough sure values, seeds or not, take part in the next round, so what was found in one context leads to
others. Values that end with a high score are identifiers too, wherever they stand. Only contexts make a secret: a seed
of that kind counts for its patterns, but is itself reported where a sure pattern holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: the last kind has no pattern of its own: only contexts find it
KINDS = ("email", "ip", "card", "phone", "secret")
#: Each finds what its plain form finds from left to right. Look-behinds stand for "where a run begins", so a failing
#: run is tried once and not again from each of its characters, and possessive groups need no stack.
PATTERNS = (
    r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # a whole run of digits with single blanks or hyphens between some, if it has 14 to 19
    r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: What else could be an identifier, each as long as it goes: a run of letters mixed with digits, something around an at
#: sign, or groups of digits. A run is tried at its beginning only, so a text is read once.
FILLER = (
    r"(?<![\p{L}\p{N}_+/.@-])(?=[A-Za-z_+/.-]*+[0-9])(?=[0-9_+/.-]*+[A-Za-z])[A-Za-z0-9_+/.-]{6,}+={0,2}+(?![\p{L}\p{N}@])"
    r"|(?<![^\s\"'<>])[^\s@\"'<>]++@[^\s@\"'<>]++"
    r"|(?<![\p{L}\p{N}_+/.@-])[+(]?[0-9]++(?![\p{L}_])(?:[() ./-]{1,3}+[0-9]++(?![\p{L}_]))*+"
)
OTHER = len(PATTERNS)
#: a filler has so many characters; a secret's seed so many, of them so many digits and so many letters
LEAST, KEY, KEY_EACH = 7, 20, 4
#: longer patterns are known by a digest
LONG = 256


@dataclass(frozen=True)
class Bootstrap:
    """rounds of the pattern-value graph; a pattern's belief is the sure part of its values, of their number plus doubt;
    patterns need support sure values; values with a pattern of belief threshold or more are taken."""

    rounds: int = 4
    doubt: float = 2.0
    support: int = 5
    threshold: float = 0.8


def _luhn(digits: Column) -> Column:
    def part(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part), F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == 1, F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255))
        .when(kind == 2, _luhn(digits))
        .when(kind == 3, F.length(digits).between(10, 15))
        .otherwise(True)
    )


def _spans(texts: DataFrame) -> DataFrame:
    """id, mark, kind (a number; OTHER for fillers), start, end (code points, end exclusive), value, and before and
    after (the ends of what surrounds it), of all matches in (uid, id, mark, text) rows. A text is split at its matches;
    running sums of the pieces' lengths place them."""
    here = (F.instr("text", "@") > 0, F.lit(True), F.lit(True), F.instr("text", "+") > 0, F.lit(True))
    finds = []
    # the two words before a match are read backwards from its piece's end, so that only they are looked at
    words_before = lambda p: F.reverse(F.regexp_extract(F.reverse(p), r"^[^\p{L}\n]{0,6}+\p{L}++(?:[^\p{L}\n]{1,6}+\p{L}++)?", 0))
    word_after = lambda p: F.regexp_extract(p, r"^[^\p{L}\n]{0,6}+\p{L}++", 0)
    for kind, (pattern, may) in enumerate(zip((*PATTERNS, FILLER), here, strict=True)):
        split = F.split("text", pattern, -1)
        pieces = F.transform(split, lambda p: F.struct(F.length(p).alias("n"), words_before(p).alias("before")))
        heads = F.transform(F.slice(split, 2, F.size(split)), word_after)
        found = F.struct(F.lit(kind).alias("kind"), pieces.alias("p"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), heads.alias("after"))
        finds.append(F.when(may & F.col("text").rlike(pattern), found))
    rows = texts.select("uid", "id", "mark", F.explode(F.filter(F.array(*finds), lambda f: f.isNotNull())).alias("f"))
    rows = rows.select("uid", "id", "mark", "f.kind", F.posexplode(F.arrays_zip(F.col("f.p").alias("p"), F.col("f.m").alias("m"), F.col("f.after").alias("after"))).alias("i", "z"))
    rows = rows.filter("z.m is not null").select("uid", "id", "mark", "kind", "i", F.col("z.p.n").alias("n"), F.col("z.p.before").alias("before"), F.col("z.after").alias("after"), F.col("z.m").alias("value"))
    place = Window.partitionBy("uid", "kind").orderBy("i")
    end = F.sum(F.col("n") + F.length("value")).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", end).select("id", "mark", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "before", "after")


def _lexical(before: Column, after: Column, value: Column) -> Column:
    """The patterns of a match: the class of its shape (what has an at sign, four dotted numbers, letters mixed with
    digits, or digits: under 7, to 13 or more), with the word before and the punctuation between, with two such words, and
    with one on each side. Where there is no word on a side its patterns are missing."""
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    shape = F.when(F.instr(value, "@") > 0, "@").when(value.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "quad").when(value.rlike("[A-Za-z]"), "mixed").when(n < 7, "short").when(n <= 13, "digits").otherwise("long")
    left, two = (F.regexp_extract(F.lower(before), pattern, 1) for pattern in (r"(\p{L}+[^\p{L}\n]{0,6})$", r"(\p{L}+[^\p{L}\n]{1,6}\p{L}+[^\p{L}\n]{0,6})$"))
    right = F.regexp_extract(F.lower(after), r"^([^\p{L}\n]{0,6}\p{L}+)", 1)
    sides = (("left", left, F.lit("")), ("two", two, F.lit("")), ("both", F.when(right != "", left), right))
    short = lambda p: F.when(F.length(p) > LONG, F.sha2(p, 256)).otherwise(p)
    named = [F.when(a != "", short(F.concat_ws("\t", F.lit(name), shape, a, b))) for name, a, b in sides]
    return F.filter(F.array(*named), lambda p: p.isNotNull())


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Bootstrap = Bootstrap()) -> DataFrame:
    """One row for each span: id_col, mark, kind (name), start, end (code points, end exclusive), value and base, which
    is true for pattern matches and false for what contexts added. Secrets are never base. mark is xxhash64 of the text, so rows that share an
    id but not a text stay apart; equal rows share spans, listed once. Null and empty texts have none.

    Matches are leftmost and don't overlap within a kind; addresses with parts over 255, cards that fail the Luhn check
    or have fewer than 14 or more than 19 digits, and phones with fewer than 10 or more than 15 are dropped. Added
    spans never overlap a base span. A value that fits two kinds has the surer one, of ties the first as listed. Values
    and patterns are pre-aggregated before they meet: a value or a context that is everywhere is one row of each task,
    and what is joined is distinct values and patterns.
    """
    # the number only tells rows apart until their matches have places
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    kept = F.when(F.col("kind") == OTHER, F.length("value") >= LEAST).otherwise(_valid(F.col("kind"), F.col("value")))
    spans = store.written(_spans(texts).filter(kept).distinct(), "spans")
    seeds = spans.filter(F.col("kind") < OTHER)

    # fillers that no base span touches
    order = Window.partitionBy("id", "mark").orderBy("start", "kind")
    reach = F.max(F.when(F.col("kind") < OTHER, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(F.col("kind") < OTHER, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = spans.withColumns({"reach": reach, "next": following}).filter((F.col("kind") == OTHER) & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True))))
    count = lambda pattern: F.length(F.regexp_replace("value", pattern, ""))
    key_like = (F.length("value") >= KEY) & (F.instr("value", "@") == 0) & (count("[^0-9]") >= KEY_EACH) & (count("[^A-Za-z]") >= KEY_EACH)
    unknown = store.written(free.select("id", "mark", "start", "end", "value", _lexical(F.col("before"), F.col("after"), F.col("value")).alias("patterns"), F.when(key_like, OTHER).alias("kind")), "fillers")

    known = seeds.select("value", "kind", _lexical(F.col("before"), F.col("after"), F.col("value")).alias("patterns"))
    places = known.union(unknown.select("value", "kind", "patterns"))
    edges = store.written(places.select("value", "kind", F.explode("patterns").alias("pattern")).distinct(), "pattern-edges")
    certain = edges.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("sure")).distinct()
    sizes = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
    # values that no pattern of a kind has matched; whether one is a secret's seed follows from the value alone
    base_values = certain.filter(F.col("kind") < OTHER).select("value").distinct()
    open_edges = store.written(edges.filter(F.coalesce(F.col("kind"), F.lit(OTHER)) == OTHER).join(base_values, "value", "left_anti").select("value", "pattern", F.col("kind").isNotNull().alias("seed")), "open-edges")
    sure = certain
    for turn in range(plan.rounds + 1):
        # patterns: those with enough sure values, found ones included
        gained = edges.select("pattern", "value").distinct().join(sure, "value").groupBy("pattern", "kind").agg(F.sum("sure").alias("sure"), F.count_if(F.col("sure") >= plan.threshold).alias("known")).filter(F.col("known") >= plan.support)
        beliefs = gained.join(sizes, "pattern").select("pattern", "kind", (F.col("sure") / (F.col("n") + plan.doubt)).alias("belief"))
        # values: the surest pattern that they fill. Weak ones don't add up: a number may stand after many words. In the
        # last turn secrets' seeds are asked, too
        asked = open_edges if turn == plan.rounds else open_edges.filter("not seed")
        scored = asked.join(beliefs, "pattern").groupBy("value", "kind").agg(F.max("belief").alias("sure"))
        values = store.written(scored, f"values-{turn}")
        sure = certain.union(values)
    found = values.filter(F.col("sure") >= plan.threshold)
    kinds = found.groupBy("value").agg(F.max_by("kind", F.struct("sure", -F.col("kind"))).alias("kind"))
    added = unknown.drop("kind").join(kinds, "value").select("id", "mark", "kind", "start", "end", "value", F.lit(False).alias("base")).distinct()
    out = seeds.select("id", "mark", "kind", "start", "end", "value", F.lit(True).alias("base")).union(added)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return out.select(F.col("id").alias(id_col), "mark", name.alias("kind"), "start", "end", "value", "base")


def digests(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, the number of base spans of each kind (n_email and so on), base_sha256 and spans,
    lists of kind:start:end by start and then kind. Documents without spans have zeros and the empty list."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = spans.withColumn("item", F.struct("start", order.alias("k"), "end", F.concat_ws(":", "kind", "start", "end").alias("t"), "base"))
    each = rows.groupBy(F.col(id_col).alias("s_id"), F.col("mark").alias("s_mark")).agg(
        F.sort_array(F.collect_list("item")).alias("items"), *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS[:OTHER]]
    )
    listed = lambda items: F.array_join(F.transform(items, lambda x: x.t), ",")
    each = each.withColumns({"base_list": listed(F.filter("items", lambda x: x.base)), "spans": listed(F.col("items"))}).drop("items")
    base = docs.select(F.col(id_col), F.xxhash64(text_col).alias("mark"))
    out = base.join(each, base[id_col].eqNullSafe(each["s_id"]) & (base["mark"] == each["s_mark"]), "left")
    none = F.lit("")
    return out.select(id_col, *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS[:OTHER]], F.sha2(F.coalesce("base_list", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"))


def redacted(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in brackets, as in [EMAIL]; spans that touch or overlap
    become one, named by the first. All rows and columns stay; texts without spans are unchanged, null stays null."""
    at = Window.partitionBy(id_col, "mark").orderBy("start", F.desc("end"), "kind")
    before = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = spans.withColumn("before", before).withColumn("island", island).groupBy(id_col, "mark", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    cuts = merged.groupBy(F.col(id_col).alias("cut_id"), F.col("mark").alias("cut_mark")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    # every span has a digit or an at sign: other texts stay where they are. The columns are a struct meanwhile, so that
    # no name clashes
    may = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False))
    some = docs.filter(may).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = some.join(cuts, F.col("id").eqNullSafe(F.col("cut_id")) & (F.xxhash64("text") == F.col("cut_mark")), "left")
    kept_from = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1).getField("end")).cast("int")
    piece = lambda c, i: F.concat(F.substring("text", kept_from(i) + 1, (c.start - kept_from(i)).cast("int")), F.lit("["), F.upper(c.kind), F.lit("]"))
    tail = F.expr("substring(text, cast(element_at(cuts, -1).end as int) + 1)")
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("cuts", piece), ""), tail))
    new = [text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    return docs.filter(~may).unionByName(rows.select(*new))
