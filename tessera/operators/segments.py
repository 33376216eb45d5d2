"""Cutting ordered words into chunks, sentences, paragraphs and captions, and folds that depend on what was kept.

Where a rule only looks at neighbours and counts, it is scans; where it depends on the chunk built so far, words know
where a chunk that began with them would end, and a walk along these steps tells where chunks begin. A key of any length
is worked on in many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.scan import SLICE, is_spread, kept_step, lag, scanned, slices_for, so_far, spread, to_come, walked, whole, with_following
from tessera.sources.stored import written


def _split(words: DataFrame, gap: float, size: int, ends: Column, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Adds the numbers of a chunk, which change after a gap, after a row where ends holds, and after size rows. Rows in
    another order than seq get their places in it as seq."""
    rows = scanned(words, order, {"_ago": lag(F.struct("end_sec", ends.alias("ends"))), "_at": so_far("sum", F.lit(1))})
    rows = rows if list(order) == ["seq"] else rows.drop(*order).withColumn("seq", F.col("_at"))
    new = F.coalesce((F.col("start_sec") - F.col("_ago.v.end_sec") > gap) | F.col("_ago.v.ends"), F.lit(True))
    rows = scanned(kept_step(rows.withColumn("_new", new).drop("_ago")), ["seq"], {"_part": so_far("max", F.when(F.col("_new"), F.col("_at")))})
    return rows.withColumn("_sub", F.floor((F.col("_at") - F.col("_part")) / size).cast("int"))


def _gathered(rows: DataFrame) -> DataFrame:
    """One row a chunk: key, chunk (from 1), first_seq, n, text, start_sec, end_sec. A chunk has a bounded number of
    words, so its text is too."""
    parts = rows.groupBy("key", "_part", "_sub").agg(
        F.min("seq").alias("first_seq"),
        F.count("*").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), " ").alias("text"),
        F.min_by("start_sec", "seq").alias("start_sec"),
        F.max_by("end_sec", "seq").alias("end_sec"),
        *[F.min(c).alias(c) for c in ([SLICE] if is_spread(rows) else [])],
    )
    return parts.drop("_part", "_sub")


def _numbered(chunks: DataFrame) -> DataFrame:
    rows = scanned(kept_step(chunks), ["first_seq"], {"chunk": so_far("sum", F.lit(1))})
    return rows.withColumn("chunk", F.col("chunk").cast("int"))


ENDS = r"[.!?]$"


def slot_chunks(words: DataFrame, least_words: int = 4, most: int | None = None, gap: float = 1.1, size: int = 14, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Chunks for slots: up to size words along order, split after gaps and sentence ends; those under least_words are
    dropped, and if most is given, the first most of a key stay."""
    found = _gathered(_split(words, gap, size, F.trim("text").rlike(ENDS), order)).filter(F.col("n") >= least_words)
    numbered = _numbered(found)
    return numbered if most is None else numbered.filter(F.col("chunk") <= most)


def sentences(words: DataFrame, gap: float = 1.1, size: int = 12) -> DataFrame:
    """Sentence blocks: up to size words, split after gaps and sentence ends."""
    return _numbered(_gathered(_split(words, gap, size, F.trim("text").rlike(ENDS))))


def paragraphs(blocks: DataFrame, gap: float = 1.5, size: int = 3) -> DataFrame:
    """Paragraph blocks: up to size sentences, split after gaps."""
    rows = blocks.select("key", F.col("chunk").alias("seq"), "text", "start_sec", "end_sec", *[c for c in blocks.columns if c == SLICE])
    return _numbered(_gathered(_split(rows, gap, size, F.lit(False))))


def _numbered_rows(words: DataFrame, order: list[str]) -> DataFrame:
    """words in slices along order, _at, their places in the key from 0, and _n, how many the key has. Slices of words
    that are spread must rise with order."""
    words = kept_step(words) if is_spread(words) else spread(words, *order)
    rows = scanned(words, order, {"_at": so_far("sum", F.lit(1)), "_n": whole("sum", F.lit(1))})
    return kept_step(rows.withColumn("_at", F.col("_at") - 1))


def captions(words: DataFrame, max_words: int | str = 3, max_chars: int | str = 42, max_gap: float | str = 0.55, least: float = 0.12, most: int = 8, order: Sequence[str] = ("start_sec", "seq"), slices: int | None = None) -> DataFrame:
    """Captions of a clip's words (key, text, start_sec, end_sec, and those of order): key, caption (from 1), text, start_sec
    and duration_sec. A caption ends before a gap, at max_words, where a word would make it longer than max_chars, after
    a sentence end from its second word on, and after a clause mark once it is one short of max_words (two at least).
    A limit can be the name of a column that is the same for all words of a key; max_words is then most at most.

    Words are dealt once, in slices along order, and each slice is read once (_captioned). Where a slice's first key began
    in an earlier slice, the caption that is open there takes none or a few of its words; so captions are formed from each
    of these words on, until these walks meet, and numbered for each. What the slices hand on is a row or two of each."""
    far = most if isinstance(max_words, str) else max_words
    said = words.withColumn("text", F.trim("text")).filter((F.col("text") != "") & F.col("key").isNotNull())
    limits = [(F.col(x) if isinstance(x, str) else F.lit(x)).alias(f"_most{i}") for i, x in enumerate((max_words, max_chars, max_gap))]
    needed = dict.fromkeys(["key", "text", "start_sec", "end_sec", *order, *[x for x in (max_words, max_chars, max_gap) if isinstance(x, str)]])
    said = said.select(*needed)
    rows = said.repartitionByRange(slices or slices_for(said), "key", *order).sortWithinPartitions("key", *order)
    mark = F.when(F.col("text").rlike(ENDS), 2).when(F.col("text").rlike("[,;:—–]$"), 1).otherwise(0)
    rows = rows.select(F.spark_partition_id().alias(SLICE), "key", "text", F.length("text").alias("_n"), mark.alias("_mark"), "start_sec", "end_sec", *limits)
    kinds = T.StructType([T.StructField(SLICE, T.IntegerType()), T.StructField("key", words.schema["key"].dataType)]).fields
    kinds = T.StructType([*kinds, *T._parse_datatype_string("_numbers array<int>, text string, _start double, _end double, _edge string").fields])
    made = written(rows.mapInArrow(lambda batches: _captioned(batches, far), kinds))
    edges = made.filter("_edge is not null").groupBy("key").agg(F.sort_array(F.collect_list(F.struct(SLICE, "_edge"))).alias("_edges"))
    handed = written(edges.select("key", F.udf(lambda edges: _handed_on(edges), "entries array<struct<slice:int,entry:int,before:int>>, captions array<struct<caption:int,text:string,_start:double,_end:double>>")("_edges").alias("r")))
    entries = handed.select(F.col("key").alias("_k"), F.explode("r.entries").alias("e")).select("_k", F.col("e.slice").alias("_s"), "e.entry", "e.before")
    # a row for each slice at most
    own = made.filter("_edge is null").join(F.broadcast(entries), (F.col("key") == F.col("_k")) & (F.col(SLICE) == F.col("_s")), "left")
    number = F.get("_numbers", F.coalesce("entry", F.lit(0))) + F.coalesce("before", F.lit(0)) + 1
    own = own.select("key", number.alias("caption"), "text", "_start", "_end").filter("caption is not null")
    out = own.union(handed.select("key", F.explode("r.captions").alias("c")).select("key", "c.caption", "c.text", "c._start", "c._end"))
    long = F.greatest(F.round(F.greatest(F.col("_end"), F.col("_start") + least) - F.col("_start"), 3), F.lit(least))
    return out.select("key", F.col("caption").cast("int").alias("caption"), "text", F.round("_start", 3).alias("start_sec"), long.alias("duration_sec"))


@dataclass
class _Open:
    """A caption that may go on: its words, and its number from 0 for each walk that it is on."""

    texts: list[str]
    chars: int
    mark: int
    start: float | None
    end: float | None
    numbers: dict[int, int]

    def ends_before(self, word: tuple) -> bool:
        _, n, _, start, _, most_words, most_chars, most_gap = word
        gap = None if start is None or self.end is None else start - self.end
        # as in SQL, what isn't a number is more than any
        far = gap is not None and (gap > most_gap or (gap != gap and most_gap == most_gap))
        size = len(self.texts)
        return far or size >= most_words or self.chars + 1 + n > most_chars or (size >= 2 and self.mark == 2) or (size >= max(2, most_words - 1) and self.mark == 1)

    def take(self, word: tuple) -> None:
        self.texts.append(word[0])
        self.chars, self.mark, self.end = self.chars + 1 + word[1], word[2], word[4]

    @classmethod
    def of(cls, word: tuple, numbers: dict[int, int]) -> _Open:
        return cls([word[0]], word[1], word[2], word[3], word[4], numbers)


def _captioned(batches: Iterator[pa.RecordBatch], far: int) -> Iterator[pa.RecordBatch]:
    """The captions of one slice, key by key, as words stream by. In the slice's first key, a walk begins at each of its
    first words, and walks that begin a caption at the same word are one from there on. The first and the last key have a
    row with _edge: the first words, which an open caption may take, and the captions that are open at the slice's end."""
    names = [SLICE, "key", "_numbers", "text", "_start", "_end", "_edge"]
    kind = here = key = None
    first, n, head, walks, out = True, 0, [], [], []

    def close(last: bool) -> None:
        if not last:
            for x in walks:
                emit(x)
        if first or last:
            opened = [[x.texts, x.chars, x.mark, x.start, x.end, list(x.numbers.items())] for x in walks] if last else None
            out.append((here, key, None, None, None, None, json.dumps([n, head if first else None, opened])))

    def emit(x: _Open) -> None:
        numbers = [x.numbers.get(e) for e in range(far)] if first else [x.numbers[0]]
        out.append((here, key, numbers, " ".join(x.texts), x.start, x.end, None))

    def packed() -> pa.RecordBatch:
        kinds = [pa.int32(), kind, pa.list_(pa.int32()), pa.string(), pa.float64(), pa.float64(), pa.string()]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        kind, out = batch.schema.field("key").type, []
        for place, owner, *word in zip(*[c.to_pylist() if c.null_count else c.to_pandas().tolist() for c in batch.columns], strict=True):
            if n and owner != key:
                close(False)
                first, n, head, walks = False, 0, [], []
            here, key = place, owner
            cut: dict[int, int] = {0: 0} if n == 0 else {}
            if first and 0 < n < far:
                cut[n] = 0
            going = []
            for x in walks:
                if x.ends_before(word):
                    emit(x)
                    cut |= {e: i + 1 for e, i in x.numbers.items()}
                else:
                    x.take(word)
                    going.append(x)
            walks = [*going, _Open.of(word, cut)] if cut else going
            if first and n < far - 1:
                head.append(word)
            n += 1
        yield packed()
    if n:
        out = []
        close(True)
        yield packed()


def _handed_on(edges: list) -> tuple[list, list]:
    """Along a key's slices: at which of its words each is entered and after how many captions, and the captions that
    were open where a slice ended."""
    entries, captions, number, going = [], [], 0, None
    for place, edge in edges:
        n, head, opened = json.loads(edge)
        entry = 0
        if going:
            while entry < len(head) and not going.ends_before(head[entry]):
                going.take(head[entry])
                entry += 1
        if going and entry < n:
            number += 1
            captions.append((number, " ".join(going.texts), going.start, going.end))
        if head is not None:
            entries.append((place, entry, number))
        if entry < n:
            going = None
            for *parts, numbers in opened or []:
                if entry in (on := dict(numbers)):
                    going, number = _Open(*parts, on), number + on[entry]
    if going:
        captions.append((number + 1, " ".join(going.texts), going.start, going.end))
    return entries, captions


def without_doubles(words: DataFrame, near: float = 0.05) -> DataFrame:
    """Words without those that repeat the last kept one: same text, start and end at most near apart.

    A word is compared with the last kept word, not with the last word. But one whose text differs from the word before, or
    that starts more than near after it, is kept whatever came before; so words between two such are a fold of their own,
    and of these only those of several words are looked at, one after the other as they stream by."""
    t = F.lower(F.trim("text"))
    order = ["start_sec", "end_sec", "_t", "seq"]
    rows = spread(words.withColumn("_t", t), *order)
    rows = scanned(rows, order, {"_ago": lag(F.struct("start_sec", "_t")), "_n": so_far("sum", F.lit(1))})
    apart = F.coalesce((F.col("_ago.v._t") != F.col("_t")) | (F.col("start_sec") - F.col("_ago.v.start_sec") > near), F.lit(True))
    rows = kept_step(rows.withColumn("_apart", apart).drop("_ago"))
    rows = kept_step(scanned(rows, order, {"_head": so_far("max", F.when(F.col("_apart"), F.col("_n")))}))
    close = rows.filter("not _apart").select("key", "_head").distinct()
    some = rows.join(close, ["key", "_head"], "left_semi").select("key", "_head", "_n", "start_sec", "end_sec").repartition("key", "_head").sortWithinPartitions("key", "_head", "_n")

    def gone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, a, b = None, 0.0, 0.0
        for frame in frames:
            out = []
            for key, head, n, start, end in frame.itertuples(index=False):
                if (key, head) == part and abs(start - a) <= near and abs(end - b) <= near:
                    out.append((key, n))
                else:
                    part, a, b = (key, head), start, end
            yield pd.DataFrame(out, columns=["key", "_n"])

    key_type = words.schema["key"].dataType.simpleString()
    doubles = some.mapInPandas(gone, f"key {key_type}, _n bigint")
    return rows.join(doubles, ["key", "_n"], "left_anti").select(*words.columns)


def without_loops(words: DataFrame, longest: int = 4, repeats: int = 3, least_words: int = 6) -> DataFrame:
    """Words (key, seq, ...) without phrase loops: where a phrase of up to longest words comes repeats times or more in
    a row, its first copy stays. Shorter phrases are tried first at each place. Transcripts of fewer than least_words
    stay as they are. Slices of words that are spread must rise with seq.

    For each length k, words that equal the word k later come in runs, and the rest of its run tells how often a phrase
    that begins at a word repeats. So every word has one successor, behind its loop or next to it, and those that the
    rule looks at are those that a walk from the first word on visits."""
    rows = words.withColumn("_said", F.regexp_replace(F.lower("text"), r"^[.,!?]+|[.,!?]+$", ""))
    rows = kept_step(with_following(_numbered_rows(rows, ["seq"]), {"_next": "_said"}, longest))
    same = lambda k: F.coalesce(F.get("_next", F.lit(k - 1)) == F.col("_said"), F.lit(False))
    ends = {f"_end{k}": to_come("min", F.when(~same(k), F.col("_at"))) for k in range(1, longest + 1)}
    rows = scanned(rows, ["_at"], ends)
    length = F.lit(1)
    to = F.col("_at") + 1
    for k in range(longest, 0, -1):
        copies = 1 + F.floor((F.col(f"_end{k}") - F.col("_at")) / k)
        loop = (copies >= repeats) & (F.col("_n") >= least_words)
        length, to = F.when(loop, k).otherwise(length), F.when(loop, F.col("_at") + copies * k).otherwise(to)
    rows = rows.withColumns({"_long": length, "_to": to}).drop("_next", "_n", "_said", *ends)
    seen = kept_step(walked(kept_step(rows)))
    # a word stays if the first copy that began last reaches it
    kept = scanned(seen, ["_at"], {"_reach": so_far("max", F.when(F.col("visited"), F.col("_at") + F.col("_long") - 1))})
    return kept.filter("_reach >= _at").select(*[c for c in words.columns if c != SLICE])


def deleted_regions(words: DataFrame) -> DataFrame:
    """Runs of deleted words as regions for display: key, start_sec, end_sec. words have deleted."""
    rows = scanned(words, ["seq"], {"_run": so_far("sum", (~F.col("deleted")).cast("int"))})
    return rows.filter("deleted").groupBy("key", "_run").agg(F.min_by("start_sec", "seq").alias("start_sec"), F.max_by("end_sec", "seq").alias("end_sec")).drop("_run")
