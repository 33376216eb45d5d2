"""Texts that hold terms of a long list, by one automaton over all terms or, of a longer list, by a join."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.stored import written

#: characters of the terms that one automaton holds; texts meet a longer list by a join
MOST = 8_000_000


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place."""
    return (at > 0 and _wordy(text[at - 1])) != (at < len(text) and _wordy(text[at]))


def first_term(automaton: ahocorasick.Automaton, text: str) -> int | None:
    """The least number of the terms in text: those with a blank anywhere, others as whole words."""
    found = None
    for end, (number, size, whole) in automaton.iter(text):
        if (found is None or number < found) and (not whole or (_edge(text, end + 1 - size) and _edge(text, end + 1))):
            found = number
    return found


def automaton_of(terms: list[str], numbers: list[int]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, number in zip(terms, numbers, strict=True):
        out.add_word(term, (number, len(term), " " not in term))
    out.make_automaton()
    return out


def blocked(docs: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term", most: int = MOST) -> DataFrame:
    """docs with term: the first by name of the terms that its text holds, or null; terms with a blank count anywhere,
    others as whole words, case aside. Terms are taken as distinct, without blanks around them, and without empty ones. A
    null text holds none.

    A list of up to most characters is one automaton, through which every text is read. A longer one isn't held by any
    task: texts meet it by a join (_joined)."""
    clean = terms.select(F.lower(F.trim(term_col)).alias("t")).filter("t <> ''").distinct()
    size = clean.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > most:
        return _joined(docs, written(clean), text_col)
    mine = [x.t for x in clean.orderBy("t").toLocalIterator()]
    return docs.withColumn("term", _found(docs, mine)(F.col(text_col)) if mine else F.lit(None).cast("string"))


def _found(docs: DataFrame, terms: list[str]):
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = shared.value
        automaton = automaton_of(terms, list(range(len(terms))))
        for series in texts:
            hits = [None if t is None else first_term(automaton, t.lower()) for t in series]
            yield pd.Series([None if h is None else terms[h] for h in hits], dtype=object)

    return F.pandas_udf(find, "string")


#: bits of the filter of a long list: at least so many a term, and at most (32 MB); and of a part of it in one row
BITS, MOST_BITS, PART_BITS = 32, 28, 19
#: characters of texts that are looked at together
CHUNK = 1 << 18
_ODD, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Text:
    """Texts in a row, and the hashes of their windows."""

    def __init__(self, texts: list[str]) -> None:
        self.text = "\n".join(texts)
        self.ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.size = len(codes)
        powers, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(self.size, x, dtype=np.uint64)], dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
        self.sums = np.r_[np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)]
        self.codes = codes

    def hashes(self, starts: np.ndarray, size: int | np.ndarray, salt: int) -> np.ndarray:
        h = (self.sums[starts + size] - self.sums[starts]) * self.inverse[starts] + np.uint64(salt)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
        return h ^ (h >> np.uint64(29))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter."""
    mask = np.uint64((1 << bits) - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _set_bits(frames: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """The filter's bits of terms: of a term's beginning, as long as the greatest power of two that it has, and of all."""
    for frame in frames:
        terms = list(frame.t)
        for at in range(0, len(terms), 10_000):
            x = _Text(terms[at : at + 10_000])
            starts = np.r_[0, x.ends[:-1] + 1]
            sizes = x.ends - starts
            begun = 1 << (np.frexp(sizes.astype(float))[1] - 1)
            places = np.concatenate([*_places(x.hashes(starts, begun, 1), bits), *_places(x.hashes(starts, sizes, 2), bits)])
            yield pd.DataFrame({"place": np.unique(places).astype(np.int64)})


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    part = np.zeros(1 << PART_BITS, dtype=bool)
    part[frame.place.to_numpy() & ((1 << PART_BITS) - 1)] = True
    return pd.DataFrame({"part": [int(frame.place.iloc[0]) >> PART_BITS], "bits": [np.packbits(part).tobytes()]})


def _joined(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """blocked() for terms (t) that no task could hold. A filter of a bounded size, made of terms' hashes, goes to all tasks.
    They look at the windows of a text that are as long as some terms, and begin and end like words where those have to;
    what passes the filter joins the terms themselves, so that only what is equal to one counts."""
    spark = docs.sparkSession
    lengths = terms.groupBy((F.instr("t", " ") == 0).alias("whole"), F.length("t").alias("size")).count().collect()
    bits = min(MOST_BITS, max(PART_BITS, (BITS * sum(x["count"] for x in lengths)).bit_length()))
    parts = terms.mapInPandas(lambda frames: _set_bits(frames, bits), "place long").groupBy(F.shiftright("place", PART_BITS)).applyInPandas(_packed, "part int, bits binary")
    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for x in parts.toLocalIterator():
        bitmap[x.part << (PART_BITS - 3) : (x.part + 1) << (PART_BITS - 3)] = np.frombuffer(x.bits, dtype=np.uint8)
    kinds: dict[tuple[bool, int], list[int]] = {}
    for x in sorted(lengths, key=lambda x: x["size"]):
        kinds.setdefault((x.whole, 1 << (x["size"].bit_length() - 1)), []).append(x["size"])
    shared = spark.sparkContext.broadcast(bitmap)

    def passing(x: _Text, starts: np.ndarray, size: int, salt: int) -> np.ndarray:
        starts = starts[starts + size <= x.size]
        for place in _places(x.hashes(starts, size, salt), bits):
            on = (shared.value[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1
            starts = np.where(on == 1, starts, -1)
        return starts[starts >= 0]

    def windows(texts: list[str], wordy: np.ndarray) -> list[set[str]]:
        x = _Text(texts)
        out: list[set[str]] = [set() for _ in texts]
        word = wordy[x.codes]
        edge = np.r_[False, word] != np.r_[word, False]
        for (whole, begun), sizes in kinds.items():
            starts = passing(x, np.flatnonzero(edge) if whole else np.arange(x.size), begun, 1)
            for size in sizes:
                ends = starts + size
                some = starts[ends <= x.size]
                some = passing(x, some[edge[some + size]] if whole else some, size, 2)
                at = np.searchsorted(x.ends, some, side="right")
                for s, d in zip(some.tolist(), at.tolist(), strict=True):
                    if s + size <= x.ends[d] and (" " in (found := x.text[s : s + size])) != whole:
                        out[d].add(found)
        return out

    def look(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wordy = np.fromiter((_wordy(chr(i)) for i in range(0x110000)), dtype=bool, count=0x110000)
        for texts in series:
            found, some, size = [], [], 0
            for t in texts:
                some.append("" if t is None else t.lower())
                size += len(some[-1]) + 1
                if size >= CHUNK:
                    found += windows(some, wordy)
                    some, size = [], 0
            found += windows(some, wordy) if some else []
            yield pd.Series([sorted(f) for f in found], dtype=object)

    rows = written(docs.withColumns({"_row": F.monotonically_increasing_id(), "_some": F.pandas_udf(look, "array<string>")(F.col(text_col))}))
    hits = rows.select("_row", F.explode("_some").alias("t")).join(terms, "t").groupBy("_row").agg(F.min("t").alias("term"))
    return rows.drop("_some", "term").join(hits, "_row", "left").select(*[c for c in docs.columns if c != "term"], "term")
