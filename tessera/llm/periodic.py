"""Periodic runs of words: stretches that repeat a phrase back to back, found after Kolpakov and Kucherov.

A text's words are cut into Lempel-Ziv factors by walking a suffix automaton. Main's algorithm finds the runs that
touch a factor's beginning, from longest common extensions on both sides of it; a run that lies inside a factor is that
of the factor's earlier occurrence and is copied. All of it is linear in the words.

Only runs of four periods or more are asked for, so most words need none of this: in a run of period q all words but
the first q come again within q places. Stretches where that is so are found first, in numpy, and no run lies outside of
them or is cut by them.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Least:
    """A run has at least so many words and so many (3 or more) periods."""

    words: int = 6
    periods: int = 4


def factors(w: list[int]) -> Iterator[tuple[int, int, int]]:
    """Lempel-Ziv factors (begin, end, shift): the longest stretch from begin on that also begins shift earlier (the
    two may overlap), or a single new word, with shift 0. Transitions of the suffix automaton are two arrays for a
    state's first and a dict for those few states that have more."""
    n = len(w)
    length, link, first_end = array("i", [0]), array("i", [-1]), array("i", [-1])
    letter, target, more = array("i", [-1]), array("i", [-1]), {}
    last = 0
    for i, c in enumerate(w):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        first_end.append(i)
        letter.append(-1)
        target.append(-1)
        p, q = last, -1
        while p >= 0:
            if letter[p] == c:
                q = target[p]
                break
            if letter[p] < 0:
                letter[p], target[p] = c, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: new}
                elif c in others:
                    q = others[c]
                    break
                else:
                    others[c] = new
            p = link[p]
        if q >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                first_end.append(first_end[q])
                letter.append(letter[q])
                target.append(target[q])
                if q in more:
                    more[clone] = dict(more[q])
                while p >= 0:
                    if letter[p] == c:
                        if target[p] != q:
                            break
                        target[p] = clone
                    else:
                        others = more[p]
                        if others.get(c) != q:
                            break
                        others[c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    i = 0
    while i < n:
        state, j = 0, i
        while j < n:
            c = w[j]
            to = target[state] if letter[state] == c else more[state].get(c, -1) if state in more else -1
            # a first occurrence that ends before j began before i
            if to < 0 or first_end[to] >= j:
                break
            state, j = to, j + 1
        yield (i, j, j - 1 - first_end[state]) if j > i else (i, i + 1, 0)
        i = max(j, i + 1)


def _z(s: list[int]) -> list[int]:
    """For each place, how many words from there on equal those from the beginning on."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _touching(w: list[int], before: int, c: int, end: int, least: Least) -> Iterator[tuple[int, int, int]]:
    """Runs (begin, end of run, period) with begin <= c <= end of run <= end, where [before, c) and [c, end) are two
    factors that follow each other, the latter empty after the last word. A run that reaches into the second begins less
    than its period before the first (else that factor would have been longer), which bounds the periods and how far back
    to look; one that ends at c and began by the first's beginning was found there."""
    far = end - before
    most = (far - 1) // (least.periods - 1)
    if most < 1:
        return
    right, low = w[c:end], max(0, before - most)
    back = w[low:c][::-1]
    # how far each later place of the right part agrees with its beginning; then places before c
    ahead = _z(right)
    over = _z([*right, -1, *w[max(0, c - most) : c], *right])
    at_c = len(over) - len(right)
    behind = _z(back)
    reach = min(most, len(right))
    across = _z([*back, -1, *w[low : c + reach][::-1]])
    across_at = len(back) + 1
    n = len(w)
    for p in range(1, most + 1):
        found = []
        if p <= c - low:
            # a period before c: c-p against c, to the right and to the left
            forward = min(over[at_c - p], len(right))
            backward = behind[p] if p < len(behind) else 0
            found.append((c - p - backward, c + forward))
        if p <= len(right):
            forward = ahead[p] if p < len(right) else 0
            backward = across[across_at + reach - p]
            found.append((c - backward, c + p + forward))
        for a, b in found:
            if b - a >= least.periods * p and b - a >= least.words and (b == n or b < end or w[b] != w[b - p]) and (a == 0 or w[a - 1] != w[a - 1 + p]):
                yield a, b, p


def runs_of(w: list[int], least: Least = Least()) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers >= 0, by start and then period: stretches with smallest
    period q, of at least least.periods * q and least.words, that no neighbour extends."""
    found: dict[tuple[int, int], int] = {}
    ends: dict[int, list[int]] = {}
    starts: list[int] = []

    def add(a: int, b: int, p: int) -> None:
        if (a, b) not in found:
            if a not in ends:
                ends[a] = []
                insort(starts, a)
            ends[a].append(b)
            found[a, b] = p
        elif p < found[a, b]:
            found[a, b] = p

    before = 0
    for begin, end, shift in factors(w):
        if begin:
            for a, b, p in _touching(w, before, begin, end, least):
                add(a, b, p)
        if shift and end - begin > least.words:
            # inside this factor runs are those of its earlier occurrence, which may reach into the factor itself
            k = bisect_left(starts, begin - shift + 1)
            while k < len(starts) and starts[k] < end - shift:
                a = starts[k]
                for b in ends[a]:
                    if b < end - shift:
                        add(a + shift, b + shift, found[a, b])
                k += 1
        before = begin
    for a, b, p in _touching(w, before, len(w), len(w), least):
        add(a, b, p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def stretches(w: np.ndarray, least: Least = Least()) -> list[tuple[int, int]]:
    """Disjoint stretches (begin, end) outside of which no run lies: for each power of two, the places whose word has come
    within so many places, as many in a row as a run of half that period leaves, and that many places before them."""
    n = len(w)
    if n < least.words:
        return []
    order = np.argsort(w, kind="stable")
    ago = np.full(n, n + 1, np.int64)
    same = w[order[1:]] == w[order[:-1]]
    ago[order[1:][same]] = (order[1:] - order[:-1])[same]
    cuts, width = [], 1
    new = np.arange(n)
    while width // 2 + 1 <= n // least.periods:
        shortest = width // 2 + 1
        wanted = max((least.periods - 1) * shortest, least.words - width)
        new = new[ago[new] > width]
        edges = np.concatenate([[-1], new, [n]])
        long = np.flatnonzero(np.diff(edges) - 1 >= wanted)
        cuts += [(max(0, int(edges[k]) + 1 - width), int(edges[k + 1])) for k in long.tolist()]
        width *= 2
    out: list[tuple[int, int]] = []
    for a, b in sorted(cuts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of_words(words: list[bytes], least: Least = Least()) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a text's words."""
    if len(words) < least.words:
        return []
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    return [(a + start, long, p) for a, b in stretches(w, least) for start, long, p in runs_of(w[a:b].tolist(), least)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    for start, long, p in runs:
        step[start + p] += 1
        step[start + long] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return words if not gone.any() else [words[i] for i in np.flatnonzero(~gone).tolist()]


FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, text_col: str = "text", least: Least = Least(), seed_col: str | None = None, change: Callable[[list[bytes], int], list[bytes]] | None = None) -> DataFrame:
    """docs without text_col, and with found: the number of words `[^\\x20\\x09-\\x0D]+`, the runs by start and then
    period, and collapsed, the words that stay joined by one blank. change(words, number of seed_col), if given, is
    applied to words first where the number isn't null.

    One pass of rows in their tasks, nothing is shuffled; a task holds one text's words at a time. Null and empty texts
    have no words, no runs and an empty collapsed text. Equal rows are each answered; other columns, of any name but
    found, come along. Words are bytes of UTF-8, told apart by case.
    """

    def found(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, seed in texts:
            rows = []
            for t, s in zip(text, seed, strict=True):
                words = (t or "").encode().split()
                if change is not None and not pd.isna(s):
                    words = change(words, int(s))
                runs = runs_of_words(words, least)
                rows.append((len(words), [{"start": a, "length": b, "period": p} for a, b, p in runs], b" ".join(collapsed(words, runs)).decode()))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    seed = F.lit(None).cast("long") if seed_col is None else F.col(seed_col).cast("long")
    udf = F.pandas_udf(found, FOUND)
    left = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, seed_col)]
    return docs.select(*left, udf(F.col(text_col), seed).alias("found"))


def planted(words: list[bytes], h: int) -> list[bytes]:
    """Where h is a multiple of ten, the words from a place on repeat the few that stand there; place and period follow
    from h."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]

