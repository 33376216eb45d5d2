"""Toxicity scores: lexicon terms and their misspellings, weighed by the words around them.

The lexicon is learned from labelled texts: words and word beginnings that occur in toxic texts far more often than
chance allows. A trie holds it; the Levenshtein automaton of a text's word runs through the trie, so one walk finds
every term within its distance. Each hit's window of words tells quotation from abuse, and a logistic regression over
what the hits amount to gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: fixed values: words that report speech, and words that address a reader
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes reported claims claimed term word slur insult insults dit écrit schrieb sagte sagt dijo escribió".split())
ADDRESS = frozenset("you your youre yours u ur ya du dich dir dein ihr euch tu toi vous votre tú te ti usted ustedes".split())
QUOTES = "\"“”„«»‘’"
N_FEATURES = 6


@dataclass(frozen=True)
class Params:
    """sample: labelled rows that a model is fitted on at most (in expectation; drawn by a hash of the id). window:
    words on each side of a hit that its context is. stem: lengths of word beginnings tried as terms. least_texts:
    toxic texts that have a term, at least. The
    number of terms is bounded by the sample alone."""

    sample: int = 20_000
    window: int = 8
    stem: tuple[int, int] = (4, 8)
    least_texts: int = 3
    penalty: float = 1.0


@dataclass
class Model:
    """terms: word -> weight; stems: word beginning -> weight; covered: words that begin with a stem -> their own weight,
    which their misspellings are looked up by; variants: misspelling -> weight, as the labelled texts
    have it; coefficients: of the features, intercept first."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    covered: dict[str, float] = field(default_factory=dict)
    variants: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [-20.0] + [0.0] * N_FEATURES)
    window: int = 8


def allowed(term: str) -> int:
    """The edits that a term of this length may be away: short words have too many neighbours."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """Terms as nested dicts; the key "" holds the term that ends at a node, and "*" the stem, after which any rest of
    a word may follow."""

    def __init__(self, terms, stems=()) -> None:
        self.root: dict = {}
        self.parts: dict[int, list[tuple[int, int, set[str]]]] = {}
        starts: dict[tuple[int, int], set[str]] = {}
        for stem in stems:
            node = self.root
            for c in stem:
                node = node.setdefault(c, {})
            node["*"] = stem
            k, n = allowed(stem), len(stem)
            cuts = [n * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for shift in range(-k, k + 1):
                    if a + shift >= 0:
                        starts.setdefault((a + shift, b + shift), set()).add(stem[a:b])
        self.starts = [(a, b, texts) for (a, b), texts in starts.items()]
        shapes: dict[tuple[int, int, int], set[str]] = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            k, n = allowed(term), len(term)
            cuts = [n * j // (k + 1) for j in range(k + 2)]
            for length in range(n - k, n + k + 1):
                for a, b in zip(cuts, cuts[1:], strict=False):
                    for shift in range(-k, k + 1) if k else (0,):
                        if 0 <= a + shift and b + shift <= length:
                            shapes.setdefault((length, a + shift, b + shift), set()).add(term[a:b])
        for (length, a, b), texts in shapes.items():
            self.parts.setdefault(length, []).append((a, b, texts))

    def may_match(self, word: str) -> bool:
        """Cut into one part more than its edits, some part of a term is unharmed, at most that many places off."""
        return any(word[a:b] in texts for a, b, texts in self.parts.get(len(word), ())) or any(word[a:b] in texts for a, b, texts in self.starts)

    def nearest(self, word: str) -> tuple[int, str] | None:
        """The nearest term, or stem of any beginning of word, within its allowed distance (of several, the first by
        name), by running the Levenshtein automaton of word through the trie. A state of the automaton is its set of (place in word, edits so far)."""
        n, best = len(word), None
        most = 2 if n >= 7 else 1
        stack = [(self.root, _closed({(0, 0)}, n, most))]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c in ("", "*"):
                    edits = min((e + n - i if c == "" else e for i, e in state), default=most + 1)
                    if edits <= allowed(child) and (best is None or (edits, child) < best):
                        best = (edits, child)
                    continue
                step = set()
                for i, e in state:
                    if i < n and word[i] == c:
                        step.add((i + 1, e))
                    elif e < most:
                        step.add((i, e + 1))
                        if i < n:
                            step.add((i + 1, e + 1))
                if step:
                    stack.append((child, _closed(step, n, most)))
        return best


def _closed(state: set[tuple[int, int]], n: int, most: int) -> frozenset[tuple[int, int]]:
    """With the states reached by leaving out letters of the word; of states at one place only the best stays."""
    least: dict[int, int] = {}
    for i, e in sorted(state):
        while i <= n and e <= most and e < least.get(i, most + 1):
            least[i] = e
            i, e = i + 1, e + 1
    return frozenset(least.items())


class Matcher:
    """What a word is to the lexicon: None, or its weight, whether it is misspelled and the term."""

    def __init__(self, model: Model) -> None:
        self.model, self.trie, self.known = model, Trie({**model.terms, **model.covered}, model.stems), {}
        self.weights = {**model.stems, **model.covered, **model.terms}
        self.lengths = sorted({len(s) for s in model.stems})

    def __call__(self, word: str):
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) > 400_000:
                self.known.clear()
            found = self.known[word] = self._find(word)
            return found

    def _find(self, word: str):
        if (weight := self.model.terms.get(word)) is not None:
            return weight, False, word
        for n in self.lengths:
            if len(word) >= n and (weight := self.model.stems.get(word[:n])) is not None:
                return weight, False, word[:n]
        if self.trie.may_match(word) and (near := self.trie.nearest(word)):
            weight = self.model.variants.get(word, 0.6 * self.weights[near[1]])
            return weight, True, near[1]
        return None


def hits(text: str, matcher: Matcher) -> list[tuple[str, str, float, bool, float, float]]:
    """(word, term, weight, misspelled, quotation 0 to 1, abuse 0 to 1) of each hit, and the window scores it got."""
    text = text.lower()  # WORD takes A-Z as separators
    tokens = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    found = [(i, got) for i, (_, _, w) in enumerate(tokens) if (got := matcher(w)) is not None and got[0] > 0]
    places, out, window = {i for i, _ in found}, [], matcher.model.window
    for i, (weight, misspelled, term) in found:
        low, high = max(0, i - window), min(len(tokens), i + window + 1)
        before, after = text[tokens[low][0] : tokens[i][0]], text[tokens[i][1] : tokens[high - 1][1] + 1]
        near = [w for _, _, w in tokens[low:high]]
        opened = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
        quotation = min(1.0, 0.6 * opened + 0.4 * any(w in REPORTING for w in near))
        abuse = min(1.0, 0.5 * any(w in ADDRESS for w in near) + 0.2 * ("!" in after) + 0.3 * any(j in places for j in range(low, high) if j != i))
        out.append((tokens[i][2], term, weight, misspelled, quotation, abuse))
    return out


def features_of(found: list, n_words: int) -> list[float]:
    """What a text's hits amount to: exact and misspelled weight, the strongest hit, quoted weight, number, density."""
    if not found:
        return [0.0] * N_FEATURES
    force = [w * (1 - 0.5 * q) * (1 + 0.25 * a) for _, _, w, _, q, a in found]
    exact = sum(f for f, h in zip(force, found, strict=True) if not h[3])
    return [min(exact, 30.0) / 10, min(sum(force) - exact, 30.0) / 10, min(max(force), 15.0) / 10, min(sum(h[2] * h[4] for h in found), 30.0) / 10, math.log1p(len(found)), min(1.0, 20 * len(found) / max(n_words, 1))]


def _scan(texts, matcher: Matcher) -> Iterator[tuple[list, int]]:
    """The hits and number of words of each text; most texts have none and are left after one look at their words."""
    for text in texts:
        if not isinstance(text, str) or not text:
            yield [], 0
            continue
        words = WORD.findall(text.lower())
        some = False
        for w in set(words):
            got = matcher(w)
            if got is not None and got[0] > 0:
                some = True
                break
        yield (hits(text, matcher) if some else []), len(words)


def learn(labelled: DataFrame, text_col: str, label_col: str, params: Params = Params()) -> Model:
    """A model from rows of a text and its label (1: toxic). The caller bounds the rows (see labelled_sample); the
    terms' counts are made by tasks, only significant terms and a few numbers a row come to the driver. Null texts
    are empty and rows with null labels aren't used. Without rows of both labels no text will be called toxic."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), (F.col(label_col) == 1).cast("int").alias("label")).filter("label is not null")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    n_toxic, n_clean = total["toxic"], total["n"] - total["toxic"]
    model = Model(window=params.window)
    if not n_toxic or not n_clean:
        return model
    low, high = params.stem

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = set(WORD.findall(text.lower()))
                seen[label].update({w[:k] + "*" for w in words for k in range(low, min(high, len(w) - 1) + 1)} | words)
            if len(seen[0]) > 250_000:
                yield pd.DataFrame([(t, seen[1][t], n) for t, n in seen[0].items()], columns=["term", "toxic", "clean"])
                seen[0].clear()
                yield pd.DataFrame([(t, n, 0) for t, n in seen[1].items()], columns=["term", "toxic", "clean"])
                seen[1].clear()
        yield pd.DataFrame([(t, seen[1][t], seen[0][t]) for t in seen[0].keys() | seen[1].keys()], columns=["term", "toxic", "clean"])

    counts = rows.filter("text is not null").mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # terms that chance would put this high fewer than once among all that are tried: 2 ln(terms) of the likelihood ratio
    n = F.col("toxic") + F.col("clean")
    share = n_toxic / (n_toxic + n_clean)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(0.0)
    ratio = 2 * (part("toxic", share) + part("clean", 1 - share))
    tried = rows.select(F.coalesce(F.length("text"), F.lit(0)).alias("c")).agg(F.sum("c").alias("c")).first()["c"]
    significant = ((F.col("toxic") >= params.least_texts) & (F.col("toxic") >= 19 * F.col("clean")) & (ratio >= 2 * math.log(max(10, tried / 20))))
    tested = {r["term"] for r in counts.filter(significant).select("term").collect()}

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = set()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = ["", *WORD.findall(text.lower()), ""]
                for i in range(1, len(words) - 1):
                    w = words[i]
                    for term in (w, *(w[:k] + "*" for k in range(low, min(high, len(w) - 1) + 1))):
                        if term in tested:
                            seen.add((term, label, zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode())))
            yield pd.DataFrame(list(seen), columns=["term", "label", "place"])

    # copies and passages that texts share repeat a term between the same words: it counts once there, and has to pass again
    apart = rows.filter("text is not null").mapInPandas(places, "term string, label int, place long").distinct()
    apart = apart.groupBy("term").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    found = {r["term"]: (r["toxic"], r["clean"]) for r in apart.filter(significant).collect()}
    model.terms, model.stems, model.covered = _lexicon(found, n_toxic, n_clean, params)

    matcher = Matcher(model)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, size, label, [h[0] for h in got if h[3]]) for k, ((got, size), label) in enumerate(zip(_scan(batch["text"], matcher), batch["label"], strict=True))]
            yield pd.DataFrame([(label, list(set(v))) for _, _, label, v in out], columns=["label", "variants"])

    seen = rows.mapInPandas(look, "label int, variants array<string>").select("label", F.explode("variants").alias("v"))
    for r in seen.groupBy("v").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect():
        near = matcher.trie.nearest(r["v"])
        odds = (r["toxic"] + 1.6) / (n_toxic + 2) * (n_clean + 2) / (r["n"] - r["toxic"] + 0.4)
        model.variants[r["v"]] = min(0.6 * matcher.weights[near[1]], math.log(odds))

    matcher = Matcher(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(label, features_of(got, size)) for (got, size), label in zip(_scan(batch["text"], matcher), batch["label"], strict=True)], columns=["label", "x"])

    # equal rows as one: most texts have no hit
    table = rows.mapInPandas(measure, "label int, x array<double>").groupBy("label", "x").agg(F.count("*").alias("n")).collect()
    table.sort(key=lambda r: (r["label"], list(r["x"])))
    model.coefficients = _logistic(np.array([r["x"] for r in table]), np.array([r["label"] for r in table], float), np.array([r["n"] for r in table], float), params.penalty)
    return model


def _lexicon(found: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, params: Params) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Of nested beginnings and words, the longest that still stands for nearly all texts of the shorter ones; and the
    words that these beginnings cover."""
    longer: dict[str, int] = {}
    for term, (toxic, _) in found.items():
        body = term.rstrip("*")
        for k in range(params.stem[0], len(body) + (term == body)):
            key = body[:k] + "*"
            if key != term:
                longer[key] = max(longer.get(key, 0), toxic)
    kept = {t: c for t, c in found.items() if not t.endswith("*") or longer.get(t, 0) < 0.95 * c[0]}
    stems = {t[:-1] for t in kept if t.endswith("*")}
    weight = lambda c: math.log((c[0] + 0.5) / (n_toxic + 1)) - math.log((c[1] + 0.5) / (n_clean + 1))
    out: tuple[dict[str, float], dict[str, float], dict[str, float]] = ({}, {}, {})
    for term, c in sorted(kept.items(), key=lambda x: (-x[1][0], x[0])):
        body = term.rstrip("*")
        covered = any(body[:k] in stems for k in range(params.stem[0], len(body)))
        if not covered:
            out[term.endswith("*")][body] = weight(c)
        elif term == body:
            out[2][body] = weight(c)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float) -> list[float]:
    """Newton's method with an L2 penalty on all but the intercept; coefficients can't be negative but for quotation."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w += step
        w[[1, 2, 3, 5, 6]] = np.maximum(w[[1, 2, 3, 5, 6]], 0)
        if np.abs(step).max() < 1e-9:
            break
    # a misspelled term that the labelled texts never had counts as much as a spelled one of its (lower) weight
    if not x[:, 2].any() or w[2] < w[1]:
        w[2] = w[1]
    return w.tolist()


def score(text: Column, model: Model) -> Column:
    """The score of a text column under a model: 0 to 1, higher for likelier toxic. Null and empty texts, and all
    without a hit, get the score of a text without hits. Whole texts are read."""
    coefficients = np.array(model.coefficients)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model)
        for texts in batches:
            x = np.array([[1.0, *features_of(got, size)] for got, size in _scan(texts, matcher)]).reshape(len(texts), -1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ coefficients, -30, 30)))) if len(texts) else pd.Series([], dtype=float)

    return scored(text.cast("string"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str, params: Params = Params()) -> DataFrame:
    """Rows of docs with their labels, some params.sample of them at most: labels are drawn by a hash of the id, so a
    rerun draws the same, and are broadcast, as that number bounds them. Ids with several labels are left out."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_other")).filter("_label = _other")
    n = one.count()
    drawn = one.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, params.sample / max(n, 1)))).select("_id", "_label")
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "_id").select("text", F.col("_label").alias("label"))
