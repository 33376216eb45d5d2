"""Operators 11 to 13 and their queries against plain versions of their contracts, over whole results."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import audit, periodic, queries, store, topk

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def saved(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# 11


def audited(rows, labels):
    """The contract of op11, one document and one order at a time. rows: doc_id, text, lang."""
    # a row without an id has no labels
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    failed = []
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text.encode())
        f = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        failed.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, *_ in failed}:
            for step, c in enumerate(order, 1):
                before = set(order[: step - 1])
                n = Counter()
                for p, f, g, t in failed:
                    if p != part:
                        continue
                    gone = bool(f & before)
                    n["kept"] += not gone and c not in f
                    n["removed"] += not gone and c in f
                    n["redundant"] += gone and c in f
                    n["unique_fails"] += f == {c}
                    n["good_lost"] += not gone and c in f and g
                    n["toxic_lost"] += not gone and c in f and t
                out[part, order, step] = n
                shapley[part, c] += n["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, o, s, *(n[x] for x in names), shapley[p, o[s - 1]]) for (p, o, s), n in out.items())


def words_of(r, n, kinds):
    return " ".join(r.choice(["w", "W", "ww", "é"]) + str(r.randrange(kinds)) for _ in range(n))


def test_audit_by_brute_force(spark, tmp_path):
    r = random.Random(11)
    texts = [None, "", "A", "long " * 120, *[words_of(r, r.choice([3, 99, 100, 130]), r.choice([5, 400])) + r.choice(["", " #", "|", " A" * 40]) for _ in range(40)]]
    rows = [(i, r.choice(texts), r.choice([None, "", "en", "de"])) for i in [*range(60), 7, 7, None, None]]
    labels = [(r.randrange(70), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    sf = saved(spark, tmp_path, documents=([(*x, "s", 1) for x in rows], "doc_id long, text string, lang string, digest string, n int"), labels=(labels, "doc_id long, quality int, toxic int"))
    got = queries.op11_filter_audit(spark, sf)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)


def test_audit_without_documents_or_labels(spark, tmp_path):
    schema = "doc_id long, text string, lang string"
    sf = saved(spark, tmp_path, documents=([], schema), labels=([], "doc_id long, quality int, toxic int"))
    assert queries.op11_filter_audit(spark, sf).count() == 0
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "en")], schema)
    counts = audit.failure_counts(docs, {"short": F.length("text") < 9}, labels=None, repeats="again")
    assert sorted((sorted(x.failed), x.n, x.quality) for x in counts.collect()) == [(["again", "short"], 1, False), (["short"], 1, False)]


# 12


def searched(rows, k=5):
    """rows: vec_id, vector."""
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(whole):
        if i is None or i % 50:
            continue
        found = [(-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0, j) for b, (j, w) in enumerate(whole) if a != b and len(w) == len(v)]
        out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_topk_by_brute_force(spark, size):
    r = np.random.default_rng(size)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.3, 6)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(90)] + [(50, rows[3][1]), (50, rows[3][1]), (None, rows[50][1]), (100, None), (150, [0.1, None]), (150, [float("nan")] * 6), (200, [1.0]), (250, []), (251, []), (300, [0.5, 0.5])]
    vectors = store.written(topk.quantised(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v"), "v")
    got = topk.nearest(vectors, vectors.filter("id % 50 = 0"), 5, block=size, query_block=3, span=4).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect()), key=repr) == searched(rows)


def test_topk_reads_part_of_its_lists(spark, monkeypatch):
    """Vectors near a query end the search before all is read; what is left out can't be among the best."""
    read = []
    monkeypatch.setattr(topk, "ROUNDS", (1 / 16, 1 / 4, 1))
    monkeypatch.setattr(topk.np, "partition", lambda a, *x, f=np.partition, **y: read.append(1) or f(a, *x, **y))
    r = np.random.default_rng(2)
    cells = r.integers(-20, 20, (2000, 8))
    cells[:20] = 200
    block = {"n": 2000, "n_dims": 8, "ids": np.arange(2000), "nulls": np.zeros(2000, np.uint8), "uids": np.arange(2000), "cells": cells, "lists": np.argsort(cells, 0, kind="stable").astype(np.uint32).T.copy()}
    packed = {c: v if isinstance(v, int) else v.tobytes() for c, v in block.items()}
    asked = packed | {"n": 4, "uids": np.arange(5000, 5004).tobytes(), "cells": cells[:4].tobytes()}
    found = topk._Queries(asked, 5)
    topk._search(found, topk._Block(packed), 5)
    assert [[i for *_, i, _ in best] for best in found.best] == [[0, 1, 2, 3, 4]] * 4 and len(read) == 1


def test_topk_beyond_doubles(spark):
    big = 2.0**20
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 1.0 + 1 / 256]), (3, [big, 1.0 + 2 / 256]), (4, [-big, 1.0])]
    vectors = store.written(topk.quantised(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v"), "v")
    got = topk.nearest(vectors, vectors.filter("id = 0"), 2).collect()
    assert [(x.vec_id, x.score) for x in sorted(got, key=lambda x: x["rank"])] == [(3, 2**56 + 256 * 258), (2, 2**56 + 256 * 257)]


def test_topk_query(spark, sf_dir, tmp_path):
    rows = [(i, [0.25 * j - i / 8 for j in range(3)]) for i in range(120)]
    sf = saved(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, queries.op12_topk(spark, sf).collect()), key=repr) == searched(rows)
    (tmp_path / "none").mkdir()
    assert queries.op12_topk(spark, saved(spark, tmp_path / "none", embeddings=([], "vec_id long, embedding array<float>"))).count() == 0


# 13


def all_runs(w, words=6, periods=4):
    found = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(words, periods * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((a, n, p) for (a, n), p in found.items())


def repeating(r):
    kinds, w = r.choice([1, 2, 3, 5]), []
    for _ in range(r.randint(0, 6)):
        some = [r.randrange(kinds) for _ in range(r.randint(1, 6))] * r.randint(1, 7)
        w += some[: len(some) - r.randrange(len(some))]
        if w and r.random() < 0.5:
            a = r.randrange(len(w))
            w += w[a : a + r.randint(1, 40)]
    return w


def test_runs_by_brute_force():
    r = random.Random(13)
    n = 0
    for _ in range(3000):
        w = repeating(r)
        words, periods = r.choice([(6, 4), (6, 4), (1, 3), (8, 5)])
        expected = all_runs(w, words, periods)
        assert periodic.runs_of(w, periodic.Least(words, periods)) == expected
        assert periodic.runs_of_words([b"%d" % x for x in w], periodic.Least(words, periods)) == expected
        n += len(expected)
    assert n > 3000


def test_factors():
    r = random.Random(5)
    for _ in range(500):
        w = repeating(r)
        at = 0
        for begin, end, shift in periodic.factors(w):
            earlier = [j for j in range(begin) if w[j : j + end - begin] == w[begin:end]]
            assert begin == at and (begin - shift in earlier if shift else end == begin + 1 and not earlier)
            # no longer stretch has come before
            assert end == len(w) or not any(w[j : j + end + 1 - begin] == w[begin : end + 1] for j in range(begin))
            at = end
        assert at == len(w)


def test_stretches_hold_all_runs():
    r = random.Random(6)
    for _ in range(500):
        w = repeating(r)
        cuts = periodic.stretches(np.array(w, np.int64))
        assert all(b < c for (_, b), (c, _) in itertools.pairwise(cuts))
        assert all(any(a <= x and x + n <= b for a, b in cuts) for x, n, _ in all_runs(w))


def documented(rows):
    out = []
    for i, text in rows:
        words = WORD.findall((text or "").encode())
        n = len(words)
        if i is not None and zlib.crc32(str(i).encode()) % 10 == 0 and n:
            g = zlib.crc32(str(i).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = all_runs(words)
        gone = {k for a, long, p in runs for k in range(a + p, a + long)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
        out.append((i, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(listed), sha(b" ".join(w for k, w in enumerate(words) if k not in gone))))
    return sorted(out, key=repr)


def test_periodic_query_by_brute_force(spark, tmp_path):
    r = random.Random(3)
    named = ["A", "a", "é", "x y", "A0"]
    text = lambda: r.choice([" ", "\n", "\x0b\t "]).join(named[x] + r.choice(["", "", "", " "]) for x in repeating(r))
    rows = [(i, text()) for i in range(400)] + [(3, None), (3, ""), (3, " \n"), (None, "a " * 9), (None, "a " * 9), (400, "b " * 30000 + "c"), (401, " ".join("zzzzzzz"))]
    rows += [(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z".replace(" ", r.choice([" ", "  "]))) for i in range(500, 700)]
    sf = saved(spark, tmp_path, documents=([(*x, "en", 5) for x in rows], "doc_id long, text string, found string, runs int"))
    got = queries.op13_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = documented(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert sum(x[1] > 0 for x in expected) > 100


def test_periodic_runs_of_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, queries.op13_periodic_runs(spark, sf_dir).collect()), key=repr) == documented([(x.doc_id, x.text) for x in docs.collect()])


def test_periodic_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(docs).count() == 0


def test_collapsed_text_and_spans(spark):
    docs = spark.createDataFrame([(1, "keep ha ha ha ha ha ha this")], "doc_id long, text string")
    found = periodic.periodic_runs(docs).first().found
    assert found.collapsed == "keep ha this" and [tuple(x) for x in found.runs] == [(1, 6, 1)] and found.n_words == 8


def test_planted_words_are_few_kinds():
    """A planted tail repeats its first words: its number of kinds is at most its period."""
    r = random.Random(8)
    kinds = defaultdict(int)
    for h in range(0, 4000, 10):
        words = [b"%d" % r.randrange(10**9) for _ in range(60)]
        out = periodic.planted(words, h)
        kinds[len(out) == 60 and out[: (h // 10) % 60] == words[: (h // 10) % 60]] += 1
        assert periodic.planted(words, h + 1) == words
    assert kinds == {True: 400}
