"""Each operator against a plain version of its rule, and on nulls, empty and repeated rows, ties, empty tables and
clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, hashing, interpolation, licenses, media, mixing, neardup, pii, queries, store, toxicity, urlfilter, warc

DOCS = "doc_id long, text string"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, texts, extra=False):
    rows = [(i, t, "x", 1) if extra else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + (", node string, n int" if extra else ""))


def spaced(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(hashing.LOWER))


# hashing


@pytest.mark.parametrize("block", [16, 64, 1 << 20])
def test_word_hashes(block, monkeypatch):
    monkeypatch.setattr(hashing, "BLOCK", block)
    monkeypatch.setattr(hashing, "_powers", [])
    r = random.Random(block)
    for _ in range(30):
        texts = [r.choice([None, "", "".join(r.choice("aB é\t\n x") for _ in range(r.randint(0, 200))), "z" * r.randint(0, 90)]) for _ in range(r.randint(0, 12))]
        hashes, cuts, words = hashing.word_hashes(pa.array(texts, pa.string()), True)
        assert words == [w for t in texts for w in spaced(t)]
        assert np.diff(cuts).tolist() == [len(spaced(t)) for t in texts]
        assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


# 1


def check_warc(rows, got, least=0):
    first = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= least and (data not in first or i < first[data]):
            first[data] = i
    for i, html in rows:
        data, r = (html or "").encode(), got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = first.get(data, i) != i
        assert (r.record_type, r.refers_to) == (("revisit", str(first[data])) if revisit else ("response", None))


def test_warc(spark, tmp_path):
    rows = [(1, "a" * 25), (2, None), (3, ""), (4, "é\r\n\r\nWARC/1.1\r\n\r\n" * 9), (5, "a" * 25), (7, "x" * 10), (6, "x" * 10)]
    df = spark.createDataFrame([(i, h, "u" if i % 2 else None, 0) for i, h in rows], "page_id long, html string, url string, total int")
    for chunk, least in ((7, 0), (1 << 20, 11)):
        chunks = warc.record_chunks(df, "page_id", "url", "html", chunk_bytes=chunk, least_bytes=least)
        manifest = warc.write_warc(chunks, f"file://{tmp_path}/{chunk}", roll_bytes=200)
        back = warc.read_warc(manifest, chunk_bytes=chunk).collect()
        got = {int(r.row_id): r for r in warc.record_table(warc.read_warc(manifest, chunk, False)).collect()}
        check_warc(rows, got, least)
        for i, html in rows:
            if got[i].record_type == "response":
                parts = sorted((r.chunk_no, bytes(r.data)) for r in back if int(r.row_id) == i)
                assert b"".join(p for _, p in parts) == (html or "").encode() and all(len(p) <= chunk for _, p in parts)
    empty = warc.write_warc(warc.record_chunks(df.limit(0), "page_id", "url", "html"), f"file://{tmp_path}/none")
    assert empty.count() == 0 and warc.read_warc(empty).count() == 0


def test_warc_keeps_rows_whose_ids_repeat(spark, tmp_path):
    rows = [(1, "a" * 30), (1, "a" * 30), (2, "bbb"), (2, "ccc"), (None, "ddd"), (None, "ddd"), (3, "ccc"), (None, "bbb")]
    df = spark.createDataFrame([(i, h, "u") for i, h in rows], "page_id long, html string, url string")
    manifest = warc.write_warc(warc.record_chunks(df, "page_id", "url", "html", chunk_bytes=8), f"file://{tmp_path}/again")
    got = sorted((r.row_id or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "", r.n_chunks) for r in warc.record_table(warc.read_warc(manifest, 8, False)).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "a" * 30, None), (1, "a" * 30, None), (2, "bbb", None), (2, "ccc", None), (None, "ddd", None), (None, "ddd", None), (3, "ccc", 2), (None, "bbb", 2)]
    want = [("" if i is None else str(i), len(t), digest(t), "revisit" if r else "response", str(r or ""), max(1, -(-len(t) // 8)) if not r else 1) for i, t, r in want]
    assert got == sorted(want)


def test_warc_query(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in table(spark, sf_dir, "pages").collect()]
    got = {r.page_id: r.asDict() | {"refers_to": None if r.refers_to is None else str(r.refers_to)} for r in queries.op1_warc(spark, sf_dir).collect()}
    check_warc(rows, {k: type("R", (), v) for k, v in got.items()})


def test_broken_archives_fail(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 100, "u")], "page_id long, html string, url string")
    manifest = warc.write_warc(warc.record_chunks(df, "page_id", "url", "html"), f"file://{tmp_path}/w")
    path = manifest.first().path.removeprefix("file://")
    data = zlib.decompress(open(path, "rb").read(), 31)
    open(path, "wb").write(zlib.compress(data.replace(b"aaaa", b"aaab", 1), wbits=31))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(manifest).collect()


# 2


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, "big" if i % 3 else r.choice(["a", "b", None]), r.randint(0, 9), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, mix_block string")
    mix = mixing.Mix(budget=1.5, entropy=0.6, repeats=6.0, blocks=8)
    got = mixing.mixed(df, mix).collect()
    totals = Counter()
    for _, s, n, _ in rows:
        totals[s] += n
    shares = np.array(list(totals.values())) / sum(totals.values())

    def entropy(a):
        w = shares**a / (shares**a).sum()
        return -(w * np.log(w)).sum()

    low, high = 0.0, 1.0
    target = entropy(1.0) + 0.6 * (entropy(0.0) - entropy(1.0))
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= target else (low, mid)
    power = mixing.tempered(mixing.source_totals(df, "source", "n_tokens"), mix)
    assert abs(power - low) < 1e-4
    z = sum(t**power for t in totals.values())
    taken, most, counts = Counter(), Counter(), Counter((x.source, x.doc_id) for x in got)
    for x in got:
        taken[x.source] += x.n_tokens
        most[x.source] = max(most[x.source], x.n_tokens)
    for s, t in totals.items():
        part = t**power / z * 1.5 * sum(totals.values())
        assert part <= taken[s] < part + 9 + 1e-6
        passes = [counts[s, i] for i, source, n, _ in rows if source == s and n]
        assert max(passes) - min(passes) <= 1 and max(passes) <= math.ceil(part / t)
    assert mixing.mixed(df.limit(0), mix).count() == 0
    only = mixing.mixed(spark.createDataFrame([(1, "a", 0), (2, "a", None)], "doc_id long, source string, n_tokens long"), mix)
    assert {x.doc_id for x in only.collect()} == {1, 2}
    with pytest.raises(ValueError, match="repeats"):
        mixing.tempered(mixing.source_totals(df, "source", "n_tokens"), mixing.Mix(budget=8.0))


def test_mixing_of_rows_with_null_ids_and_clashing_names(spark):
    rows = [(None, "s", 1, f"text {i}", i) for i in range(300)] + [(7, "s", 1, "again", 0)] * 3 + [(8, None, 5, "null source", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, text string, _block int").withColumn("key", F.lit("k")).withColumn("end", F.lit(1)).withColumn("b_source", F.lit("b"))
    for cut in (100_000, 0):
        got = mixing.mixed(df, mixing.Mix(budget=0.5, blocks=4, broadcast=cut)).collect()
        taken = Counter(x.source for x in got)
        assert {x.text for x in got if x.source == "s"} and 100 < taken["s"] < 200 and got[0].key == "k" and got[0].b_source == "b"
        assert sum(x.text == "again" for x in got) in (0, 3)


def test_mixing_keeps_to_the_repeat_limit(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1000)], "doc_id long, source string, n_tokens long")
    power = mixing.tempered(mixing.source_totals(df, "source", "n_tokens"), mixing.Mix(budget=1.0, entropy=1.0, repeats=10.0))
    share = 1 / (1 + 1000**power)
    assert 9.99 <= share * 1001 <= 10.0001


# 3


def test_media_round_trip(spark, tmp_path):
    texts = ["", None, "a", "é" * 64, "b" * 63, "b" * 64, "a", "x" * 100_000]
    rows = media.store_payloads(docs(spark, texts, True), f"file://{tmp_path}/m", "doc_id", "text")
    places = store.written(media.members(rows), "places")
    got = {r.doc_id: r for r in rows.select("doc_id", "media_sha256").join(media.headers(places).join(media.features(places), "media_sha256"), "media_sha256").collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded)) and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.width * r.height == len(padded)
        assert media.decode_png(media.encode_png(data)) == padded and r.media_bytes == len(media.encode_png(data))
    assert got[2].feature == got[6].feature and places.count() == 6
    assert media.store_payloads(docs(spark, ["a"]).limit(0), f"file://{tmp_path}/n", "doc_id", "text").count() == 0


def test_media_members_open_as_tar(spark, tmp_path):
    import tarfile

    rows = media.store_payloads(docs(spark, ["a", "b"]).coalesce(1), f"file://{tmp_path}/t", "doc_id", "text").collect()
    with tarfile.open(rows[0].shard.removeprefix("file://")) as tar:
        for m in tar.getmembers():
            assert hashlib.sha256(tar.extractfile(m).read()).hexdigest() + ".png" == m.name


# 4


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
CC = "The text is available under a Creative Commons\nAttribution-NonCommercial 4.0 International License."
NOTICES = [None, "", "words.\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "licensed under the gnu general public license, version 3", "My driver license came back. Copyright fees rose for the court.", "Licensed under CC BY-NC 4.0.\nAll rights reserved."]
NOTICES += [MIT, APACHE, BSD, CC, "Text is available under CC-BY-SA 4.0.", "Released under AGPL-3.0.", "Available under Apache 2.0.", "The public release of the software was a general success for the version.", "x" * 100_000, "word " * 20_000]


def test_licenses(spark):
    got, rows = {}, docs(spark, NOTICES, True)
    found = licenses.license_paragraphs(rows.union(rows.filter("doc_id = 2"))).collect()
    for r in found:
        if r.family != licenses.UNKNOWN:
            got.setdefault(r.doc_id, []).append(r.family)
    want = {2: {"MIT"}, 3: {"Apache-2.0"}, 4: {"GPL"}, 6: {"CC-BY-NC", "Proprietary"}, 7: {"MIT"}, 8: {"Apache-2.0"}, 9: {"BSD"}, 10: {"CC-BY-NC"}, 11: {"CC-BY-SA"}, 12: {"AGPL"}, 13: {"Apache-2.0"}}
    assert {k: set(v) for k, v in got.items()} == want
    assert len(got[7]) == 3 and len(got[2]) == 2  # all three paragraphs; the repeated row again
    assert licenses.license_paragraphs(docs(spark, ["a"]).limit(0)).count() == 0


def test_license_query_by_brute_force(spark, tmp_path):
    """Documents of notices with words changed, of near misses and of other words, with ids that repeat or are null:
    families are those of the notices that were put in, for each row by its own text."""
    r = random.Random(44)
    word = lambda: "".join(r.choice("klmnopq") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    misses = ["The rights of all were reserved.", "He is free of charge and in copies.", "The license of the driver was granted without warranty.", "The software was released in the public library."]
    rows, want = [], []
    for i in range(120):
        paragraphs, families = [], []
        for _ in range(r.randint(0, 4)):
            if r.random() < 0.5:
                family = r.choice(sorted(licenses.TEMPLATES))
                paragraphs.append(r.choice([str, str.upper, lambda t: t.replace(" ", "  ")])(r.choice(licenses.TEMPLATES[family])))
                families.append(family)
            else:
                paragraphs.append(r.choice([prose(12), r.choice(misses), ""]))
        rows.append((i % 100 if i % 7 else None, "\n\n".join(paragraphs)))
        want.append((",".join(sorted(set(families))), len(families)))
    same = {}
    for (i, text), (families, n) in zip(rows, want, strict=True):
        same.setdefault((i, text), (i, families, n))
    extra = [rows[3], rows[3], (1, None), (1, ""), (None, None)]
    got = [same[rows[3]]] * 2 + [(1, "", 0), (1, "", 0), (None, "", 0)] + [same[x] for x in rows]
    spark.createDataFrame([(*x, "a", 2) for x in rows + extra], DOCS + ", family string, mark int").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_license_scan(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, got))


def test_paragraphs_without_needed_words_resemble_nothing():
    templates, least = [licenses.WORD.findall(t.lower()) for ts in licenses.TEMPLATES.values() for t in ts], licenses.Scan().resembles
    need, r = licenses.needed_words(templates, least), random.Random(4)
    telling = [licenses._telling(t) for t in templates]
    pattern, near = re.compile(licenses.needed_pattern(least)), 0
    for _ in range(20_000):
        base = r.choice(templates)
        at = r.randrange(len(base))
        words = base[at : at + r.randint(1, 12)] + [r.choice(r.choice(templates)) for _ in range(r.randint(0, 4))]
        if r.random() < 0.5:
            words = [w for w in words if w not in need]
        pairs = licenses._telling(words)
        like = max(len(t & pairs) / max(min(len(t), len(pairs)), -(-len(t) // 2), 1) for t in telling)
        near += like >= least
        assert pattern.search("-".join(words)) or like < least
        assert not set(words) & set(need) or pattern.search(" ".join(words))
    assert near > 1000 and all(pattern.search(t) for ts in licenses.TEMPLATES.values() for t in ts)


def test_license_probabilities_by_hand(spark):
    """The JVM's margins, temperature and similarity against the model's coefficients and plain sets."""
    rows = spark.createDataFrame([(i, licenses.WORD.findall(t.lower())) for i, t in enumerate(NOTICES) if t and len(t) < 2000], "i int, words array<string>")
    some = spark.createDataFrame([(licenses.WORD.findall(t.lower()),) for t in licenses.OTHERS * 2], "words array<string>")
    model, hasher, names, temperature = licenses.train(spark, some)
    made = hasher.transform(rows.withColumn("grams", licenses._grams(F.col("words"))))
    got = model.transform(made).select("i", "features", licenses._softmax(licenses.vector_to_array("rawPrediction"), temperature).alias("p"), licenses._pairs(F.col("words")).alias("pairs")).collect()
    weights, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    for r in got:
        margins = (weights[:, r.features.indices].sum(axis=1) + start) / temperature
        p = np.exp(margins - margins.max())
        assert np.allclose(r.p, p / p.sum()) and names[0] == licenses.UNKNOWN
        assert {tuple(x.split(" ")) for x in r.pairs} == licenses._telling(licenses.WORD.findall(NOTICES[r.i].lower()))


# 5


def far(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        below = [i]
        for j, y in enumerate(b, 1):
            below.append(min(row[j] + 1, below[-1] + 1, row[j - 1] + (x != y)))
        row = below
    return row[-1]


def test_nearest_is_levenshtein():
    r = random.Random(4)
    terms = ["abcde", "abcd", "bcdeabcde", "eeeee", "aabbccdde"]
    trie = toxicity.Trie(terms)
    for _ in range(2000):
        word = "".join(r.choice("abcde") for _ in range(r.randint(2, 11)))
        want = min(((far(word, t), t) for t in terms if far(word, t) <= toxicity.allowed(t)), default=None)
        if want:
            assert trie.may_match(word)
        assert (trie.nearest(word) if trie.may_match(word) else None) == want


def toxic_rows(n=300):
    r = random.Random(6)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 8))) for _ in range(30)]
        if i % 4 == 0:
            words[r.randrange(30)] = r.choice(["blorfing", "grundwad", "snivelok"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity(spark):
    df = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    model = toxicity.learn(df, "text", "toxic")
    assert set(model.terms) == {"blorfing", "grundwad", "snivelok"}
    tests = ["you are a blorfing", "you are a blorfimg one", "plain text here", "", None, "BLORFING!!", "x " * 50_000 + "grundwad"]
    got = docs(spark, tests, True).withColumn("s", toxicity.score(F.col("text"), model)).orderBy("doc_id").collect()
    assert [r.s >= 0.5 for r in got] == [True, True, False, False, False, True, True]
    assert got[1].s > got[2].s == got[3].s == got[4].s and all(0 <= r.s <= 1 for r in got)
    model.variants["blorfimg"] = 0.6 * model.terms["blorfing"]
    quoted, abused = (toxicity.hits(t, toxicity.Matcher(model))[0] for t in ('he said "blorfing" once', "you blorfing!"))
    assert quoted[4] == 1.0 > abused[4] and abused[5] > quoted[5]
    none = toxicity.learn(df.limit(0), "text", "toxic")
    assert docs(spark, tests).select(toxicity.score(F.col("text"), none).alias("s")).agg(F.max("s")).first()[0] < 0.5
    assert docs(spark, tests).limit(0).select(toxicity.score(F.col("text"), model)).count() == 0


def plain_score(text, model):
    """The score without tries: every word against every term, stem and covered word."""
    text = (text or "").lower()
    tokens = [(m.start(), m.end(), m.group()) for m in toxicity.WORD.finditer(text)]

    def found(w):
        if w in model.terms:
            return model.terms[w], False
        for n in sorted({len(s) for s in model.stems}):
            if len(w) >= n and w[:n] in model.stems:
                return model.stems[w[:n]], False
        near = [(far(w, t), t, x) for t, x in {**model.covered, **model.terms}.items() if far(w, t) <= toxicity.allowed(t)]
        near += [(d, t, x) for t, x in model.stems.items() if (d := min(far(w[:k], t) for k in range(len(w) + 1))) <= toxicity.allowed(t)]
        if not near:
            return None
        return model.variants.get(w, 0.6 * min(near)[2]), True

    hit = [(i, *f) for i, (_, _, w) in enumerate(tokens) if (f := found(w)) and f[0] > 0]
    force, exact, quoted = [], 0.0, 0.0
    for i, weight, misspelled in hit:
        low, high = max(0, i - model.window), min(len(tokens) - 1, i + model.window)
        before, after = text[tokens[low][0] : tokens[i][0]], text[tokens[i][1] : tokens[high][1] + 1]
        near = [tokens[j][2] for j in range(low, high + 1)]
        marks = sum(c in toxicity.QUOTES for c in before) % 2 == 1 and any(c in toxicity.QUOTES for c in after)
        q = min(1.0, 0.6 * marks + 0.4 * any(w in toxicity.REPORTING for w in near))
        a = min(1.0, 0.5 * any(w in toxicity.ADDRESS for w in near) + 0.2 * ("!" in after) + 0.3 * any(j != i and low <= j <= high for j, _, _ in hit))
        force.append(weight * (1 - 0.5 * q) * (1 + 0.25 * a))
        exact += 0 if misspelled else force[-1]
        quoted += weight * q
    x = [0.0] * 6
    if hit:
        x = [min(exact, 30) / 10, min(sum(force) - exact, 30) / 10, min(max(force), 15) / 10, min(quoted, 30) / 10, math.log1p(len(hit)), min(1, 20 * len(hit) / max(len(tokens), 1))]
    return 1 / (1 + math.exp(-max(-30, min(30, model.coefficients[0] + sum(c * v for c, v in zip(model.coefficients[1:], x, strict=True))))))


def test_score_by_brute_force(spark):
    r = random.Random(55)
    model = toxicity.Model({"blorfing": 6.0, "grunt": 5.0, "zob": 4.0}, {"snive": 5.5}, {"sniveling": 5.0, "snivelok": 4.5}, {"blorfin": 2.0}, [-3.0, 2.0, 1.5, 1.0, -0.5, 0.5, 0.2])
    pool = ["blorfing", "grunt", "zob", "snive", "sniveling", "plain", "words", "you", "said", '"', "!", "the", "your", "«", "»", "blorfin"]

    def word():
        w = list(r.choice(pool))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            at = r.randrange(len(w) + 1)
            w[at : at + r.choice([0, 1])] = r.choice(["", "x", "e", "!"])
        return "".join(w)

    texts = [None, "", "zob", "zobs", "ZOB!", "x" * 3000 + " grunt"] + [" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(300)]
    got = docs(spark, texts, True).select("doc_id", toxicity.score(F.col("text"), model).alias("s")).orderBy("doc_id").collect()
    assert [x.s for x in got] == pytest.approx([plain_score(t, model) for t in texts])


def test_misspelled_inflections_of_stems(spark):
    r, rows = random.Random(8), []
    for i in range(600):
        words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 8))) for _ in range(30)]
        if i % 3 == 0:
            words[r.randrange(30)] = "grabwusk" + r.choice(["ing", "ed", "er", "s", "able", "ish", "ers", "ful"])
        rows.append((" ".join(words), int(i % 3 == 0)))
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"), "text", "toxic")
    assert model.stems and not model.terms
    matcher = toxicity.Matcher(model)
    for word in ("grrabwusking", "gabwusked", "grabwvskful", "grabwuskling"):
        assert (got := matcher(word)) is not None and got[0] > 0, word
    assert matcher("garbanzos") is None and matcher("tesserae") is None
    texts = ["so they are grabwusking us", "so they are grrabwusking us", "so they are walking to us"]
    scored = [x.s for x in docs(spark, texts).select(toxicity.score(F.col("text"), model).alias("s")).collect()]
    assert scored[0] > 0.5 and scored[1] > scored[2] + 0.1


def test_labels_of_held_out_rows_are_not_used(spark):
    d = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    labels = d.select("doc_id", "toxic").union(spark.createDataFrame([(5, 1), (None, 1), (6, None)], "doc_id long, toxic int"))
    sample = toxicity.labelled_sample(d.select("doc_id", "text"), labels, "doc_id", "toxic", "text")
    assert sample.count() == 299  # a row with two labels has none


# 6


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)))


def contaminated(texts, items):
    out = []
    for t in texts:
        w, hit, found = words_of(t), set(), set()
        for i, x in items:
            x = words_of(x)
            m = min(13, len(x))
            for s in range(len(x) - m + 1) if m else ():
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == x[s : s + m]:
                        hit.update(range(p, p + m))
                        found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark):
    r = random.Random(7)
    vocabulary = ["a", "b", "c"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([0, 1, 3, 5, 8, 12, 13, 14, 30, 40])] + [(20, None), (21, "Übung e é"), (10, "z y")]
    texts = [None, "", "z", "Z-y!", "ÜBUNG e É Übung E é", "Übung E é"] + [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(30)] + [f"n{i} " * 30 + items[8][1] + f" m{i}" * 90 for i in range(5)] + [items[9][1]] * 2
    b = spark.createDataFrame(items, "item_id int, text string")
    for chosen in (items, [x for x in items if len(words_of(x[1])) >= 13], []):
        got = decontaminate.contamination(docs(spark, texts, True), b.filter(F.col("item_id").isin([x[0] for x in chosen])) if chosen else b.limit(0)).orderBy("doc_id").collect()
        assert [tuple(x)[1:6] for x in got] == contaminated(texts, chosen)
    assert decontaminate.contamination(docs(spark, ["a"]).limit(0), b).count() == 0
    twice = spark.createDataFrame([(1, items[8][1]), (1, "plain"), (1, items[8][1])], DOCS)
    long = b.filter("item_id = 8")
    assert sorted(x.n_hit for x in decontaminate.contamination(twice, long, rule=decontaminate.Winnow(broadcast=0)).collect()) == [0, 30, 30]


# 7


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://COM/en/x", "http://a.com?en/", "HTTP://x.Example.com/en/77?q#f", "http://notcom/en/", "s://.net/de/", "http://u@example.net/de/8#x", "http://example.net:80/de/8"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, host string")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("com", "/en/", "allow")], "host string, path string, verdict string")
    for size in (100, 0):
        got = urlfilter.judge_urls(df, rules, broadcast_rules=size).orderBy("page_id").collect()
        assert [r.verdict for r in got] == ["allow", "allow", "allow", "block", "allow", "allow", "allow", "block", "block", "allow"]
        assert got[5].rule == "example.com/en/7" and got[3].host == "com" and got[4].path == ""
    assert {r.verdict for r in urlfilter.judge_urls(df, rules.limit(0)).collect()} == {"allow"}
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0


# 8

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(zip(pii.KINDS, PLAIN, strict=False)):
        for m in re.finditer(pattern, text or "", re.A):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if (k == 0, k == 1 and all(int(p) <= 255 for p in v.split(".")), k == 2 and 14 <= len(digits) <= 19 and luhn, k == 3 and 10 <= len(digits) <= 15)[k]:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def test_base_spans(spark):
    r = random.Random(8)
    alphabet = "aZ0123456789" * 2 + "@@..--++() _%é\n"
    texts = [None, "", "a@b.c.d@e.f x@a.b_c@d.e", "+1 (555) 123-4567", "1.2.3.4.5.6.7.8 256.1.1.1 0000001.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "1 " * 3000, "a." * 3000 + "@" + "b." * 3000 + "c", "5500005555555559 " * 40]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(400)]
    texts += ["".join(r.choice("0123456789 -") for _ in range(r.randint(10, 60))) for _ in range(200)]
    d = docs(spark, texts, True)
    spans = store.written(pii.personal_data(d), "test-spans")
    got = {r.doc_id: r for r in pii.digests(d, spans).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[3] == k for x in want) for k in pii.KINDS[:4]], t
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in want).encode()).hexdigest()
    plain = {r.doc_id: r.text for r in pii.redacted(d, spans).collect()}
    assert plain[0] is None and plain[1] == "" and plain[3] == "[PHONE]" and plain[2] == "[EMAIL]@e.f [EMAIL]"
    assert pii.personal_data(docs(spark, ["a"]).limit(0)).count() == 0


def test_repeated_rows_share_spans(spark):
    text = "a@b.c and more@d.e, call +1 (555) 123-4567"
    rows = [(1, text), (1, text), (1, "other x@y.z"), (None, text), (None, None)]
    d = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or -1, r.n_email, r.n_phone, r.spans) for r in pii.digests(d, pii.personal_data(d)).collect())
    both = (2, 1, "email:0:5,email:10:18,phone:25:42")
    assert got == sorted([(-1, *both), (-1, 0, 0, ""), (1, *both), (1, *both), (1, 1, 0, "email:6:11")])
    assert sorted(r.text or "" for r in pii.redacted(d, pii.personal_data(d)).collect()) == sorted(["[EMAIL] and [EMAIL], call [PHONE]"] * 3 + ["other [EMAIL]", ""])


def test_contexts_find_other_shapes(spark):
    texts = [f"call phone: +1 555 {i:03d} 0{i % 10}99 now" for i in range(100, 140)] + ["call phone: (555) 777-1234 now", "order number (555) 777-9999 now"]
    texts += [f"mail: user{i}@site.org" for i in range(40)] + ["mail: someone@localhost", "see a@b here", "phone: other@localhost"]
    found = {(r.doc_id, r.kind, r.value) for r in pii.personal_data(docs(spark, texts)).filter("not base").collect()}
    assert found == {(40, "phone", "(555) 777-1234"), (82, "email", "someone@localhost")}


def test_found_values_open_new_contexts(spark):
    # numbers without a plus after "phone:" are found first; these also stand after "mobil", which no seed does
    texts = [f"the phone: +1 555 {i:03d} 0{i % 10}99 ok" for i in range(100, 160)]
    texts += [f"the phone: 555 777 {i:04d} ok" for i in range(10)] + [f"sein mobil 555 777 {i:04d} da" for i in range(10)] + ["sein mobil 555 888 0000 da", "ihre nummer 555 888 1111 da"]
    found = {r.value for r in pii.personal_data(docs(spark, texts)).filter("not base").collect()}
    assert found == {f"555 777 {i:04d}" for i in range(10)} | {"555 888 0000"}


def test_secrets_are_found_by_context(spark):
    r = random.Random(89)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [f'x token = "a1{key(38)}" y' for _ in range(30)] + ['x token = "a1b2c3d4" y', 'my version = "a1b2c3d5" y', "commit a1" + key(38)]
    found = {(x.doc_id, x.kind) for x in pii.personal_data(docs(spark, texts)).filter("not base").collect()}
    assert found == {(i, "secret") for i in range(31)}


def keys(r, n, size=40):
    return ["".join(r.choice("0123456789abcdef") for _ in range(size - 4)) + "a1b2" for _ in range(n)]


def test_redaction_leaves_nothing_of_long_values(spark):
    r = random.Random(1000)
    long = keys(r, 1, 1000)[0]
    texts = [f'x entry <{k}> y' for k in keys(r, 30)] + [f'x entry <{long}> y', f"x entry <{long}@{long}> y", "entry <12345 6789012345678901234567890123456789012345678901234567890>"]
    d = docs(spark, texts)
    out = [x.text for x in pii.redacted(d, pii.personal_data(d)).orderBy("doc_id").collect()]
    assert out[:31] == ["x entry <[SECRET]> y"] * 31 and not any(long[i : i + 8] in out[30] for i in range(900))
    # what stands there but has another shape isn't one of them, and isn't cut either
    assert out[31:] == texts[31:]


def test_long_words_make_contexts(spark):
    r = random.Random(60)
    word = "langes" * 400
    texts = [f"{word}: {k}" for k in keys(r, 12)] + [f"{word}: abc123x", f"x{word}: abc123y"]
    found = [(x.doc_id, x.value) for x in pii.personal_data(docs(spark, texts)).filter("not base").collect()]
    assert sorted(i for i, _ in found) == list(range(13)) and ("abc123x" in dict(found).values())


def test_runs_are_read_once(spark):
    texts = ["=" * 60000, "a=" * 30000, "(" * 60000, "1 " * 30000, "12a " * 20000, ",a1" * 20000, "@" * 60000, "a1" * 30000 + "@"]
    assert pii.personal_data(docs(spark, texts)).count() == 0


def test_pii_query_by_brute_force(spark, tmp_path):
    """Base spans as by plain patterns, added ones as planted: after "badge no" stand identifiers of any shape with
    letters and digits, of which the seeds have the shape of keys; elsewhere such strings are none."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    rows, planted = [], set()
    for i in range(300):
        parts = [word() for _ in range(r.randint(0, 20))]
        kind = r.randrange(6)
        if kind < 2:
            value = keys(r, 1)[0] if r.random() < 0.85 else f"{word()}x{r.randrange(10**6)}"
            parts += ["badge no", value, word()]
            if len(value) >= 7:
                planted.add((i, value))
        elif kind == 2:
            parts += [word(), keys(r, 1)[0]]
        elif kind == 3:
            parts += [f"{word()}@{word()}.org", "+1 555 010 9999"]
        rows.append((i, " ".join(parts), "x", 1))
    rows += [rows[5], (5, "other a@b.c", "x", 1), (None, "a@b.c", "x", 1), (None, None, "x", 1), (400, "", "x", 1)]
    spark.createDataFrame(rows, DOCS + ", kind string, mark int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    listed = lambda spans: ",".join(f"{n}:{s}:{e}" for s, _, e, n in spans)
    sha = lambda t: hashlib.sha256(listed(base_spans(t)).encode()).hexdigest()
    assert sorted((str(x.doc_id), x.base_sha256) for x in got) == sorted((str(i), sha(t)) for i, t, *_ in rows)
    texts = {i: t for i, t, *_ in rows if i not in (5, None)}
    added = {(x.doc_id, texts[x.doc_id][int(a) : int(b)]) for x in got if x.doc_id in texts for kind, a, b in (s.split(":") for s in x.spans.split(",") if s) if kind == "secret"}
    planted = {(i, v) for i, v in planted if i != 5}
    assert len(added & planted) / len(added) == 1.0 and added == planted and len(added) > 60


# 9


def test_language_model(spark):
    r = random.Random(9)
    texts = [None, "", "A b a", "a b a"] + [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 40))) for _ in range(80)]
    d = docs(spark, texts, True)
    training = (F.col("doc_id") % 7) != 2
    got = {x.doc_id: x for x in interpolation.scored(d, training, plan=interpolation.Plan(chunk_tokens=50, bucket_keys=100)).collect()}
    counts = Counter()
    tokens = {i: [*spaced(t), None] for i, t in enumerate(texts)}
    for i, t in tokens.items():
        if i % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.vocabulary) == (len(t), sum(counts[w] > 0 for w in t), n, v)
        assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) and x.score < 0
    assert got[3].score == pytest.approx(got[2].score)  # equal but for case; in and out of training
    whole = interpolation.scored(d, training).collect()
    assert {x.doc_id: x.base_score for x in whole} == pytest.approx({i: x.base_score for i, x in got.items()})
    none = interpolation.scored(d, F.lit(False)).filter("doc_id = 2").first()
    assert (none.train_tokens, none.n_known, none.score, none.base_score) == (0, 0, pytest.approx(4 * math.log10(1 / 3)), 0.0)
    assert interpolation.scored(d.limit(0), training).count() == 0


def test_interpolated_score_by_brute_force(spark):
    """Counts, held-out estimates and the mixture's formula in plain Python."""
    r = random.Random(91)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(4000)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(120)] + [None, "", texts_copy := "w1 w2 w3", texts_copy]
    d = docs(spark, texts)
    training = F.pmod(F.col("doc_id"), F.lit(7)) != 2
    plan = interpolation.Plan(chunk_tokens=60, bucket_keys=100)
    flags = {x.doc_id: x for x in d.select("doc_id", training.alias("t"), (F.pmod(F.xxhash64("text", F.lit(3)), F.lit(plan.held)) == 0).alias("h")).collect()}
    tokens = {i: [*spaced(t), None] for i, t in enumerate(texts)}
    pairs = lambda ts: list(zip([None, *ts[:-1]], ts, strict=True))

    def counted(ids):
        one, two = Counter(), Counter()
        for i in ids:
            one.update(tokens[i])
            two.update(pairs(tokens[i]))
        return one, two

    learned = [i for i in tokens if flags[i].t]
    one, two = counted(learned)
    fit_one, fit_two = counted([i for i in learned if not flags[i].h])

    def estimates(pair, one, two):
        context, word = pair
        c, n = one[context], sum(one.values())
        bucket = min(1 + int(math.log2(c)), plan.context_buckets - 1) if c else 0
        return bucket, two[pair] / c if c else 0.0, one[word] / n

    table = Counter()
    for i in learned:
        if flags[i].h:
            for pair in pairs(tokens[i]):
                b, p, q = estimates(pair, fit_one, fit_two)
                table[b, int(interpolation._level(np.array([p]))[0]), int(interpolation._level(np.array([q]))[0])] += 1
    floor = 1 / (len(one) + 1)
    weights = interpolation.mixture(np.array([[*k, n] for k, n in sorted(table.items())], float), floor, plan)
    for x in interpolation.scored(d, training, plan=plan).collect():
        want = 0.0
        for pair in pairs(tokens[x.doc_id]):
            b, p, q = estimates(pair, one, two)
            want += math.log10(weights[b] @ [p, q, floor])
        assert x.score == pytest.approx(want)


def test_repeated_and_null_ids_are_scored(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e"), (None, "a b c"), (None, None), (2, "y " * 50_000 + "z" * 100_000)]
    got = interpolation.scored(spark.createDataFrame(rows, DOCS), F.coalesce(F.col("doc_id") != 9, F.lit(True))).collect()
    assert len(got) == 6 and len({round(x.score, 9) for x in got if x.n_tokens == 4}) == 1
    assert sorted(x.n_tokens for x in got) == [1, 3, 4, 4, 4, 50_002]


def test_counts_survive_packing():
    r = np.random.default_rng(1)
    for size in (0, 1, 1000):
        keys = np.unique(r.integers(0, 1 << 56, size, dtype=np.uint64))
        assert (interpolation._unpack_keys(interpolation._pack_keys(keys)) == keys).all()


def test_mixture_prefers_what_predicts():
    p = interpolation.Plan()
    level = lambda x: int(interpolation._level(np.array([x]))[0])
    rows = np.array([[5, level(0.5), level(0.001), 100], [2, 0, level(0.1), 100]], float)
    w = interpolation.mixture(rows, 1e-6, p)
    assert w[5][0] > 0.9 and w[2][1] > 0.9 and np.allclose(w.sum(axis=1), 1)


# 10


def near(texts, percent=75):
    sets = []
    for t in texts:
        w = spaced(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    name = list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return [(len(s), root(i), root(i) == i) for i, s in enumerate(sets)]


def test_near_duplicates(spark):
    r = random.Random(10)
    texts = [None, "", "  \n", "a b", "A  b", "a b c"]
    for _ in range(12):  # groups of near copies around the threshold, some of them large
        base = ["w%d" % r.randrange(3000) for _ in range(r.choice([8, 60, 150]))]
        for _ in range(r.choice([2, 3, 90])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 6])):
                copy[r.randrange(len(copy))] = "x%d" % r.randrange(10**6)
            texts.append(" ".join(copy))
    passage = " ".join("p%d" % i for i in range(40))
    texts += [passage + " " + " ".join("q%d" % r.randrange(10**6) for _ in range(r.randint(30, 90))) for _ in range(150)]
    got = neardup.duplicate_classes(docs(spark, texts, True)).orderBy("doc_id").collect()
    assert [tuple(x)[1:4] for x in got] == near(texts)
    assert all(x.first == x.kept for x in got)
    # blocks of a few classes: clusters lie across several tasks; small leaves: nodes lie deep, and trees are repeated
    for plan in (neardup.Join(block=7), neardup.Join(leaf=16, block=5)):
        small = neardup.duplicate_classes(docs(spark, texts), join=plan).orderBy("doc_id").collect()
        assert [tuple(x)[1:4] for x in small] == near(texts)


def test_recall_by_depth():
    plan = neardup.Join()
    assert plan.missed(0) == pytest.approx(0.25**8) and plan.missed(1) < 1e-3 < plan.missed(2) and plan.reach == 1
    assert all(plan.missed(d) < plan.missed(d + 1) < 1 for d in range(12))


def test_long_words_differ():
    word = "a"
    for _ in range(12):  # the doubling word and its complement, which polynomials modulo 2 ** 64 can't tell apart
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes, _ = hashing.word_hashes(pa.array([word, other, word.upper()]))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_near_duplicates_of_odd_rows(spark):
    rows = [(7, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other words entirely here now"), (None, None), (None, "z")]
    got = sorted(map(repr, neardup.duplicate_classes(spark.createDataFrame(rows, DOCS)).collect()))
    kept = sorted((repr(x[0]), x[1], repr(x[2]), x[3]) for x in neardup.duplicate_classes(spark.createDataFrame(rows, DOCS)).collect())
    assert len(got) == 7 and ("3", 2, "3", True) in kept and ("7", 2, "3", False) in kept and ("None", 0, "None", True) in kept and ("None", 1, "None", True) in kept
    assert neardup.duplicate_classes(docs(spark, ["a"]).limit(0)).count() == 0


# queries and pipeline


def test_queries_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        relation = c.sql(sql)
        at = [relation.columns.index(x) for x in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall()), name


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    d = table(spark, sf_dir, "documents")
    current, kept = d, {}
    for name, stage in corpus_pipeline.STAGES:
        current = store.written(stage(spark, current, sf_dir), name)
        if name != "mixing":
            assert current.columns == d.columns
        kept[name] = {r.doc_id: r.text for r in current.collect()}
    original = {r.doc_id: r.text for r in d.collect()}
    ids = sorted(kept["toxicity"])
    name = near([original[i] for i in ids])
    assert sorted(kept["near_duplicates"]) == [i for i, x in zip(ids, name, strict=True) if x[2]]
    bench = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    ids = sorted(kept["near_duplicates"])
    flags = contaminated([original[i] for i in ids], bench)
    assert sorted(kept["decontamination"]) == [i for i, x in zip(ids, flags, strict=True) if not x[4]]
    assert set(kept["personal_data"]) == set(kept["decontamination"])
    assert not any(base_spans(t) for t in kept["personal_data"].values())
    assert set(kept["mixing"]) <= set(kept["personal_data"])
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    import corpus_pipeline

    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "a b c d e f", "en", "s", 3), (3, "mail me at x@y.org +1 (555) 555-1234", "en", "s", 9), (3, "mail me at x@y.org +1 (555) 555-1234", "en", "s", 9)]
    df = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema).withColumn("node", F.lit("x"))
    for c in ("_id", "_mark", "_cuts", "_block", "_t", "key", "row", "mark", "b_source"):
        df = df.withColumn(c, F.lit("x"))
    sizes, columns = [], df.columns
    for name, stage in corpus_pipeline.STAGES:
        df = store.written(stage(spark, df, sf_dir), name)
        sizes.append(df.count())
        assert df.columns[: len(columns)] == columns
    assert sizes[0] == 5 and sizes[1:4] == [4, 4, 4]
    assert "mail me at [EMAIL] [PHONE]" in {r.text for r in df.collect()}


def test_stages_tell_rows_with_one_id_apart(spark, sf_dir):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (3, long), (3, " ".join(f"v{i}" for i in range(40))), (3, long), (None, long + " z"), (None, "quite other words than those")]
    d = spark.createDataFrame(rows, DOCS)
    left = corpus_pipeline.near_duplicates_out(spark, d, sf_dir).collect()
    assert sorted((r.doc_id or -1, r.text) for r in left) == sorted([(1, long), (3, rows[2][1]), (-1, rows[5][1])])
    item = table(spark, sf_dir, "benchmark").filter("length(text) > 100").first().text
    d = spark.createDataFrame([(5, item), (5, long), (None, item), (None, long)], DOCS)
    left = corpus_pipeline.benchmark_out(spark, d, sf_dir).collect()
    assert sorted((r.doc_id or -1, r.text) for r in left) == sorted([(5, long), (-1, long)])
