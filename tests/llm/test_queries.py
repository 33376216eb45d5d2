"""Registered queries over whole small tables, against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, queries

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    """Documents with nulls, empty and repeated texts and ids, and a source that holds half of them."""
    r = random.Random(1)
    words = ["A", "b", "été", "x-1", "Y", "the", "of"]
    texts = [None, "", " \n", "one", "one"] + [" ".join(r.choice(words) for _ in range(r.choice([1, 5, 40, 300]))) for _ in range(120)]
    rows = [(i, t, "en", r.choice(["s0", "s0", "s0", "s1", "s2", None]), 0) for i, t in enumerate(texts)]
    rows += [(7, "seven again", "en", "s0", 0), (None, "nobody", "en", "s1", 0), rows[9], rows[9]]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_rows_of_the_mix(spark, odd_documents):
    """Source by source and epoch by epoch, in the order of the permutation, rows are taken until the part is met."""
    path, rows = odd_documents
    mix = mixing.Mix()
    slim = spark.createDataFrame([(i, s, len(WORD.findall((t or "").encode()))) for i, t, _, s, _ in rows], "doc_id long, source string, n_tokens long")
    totals = mixing.source_totals(slim, "source", "n_tokens")
    power = mixing.tempered(totals, mix)
    tokens = {x.source: x.tokens for x in totals.collect()}
    z, everything = sum(t**power for t in tokens.values() if t), sum(tokens.values())
    seed = F.lit(mix.seed)
    hashed = slim.withColumn("key", F.xxhash64(seed, "doc_id", "source", "n_tokens")).withColumn("block", F.pmod("key", F.lit(mix.blocks)).cast("int"))
    hashed = hashed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumns({"of_block": F.xxhash64(seed, "source", "epoch", "block"), "place": F.shiftrightunsigned(F.xxhash64(seed, "epoch", "key"), 1)})
    lines = defaultdict(list)
    for x in hashed.collect():
        lines[x.source, x.epoch].append((x.of_block, x.block, x.place, x.doc_id, x.n_tokens))
    want = Counter()
    for source, size in tokens.items():
        part, taken = (size**power / z if size else 0.0) * mix.budget * everything, 0
        for epoch in range(max(1, math.ceil(round(part / max(size, 1), 9)))):
            line, k = sorted(lines[source, epoch], key=lambda x: x[:3]), 0
            while k < len(line):
                # rows that are equal in all columns have one place and are taken together
                same = [x for x in line[k:] if x[:3] == line[k][:3]]
                if taken < part or not same[0][4]:
                    want.update((x[3], source, x[4], epoch) for x in same)
                taken += sum(x[4] for x in same)
                k += len(same)
    got = Counter((x.doc_id, x.source, x.n_tokens, x.mix_epoch) for x in queries.op2_mixing(spark, path).collect())
    textful = lambda c: Counter({k: n for k, n in c.items() if k[2]})
    assert textful(got) == textful(want) and sum(n * k[2] for k, n in got.items()) >= everything * mix.budget


def test_stored_payloads(spark, odd_documents):
    path, rows = odd_documents
    got = queries.op3_media(spark, path).collect()
    want = []
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(map(repr, [(x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in got])) == sorted(map(repr, want))
    forms = defaultdict(set)
    for x in got:
        forms[x.payload_sha256].add((x.media_bytes, x.media_sha256, x.feature))
    assert all(len(f) == 1 for f in forms.values())


def test_base_score_of_tokens(spark, odd_documents):
    path, rows = odd_documents
    remainder = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    said = [(i, [*WORD.findall(lower(t)), None]) for i, t, *_ in rows]
    counts = Counter(w for i, words in said if remainder(i) not in (2, None) for w in words)
    n, v = sum(counts.values()), len(counts)
    want = [(i, None if i is None else remainder(i) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in said]
    got = queries.op9_lm_scoring(spark, path).collect()
    assert sorted(map(repr, [(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got])) == sorted(map(repr, want))
    assert sum(x.score for x in got) > sum(x.base_score for x in got)


def test_toxicity_query(spark, tmp_path):
    """What makes texts toxic is learned from labelled rows that aren't held out, and told of those that are."""
    r = random.Random(5)
    plain = ["lake", "tree", "walk", "bread", "window", "paper", "green", "music", "garden", "silver", "open", "table"]
    rude = ["blorgface", "snarkwit", "grubhead"]
    rows, labels = [], []
    for i in range(500):
        words = [r.choice(plain) for _ in range(r.randint(15, 40))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["you ", "such a "]) + r.choice(rude))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(600, None, "en", "s", 0), (601, "", "en", "s", 0), (None, "such a blorgface", "en", "s", 0), rows[4]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    held = [(x.predicted, int(x.doc_id % 4 == 0)) for x in got if x.held_out and x.doc_id < 500]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.95
    assert len({x.score for x in got if x.doc_id == 4}) == 1


def test_url_rules_are_the_contracts(spark, tmp_path):
    urls = ["http://a.net/de/1", "http://net/de/", "http://example.net/de/7", "http://example.net/de/8", "http://x.com/en/", "http://example.com/en/7", "http://a.org/es/", "http://a.org/de/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op7_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["allow", "allow", "allow", "block", "block", "allow", "block", "allow"]
    assert [r.rule for r in got] == ["net/de/", "net/de/", "net/de/", "example.net/de/8", "com/en/", "example.com/en/7", "org/es/", None]
