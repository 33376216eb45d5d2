"""Licence families of documents' paragraphs, in DataFrame operations only.

A logistic regression over sparse word n-grams, trained on varied licence notices against paragraphs of the corpus, gives
each paragraph a family or "unknown"; its probabilities are calibrated on notices and paragraphs that a first fit has not
seen. A prediction counts if the paragraph also resembles a template of that family. Paragraphs without any of a set of
words that is derived from the templates can't resemble one; they are unknown without being scored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .decontaminate import words_of

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

#: fixed values: notices by which licences are usually named or granted
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "Available under Apache 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "This software is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or later.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.", "Released under AGPL 3.0."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Distributed under the terms of the LGPL, the Lesser General Public License."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Distributed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "EUPL": ["Licensed under the European Union Public Licence, version 1.2.", "Licensed under the EUPL, Version 1.2 or later."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense, into the public domain."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "Text is available under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without written permission of the publisher."],
}
#: fixed values: sentences with the same words that license nothing
OTHERS = [
    "He renewed his driver license at the office last week.",
    "The court heard a case about copyright and public policy.",
    "No permission was needed to enter the building.",
    "The city reserved all rooms for the conference.",
    "A new version of the software was released in May.",
    "The foundation published a general report on free education.",
    "The version is available in the public library.",
]
#: fixed values: a pair of two of these tells nothing and isn't a pair of a template
STOP = frozenset("a an and any are as be but for in is it not of on or that the this to with".split())
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Scan:
    """variants: of each notice, with words left out; sample: other paragraphs of the corpus that the model sees, at most,
    those of the least hashes; least: calibrated probability, and resembles: similarity to a template (see _similarity)
    that confirm a family."""

    variants: int = 24
    sample: int = 1_000
    least: float = 0.5
    resembles: float = 0.6


def paragraphs_of(text: Column) -> Column:
    """The paragraphs of a text: it is cut at blank lines and at line breaks, but for those where a line ends in a word
    or comma and so goes on in the next."""
    return F.split(text, r"\r?\n[ \t]*\r?\n|(?<![\p{L}\p{N},\- \t\r])[ \t]*\r?\n")


def _telling(words: list[str]) -> set[tuple[str, str]]:
    return {(a, b) for a, b in zip(words, words[1:], strict=False) if not (a in STOP and b in STOP)}


def shared_pairs(size: int, resembles: float) -> int:
    """The pairs that a paragraph shares at least with a template of so many which it resembles."""
    return max(1, math.ceil(resembles * -(-size // 2) - 1e-9))


def needed_words(templates: list[list[str]], resembles: float) -> list[str]:
    """Words of which every paragraph that resembles a template has at least one: it shares some pairs with the template,
    and these words leave fewer of the template's pairs without one. Chosen greedily, long words first."""
    worth = lambda w: 0.0 if w in STOP else max(min(len(w), 8) - 2.9, 0.05)
    open_pairs, chosen = [(p, shared_pairs(len(p), resembles)) for p in map(_telling, templates)], []
    while any(len(p) >= k for p, k in open_pairs):
        gain = Counter(w for p, k in open_pairs if len(p) >= k for pair in p for w in set(pair))
        best = max(gain, key=lambda w: (gain[w] * worth(w), w))
        chosen.append(best)
        open_pairs = [({pair for pair in p if best not in pair}, k) for p, k in open_pairs]
    return sorted(chosen)


def _branches(words: list[str]) -> str:
    """A pattern of the sorted words, by common beginnings."""
    out = []
    for first, group in itertools.groupby(words, key=lambda w: w[:1]):
        rest = [w[1:] for w in group]
        out.append(re.escape(first) + (_branches(rest) if any(rest) else ""))
    return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"


def needed_pattern(resembles: float) -> str:
    """Matches what has one of the needed words, and perhaps more."""
    return "(?i)(?<![A-Za-z0-9])" + _branches(needed_words([WORD.findall(t.lower()) for texts in TEMPLATES.values() for t in texts], resembles)) + "(?![A-Za-z0-9])"


def _grams(words: Column) -> Column:
    """Words and pairs of neighbours, distinct."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def _notices(spark: SparkSession, scan: Scan) -> DataFrame:
    """(family, words, variant, notice) of all notices, each also with every tenth to fifth word left out, but for words
    that only one family has; notice is its number in its family."""
    rows = [(f, t, i) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)] + [(UNKNOWN, t, i) for i, t in enumerate(OTHERS)]
    notices = spark.createDataFrame(rows, "family string, text string, notice int").select("family", "notice", words_of(F.col("text")).alias("all"))
    notices = notices.select("family", "notice", "all", F.explode(F.sequence(F.lit(0), F.lit(scan.variants))).alias("variant"))
    families = [{w for t in texts for w in WORD.findall(t.lower())} for texts in TEMPLATES.values()]
    shared = F.array(*[F.lit(w) for w, n in sorted(Counter(w for f in families for w in f).items()) if n > 1])
    kept = F.filter("all", lambda w, i: (F.col("variant") == 0) | ~F.array_contains(shared, w) | (F.pmod(F.xxhash64(w, i, F.col("variant")), F.lit(100)) >= 10 + F.col("variant") % 11))
    return notices.select("family", kept.alias("words"), "variant", "notice")


def _pairs(words: Column) -> Column:
    """The distinct pairs of neighbours, but for those of two stop words."""
    stop = F.array(*map(F.lit, sorted(STOP)))
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.when(~(F.array_contains(stop, a) & F.array_contains(stop, b)), F.concat_ws(" ", a, b)))
    return F.when(F.size(words) > 1, F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))).otherwise(F.array().cast("array<string>"))


def _similarity(template: Column, pairs: Column) -> Column:
    """The share of common pairs, in the template's or, if the paragraph has fewer, in its own, but at least in half the
    template's. Both are distinct pairs."""
    return F.size(F.array_intersect(template, pairs)) / F.greatest(F.least(F.size(template), F.size(pairs)), F.ceil(F.size(template) / 2), F.lit(1))


def train(spark: SparkSession, paragraphs: DataFrame, scan: Scan = Scan()):
    """(model, vectors, names, temperature). paragraphs (words) are others of the corpus, at most scan.sample. A first
    fit leaves out the last notice of each family and a quarter of the others; on what it leaves out the temperature
    that divides the margins is chosen by log-likelihood. The model is then fitted on all."""
    others = paragraphs.select(F.lit(UNKNOWN).alias("family"), "words", F.lit(0).alias("variant"), F.pmod(F.xxhash64("words"), F.lit(4)).cast("int").alias("notice"), F.lit(True).alias("sampled"))
    names = [UNKNOWN, *sorted(TEMPLATES)]
    label = F.array_position(F.array(*map(F.lit, names)), F.col("family")).cast("double") - 1
    last = F.array_position(F.array(*[F.lit(f"{f} {len(t) - 1}") for f, t in TEMPLATES.items() if len(t) > 1], F.lit(f"{UNKNOWN} 3")), F.concat_ws(" ", "family", "notice")) > 0
    # the table is small and bounded, so it is sorted: the same rows give the same model
    rows = _notices(spark, scan).withColumn("sampled", F.lit(False)).union(others).filter(F.size("words") > 0).select(label.alias("label"), "variant", "sampled", last.alias("held"), _grams(F.col("words")).alias("grams"))
    rows = store.written(rows.coalesce(1).sortWithinPartitions("label", "variant", F.xxhash64("grams")), "notices")
    # all n-grams that two notices have: the notices are fixed, so their number doesn't follow the corpus
    vectors = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=(1 << 31) - 1, minDF=2, binary=True).fit(rows.filter("not sampled"))
    rows = store.written(vectors.transform(rows), "notice-vectors")
    fit = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, tol=1e-4, aggregationDepth=2)
    grid = [0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 3.0]
    margins = fit.fit(rows.filter("not held")).transform(rows.filter("held")).select("label", vector_to_array("rawPrediction").alias("m"))
    losses = margins.select(*[F.avg(-F.log(F.greatest(F.get(_softmax(F.col("m"), t), F.col("label").cast("int")), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    best = min(range(len(grid)), key=lambda i: (round(losses[i], 6), grid[i])) if losses and losses[0] is not None else grid.index(1.0)
    return fit.fit(rows), vectors, names, grid[best]


def _softmax(margins: Column, temperature: float) -> Column:
    powers = F.transform(margins, lambda m: F.exp((m - F.array_max(margins)) / temperature))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


def license_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: Scan = Scan()) -> DataFrame:
    """One row for each paragraph of docs that has a word of needed_words: id_col, mark (xxhash64 of the text, so that rows
    that share an id but not a text stay apart), paragraph (from 0), family, confidence (the calibrated probability) and similarity (the best template's). family is "unknown" where that is
    likeliest, where confidence is under scan.least or where no template of the family resembles the paragraph; all
    paragraphs without a row are unknown, as none of them can resemble a template.

    Null and empty texts have no paragraphs. Repeated rows give their rows again. Of families that are equally likely
    the first by name counts, unknown before all. A line without an end is one paragraph, however long. Only the two
    named columns are read; whole texts are.
    """
    spark = docs.sparkSession
    need = needed_pattern(scan.resembles)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    lines = texts.filter(F.col("text").rlike(need)).select("id", "mark", F.posexplode(paragraphs_of(F.col("text"))).alias("paragraph", "line"))
    lines = store.written(lines.filter(F.col("line").rlike(need)).select("id", "mark", "paragraph", words_of(F.col("line")).alias("words")).filter(F.size("words") > 0), "paragraphs")

    templates = _notices(spark, scan).filter((F.col("variant") == 0) & (F.col("family") != UNKNOWN)).select("family", _pairs(F.col("words")).alias("template"))
    listed = templates.groupBy("family").agg(F.collect_list("template").alias("templates"))  # a fixed number of families
    every = templates.agg(F.collect_list("template").alias("templates"))
    # paragraphs that no template confirms, however near, the first by hash; more than are needed are looked at
    alike = lambda pairs: F.array_max(F.transform("templates", lambda t: _similarity(t, pairs)))
    hashed = lines.withColumn("h", F.xxhash64("words"))
    drawn = hashed.select("h").distinct().orderBy("h").limit(2 * scan.sample)
    some = store.written(hashed.join(F.broadcast(drawn), "h").dropDuplicates(["h"]).select("h", "words", _pairs(F.col("words")).alias("pairs")), "other-paragraphs").crossJoin(F.broadcast(every))
    others = some.filter(alike(F.col("pairs")) < scan.resembles).orderBy("h").limit(scan.sample).select("words")
    model, vectors, names, temperature = train(spark, others, scan)

    # a probability for each name; the model's own Column form keeps it in the JVM
    judged = model.transform(vectors.transform(lines.withColumn("grams", _grams(F.col("words"))))).withColumn("p", _softmax(vector_to_array("rawPrediction"), temperature))
    judged = judged.withColumn("confidence", F.array_max("p")).withColumn("guess", F.element_at(F.array(*map(F.lit, names)), F.array_position("p", F.col("confidence")).cast("int")))
    judged = judged.withColumn("pairs", _pairs(F.col("words"))).join(F.broadcast(listed.withColumnRenamed("family", "guess")), "guess", "left").withColumn("similarity", F.coalesce(alike(F.col("pairs")), F.lit(0.0)))
    sure = (F.col("guess") != UNKNOWN) & (F.col("confidence") >= scan.least) & (F.col("similarity") >= scan.resembles)
    return judged.select(F.col("id").alias(id_col), "mark", "paragraph", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), F.round("confidence", 3).alias("confidence"), F.round("similarity", 3).alias("similarity"))
