"""How filters interact: what each would remove after any others, from one pass over the documents.

A document's failures are a set of filters. Applying filters one after the other is a walk up the lattice of applied
sets, and what a step removes depends only on the set before it and on the next filter, not on the order within the set.
So documents are counted by their failures, the counts go to the lattice's edges (applied set, next filter), and every
order of the filters is a path of edges that are already summed.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: fixed values: white space between words, and characters of markup
SPACE, MARKUP = r"[\x20\x09-\x0D]+", "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Failures that a text alone decides. A: under 100 words; B: under 80 % of its words are distinct; C: over 10 % of
    its code points are capitals A-Z; D: a character of markup. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike(MARKUP),
    }


def with_repeats(docs: DataFrame, id_col: str, digest_col: str, name: str) -> DataFrame:
    """docs with a boolean column name: some row with a smaller id has the same digest. Rows that share their id are not
    repeats of each other, and a row without an id neither is one nor makes one.

    The first of each digest is found by partial aggregation, and meets its row by digest and id together, so that copies
    of one text, however many, are spread by their ids."""
    first = docs.groupBy(F.col(digest_col).alias("_digest")).agg(F.min(id_col).alias("_first")).filter("_first is not null")
    met = docs.join(first, (docs[digest_col] == first["_digest"]) & (docs[id_col] == first["_first"]), "left")
    return met.withColumn(name, F.col("_first").isNull() & F.col(id_col).isNotNull()).drop("_digest", "_first")


def failure_counts(docs: DataFrame, failures: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", labels: DataFrame | None = None, marks: tuple[str, ...] = ("quality", "toxic"), repeats: str = "E") -> DataFrame:
    """part (null as the empty string), failed (array of letters), one boolean for each of marks, and n, the number of
    rows: the documents counted by what they fail. failures names boolean columns over docs; repeats names the further
    failure of rows whose whole text some row with a smaller id has, anywhere in the table.

    Labels (id_col, and marks that are 1 where they hold) may repeat ids: a mark holds if it does in any. Documents
    without labels, or without an id, have none. Only ids, digests and bits are shuffled, not texts."""
    flags = [(name, F.coalesce(failed, F.lit(False))) for name, failed in failures.items()]
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"),
        *[failed.alias(f"fails_{name}") for name, failed in flags],
    )
    rows = with_repeats(store.written(slim, "failures"), "id", "digest", f"fails_{repeats}")
    if labels is not None:
        held = labels.groupBy(F.col(id_col).alias("label_id")).agg(*[F.bool_or(F.coalesce(F.col(m) == 1, F.lit(False))).alias(f"is_{m}") for m in marks])
        rows = rows.join(held, rows["id"] == held["label_id"], "left")
    else:
        rows = rows.withColumns({f"is_{m}": F.lit(False) for m in marks})
    names = [*failures, repeats]
    failed = F.filter(F.array(*[F.when(F.col(f"fails_{n}"), n) for n in names]), lambda x: x.isNotNull())
    known = [F.coalesce(f"is_{m}", F.lit(False)).alias(m) for m in marks]
    return rows.select("part", failed.alias("failed"), *known).groupBy("part", "failed", *marks).agg(F.count("*").alias("n"))


def lattice_edges(counts: DataFrame, letters: str, marks: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """One row for each part and edge: applied (an array of letters in their order), next, and the counts of documents
    that are kept after next, removed by it, redundant (they fail it, but were removed before), unique_fails (they fail
    nothing else), and of each mark among the removed. All rows of a part and a set of failures are one row before they go
    to the edges, so each part has 80 edges for five filters, whatever its size."""
    edges = [(tuple(c for i, c in enumerate(letters) if subset >> i & 1), c) for subset in range(1 << len(letters)) for k, c in enumerate(letters) if not subset >> k & 1]
    lattice = F.array(*[F.struct(F.array(*map(F.lit, applied)).cast("array<string>").alias("applied"), F.lit(c).alias("next")) for applied, c in edges])
    rows = counts.withColumn("edge", F.explode(lattice)).select("part", "failed", *marks, "n", "edge.applied", "edge.next")
    gone, fails = F.arrays_overlap("failed", "applied"), F.array_contains("failed", F.col("next"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rows.groupBy("part", "applied", "next").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(fails & (F.size("failed") == 1)).alias("unique_fails"),
        *[total(~gone & fails & F.col(m)).alias(f"removed_{m}") for m in marks],
    )


def orders(edges: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters as a path of edges: filter_order, step (from 1), part, the edge's counts, and shapley,
    what the step's filter removes, summed over all orders."""
    paths = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    step = F.explode(F.sequence(F.lit(1), F.lit(len(letters))))
    paths = edges.sparkSession.range(1).select(F.explode(paths).alias("filter_order")).withColumn("step", step)
    letter = lambda i: F.substring("filter_order", i, 1)
    before = F.array_sort(F.filter(F.split("filter_order", ""), lambda c: (c != "") & (F.instr(F.col("filter_order"), c) < F.col("step"))))
    paths = paths.withColumns({"applied": before, "next": F.substring("filter_order", F.col("step"), F.lit(1))})
    # a path table of 5 x 5! rows, whatever the input
    met = edges.join(F.broadcast(paths), ["applied", "next"])
    removed = met.groupBy("part", "next").agg(F.sum("removed").alias("shapley"))
    return met.join(removed, ["part", "next"]).drop("applied", "next")
