"""Temperature mixing of sources under a token budget.

Source weights are token shares to a power. The power is bisected until the mix meets a target entropy and no
source is repeated more often than allowed. Each source's rows lie in blocks of a hash permutation, one permutation
an epoch; an epoch's blocks are taken in order until the source's part of the budget is met.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: a block that is cut is looked at in 2 ** PIECES parts
PIECES = 12


@dataclass(frozen=True)
class Mix:
    """budget: tokens to take, as a multiple of the tokens there are. entropy: the target as a part of the way from the
    natural shares' entropy to that of equal shares. repeats: how many times a source may be gone through. blocks: of
    each source. broadcast: rows of the table of blocks, at most, for which it goes to every task."""

    budget: float = 1.0
    entropy: float = 0.5
    repeats: float = 4.0
    blocks: int = 256
    broadcast: int = 100_000
    seed: int = 17


def token_count(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_totals(rows: DataFrame, source_col: str, tokens_col: str) -> DataFrame:
    return rows.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens_col).cast("long").alias("tokens"), F.count("*").alias("n_rows"))


def tempered(totals: DataFrame, mix: Mix, steps: int = 3, width: int = 64) -> float:
    """The exponent in [0, 1], by interval search: each of the steps evaluates width exponents in one aggregation of
    the totals and keeps one interval, so it costs the same for any number of sources. The entropy falls and the
    largest repetition shrinks as the exponent grows; the result is the largest exponent that still has the target
    entropy, or a larger one if a source would be repeated too often (1 always meets a limit of at least budget)."""
    low, high = 0.0, 1.0
    base = totals.filter("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    whole = base.agg(F.sum("t").alias("all"), F.count("*").alias("k"), F.max("t").alias("top")).first()
    if not whole["k"]:
        return 1.0
    for step in range(steps):
        grid = [low + (high - low) * i / width for i in range(width + 1)]
        # one pass: for every exponent a, the sums that give its entropy and its largest repetition
        shares = base.select("t", (F.col("t") / float(whole["top"])).alias("s"), F.explode(F.array(*[F.lit(a) for a in sorted({*grid, 0.0, 1.0})])).alias("a")).withColumn("w", F.pow("s", "a"))
        sums = shares.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("t")).alias("most"))
        got = {r["a"]: (float(math.log(r["z"]) - r["wl"] / r["z"]), mix.budget * whole["all"] * r["most"] / r["z"]) for r in sums.collect()}
        natural, equal = got[1.0][0], got[0.0][0]
        target = natural + mix.entropy * (equal - natural)
        if got[1.0][1] > mix.repeats * (1 + 1e-12):
            raise ValueError(f"a budget of {mix.budget} times the tokens can't keep to {mix.repeats} repeats")
        entropic = max([a for a in grid if got[a][0] >= target - 1e-12], default=low)
        limited = min([a for a in grid if got[a][1] <= mix.repeats * (1 + 1e-12)], default=high)
        if limited > entropic:  # the limit binds: its smallest exponent lies in the interval that ends at limited
            high, low = limited, grid[max(0, grid.index(limited) - 1)]
            best = limited
        else:
            low, high = entropic, grid[min(width, grid.index(entropic) + 1)]
            best = entropic
    return best


def mixed(rows: DataFrame, mix: Mix, source_col: str = "source", tokens_col: str = "n_tokens", key_cols: tuple[str, ...] = ()) -> DataFrame:
    """The rows in the mix: every row once for each epoch that takes it, with mix_epoch, mix_block and mix_order (a
    position key within the source's epoch) and mix_weight (its source's weight).

    A source's part of the budget is weight * budget * all tokens. Blocks come in the order of a hash of (seed,
    source, epoch, block); in the block where the part is met, rows come in the order of a hash and are taken while
    the tokens before them fall short of it, so a source overshoots by less than one row. Rows without tokens are
    taken with the position they have. A null source is a source like others. key_cols (all columns that can be hashed,
    if empty) tell rows apart: rows that are equal in them have one position and are taken together. Empty tables stay
    empty. Columns named like the four new ones are replaced; others are kept.

    Rows stay where they are. What is shuffled are sums: by source and block, and for the one block of a source that is
    cut, by part of it and then, for the part where the budget ends, by row (number, tokens). These give an epoch's
    last position, and rows are compared with that. The table of blocks (mix.blocks for each source and epoch, at most)
    is broadcast if it is counted to be small, and joined by shuffling beyond that.
    """
    rows = rows.drop(*[c for c in ("mix_epoch", "mix_block", "mix_order", "mix_weight") if c in rows.columns])

    def unit(*c) -> Column:
        return F.xxhash64(F.lit(mix.seed), *c)

    def place(epoch: Column, key: Column) -> Column:
        return F.shiftrightunsigned(unit(epoch, key), 1)  # not negative

    key = unit(*(key_cols or [c for c, kind in rows.dtypes if "map<" not in kind]))
    block = lambda key: F.pmod(key, F.lit(mix.blocks)).cast("int")
    slim = store.written(rows.select(F.col(source_col).alias("b_source"), key.alias("key"), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("t")), "mix-keys")
    totals = store.written(source_totals(slim, "b_source", "t"), "source-totals")
    power = tempered(totals, mix)
    sums = totals.filter("tokens > 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"), F.coalesce(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(power))), F.lit(1.0)).alias("z"))
    parts = (
        totals.crossJoin(F.broadcast(sums))  # one row
        .withColumn("mix_weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(power)) / F.col("z")).otherwise(0.0))
        .withColumn("part", F.col("mix_weight") * mix.budget * F.col("all_tokens"))
        .select(F.col("source").alias("_source"), "mix_weight", "part", (F.col("part") / F.greatest("tokens", F.lit(1))).alias("passes"))
        .withColumn("n_epochs", F.greatest(F.ceil(F.round("passes", 9)), F.lit(1)).cast("int"))
    )
    blocks = (
        slim.groupBy("b_source", block(F.col("key")).alias("b_block"))
        .agg(F.sum("t").alias("b_tokens"))
        .join(parts, F.col("b_source").eqNullSafe(F.col("_source")))
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("n_epochs") - 1)))
    )
    # whole epochs before this one are taken whole, so every epoch starts from its own number of tokens
    in_epoch = Window.partitionBy("b_source", "mix_epoch").orderBy(unit("b_source", "mix_epoch", "b_block"), "b_block")
    whole = Window.partitionBy("b_source", "mix_epoch")
    blocks = (
        blocks.withColumn("before", F.coalesce(F.sum("b_tokens").over(in_epoch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("b_tokens").over(whole) * F.col("mix_epoch"))
        .withColumn("rank", F.row_number().over(in_epoch))
        .filter((F.col("before") < F.col("part")) | (F.col("b_tokens") == 0))
        .select("b_source", "b_block", "mix_epoch", "mix_weight", "rank", (F.col("part") - F.col("before")).alias("room"), (F.col("before") + F.col("b_tokens") <= F.col("part")).alias("full"))
    )
    blocks = store.written(blocks, "mix-blocks")
    few = blocks.count() <= mix.broadcast
    ready = F.broadcast if few else (lambda df: df)

    # where the part is met: by thousands of parts of the block, then by row
    cut = blocks.filter("not full").select(F.col("b_source").alias("c_source"), "b_block", "mix_epoch", "room")
    same = lambda df: df["b_source"].eqNullSafe(F.col("c_source"))
    there = slim.join(ready(cut), same(slim) & (block(F.col("key")) == F.col("b_block"))).select("c_source", "mix_epoch", "room", place(F.col("mix_epoch"), F.col("key")).alias("at"), "t")
    piece = F.shiftright("at", 63 - PIECES).alias("piece")
    pieces = there.groupBy("c_source", "mix_epoch", "room", piece).agg(F.sum("t").alias("t"))
    running = Window.partitionBy("c_source", "mix_epoch").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("t").over(running), F.lit(0))).filter(F.col("before") < F.col("room"))
    last = pieces.groupBy("c_source", "mix_epoch", "room").agg(F.max_by(F.struct("piece", "before"), "piece").alias("last"))
    last = last.select(F.col("c_source").alias("l_source"), F.col("mix_epoch").alias("l_epoch"), F.col("last.piece").alias("l_piece"), (F.col("room") - F.col("last.before")).alias("left"))
    ending = there.withColumn("piece", piece).join(ready(last), F.col("c_source").eqNullSafe(F.col("l_source")) & (F.col("mix_epoch") == F.col("l_epoch")) & (F.col("piece") == F.col("l_piece")))
    ending = ending.groupBy("l_source", "l_epoch", "at", "left").agg(F.sum("t").alias("t"))
    sofar = Window.partitionBy("l_source", "l_epoch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = ending.withColumn("before", F.coalesce(F.sum("t").over(sofar), F.lit(0))).filter(F.col("before") < F.col("left")).groupBy("l_source", "l_epoch").agg(F.max("at").alias("end"))
    placed = blocks.join(ready(ends), F.col("b_source").eqNullSafe(F.col("l_source")) & (F.col("mix_epoch") == F.col("l_epoch")) & ~F.col("full"), "left")
    placed = store.written(placed.select("b_source", "b_block", "mix_epoch", "mix_weight", (F.col("rank") - 1).alias("mix_block"), "full", "end"), "mix-ends")

    # every column of the rows has a new name meanwhile, so none clashes with those of the blocks
    kept = rows.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(source_col).alias("source"))
    taken = kept.join(ready(placed), F.col("source").eqNullSafe(F.col("b_source")) & (block(F.col("key")) == F.col("b_block"))).withColumn("mix_order", place(F.col("mix_epoch"), F.col("key")))
    taken = taken.filter(F.col("full") | (F.col("mix_order") <= F.col("end")))
    return taken.select("row.*", "mix_epoch", "mix_block", "mix_order", "mix_weight")
