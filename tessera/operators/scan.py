"""Running values along each key's rows, also where one key holds a large part of all rows.

A window over a key puts the key's rows into one task. Here rows are first cut into slices: spread() range-partitions a
table by key and order and writes it with each row's slice, so that slices have about equal numbers of rows, a long key
has many and short keys share one. scanned() then runs windows within (key, slice), sums each slice up in one row, runs
along these few rows, and joins what comes from other slices back. On a table that isn't spread it is plain windows over
the key, with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.stored import TASK_ROWS, written

SLICE = "_slice"


@dataclass(frozen=True)
class Scan:
    """What to run along the rows: sum, max, min, first or last (both of values that aren't null) of value, over the rows
    that are before this one, so_far (this one included), to_come (from this one on), after, or all of the key."""

    value: Column
    how: str
    where: str = "so_far"


def so_far(how: str, value: Column | str) -> Scan:
    return Scan(_column(value), how, "so_far")


def before(how: str, value: Column | str) -> Scan:
    return Scan(_column(value), how, "before")


def after(how: str, value: Column | str) -> Scan:
    return Scan(_column(value), how, "after")


def to_come(how: str, value: Column | str) -> Scan:
    return Scan(_column(value), how, "to_come")


def whole(how: str, value: Column | str) -> Scan:
    return Scan(_column(value), how, "all")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_spread(rows: DataFrame) -> bool:
    return SLICE in rows.columns


def slices_for(rows: DataFrame) -> int:
    """As many slices as rows ask for, which are counted, at least spark.sql.shuffle.partitions."""
    return _slices_of(rows, rows.count())


def _slices_of(rows: DataFrame, n: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))


def tasks_for(rows: DataFrame) -> int | None:
    """How many tasks must share spread rows for none to hold more than about TASK_ROWS; None if one may hold them all, or
    they aren't spread. The slices' column tells how many rows there were when they were spread."""
    n = rows.schema[SLICE].metadata.get("rows", 0) if is_spread(rows) else 0
    return _slices_of(rows, n) if n > TASK_ROWS else None


def laid(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """rows dealt by keys to this many tasks, or left to Spark, which coalesces tasks by the bytes that it shuffles: these
    are few for numbers that rise, and many once they are sorted."""
    return rows.repartition(tasks, *keys) if tasks else rows


def spread(rows: DataFrame, *order: str, key: str = "key", slices: int | None = None) -> DataFrame:
    """rows from a written table, with a number _slice that rises with (key, order); without it, where a row stands in a
    key is not decided by its slice. Rows without a key belong to none and are left out. Slices number as many as
    spark.sql.shuffle.partitions unless told, or more if these would have over TASK_ROWS rows each: what is written is
    counted, and cut anew then."""

    def cut(rows: DataFrame, number: int) -> DataFrame:
        parts = rows.drop(SLICE).filter(F.col(key).isNotNull()).repartitionByRange(number, key, *order)
        # written, as bounds of ranges are sampled anew whenever they are computed
        return written(parts.withColumn(SLICE, F.spark_partition_id()))

    out = cut(rows, slices or _slices_of(rows, 0))
    n = out.count()
    if not slices and n > TASK_ROWS * _slices_of(rows, 0):
        out = cut(out, _slices_of(rows, n))
    return out.withColumn(SLICE, F.col(SLICE).alias(SLICE, metadata={"rows": n}))


def spread_like(rows: DataFrame, other: DataFrame, *order: str, key: str = "key") -> DataFrame:
    """rows spread by order if other is spread, else as they are."""
    return spread(rows, *order, key=key) if is_spread(other) else rows.drop(SLICE)


def kept_step(rows: DataFrame) -> DataFrame:
    """rows, written if they are spread: between two scans, so that the first isn't computed for the second's sums again."""
    return written(rows) if is_spread(rows) else rows


_FRAMES = {
    "before": (Window.unboundedPreceding, -1),
    "so_far": (Window.unboundedPreceding, Window.currentRow),
    "to_come": (Window.currentRow, Window.unboundedFollowing),
    "after": (1, Window.unboundedFollowing),
    "all": (Window.unboundedPreceding, Window.unboundedFollowing),
}


def _function(how: str) -> Callable[[Column], Column]:
    return {"sum": F.sum, "max": F.max, "min": F.min, "first": lambda c: F.first(c, True), "last": lambda c: F.last(c, True)}[how]


def scanned(rows: DataFrame, order: Iterable[str], scans: dict[str, Scan], key: str | list[str] = "key") -> DataFrame:
    """rows with a column for each scan, along order (columns, rising) within the key. If rows are spread, their slices
    must rise with order; a sum of doubles then adds slice by slice."""
    keys, order = [key] if isinstance(key, str) else list(key), list(order)
    if not is_spread(rows):
        line = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns({name: _function(s.how)(s.value).over(line.rowsBetween(*_FRAMES[s.where])) for name, s in scans.items()})
    parts = [*keys, SLICE]
    place = F.struct(*order)
    total = {"sum": F.sum, "max": F.max, "min": F.min, "first": lambda c: F.min_by(c, F.when(c.isNotNull(), place)), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place))}
    sums = rows.groupBy(*parts).agg(*[total[s.how](s.value).alias(name) for name, s in scans.items()])
    # what other slices of the key bring: one row a slice, so a key has at most as many as there are slices
    along = Window.partitionBy(*keys).orderBy(SLICE)
    outside = {"before": "before", "so_far": "before", "to_come": "after", "after": "after", "all": "all"}
    carried = sums.select(*[F.col(p).alias(f"_c_{p}") for p in parts], *[_function(s.how)(F.col(name)).over(along.rowsBetween(*_FRAMES[outside[s.where]])).alias(f"_c{i}") for i, (name, s) in enumerate(scans.items())])
    inside = Window.partitionBy(*parts).orderBy(*order)
    dealt = rows if all(s.where == "all" for s in scans.values()) else laid(rows, tasks_for(rows), *parts)
    local = dealt.withColumns({name: _function(s.how)(s.value).over(inside.rowsBetween(*_FRAMES[s.where])) for name, s in scans.items() if s.where != "all"})
    on = [local[p] == carried[f"_c_{p}"] for p in parts]
    # a key in one slice is a row of carried, too, so it grows with the keys: where rows lie by slice already, it is dealt like them
    both = local.join(carried if all(s.where == "all" for s in scans.values()) else carried.hint("merge"), on)
    out = {}
    for i, (name, s) in enumerate(scans.items()):
        here, there = F.col(name), F.col(f"_c{i}")
        if s.where == "all":
            out[name] = there
        elif s.how == "sum":
            out[name] = F.when(here.isNull() | there.isNull(), F.coalesce(here, there)).otherwise(there + here)
        elif s.how in ("max", "min"):
            out[name] = (F.greatest if s.how == "max" else F.least)(here, there)
        else:
            # rows of other slices come first where they are before this one and the first is wanted, or behind and the last
            out[name] = F.coalesce(there, here) if (s.how == "first") == (s.where in ("before", "so_far")) else F.coalesce(here, there)
    return both.withColumns(out).drop(*[f"_c_{p}" for p in parts], *[f"_c{i}" for i in range(len(scans))])


def lag(value: Column | str) -> Scan:
    """The value of the row before, in a struct named v, so that a null stays one: read it as column.v."""
    return before("last", F.struct(_column(value).alias("v")))


def lead(value: Column | str) -> Scan:
    """The value of the row after, in a struct named v."""
    return after("first", F.struct(_column(value).alias("v")))


#: rows of a block of neighbours
BLOCK = 1 << 16


def with_following(rows: DataFrame, columns: dict[str, str], many: int, at: str = "_at", block: int = BLOCK) -> DataFrame:
    """rows with an array for each of columns (new name: column) of that column's values in the next many rows of the key,
    fewer at its end. at is a row's place in the key, counted without gaps; rows go to blocks of places, and the first
    rows of a block to the one before as well, so that no window is longer than a block."""
    place = F.col(at)
    number = lambda shift: F.floor((place - shift) / block)
    near = rows.withColumn("_block", F.explode(F.array_distinct(F.array(number(0), number(many)))))
    near = laid(near, tasks_for(rows), "key", "_block")
    following = Window.partitionBy("key", "_block").orderBy(at).rowsBetween(1, many)
    near = near.withColumns({name: F.collect_list(F.struct(F.col(c).alias("v"))).over(following) for name, c in columns.items()})
    return near.filter(F.col("_block") == number(0)).drop("_block").withColumns({name: F.transform(name, lambda x: x.v) for name in columns})


def walked(rows: DataFrame, at: str = "_at", to: str = "_to") -> DataFrame:
    """rows with a boolean visited: whether a walk that begins at the key's first row, and goes from each row that it visits
    to the row whose place is to (greater than its own place at), comes by.

    A row that no earlier row's step passes over is visited for sure, and what comes after it is a walk of its own. So
    only the stretches behind steps that pass over rows are open; their walks are found by pointer jumping: steps are
    doubled until none stays in its stretch, and at each doubling the rows reached so far reach as many again. As a walk
    comes by a row once, no row is reached twice."""
    tasks = tasks_for(rows)
    rows = kept_step(scanned(rows, [at], {"_passed": before("max", to)}))
    open_row = F.coalesce(F.col("_passed") > F.col(at), F.lit(False))
    inside = scanned(rows.withColumn("_open", open_row), [at], {"_head": so_far("max", F.when(~open_row, F.col(at)))})
    steps = written(inside.filter(F.col("_open") | (F.col(to) > F.col(at) + 1)).select("key", F.col("_head").alias("head"), F.col(at).alias("a"), F.col(to).alias("b")))
    reached = steps.filter("a = head").select("key", "head", "a")
    place, goal = ["key", "head", "a"], ["key", "head", "b"]
    while not steps.isEmpty():
        by_place = laid(steps, tasks, *place)
        reached = written(reached.union(laid(reached, tasks, *place).join(by_place, place).select("key", "head", F.col("b").alias("a"))))
        further = laid(steps.select("key", "head", F.col("a").alias("b"), F.col("b").alias("c")), tasks, *goal)
        steps = written(laid(steps, tasks, *goal).join(further, goal).select("key", "head", "a", F.col("c").alias("b")))
    # a walk ends at a row that isn't open, which is visited anyway
    met = reached.filter("a > head").select(F.col("key").alias("_k"), F.col("a").alias("_p"), F.lit(True).alias("_met"))
    out = laid(rows, tasks, "key", at).join(laid(met, tasks, "_k", "_p"), (F.col("key") == F.col("_k")) & (F.col(at) == F.col("_p")) & open_row, "left")
    return out.withColumn("visited", ~open_row | F.coalesce("_met", F.lit(False))).drop("_passed", "_k", "_p", "_met")
