"""Exact top-k inner products by aggregation of sorted lists without random access.

Each component of the vectors is a list sorted by value, read from its high end where a query's component is positive and
from its low end where it is negative. Lists are read in the same rounds for all queries. What a vector's unread
components can still add is bounded by where each list stands (from above) and by its far end (from below); once the k-th
best lower bound of a query is over the upper bounds of all but a few vectors, only those few are left, and their scores
are completed. Vectors are worked on in blocks, whose lists travel with them, and a query's k-th score so far is its
lower bound in the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

BLOCKS = "n_dims int, block long, n int, ids binary, nulls binary, uids binary, cells binary, lists binary"
HITS = "query_uid long, query_id long, vec_id long, uid long, score long"
#: parts of each list that are read by the end of each round
ROUNDS = (1 / 8, 1 / 4, 1 / 2, 1)
#: a query with at most so many vectors left in a block has them completed
FEW = 64


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """uid, id and v (longs, floor of scale * component as double) of the rows that take part: those whose vector isn't
    null and has only finite components. uid numbers the rows, so that rows that share an id stay apart."""
    whole = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.coalesce(whole, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _blocks(rows: DataFrame, size: int, with_lists: bool) -> DataFrame:
    """Rows of equal numbers of components in blocks of up to size, each one row of bytes: ids, numbers of rows, cells (row by
    row), and lists: for each component the places of the block's rows by rising value."""

    def packed(n_dims: int, ids: list, uids: list, vs: list, number: int) -> dict:
        cells = np.array(vs, np.int64).reshape(len(ids), n_dims)
        lists = np.argsort(cells, axis=0, kind="stable").astype(np.uint32).T.tobytes() if with_lists else b""
        known = [0 if i is None else i for i in ids]
        nulls = np.array([i is None for i in ids], np.uint8).tobytes()
        return {"n_dims": n_dims, "block": number, "n": len(ids), "ids": np.array(known, np.int64).tobytes(), "nulls": nulls, "uids": np.array(uids, np.int64).tobytes(), "cells": cells.tobytes(), "lists": lists}

    schema = pa.schema([("n_dims", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "nulls", "uids", "cells", "lists")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for i, uid, v in zip(*(batch.column(c).to_pylist() for c in ("id", "uid", "v")), strict=True):
                ids, uids, vs = open_blocks.setdefault(len(v), ([], [], []))
                ids.append(i)
                uids.append(uid)
                vs.append(v)
                if len(ids) == size:
                    del open_blocks[len(v)]
                    yield pa.RecordBatch.from_pylist([packed(len(v), ids, uids, vs, uids[0])], schema)
        for n_dims, (ids, uids, vs) in open_blocks.items():
            yield pa.RecordBatch.from_pylist([packed(n_dims, ids, uids, vs, uids[0])], schema)

    return rows.select("uid", "id", "v").mapInArrow(run, BLOCKS)


class _Queries:
    """A block of queries, and of each the best k so far: scores, ids (null as the largest), row numbers."""

    def __init__(self, row: dict, k: int):
        n = row["n"]
        self.k, self.ids, self.nulls = k, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], np.uint8)
        self.uids = np.frombuffer(row["uids"], np.int64)
        self.cells = np.frombuffer(row["cells"], np.int64).reshape(n, row["n_dims"])
        self.best: list[list[tuple[int, bool, int, int]]] = [[] for _ in range(n)]

    def least(self) -> np.ndarray:
        """Of each query the score that k vectors have reached already; minus infinity while there are fewer."""
        return np.array([b[-1][0] * -1.0 if len(b) == self.k else -np.inf for b in self.best])

    def take(self, q: int, scores: np.ndarray, block: _Block, rows: np.ndarray) -> None:
        new = [(-int(s), bool(block.nulls[r]), int(block.ids[r]), int(block.uids[r])) for s, r in zip(scores, rows, strict=True) if block.uids[r] != self.uids[q]]
        self.best[q] = sorted(self.best[q] + new)[: self.k]

    def hits(self) -> pd.DataFrame:
        rows = [(int(self.uids[q]), int(self.ids[q]), None if null else i, uid, -s) for q, best in enumerate(self.best) for s, null, i, uid in best]
        out = pd.DataFrame(rows, columns=["query_uid", "query_id", "vec_id", "uid", "score"])
        return out.astype({"vec_id": "Int64"})


class _Block:
    """A block of vectors with its sorted lists."""

    def __init__(self, row: dict):
        n, d = row["n"], row["n_dims"]
        self.n, self.ids, self.nulls, self.uids = n, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], np.uint8), np.frombuffer(row["uids"], np.int64)
        self.cells = np.frombuffer(row["cells"], np.int64).reshape(n, d)
        self.places = np.frombuffer(row["lists"], np.uint32).reshape(d, n)
        self.lists = np.take_along_axis(self.cells.T, self.places.astype(np.int64), 1)


def _exact(q: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; those that doubles can't hold are summed as Python's numbers."""
    size = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(cells.astype(float)).max(initial=0)) * max(1, len(q))
    if size < 2.0**53:
        return (cells.astype(float) @ q.astype(float)).astype(np.int64)
    return (cells.astype(object) @ q.astype(object)) if len(q) else np.zeros(len(cells), np.int64)


def _search(queries: _Queries, block: _Block, k: int) -> None:
    """Adds the block's vectors to the queries' best k."""
    n, d = block.n, block.cells.shape[1]
    if not n:
        return
    q = queries.cells.astype(float)
    rising, falling = np.maximum(q, 0), np.minimum(q, 0)
    # sums of doubles round once they pass 2**53: bounds are widened by as much
    slack = 0.0 if (size := np.abs(q).max(initial=0) * np.abs(block.lists.astype(float)).max(initial=0) * max(d, 1)) < 2.0**53 else size * max(d, 1) * 2.0**-50
    lists = block.lists.astype(float)
    everywhere, dims = np.arange(d)[:, None], np.arange(d)
    # read cells hold their value; an unread one is at most what its list shows next, at least what the list ends with
    high_top, high_low = np.empty((n, d)), np.empty((n, d))
    low_top, low_low = np.empty((n, d)), np.empty((n, d))
    read = 0
    left = np.arange(len(q))
    least = queries.least()
    unread_high, unread_low = np.ones((n, d), bool), np.ones((n, d), bool)
    high_low[:], low_low[:] = (lists[:, 0], lists[:, -1]) if d else (0.0, 0.0)
    for share in ROUNDS:
        to = min(n, max(read + 1, int(n * share)))
        if d:
            at = block.places[:, n - to : n - read]
            high_top[at, everywhere] = high_low[at, everywhere] = lists[:, n - to : n - read]
            unread_high[at, everywhere] = False
            at = block.places[:, read:to]
            low_top[at, everywhere] = low_low[at, everywhere] = lists[:, read:to]
            unread_low[at, everywhere] = False
        read = to
        if read < n:
            high_top = np.where(unread_high, lists[dims, n - read - 1], high_top)
            low_top = np.where(unread_low, lists[dims, read], low_top)
        upper = rising[left] @ high_top.T + falling[left] @ low_top.T + slack
        if read < n:
            lower = rising[left] @ high_low.T + falling[left] @ low_low.T - slack
            if n > k:
                # one more than k: a query may be among the block's vectors, and doesn't count
                least[left] = np.maximum(least[left], np.partition(lower, n - 1 - k, axis=1)[:, n - 1 - k])
        open_rows = upper >= least[left, None]
        counts = open_rows.sum(1)
        done = np.flatnonzero(counts <= FEW) if read < n else np.arange(len(left))
        for j in done.tolist():
            rows = np.flatnonzero(open_rows[j])
            if read == n and not slack and len(rows) > k + 1:
                # all is read, so bounds are scores: of the many, those that k + 1 don't beat
                rows = rows[upper[j, rows] >= np.partition(upper[j, rows], len(rows) - 1 - k)[len(rows) - 1 - k]]
            if len(rows):
                queries.take(left[j], _exact(queries.cells[left[j]], block.cells[rows]), block, rows)
        left = np.delete(left, done)
        if not len(left):
            return


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048, query_block: int = 1024, span: int = 32) -> DataFrame:
    """query_uid, query_id, rank (from 1), vec_id and score of each query's k vectors with the highest inner products,
    ties to the smaller vec_id (null last). vectors and queries have uid, id and v (longs); a query is not its own
    candidate, but other rows with its id are. Vectors meet those with as many components; the empty ones meet each other
    with score 0. Queries without candidates have no rows.

    Blocks of vectors meet groups of about two query blocks in tasks of up to about span vector blocks: a task holds a group and
    one block at a time, and hands on k rows a query. Each vector is sent once for each group. With whole numbers of up to 2**53 scores
    are exact; beyond, too, by slower sums; a score beyond 64 bits fails the query."""
    spark = vectors.sparkSession
    data = store.written(_blocks(vectors, block, True), "vector-blocks")
    asked = store.written(_blocks(queries, query_block, False), "query-blocks")
    partitions, blocks = int(spark.conf.get("spark.sql.shuffle.partitions")), data.count()
    spans, groups = max(1, min(blocks, max(-(-blocks // span), partitions))), max(1, asked.count() // 2)
    number = lambda n: F.pmod(F.xxhash64("n_dims", "block"), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    every = asked.withColumns({"g": number(groups), "s": to_all(spans), "kind": F.lit(0)}).unionByName(data.withColumns({"g": to_all(groups), "s": number(spans), "kind": F.lit(1)}))
    tasks = max(partitions, spans)
    dealt = every.repartition(tasks, "g", "s").sortWithinPartitions("g", "s", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current = None, []
        schema = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (row["g"], row["s"]) != at:
                    for queries in current:
                        yield pa.RecordBatch.from_pandas(queries.hits(), schema, preserve_index=False)
                    at, current = (row["g"], row["s"]), []
                if row["kind"] == 0:
                    current.append(_Queries(row, k))
                elif same := [queries for queries in current if queries.cells.shape[1] == row["n_dims"]]:
                    vectors = _Block(row)
                    for queries in same:
                        _search(queries, vectors, k)
        for queries in current:
            yield pa.RecordBatch.from_pandas(queries.hits(), schema, preserve_index=False)

    found = dealt.mapInArrow(run, HITS)
    best = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_uid", "query_id", "rank", "vec_id", "score")
