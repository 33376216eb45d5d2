"""Substring search by an index of trigrams: postings of the query's trigrams are intersected, and what they leave is
looked at."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.stored import folder

SIZE = 3
BUCKETS = 64


def trigrams(text: str) -> list[str]:
    text = text.lower()
    return sorted({text[i : i + SIZE] for i in range(len(text) - SIZE + 1)})


def write_index(rows: DataFrame, id_cols: list[str], text_col: str, path: str | None = None, buckets: int = BUCKETS) -> str:
    """Writes the trigrams of each row's lower-cased text, with id_cols, and returns where. A trigram's rows lie in the
    folder of its bucket, ordered by trigram, so that a reader of a few trigrams skips the rest. Tasks make lists of the
    rows that have a trigram, of some texts at a time; these are what is dealt and sorted, by trigram."""
    path = path or f"{folder(rows.sparkSession)}/tessera-trigrams-{uuid.uuid4().hex}"
    text = F.lower(text_col)
    ids = F.struct(*id_cols)
    said = rows.filter(F.length(text) >= SIZE).select(text.alias("_text"), ids.alias("_id"))
    kinds = rows.select(F.lit("").alias("gram"), F.array(ids).alias("ids")).schema
    # dealt, as a file may hold many texts, and to tasks that aren't coalesced by their bytes
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-said.count() // TASK_TEXTS))
    lists = said.repartition(tasks, "_id").mapInArrow(_lists, kinds).withColumn("bucket", F.pmod(F.crc32("gram"), F.lit(buckets)).cast("int"))
    lists.repartitionByRange(tasks, "bucket", "gram").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)
    return path


#: texts of a task
TASK_TEXTS = 20_000
#: texts and their characters that a task makes lists of at once
TEXTS, CHARS = 4096, 1 << 21


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each trigram of some texts (_text) with a list of those texts' ids (_id): few rows, whatever the texts."""
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        ends = np.cumsum([len(t) for t in texts])
        at = 0
        while at < len(texts):
            to = max(at + 1, min(at + TEXTS, int(np.searchsorted(ends, ends[at] + CHARS))))
            yield _list(texts[at:to], batch.column("_id").slice(at, to - at))
            at = to


def _list(texts: list[str], ids: pa.Array) -> pa.RecordBatch:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    # a trigram is three code points of 21 bits; those across two texts are none
    inside = row[2:] == row[:-2]
    grams, each = np.unique(((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])[inside], return_inverse=True)
    pairs = np.unique(each.astype(np.uint64) * np.uint64(len(texts)) + row[2:][inside])
    gram, which = pairs // np.uint64(len(texts)), pairs % np.uint64(len(texts))
    offsets = np.searchsorted(gram, np.arange(len(grams) + 1, dtype=np.uint64))
    points = np.stack([(grams >> np.uint64(s)) & np.uint64(0x1FFFFF) for s in (42, 21, 0)], axis=1).astype(np.uint32)
    text = points.tobytes().decode("utf-32-le", "surrogatepass")
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.take(pa.array(which.astype(np.int64))))
    return pa.RecordBatch.from_arrays([pa.array([text[i : i + SIZE] for i in range(0, len(text), SIZE)], pa.string()), lists], ["gram", "ids"])


def found(rows: DataFrame, id_cols: list[str], text_col: str, query: str, index: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows whose text contains query, case aside; none for an empty query. Only the postings of the query's trigrams are
    read, counted by row, and only rows that have them all are compared; a query of fewer than three characters has no
    trigram, and all rows are."""
    query = query.strip().lower()
    if not query:
        return rows.limit(0)
    grams = trigrams(query)
    holds = F.contains(F.lower(text_col), F.lit(query))
    if not grams:
        return rows.filter(holds)
    of = sorted({zlib.crc32(g.encode()) % buckets for g in grams})
    schema = rows.select(F.lit("").alias("gram"), F.array(F.struct(*id_cols)).alias("ids"), F.lit(0).alias("bucket")).schema
    lists = rows.sparkSession.read.schema(schema).parquet(index).filter(F.col("bucket").isin(of) & F.col("gram").isin(grams))
    postings = lists.select(F.explode("ids").alias("_id")).select("_id.*")
    all_of_them = postings.groupBy(*id_cols).agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(*id_cols)
    return rows.join(all_of_them, id_cols, "left_semi").filter(holds)
