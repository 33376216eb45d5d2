"""From documents to a training mix, in five stages that are each written as Parquet and read again.

A stage gets (spark, docs, sf_dir) and works on all that its predecessor kept. Documents keep their columns up to the
last stage, which adds those of the mix. A row is known by its doc_id and text: ids may repeat or be null, and a row goes
only if its own text is rejected. Of the columns, doc_id, text and source are read; others, of any name, come along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, neardup, pii, store, toxicity

#: the scores come from a model fitted on this run's labelled rows; SQL can't express that
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    sample = store.written(toxicity.labelled_sample(docs, labels, "doc_id", "toxic", "text"), "labelled")
    return docs.filter(toxicity.score(F.col("text"), toxicity.learn(sample, "text", "label")) < 0.5)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the least doc_id (and of several with it, one).
    Of rows that are equal in doc_id and text one stays; rows without words all stay."""
    found = store.written(neardup.duplicate_classes(docs, "doc_id", "text"), "near-duplicates")
    left = without(docs, found.filter("not first"))
    repeated = store.written(found.filter("first and n_shingles > 0").groupBy("doc_id", "mark").count().filter("count > 1").select("doc_id", "mark"), "repeated")
    if repeated.isEmpty():
        return left
    once = docs.join(repeated, of_document(docs, repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return without(left, repeated).unionByName(once).select(*docs.columns)


def of_document(docs: DataFrame, known: DataFrame) -> Column:
    """That a row of docs is one of known (doc_id, and mark, a hash of its text): ids may repeat or be null."""
    return docs["doc_id"].eqNullSafe(known["doc_id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(known["mark"])


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for the rows of rejected (doc_id, mark): a text goes, not all texts that share its id."""
    gone = rejected.select("doc_id", "mark").distinct()
    return docs.join(gone, of_document(docs, gone), "left_anti").select(*docs.columns)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of benchmark items."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, store.written(found.filter("contaminated").select("doc_id", "mark"), "contaminated"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows."""
    out = pii.redacted(docs, store.written(pii.personal_data(docs), "personal-data"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mix: documents once for each epoch that takes them, with n_tokens and the columns of the mix."""
    return mixing.mixed(docs.withColumn("n_tokens", mixing.token_count(F.col("text"))), mixing.Mix(), key_cols=("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("personal_data", personal_data_out),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return docs
