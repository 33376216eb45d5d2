"""Nested JSON documents, taken apart to any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.stored import written

_SAFE = {"mode": "PERMISSIVE"}


def _children(json: Column, kind: Column) -> Column:
    """The values of an object or array in their order, each with its own JSON and whether it is one of the two."""

    def inside(v: Column, text: Column) -> Column:
        kind = F.schema_of_variant(v)
        nested = F.when(kind.startswith("OBJECT<"), "object").when(kind.startswith("ARRAY<"), "array")
        plain = F.when(kind == "BOOLEAN", F.initcap(text)).when(kind == "VOID", F.lit("")).otherwise(text)
        return F.struct(nested.alias("kind"), F.when(nested.isNotNull(), text).otherwise(plain).alias("json"))

    fields = F.zip_with(F.map_values(F.from_json(json, "map<string,variant>", _SAFE)), F.map_values(F.from_json(json, "map<string,string>", _SAFE)), inside)
    items = F.zip_with(F.from_json(json, "array<variant>", _SAFE), F.from_json(json, "array<string>", _SAFE), inside)
    return F.when(kind == "object", fields).when(kind == "array", items)


def json_values(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id_col, path, value): the values at the leaves of each row's JSON object, with their places from the top down,
    which sort as the document has them. Strings, numbers and booleans (True, False) are texts, null is the empty one.
    What isn't an object, and unreadable JSON, has none. One level a round, each written, until no object or array is
    left; rounds are as many as the deepest document has levels."""
    level = rows.select(F.col(id_col).alias("id"), F.array().cast("array<int>").alias("path"), F.when(F.ltrim(F.col(json_col)).startswith("{"), "object").alias("kind"), F.col(json_col).alias("json")).filter("kind is not null")
    leaves = None
    while True:
        each = level.select("id", "path", F.posexplode(_children(F.col("json"), F.col("kind"))).alias("i", "c"))
        each = written(each.select("id", F.array_append("path", F.col("i")).alias("path"), "c.kind", "c.json"))
        plain = each.filter("kind is null").select("id", "path", F.col("json").alias("value"))
        leaves = plain if leaves is None else leaves.unionByName(plain)
        level = each.filter("kind is not null")
        if level.isEmpty():
            return leaves.withColumnRenamed("id", id_col)


def with_json_text(rows: DataFrame, id_col: str, json_col: str, out: str = "json_text") -> DataFrame:
    """rows with the values of their JSON object in one text, in document order; the empty text without any. id_col
    tells rows apart."""
    found = json_values(rows, id_col, json_col).groupBy(F.col(id_col).alias("_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: x.value), " ").alias(out))
    return rows.join(found, F.col(id_col) == F.col("_id"), "left").withColumn(out, F.coalesce(out, F.lit(""))).drop("_id")
