"""URL rule lists, matched by hashed host-suffix and path-prefix expressions.

A rule is (host, path, verdict). It fits a URL whose host equals the rule's or is a subdomain of it and whose path
starts with the rule's. Every URL is expanded into the expressions that some rule could equal, these meet the rules
in an equi-join on a short prefix of their digests, full digests confirm, and the longest fitting rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for text without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(
    urls: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    default: str = "allow",
    short_bytes: int = 4,
    broadcast_rules: int = 100_000,
) -> DataFrame:
    """Adds host, path, rule and verdict to every row of urls.

    rules has host, path and verdict ("allow" or "block"); rules with a null in any of them are ignored. The longest
    rule (length of host plus path, then of host) wins; if the same rule is both allowed and blocked, block wins.
    URLs that no rule fits, null and malformed ones get a null rule and the default. Columns of urls that clash with
    the four added ones are replaced. An empty rule table gives every row the default.

    Only (labels, path length) shapes that occur among the rules are expanded, so a URL yields at most as many
    expressions as there are shapes. Each distinct (host, path) is expanded once, so a hot URL costs one row.
    Up to broadcast_rules rules (counted first) are broadcast; more are joined by shuffling on the short hash.
    """
    clean = (
        rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .dropna()
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))  # "block" > "allow"
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("r_short", F.substring("r_digest", 1, 2 * short_bytes))
    )
    shapes = clean.select(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("length")).distinct().collect()
    host, path = url_parts(F.col(url_col))
    rows = urls.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col]).withColumns({"host": host, "path": path})
    if not shapes:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    table = F.broadcast(clean) if clean.count() <= broadcast_rules else clean

    shape = F.array(*[F.struct(F.lit(s.labels).alias("labels"), F.lit(s.length).alias("length")) for s in shapes])
    n_labels = F.size(F.split("host", r"\."))
    expressions = (
        rows.filter(F.col("host") != "")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(F.filter(shape, lambda s: (s.labels <= n_labels) & (s.length <= F.length("path")))).alias("s"))
        .select("host", "path", F.expr("substring_index(host, '.', -s.labels)").alias("suffix"), F.expr("substring(path, 1, s.length)").alias("prefix"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .select("host", "path", "digest", F.substring("digest", 1, 2 * short_bytes).alias("short"))
    )
    verdicts = (
        expressions.join(table, F.col("short") == F.col("r_short"))
        .filter(F.col("digest") == F.col("r_digest"))
        .withColumn("rule", F.concat("r_host", "r_path"))
        .groupBy(F.col("host").alias("v_host"), F.col("path").alias("v_path"))
        .agg(F.max(F.struct(F.length("rule").alias("a"), F.length("r_host").alias("b"), "rule", "r_verdict")).alias("best"))
    )
    return (
        rows.join(verdicts, (F.col("host") == F.col("v_host")) & (F.col("path") == F.col("v_path")), "left")
        .withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.r_verdict", F.lit(default))})
        .drop("v_host", "v_path", "best")
    )
