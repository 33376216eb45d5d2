"""The queries of this subpackage, one opN_<name> for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontaminate, interpolation, licenses, media, mixing, neardup, periodic, pii, store, topk, toxicity, urlfilter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: its payload in the archive, as read back. Records are known by their places, so pages whose ids
    repeat or are null each have one; a null html is an empty payload."""
    pages = _read(spark, sf_dir, "pages")
    chunks = warc.record_chunks(pages, "page_id", "url", "html", least_bytes=0)
    manifest = warc.write_warc(chunks, store.new_path(spark, "warc"))
    records = warc.record_table(warc.read_warc(manifest, with_data=False))
    return records.select(F.col("row_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "n_chunks")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each epoch that takes them. A null source is a source; rows that are equal in id,
    source and number of tokens have one place and are taken together."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"))
    return mixing.mixed(store.written(docs, "token-counts"), mixing.Mix()).select("doc_id", "source", "n_tokens", "mix_epoch", "mix_block", F.round("mix_weight", 9).alias("mix_weight"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, read back from the shards. Null texts are empty; equal texts share a member's values; ids may
    repeat or be null."""
    docs = _read(spark, sf_dir, "documents")
    rows = media.store_payloads(docs, store.new_path(spark, "shards"), "doc_id", "text")
    places = store.written(media.members(rows), "media-members")
    columns = media.headers(places).join(media.features(places), "media_sha256")
    return rows.select("doc_id", "media_sha256").join(columns, "media_sha256").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of each document's paragraphs, sorted, and how many paragraphs have one. Rows are known by id and text:
    ids may repeat or be null, and equal rows get the same answer. Null and empty texts have none."""
    docs = _read(spark, sf_dir, "documents")
    found = licenses.license_paragraphs(docs, "doc_id", "text").filter(F.col("family") != licenses.UNKNOWN).select("doc_id", "mark", "paragraph", "family").distinct()
    each = found.groupBy(F.col("doc_id").alias("id"), "mark").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count("*").alias("n_paragraphs"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("own_mark"))
    met = rows.join(each, rows["doc_id"].eqNullSafe(each["id"]) & (rows["own_mark"] == each["mark"]), "left")
    return met.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document. Null texts are scored as empty ones; equal texts score alike; a row without an id has a null
    held_out and is never learned from."""
    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    sample = toxicity.labelled_sample(docs, _read(spark, sf_dir, "labels").filter(~held_out), "doc_id", "toxic", "text")
    model = toxicity.learn(store.written(sample, "labelled"), "text", "label")
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, known by id and text; null and empty texts have no words and no hits."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("mark")


URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page; rows that repeat are each judged, and a null url has an empty host and path."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: rows are known by id and text, which may repeat or be null; equal rows have the same spans."""
    docs = _read(spark, sf_dir, "documents")
    return pii.digests(docs, pii.personal_data(docs, "doc_id", "text"), "doc_id", "text")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document. Null and empty texts are one end token; a row without an id has a null held_out and isn't
    learned from; repeated rows each count."""
    docs = _read(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    rows = interpolation.scored(docs, remainder != 2, "doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document. Texts without words are linked with nothing; rows that repeat an id stay separate, and a row
    without an id belongs to its component but doesn't name it."""
    return neardup.duplicate_classes(_read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_shingles", "component_id", "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part (lang; null: empty), order of the five filters and step. Repeated ids: a row fails E if some
    row with a smaller id has its text; rows without an id never do. No documents, no rows."""
    docs = _read(spark, sf_dir, "documents")
    counts = store.written(audit.failure_counts(docs, audit.text_failures(F.col("text")), labels=_read(spark, sf_dir, "labels")), "failure-counts")
    out = audit.orders(audit.lattice_edges(counts, "ABCDE"), "ABCDE")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", F.col("removed_quality").alias("good_lost"), F.col("removed_toxic").alias("toxic_lost"), "shapley")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each vector whose id is divisible by 50. Rows that repeat an id are queries and candidates of
    their own; a row without an id is a candidate only, after the others of its score."""
    vectors = store.written(topk.quantised(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "quantised")
    return topk.nearest(vectors, vectors.filter("id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document after the planting that its id decides; a row without an id stays as it is."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    found = periodic.periodic_runs(docs, "text", seed_col="h", change=periodic.planted)
    longest = F.element_at(F.array_sort("found.runs", lambda a, b: F.when(a.length != b.length, F.signum(b.length - a.length)).when(a.start != b.start, F.signum(a.start - b.start)).otherwise(F.signum(a.period - b.period)).cast("int")), 1)
    listed = F.array_join(F.transform("found.runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    rows = found.select("doc_id", "found", F.when(F.size("found.runs") > 0, longest).alias("top"), F.when(F.size("found.runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"))
    return rows.select(
        "doc_id",
        F.size("found.runs").cast("long").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("found.collapsed", 256).alias("collapsed_sha256"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hit AS (SELECT DISTINCT doc_id, dw.m, i, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.m = bw.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP7_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
)
SELECT page_id, host, path,
  (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT max_by(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), g AS (SELECT doc_id, unnest(sh) AS x FROM s), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.sh) + len(q.sh) - n)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM s LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), first AS (SELECT text, min(doc_id) AS m FROM t GROUP BY text),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN t.doc_id > m THEN 'E' ELSE '' END AS f
  FROM t JOIN first USING (text) LEFT JOIN marks ON marks.doc_id = t.doc_id
), g AS (SELECT part, f, good, toxic, count(*) AS n FROM d GROUP BY ALL),
l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
p AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o FROM l a JOIN l b ON b.c <> a.c JOIN l c ON c.c NOT IN (a.c, b.c) JOIN l d ON d.c NOT IN (a.c, b.c, c.c) JOIN l e ON e.c NOT IN (a.c, b.c, c.c, d.c)
), s AS (SELECT o, unnest(range(1, 6)) AS step FROM p), e AS (SELECT o, step, substr(o, 1, step - 1) AS before, substr(o, step, 1) AS c FROM s),
x AS (
  SELECT part, o, step, c, n, f, good, toxic, before <> '' AND translate(f, before, '') <> f AS gone, contains(f, c) AS fails FROM g, e
), y AS (
  SELECT part, o, step, c, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f = c THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM y
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_mixing, op3_media, op4_license_scan, op5_toxicity, op6_decontamination, op7_url_filter, op8_pii, op9_lm_scoring, op10_near_duplicates, op11_filter_audit, op12_topk, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6_SQL, "op7_url_filter": OP7_SQL, "op10_near_duplicates": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_topk": OP12_SQL}
