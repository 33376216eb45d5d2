"""Queries on text functions and candidate ranking, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import numeric as num
from tessera.functions import text as tx
from tessera.operators import blocklist, search
from tessera.operators import ranking as rk
from tessera.sources.stored import dealt
from tessera.sources.tables import table

STOP = "['a','an','and','are','as','at','be','but','by','for','from','has','have','i','if','in','into','is','it','its','of','on','or','our','that','the','their','there','this','to','was','we','were','with','you','your','about','after','before','during','then','than']"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def f1_tokens(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


F1 = "SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda t: lower(t))) AS token FROM documents) GROUP BY token"


#: documents of a task that holds their distinct tokens
TASK_DOCS = 5_000


def a6_concepts(spark, sf_dir):
    """Concepts by grouping tokens, as a corpus-wide plan. Texts are dealt by document before they are taken apart, so that
    tokens and their counts aren't shuffled."""
    t = dealt(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", rows=TASK_DOCS).select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))
    t = t.filter((F.length("token") >= 3) & ~F.col("token").isin(tx.STOP_WORDS))
    counts = t.groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = rk.top_per_group(counts, ["doc_id"], 4, [F.desc("n"), F.col("first")])
    lists = best.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x.token), " ").alias("concept"))
    return docs(spark, sf_dir).select("doc_id").join(lists, "doc_id", "left")


A6 = f"""WITH t AS (SELECT doc_id, unnest(ts) AS token, unnest(range(0, len(ts))) AS pos FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda t: lower(t)) AS ts FROM documents)),
c AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first FROM t WHERE length(token) >= 3 AND NOT list_contains({STOP}, token) GROUP BY doc_id, token),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c)
SELECT d.doc_id, x.concept FROM documents d LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY rank) AS concept FROM r WHERE rank <= 4 GROUP BY doc_id) x ON x.doc_id = d.doc_id"""


def a6_concept_function(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return tx.with_concepts(turns, "text").select("conv_id", "turn", tx.concept_text(F.col("concepts")).alias("concept"))


A6F = f"""WITH b AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda t: lower(t)) AS ts FROM conversations),
u AS (SELECT conv_id, turn, ts, list_filter(ts, lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t)) AS fs FROM b),
v AS (SELECT conv_id, turn, CASE WHEN len(fs) > 0 THEN fs ELSE ts[1:3] END AS us FROM u),
e AS (SELECT conv_id, turn, unnest(us) AS t, unnest(range(0, len(us))) AS p FROM v), c AS (SELECT conv_id, turn, t, count(*) AS n, min(p) AS first FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first) AS k FROM c), g AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY k) AS concept FROM r WHERE k <= 4 GROUP BY ALL)
SELECT v.conv_id, v.turn, coalesce(g.concept, 'general scene') AS concept FROM v LEFT JOIN g ON g.conv_id = v.conv_id AND g.turn = v.turn"""


def f2_entities(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(tx.entities(F.col("text")), "|").alias("entities"))


def f4_queries(spark, sf_dir):
    turns = tx.with_concepts(table(spark, sf_dir, "conversations"), "text").withColumn("named", tx.entities(F.col("text")))
    return turns.select("conv_id", "turn", F.array_join(tx.expanded_queries(F.col("text"), tx.concept_text(F.col("concepts")), F.col("concepts"), F.col("named")), "|").alias("queries"))


def f5_search_queries(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    c = tx.tokens(F.concat_ws(" ", "p_name", "p_type"))
    return part.select("p_partkey", F.array_join(tx.search_queries(F.col("p_name"), c, F.array(F.col("p_brand"), F.col("p_type"), F.lower("p_type"))), "|").alias("queries"))


F5 = """WITH t AS (SELECT p_partkey, p_name, p_brand, p_type, list_transform(regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z0-9'']+'), lambda x: lower(x)) AS c FROM part),
q AS (SELECT p_partkey, [trim(p_name), array_to_string(c[1:3], ' '), array_to_string(c[1:2], ' '), c[1]] AS a, [trim(p_brand), trim(p_type), lower(trim(p_type))] AS h FROM t),
o AS (SELECT p_partkey, list_filter(a, lambda x, i: x <> '' AND list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i)[1:3] AS o, h FROM q),
m AS (SELECT p_partkey, list_concat(o, h) AS m FROM o)
SELECT p_partkey, array_to_string(list_filter(m, lambda x, i: x <> '' AND list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i)[1:6], '|') AS queries FROM m"""


def p3_p5_p6_p7_words(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", F.explode(F.split(tx.squeezed(F.col("text")), " ")).alias("w"))
    return w.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.count_if(tx.is_filler(F.col("w"))).alias("fillers"),
        F.count_if(tx.is_editor_filler(F.col("w"))).alias("editor_fillers"),
        F.count_if(tx.found_in(F.col("w"), "Th")).alias("matches"),
    )


P5 = r"""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS w FROM documents)
SELECT doc_id, count(*) AS n,
  count(*) FILTER (regexp_replace(lower(trim(w)), '[.,!?;:]+$', '') IN ('um','uh','uhm','umm','hmm','hm','ah','er','eh','like','basically','literally','actually','right','you know','i mean','sort of','kind of','so yeah')) AS fillers,
  count(*) FILTER (trim(regexp_replace(lower(w), '[^a-z\s]', '', 'g')) IN ('um','uh','uhm','umm','hmm','hm','mm','ah','er','erm','eh','huh','mhm','like','basically','literally','actually','you know','i mean','sort of','kind of','right','okay','so','well','yeah')) AS editor_fillers,
  count(*) FILTER (contains(lower(w), 'th')) AS matches FROM w GROUP BY doc_id"""


#: substrings that are looked for, in any case
SEARCHES = ["the th", "QUE", "xyzzy", "o", "e.", "one and"]


def p7_indexed_search(spark, sf_dir):
    """Turns of conversations that contain each of some substrings, by an index of their trigrams."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    index = search.write_index(turns, ["conv_id", "turn"], "text")
    hits = [search.found(turns, ["conv_id", "turn"], "text", q, index).select(F.lit(q).alias("query"), "conv_id", "turn") for q in SEARCHES]
    return reduce(lambda a, b: a.union(b), hits)


P7 = f"SELECT q.query, conv_id, turn FROM conversations JOIN (VALUES {', '.join(f'({q!r})' for q in SEARCHES)}) q(query) ON contains(lower(text), lower(q.query))"


def p9_p10_blocked_and_latin(spark, sf_dir):
    terms = spark.createDataFrame([("idiot",), ("of the",), ("C++",), (" ",)], "term string")
    found = blocklist.blocked(docs(spark, sf_dir).select("doc_id", "text"), terms)
    return found.select("doc_id", F.col("term").isNotNull().alias("blocked"), F.round(tx.latin_share(F.col("text")), 6).alias("latin"))


P9 = r"""SELECT doc_id, regexp_matches(lower(text), '\bidiot\b') OR contains(lower(text), 'of the') OR regexp_matches(lower(text), '\bc\+\+\b') AS blocked,
  round(CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) = 0 THEN 1.0 ELSE length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / greatest(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 1) END, 6) AS latin FROM documents"""


def p9_blocked_by_long_list(spark, sf_dir):
    """The first of all customers' and parts' names, and of the words of benchmark items, that a document holds."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("term")).union(table(spark, sf_dir, "part").select("p_name"))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).filter("term rlike '^[a-z]{7,}$'")
    return blocklist.blocked(docs(spark, sf_dir).select("doc_id", "text"), names.union(words)).select("doc_id", "term")


P9_LONG = r"""WITH n AS (SELECT DISTINCT lower(trim(term)) AS term FROM (SELECT c_name AS term FROM customer UNION ALL SELECT p_name FROM part) WHERE trim(term) <> ''),
b AS (SELECT DISTINCT w AS term FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]{7,}')),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents),
h AS (SELECT doc_id, term FROM w JOIN b USING (term) UNION ALL SELECT doc_id, term FROM documents JOIN n ON contains(lower(text), term) WHERE contains(term, ' ') OR regexp_matches(lower(text), '\b' || replace(term, '#', '\#') || '\b'))
SELECT d.doc_id, min(term) AS term FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id"""


def f11_f12_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_id") % 3 == 0, F.format_string("%d:%02d.%03d", (F.col("event_id") % 60).cast("int"), (F.col("event_id") % 59).cast("int"), (F.col("event_id") % 1000).cast("int"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.col("value").cast("string"), F.lit(" Sec"))
    ).otherwise(F.format_string("%d:%02d:%02d", (F.col("event_id") % 5).cast("int"), (F.col("event_id") % 60).cast("int"), (F.col("event_id") % 59).cast("int")))
    return e.select("event_id", F.round(tx.timecode(code), 3).alias("seconds"), tx.clock_label(F.col("value")).alias("clock"), tx.confidence_label(F.col("value") / 100).alias("label"))


F11 = """SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN (event_id % 60) * 60 + event_id % 59 + (event_id % 1000) / 1000.0 WHEN 1 THEN value ELSE (event_id % 5) * 3600 + (event_id % 60) * 60 + event_id % 59 END, 3) AS seconds,
  CAST(floor(value / 60) AS BIGINT)::VARCHAR || ':' || lpad(CAST(floor(value % 60) AS BIGINT)::VARCHAR, 2, '0') AS clock,
  CASE WHEN value / 100 >= 0.78 THEN 'high' WHEN value / 100 >= 0.55 THEN 'medium' ELSE 'low' END AS label FROM events"""


def f13_f15_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d, s = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size").cast("double")), F.col("p_retailprice") / 100
    w, h = F.col("p_size") * 40, (F.col("p_partkey") % 30).cast("int") * 64
    size = num.output_size(w, h, 1080)
    return p.select(
        "p_partkey",
        F.round(num.duration_fit(d, s), 6).alias("fit"),
        F.round(num.provider_duration_score(d, s), 6).alias("duration"),
        num.orientation_score(w, h).alias("orientation"),
        F.round(num.resolution_score(w, h), 6).alias("resolution"),
        size["width"].alias("width"),
        size["height"].alias("height"),
        num.looked_up(F.lower("p_brand").substr(1, 3), num.CRF, 25).alias("crf"),
        F.array_join(F.transform(num.tempo_chain(F.col("p_size") / 6.0), lambda x: F.format_string("%.4f", x)), ",").alias("tempo"),
        F.round(F.aggregate(num.tempo_chain(F.col("p_size") / 6.0), F.lit(1.0), lambda a, x: a * x), 4).alias("speed"),
    ).drop("tempo")


F13 = """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_size::DOUBLE END AS d, p_retailprice / 100 AS s, p_size * 40 AS w, CAST((p_partkey % 30) * 64 AS INT) AS h, p_size FROM part),
q AS (SELECT *, greatest(s, 0.6) AS b, greatest(s, 0.8) AS c, 1080.0 / least(greatest(w, 2), greatest(h, 2)) AS k FROM p)
SELECT p_partkey, round(CASE WHEN d IS NULL OR d <= 0 THEN 0.45 ELSE 0.25 + 0.75 * greatest(0.0, least(1.0, 1 - abs(d - b) / greatest(b * 2.2, 1.0))) END, 6) AS fit,
  round(CASE WHEN d IS NULL OR d <= 0 THEN 0.08 ELSE 0.06 + 0.14 * greatest(0.0, least(1.0, 1 - abs(d - c) / greatest(c * 2.0, 1.0))) END, 6) AS duration,
  CAST(CASE WHEN w <= 0 OR h <= 0 THEN 0.03 WHEN h >= w THEN 0.09 ELSE 0.05 END AS DOUBLE) AS orientation,
  round(CASE WHEN w <= 0 OR h <= 0 THEN 0.03 ELSE 0.03 + 0.07 * least(1.0, w * h / (1920.0 * 1080.0)::DOUBLE) END, 6)::DOUBLE AS resolution,
  CAST(round_even(greatest(w, 2) * k, 0) AS INT) + CAST(round_even(greatest(w, 2) * k, 0) AS INT) % 2 AS width, CAST(round_even(greatest(h, 2) * k, 0) AS INT) + CAST(round_even(greatest(h, 2) * k, 0) AS INT) % 2 AS height,
  25 AS crf, round(greatest(p_size / 6.0, 0.01), 4)::DOUBLE AS speed FROM q"""


def f17_cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rk.nearest_vectors(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding"), e.select("vec_id", "embedding"), 5)


F17 = """WITH p AS (SELECT a.vec_id AS q_id, b.vec_id, round(greatest(0.0, least(1.0, (list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2)), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT q_id, vec_id, cosine, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""


def _slots(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_size").alias("project_id"), F.col("p_partkey").alias("slot_id"), F.split(F.lower("p_name"), " ").alias("concepts"), (F.col("p_partkey") % 40).cast("double").alias("slot_sec"), (F.col("p_partkey") - 7).alias("own_asset"))


def _assets(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("project_id"), F.col("p_partkey").alias("asset_id"), F.concat("p_name", F.lit("_"), "p_type", F.lit(".mp4")).alias("filename"), (F.col("p_retailprice") - 880).alias("duration_sec"), F.col("p_retailprice").alias("created_at"))


LOCAL = """slots AS (SELECT p_size AS project_id, p_partkey AS slot_id, string_split(lower(p_name), ' ') AS concepts, (p_partkey % 40)::DOUBLE AS slot_sec, p_partkey - 7 AS own_asset FROM part),
assets AS (SELECT p_size AS project_id, p_partkey AS asset_id, p_name || '_' || p_type || '.mp4' AS filename, p_retailprice - 880 AS duration_sec, p_retailprice AS created_at FROM part),
placed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, asset_id DESC) - 1 AS place, count(*) OVER (PARTITION BY project_id) AS total, list_transform(regexp_extract_all(filename, '[A-Za-z0-9'']+'), lambda t: lower(t)) AS terms FROM assets),
scored AS (SELECT slot_id, asset_id, place, duration_sec, least(1.0, round(0.20::DOUBLE + least(len(list_filter(concepts, lambda t: list_contains(terms, t)))::DOUBLE / greatest(len(concepts), 1) * 0.45, 0.45) + CASE WHEN asset_id = own_asset THEN 0.06 ELSE 0.18 END::DOUBLE
  + CASE WHEN duration_sec > 0 AND duration_sec >= greatest(slot_sec, 1.0) THEN 0.12 ELSE 0.05 END::DOUBLE + (1 - place::DOUBLE / greatest(total, 1)) * 0.15, 3)) AS score FROM slots JOIN placed USING (project_id)),
local AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY score DESC, place) AS rank FROM scored)"""


def r1_local_scores(spark, sf_dir):
    return rk.local_scores(_slots(spark, sf_dir), _assets(spark, sf_dir)).select("slot_id", "asset_id", "score", "rank")


def _external(spark, sf_dir):
    """Eight hits a slot. Slots are dealt before their hits are made, which then aren't shuffled: a file of few bytes is one
    task's, and holds many slots."""
    hits = dealt(_slots(spark, sf_dir).select("slot_id", "slot_sec"), "slot_id", rows=TASK_SLOTS).select("slot_id", "slot_sec", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("place"))
    x = F.col("slot_id") + F.col("place") * 31
    return hits.select("slot_id", "slot_sec", "place", F.lit(8).alias("total"), F.concat(F.lit("https://v.example.com/"), (x % 900).cast("string")).alias("url"), (x % 45).cast("double").alias("duration_sec"), (x % 2000).cast("int").alias("width"), (x % 1700).cast("int").alias("height"))


#: slots of a task that holds their hits
TASK_SLOTS = 12_500

EXT = """hits AS (SELECT slot_id, slot_sec, place, slot_id + place * 31 AS x FROM slots, (SELECT unnest(range(0, 8))::INT AS place)),
ext0 AS (SELECT slot_id, place, 'https://v.example.com/' || (x % 900)::VARCHAR AS url, round(greatest(0.0, least(0.99, 0.42::DOUBLE
  + CASE WHEN x % 45 <= 0 THEN 0.08 ELSE 0.06 + 0.14 * greatest(0.0, least(1.0, 1 - abs((x % 45)::DOUBLE - greatest(slot_sec, 0.8)) / greatest(greatest(slot_sec, 0.8) * 2.0, 1.0))) END
  + CASE WHEN x % 2000 = 0 OR x % 1700 = 0 THEN 0.03 WHEN x % 1700 >= x % 2000 THEN 0.09 ELSE 0.05 END::DOUBLE
  + CASE WHEN x % 2000 = 0 OR x % 1700 = 0 THEN 0.03 ELSE 0.03 + 0.07 * greatest(0.0, least(1.0, (x % 2000) * (x % 1700) / (1920.0 * 1080.0)::DOUBLE)) END
  + greatest(0.0, least(0.12, (1 - place::DOUBLE / 8) * 0.12)))) + 1e-9, 3) AS score FROM hits),
ext1 AS (SELECT *, row_number() OVER (PARTITION BY slot_id, url ORDER BY score DESC, place) AS again FROM ext0),
ext AS (SELECT slot_id, url, score, row_number() OVER (PARTITION BY slot_id ORDER BY score DESC, place, url) AS rank FROM ext1 WHERE again = 1)"""


def r6_provider_scores(spark, sf_dir):
    return rk.provider_scores(_external(spark, sf_dir), 0.42, 5, dealt_by_slot=True).select("slot_id", "url", "score", "rank")


def l3_mixed(spark, sf_dir):
    local = rk.local_scores(_slots(spark, sf_dir), _assets(spark, sf_dir), 6).withColumn("url", F.lit(None).cast("string"))
    external = rk.provider_scores(_external(spark, sf_dir).filter("slot_id % 3 <> 0"), 0.42, 6, dealt_by_slot=True).withColumn("asset_id", F.lit(None).cast("bigint"))
    return rk.mixed(local, external, 5)


L3 = f"""WITH {LOCAL}, {EXT}, r AS (
  SELECT slot_id, asset_id, NULL::VARCHAR AS url, score, rank, 0 AS source FROM local WHERE rank <= 6 UNION ALL SELECT slot_id, NULL, url, score, rank, 1 FROM ext WHERE rank <= 6 AND slot_id % 3 <> 0),
b AS (SELECT *, min(source) OVER (PARTITION BY slot_id) = 0 AND max(source) OVER (PARTITION BY slot_id) = 1 AS two FROM r),
c AS (SELECT *, rank <= CASE WHEN NOT two THEN 5 WHEN source = 0 THEN 2 ELSE 3 END AS chosen FROM b),
d AS (SELECT *, count(*) FILTER (chosen) OVER (PARTITION BY slot_id) AS nc, row_number() OVER (PARTITION BY slot_id, chosen ORDER BY score DESC, source, rank) AS spare FROM c)
SELECT slot_id, CAST(row_number() OVER (PARTITION BY slot_id ORDER BY score DESC, chosen DESC, source, rank) AS INT) AS rank, source, asset_id, url, score FROM d WHERE chosen OR spare <= 5 - nc QUALIFY row_number() OVER (PARTITION BY slot_id ORDER BY score DESC, chosen DESC, source, rank) <= 5"""


def _candidates(spark, sf_dir):
    """Documents as candidates of conversations' first turns; those of no conversation have an empty slot."""
    slots = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("slot_id"), F.col("text").alias("slot_text"))
    slots = tx.with_concepts(slots, "slot_text").select("slot_id", "slot_text", tx.concept_text(F.col("concepts")).alias("concept"), "concepts", (F.col("slot_id") % 12 + 1.5).alias("slot_sec"))
    d = docs(spark, sf_dir).select((F.col("doc_id") % 100).alias("slot_id"), F.col("doc_id").alias("candidate_id"), "text", ((F.col("doc_id") * 7 % 100) / 100.0).alias("base"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 30).cast("double")).alias("duration_sec"))
    rows = d.join(slots, "slot_id", "left").withColumns({"slot_text": F.coalesce("slot_text", F.lit("")), "concept": F.coalesce("concept", F.lit("general scene")), "concepts": F.coalesce("concepts", F.array(F.lit("general"))), "slot_sec": F.coalesce("slot_sec", F.lit(1.5))})
    return rows.withColumn("keyword_hits", F.filter("concepts", lambda t: F.contains(F.lower("text"), t)))


TOKENS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9'']+'), lambda t: lower(t))"
#: runs of capitalised words; letters beyond ASCII are letters, which the pattern's word boundaries don't know there
CAPITALS = r"list_filter(regexp_extract_all(regexp_replace({}, '[À-ÖØ-öø-ÿ]', '1', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}})\b', 1), lambda x: length(trim(x)) >= 3)"
ONCE = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)[1:{1}]"
CONCEPTS = f"""b AS (SELECT conv_id, turn, text, {TOKENS.format("text")} AS ts FROM conversations),
u AS (SELECT conv_id, turn, text, ts, list_filter(ts, lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t)) AS fs FROM b),
v AS (SELECT conv_id, turn, text, ts, CASE WHEN len(fs) > 0 THEN fs ELSE ts[1:3] END AS us FROM u),
e AS (SELECT conv_id, turn, unnest(us) AS t, unnest(range(0, len(us))) AS p FROM v), c AS (SELECT conv_id, turn, t, count(*) AS n, min(p) AS first FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first) AS k FROM c), g AS (SELECT conv_id, turn, list(t ORDER BY k) AS cs FROM r WHERE k <= 4 GROUP BY ALL),
k AS (SELECT v.conv_id, v.turn, v.text, v.ts, coalesce(g.cs, ['general']) AS cs, coalesce(array_to_string(g.cs, ' '), 'general scene') AS concept FROM v LEFT JOIN g ON g.conv_id = v.conv_id AND g.turn = v.turn)"""

F2 = f"""WITH e AS (SELECT doc_id, {CAPITALS.format("text")} AS es FROM documents) SELECT doc_id, array_to_string({ONCE.format("es", 8)}, '|') AS entities FROM e"""

F4 = f"""WITH {CONCEPTS}, n AS (SELECT *, {CAPITALS.format("text")} AS es FROM k), m AS (SELECT *, {ONCE.format("es", 8)}[1:3] AS named FROM n),
q AS (SELECT conv_id, turn, list_filter(list_transform(list_concat([concept, array_to_string(cs[1:3], ' ')], flatten(list_transform(named, lambda x: [x, x || ' ' || array_to_string(cs[1:2], ' ')])), [array_to_string(ts[1:4], ' ')]), lambda x: trim(x)), lambda x: x <> '') AS a FROM m)
SELECT conv_id, turn, array_to_string({ONCE.format("a", 6)}, '|') AS queries FROM q"""


def r2_reranked(spark, sf_dir):
    return rk.reranked(_candidates(spark, sf_dir)).select("slot_id", "candidate_id", "score", "confidence", F.array_join("hits", "|").alias("hits"))


def r2_reranked_by_vectors(spark, sf_dir):
    """Rows without a vector have no meaning to compare."""
    e = table(spark, sf_dir, "embeddings")
    c = _candidates(spark, sf_dir).join(e.select(F.col("vec_id").alias("slot_id"), F.col("embedding").alias("slot_vec")), "slot_id", "left").join(e.select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("vec")), "candidate_id", "left")
    return rk.reranked(c, vectors=True).select("slot_id", "candidate_id", "score", "confidence")


def _r2(vectors: bool) -> str:
    """The re-ranking rule step by step; vectors say what compares meanings."""
    overlap = lambda a, b: f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"
    meaning = "CASE WHEN sv.embedding IS NULL OR dv.embedding IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (list_dot_product(sv.embedding::DOUBLE[], dv.embedding::DOUBLE[]) + 1) / 2)) END" if vectors else overlap("st", "ct")
    joins = " LEFT JOIN embeddings sv ON sv.vec_id = slot_id LEFT JOIN embeddings dv ON dv.vec_id = candidate_id" if vectors else ""
    sure = "0.45 * f + 0.25 * sem + 0.20 * ent + 0.10 * meta"
    sure = f"greatest(0.0, least(1.0, {sure}))" if vectors else f"greatest(0.0, least(1.0, greatest(0.0, least(1.0, {sure})) * 0.92))"
    return f"""WITH {CONCEPTS}, slots AS (SELECT conv_id AS slot_id, text AS slot_text, cs, concept, conv_id % 12 + 1.5::DOUBLE AS slot_sec, {CAPITALS.format("text")} AS es FROM k WHERE turn = 0),
s AS (SELECT *, {ONCE.format("es", 8)} AS se FROM slots),
d AS (SELECT doc_id % 100 AS slot_id, doc_id AS candidate_id, coalesce(text, '') AS text, (doc_id * 7 % 100) / 100.0::DOUBLE AS base, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 30)::DOUBLE END AS dur, {CAPITALS.format("coalesce(text, '')")} AS es, list_distinct({TOKENS.format("coalesce(text, '')")}) AS ct FROM documents),
p AS (SELECT d.slot_id, candidate_id, text, lower(text) AS low, base, dur, ct, coalesce(cs, ['general']) AS cs, coalesce(slot_sec, 1.5::DOUBLE) AS slot_sec, coalesce(se, []::VARCHAR[]) AS se, {ONCE.format("d.es", 8)} AS ce,
  list_distinct({TOKENS.format("coalesce(slot_text, '') || ' ' || coalesce(concept, 'general scene') || ' ' || array_to_string(coalesce(cs, ['general']), ' ') || ' ' || array_to_string(coalesce(se, []::VARCHAR[]), ' ')")}) AS st FROM d LEFT JOIN s ON s.slot_id = d.slot_id),
h AS (SELECT *, list_filter(ce, lambda x: list_contains(list_transform(se, lambda y: lower(y)), lower(x))) AS own, list_filter(cs, lambda t: contains(low, t)) AS kw, least(greatest(base, 0.0), 0.99) AS b, greatest(slot_sec, 0.6) AS w FROM p),
i AS (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE list_filter(se, lambda x: contains(low, lower(x))) END AS hits FROM h),
j AS (SELECT *, {meaning} AS sem, CASE WHEN len(se) > 0 THEN len(list_distinct(list_transform(hits, lambda x: lower(x))))::DOUBLE / len(se) ELSE 0.0 END AS ent,
  greatest(0.0, least(1.0, 0.5 * ({overlap("list_distinct(cs)", "ct")}) + 0.2 * (CASE WHEN len(cs) > 0 THEN least(len(kw), len(cs))::DOUBLE / len(cs) ELSE 0.0 END) + 0.3 * b)) AS meta,
  CASE WHEN dur IS NULL OR dur <= 0 THEN 0.45 ELSE 0.25 + 0.75 * greatest(0.0, least(1.0, 1 - abs(dur - w) / greatest(w * 2.2, 1.0))) END AS fit FROM i{joins}),
l AS (SELECT *, greatest(0.0, least(0.99, 0.75 * (0.55 * sem + 0.20 * ent + 0.15 * meta + 0.10 * fit) + 0.25 * b)) AS f FROM j)
SELECT slot_id, candidate_id, round(f + 1e-9, 3) AS score, round({sure} + 1e-9, 3) AS confidence{"" if vectors else ", array_to_string(hits[1:8], '|') AS hits"} FROM l"""


def r4_l4_picks(spark, sf_dir):
    return rk.picked(rk.not_reranked(_candidates(spark, sf_dir)))


L4 = """WITH c AS (SELECT doc_id % 100 AS slot_id, doc_id AS candidate_id, round(least(0.99, (doc_id * 7 % 100) / 100.0), 3) AS s FROM documents)
SELECT slot_id, coalesce(arg_max(candidate_id, row(s, -candidate_id)) FILTER (s >= 0.78), arg_max(candidate_id, row(s, -candidate_id))) AS candidate_id, count(*) FILTER (s >= 0.78) > 0 AS confident FROM c GROUP BY slot_id"""


def j11_not_shown(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("slot_id"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")).alias("asset_id"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("u"), (F.col("l_partkey") % 500).cast("string"))).alias("url"), "l_returnflag").distinct()
    return rk.not_shown(c.filter("l_returnflag = 'R'"), c.filter("l_returnflag = 'A'")).select("slot_id", "asset_id", "url")


J11 = """WITH c AS (SELECT DISTINCT l_suppkey AS slot_id, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END AS asset_id, CASE WHEN l_partkey % 3 = 0 THEN 'u' || (l_partkey % 500)::VARCHAR END AS url, l_returnflag FROM lineitem)
SELECT slot_id, asset_id, url FROM c WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM c s WHERE s.l_returnflag = 'A' AND s.slot_id = c.slot_id AND s.asset_id = c.asset_id) AND NOT EXISTS (SELECT 1 FROM c s WHERE s.l_returnflag = 'A' AND s.slot_id = c.slot_id AND s.url = c.url)"""


def j3_nested(spark, sf_dir):
    slots = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slot_id"))
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("slot_id"), F.col("l_partkey").alias("candidate_id")).agg(F.max("l_extendedprice").alias("score"))
    return rk.nested_candidates(slots, c).select("slot_id", F.array_join("candidates", ",").alias("candidates"))


J3 = """WITH c AS (SELECT l_suppkey AS slot_id, l_partkey AS candidate_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2)
SELECT s_suppkey AS slot_id, coalesce((SELECT string_agg(candidate_id::VARCHAR, ',' ORDER BY score DESC, candidate_id) FROM c WHERE c.slot_id = s_suppkey), '') AS candidates FROM supplier"""


def l6_best_rendition(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 2, F.concat(F.lit("r"), F.col("l_partkey").cast("string"))).alias("link"), (F.col("l_quantity") * 40).cast("int").alias("width"), (F.col("l_suppkey") % 50 * 40).cast("int").alias("height"))
    return rk.best_rendition(r, "l_orderkey")


L6 = """WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber <> 2 THEN 'r' || l_partkey::VARCHAR END AS link, CAST(l_quantity * 40 AS INT) AS width, CAST(l_suppkey % 50 * 40 AS INT) AS height FROM lineitem)
SELECT l_orderkey, b[1] AS link, b[2] AS width, b[3] AS height FROM (SELECT l_orderkey, arg_max(row(link, width, height), row(width * height + CASE WHEN height >= width THEN 200000 ELSE 0 END, link)) AS b FROM r WHERE link IS NOT NULL GROUP BY l_orderkey)"""


def a10_hit_rates(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("sample_id"), F.col("doc_id").alias("candidate_id"), (F.col("quality") == 1).alias("positive"), ((F.col("doc_id") * 13) % 101).alias("base"), ((F.col("doc_id") * 29) % 97).alias("again"))
    a = rk.hit_rates(d, F.desc("base")).select("samples", F.col("top1").alias("base_top1"), F.col("top3").alias("base_top3"))
    return a.crossJoin(rk.hit_rates(d, F.desc("again")).select(F.col("top1").alias("rerank_top1"), F.col("top3").alias("rerank_top3")))


A10 = """WITH d AS (SELECT doc_id % 40 AS sample_id, doc_id AS c, quality = 1 AS p, doc_id * 13 % 101 AS b, doc_id * 29 % 97 AS g FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY b DESC, c) AS rb, row_number() OVER (PARTITION BY sample_id ORDER BY g DESC, c) AS rg FROM d),
e AS (SELECT sample_id, max((p AND rb <= 1)::INT) AS b1, max((p AND rb <= 3)::INT) AS b3, max((p AND rg <= 1)::INT) AS g1, max((p AND rg <= 3)::INT) AS g3 FROM r GROUP BY sample_id)
SELECT count(*) AS samples, round(avg(b1), 6) AS base_top1, round(avg(b3), 6) AS base_top3, round(avg(g1), 6) AS rerank_top1, round(avg(g3), 6) AS rerank_top3 FROM e"""

QUERIES = {
    "f1_tokens": (f1_tokens, F1),
    "a6_concepts": (a6_concepts, A6),
    "a6_concept_function": (a6_concept_function, A6F),
    "f2_d1_entities": (f2_entities, F2),
    "f4_expanded_queries": (f4_queries, F4),
    "f5_search_queries": (f5_search_queries, F5),
    "p3_p5_p6_p7_words": (p3_p5_p6_p7_words, P5),
    "p7_indexed_search": (p7_indexed_search, P7),
    "p9_p10_blocked_and_latin": (p9_p10_blocked_and_latin, P9),
    "p9_blocked_by_long_list": (p9_blocked_by_long_list, P9_LONG),
    "f11_f12_p13_times": (f11_f12_times, F11),
    "f13_f20_scores": (f13_f15_scores, F13),
    "f17_l2_cosine_topk": (f17_cosine_topk, F17),
    "r1_j12_local_scores": (r1_local_scores, f"WITH {LOCAL} SELECT slot_id, asset_id, score, CAST(rank AS INT) AS rank FROM local WHERE rank <= 4"),
    "r6_d2_w21_provider_scores": (r6_provider_scores, f"WITH {LOCAL}, {EXT} SELECT slot_id, url, score, CAST(rank AS INT) AS rank FROM ext WHERE rank <= 5"),
    "l3_d3_mixed": (l3_mixed, L3),
    "r2_r3_reranked": (r2_reranked, _r2(False)),
    "r2_reranked_by_vectors": (r2_reranked_by_vectors, _r2(True)),
    "r4_l4_picks": (r4_l4_picks, L4),
    "j11_not_shown": (j11_not_shown, J11),
    "j3_nested_candidates": (j3_nested, J3),
    "l6_best_rendition": (l6_best_rendition, L6),
    "a10_hit_rates": (a10_hit_rates, A10),
}
