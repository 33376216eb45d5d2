"""Candidate ranking: local and provider scores, mixing by quota, re-ranking, per-group picks, deduplication, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as num
from tessera.functions import text as tx
from tessera.sources.stored import dealt, written


def top_per_group(rows: DataFrame, group: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group, with rank (from 1). The order should end in a unique column."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def best_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each value of keys, the first by order; rows with a null key stay. By an aggregate, so a hot key is
    reduced where its rows are."""
    rest = rows.filter(" or ".join(f"{k} is null" for k in keys))
    whole = rows.filter(" and ".join(f"{k} is not null" for k in keys))
    one = whole.groupBy(*keys).agg(F.min_by(F.struct(*whole.columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r"))
    return one.select("_r.*").unionByName(rest)


#: slots of more concepts, and assets of more terms that some concept names, are compared pair by pair
CONCEPTS, TERMS = 4, 10
#: up to so many projects with assets, which are counted, are told to all tasks
PROJECTS = 10_000


def local_scores(slots: DataFrame, assets: DataFrame, k: int = 4) -> DataFrame:
    """The k best assets of a slot's project: slots have project_id, slot_id, concepts, slot_sec and own_asset; assets
    project_id, asset_id, filename, duration_sec and created_at. Newer assets score higher; ties keep that order.

    Slots of a project that have the same concepts and length score its assets alike, but for their own, which score less:
    so the k + 1 best are looked for once for each such kind of slot, and a slot's k best are among them. Only pairs that
    can be among these are formed (see _promising), so the work grows with the slots and the assets, not with their
    product. Slots of projects without assets have none, and are left out first. Joins are by shuffling, as files of few
    bytes may hold many rows."""
    project = Window.partitionBy("project_id")
    newest = project.orderBy(F.desc("created_at"), F.desc("asset_id"))
    sizes = written(assets.groupBy("project_id").agg(F.count("*").alias("total")))
    there = sizes.select("project_id")
    slots = slots.join(F.broadcast(there) if sizes.count() <= PROJECTS else there.hint("merge"), "project_id", "left_semi")
    placed = assets.withColumns({"place": F.row_number().over(newest) - 1, "terms": F.array_distinct(tx.tokens(F.col("filename")))}).join(sizes, "project_id")
    placed = written(placed.select("project_id", "asset_id", "filename", "duration_sec", "place", "total", "terms"))
    known = slots.select("project_id", "slot_id", "own_asset", "concepts", F.coalesce("concepts", F.array().cast("array<string>")).alias("c"), F.coalesce("slot_sec", F.lit(1.0)).alias("sec"))
    kinds = written(known.select("project_id", "c", "sec").distinct().withColumn("kind", F.monotonically_increasing_id()))

    def score(diverse: Column | float) -> Column:
        semantic = F.when(F.size("c") > 0, F.least(F.size("hits") / F.greatest(F.size("c"), F.lit(1)) * 0.45, F.lit(0.45))).otherwise(0.0)
        long = F.when((F.col("duration_sec") > 0) & (F.col("duration_sec") >= F.greatest("sec", F.lit(1.0))), 0.12).otherwise(0.05)
        recent = (1 - F.col("place") / F.greatest("total", F.lit(1))) * 0.15
        return num.clamp(F.round(0.20 + semantic + (F.lit(diverse) if isinstance(diverse, float) else diverse) + long + recent, 3))

    as_slots = kinds.select("project_id", F.col("kind").alias("slot_id"), F.col("c").alias("concepts"), F.col("sec").alias("slot_sec"))
    pairs = _promising(as_slots, placed, k).withColumnRenamed("slot_id", "kind").join(placed.hint("merge"), ["project_id", "asset_id"]).join(kinds.hint("merge"), ["project_id", "kind"])
    pairs = pairs.withColumn("hits", F.filter("c", lambda t: F.array_contains(F.col("terms"), t))).drop("terms").withColumn("alike", score(0.18))
    best = top_per_group(pairs, ["kind"], k + 1, [F.desc("alike"), F.col("place")]).drop("rank", "alike", "c", "sec")
    mine = known.join(kinds.hint("merge"), ["project_id", "c", "sec"]).join(best.hint("merge"), ["project_id", "kind"])
    scored = mine.withColumn("score", score(F.when(F.col("asset_id").eqNullSafe(F.col("own_asset")), 0.06).otherwise(0.18)))
    scored = scored.withColumn("hits", F.when(F.col("concepts").isNotNull(), F.col("hits")))
    return top_per_group(scored, ["slot_id"], k, [F.desc("score"), F.col("place")]).select("slot_id", "asset_id", "filename", "duration_sec", "hits", "score", "rank")


def _longest_yet(rows: DataFrame, by: list[str], layers: int) -> DataFrame:
    """rows (place, duration_sec) without those that layers or more others of their group beat, by an earlier place and a
    duration that isn't shorter. Rows longer than all before them are the first layer, those longer than all others before
    them the second, and so on: a row beyond the last one is beaten by one of each layer."""
    line = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_left": F.lit(True), "_most": F.lit(None).cast("double")})
    for _ in range(layers):
        rows = rows.withColumn("_most", F.max(F.when(F.col("_left"), F.col("duration_sec"))).over(line))
        rows = rows.withColumn("_left", F.col("_left") & F.coalesce(F.col("duration_sec") <= F.col("_most"), F.lit(False)))
    return rows.filter("not _left").drop("_left", "_most")


def _promising(slots: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(project_id, slot_id, asset_id), with every asset that may be among a slot's k best.

    Take the assets that have all terms of a set S of a slot's concepts, and among them those that are long enough for
    the slot. One that hits just S scores no more than those before it in place, but for the slot's own asset: so it
    is among the first k + 1 of them, or of all that have S if it is too short. These lists are made once for each
    project and set, and class of length, whatever the number of slots. Within the slot's own class they are among the
    assets that less than k + 1 earlier ones equal in length (see _longest_yet): some (k + 1) log n of n."""
    length = lambda seconds: F.floor(8 * F.log2(F.greatest(seconds, F.lit(1.0)))).cast("int")
    sets = lambda items, most: F.filter(F.transform(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(items)) - 1), lambda b: F.filter(items, lambda x, i: F.call_function("shiftright", b, i).bitwiseAND(F.lit(1)) == 1)), lambda s: F.size(s) <= most)
    known = slots.select("project_id", "slot_id", F.array_sort(F.array_distinct(F.coalesce("concepts", F.array().cast("array<string>")))).alias("c"), F.coalesce("slot_sec", F.lit(1.0)).alias("sec"), length(F.coalesce("slot_sec", F.lit(1.0))).alias("class"))
    few, many = known.filter(F.size("c") <= CONCEPTS), known.filter(F.size("c") > CONCEPTS)
    wanted = few.select("project_id", "slot_id", "sec", "class", F.explode(sets(F.col("c"), CONCEPTS)).alias("s")).withColumn("s", F.concat_ws("\x01", "s"))
    named = known.select("project_id", F.explode("c").alias("term")).distinct()
    base = placed.select("project_id", "asset_id", "place", "duration_sec", length(F.col("duration_sec")).alias("long"), (F.col("duration_sec") > 0).alias("timed"), "terms")
    terms = base.select("project_id", "asset_id", F.explode("terms").alias("term")).join(named.hint("merge"), ["project_id", "term"]).groupBy("project_id", "asset_id").agg(F.array_sort(F.collect_set("term")).alias("t"))
    base = base.drop("terms").join(terms.hint("merge"), ["project_id", "asset_id"], "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    lists = base.filter(F.size("t") <= TERMS).select("project_id", "asset_id", "place", "timed", "duration_sec", "long", F.explode(sets(F.col("t"), CONCEPTS)).alias("s")).withColumn("s", F.concat_ws("\x01", "s"))
    lists = written(lists.join(wanted.select("project_id", "s").distinct().hint("merge"), ["project_id", "s"]))
    first = lambda rows, *by: top_per_group(rows, ["project_id", "s", *by], k + 1, [F.col("place")]).drop("rank")
    any_length = wanted.join(first(lists).select("project_id", "s", "asset_id").hint("merge"), ["project_id", "s"])
    timed = lists.filter("timed")
    classes = wanted.select("project_id", "s", "class").distinct()
    longer = first(classes.join(first(timed, "long").hint("merge"), ["project_id", "s"]).filter(F.col("long") > F.col("class")), "class").select("project_id", "s", "class", "asset_id")
    alike = _longest_yet(timed, ["project_id", "s", "long"], k + 1).select("project_id", "s", F.col("long").alias("class"), "asset_id", "duration_sec")
    at_least = F.col("duration_sec") >= F.greatest("sec", F.lit(1.0))
    by_length = wanted.join(longer.withColumn("duration_sec", F.lit(float("inf"))).unionByName(alike).hint("merge"), ["project_id", "s", "class"]).filter(at_least)
    out = any_length.select("project_id", "slot_id", "asset_id").union(by_length.select("project_id", "slot_id", "asset_id"))
    out = out.union(many.join(base, "project_id").select("project_id", "slot_id", "asset_id")).union(few.join(base.filter(F.size("t") > TERMS), "project_id").select("project_id", "slot_id", "asset_id"))
    return out.distinct()


def provider_scores(hits: DataFrame, base: float, limit: int, dealt_by_slot: bool = False) -> DataFrame:
    """Scores of provider hits (slot_id, url, place, total, duration_sec, width, height, slot_sec), each URL once, and
    the limit best of a slot. Hits are dealt by slot_id unless they were."""
    size = num.orientation_score(F.col("width"), F.col("height")) + num.resolution_score(F.col("width"), F.col("height"))
    score = F.round(num.clamp(base + num.provider_duration_score(F.col("duration_sec"), F.col("slot_sec")) + size + num.rank_bonus(F.col("place"), F.col("total")), 0.0, 0.99) + 1e-9, 3)
    hits = hits.withColumn("score", score)
    if dealt_by_slot:
        # windows keep to the tasks that slots are dealt to; behind a union is another exchange, coalesced by its bytes
        again = F.row_number().over(Window.partitionBy("slot_id", "url").orderBy(-F.col("score"), F.col("place")))
        scored = hits.withColumn("_again", again).filter("_again = 1 or slot_id is null or url is null").drop("_again")
    else:
        scored = best_of_each(dealt(hits, "slot_id"), ["slot_id", "url"], [-F.col("score"), F.col("place")])
    return top_per_group(scored, ["slot_id"], limit, [F.desc("score"), F.col("place"), F.col("url")])


def mixed(local: DataFrame, external: DataFrame, limit: int, *kept: str) -> DataFrame:
    """Candidates of a slot from both sources: half of limit local (one at least) and the rest external where there
    are both, filled up with the best left over; then by score, each asset and each URL once, limit at most. Both
    have slot_id, asset_id, url, score and rank (from 1), and what else is kept."""
    columns = ["slot_id", "asset_id", "url", "score", "rank", *kept]
    rows = local.select(*columns, F.lit(0).alias("source")).unionByName(external.select(*columns, F.lit(1).alias("source")))
    slot = Window.partitionBy("slot_id")
    both = (F.min("source").over(slot) == 0) & (F.max("source").over(slot) == 1)
    of_local = F.when(both, max(1, limit // 2)).otherwise(limit)
    of_external = F.when(both, max(1, limit - max(1, limit // 2))).otherwise(limit)
    rows = rows.withColumn("chosen", F.col("rank") <= F.when(F.col("source") == 0, of_local).otherwise(of_external))
    rows = rows.withColumn("n_chosen", F.count_if("chosen").over(slot))
    spare = F.row_number().over(Window.partitionBy("slot_id", "chosen").orderBy(F.desc("score"), "source", "rank"))
    rows = rows.withColumn("spare", spare).filter(F.col("chosen") | (F.col("spare") <= limit - F.col("n_chosen")))
    order = [F.desc("score"), F.desc("chosen"), F.col("source"), F.col("rank")]
    for column in ("asset_id", "url"):
        again = F.row_number().over(Window.partitionBy("slot_id", column).orderBy(*order))
        rows = rows.withColumn("again", F.when(F.col(column).isNull(), 1).otherwise(again)).filter("again = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("slot_id").orderBy(*order))).filter(F.col("place") <= limit)
    return rows.select("slot_id", F.col("place").alias("rank"), "source", "asset_id", "url", "score", *kept)


def reranked(rows: DataFrame, weights: tuple[float, float, float, float] = (0.55, 0.20, 0.15, 0.10), vectors: bool = False) -> DataFrame:
    """Adds score, confidence and hits to candidates: slot_text, concept, concepts, slot_sec, text, base, keyword_hits
    and duration_sec, and with vectors slot_vec and vec, by which meaning is compared instead of by words."""
    w = num.normalised(list(weights))
    rows = rows.withColumn("_se", tx.entities(F.col("slot_text")))
    slot_tokens = tx.tokens(F.concat_ws(" ", "slot_text", "concept", F.array_join("concepts", " "), F.array_join("_se", " ")))
    rows = rows.withColumn("_st", F.array_distinct(slot_tokens))
    rows = rows.withColumns({"_ct": F.array_distinct(tx.tokens(F.col("text"))), "_ce": tx.entities(F.col("text"))})
    semantic = num.unit_cosine(F.col("slot_vec"), F.col("vec")) if vectors else tx.token_overlap(F.col("_st"), F.col("_ct"))
    rows = rows.withColumns({"_sl": F.transform("_se", lambda e: F.lower(e)), "_low": F.lower("text")})
    own = F.filter("_ce", lambda e: F.array_contains(F.col("_sl"), F.lower(e)))
    hits = F.when(F.size(own) > 0, own).otherwise(F.filter("_se", lambda e: F.contains(F.col("_low"), F.lower(e))))
    rows = rows.withColumns({"hits": hits, "_sem": semantic, "_base": num.clamp(F.col("base"), 0.0, 0.99)})
    entity = F.when(F.size("_se") > 0, F.size(F.array_distinct(F.transform("hits", lambda e: F.lower(e)))) / F.greatest(F.size("_se"), F.lit(1))).otherwise(0.0)
    n = F.greatest(F.size("concepts"), F.lit(1))
    keywords = F.when(F.size("concepts") > 0, F.least(F.coalesce(F.size("keyword_hits"), F.lit(0)), n) / n).otherwise(0.0)
    metadata = num.clamp(0.5 * tx.token_overlap(F.transform("concepts", lambda t: F.lower(t)), F.col("_ct")) + 0.2 * keywords + 0.3 * F.col("_base"))
    rows = rows.withColumns({"_ent": entity, "_meta": metadata, "_dur": num.duration_fit(F.col("duration_sec"), F.col("slot_sec"))})
    weighted = w[0] * F.col("_sem") + w[1] * F.col("_ent") + w[2] * F.col("_meta") + w[3] * F.col("_dur")
    rows = rows.withColumn("_final", num.clamp(0.75 * weighted + 0.25 * F.col("_base"), 0.0, 0.99))
    sure = num.clamp(0.45 * F.col("_final") + 0.25 * F.col("_sem") + 0.20 * F.col("_ent") + 0.10 * F.col("_meta"))
    sure = sure if vectors else num.clamp(sure * 0.92)
    return rows.withColumns({"score": F.round(F.col("_final") + 1e-9, 3), "confidence": F.round(sure + 1e-9, 3), "hits": F.slice("hits", 1, 8)}).drop("_se", "_sl", "_low", "_st", "_ct", "_ce", "_sem", "_base", "_ent", "_meta", "_dur", "_final")


def nearest_vectors(queries: DataFrame, rows: DataFrame, k: int, query_block: int = 512, row_block: int = 4096) -> DataFrame:
    """(q_id, vec_id, cosine, rank): the k rows (vec_id, embedding) whose unit vectors are nearest to each query's
    (q_id, embedding), other than the row of its own id; cosine is on [0, 1], ties go by id. Null vectors and those of
    other lengths than the query's are no one's neighbours.

    Queries and rows meet in blocks: a task multiplies a block of each and keeps k rows for each query, so what is
    shuffled follows the number of blocks and not of pairs."""

    def blocks(df: DataFrame, key: str, size: int, out: str) -> DataFrame:
        df = df.filter(F.col("embedding").isNotNull()).select(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        n = max(1, -(-df.count() // size))
        block = F.pmod(F.xxhash64("id"), F.lit(n))
        return df.groupBy(block.alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("x")).select(F.transform("x", lambda x: x.id).alias(f"{out}_ids"), F.transform("x", lambda x: x.v).alias(f"{out}_vecs"))

    def alike(vecs: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each length, the places of its vectors and a matrix of them, which is the batch's memory if all are as long."""
        sizes = vecs.value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = vecs.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        if len(sizes) and (sizes == sizes[0]).all():
            return {int(sizes[0]): (np.arange(len(sizes)), flat.reshape(len(sizes), -1))} if sizes[0] else {}
        at = {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes) if s}
        return {s: (i, flat[(ends[i] - s)[:, None] + np.arange(s)[None, :]]) for s, i in at.items()}

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q_vecs, r_ids, r_vecs = (batch.column(c)[r].values for c in ("q_ids", "q_vecs", "r_ids", "r_vecs"))
                among = alike(r_vecs)
                for size, (q, matrix) in alike(q_vecs).items():
                    if size not in among:
                        continue
                    v, others = among[size]
                    ids, own = r_ids.to_numpy(zero_copy_only=False)[v], q_ids.to_numpy(zero_copy_only=False)[q]
                    order = np.argsort(ids, kind="stable")
                    ids = ids[order]
                    cosine = matrix @ others[order].T
                    cosine /= 2
                    cosine += 0.5
                    np.round(np.clip(cosine, 0, 1, out=cosine), 6, out=cosine)
                    cosine[own[:, None] == ids[None, :]] = -1
                    best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                    found = np.take_along_axis(cosine, best, axis=1)
                    keep = found >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, keep.sum(axis=1)), pa.int64()), pa.array(ids[best][keep], pa.int64()), pa.array(found[keep], pa.float64())], ["q_id", "vec_id", "cosine"])

    pairs = blocks(queries, "q_id", query_block, "q").crossJoin(blocks(rows, "vec_id", row_block, "r"))  # of blocks
    return top_per_group(pairs.mapInArrow(multiplied, "q_id long, vec_id long, cosine double"), ["q_id"], k, [F.desc("cosine"), F.col("vec_id")])


def not_reranked(rows: DataFrame) -> DataFrame:
    """Score and confidence of candidates where re-ranking is off: the base score, below 1."""
    score = F.round(num.clamp(F.col("base"), 0.0, 0.99), 3)
    return rows.withColumns({"score": score, "confidence": score})


def picked(candidates: DataFrame, threshold: float = 0.78) -> DataFrame:
    """For each slot the best candidate that is confident enough, else the best: slot_id, candidate_id, confident."""
    order = F.struct("score", (-F.col("candidate_id")).alias("c"))
    best = candidates.groupBy("slot_id").agg(F.max_by("candidate_id", order).alias("top"), F.max_by("candidate_id", F.when(F.col("confidence") >= threshold, order)).alias("sure"))
    return best.select("slot_id", F.coalesce("sure", "top").alias("candidate_id"), F.col("sure").isNotNull().alias("confident"))


def not_shown(candidates: DataFrame, shown: DataFrame) -> DataFrame:
    """Candidates whose asset and whose URL the slot hasn't shown yet; a null asset or URL was never shown."""
    out = candidates.join(shown.filter("asset_id is not null").select("slot_id", "asset_id").distinct(), ["slot_id", "asset_id"], "left_anti")
    return out.join(shown.filter("url is not null").select("slot_id", "url").distinct(), ["slot_id", "url"], "left_anti")


def best_rendition(renditions: DataFrame, key: str) -> DataFrame:
    """For each video the rendition with most pixels, portrait counting 200 000 more; ties by link."""
    weight = F.col("width") * F.col("height") + F.when(F.col("height") >= F.col("width"), 200_000).otherwise(0)
    return renditions.filter(F.col("link").isNotNull()).groupBy(key).agg(F.max_by(F.struct("link", "width", "height"), F.struct(weight.alias("w"), "link")).alias("r")).select(key, "r.*")


def hit_rates(ranked: DataFrame, order: Column) -> DataFrame:
    """Share of samples with a positive among the first and the first three by order: candidates have sample_id,
    positive and candidate_id. Samples without candidates don't count."""
    placed = ranked.withColumn("r", F.row_number().over(Window.partitionBy("sample_id").orderBy(order, "candidate_id")))
    each = placed.groupBy("sample_id").agg(*[F.max(F.when((F.col("r") <= k) & F.col("positive"), 1.0).otherwise(0.0)).alias(f"top{k}") for k in (1, 3)])
    return each.agg(F.count("*").alias("samples"), *[F.round(F.avg(f"top{k}"), 6).alias(f"top{k}") for k in (1, 3)])


def nested_candidates(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """Slots with their candidates, best first; slots without any have an empty list."""
    order = F.struct((-F.col("score")).alias("s"), "candidate_id")
    lists = candidates.groupBy("slot_id").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x.candidate_id).alias("candidates"))
    return slots.join(lists, "slot_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<bigint>")))
