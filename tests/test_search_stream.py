"""The trigram index against a scan, and the edit log as a stream against the same log at once, with a restart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import edits, search
from tessera.streaming import edit_log


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(7)
    words = ["The", "lake", "és", "bread", "la", "ke", "%_", "ab"]
    rows = [(i, i % 3, "".join(r.choice([*words, " ", "."]) for _ in range(r.randint(0, 12)))) for i in range(400)] + [(500, 0, None), (501, 0, "")]
    frame = spark.createDataFrame(rows, "id int, part int, text string")
    index = search.write_index(frame, ["id", "part"], "text", f"file://{tmp_path}/index")
    for query in ("lake", "KE.", "the l", "és", "a", "", " ", "no such text", "%_", "bread.the"):
        got = search.found(frame, ["id", "part"], "text", query, index)
        q = query.strip().lower()
        assert sorted(x.id for x in got.collect()) == sorted(i for i, _, t in rows if q and t and q in t.lower()), query


def test_index_of_an_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "id int, text string")
    assert search.found(frame, ["id"], "text", "lake", search.write_index(frame, ["id"], "text", f"file://{tmp_path}/index")).count() == 0


def test_index_reads_few_postings(spark, tmp_path):
    frame = spark.range(200).select("id", F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    index = search.write_index(frame, ["id"], "text", f"file://{tmp_path}/index")
    plan = search.found(frame, ["id"], "text", "number 77", index)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("#", "") or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram" in plan


def test_index_has_a_list_for_each_trigram(spark, tmp_path):
    frame = spark.range(0, 300, 1, 2).select("id", F.concat(F.lit("Turn é\U0001f600 "), F.col("id").cast("string")).alias("text"))
    kept = spark.read.parquet(search.write_index(frame, ["id"], "text", f"file://{tmp_path}/index"))
    grams = {g for i in range(300) for g in search.trigrams(f"Turn é\U0001f600 {i}")}
    lists = kept.collect()
    assert {x.gram for x in lists} == grams
    assert len(lists) <= len(grams) * spark.sparkContext.defaultParallelism
    assert sorted(x.id for r in lists if r.gram == "é\U0001f600 " for x in r.ids) == list(range(300))


OPS = "project_id string, op_id int, op_type string, params map<string,string>"
CLIPS = "project_id string, track string, ord int, clip_id string, asset_id string, start_sec double, end_sec double, timeline_start_sec double, speed double"


def test_stream_of_edits_survives_a_restart(spark, tmp_path, monkeypatch):
    clips = edits.new_clips(spark.createDataFrame([(p, "video", 1, "c1", "a", 0.0, 10.0, 0.0, 1.0) for p in ("p", "q")], CLIPS))
    log = [
        [("p", 1, "split_clip", {"clip": "1", "at_sec": "4"}), ("q", 1, "set_speed", {"clip": "1", "speed": "2"}), ("p", 2, "delete_clip", {"clip": "9"})],
        [("p", 3, "delete_clip", {"clip": "1"}), ("q", 2, "trim_clip", {"clip": "1", "start_sec": "1", "end_sec": "3"})],
        [("q", 3, "add_broll_clip", {"asset_id": "z", "end_sec": "2"})],
    ]
    source, folder = tmp_path / "ops", f"file://{tmp_path}/state"
    (tmp_path / "ops").mkdir()

    def arrive(k):
        spark.createDataFrame(log[k], OPS).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        part = next((tmp_path / f"in{k}").glob("part-*"))
        part.rename(source / f"{k}.parquet")

    def run():
        stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
        query = edit_log.follow(stream, clips, folder).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    arrive(0)
    run()
    assert edit_log.finished(spark, folder) == [0]
    arrive(1)
    whole = edit_log._applied

    def cut_short(*args):
        left, told = whole(*args)
        return left, told.withColumn("error", F.raise_error(F.lit("lost")).cast("string"))

    monkeypatch.setattr(edit_log, "_applied", cut_short)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(edit_log, "_applied", whole)
    assert edit_log.finished(spark, folder) == [0]
    arrive(2)
    run()
    expected, told = edit_log._applied(clips, spark.createDataFrame([op for ops in log for op in ops], OPS))
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(edit_log.current_clips(spark, folder, clips)) == shown(expected)
    assert shown(edit_log.outcomes(spark, folder).drop("batch")) == shown(told)
    assert {(x.project_id, x.op_id): x.error for x in told.collect() if x.error} == {("p", 2): "no such clip"}
