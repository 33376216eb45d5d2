"""Job logs: current status, active jobs, orphans, stages. Events have job_id, project_id, kind, stage, status,
progress, event_id and created_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scan import after, before, kept_step, scanned, so_far, spread, walked, whole

ACTIVE, DONE = ("queued", "running"), ("completed", "failed")
#: fixed values: what jobs of each kind go through: stage, status and progress. Any stage but a last one may fail
STAGES = {
    "render": [("queued", "queued", 0), ("running", "running", 5), ("build", "running", 20), ("render", "running", 35), ("complete", "completed", 100)],
    "ingest": [("queued", "queued", 0), ("running", "running", 5), ("download", "running", 20), ("probe", "running", 70), ("register", "running", 85), ("complete", "completed", 100)],
}
FAILED = ("failed", "failed", 100)


def latest(events: DataFrame, key: str = "job_id") -> DataFrame:
    """The last event of each key, by time and then id."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct("created_at", "event_id")).alias("e")).select(key, "e.*")


def active_jobs(events: DataFrame, since=None) -> DataFrame:
    """For each project and kind the job that is queued or running and was updated last, not before since."""
    now = latest(events).filter(F.col("status").isin(*ACTIVE))
    now = now if since is None else now.filter(F.col("created_at") >= F.lit(since))
    best = now.groupBy("project_id", "kind").agg(F.max_by(F.struct("job_id", "status", "created_at"), F.struct("created_at", "event_id")).alias("j"))
    return best.select("project_id", "kind", "j.job_id", "j.status")


def orphans(events: DataFrame) -> DataFrame:
    """Jobs without a final event, as they are marked at start-up: failed, at 100."""
    ended = events.filter(F.col("status").isin(*DONE)).select("job_id").distinct()
    return events.select("job_id").distinct().join(ended, "job_id", "left_anti").withColumns({"status": F.lit("failed"), "progress": F.lit(100)})


def stage_times(events: DataFrame) -> DataFrame:
    """Each event with the seconds until its job's next; the last has none."""
    nexts = F.lead(F.unix_micros(F.col("created_at").cast("timestamp"))).over(Window.partitionBy("job_id").orderBy("created_at", "event_id"))
    return events.withColumn("seconds", (nexts - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(1e6))


def run_through(events: DataFrame) -> DataFrame:
    """Events with the state that their job was in (null before it was queued), and error: null for those that take the job
    on, else why they don't: unknown stage (of its kind), wrong status or progress (for its stage), ended, or out of
    order. An event that doesn't take its job on leaves it as it was.

    A stage leads to the next of its kind or to failure. So each event has one successor, the first later event of these
    two, and the events that take a job on are those that a walk from its first queued event visits: jobs with any number
    of events, and any number of jobs."""
    steps = [(kind, i, *step) for kind, steps in STAGES.items() for i, step in enumerate(steps)]
    steps += [(kind, len(stages), *FAILED) for kind, stages in STAGES.items()]
    told = F.lit(None).cast("struct<at:int,status:string,progress:int>")
    for kind, at, stage, status, progress in steps:
        told = F.when((F.col("kind") == kind) & (F.col("stage") == stage), F.struct(F.lit(at).alias("at"), F.lit(status).alias("status"), F.lit(progress).alias("progress"))).otherwise(told)
    fits = (F.col("_told.status") == F.col("status")) & (F.col("_told.progress") == F.col("progress"))
    rows = events.withColumn("_told", told).withColumn("_step", F.when(F.coalesce(fits, F.lit(False)), F.col("_told.at")))
    order = ["created_at", "event_id"]
    rows = spread(rows.withColumn("key", F.col("job_id")), *order)
    most = max(map(len, STAGES.values()))
    later = {f"_next{i}": after("min", F.when(F.col("_step") == i, F.col("_at"))) for i in range(1, most + 1)}
    rows = kept_step(scanned(rows, order, {"_at": so_far("sum", F.lit(1))}))
    rows = scanned(rows, ["_at"], later | {"_first": whole("min", F.when(F.col("_step") == 0, F.col("_at"))), "_all": whole("max", "_at")})
    size = F.lit(None).cast("int")
    for kind, stages in STAGES.items():
        size = F.when(F.col("kind") == kind, len(stages)).otherwise(size)
    far = F.lit(None).cast("bigint")
    for i in range(most - 1):
        fails = F.lit(None).cast("bigint")
        for kind, stages in STAGES.items():
            fails = F.when(F.col("kind") == kind, F.col(f"_next{len(stages)}")).otherwise(fails)
        # a stage before the last goes on, or fails; the last one (complete) and failure end
        far = F.when((F.col("_step") == i) & (F.col("_step") < size - 1), F.least(F.col(f"_next{i + 1}"), fails)).otherwise(far)
    # the walk begins at the first row, so what comes before the first queued event leads there
    end = F.col("_all") + 1
    to = F.when(F.col("_at") < F.coalesce("_first", end), F.coalesce("_first", end)).otherwise(F.coalesce(far, end))
    rows = kept_step(rows.withColumn("_to", to).drop(*later))
    rows = kept_step(walked(rows)).withColumn("_on", F.col("visited") & F.coalesce(F.col("_at") >= F.col("_first"), F.lit(False)))
    rows = scanned(rows, ["_at"], {"state": before("last", F.when(F.col("_on"), F.col("stage")))})
    ended = F.col("state").isin("complete", FAILED[0])
    error = F.when(F.col("_on"), None).when(F.col("_told").isNull(), "unknown stage").when(~F.coalesce(fits, F.lit(False)), "wrong status or progress").when(ended, "ended").otherwise("out of order")
    return rows.withColumn("error", error).select(*events.columns, "state", "error")


def job_states(events: DataFrame, silent_sec: float) -> DataFrame:
    """For each job: state (the last stage that took it on), progress, the number of events and of refused ones, and silent:
    that it hasn't ended and nothing was heard of it for more than silent_sec before the log's last event."""
    rows = run_through(events)
    last = F.max(F.when(F.col("error").isNull(), F.struct("created_at", "event_id", "stage", "progress")))
    each = rows.groupBy("job_id", "project_id", "kind").agg(last.alias("l"), F.count("*").alias("n_events"), F.count("error").alias("n_refused"), F.max("created_at").alias("heard"))
    now = events.agg(F.max(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("now"))  # one row
    quiet = (F.col("now") - F.unix_micros(F.col("heard").cast("timestamp"))) / 1e6 > silent_sec
    each = each.crossJoin(F.broadcast(now))
    return each.select("job_id", "project_id", "kind", F.col("l.stage").alias("state"), F.coalesce("l.progress", F.lit(0)).alias("progress"), "n_events", "n_refused", (quiet & ~F.coalesce(F.col("l.stage").isin("complete", FAILED[0]), F.lit(False))).alias("silent"))


def appended(events: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with the updates that take their jobs on, the refused ones with their error): what a writer of the log
    appends, and what it doesn't. Updates have the events' columns and come after what is there."""
    mark = F.lit(True)
    rows = run_through(events.withColumn("_new", F.lit(False)).unionByName(updates.withColumn("_new", mark)))
    fresh = rows.filter("_new")
    return events.unionByName(fresh.filter("error is null").select(*events.columns)), fresh.filter("error is not null").select(*events.columns, "error")


def stream_flag(metadata_json: Column, field: str, probed: Column) -> Column:
    """Whether a file has a kind of stream: as its metadata says, else as probed, else no."""
    return F.coalesce(F.get_json_object(metadata_json, f"$.{field}").try_cast("boolean"), probed, F.lit(False))
