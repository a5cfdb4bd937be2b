"""The stateful stream ends in the state of the batch query, and the job store round-trips."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.operators import jobs
from plumbline.sources import job_store
from plumbline.streaming import progress

EVENTS = "job_id string, slot string, phase string, status string, message string, ts timestamp, event_id long"


def log(n):
    start = datetime(2024, 1, 1)
    states = ("running", "done", "error", "done")
    steps = (*jobs.PHASES, "done", "pipeline", "detecting-refusal")
    # two events share each time, so the number of the event decides; numbers are above a million
    return [(f"j{i % 3}", f"s{i % 2}", steps[i % 9], states[i % 4], "Refusal detected" if i % 5 else None, start + timedelta(seconds=i // 2), 5_000_000 * i) for i in range(n)]


def test_phase_states(spark):
    def states(*events):
        rows = [("j", "s", phase, status, message, datetime(2024, 1, 1), i) for i, (phase, status, message) in enumerate(events)]
        return {r.phase: r.state for r in jobs.phase_states(spark.createDataFrame(rows, EVENTS)).collect()}

    assert states(("querying", "running", None)) == {"translating": "done", "querying": "running"}
    assert states(("done", "done", None)) == dict.fromkeys(jobs.PHASES, "done")
    refused = states(("detecting-refusal", "done", "Refusal detected (85% confidence)"))
    assert refused == {"translating": "done", "querying": "done", "detecting-refusal": "done", "extracting-facts": "skipped", "verifying-facts": "skipped"}
    assert states(("scoring-bias", "error", None), ("pipeline", "running", None)) == {"scoring-bias": "error"}


def test_stateful_stream_equals_batch_over_several_batches_and_a_restart(spark, tmp_path):
    rows = log(120)
    source, changes, checkpoint = (str(tmp_path / x) for x in ("in", "changes", "checkpoint"))

    def run():
        schema = spark.createDataFrame([], EVENTS).schema
        stream = progress.stateful_states(progress.read_events(spark, source, schema, "*.parquet", files=1))
        query = progress.snapshots(stream, progress.append_to(changes), checkpoint)
        query.awaitTermination()

    def deliver(part, name):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{source}/{name}")

    deliver(rows[:40], "a"), deliver(rows[40:80], "b")
    run()
    deliver(rows[80:], "c")
    run()  # a new query resumes from the checkpoint
    batches = spark.read.parquet(changes)
    assert batches.select("batch").distinct().count() == 3
    got = {(r.job_id, r.slot, r.phase): r.state for r in progress.current(batches).collect()}
    assert got == {(r.job_id, r.slot, r.phase): r.state for r in jobs.phase_states(spark.createDataFrame(rows, EVENTS)).collect()}


def test_snapshot_and_tail_are_the_whole_log(spark):
    frame = spark.createDataFrame(log(60), EVENTS)
    until = datetime(2024, 1, 1, 0, 0, 14)
    first = jobs.snapshot(frame, F.lit(until))
    assert first.select("job_id", "slot", "n_events").distinct().agg(F.sum("n_events")).first()[0] + frame.where(F.col("ts") > F.lit(until)).count() == 60


def test_job_store(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    rows = [("j1", "completed", ("Why?", None), 1, 5), ("j2", "running", ("How?", "如何"), 2, None), ("j10", "error", ("Who?", "谁"), 3, 9)]
    frame = spark.createDataFrame(rows, "id string, status string, scenario struct<english:string,chinese:string>, createdAt long, completedAt long")
    job_store.write_jobs(frame.coalesce(1), folder)
    (tmp_path / "jobs" / "broken.json").write_text("{not json")
    back = job_store.read_jobs(spark, folder)
    assert {r.id for r in back.collect()} == {"j1", "j2", "j10"}
    assert {r.id for r in job_store.without_incomplete(back).collect()} == {"j1", "j10"}
    assert {(r.id, r.english, r.slot_count) for r in job_store.summaries(back).collect()} == {("j1", "Why?", 0), ("j2", "How?", 0), ("j10", "Who?", 0)}
    assert {(r.id, r.status) for r in job_store.upsert(back.drop("file"), frame.where("id = 'j2'").withColumn("status", F.lit("completed"))).select("id", "status").collect()} == {("j1", "completed"), ("j2", "completed"), ("j10", "error")}


def test_last_files_are_chosen_before_they_are_read(spark, tmp_path):
    for name, text in (("j1", '{\n  "id": "j1"\n}'), ("j10", '{"id": "j10"}'), ("j2", "{broken"), ("j3", '{\n  "id": "j3"}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert [r.id for r in job_store.last_files(spark, str(tmp_path), 3).collect()] == ["j3", "j10"]
    assert {r.id for r in job_store.read_jobs(spark, str(tmp_path), one_a_file=True).collect()} == {"j1", "j10", "j3"}
