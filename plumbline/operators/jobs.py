"""Job lists, retention and the event log as batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import numbered

# The phases of a slot in their order, the step after the last one, and the phases that a refusal skips.
PHASES = ("translating", "querying", "detecting-refusal", "extracting-facts", "verifying-facts", "scoring-bias")
DONE = "done"
SKIPPED = ("extracting-facts", "verifying-facts")


def next_id(ids: Column) -> Column:
    """The next job id (an aggregate): one above the largest ``j<number>``."""
    number = F.regexp_extract(ids, r"^j(\d+)$", 1).try_cast("bigint")
    return F.concat(F.lit("j"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string"))


def retained(jobs: DataFrame, keep: int, done: str = "completed_at") -> DataFrame:
    """Jobs that stay: all unfinished ones, and the ``keep`` finished ones that finished last.

    The boundary is found by a distributed top-k, so no window gathers all finished jobs.
    """
    finished = F.col("status").isin("completed", "error")
    newest = jobs.where(finished).orderBy(F.coalesce(done, F.lit(0)).desc(), F.col("job_id")).limit(keep).select("job_id")
    return jobs.where(~finished).unionByName(jobs.where(finished).join(newest, "job_id", "left_semi"))


def recent(memory: DataFrame, stored: DataFrame, n: int = 10, done: str = "completed_at") -> DataFrame:
    """The ``n`` jobs that finished last, from memory and, where it lacks them, from the store."""
    others = stored.join(memory.select("job_id"), "job_id", "left_anti")
    return memory.unionByName(others, allowMissingColumns=True).orderBy(F.coalesce(done, F.lit(0)).desc(), F.col("job_id")).limit(n)


def running(jobs: DataFrame) -> DataFrame:
    """The running jobs with their place by start (missing: first)."""
    rows = jobs.where(F.col("status") == "running")
    return numbered(rows, [F.coalesce("started_at", F.lit(0)), F.col("job_id")], "place")


def admitted(jobs: DataFrame, limit: int = 2) -> DataFrame:
    """The queued jobs that may start now: the first in line, as many as the running ones leave of ``limit``."""
    first = jobs.where(F.col("status") == "queued").orderBy("created_at", "job_id").limit(limit).select("job_id", "created_at")
    placed = first.withColumn("position", F.row_number().over(Window.orderBy("created_at", "job_id")))  # at most ``limit`` rows
    busy = jobs.agg(F.count_if(F.col("status") == "running").alias("busy"))  # one row
    return placed.crossJoin(F.broadcast(busy)).where(F.col("position") <= limit - F.col("busy")).select("job_id", "position")


def overview(jobs: DataFrame) -> DataFrame:
    """One row: how many jobs wait, run and have ended, and how many are active together."""
    count = {s: F.count_if(F.col("status") == s) for s in ("queued", "running", "completed", "error")}
    return jobs.agg(count["queued"].alias("queue_length"), count["running"].alias("n_running"), (count["queued"] + count["running"]).alias("n_active"), (count["completed"] + count["error"]).alias("n_ended"))


def event_log(events: DataFrame) -> DataFrame:
    """The kept log: every event of a job and slot with its place in the order of arrival, told by the time since the slot
    began. The rows stay rows, so a slot of any length is no single value."""
    window = Window.partitionBy("job_id", "slot").orderBy("ts", "event_id")
    begun = F.min(F.struct("ts", "event_id")).over(Window.partitionBy("job_id", "slot"))["ts"]
    return events.withColumn("place", F.row_number().over(window)).withColumn("elapsed_ms", F.unix_millis("ts") - F.unix_millis(begun))


def snapshot(events: DataFrame, until: Column) -> DataFrame:
    """What a new subscriber gets first: the states of all phases by the events up to a time, and how many these were.
    The events after it are the tail, so both together are the whole log."""
    seen = events.where(F.col("ts") <= until)
    counted = seen.groupBy("job_id", "slot").agg(F.count(F.lit(1)).alias("n_events"))
    return phase_states(seen).join(counted, ["job_id", "slot"])


def best_scores(scores: DataFrame, by: str, score: str, total: str, streak: str, order: list[str]) -> DataFrame:
    """The best score and streak of each player over all games, and the total of the last game."""
    return scores.groupBy(by).agg(F.max(score).alias("score"), F.max_by(total, F.struct(*order)).alias("total"), F.max(streak).alias("streak"))


# How slots are shown, and the tags of quiz categories (others: the last).
SLOT_LABELS = {"us-model-en": "US · EN", "us-model-zh": "US · ZH", "cn-model-en": "CN · EN", "cn-model-zh": "CN · ZH"}
SLOT_FLAGS = {"us": "🇺🇸", "cn": "🇨🇳"}
TAGS = {"Omission": "tag-omission", "Redaction": "tag-redaction"}
OTHER_TAG = "tag-bias"


def slot_label(slot: Column) -> Column:
    """The flag and label of a slot; its name where it has none."""
    labels = F.create_map(*[F.lit(x) for pair in SLOT_LABELS.items() for x in pair])
    flags = F.create_map(*[F.lit(x) for pair in SLOT_FLAGS.items() for x in pair])
    return F.coalesce(F.concat(F.try_element_at(flags, F.substring_index(slot, "-", 1)), F.lit(" "), F.try_element_at(labels, slot)), slot)


def tag(category: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    return F.coalesce(F.try_element_at(tags, category), F.lit(OTHER_TAG))


def in_category(rows: DataFrame, category: str, column: str = "category") -> DataFrame:
    """The rows of a category; ``All`` passes every row."""
    return rows if category == "All" else rows.where(F.col(column) == category)


def events_by_slot(events: DataFrame) -> DataFrame:
    """What the log holds of each job and slot: number, first and last time, and the latest status (partial aggregates)."""
    return events.groupBy("job_id", "slot").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by("status", F.struct("ts", "event_id")).alias("last_status"),
    )


def first_transitions(events: DataFrame) -> DataFrame:
    """The first time of each phase of a job and slot, and the time since the slot began."""
    first = events.where(F.col("phase").isin(*PHASES)).groupBy("job_id", "slot", "phase").agg(F.min_by("ts", F.struct("ts", "event_id")).alias("first_ts"))
    begun = F.min("first_ts").over(Window.partitionBy("job_id", "slot"))  # at most one row a phase
    return first.withColumn("elapsed_ms", F.unix_millis("first_ts") - F.unix_millis(begun))


def phase_updates(events: DataFrame) -> DataFrame:
    """Each event as the phase states that it sets.

    The phases before a running or done one are done, its own has the event's status; the step after the last one makes
    all done; a refusal that is told while it is looked for skips the phases that need facts. Other steps and statuses
    set nothing.
    """
    order = F.array(*[F.lit(p) for p in PHASES])
    at = F.array_position(order, F.col("phase")).cast("int")

    def all_to(phases: Column, state: str) -> Column:
        return F.transform(phases, lambda p: F.struct(p.alias("phase"), F.lit(state).alias("state")))

    none = F.array().cast("array<struct<phase:string,state:string>>")
    before = F.when(F.col("status").isin("running", "done"), all_to(F.slice(order, 1, F.greatest(at - 1, F.lit(0))), "done")).otherwise(none)
    own = F.when(F.col("status").isin("running", "done", "error"), F.array(F.struct(F.col("phase"), F.col("status").alias("state")))).otherwise(none)
    refused = (F.col("phase") == "detecting-refusal") & F.col("status").isin("running", "done") & F.contains(F.lower(F.coalesce("message", F.lit(""))), F.lit("refusal detected"))
    skipped = F.when(refused, all_to(F.array(*[F.lit(p) for p in SKIPPED]), "skipped")).otherwise(none)
    updates = F.when(F.col("phase") == DONE, all_to(order, "done")).when(at > 0, F.concat(before, own, skipped))
    return events.select("job_id", "slot", "ts", "event_id", F.explode(updates).alias("u")).select("job_id", "slot", "ts", "event_id", "u.phase", "u.state")


def phase_states(events: DataFrame) -> DataFrame:
    """The last state of each phase of a job and slot."""
    return phase_updates(events).groupBy("job_id", "slot", "phase").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))


def settled(events: DataFrame, by: str, gap_ms: int) -> DataFrame:
    """The last input of each burst: inputs that no other of the same source follows within the gap."""
    following = F.lead("ts").over(Window.partitionBy(by).orderBy("ts", "event_id"))
    wait = F.unix_micros(following) - F.unix_micros("ts")
    return events.withColumn("_wait", wait).where(F.col("_wait").isNull() | (F.col("_wait") > gap_ms * 1000)).drop("_wait")


def streaks(answers: DataFrame, by: str, order: list[str], right: str) -> DataFrame:
    """The longest run of right answers of each player, and the run at the end."""
    window = Window.partitionBy(by).orderBy(*order)
    marked = answers.withColumn("_wrong", (~F.col(right)).cast("int")).withColumn("_island", F.sum("_wrong").over(window))
    runs = marked.groupBy(by, "_island").agg(F.count_if(right).alias("run"))
    return runs.groupBy(by).agg(F.max("run").alias("best_streak"), F.max_by("run", "_island").alias("current_streak"))


# The titles of quiz results by the least rounded percentage.
TIERS = {100: "Perfect run", 80: "Sharp eye", 50: "Good instincts", 0: "Worth another pass"}


def quiz_tier(share: Column) -> Column:
    """The title of a share of right answers."""
    whole = F.round(share * 100, 0)
    tier = F.lit(TIERS[0])
    for least in sorted(TIERS):
        tier = F.when(whole >= least, TIERS[least]).otherwise(tier)
    return tier
