"""The progress feed as Structured Streaming: event log in, state of each job and slot out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.jobs import PHASES, phase_updates


def read_events(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", files: int = 8) -> DataFrame:
    """A stream over Parquet files of events; at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(folder)


_STATE = "at array<bigint>, number array<bigint>, states array<string>"
_OUT = "job_id string, slot string, phase string, state string, at bigint, number bigint"


def stateful_states(events: DataFrame, mode: str = "update", late_ms: int = 86_400_000) -> DataFrame:
    """The same fold with explicit state: the last state of each phase of a job and slot, with the time (microseconds) and
    number of its event, by which an upsert tells which of two states is later.

    The state of a key is dropped when the watermark has passed its last event by ``late_ms``, so it doesn't grow
    without bound.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = len(PHASES)
        at, number, states = map(list, state.get) if state.exists else ([-1] * n, [-1] * n, [None] * n)
        changed = set()
        for batch in batches:
            for phase, s, ts, event in zip(batch["phase"], batch["state"], batch["ts"], batch["event_id"]):
                i, when = PHASES.index(phase), (int(ts.value // 1000), int(event))
                if when >= (at[i], number[i]):
                    (at[i], number[i]), states[i] = when, s
                    changed.add(i)
        state.update((at, number, states))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), max(at) // 1000) + late_ms)
        yield pd.DataFrame([(*key, PHASES[i], states[i], at[i], number[i]) for i in sorted(changed)], columns=["job_id", "slot", "phase", "state", "at", "number"])

    updates = phase_updates(events.withWatermark("ts", f"{late_ms} milliseconds"))
    return updates.groupBy("job_id", "slot").applyInPandasWithState(fold, _OUT, _STATE, mode, "EventTimeTimeout")


def snapshots(states: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Hand every batch of changed states to ``write`` (an upsert by key); a restart resumes from the checkpoint."""
    return states.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def append_to(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``write`` that keeps the changes of each batch in its own folder; a batch that runs again replaces its own."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def current(changes: DataFrame) -> DataFrame:
    """The table that an upsert of all changes by key gives: the latest state of each phase."""
    return changes.groupBy("job_id", "slot", "phase").agg(F.max_by("state", F.struct("at", "number")).alias("state"))


def messages(states: DataFrame) -> DataFrame:
    """The states as messages for subscribers."""
    return states.select("job_id", F.to_json(F.struct(F.lit("progress").alias("type"), *states.columns)).alias("payload"))
