"""Event operators over streams: the batch forms give the same results on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.sinks import KeyedTable

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def retained(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Events of users whose rights allow keeping them (a static table)."""
    return events.join(allowed, "user_id", "left_semi")


def counters(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """Events and distinct users by type and day: state of days behind the watermark is dropped."""
    marked = events.withWatermark("ts", delay)
    return marked.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"))


def unique_sessions(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """The first event of each user within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id"])


def latest_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


#: What an event does to its session: an explicit end closes it, there is no time-out.
ENDS = {"purchase": "COMPLETED", "error": "ABORTED"}


def lifecycle(types: list[str], state: str | None) -> str:
    for t in types:
        if state in ENDS.values():
            break
        state = ENDS.get(t, "STARTED" if state is None else "ACTIVE")
    return state or "STARTED"


def session_states(events: DataFrame) -> DataFrame:
    """user_id, state after each batch; works on streams (arbitrary state) only."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        now = lifecycle(rows["event_type"].tolist(), state.get[0] if state.exists else None)
        state.update((now,))
        yield pd.DataFrame({"user_id": [key[0]], "state": [now]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, state string", "state string", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, target: KeyedTable, checkpoint: str, order: list[Column]):
    """Upserts each batch into a keyed table: the last write of a key stays, and a batch that one checkpoint delivers again changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        target.upsert(batch, order, batch=(checkpoint, batch_id))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def newest_sessions(events: DataFrame, cap: int = 10_000) -> DataFrame:
    """session and first (when it was first seen) of the newest sessions: beyond the cap the oldest ones are forgotten.

    The cap is the feature; the sort takes the first `cap` rows of each task before they meet.
    """
    return events.groupBy("session").agg(F.min("ts").alias("first")).orderBy(F.col("first").desc(), F.col("session").desc()).limit(cap)
