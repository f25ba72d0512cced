"""Structured Streaming twins of the event operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import EVENT, classified, routed, sanitize

HISTORY_MS = 7 * 24 * 3600 * 1000


def source(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Cleaned, classified events from JSON files that arrive in a folder."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    events = classified(sanitize(raw.where("event_type is not null")))
    return events.withColumn("ts", F.to_timestamp("timestamp"))


def route(events: DataFrame, write: Callable[[DataFrame, str], None], checkpoint: str, **trigger):
    """Each micro-batch is read once and handed to ``write`` for its three tables. After a failure a batch
    may come twice: use ``route_to``, or a ``write`` that stands that."""

    def each(batch: DataFrame, _: int) -> None:
        batch = routed(batch).persist()
        try:
            for name in ("search_events", "click_events", "conversion_events"):
                write(batch.where(F.col("target") == name).drop("target"), name)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def route_to(events: DataFrame, folder: str, checkpoint: str, **trigger):
    """As ``route`` into Parquet tables below ``folder``, once: a batch writes its own folder anew, so one
    that is replayed after a failure doesn't count twice."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, folder, batch_id)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_batch(batch: DataFrame, folder: str, batch_id: int) -> None:
    """Writes a batch under its number, each target a folder of its own."""
    routed(batch).withColumn("batch", F.lit(batch_id)).write.partitionBy("target", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def daily(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Searches a day and shop; a day is final once the watermark passes it."""
    own = events.where(F.col("event_type").isin("search", "no_results")).withWatermark("ts", delay)
    counts = own.groupBy(F.window("ts", "1 day"), "shop_id").agg(F.count("*").alias("searches"), F.count(F.when(F.col("event_type") == "no_results", 1)).alias("empty"))
    return counts.select(F.to_date("window.start").alias("day"), "shop_id", "searches", "empty")


def stats(events: DataFrame) -> DataFrame:
    """Running statistics a query and shop, for the update output mode."""
    own = events.where(F.col("event_type").isin("search", "no_results"))
    return own.groupBy("query", "shop_id").agg(F.count("*").alias("search_count"), F.max_by("results_count", "ts").alias("results_count"), F.max("ts").alias("last_search"))


def histories(events: DataFrame, keep: int = 10, kind: str = "search") -> DataFrame:
    """The last ``keep`` queries of each session. A session's state goes once the watermark, seven days
    behind the newest event, has passed its last entry by seven days; events behind it are dropped."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        queries, times = (list(x) for x in state.get) if state.exists else ([], [])
        fresh = [(int(t.timestamp() * 1000), q) for b in batches for t, q in zip(b["ts"], b["query"], strict=True)]
        # by time, so that late events take their place; a pause longer than a history lives starts it anew
        entries = sorted([*zip(times, queries, strict=True), *fresh], key=lambda e: e[0])
        begin = max((k for k in range(1, len(entries)) if entries[k][0] - entries[k - 1][0] > HISTORY_MS), default=0)
        times, queries = map(list, zip(*entries[begin:][-keep:], strict=True))
        state.update((queries, times))
        state.setTimeoutTimestamp(times[-1] + HISTORY_MS)
        yield pd.DataFrame({"session_id": [key[0]], "queries": [queries]})

    own = events.where((F.col("event_type") == kind) & F.col("query").isNotNull() & F.col("ts").isNotNull()).select("session_id", "query", "ts").withWatermark("ts", "7 days")
    return own.groupBy("session_id").applyInPandasWithState(
        update, "session_id string, queries array<string>", "queries array<string>, times array<bigint>", "update", GroupStateTimeout.EventTimeTimeout
    )
