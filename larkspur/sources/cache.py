"""A read-through cache of two tiers: a small frame in memory, with a short life, before a stored table of
buckets, with a longer one. A search whose answers are held reads neither the catalogue nor the
table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import read_buckets, upsert_buckets

ENTRY = "cache_key string, result_data string, created_at timestamp"
MEMORY_SECONDS, STORED_SECONDS, MEMORY_ROWS = 60, 300, 1000


class ResultCache:
    """``compute``: from a frame of asked rows (cache_key and whatever it needs) to (cache_key, result_data).
    Null results are answers that are not kept. Clocks are arguments; entries count by their
    created_at in both tiers. Keys of one call are distinct."""

    def __init__(self, spark: SparkSession, path: str, compute: Callable[[DataFrame], DataFrame], memory_seconds: int = MEMORY_SECONDS, stored_seconds: int = STORED_SECONDS, memory_rows: int = MEMORY_ROWS, buckets: int = 16):
        self.spark, self.path, self.compute, self.buckets = spark, path, compute, buckets
        self.memory_seconds, self.stored_seconds, self.memory_rows = memory_seconds, stored_seconds, memory_rows
        self.memory = spark.createDataFrame([], ENTRY)

    def _fresh(self, entries: DataFrame, now: F.Column, seconds: int) -> DataFrame:
        return entries.where(F.col("created_at").isNotNull() & (F.col("created_at") >= now - F.expr(f"interval {seconds} seconds")))

    def _hold(self, entries: DataFrame) -> None:
        """The newest ``memory_rows`` entries become the frame in memory: rows of their own, which no
        write to the table touches."""
        held = entries.select("cache_key", "result_data", "created_at").orderBy(F.desc("created_at"), "cache_key").limit(self.memory_rows)
        self.memory = self.spark.createDataFrame(held.toArrow(), ENTRY)

    def get(self, asked: DataFrame, now: F.Column) -> DataFrame:
        """(cache_key, result_data, tier): memory, stored or computed, for each asked row that has a result.
        Rows of the latter two are read from the table: before the next call."""
        now = now.cast("timestamp")
        warm = self._fresh(self.memory, now, self.memory_seconds)
        hits = warm.join(asked.select("cache_key"), "cache_key").select("cache_key", "result_data", F.lit("memory").alias("tier"))
        missing = asked.join(warm.select("cache_key"), "cache_key", "left_anti")
        if missing.isEmpty():
            return hits
        table = read_buckets(self.spark, self.path)
        kept = self.spark.createDataFrame([], ENTRY) if table is None else self._fresh(table, now, self.stored_seconds)
        lacking = missing.join(kept.select("cache_key"), "cache_key", "left_anti")
        if not lacking.isEmpty():
            made = self.compute(lacking).select("cache_key", "result_data", now.alias("created_at")).where("result_data is not null").persist()
            upsert_buckets(made, self.path, ["cache_key"], buckets=self.buckets)
            made.unpersist()
            table = read_buckets(self.spark, self.path)
        if table is None:  # nothing has ever been found
            return hits
        found = self._fresh(table, now, self.stored_seconds).join(missing.select("cache_key"), "cache_key")
        fresh = self._fresh(found, now, self.memory_seconds)
        self._hold(warm.join(fresh.select("cache_key"), "cache_key", "left_anti").unionByName(fresh))
        tier = F.when(F.col("created_at") == now, "computed").otherwise("stored").alias("tier")
        return hits.unionByName(found.select("cache_key", "result_data", tier))

    def invalidate(self, keys: DataFrame | None = None) -> None:
        """Takes entries (cache_key; all where none are given) out of both tiers; of the table only their
        buckets are rewritten."""
        table = read_buckets(self.spark, self.path)
        gone = keys if keys is not None else table
        if gone is not None and table is not None:
            marks = table.join(gone.select("cache_key").distinct(), "cache_key", "left_semi").select("cache_key", F.lit(None).cast("string").alias("result_data"), F.lit(None).cast("timestamp").alias("created_at")).persist()
            upsert_buckets(marks, self.path, ["cache_key"], buckets=self.buckets)
            marks.unpersist()
        self._hold(self.memory.limit(0) if keys is None else self.memory.join(keys.select("cache_key"), "cache_key", "left_anti"))
