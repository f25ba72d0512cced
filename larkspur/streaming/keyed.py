"""Keyed streams: histories and recent searches with timers, sessions, attribution by a join of two
streams, and day figures with distinct sessions.

Every twin gives what its batch operator gives, whatever the order in which files come, late and
repeated events included, as long as events are not later than the watermark. State goes with the
watermark: histories by a timer, sessions and joins by their time ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import session_key
from ..operators.reports import STAT_KEYS, merge_stats, query_stats
from ..sources.sinks import BUCKETS, upsert_buckets

LIFE_MS = 7 * 24 * 3600 * 1000
HISTORY = "session_id string, kind string, place int, event_id long, query string, id_product long"
#: The histories of a session: the kinds of events that go in, how many are kept.
KEPT = {"search": 10, "click": 20}
RECENT = 5


def use_keyed_state(spark: SparkSession) -> None:
    """The state store that list and map state need (a session-wide setting, to be made before a query starts)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Histories(StatefulProcessor):
    """Of a session: its last searches with results and last clicks as list states; its recent distinct
    queries as a map state, in which a repeated query moves to the front and a removed one leaves a mark,
    so that a late search from before the removal doesn't bring it back. A timer clears all once the
    watermark is ``life_ms`` past the newest event."""

    def __init__(self, kept: dict[str, int] | None = None, recent: int = RECENT, life_ms: int = LIFE_MS):
        self.kept, self.recent, self.life_ms = kept or KEPT, recent, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        entry = "ts long, event_id long, query string, id_product long"
        self.lists = {kind: handle.getListState(kind, entry) for kind in self.kept}
        self.queries = handle.getMapState("recent", "query string", "ts long, event_id long, removed boolean")

    def _merged(self, kind: str, fresh: pd.DataFrame) -> Iterator[tuple]:
        """Stores the newest entries of a list, each event once, and gives those that are alive: behind
        the last pause of more than a life."""
        own = {(e[0], e[1]): tuple(e) for e in self.lists[kind].get()}
        own |= {(e.ms, e.event_id): (e.ms, e.event_id, e.query, e.id_product) for e in fresh.itertuples()}
        newest = [own[k] for k in sorted(own)][-self.kept[kind] :]
        self.lists[kind].put([tuple(None if v != v else v for v in e) for e in newest])
        begin = max((k for k in range(1, len(newest)) if newest[k][0] - newest[k - 1][0] > self.life_ms), default=0)
        return reversed(newest[begin:])

    def _moved(self, fresh: pd.DataFrame) -> list[tuple]:
        """Moves queries to the front, marks removed ones, and gives the newest that stand."""
        for e in fresh.sort_values(["ms", "event_id"]).itertuples():
            at = self.queries.getValue((e.query,)) if self.queries.containsKey((e.query,)) else None
            if at is None or (e.ms, e.event_id) >= (at[0], at[1]):
                self.queries.updateValue((e.query,), (e.ms, e.event_id, e.kind == "remove"))
        standing = sorted(((v[0], v[1], k[0]) for k, v in self.queries.iterator() if not v[2]), reverse=True)
        return standing[: self.recent]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True)
        out = []
        for kind in self.kept:
            fresh = events[(events["kind"] == kind) & ((kind != "search") | (events["results_count"] > 0))]
            if len(fresh):
                out += [(key[0], kind, k, e[1], e[2], e[3]) for k, e in enumerate(self._merged(kind, fresh), 1)]
        asked = events[events["kind"].isin(["search", "no_results", "remove"]) & events["query"].notna()]
        if len(asked):
            out += [(key[0], "recent", k, e[1], e[2], None) for k, e in enumerate(self._moved(asked), 1)]
        newest = max([int(events["ms"].max()), *(t - self.life_ms for t in self.handle.listTimers())])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + self.life_ms)
        frame = pd.DataFrame(out, columns=["session_id", "kind", "place", "event_id", "query", "id_product"])
        yield frame.astype({"place": "int32", "event_id": "int64", "id_product": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (*self.lists.values(), self.queries):
            state.clear()
        yield pd.DataFrame({"session_id": [key[0]], "kind": ["gone"], "place": [0], "event_id": [None], "query": [None], "id_product": [None]}).astype({"place": "int32", "event_id": "Int64", "id_product": "Int64"})

    def close(self) -> None:
        pass


def histories(events: DataFrame, delay: str = "7 days", life_ms: int = LIFE_MS) -> DataFrame:
    """(session_id, kind, place, event_id, query, id_product), for the update output mode: each batch gives
    the whole histories (kind search, click or recent; place 1 is the newest) that it changes, and a row of
    kind gone for a session whose state has ended. ``events``: session_id, kind (also ``remove``: a recent
    query is taken away), query, id_product, results_count, event_id, ts."""
    own = events.where("session_id is not null and ts is not null and kind in ('search', 'no_results', 'click', 'remove')")
    own = own.select("session_id", "kind", "query", F.col("id_product").cast("long").alias("id_product"), F.col("results_count").cast("int").alias("results_count"), F.col("event_id").cast("long").alias("event_id"), F.unix_millis("ts").alias("ms"), "ts")
    return own.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(Histories(life_ms=life_ms), HISTORY, "Update", "EventTime")


def sessions(visits: DataFrame, gap: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(visitor, session_id, start, last, n_events) of (visitor, ts), each session once it has ended: the twin
    of ``with_sessions``. A pause of exactly the gap still belongs to a session."""
    window = F.session_window("ts", f"{gap} 1 microsecond")
    own = visits.withWatermark("ts", delay).groupBy("visitor", window).agg(F.count("*").alias("n_events"), F.min("ts").alias("start"), F.max("ts").alias("last"))
    return own.select("visitor", session_key(F.col("start"), F.col("visitor")).alias("session_id"), "start", "last", "n_events")


def attribution(conversions: DataFrame, clicks: DataFrame, lookback: str = "7 days", delay: str = "1 day") -> DataFrame:
    """The twin of ``attributed_within``, by an outer join of two streams: a conversion is given once the
    watermark says that no click for it can come. The state holds a click for the lookback."""
    bought = conversions.select("event_id", "session_id", "id_product", "amount", "ts").withWatermark("ts", delay)
    seen = clicks.select(F.col("session_id").alias("s"), F.col("id_product").alias("p"), F.col("query").alias("q"), "position", F.col("event_id").alias("e"), F.col("ts").alias("at")).withWatermark("at", delay)
    same = (F.col("session_id") == F.col("s")) & (F.col("id_product") == F.col("p"))
    rows = bought.join(seen, same & (F.col("at") <= F.col("ts")) & (F.col("at") >= F.col("ts") - F.expr(f"interval {lookback}")), "leftOuter")
    first = F.min(F.when(F.col("at").isNotNull(), F.struct("at", "e", "q", "position"))).alias("first")
    each = rows.groupBy("event_id", "session_id", "id_product", "amount", "ts").agg(first)
    return each.select("event_id", "session_id", "id_product", "amount", F.col("first.q").alias("source_query"), F.col("first.position").alias("source_position"), F.col("first").isNotNull().alias("attributed"))


def daily(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The twin of ``daily_stats``: (day, id_shop, searches, sessions, empty, avg_results), each day once it is
    final. Sessions are distinct exactly: events are summed by session first, then by day."""
    own = events.where(F.col("kind").isin("search", "no_results")).withWatermark("ts", delay)
    empty = F.count(F.when(F.col("kind") == "no_results", 1))
    by_session = own.groupBy(F.window("ts", "1 day"), "id_shop", "session_id").agg(F.count("*").alias("n"), empty.alias("empty"), F.sum("results_count").alias("results"))
    day = F.window(F.window_time("window"), "1 day")
    by_day = by_session.groupBy(day, "id_shop").agg(F.sum("n").alias("searches"), F.count("session_id").alias("sessions"), F.sum("empty").alias("empty"), F.sum("results").alias("results"))
    return by_day.select(F.to_date("window.start").alias("day"), "id_shop", "searches", "sessions", "empty", (F.col("results") / F.col("searches")).alias("avg_results"))


def stats_into(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, by_language: bool = False, **trigger):
    """Keeps ``query_stats`` of a stream in a table of buckets: each micro-batch is summed by query and shop,
    and only the buckets with its queries are rewritten. A batch that comes again counts once."""
    keys = [*STAT_KEYS, *["id_lang"] * by_language]

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_buckets(query_stats(batch, by_language), path, keys, merge_stats, batch_id, buckets)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
