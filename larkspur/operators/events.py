"""Events: parsing, cleaning, routing, histories and attribution (batch and stream alike)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_tags

MAX_TEXT, MAX_ITEMS, MAX_KEY, MAX_DEPTH = 1000, 100, 50, 5
EVENT = (
    "event_type string, shop_id string, session_id string, user_agent string, device_type string, timestamp string, page_url string, "
    "query string, results_count int, product_id bigint, product_name string, position int, price double, order_id bigint, "
    "last_search_query string, customer_id bigint, revenue double, currency string, "
    "products array<struct<product_id:bigint,product_name:string,quantity:int,price:double,total:double>>, "
    "search_history array<struct<query:string,results:int,timestamp:bigint>>, "
    "click_history array<struct<product_id:bigint,product_name:string,price:double,query:string,position:int,timestamp:bigint>>"
)
ROUTES = {"search": "search_events", "no_results": "search_events", "click": "click_events", "conversion": "conversion_events"}


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects as events; what is no object or has no type is dropped."""
    own = raw.withColumn("event", F.from_json(column, EVENT, {"mode": "PERMISSIVE"}))
    return own.where(F.ltrim(F.col(column)).startswith("{")).select("event.*").where("event_type is not null")


def clean(value: F.Column, kind: T.DataType, depth: int = 0) -> F.Column:
    """A value of this type made safe: texts cut to 1000 characters, then without tags; arrays to
    100 items; deeper than five levels nothing."""
    if isinstance(kind, T.StringType):
        return strip_tags(F.substring(value, 1, MAX_TEXT))
    if isinstance(kind, T.ArrayType):
        if depth >= MAX_DEPTH:
            return F.when(value.isNotNull(), F.array().cast(kind))
        return F.transform(F.slice(value, 1, MAX_ITEMS), lambda x: clean(x, kind.elementType, depth + 1))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(clean(value[f.name], f.dataType, depth + 1).alias(f.name) for f in kind)))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(F.regexp_replace(e["key"], "[^a-zA-Z0-9_]", "").alias("key"), clean(e["value"], kind.valueType, depth + 1).alias("value")))
        usable = F.filter(entries, lambda e: (F.length(e["key"]) > 0) & (F.length(e["key"]) <= MAX_KEY))
        return F.map_from_entries(usable)
    return value


def sanitize(events: DataFrame) -> DataFrame:
    return events.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in events.schema))


def classified(events: DataFrame) -> DataFrame:
    """A search without results is a no_results event."""
    kind = F.when((F.col("event_type") == "search") & (F.coalesce("results_count", F.lit(0)) == 0), "no_results").otherwise(F.col("event_type"))
    return events.withColumn("event_type", kind)


def routed(events: DataFrame, column: str = "event_type") -> DataFrame:
    """Adds the table an event belongs to; unknown kinds are dropped."""
    target = None
    for kind, name in ROUTES.items():
        target = F.when(F.col(column) == kind, F.lit(name)) if target is None else target.when(F.col(column) == kind, F.lit(name))
    return events.withColumn("target", target).where("target is not null")


def conversion_rows(events: DataFrame) -> DataFrame:
    """One row a product of each conversion; its query is the event's, else the last searched one."""
    own = events.where("event_type = 'conversion'")
    query = F.coalesce("query", "last_search_query").alias("query")
    return own.select("order_id", "shop_id", "session_id", "timestamp", query, F.inline_outer("products"))


def session_key(start: F.Column, visitor: F.Column) -> F.Column:
    """The id of a session: the time it starts and the visitor."""
    return F.concat(F.lit("ss_"), F.unix_millis(start.cast("timestamp")).cast("string"), F.lit("_"), F.substring(F.md5(visitor.cast("string")), 1, 9))


def with_sessions(visits: DataFrame, gap: str = "1 day") -> DataFrame:
    """Adds session_id to (visitor, ts, event_id): a visitor keeps a session until a pause longer than
    ``gap``; its id is made of the time it starts and the visitor."""
    order = Window.partitionBy("visitor").orderBy("ts", "event_id")
    fresh = F.coalesce(F.col("ts") > F.lag("ts").over(order) + F.expr(f"interval {gap}"), F.lit(True))
    numbered = visits.withColumn("__n", F.sum(fresh.cast("int")).over(order))
    start = F.min("ts").over(Window.partitionBy("visitor", "__n"))
    return numbered.withColumn("session_id", session_key(start, F.col("visitor"))).drop("__n")


def last_searches(events: DataFrame, keep: int = 10, expiry_days: int | None = None, as_of: F.Column | None = None) -> DataFrame:
    """The last searches with results of each session. A history lives ``expiry_days`` from its last
    entry: after a longer pause it starts anew, and at ``as_of`` it may be gone."""
    return _last(events.where("kind = 'search' and results_count > 0"), keep, expiry_days, as_of)


def last_clicks(events: DataFrame, keep: int = 20, expiry_days: int | None = None, as_of: F.Column | None = None) -> DataFrame:
    return _last(events.where("kind = 'click'"), keep, expiry_days, as_of)


def _last(events: DataFrame, keep: int, expiry_days: int | None, as_of: F.Column | None) -> DataFrame:
    newest = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    if expiry_days is not None:
        life = F.expr(f"interval {expiry_days} days")
        ends = F.when(F.lag("ts").over(newest) > F.col("ts") + life, 1).otherwise(0)  # the next entry came too late
        if as_of is not None:
            ends = F.when(F.lag("ts").over(newest).isNull() & (F.col("ts") + life < as_of), 1).otherwise(ends)
        events = events.withColumn("__ended", ends).withColumn("__ended", F.sum("__ended").over(newest)).where("__ended = 0").drop("__ended")
    return events.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= keep)


def without_query(recent: DataFrame, removed: DataFrame) -> DataFrame:
    """Recent queries (session_id, query, place) without those that were removed; the others move up."""
    left = recent.join(removed.select("session_id", "query"), ["session_id", "query"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("place")))


def recent_queries(events: DataFrame, keep: int = 5) -> DataFrame:
    """Last distinct queries of a session, newest first; a repeated query moves to the front."""
    own = events.where("kind in ('search', 'no_results')").groupBy("session_id", "query").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("last")))
    return own.withColumn("place", rank).where(F.col("place") <= keep).select("session_id", "query", "place")


def attributed(conversions: DataFrame, clicks: DataFrame, keep: int = 20) -> DataFrame:
    """Conversions with the earliest click on the same product among the session's last clicks."""
    history = last_clicks(clicks, keep).groupBy("session_id", "id_product").agg(F.min_by(F.struct("query", "position", "event_id"), F.struct("ts", "event_id")).alias("first"))
    rows = conversions.join(history, ["session_id", "id_product"], "left")
    return rows.select("event_id", "session_id", "id_product", "amount", F.col("first.query").alias("source_query"), F.col("first.position").alias("source_position"), F.col("first").isNotNull().alias("attributed"))


def attributed_within(conversions: DataFrame, clicks: DataFrame, lookback: str = "7 days") -> DataFrame:
    """Conversions with the session's earliest click on the same product within ``lookback`` before them,
    by an equi-join whose range is tested row by row; ties by event_id."""
    seen = clicks.select(F.col("session_id").alias("s"), F.col("id_product").alias("p"), F.struct(F.col("ts").alias("at"), "event_id", "query", "position").alias("click"))
    bought = conversions.select("event_id", "session_id", "id_product", "amount", "ts")
    within = (F.col("click.at") <= F.col("ts")) & (F.col("click.at") >= F.col("ts") - F.expr(f"interval {lookback}"))
    rows = bought.join(seen, (F.col("session_id") == F.col("s")) & (F.col("id_product") == F.col("p")) & within, "left")
    each = rows.groupBy("event_id", "session_id", "id_product", "amount", "ts").agg(F.min("click").alias("first"))
    return each.select("event_id", "session_id", "id_product", "amount", F.col("first.query").alias("source_query"), F.col("first.position").alias("source_position"), F.col("first").isNotNull().alias("attributed"))


def attribution_totals(rows: DataFrame) -> DataFrame:
    hits = F.count(F.when(F.col("attributed"), 1))
    rate = F.round((hits * 100).cast("decimal(20,6)") / F.nullif(F.count("*"), F.lit(0)).cast("decimal(20,0)"), 2).cast("double")
    return rows.agg(
        F.count("*").alias("n_lines"), hits.alias("n_attributed"),
        F.coalesce(F.sum(F.when(F.col("attributed"), F.col("amount"))), F.lit(0)).cast("double").alias("revenue"), F.coalesce(rate, F.lit(0.0)).alias("rate"),
    )
