"""Search statistics, reports and day views. Every fan-out join is avoided: each side is
aggregated to the join key first, then joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAT_KEYS = ["query", "id_shop"]


def query_stats(events: DataFrame, by_language: bool = False) -> DataFrame:
    """One row per query and shop (and language) from search and no_results events."""
    own = events.where(F.col("kind").isin("search", "no_results"))
    return own.groupBy(*STAT_KEYS, *["id_lang"] * by_language).agg(
        F.count("*").alias("search_count"), F.max_by("results_count", F.struct("ts", "event_id")).alias("results_count"),
        F.max("ts").alias("last_search"), F.min("ts").alias("date_add"),
    )


def merge_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored statistics with a later batch: counts add up, the last result count wins. Statistics by
    language (both have id_lang) stay so."""
    keys = [*STAT_KEYS, *["id_lang"] * ("id_lang" in old.columns)]
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(
        F.sum("search_count").alias("search_count"), F.max_by("results_count", "last_search").alias("results_count"),
        F.max("last_search").alias("last_search"), F.min("date_add").alias("date_add"),
    )


def clicks(events: DataFrame) -> DataFrame:
    return events.where("kind = 'click'").select("event_id", "query", "id_product", "position", "session_id", "id_shop", "ts")


def conversions(events: DataFrame) -> DataFrame:
    return events.where("kind = 'conversion'").select("event_id", "query", "id_product", F.col("event_id").alias("id_order"), "amount", "session_id", "id_shop", "ts")


def top_searches(stats: DataFrame, limit: int = 20) -> DataFrame:
    return stats.orderBy(F.desc("search_count"), "query", "id_shop").limit(limit).select("query", "id_shop", "search_count", "results_count")


def zero_results(stats: DataFrame, limit: int = 20) -> DataFrame:
    return top_searches(stats.where("results_count = 0"), limit)


def top_clicked(clicks: DataFrame, limit: int = 20) -> DataFrame:
    counts = clicks.groupBy("id_product").agg(F.count("*").alias("n_clicks"), (F.sum("position") / F.count("*")).alias("avg_position"))
    return counts.orderBy(F.desc("n_clicks"), "id_product").limit(limit)


def _percent(part: F.Column, whole: F.Column) -> F.Column:
    return F.round((part * 100).cast("decimal(20,6)") / whole.cast("decimal(20,0)"), 2).cast("double")


def click_through(stats: DataFrame, clicks: DataFrame, least: int = 10, limit: int = 50) -> DataFrame:
    """Clicks per search of queries with results, in percent."""
    own = stats.where((F.col("results_count") > 0) & (F.col("search_count") >= least))
    per = clicks.groupBy(*STAT_KEYS).agg(F.count("*").alias("n_clicks"))
    rows = own.join(per, STAT_KEYS, "left").withColumn("n_clicks", F.coalesce("n_clicks", F.lit(0)))
    rows = rows.withColumn("ctr", _percent(F.col("n_clicks"), F.col("search_count")))
    return rows.orderBy(F.desc("ctr"), "query", "id_shop").limit(limit).select(*STAT_KEYS, "search_count", "n_clicks", "ctr")


def conversion_rate(stats: DataFrame, conversions: DataFrame, least: int = 10, limit: int = 50) -> DataFrame:
    per = conversions.groupBy(*STAT_KEYS).agg(F.count("*").alias("n_conversions"), F.sum("amount").alias("revenue"))
    rows = stats.where(F.col("search_count") >= least).join(per, STAT_KEYS, "left")
    rows = rows.withColumn("n_conversions", F.coalesce("n_conversions", F.lit(0))).withColumn("revenue", F.coalesce("revenue", F.lit(0)).cast("double"))
    rows = rows.withColumn("rate", _percent(F.col("n_conversions"), F.col("search_count")))
    return rows.orderBy(F.desc("rate"), F.desc("revenue"), "query", "id_shop").limit(limit).select(*STAT_KEYS, "search_count", "n_conversions", "revenue", "rate")


def dashboard(stats: DataFrame, clicks: DataFrame, conversions: DataFrame) -> DataFrame:
    """One row of key figures; divisions by zero give 0."""
    s = stats.agg(
        F.sum("search_count").alias("searches"), F.countDistinct("query").alias("queries"),
        F.sum(F.when(F.col("results_count") == 0, F.col("search_count")).otherwise(0)).alias("empty"),
        F.sum(F.col("results_count") * F.col("search_count")).alias("weighted"),
    )
    c = clicks.agg(F.count("*").alias("clicks"))
    v = conversions.agg(F.count("*").alias("conversions"), F.coalesce(F.sum("amount"), F.lit(0)).alias("revenue"))
    one = s.crossJoin(c).crossJoin(v)  # one row each
    guard = lambda a, b, scale, k: F.when(F.coalesce(b, F.lit(0)) > 0, F.round((a * scale).cast("decimal(20,6)") / b.cast("decimal(20,0)"), k)).otherwise(0).cast("double")
    return one.select(
        "searches", "queries", "clicks", "conversions", F.col("revenue").cast("double").alias("revenue"),
        guard(F.col("empty"), F.col("searches"), 100, 2).alias("empty_rate"), guard(F.col("clicks"), F.col("searches"), 100, 2).alias("ctr"),
        guard(F.col("conversions"), F.col("clicks"), 100, 2).alias("conversion_rate"), guard(F.col("weighted"), F.col("searches"), 1, 1).alias("avg_results"),
        guard(F.col("revenue"), F.col("conversions"), 1, 2).alias("avg_order"),
    )


def trend(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("query").alias("n_queries"))


def daily_stats(events: DataFrame) -> DataFrame:
    own = events.where(F.col("kind").isin("search", "no_results"))
    return own.groupBy(F.to_date("ts").alias("day"), "id_shop").agg(
        F.count("*").alias("searches"), F.countDistinct("session_id").alias("sessions"),
        F.count(F.when(F.col("kind") == "no_results", 1)).alias("empty"), (F.sum("results_count") / F.count("*")).alias("avg_results"),
    )


def since(df: DataFrame, as_of: F.Column, days: int, column: str = "ts") -> DataFrame:
    """Rows of the last days: a retention filter and the window of the views."""
    return df.where(F.col(column) >= as_of - F.expr(f"interval {days} days"))


def view_top(events: DataFrame, as_of: F.Column, days: int = 30) -> DataFrame:
    own = since(events.where(F.col("kind").isin("search", "no_results")), as_of, days)
    return own.groupBy("query", "id_shop").agg(F.count("*").alias("searches"), F.countDistinct("session_id").alias("sessions"), (F.sum("results_count") / F.count("*")).alias("avg_results"))


def view_ctr(events: DataFrame, as_of: F.Column, days: int = 30) -> DataFrame:
    """Sessions that clicked after a search of the same query, over sessions that searched."""
    own = since(events, as_of, days)
    asked = own.where("kind = 'search'").select("query", "id_shop", "session_id").distinct()
    hit = own.where("kind = 'click'").select("query", "session_id").distinct().withColumn("clicked", F.lit(1))
    rows = asked.join(hit, ["query", "session_id"], "left").groupBy("query", "id_shop").agg(F.count("*").alias("sessions"), F.count("clicked").alias("clicked"))
    return rows.withColumn("ctr", F.coalesce(_percent(F.col("clicked"), F.nullif("sessions", F.lit(0))), F.lit(0.0)))


def view_revenue(events: DataFrame, as_of: F.Column, days: int = 30) -> DataFrame:
    own = since(conversions(events), as_of, days)
    return own.groupBy("query", "id_shop").agg(F.countDistinct("id_order").alias("orders"), F.countDistinct("session_id").alias("sessions"), F.sum("amount").cast("double").alias("revenue"))


def view_no_results(events: DataFrame, as_of: F.Column, days: int = 30) -> DataFrame:
    own = since(events.where("kind = 'no_results'"), as_of, days)
    return own.groupBy("query", "id_shop").agg(F.count("*").alias("searches"), F.max("ts").alias("last_seen"))
