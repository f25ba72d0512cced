"""Basket, report, suggestion and event queries with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators import baskets, events, reports, suggest
from ..sources import shop
from .views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAYS_BACK = 3650
NOW = shop.EVENTS_AS_OF


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# baskets
def pairs(spark, sf):
    return baskets.pair_counts(shop.order_lines(spark, sf), shop.order_heads(spark, sf), shop.ntz(shop.CATALOG_AS_OF), DAYS_BACK)


def edges(spark, sf):
    return baskets.correlations(baskets.most_frequent(pairs(spark, sf)))


query("pair_counts", with_views("SELECT * FROM pairs", "pairs"))(pairs)
_SPAN = 365
_DAY = f"DATE '{shop.CATALOG_AS_OF[:10]}' - CAST(k AS INTEGER)"


@query("pairs_sliding", with_views(f"""SELECT day, a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS n_orders FROM (SELECT CAST({_DAY} AS DATE) AS day FROM unnest(range(30)) AS g(k)) d
  JOIN orders ON CAST(o_orderdate AS DATE) <= day AND CAST(o_orderdate AS DATE) > day - {_SPAN} AND o_orderstatus IN ('F', 'O') JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
  GROUP BY 1, 2, 3 HAVING count(DISTINCT a.l_orderkey) >= 2"""))  # fmt: skip
def pairs_sliding(spark, sf):
    """Co-purchases over the year that ends on each of thirty days, from one count of each day's pairs."""
    days = spark.range(30).select(F.date_sub(F.to_date(F.lit(shop.CATALOG_AS_OF)), F.col("id").cast("int")).alias("day"))
    daily = baskets.daily_pairs(shop.order_lines(spark, sf), shop.order_heads(spark, sf))
    return baskets.counts_on(baskets.sliding_counts(daily, _SPAN, 2), days, 2)


query("correlations", with_views("SELECT * FROM edges", "edges"))(edges)


@query("correlation_stats", with_views("SELECT count(*) AS n_edges, count(DISTINCT id_source) AS n_products, CAST(round(CAST(sum(score) AS DECIMAL(20, 10)) / count(*), 4) AS DOUBLE) AS avg_score FROM edges", "edges"))
def correlation_stats(spark, sf):
    return baskets.correlation_stats(edges(spark, sf))


@query("correlation_stats_dated", with_views("SELECT count(*) AS n_edges, count(DISTINCT id_source) AS n_products, CAST(round(CAST(sum(score) AS DECIMAL(20, 10)) / count(*), 4) AS DOUBLE) AS avg_score, TIMESTAMP '2001-08-02' + to_days(CAST(max(id_source) AS INTEGER)) AS last_update FROM edges", "edges"))
def correlation_stats_dated(spark, sf):
    dated = edges(spark, sf).withColumn("date_upd", F.expr(f"timestamp_ntz'{shop.CATALOG_AS_OF}' + make_dt_interval(cast(id_source as int))"))
    return baskets.correlation_stats(dated)


@query("correlations_merged", with_views("SELECT count(*) AS n, CAST(sum(n_orders) AS BIGINT) AS orders FROM (SELECT n_orders FROM edges UNION ALL SELECT 7)", "edges"))
def correlations_merged(spark, sf):
    new = edges(spark, sf)
    old = new.limit(50).withColumn("n_orders", F.lit(999).cast("bigint"))
    extra = shop.literal(spark, [(-1, -2, 7)], "id_source bigint, id_target bigint, n_orders bigint").select("id_source", "id_target", F.lit(0).cast("decimal(5,4)").alias("score"), "n_orders")
    return baskets.merge_edges(old.unionByName(extra), new).agg(F.count("*").alias("n"), F.sum("n_orders").alias("orders"))


_ITEM = "(SELECT min(id_source) FROM edges)"


@query("recs_item", with_views(f"SELECT id_product, score, n_orders, name FROM (SELECT id_target AS id_product, score, n_orders FROM edges WHERE id_source = {_ITEM}) JOIN catalog USING (id_product) ORDER BY score DESC, n_orders DESC, id_product LIMIT 8", "edges", "catalog"))
def recs_item(spark, sf):
    own = edges(spark, sf)
    return baskets.for_item(own, shop.catalog(spark, sf), own.agg(F.min("id_source")).scalar())


@query("recs_fallback_category", with_views("SELECT id_product, CAST(0 AS DECIMAL(5, 4)) AS score, CAST(0 AS BIGINT) AS n_orders, name FROM catalog WHERE id_product <> 10 AND id_category = (SELECT id_category FROM catalog WHERE id_product = 10) ORDER BY md5(CAST(id_product AS VARCHAR)), id_product LIMIT 8", "catalog"))
def recs_fallback_category(spark, sf):
    none = edges(spark, sf).where("id_source < 0")
    return baskets.for_item(none, shop.catalog(spark, sf), 10)


@query("recs_cart", with_views("""SELECT id_product, CAST(sum(score) AS DOUBLE) AS score, CAST(sum(n_orders) AS BIGINT) AS n_orders, name FROM (SELECT id_target AS id_product, score, n_orders FROM edges
  WHERE id_source IN (SELECT id_source FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) AND id_target NOT IN (SELECT id_source FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3))
  JOIN catalog USING (id_product) GROUP BY id_product, name ORDER BY 2 DESC, 3 DESC, 1 LIMIT 8""", "edges", "catalog"))  # fmt: skip
def recs_cart(spark, sf):
    own = edges(spark, sf)
    cart = own.groupBy("id_source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id_source").limit(3).select(F.col("id_source").alias("id_product"))
    return baskets.for_cart_rows(own, shop.catalog(spark, sf), shop.sales(spark, sf), cart, least=1)


@query("recs_fallback_bestseller", with_views("SELECT id_product, CAST(0 AS DOUBLE) AS score, coalesce(sold, 0) AS n_orders, name FROM catalog LEFT JOIN sales USING (id_product) WHERE id_product NOT IN (1, 2) ORDER BY 3 DESC, 1 LIMIT 8", "catalog", "sales"))
def recs_fallback_bestseller(spark, sf):
    none = edges(spark, sf).where("id_source < 0")
    return baskets.for_cart(none, shop.catalog(spark, sf), shop.sales(spark, sf), [1, 2])


# reports
def stats(spark, sf):
    return reports.query_stats(shop.behaviour(spark, sf))


def clicks(spark, sf):
    return reports.clicks(shop.behaviour(spark, sf))


def conversions(spark, sf):
    return reports.conversions(shop.behaviour(spark, sf))


query("query_stats", with_views("SELECT * FROM stats", "stats"))(stats)


@query("query_stats_by_language", with_views("SELECT query, id_shop, id_lang, count(*) AS search_count, arg_max(results_count, (ts, event_id)) AS results_count, max(ts) AS last_search, min(ts) AS date_add FROM behaviour WHERE kind IN ('search', 'no_results') GROUP BY 1, 2, 3", "behaviour"))
def query_stats_by_language(spark, sf):
    return reports.query_stats(shop.behaviour(spark, sf), by_language=True)


@query("query_stats_merged", with_views("SELECT query, id_shop, search_count, results_count, last_search, date_add FROM stats", "stats"))
def query_stats_merged(spark, sf):
    ev = shop.behaviour(spark, sf)
    cut = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    return reports.merge_stats(reports.query_stats(ev.where(F.col("ts") < cut)), reports.query_stats(ev.where(F.col("ts") >= cut)))


@query("query_stats_merged_by_language", ORACLES["query_stats_by_language"])
def query_stats_merged_by_language(spark, sf):
    ev = shop.behaviour(spark, sf)
    cut = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    parts = [reports.query_stats(ev.where(test), by_language=True) for test in (F.col("ts") < cut, F.col("ts") >= cut)]
    return reports.merge_stats(*parts)


@query("top_searches", with_views("SELECT query, id_shop, search_count, results_count FROM stats ORDER BY search_count DESC, query, id_shop LIMIT 20", "stats"))
def top_searches(spark, sf):
    return reports.top_searches(stats(spark, sf))


@query("zero_results", with_views("SELECT query, id_shop, search_count, results_count FROM stats WHERE results_count = 0 ORDER BY search_count DESC, query, id_shop LIMIT 20", "stats"))
def zero_results(spark, sf):
    return reports.zero_results(stats(spark, sf))


@query("top_clicked", with_views("SELECT id_product, count(*) AS n_clicks, CAST(sum(position) AS DOUBLE) / count(*) AS avg_position FROM clicks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "clicks"))
def top_clicked(spark, sf):
    return reports.top_clicked(clicks(spark, sf))


@query("ctr", with_views("""SELECT query, id_shop, search_count, coalesce(n, 0) AS n_clicks, CAST(round(CAST(coalesce(n, 0) * 100 AS DECIMAL(20, 6)) / search_count, 2) AS DOUBLE) AS ctr FROM stats LEFT JOIN (SELECT query, id_shop, count(*) AS n FROM clicks GROUP BY 1, 2) USING (query, id_shop)
  WHERE results_count > 0 AND search_count >= 10 ORDER BY ctr DESC, query, id_shop LIMIT 50""", "stats", "clicks"))  # fmt: skip
def ctr(spark, sf):
    return reports.click_through(stats(spark, sf), clicks(spark, sf))


@query("conversion_rate", with_views("""SELECT query, id_shop, search_count, coalesce(n, 0) AS n_conversions, CAST(coalesce(r, 0) AS DOUBLE) AS revenue, CAST(round(CAST(coalesce(n, 0) * 100 AS DECIMAL(20, 6)) / search_count, 2) AS DOUBLE) AS rate
  FROM stats LEFT JOIN (SELECT query, id_shop, count(*) AS n, sum(amount) AS r FROM conv GROUP BY 1, 2) USING (query, id_shop) WHERE search_count >= 10 ORDER BY rate DESC, revenue DESC, query, id_shop LIMIT 50""", "stats", "conv"))  # fmt: skip
def conversion_rate(spark, sf):
    return reports.conversion_rate(stats(spark, sf), conversions(spark, sf))


@query("dashboard", with_views("""SELECT searches, queries, clicks, conversions, CAST(revenue AS DOUBLE) AS revenue, CAST(round(CAST(empty * 100 AS DECIMAL(20, 6)) / searches, 2) AS DOUBLE) AS empty_rate, CAST(round(CAST(clicks * 100 AS DECIMAL(20, 6)) / searches, 2) AS DOUBLE) AS ctr,
  CAST(round(CAST(conversions * 100 AS DECIMAL(20, 6)) / clicks, 2) AS DOUBLE) AS conversion_rate, CAST(round(CAST(weighted AS DECIMAL(20, 6)) / searches, 1) AS DOUBLE) AS avg_results, CAST(round(CAST(revenue AS DECIMAL(20, 6)) / conversions, 2) AS DOUBLE) AS avg_order
  FROM (SELECT CAST(sum(search_count) AS BIGINT) AS searches, count(DISTINCT query) AS queries, CAST(sum(CASE WHEN results_count = 0 THEN search_count ELSE 0 END) AS BIGINT) AS empty, CAST(sum(results_count * search_count) AS BIGINT) AS weighted FROM stats),
  (SELECT count(*) AS clicks FROM clicks), (SELECT count(*) AS conversions, sum(amount) AS revenue FROM conv)""", "stats", "clicks", "conv"))  # fmt: skip
def dashboard(spark, sf):
    return reports.dashboard(stats(spark, sf), clicks(spark, sf), conversions(spark, sf))


@query("search_trend", with_views("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT query) AS n_queries FROM clicks GROUP BY 1", "clicks"))
def search_trend(spark, sf):
    return reports.trend(clicks(spark, sf))


@query("daily_stats", with_views("SELECT CAST(ts AS DATE) AS day, id_shop, count(*) AS searches, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE kind = 'no_results') AS empty, CAST(sum(results_count) AS DOUBLE) / count(*) AS avg_results FROM behaviour WHERE kind IN ('search', 'no_results') GROUP BY 1, 2", "behaviour"))
def daily_stats(spark, sf):
    return reports.daily_stats(shop.behaviour(spark, sf))


_30 = "ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS"


@query("view_top_searches", with_views(f"SELECT query, id_shop, count(*) AS searches, count(DISTINCT session_id) AS sessions, CAST(sum(results_count) AS DOUBLE) / count(*) AS avg_results FROM behaviour WHERE kind IN ('search', 'no_results') AND {_30} GROUP BY 1, 2", "behaviour"))
def view_top_searches(spark, sf):
    return reports.view_top(shop.behaviour(spark, sf), shop.ntz(NOW))


@query("view_ctr", with_views(f"""SELECT query, id_shop, count(*) AS sessions, count(h) AS clicked, CAST(round(CAST(count(h) * 100 AS DECIMAL(20, 6)) / count(*), 2) AS DOUBLE) AS ctr
  FROM (SELECT DISTINCT query, id_shop, session_id FROM behaviour WHERE kind = 'search' AND {_30}) LEFT JOIN (SELECT DISTINCT query, session_id, 1 AS h FROM behaviour WHERE kind = 'click' AND {_30}) USING (query, session_id) GROUP BY 1, 2""", "behaviour"))  # fmt: skip
def view_ctr(spark, sf):
    return reports.view_ctr(shop.behaviour(spark, sf), shop.ntz(NOW))


@query("view_revenue", with_views(f"SELECT query, id_shop, count(DISTINCT id_order) AS orders, count(DISTINCT session_id) AS sessions, CAST(sum(amount) AS DOUBLE) AS revenue FROM conv WHERE {_30} GROUP BY 1, 2", "conv"))
def view_revenue(spark, sf):
    return reports.view_revenue(shop.behaviour(spark, sf), shop.ntz(NOW))


@query("view_no_results", with_views(f"SELECT query, id_shop, count(*) AS searches, max(ts) AS last_seen FROM behaviour WHERE kind = 'no_results' AND {_30} GROUP BY 1, 2", "behaviour"))
def view_no_results(spark, sf):
    return reports.view_no_results(shop.behaviour(spark, sf), shop.ntz(NOW))


@query("retention", with_views("SELECT kind, count(*) AS n FROM behaviour WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS GROUP BY 1", "behaviour"))
def retention(spark, sf):
    return reports.since(shop.behaviour(spark, sf), shop.ntz(NOW), 10).groupBy("kind").agg(F.count("*").alias("n"))


# suggestions
@query("suggest_popular", with_views("SELECT query, n FROM totals WHERE results > 0 AND n >= 2 AND starts_with(query, 'q1') ORDER BY n DESC, query LIMIT 5", "totals"))
def suggest_popular(spark, sf):
    return suggest.popular(stats(spark, sf), "q1")


@query("suggest_related", with_views("SELECT query, n FROM totals WHERE results > 0 AND n >= 2 AND contains(query, '7') ORDER BY n DESC, query LIMIT 8", "totals"))
def suggest_related(spark, sf):
    return suggest.related(stats(spark, sf), "7")


@query("suggest_product", with_views("SELECT DISTINCT array_to_string(string_split(name, ' ')[1:3], ' ') AS query FROM catalog WHERE starts_with(lower(name), 'co') ORDER BY 1 LIMIT 5", "catalog"))
def suggest_product(spark, sf):
    return suggest.product_names(shop.catalog(spark, sf), "Co")


@query("suggest_brand", with_views("SELECT DISTINCT brand AS query FROM catalog WHERE starts_with(lower(brand), 'brand#1') ORDER BY 1 LIMIT 3", "catalog"))
def suggest_brand(spark, sf):
    return suggest.brands(shop.catalog(spark, sf), "brand#1")


def _staged_sql(text: str) -> str:
    """All four stages: a term that is there already is not given again."""
    lower = text.lower()
    return f"""SELECT '{text}' AS text, * FROM (WITH pool AS (SELECT query, n FROM totals WHERE results > 0 AND n >= 2 AND contains(query, '{lower}')),
    one AS (SELECT query, 'popular' AS stage FROM pool WHERE starts_with(query, '{lower}') ORDER BY n DESC, query LIMIT 5),
    two AS (SELECT query, 'related' AS stage FROM (SELECT query, row_number() OVER (ORDER BY n DESC, query) AS r FROM pool WHERE query NOT IN (SELECT query FROM one)) WHERE r <= 8 - (SELECT count(*) FROM one)),
    a AS (SELECT * FROM one UNION ALL SELECT * FROM two),
    three AS (SELECT query, 'product' AS stage FROM (SELECT query, row_number() OVER (ORDER BY query) AS r FROM (SELECT DISTINCT array_to_string(string_split(name, ' ')[1:3], ' ') AS query FROM catalog WHERE starts_with(lower(name), '{lower}')))
      WHERE r <= 5 - (SELECT count(*) FROM a) AND lower(query) NOT IN (SELECT lower(query) FROM a)),
    b AS (SELECT * FROM a UNION ALL SELECT * FROM three),
    four AS (SELECT query, 'brand' AS stage FROM (SELECT DISTINCT brand AS query FROM catalog WHERE starts_with(lower(brand), '{lower}') ORDER BY 1 LIMIT 3) WHERE (SELECT count(*) FROM b) < 8 AND lower(query) NOT IN (SELECT lower(query) FROM b))
    SELECT * FROM b UNION ALL SELECT * FROM four)"""


STARTS = ["bl", "q1", "q98", "7", "Brand#1", "co"]


@query("suggest_staged", with_views(" UNION ALL ".join(f"SELECT * FROM ({_staged_sql(t)})" for t in STARTS), "totals", "catalog"))
def suggest_staged(spark, sf):
    texts = shop.literal(spark, list(enumerate(STARTS)), "query_id bigint, text string")
    found = suggest.staged_for(stats(spark, sf), shop.catalog(spark, sf), texts)
    return found.join(F.broadcast(texts), "query_id").select("text", "query", "stage")


_LIKE = "levenshtein(query, 'q101')"


@query("dym_popular", with_views(f"""SELECT query, CAST(greatest(CASE WHEN {_LIKE} > 0 AND {_LIKE} <= ceil(0.3 * greatest(length(query), 4)) THEN n - 10 * {_LIKE} END, CASE WHEN query <> 'q101' AND (contains(query, 'q101') OR contains('q101', query)) THEN n END) AS BIGINT) AS score
  FROM (SELECT * FROM totals WHERE results > 0 AND n >= 3 ORDER BY n DESC, query LIMIT 200) WHERE score IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 3""", "totals"))  # fmt: skip
def dym_popular(spark, sf):
    return suggest.did_you_mean_popular(stats(spark, sf), "q101")


@query("dym_product", with_views("SELECT DISTINCT lower(name) AS query FROM catalog WHERE (contains(lower(name), 'cold') OR contains(lower(name), 'ring')) AND length(name) >= 4 ORDER BY 1 LIMIT 2", "catalog"))
def dym_product(spark, sf):
    return suggest.did_you_mean_product(shop.catalog(spark, sf), "cold ring set")


@query("dym_brand", with_views("SELECT query, CAST(levenshtein(lower(query), 'brnd#13') AS INTEGER) AS d FROM (SELECT DISTINCT brand AS query FROM catalog) WHERE levenshtein(lower(query), 'brnd#13') BETWEEN 1 AND 2 ORDER BY 2, 1 LIMIT 2", "catalog"))
def dym_brand(spark, sf):
    return suggest.did_you_mean_brand(shop.catalog(spark, sf), "brnd#13")


def _dym_sql(text: str) -> str:
    """Popular queries, names and brands, each term once, without the text itself."""
    d = f"levenshtein(query, '{text}')"
    words = [w for w in text.split(" ") if len(w) >= 3]
    names = " OR ".join(f"contains(lower(name), '{w}')" for w in words) or "false"
    return f"""SELECT '{text}' AS text, query, CAST(min(step) AS INTEGER) AS step FROM (
    SELECT query, 1 AS step FROM (SELECT query, greatest(CASE WHEN {d} > 0 AND {d} <= ceil(0.3 * greatest(length(query), {len(text)})) THEN n - 10 * {d} END, CASE WHEN query <> '{text}' AND (contains(query, '{text}') OR contains('{text}', query)) THEN n END) AS score
      FROM (SELECT * FROM totals WHERE results > 0 AND n >= 3 ORDER BY n DESC, query LIMIT 200) WHERE score IS NOT NULL ORDER BY score DESC, query LIMIT 3)
    UNION ALL SELECT query, 2 FROM (SELECT DISTINCT lower(array_to_string(string_split(name, ' ')[1:3], ' ')) AS query FROM catalog WHERE ({names})) WHERE length(query) >= 4 AND query <> '{text}' AND query IN (SELECT DISTINCT lower(array_to_string(string_split(name, ' ')[1:3], ' ')) AS q FROM catalog WHERE ({names}) AND length(name) >= 4 AND lower(array_to_string(string_split(name, ' ')[1:3], ' ')) <> '{text}' ORDER BY q LIMIT 2)
    UNION ALL SELECT lower(query), 3 FROM (SELECT query, d FROM (SELECT brand AS query, 0 AS d FROM (SELECT DISTINCT brand FROM catalog) WHERE contains(lower(brand), '{text}') AND lower(brand) <> '{text}'
      UNION ALL SELECT brand, levenshtein(lower(brand), '{text}') FROM (SELECT DISTINCT brand FROM catalog) WHERE levenshtein(lower(brand), '{text}') BETWEEN 1 AND 2
        AND NOT EXISTS (SELECT 1 FROM catalog WHERE contains(lower(brand), '{text}') AND lower(brand) <> '{text}')) ORDER BY d, query LIMIT 2)
  ) WHERE query <> '{text}' GROUP BY query ORDER BY 3, 2 LIMIT 5"""


MEANT = ["q101", "cold ring set", "brnd#13", "brand#1"]


@query("did_you_mean", with_views(" UNION ALL ".join(f"SELECT * FROM ({_dym_sql(t)})" for t in MEANT), "totals", "catalog"))
def did_you_mean(spark, sf):
    parts = [suggest.did_you_mean(stats(spark, sf), shop.catalog(spark, sf), t).select(F.lit(t).alias("text"), "query", "step") for t in MEANT]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("spelled_alike", with_views("SELECT query, CAST(levenshtein(query, 'q9x') AS INTEGER) AS d, n FROM totals WHERE n > 5 AND levenshtein(query, 'q9x') BETWEEN 1 AND ceil(greatest(length(query), 3) / 4.0) ORDER BY 2, 3 DESC, 1 LIMIT 3", "totals"))
def spelled_alike(spark, sf):
    return suggest.spelled_alike(stats(spark, sf), "q9x")


@query("match_spans", with_views("SELECT query, CAST(instr(query, '7') AS INTEGER) AS at, CASE WHEN contains(query, '7') THEN '7' ELSE '' END AS part, n > 10 AS is_popular FROM totals", "totals"))
def match_spans(spark, sf):
    at, part = suggest.match_span(F.col("query"), "7")
    return suggest.totals(stats(spark, sf)).select("query", at.alias("at"), part.alias("part"), (F.col("n") > 10).alias("is_popular"))


# events
def raw_events(spark, sf):
    """The events table as JSON envelopes, as a stream would bring them."""
    ev = shop.table(spark, sf, "events").where("event_type in ('view', 'error', 'click', 'purchase', 'signup')")
    kind = F.when(F.col("event_type").isin("view", "error"), "search").when(F.col("event_type") == "purchase", "conversion").otherwise(F.col("event_type"))
    count = F.when(F.col("event_type") == "view", F.lit(3)).when(F.col("event_type") == "error", F.lit(0))
    body = F.struct(kind.alias("event_type"), F.concat(F.lit("<b>q</b>"), F.get_json_object("props", "$.k")).alias("query"), count.alias("results_count"), (F.col("event_id") % 200).alias("product_id"), F.concat(F.lit("ss_"), F.col("user_id").cast("string")).alias("session_id"))
    bad = spark.range(3).select(F.element_at(F.array(F.lit("null"), F.lit("[1]"), F.lit("{}")), (F.col("id") + 1).cast("int")).alias("value"))
    return ev.select(F.to_json(body).alias("value")).unionByName(bad)


@query("event_routing", "SELECT CASE event_type WHEN 'click' THEN 'click_events' WHEN 'purchase' THEN 'conversion_events' ELSE 'search_events' END AS target, CASE event_type WHEN 'view' THEN 'search' WHEN 'error' THEN 'no_results' WHEN 'purchase' THEN 'conversion' ELSE event_type END AS event_type, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1, 2")
def event_routing(spark, sf):
    own = events.routed(events.classified(events.parse(raw_events(spark, sf))))
    return own.groupBy("target", "event_type").agg(F.count("*").alias("n"))


@query("event_sanitize", "SELECT 'q' || json_extract_string(props, '$.k') AS query, count(*) AS n FROM events GROUP BY 1")
def event_sanitize(spark, sf):
    return events.sanitize(events.parse(raw_events(spark, sf))).groupBy("query").agg(F.count("*").alias("n"))


@query("search_history_10", with_views("SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS age FROM behaviour WHERE kind = 'search' AND results_count > 0 QUALIFY age <= 10", "behaviour"))
def search_history_10(spark, sf):
    return events.last_searches(shop.behaviour(spark, sf)).select("session_id", "event_id", "age")


@query("click_history_20", with_views("SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS age FROM clicks QUALIFY age <= 20", "clicks"))
def click_history_20(spark, sf):
    return events.last_clicks(shop.behaviour(spark, sf)).select("session_id", "event_id", "age")


@query("recent_searches_5", with_views("SELECT session_id, query, CAST(row_number() OVER (PARTITION BY session_id ORDER BY t DESC, e DESC) AS INTEGER) AS place FROM (SELECT session_id, query, max(ts) AS t, arg_max(event_id, (ts, event_id)) AS e FROM behaviour WHERE kind IN ('search', 'no_results') GROUP BY 1, 2) QUALIFY place <= 5", "behaviour"))
def recent_searches_5(spark, sf):
    return events.recent_queries(shop.behaviour(spark, sf))


def _life_sql(rows: str, keep: int) -> str:
    """The last entries of the histories that are alive at the end of January."""
    return f"""SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS age FROM (
    SELECT *, sum(CASE WHEN coalesce(later, TIMESTAMP '2024-01-31') > ts + INTERVAL 7 DAYS THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS ended
    FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS later FROM {rows})) WHERE ended = 0 QUALIFY age <= {keep}"""


@query("search_history_alive", with_views(_life_sql("(SELECT * FROM behaviour WHERE kind = 'search' AND results_count > 0)", 10), "behaviour"))
def search_history_alive(spark, sf):
    return events.last_searches(shop.behaviour(spark, sf), 10, 7, shop.ntz(NOW)).select("session_id", "event_id", "age")


@query("click_history_alive", with_views(_life_sql("clicks", 20), "clicks"))
def click_history_alive(spark, sf):
    return events.last_clicks(shop.behaviour(spark, sf), 20, 7, shop.ntz(NOW)).select("session_id", "event_id", "age")


@query("recent_searches_removed", with_views("""SELECT session_id, query, CAST(row_number() OVER (PARTITION BY session_id ORDER BY place) AS INTEGER) AS place FROM (
  SELECT session_id, query, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, e DESC) AS place FROM (SELECT session_id, query, max(ts) AS t, arg_max(event_id, (ts, event_id)) AS e FROM behaviour WHERE kind IN ('search', 'no_results') GROUP BY 1, 2) QUALIFY place <= 5
  ) WHERE query NOT LIKE '%3'""", "behaviour"))  # fmt: skip
def recent_searches_removed(spark, sf):
    recent = events.recent_queries(shop.behaviour(spark, sf))
    return events.without_query(recent, recent.where("query like '%3'"))


@query("sessions", """SELECT event_id, 'ss_' || (epoch_us(min(ts) OVER (PARTITION BY user_id, n)) // 1000) || '_' || left(md5(CAST(user_id AS VARCHAR)), 9) AS session_id FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (
    SELECT *, CASE WHEN coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY, true) THEN 1 ELSE 0 END AS fresh FROM events))""")  # fmt: skip
def sessions(spark, sf):
    visits = shop.table(spark, sf, "events").select(F.col("user_id").alias("visitor"), "ts", "event_id")
    return events.with_sessions(visits).select("event_id", "session_id")


_FIRST = """SELECT c.event_id, c.session_id, c.id_product, c.amount, h.query AS source_query, h.position AS source_position, h.event_id IS NOT NULL AS attributed FROM conv c LEFT JOIN
  (SELECT * FROM (SELECT * FROM clicks QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) <= 20) QUALIFY row_number() OVER (PARTITION BY session_id, id_product ORDER BY ts, event_id) = 1) h
  ON h.session_id = c.session_id AND h.id_product = c.id_product"""


def attribution(spark, sf):
    return events.attributed(conversions(spark, sf), shop.behaviour(spark, sf))


query("attribution", with_views(_FIRST, "conv", "clicks"))(attribution)


@query("attribution_within", with_views("""SELECT c.event_id, c.session_id, c.id_product, c.amount, h.query AS source_query, h.position AS source_position, h.event_id IS NOT NULL AS attributed FROM conv c LEFT JOIN clicks h
  ON h.session_id = c.session_id AND h.id_product = c.id_product AND h.ts <= c.ts AND h.ts >= c.ts - INTERVAL 7 DAYS QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY h.ts, h.event_id) = 1""", "conv", "clicks"))
def attribution_within(spark, sf):
    return events.attributed_within(conversions(spark, sf), clicks(spark, sf))


def sold_lines(spark, sf):
    """Each order as the JSON text of a conversion, with its lines; every third order names no query itself."""
    line = F.struct(F.col("l_partkey").alias("product_id"), F.concat(F.lit("<i>p</i>"), F.col("l_partkey")).alias("product_name"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").alias("price"))
    own = shop.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("lines"))
    query = F.when(F.col("l_orderkey") % 3 > 0, F.concat(F.lit("q"), F.col("l_orderkey") % 7))
    body = F.struct(F.lit("conversion").alias("event_type"), F.col("l_orderkey").alias("order_id"), F.concat(F.lit("s"), F.col("l_orderkey") % 50).alias("session_id"), query.alias("query"), F.lit("last<br>").alias("last_search_query"), F.transform("lines", lambda x: x["line"]).alias("products"))
    return own.select(F.to_json(body).alias("value"))


@query("conversion_rows", "SELECT l_orderkey AS order_id, 's' || (l_orderkey % 50) AS session_id, CASE WHEN l_orderkey % 3 > 0 THEN 'q' || (l_orderkey % 7) ELSE 'last' END AS query, l_partkey AS product_id, 'p' || l_partkey AS product_name, CAST(trunc(l_quantity) AS INTEGER) AS quantity FROM lineitem")
def conversion_rows(spark, sf):
    """A row for each product of each conversion, cleaned; without a query the last searched one counts."""
    own = events.conversion_rows(events.sanitize(events.parse(sold_lines(spark, sf))))
    return own.select("order_id", "session_id", "query", "product_id", "product_name", "quantity")


@query("sanitize_nested", """SELECT o_custkey AS id, least(count(*), 100) AS n_items, CAST(sum(CASE WHEN r <= 100 THEN length('o' || o_orderkey) ELSE 0 END) AS BIGINT) AS n_chars, 1 AS n_keys, 0 AS n_deep
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1""")  # fmt: skip
def sanitize_nested(spark, sf):
    """Arrays are cut to 100 items, texts lose their tags, keys what isn't a letter, digit or _ (too long and
    empty ones go), and nothing is left below the fifth level."""
    items = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("<b>o</b>"), k))
    deep = F.lit(1)
    for _ in range(7):
        deep = F.array(deep)
    keys = F.create_map(F.lit("a-b c"), F.lit("x"), F.lit("!!"), F.lit("y"), F.lit("k" * 51), F.lit("z"))
    own = shop.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(items.alias("items"), F.first(deep).alias("deep"), F.first(keys).alias("named"))
    safe = events.sanitize(own)
    level = F.col("deep")
    for _ in range(5):
        level = level[0]
    n_keys = F.size(F.filter(F.map_keys("named"), lambda k: k == "abc")) + F.size("named") - 1
    return safe.select("id", F.size("items").cast("long").alias("n_items"), F.length(F.array_join("items", "")).cast("long").alias("n_chars"), n_keys.alias("n_keys"), F.size(level).alias("n_deep"))


@query("attribution_rate", with_views(f"SELECT count(*) AS n_lines, count(*) FILTER (WHERE attributed) AS n_attributed, CAST(coalesce(sum(amount) FILTER (WHERE attributed), 0) AS DOUBLE) AS revenue, CAST(round(CAST(count(*) FILTER (WHERE attributed) * 100 AS DECIMAL(20, 6)) / count(*), 2) AS DOUBLE) AS rate FROM ({_FIRST})", "conv", "clicks"))
def attribution_rate(spark, sf):
    return events.attribution_totals(attribution(spark, sf))


@query("order_revenue", "SELECT l_orderkey AS id_order, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(20, 6))), 2) AS DOUBLE) AS revenue, count(*) AS n_lines FROM lineitem GROUP BY 1")
def order_revenue(spark, sf):
    return shop.order_lines(spark, sf).groupBy("id_order").agg(F.round(F.sum("line_total"), 2).cast("double").alias("revenue"), F.count("*").alias("n_lines"))
