"""Co-purchase correlations and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .postings import scan
from .search import estimated_bytes

#: Correlations are made of so many pairs; pairs themselves are never cut.
EDGE_CAP = 10_000
#: By the planner's estimate (two columns of a Parquet file), lines whose baskets and pairs are one task's.
PLACE_BYTES = 1 << 18


def pair_counts(lines: DataFrame, heads: DataFrame, as_of: F.Column, days_back: int = 180, min_support: int = 2) -> DataFrame:
    """Unordered product pairs of valid orders in the window: (a, b, n_orders), a < b; all of them, in no
    order."""
    since = F.expr(f"interval {days_back} days")
    own = heads.where("valid").where(F.col("date_add") >= as_of - since).select("id_order")
    n = places(lines)
    # not a semi-join, which the optimizer would take out to before the lines are dealt; baskets are sets
    pairs = basket_pairs(dealt(lines, n).join(own, "id_order")).repartition(n, "a", "b")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n_orders"))
    return counts.where(F.col("n_orders") >= min_support)


def most_frequent(pairs: DataFrame, cap: int = EDGE_CAP) -> DataFrame:
    """The pairs that correlations are made of."""
    return pairs.orderBy(F.desc("n_orders"), "a", "b").limit(cap)


def places(lines: DataFrame) -> int:
    """How many tasks take the baskets and pairs of these lines: in proportion to the lines, so that a task's
    share stays the same. Left to itself Spark sizes tasks by the lines' shuffled bytes, of which pairs are a
    multiple, and counts them in hash tables before and after the shuffle though few repeat within a task."""
    size = estimated_bytes(lines.select("id_order", "id_product"))
    return int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size is None else max(1, -(-size // PLACE_BYTES))


def dealt(lines: DataFrame, n: int) -> DataFrame:
    return lines.select("id_order", "id_product").repartition(n, "id_order")


def basket_pairs(lines: DataFrame, *more: str) -> DataFrame:
    """(a, b), a < b, once for each order that has both; ``more``: columns of the order that stay. Lines
    are read once: a basket is gathered and its pairs spelt out, so its size, not the catalogue, bounds
    what is held."""
    baskets = lines.groupBy("id_order", *more).agg(F.sort_array(F.collect_set("id_product")).alias("items"))
    each = baskets.where(F.size("items") > 1).select(*more, "items", F.posexplode("items").alias("at", "a"))
    return each.select(*more, "a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b"))


def daily_pairs(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(day, a, b, n) of valid orders: what a sliding window is made of. A day's rows don't change once
    its orders are in, so they are stored by day and never counted again."""
    own = heads.where("valid").select("id_order", F.to_date("date_add").alias("day"))
    n = places(lines)
    pairs = basket_pairs(dealt(lines, n).join(own, "id_order"), "day").repartition(n, "a", "b")
    return pairs.groupBy("day", "a", "b").agg(F.count("*").alias("n"))


def sliding_counts(daily: DataFrame, days_back: int = 180, min_support: int = 1) -> DataFrame:
    """(a, b, day, until, n_orders): the count of each pair over the ``days_back`` days that end at any day
    from ``day`` to before ``until``. A day's pairs are added when they come and taken away when the
    window has moved past them; the running sum of a pair is all there is to it. Pairs with fewer than
    ``min_support`` orders on all days together reach that in no window and are left out."""
    if min_support > 1:
        daily = daily.withColumn("__all", F.sum("n").over(Window.partitionBy("a", "b"))).where(F.col("__all") >= min_support).drop("__all")
    ends = F.array(F.struct(F.col("day").alias("day"), F.col("n").alias("n")), F.struct(F.date_add("day", days_back).alias("day"), (-F.col("n")).alias("n")))
    changes = daily.select("a", "b", F.explode(ends).alias("x")).groupBy("a", "b", F.col("x.day").alias("day")).agg(F.sum("x.n").alias("change")).where("change <> 0")
    order = Window.partitionBy("a", "b").orderBy("day")
    running = changes.withColumn("n_orders", F.sum("change").over(order)).withColumn("until", F.lead("day").over(order))
    return running.where("n_orders > 0").select("a", "b", "day", "until", "n_orders")


def counts_on(sliding: DataFrame, days: DataFrame, min_support: int = 2) -> DataFrame:
    """(day, a, b, n_orders) of the windows that end on some stated ``days`` (day)."""
    spans = sliding.where(F.col("n_orders") >= min_support).withColumnRenamed("day", "since")
    return scan(spans, days, lambda q: (F.col("since") <= q["day"]) & (F.col("until") > q["day"])).select("day", "a", "b", "n_orders")


def advance(counts: DataFrame, daily: DataFrame, day: str, days_back: int = 180) -> DataFrame:
    """(a, b, n_orders) of the window that ends on ``day``, from that of the day before: only two days
    of pairs are read."""
    came = daily.where(F.col("day") == F.to_date(F.lit(day))).select("a", "b", F.col("n").alias("n_orders"))
    left = daily.where(F.col("day") == F.date_sub(F.to_date(F.lit(day)), days_back)).select("a", "b", (-F.col("n")).alias("n_orders"))
    return counts.unionByName(came).unionByName(left).groupBy("a", "b").agg(F.sum("n_orders").alias("n_orders")).where("n_orders > 0")


def correlations(pairs: DataFrame) -> DataFrame:
    """Both directions with the count over the largest count, four decimals. ``pairs`` are read once for
    the edges and, where the plan is not shared, once for the largest count."""
    most = pairs.agg(F.greatest(F.max("n_orders"), F.lit(1))).scalar()
    scored = pairs.withColumn("score", F.round((F.col("n_orders") / most).cast("decimal(20,10)"), 4).cast("decimal(5,4)"))
    ends = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))
    return scored.select(F.explode(ends).alias("x"), "score", "n_orders").select(F.col("x.s").alias("id_source"), F.col("x.t").alias("id_target"), "score", "n_orders")


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """New edges replace old ones of the same key; the others stay."""
    return old.join(new.select("id_source", "id_target"), ["id_source", "id_target"], "left_anti").unionByName(new)


def correlation_stats(edges: DataFrame) -> DataFrame:
    """Edges, products, average score and, where edges have a ``date_upd``, the latest."""
    latest = [F.max("date_upd").alias("last_update")] if "date_upd" in edges.columns else []
    return edges.agg(
        F.count("*").alias("n_edges"), F.countDistinct("id_source").alias("n_products"),
        F.round(F.avg("score").cast("decimal(20,10)"), 4).cast("double").alias("avg_score"), *latest,
    )


def _top(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("score"), F.desc("n_orders"), "id_product").limit(limit)


def for_item(edges: DataFrame, catalog: DataFrame, item: int | F.Column, limit: int = 8) -> DataFrame:
    """Related products; products of the same category, in a seeded order, where there is none. ``item``: an
    id, or a column of one value (a scalar subquery)."""
    own = edges.where(F.col("id_source") == item).select(F.col("id_target").alias("id_product"), "score", "n_orders")
    # products that are not in the catalogue count as related, but aren't shown
    shown = own.join(catalog.select("id_product", "name", F.lit(True).alias("shown")), "id_product", "left")
    shown = shown.orderBy(F.col("shown").desc_nulls_last(), F.desc("score"), F.desc("n_orders"), "id_product").limit(limit)
    return _first_or(shown, same_category(catalog, item, limit).withColumn("shown", F.lit(True)), 1).where("shown").drop("shown")


def _first_or(first: DataFrame, second: DataFrame, least: int) -> DataFrame:
    """``first``, or ``second`` where it has fewer than ``least`` rows: both are a few rows and are read once."""
    both = first.withColumn("__step", F.lit(1)).unionByName(second.withColumn("__step", F.lit(2)))
    n = F.count(F.when(F.col("__step") == 1, 1)).over(Window.partitionBy())
    return both.withColumn("__n", n).where((F.col("__n") >= least) == (F.col("__step") == 1)).drop("__n", "__step")


def same_category(catalog: DataFrame, item: int | F.Column, limit: int = 8) -> DataFrame:
    category = catalog.where(F.col("id_product") == item).agg(F.max("id_category")).scalar()
    pool = catalog.where((F.col("id_product") != item) & (F.col("id_category") == category))
    shuffled = pool.orderBy(F.md5(F.col("id_product").cast("string")), "id_product").limit(limit)
    return shuffled.select("id_product", F.lit(0).cast("decimal(5,4)").alias("score"), F.lit(0).cast("bigint").alias("n_orders"), "name")


def for_cart(edges: DataFrame, catalog: DataFrame, sales: DataFrame, cart: list[int], limit: int = 8, least: int = 4) -> DataFrame:
    """Summed scores over the cart; bestsellers (unsold products too) take the place of fewer than
    ``least`` products."""
    return _cart(edges, catalog, sales, F.array(*map(F.lit, cart)), limit, least)


def for_cart_rows(edges: DataFrame, catalog: DataFrame, sales: DataFrame, cart: DataFrame, limit: int = 8, least: int = 4) -> DataFrame:
    """As ``for_cart`` for a cart (id_product) that is a table, a handful of rows."""
    return _cart(edges, catalog, sales, cart.agg(F.collect_set("id_product")).scalar(), limit, least)


def _cart(edges: DataFrame, catalog: DataFrame, sales: DataFrame, cart: F.Column, limit: int, least: int) -> DataFrame:
    inside = lambda c: F.array_contains(cart, F.col(c))
    own = edges.where(inside("id_source") & ~inside("id_target"))
    own = own.groupBy(F.col("id_target").alias("id_product")).agg(F.sum("score").cast("double").alias("score"), F.sum("n_orders").alias("n_orders"))
    own = _top(own.join(catalog.select("id_product", "name"), "id_product"), limit)
    best = catalog.where(~inside("id_product")).join(sales, "id_product", "left")
    best = best.select("id_product", F.lit(0.0).alias("score"), F.coalesce("sold", F.lit(0)).alias("n_orders"), "name")
    return _first_or(own, best.orderBy(F.desc("n_orders"), "id_product").limit(limit), least)
