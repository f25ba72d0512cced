import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions.scoring import age_bonus, sales_bonus, with_relevance
from larkspur.functions.text import spellings
from larkspur.operators import baskets, search
from larkspur.plans import search_queries as Q
from larkspur.sources import shop

SCHEMA = "name string, brand string, reference string, short_desc string, stock int"


def score(spark, query, **row):
    data = {"name": "", "brand": "", "reference": "", "short_desc": "", "stock": 1} | row
    df = spark.createDataFrame([tuple(data[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)
    df = df.withColumn("query", F.lit(query)).withColumn("words", F.array(*[F.lit(w) for w in query.split(" ")])).withColumn("spellings", spellings(F.col("words")))
    return with_relevance(df, full=False).first().relevance


def test_golden_scores(spark):
    assert score(spark, "cold widget", name="Cold widget x") == 1400
    assert score(spark, "cold widget", name="a cold widget") == 1300
    assert score(spark, "cold widget", name="cold thing") == 90
    assert score(spark, "cold widget", brand="coldish") == 9
    assert score(spark, "cold widget", name="cold widget", stock=0) == 980
    assert score(spark, "acme", brand="acme") == 700
    assert score(spark, "ref-1", reference="REF-1") == 750
    assert score(spark, "bar 350g", name="bar 350 gr") == 1000


def test_bonus_edges(spark):
    sold = [0, 1, 10, 11, 50, 51, 100, 101]
    rows = spark.createDataFrame([(s,) for s in sold], "s int").select(sales_bonus(F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == [0, 5, 5, 10, 10, 15, 15, 20]
    now = shop.ntz("2001-08-02 00:00:00")
    days = spark.createDataFrame([(datetime.datetime(2001, 8, 2) - datetime.timedelta(days=d),) for d in (0, 7, 8, 30, 31)], "d timestamp_ntz")
    assert [r.x for r in days.select(age_bonus(F.col("d"), now).alias("x")).collect()] == [15, 15, 10, 10, 0]


def test_merge_never_repeats_and_penalises(spark):
    one = spark.createDataFrame([(1, 7, 90.0)], "query_id int, id_product int, relevance double")
    two = spark.createDataFrame([(1, 7, 50.0), (1, 8, 90.0)], "query_id int, id_product int, relevance double")
    assert {(r.id_product, r.relevance) for r in search.merge(one, two).collect()} == {(7, 90.0), (8, 90.0 * 0.7)}


def test_pages_join_up(spark, sf):
    ranked = search.final_order(Q._scored(spark, sf, "cold widget").withColumn("boost", F.lit(1.0))).select("query_id", "rank", "id_product").cache()
    total, seen, offset = ranked.count(), [], 0
    while True:
        rows = search.page(ranked, offset, 50).orderBy("rank").collect()
        seen += [r.id_product for r in rows]
        if not rows or not rows[0].has_more:
            break
        offset += 50
    assert seen == [r.id_product for r in ranked.orderBy("rank").collect()] and len(seen) == total


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(1.0, 4.0))
def test_boost_is_monotone(spark, boost):
    df = spark.createDataFrame([(1, 1, "a", 10.0, 1.0), (1, 2, "b", 10.0, boost)], "query_id int, id_product int, name string, relevance double, boost double")
    first = search.final_order(df).where("rank = 1").first()
    assert first.final == pytest.approx(10 * max(1.0, boost))


def test_correlations(spark):
    pairs = spark.createDataFrame([(1, 2, 5), (1, 3, 2)], "a bigint, b bigint, n_orders bigint")
    found = {(r.id_source, r.id_target): float(r.score) for r in baskets.correlations(pairs).collect()}
    assert found == {(1, 2): 1.0, (2, 1): 1.0, (1, 3): 0.4, (3, 1): 0.4}


def test_pairs_need_support_and_validity(spark):
    lines = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 10), (2, 11), (3, 10), (3, 12), (4, 10), (4, 12)], "id_order int, id_product int")
    day = datetime.datetime(2001, 7, 1)
    heads = spark.createDataFrame([(1, True, day), (2, True, day), (3, True, day), (4, False, day)], "id_order int, valid boolean, date_add timestamp_ntz")
    found = baskets.pair_counts(lines, heads, shop.ntz("2001-08-02 00:00:00")).collect()
    assert [(r.a, r.b, r.n_orders) for r in found] == [(10, 11, 2)]


def test_pairs_are_not_cut(spark):
    """Two orders of 150 products: every pair of them, more than correlations are made of."""
    lines = spark.createDataFrame([(k, p) for k in (1, 2) for p in range(150)], "id_order int, id_product int")
    heads = spark.createDataFrame([(k, True, datetime.datetime(2001, 7, 1)) for k in (1, 2)], "id_order int, valid boolean, date_add timestamp_ntz")
    found = baskets.pair_counts(lines, heads, shop.ntz("2001-08-02 00:00:00")).collect()
    assert len(found) > baskets.EDGE_CAP
    assert sorted(map(tuple, found)) == [(a, b, 2) for a in range(150) for b in range(a + 1, 150)]


def test_filters_parse():
    f = search.Filters.parse({"category": "1,2,x", "price_min": "abc", "price_max": "9.5", "in_stock": "1"})
    assert f.categories == (1, 2) and f.price_min is None and f.price_max == 9.5 and f.active() == 4


def test_keyword_fires(spark):
    fire = lambda k, w, n=2: spark.range(1).select(search.keyword_fires(F.lit(k).cast("string"), F.array(*[F.lit(x) for x in w]), n).alias("x")).first().x
    assert fire(None, ["a"]) and fire("", ["zz"]) and fire("cold, ice", ["colder"]) and fire("colder", ["cold"])
    assert not fire("cold", ["c"]) and fire("cold", ["c"], 1) and not fire("cold", ["warm"])


def test_no_job_while_the_plan_is_built(spark, sf):
    """Stated queries and rules are local relations: their size is known without a job."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "a search is put together")
    before = len(tracker.getJobIdsForGroup("building"))
    frame = Q.full_search(spark, sf)
    jobs = len(tracker.getJobIdsForGroup("building")) - before
    reads = 6  # each spark.read.parquet looks up a schema in a job of its own
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= reads and frame.columns[0] == "query_id"


def test_filters_stand_before_the_cap(spark, sf):
    """A narrow filter still fills the result although the best 300 of all products don't pass it."""
    from pyspark.sql import functions as F

    rows = [(i, f"cold thing {i:04d}", "Acme", 1 if i >= 1000 else 2, "x", "", "d", f"R-{i}", "", "", 1, 10.0, 10) for i in range(1100)]
    cat = spark.createDataFrame(rows, "id_product int, name string, brand string, id_brand int, category string, short_desc string, description string, reference string, ean13 string, upc string, stock int, price_incl double, sold int").withColumn("date_add", shop.ntz(Q.AS_OF))
    asked = shop.literal(spark, [(1, "cold")], "query_id bigint, query string")
    found = search.search(cat, asked, Q.boosts(spark), shop.ntz(Q.AS_OF), search.Filters(brands=(1,)), inject=False)
    assert {r.id_product for r in found.where(~F.col("injected")).collect()} == set(range(1000, 1100))


def test_sliding_window_is_a_recount_on_each_day(spark):
    """Thirty days moved one by one, and all of them at once."""
    import random

    rng = random.Random(8)
    first = datetime.date(2001, 1, 1)
    orders = [(k, True if k % 9 else False, datetime.datetime.combine(first + datetime.timedelta(days=rng.randrange(60)), datetime.time(rng.randrange(24)))) for k in range(300)]
    lines = [(k, rng.randrange(9)) for k, _, _ in orders for _ in range(rng.randint(1, 4))]
    line_rows, head_rows = spark.createDataFrame(lines, "id_order int, id_product int"), spark.createDataFrame(orders, "id_order int, valid boolean, date_add timestamp_ntz")
    daily = baskets.daily_pairs(line_rows, head_rows).cache()
    days = [first + datetime.timedelta(days=30 + k) for k in range(30)]
    at_once = {}
    for r in baskets.counts_on(baskets.sliding_counts(daily, 20), spark.createDataFrame([(d,) for d in days], "day date"), 1).collect():
        at_once.setdefault(r.day, {})[r.a, r.b] = r.n_orders

    def recount(day):
        items, out = {}, {}
        for k, p in lines:
            items.setdefault(k, set()).add(p)
        for k, valid, at in orders:
            if valid and day - datetime.timedelta(days=20) < at.date() <= day:
                for a in items[k]:
                    for b in items[k]:
                        if a < b:
                            out[a, b] = out.get((a, b), 0) + 1
        return out

    counts = daily.where(F.col("day") == "1999-01-01").select("a", "b", F.col("n").alias("n_orders"))
    for k in range(30 + 30):
        day = first + datetime.timedelta(days=k)
        counts = spark.createDataFrame(baskets.advance(counts, daily, str(day), 20).toArrow(), "a int, b int, n_orders long")
        if day in days:
            assert {(r.a, r.b): r.n_orders for r in counts.collect()} == recount(day) == at_once[day]


def test_pairs_are_dealt_by_the_lines_size(spark, sf, monkeypatch):
    """Pairs are dealt before they are counted, over as many tasks as the lines' size asks for."""
    monkeypatch.setattr(baskets, "PLACE_BYTES", 1 << 10, raising=False)
    line_rows, head_rows = shop.order_lines(spark, sf), shop.order_heads(spark, sf)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        daily = baskets.daily_pairs(line_rows, head_rows)
        shares = daily.groupBy(F.spark_partition_id()).count().collect()
        pairs = baskets.pair_counts(line_rows, head_rows, shop.ntz(shop.CATALOG_AS_OF), 3650)
        pairs.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(shares) >= 8 and max(r["count"] for r in shares) < daily.count() / 4
    for frame in (pairs, daily):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "LeftSemi" not in plan


def test_pairs_below_the_support_leave_no_window(spark, sf):
    daily = baskets.daily_pairs(shop.order_lines(spark, sf), shop.order_heads(spark, sf)).cache()
    days = spark.sql("select date'2001-08-02' - cast(id * 100 as int) as day from range(8)")
    rows = lambda sliding: sorted(map(tuple, baskets.counts_on(sliding, days, 2).collect()))
    assert rows(baskets.sliding_counts(daily, 1500, 2)) == rows(baskets.sliding_counts(daily, 1500)) != []
    daily.unpersist()
