from larkspur.operators import merch
from larkspur.plans import search_queries as Q
from larkspur.sources import shop


def test_crud(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, v string, active boolean")
    pick = spark.createDataFrame([(2,)], "id int")
    assert {(r.id, r.active) for r in merch.toggle(rows, pick, ["id"]).collect()} == {(1, True), (2, True)}
    assert [r.id for r in merch.delete(rows, pick, ["id"]).collect()] == [1]
    new = spark.createDataFrame([(2, "c", True), (3, "d", True)], "id int, v string, active boolean")
    assert {(r.id, r.v) for r in merch.upsert(rows, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r.id, r.v) for r in merch.insert_missing(rows, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_cache(spark, sf):
    cache = Q.cache(spark, sf)
    assert merch.cache_invalidate(cache).count() == 0
    key = cache.first().cache_key
    assert merch.cache_invalidate(cache, key[:27]).where(f"cache_key = '{key}'").count() == 0
    entries = cache.limit(2).selectExpr("cache_key", "'x' as result_data", "created_at", "cast(1 as int) as n_results")
    put = merch.cache_put(cache, entries)
    assert put.count() == cache.count() and put.where("result_data = 'x'").count() == 2
    assert merch.cache_get(cache, cache.select("cache_key"), shop.ntz("2030-01-01 00:00:00")).count() == 0


def test_banner_list_has_every_banner(spark, sf):
    rows = [(i * 7 % 100, ["top", "middle", "bottom", "sidebar", "other", None][i % 6]) for i in range(90)]
    order = {p: k + 1 for k, p in enumerate(merch.POSITIONS)}
    expected = [(i, p, k + 1) for k, (i, p) in enumerate(sorted(rows, key=lambda r: (order.get(r[1], 0), r[0])))]
    for width in (3, 10_000):
        assert sorted(map(tuple, merch.banner_list(spark.createDataFrame(rows, "id bigint, position string"), width).collect()), key=lambda r: r[2]) == expected
    listed = Q.QUERIES["banner_list"](spark, sf)
    assert listed.count() == listed.select("place").distinct().count() == shop.table(spark, sf, "customer").count()
