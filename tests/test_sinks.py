import pathlib

import pytest
from pyspark.sql import functions as F

from larkspur.operators.reports import merge_stats
from larkspur.sources import sinks
from larkspur.sources.cache import ResultCache


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.latest(spark, path) == (None, -1)
    assert sinks.upsert_table(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), path, ["id"]) == 0
    assert sinks.upsert_table(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), path, ["id"]) == 1
    rows, version = sinks.latest(spark, path)
    assert version == 1 and {(r.id, r.v) for r in rows.collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_webhook_sends_all(spark, tmp_path):
    folder = str(tmp_path)

    def post(bodies):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(bodies))

    sinks.webhook(post, batch=10)(spark.range(35))
    sent = [line for p in tmp_path.iterdir() for line in p.read_text().split("\n")]
    assert len(sent) == 35 and '{"id":3}' in sent


def files(path):
    return {p for p in pathlib.Path(path).rglob("*.parquet")}


def test_an_upsert_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(5000).select("id", F.lit("old").alias("v"))
    assert len(sinks.upsert_buckets(rows, path, ["id"], buckets=32)) == 32
    before = files(path)
    few = spark.createDataFrame([(7, "new"), (4999, "new"), (9000, "new")], "id long, v string")
    touched = sinks.upsert_buckets(few, path, ["id"], buckets=32)
    assert 1 <= len(touched) <= 3
    changed = {p.parent.name for p in before ^ files(path)}
    assert changed == {f"bucket_of_32={b}" for b in touched}
    found = {r.id: r.v for r in sinks.read_buckets(spark, path).collect()}
    assert found == {i: "new" if i in (7, 4999, 9000) else "old" for i in [*range(5000), 9000]}
    with pytest.raises(ValueError):
        sinks.upsert_buckets(few, path, ["id"], buckets=8)


def test_replayed_batches_add_up_once(spark, tmp_path):
    """Also where a failure left only some buckets written."""
    path, keys = str(tmp_path / "t"), ["query", "id_shop"]
    kind = "query string, id_shop int, search_count long, results_count int, last_search timestamp, date_add timestamp"
    batch = lambda n: spark.range(40).selectExpr("concat('q', id) as query", "1 as id_shop", f"{n}L as search_count", f"{n} as results_count", f"timestamp'2024-01-0{n} 00:00:00' as last_search", f"timestamp'2024-01-0{n} 00:00:00' as date_add").to(spark.createDataFrame([], kind).schema)
    go = lambda df, k: sinks.upsert_buckets(df, path, keys, merge_stats, batch_id=k, buckets=8)
    assert go(batch(1), 0)
    assert go(batch(2).where("query < 'q2'"), 1)  # a part of the second batch's buckets
    part = {r[0] for r in spark.read.parquet(path).where("last_batch = 1").select("bucket_of_8").distinct().collect()}
    whole = sinks.upsert_buckets(batch(2), path, keys, merge_stats, batch_id=1, buckets=8)
    assert part and not part & set(whole) and go(batch(2), 1) == [] and go(batch(1), 0) == []
    assert {r.search_count for r in sinks.read_buckets(spark, path).collect() if r.query < "q2"} == {3}


def test_two_tiers(spark, tmp_path):
    """Memory answers until its entries are a minute old, then the table, then the search itself."""
    calls = []

    def compute(asked):
        calls.append(sorted(r.cache_key for r in asked.collect()))
        return asked.select("cache_key", F.when(F.col("cache_key") != "none", F.concat(F.lit("r-"), "cache_key")).alias("result_data"))

    cache = ResultCache(spark, str(tmp_path / "c"), compute)
    asked = lambda *keys: spark.createDataFrame([(k,) for k in keys], "cache_key string")
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    get = lambda s, *keys: sorted((r.cache_key, r.result_data, r.tier) for r in cache.get(asked(*keys), at(s)).collect())
    assert get(0, "a", "b", "none") == [("a", "r-a", "computed"), ("b", "r-b", "computed")]
    assert get(10, "a") == [("a", "r-a", "memory")] and get(20, "a", "c") == [("a", "r-a", "memory"), ("c", "r-c", "computed")]
    assert get(61, "a", "c") == [("a", "r-a", "stored"), ("c", "r-c", "memory")]
    assert calls == [["a", "b", "none"], ["c"]]
    # a hit in memory reads no file
    plan = cache.get(asked("c"), at(62))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "InMemory" not in plan
    assert get(301, "a") == [("a", "r-a", "computed")]
    cache.invalidate(asked("a"))
    assert get(302, "a", "c") == [("a", "r-a", "computed"), ("c", "r-c", "stored")]
    cache.invalidate()
    assert get(303, "c") == [("c", "r-c", "computed")] and len(calls) == 5


def test_append(spark, tmp_path):
    for k in range(2):
        sinks.append(spark.range(3).select("id", F.lit(f"d{k}").alias("day")), str(tmp_path / "a"), "day")
    rows = spark.read.parquet(str(tmp_path / "a")).collect()
    assert sorted((r.day, r.id) for r in rows) == [("d0", 0), ("d0", 1), ("d0", 2), ("d1", 0), ("d1", 1), ("d1", 2)]
    assert sorted(p.name for p in (tmp_path / "a").iterdir() if p.is_dir()) == ["day=d0", "day=d1"]
