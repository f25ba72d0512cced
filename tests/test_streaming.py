import datetime
import json

from pyspark.sql import functions as F

from larkspur.operators import events as E
from larkspur.streaming import events as S


def write(folder, rows):
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows))


def some_events():
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        kind = ["search", "search", "click", "conversion", "signup"][i % 5]
        rows.append({"event_type": kind, "shop_id": str(i % 2), "session_id": f"s{i % 3}", "query": f"<i>q{i % 7}</i>", "results_count": (i % 5) * 3, "timestamp": (start + datetime.timedelta(hours=i)).isoformat()})
    return rows


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_routing_and_batch_twin(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    write(folder, some_events())
    query = S.route(S.source(spark, str(folder)), lambda df, name: df.write.mode("append").parquet(f"{out}/{name}"), str(tmp_path / "c"))
    query.awaitTermination(120)
    raw = spark.read.schema(E.EVENT).json(str(folder))
    batch = {r.target: r.n for r in E.routed(E.classified(raw)).groupBy("target").agg(F.count("*").alias("n")).collect()}
    for name in ("search_events", "click_events", "conversion_events"):
        assert spark.read.parquet(f"{out}/{name}").count() == batch[name]


def test_daily_matches_batch(spark, tmp_path):
    write(tmp_path, some_events())
    stream = run(S.daily(S.source(spark, str(tmp_path))), "daily_out", "complete").collect()
    rows = [r for r in some_events() if r["event_type"] == "search"]
    assert sum(r.searches for r in stream) == len(rows)
    assert sum(r.empty for r in stream) == sum(r["results_count"] == 0 for r in rows)


def test_history_state(spark, tmp_path):
    write(tmp_path, some_events())
    found = {r.session_id: r.queries for r in run(S.histories(S.source(spark, str(tmp_path)), keep=3), "history_out", "update").collect()}
    rows = [r for r in some_events() if r["event_type"] == "search" and r["results_count"] > 0]
    for session, queries in found.items():
        own = [r["query"].replace("<i>", "").replace("</i>", "") for r in rows if r["session_id"] == session]
        assert queries == own[-3:]


def test_late_events_take_their_place(spark, tmp_path):
    """A file that comes later brings an older search, and one after a pause of over a week."""
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda q, day: {"event_type": "search", "shop_id": "1", "session_id": "s", "query": q, "results_count": 3, "timestamp": f"2024-01-{day:02d}T00:00:00"}
    (folder / "a.json").write_text("\n".join(json.dumps(row(q, d)) for q, d in [("one", 1), ("three", 3)]))
    out = []

    def go():
        query = S.histories(S.source(spark, str(folder)), keep=3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        query = query.foreachBatch(lambda df, _: out.extend(r.queries for r in df.collect())).trigger(availableNow=True).start()
        assert query.awaitTermination(100)

    go()
    (folder / "b.json").write_text(json.dumps(row("two", 2)))
    go()
    assert out[-1] == ["one", "two", "three"]
    (folder / "c.json").write_text(json.dumps(row("new", 20)))
    go()
    assert out[-1] == ["new"]


def test_replayed_batches_count_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    write(folder, some_events())
    S.route_to(S.source(spark, str(folder)), str(out), str(tmp_path / "c")).awaitTermination(120)
    n = spark.read.parquet(str(out)).groupBy("target").count().collect()
    again = E.classified(spark.read.schema(E.EVENT).json(str(folder))).withColumn("ts", F.to_timestamp("timestamp"))
    S.write_batch(again, str(out), 0)
    assert sorted(n) == sorted(spark.read.parquet(str(out)).groupBy("target").count().collect())


def test_parse_and_clean(spark):
    raw = spark.createDataFrame([("null",), ("[1]",), ("{}",), ("not json",), (json.dumps({"event_type": "click", "query": "<b>x</b>" + "y" * 2000}),)], "value string")
    rows = E.sanitize(E.parse(raw)).collect()
    assert len(rows) == 1 and rows[0].query.startswith("xy") and len(rows[0].query) == 993


def test_conversion_rows_fall_back_to_the_last_search(spark):
    df = spark.createDataFrame([(json.dumps({"event_type": "conversion", "order_id": 1, "last_search_query": "q", "products": [{"product_id": 3, "quantity": 2}, {"product_id": 4, "quantity": 1}]}),)], "value string")
    rows = E.conversion_rows(E.parse(df)).collect()
    assert [(r.query, r.product_id) for r in rows] == [("q", 3), ("q", 4)]
