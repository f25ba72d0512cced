"""Streams against their batch twins, on input that comes shuffled, late and twice."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import events as E
from larkspur.operators import reports
from larkspur.sources import sinks
from larkspur.streaming import keyed as K

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, kind string, session_id string, visitor string, query string, id_product long, results_count int, id_shop int, position int, amount decimal(10,2), ts timestamp"


def some_events(n=400, days=20, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["search", "search", "no_results", "click", "click", "conversion", "remove"])
        at = START + datetime.timedelta(days=rng.random() * days)
        rows.append((i, kind, rng.choice(["a", "b", "c", None] if kind == "signup" else ["a", "b", "c"]), f"v{rng.randrange(4)}", f"q{rng.randrange(6)}", rng.randrange(4), rng.randrange(3) if kind == "search" else 0, rng.randrange(2), rng.randrange(9), None if kind != "conversion" else rng.randrange(100), at))
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame([(*r[:9], None if r[9] is None else __import__("decimal").Decimal(r[9]), r[10]) for r in rows], SCHEMA)


def feed(spark, folder, rows, files=4, seed=2, twice=True):
    """Shuffled rows in several files, some rows in two of them."""
    rng = random.Random(seed)
    rows = rows[:]
    rng.shuffle(rows)
    parts = [rows[k::files] for k in range(files)]
    if twice:
        parts[-1] = parts[-1] + parts[0][:10]
    for k, part in enumerate(parts):
        as_frame(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def run(stream, mode, tmp_path):
    """All rows of all batches, in their order."""
    out = []
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state"))
    query = query.foreachBatch(lambda df, k: out.extend((k, r) for r in df.collect())).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return out


@pytest.fixture
def keyed_state(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    K.use_keyed_state(spark)
    yield
    spark.conf.set(name, before)


def newest(out):
    """What each history is at last."""
    last = {}
    for k, r in out:
        last.setdefault((r.session_id, r.kind, k), []).append((r.place, r.event_id, r.query))
    keep = {}
    for (session, kind, _), rows in sorted(last.items(), key=lambda x: x[0][2]):
        keep[session, kind] = sorted(rows)
    return keep


def test_histories_are_as_in_batch(spark, tmp_path, keyed_state):
    rows = some_events()
    found = newest(run(K.histories(feed(spark, tmp_path / "in", rows), delay="40 days"), "update", tmp_path))
    events = as_frame(spark, rows)
    for kind, df in (("search", E.last_searches(events, 10, 7)), ("click", E.last_clicks(events, 20, 7))):
        want = {}
        for r in df.collect():
            want.setdefault((r.session_id, kind), []).append((r.age, r.event_id, r.query))
        assert {k: v for k, v in found.items() if k[1] == kind} == {k: sorted(v) for k, v in want.items()}
    # recent queries: the newest search of each, where no removal came behind it
    last = {}
    for r in sorted(rows, key=lambda r: (r[10], r[0])):
        if r[1] in ("search", "no_results", "remove"):
            last[r[2], r[4]] = (r[10], r[0], r[1])
    for session in "abc":
        own = sorted(((t, e, q) for (s, q), (t, e, k) in last.items() if s == session and k != "remove"), reverse=True)[:5]
        assert [x[1:] for x in found[session, "recent"]] == [(e, q) for _, e, q in own]


def test_expired_histories_go(spark, tmp_path, keyed_state):
    """The watermark passes a session's last event by a life; another session drives it."""
    day = lambda d, i, s: (i, "search", s, "v", "q", 1, 2, 1, 1, None, START + datetime.timedelta(days=d))
    for k, part in enumerate([[day(0, 1, "old")], [day(30, 2, "new")], [day(31, 3, "new")]]):
        as_frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = run(K.histories(stream, delay="1 day"), "update", tmp_path)
    assert [r.session_id for _, r in out if r.kind == "gone"] == ["old"]


def test_sessions_are_as_in_batch(spark, tmp_path):
    rows = some_events(120, 60)
    edge = [(900 + i, "search", "a", "edge", "q", 1, 1, 1, 1, None, START + datetime.timedelta(days=d)) for i, d in enumerate([0, 1, 2, 3.5])]
    flush = [(999, "search", "z", "zz", "q", 1, 1, 1, 1, None, START + datetime.timedelta(days=400))]
    stream = feed(spark, tmp_path / "in", rows + edge, twice=False)
    as_frame(spark, flush).coalesce(1).write.parquet(f"{tmp_path}/in/z")
    out = run(K.sessions(stream, delay="90 days"), "append", tmp_path)
    batch = E.with_sessions(as_frame(spark, rows + edge)).groupBy("visitor", "session_id").agg(F.count("*").alias("n")).collect()
    assert sorted((r.visitor, r.session_id, r.n_events) for _, r in out) == sorted((r.visitor, r.session_id, r.n) for r in batch)
    assert sum(r.visitor == "edge" for _, r in out) == 2


def test_attribution_is_as_in_batch(spark, tmp_path):
    rows = some_events(500, 25, seed=5)
    flush = [(9000 + k, kind, "z", "zz", "q", 1, 1, 1, 1, 1 if kind == "conversion" else None, START + datetime.timedelta(days=400 + d)) for k, (kind, d) in enumerate([("click", 0), ("conversion", 0), ("click", 1), ("conversion", 1)])]
    stream = feed(spark, tmp_path / "in", rows, twice=False)
    as_frame(spark, flush).coalesce(1).write.parquet(f"{tmp_path}/in/z")
    out = run(K.attribution(stream.where("kind = 'conversion'"), stream.where("kind = 'click'"), delay="60 days"), "append", tmp_path)
    events = as_frame(spark, rows)
    batch = E.attributed_within(events.where("kind = 'conversion'"), events.where("kind = 'click'")).collect()
    key = lambda r: (r.event_id, r.session_id, r.id_product, r.amount, r.source_query, r.source_position, r.attributed)
    assert sorted(map(str, map(key, (r for _, r in out if r.event_id < 9000)))) == sorted(map(str, map(key, batch)))
    assert {r.attributed for r in batch} == {True, False}


def test_days_are_as_in_batch(spark, tmp_path):
    rows = some_events(300, 12, seed=6)
    flush = [(9000, "search", "z", "zz", "q", 1, 1, 1, 1, None, START + datetime.timedelta(days=100))]
    stream = feed(spark, tmp_path / "in", rows, twice=False)
    as_frame(spark, flush).coalesce(1).write.parquet(f"{tmp_path}/in/z")
    out = run(K.daily(stream, delay="30 days"), "append", tmp_path)
    batch = reports.daily_stats(as_frame(spark, rows)).collect()
    key = lambda r: (r.day, r.id_shop, r.searches, r.sessions, r.empty, pytest.approx(r.avg_results))
    assert sorted(map(key, (r for _, r in out)), key=str) == sorted(map(key, batch), key=str)
    assert isinstance(pd.Timestamp(batch[0].day), pd.Timestamp) and len(out) > 10


def test_stats_in_buckets_are_as_in_batch(spark, tmp_path):
    """Over four micro-batches; the last one is replayed by hand and counts once."""
    rows = some_events(200, 5, seed=7)
    path = str(tmp_path / "stats")
    stream = feed(spark, tmp_path / "in", rows, twice=False)
    assert K.stats_into(stream, path, str(tmp_path / "c"), buckets=4).awaitTermination(300) is not False
    key = lambda r: (r.query, r.id_shop, r.search_count, r.results_count, r.last_search, r.date_add)
    want = sorted(map(key, reports.query_stats(as_frame(spark, rows)).collect()))
    assert sorted(map(key, sinks.read_buckets(spark, path).collect())) == want
    last = spark.read.parquet(path).agg(F.max("last_batch")).first()[0]
    assert last == 3 and sinks.upsert_buckets(reports.query_stats(as_frame(spark, rows[:50])), path, reports.STAT_KEYS, reports.merge_stats, last, 4) == []
    assert sorted(map(key, sinks.read_buckets(spark, path).collect())) == want
