import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from texts import empty, odd, odd_rows, with_clashes

from larkspur.llm.sharding import assign, schedule


def plain_loads(sizes, shards):
    """Longest first, one by one, to the least-loaded shard; units of each size in each shard."""
    loads, given = [0] * shards, Counter()
    for size in sorted(sizes, reverse=True):
        k = min(range(shards), key=lambda s: (loads[s], s))
        loads[k] += size
        given[size, k] += 1
    return loads, given


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 120)), max_size=12), st.integers(1, 9))
def test_classes_are_as_one_by_one(classes, shards):
    sizes = [s for s, c in dict(classes).items() for _ in range(c)]
    _, given = plain_loads(sizes, shards)
    found = schedule(list(dict(classes).items()), shards)
    assert {(s, k): n for s, _, own in found for k, n in enumerate(own) if n} == given


def test_large_classes():
    (first, _), (second, _) = [(own, s) for s, _, own in schedule([(7, 10**12 + 3), (1000, 5)], 8)]
    assert first == [1, 1, 1, 1, 1, 0, 0, 0] and sum(second) == 10**12 + 3
    loads = [1000 * a + 7 * b for a, b in zip(first, second, strict=True)]
    assert max(loads) - min(loads) <= 7


def test_assign_against_plain_version(spark):
    """Loads of all shards, over groups of equal texts, with classes cut into many parts."""
    rng = random.Random(6)
    texts = [rng.choice("abc") * rng.choice([1, 2, 5, 9, 40]) + str(rng.randrange(60)) for _ in range(500)] + ["x" * 3000] * 3 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = Counter()
    for t in texts:
        sizes[t or ""] += len(t or "") + 1
    want, _ = plain_loads(sizes.values(), 8)
    for part_groups in (10_000, 3):
        rows = assign(docs, part_groups=part_groups).collect()
        loads = [0] * 8
        for r in rows:
            loads[r.shard] += r.size
        assert loads == want and len(rows) == len(texts)
        check(rows)


def check(rows, shards=8):
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = assign(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    of, loads = {}, [0] * 8
    for r in rows:
        raw = text[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert of.setdefault(raw, r.shard) == r.shard
        loads[r.shard] += r.size
    check(rows)
    assert len(rows) == len(text) and max(loads) - min(loads) < 0.01 * max(loads)


def test_odd_rows(spark):
    rows = assign(with_clashes(odd(spark))).collect()
    assert len(rows) == len(odd_rows())
    check(rows)
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {1} and {r.text_crc32 for r in rows if r.doc_id == 1} == {0}
    assert assign(empty(spark)).count() == 0
