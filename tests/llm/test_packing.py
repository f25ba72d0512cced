import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from texts import empty, odd, odd_rows, with_clashes


from larkspur.llm.bpe import default_vocabulary
from larkspur.llm.packing import MergingBpe, Places, op13_packing, pack, pieces, plan, sequences


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return MergingBpe(default_vocabulary()), Tokenizer.from_file(default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(both, text):
    assert both[0].ids(text) == both[1].encode(text, add_special_tokens=False).ids


def test_words(both):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("etaoinshrdlu'S9éß") for _ in range(rng.randint(1, 40))) for _ in range(60)) for _ in range(40)]
    texts += ["a" * k + " " + "ha" * k + " " + "!" * k + "?!" * k for k in range(1, 90)]
    texts += ["<|endoftext|> a<|startoftext|>b <|endoftext|>", "they're 'S", "Σίσυφος", None, "", " ", "x" * 700 + "yz" * 300]
    want = [both[1].encode(t or "", add_special_tokens=False).ids for t in texts]
    got = defaultdict(bytes)
    for k, raw, _ in both[0].encode(texts):
        got[k] += raw
    assert [np.frombuffer(got[k], "<u4").tolist() for k in range(len(texts))] == want


def one_by_one(sizes, capacity):
    """The same rule, piece by piece: the gaps of all sequences."""
    large, small = sorted((s for s in sizes if 3 * s > capacity), reverse=True), sorted((s for s in sizes if 3 * s <= capacity), reverse=True)
    gaps = []
    while large:
        s = large.pop(0)
        t = next((t for t in large if s + t <= capacity), None)
        if t is not None:
            large.remove(t)
        gaps.append(capacity - s - (t or 0))
    for s in small:
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - s)
    return sorted(gaps)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_is_as_piece_by_piece(sizes):
    kinds = plan(Counter(sizes), 30)
    assert sorted(k.gap for k in kinds for _ in range(k.many)) == one_by_one(sizes, 30)
    held = Counter()
    for kind in kinds:
        assert sum(s * k for s, k in kind.holds) + kind.gap == 30
        for s, k in kind.holds:
            held[s] += kind.many * k
    assert held == Counter(sizes)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=80))
def test_places(sizes):
    places, number, at = Places(plan(Counter(sizes), 30)), Counter(), []
    for s in sizes:
        at.append(number[s])
        number[s] += 1
    sequence, offset = places.of(np.array(sizes), np.array(at))
    check(list(zip(sequence.tolist(), offset.tolist(), sizes, strict=True)), 30)
    assert set(sequence.tolist()) == set(range(places.sequences))


def check(rows, capacity):
    by = defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_huge_counts():
    """The work depends on the sizes alone."""
    rng = random.Random(2)
    counts = {s: rng.randrange(10**9) for s in range(1, 2049)}
    kinds = plan(counts)
    assert len(kinds) < 3 * 2048 and sum(k.many for k in kinds) >= -(-sum(s * c for s, c in counts.items()) // 2048)


def test_query_against_library(spark, both):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_packing(spark, sf).collect()
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    assert set(own) == set(docs)
    sizes = []
    for doc_id, text in docs.items():
        ids = [*both[1].encode(text or "", add_special_tokens=False).ids, 0]
        parts = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        sizes += map(len, parts)
        found = sorted(own[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in found] == [(k, 2048 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
    assert check([(r.sequence_id, r.offset, r.length) for r in rows], 2048) == len(one_by_one(sizes, 2048))


def test_sequences(spark, both):
    texts = ["one two three", "a b", None, "x " * 25, "one two three", "d"]
    placed = pack(pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=10), capacity=10)
    rows = {r.sequence_id: r.token_ids for r in sequences(placed).collect()}
    parts = placed.collect()
    assert sum(map(len, rows.values())) == sum(r.length for r in parts)
    for r in parts:
        assert rows[r.sequence_id][r.offset : r.offset + r.length] == r.token_ids


def test_odd_rows(spark):
    docs = with_clashes(odd(spark)).withColumns({c: F.lit("clash") for c in ("piece", "sequence_id", "offset", "__row", "__part", "length")})
    rows = pack(pieces(docs, keep_ids=False)).collect()
    assert sum(r.piece == 0 for r in rows) == len(odd_rows()) and {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1}
    check([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    assert pack(pieces(empty(spark))).collect() == []


def test_pack_keeps_columns_and_one_hot_length(spark):
    parts = spark.createDataFrame([(5 if k % 3 else k % 40 + 1, "x") for k in range(3000)], "length int, __row string").withColumns({c: F.lit("y") for c in ("__at", "__to", "__part", "before", "count", "size")})
    out = pack(parts, 50)
    rows = out.collect()
    assert len(rows) == 3000 and out.columns == [*parts.columns, "sequence_id", "offset"] and {(r["__row"], r["__at"]) for r in rows} == {("x", "y")}
    assert check([(r.sequence_id, r.offset, r.length) for r in rows], 50) == len(one_by_one([r.length for r in rows], 50))
    with pytest.raises(ValueError):
        pack(parts, 30)


def test_slices_and_tables(both, monkeypatch):
    from larkspur.llm import bpe

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab cdé'1! ") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    monkeypatch.setattr(bpe, "SLICE", 64)
    small = MergingBpe(default_vocabulary(), keep_bytes=3000)
    assert [small.ids(t) for t in texts] == [both[1].encode(t, add_special_tokens=False).ids for t in texts]
