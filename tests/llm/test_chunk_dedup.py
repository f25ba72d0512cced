import random

from texts import empty, odd, with_clashes, words

from larkspur.llm.chunk_dedup import LARGEST, LEAST, chunk_ends, deduplicate, spans


def test_chunks_resist_shifts():
    rng = random.Random(2)
    raw = words(rng, 2000).encode()
    pieces = lambda r: {r[a:b] for a, b in zip([0, *chunk_ends(r)], chunk_ends(r), strict=False)}
    shifted = b"inserted " + raw[:5000] + b" more" + raw[5000:]
    assert len(pieces(raw) & pieces(shifted)) > 0.95 * len(pieces(raw))
    ends = chunk_ends(raw)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(raw) and max(sizes) <= LARGEST + 3 and all(s >= LEAST for s in sizes[:-1])
    uni = ("é漢🙂" * 200).encode()
    for end in chunk_ends(uni):
        uni[:end].decode()


def test_planted_passages(spark):
    rng = random.Random(4)
    passages = [words(rng, 55) for _ in range(4)]
    rows = [(i, words(rng, 100) + " " + passages[i % 4] + " " + words(rng, 80)) for i in range(40)]
    rows += [(100 + i, words(rng, 200)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spans(docs).collect()
    assert {r.doc_id for r in found} == set(range(4, 40)) and {r.source_doc_id for r in found} == {0, 1, 2, 3}
    text = dict(rows)
    for r in found:
        cut = text[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert cut in passages[r.doc_id % 4] or cut.strip() in text[r.source_doc_id]
    kept = {r.doc_id: r.text for r in deduplicate(docs).collect()}
    for i, t in rows:
        removed = sum(r.end_byte - r.start_byte for r in found if r.doc_id == i)
        assert len(kept[i]) == len(t) - removed


def test_odd_rows(spark):
    docs = with_clashes(odd(spark))
    found = {(r.doc_id, r.source_doc_id) for r in spans(docs).collect()}
    assert found == {(7, 6), (8, 6), (None, 6), (11, 6)}
    assert deduplicate(docs).count() == docs.count() and spans(empty(spark)).count() == 0


def brute(rows, least=140):
    """For each document the bytes that lie in a stretch of ``least`` bytes of an earlier one."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        own = [raw[k : k + least] for k in range(len(raw) - least + 1)]
        bytes_of = set()
        for k, piece in enumerate(own):
            if piece in seen:
                bytes_of.update(range(k, k + least))
        out[i] = bytes_of
        seen.update(own)
    return out


def check_against_brute(spark, rows, recall):
    want, found = brute(rows), {i: set() for i, _ in rows}
    for r in spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.end_byte - r.start_byte >= 140
        found[r.doc_id].update(range(r.start_byte, r.end_byte))
    assert all(found[i] <= want[i] for i in want)  # nothing is cut that doesn't repeat
    total = sum(map(len, want.values()))
    assert total and sum(map(len, found.values())) >= recall * total


def test_against_brute_force(spark):
    """Made-up documents: passages from 30 to 120 words with short and long words, nested and shared."""
    rng = random.Random(7)
    short = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4))) for _ in range(n))
    passages = [short(rng.randint(70, 120)) for _ in range(10)] + [words(rng, rng.randint(30, 90)) for _ in range(10)]
    passages += [passages[3][20:] + " " + passages[12], "é漢🙂ü" * 40]
    rows = [(i, f"{words(rng, rng.randint(0, 60))} {passages[i % 22]} {words(rng, rng.randint(0, 60))} {passages[(i * 7) % 22] if i % 3 else ''}") for i in range(120)]
    check_against_brute(spark, rows, 0.98)


def test_documents_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_against_brute(spark, rows, 0.97)


def test_short_words(spark):
    """51 words of some three letters: whole chunks alone cover too little of them."""
    rng = random.Random(11)
    short = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(n))
    passages = [short(51) for _ in range(100)]
    rows = [(2 * k + j, f"{words(rng, 60)} {p} {words(rng, 60)}") for k, p in enumerate(passages) for j in range(2)]
    found = {r.doc_id: r for r in spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) <= set(range(1, 200, 2)) and len(found) >= 98
    text = dict(rows)
    assert all(passages[i // 2] in text[i].encode()[r.start_byte : r.end_byte].decode() for i, r in found.items())
