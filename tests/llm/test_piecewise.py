import hashlib
import random
import zlib

import pytest
from texts import empty, odd, odd_rows, with_clashes, words

from larkspur.llm.piecewise_hash import _BYTE, _LETTERS, compare_edited, fingerprint


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain(text):
    """The fingerprint byte by byte, each block size on its own."""
    raw = text.encode()
    block = 4
    while block * 64 < len(raw):
        block *= 2
    out, size = [str(block)], 2 * block
    while size >= 4:
        signature, start = "", 0
        for i in range(len(raw)):
            h = sum(int(_BYTE[raw[i - k]]) * 0x9E3779B1**k for k in range(7) if i >= k) % 2**32 >> 9
            if h % size == size - 1 and len(signature) < 63:
                signature += _LETTERS[zlib.crc32(raw[start : i + 1]) >> 7 & 63]
                start = i + 1
        if start < len(raw):
            signature += _LETTERS[zlib.crc32(raw[start:]) >> 7 & 63]
        out.append(signature)
        size //= 2
    return ":".join(out)


def likeness(a, b):
    if a == b:
        return 1.0
    (m, *x), (n, *y) = a.split(":"), b.split(":")
    if not 0.5 <= int(m) / int(n) <= 2:
        return 0.0
    both = list(zip(reversed(x), reversed(y), strict=False))
    p, q = next(((s, t) for s, t in reversed(both) if min(len(s), len(t)) >= 32), both[0])
    return 1 - levenshtein(p, q) / max(len(p), len(q)) if p or q else 1.0


def test_fingerprint_against_plain_version():
    rng = random.Random(4)
    line = words(rng, 8) + "\n"
    for text in ["", "a", "ß" * 5, words(rng, 30), words(rng, 300), line * 40, line * 7 + words(rng, 60), "x" * 700]:
        assert fingerprint(text) == plain(text)


def test_repeated_lines(spark):
    """Half of such a text stays, and the fingerprints say so."""
    rng = random.Random(11)
    rows = [(k, (words(rng, rng.randint(4, 14)) + "\n") * rng.randint(40, 200)) for k in range(120)]
    found = compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = sorted(r.near_edited for r in found)
    assert near[len(near) // 20] >= 0.4 and sorted(r.near_next for r in found)[110] < 0.4


@pytest.mark.parametrize("buckets", [1, 7])
def test_against_plain_version(spark, buckets):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    found = {r.doc_id: r for r in compare_edited(docs, buckets).collect()}
    assert len(found) == len(rows)
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint(text) and r.edited_fingerprint == fingerprint(edited)
        assert len(text) > 3000 or r.fingerprint == plain(text)
        assert r.near_edited == pytest.approx(likeness(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(likeness(r.fingerprint, fingerprint(after)))


def test_edits_change_little():
    rng = random.Random(9)
    text = words(rng, 800)
    edited = text[:1500] + " inserted words " + text[1500:]
    assert likeness(fingerprint(text), fingerprint(edited)) > 0.85
    assert likeness(fingerprint(text), fingerprint(words(rng, 800))) < 0.4


def test_slices_do_not_matter(monkeypatch):
    from larkspur.llm import piecewise_hash

    text = words(random.Random(1), 700)
    whole = fingerprint(text)
    monkeypatch.setattr(piecewise_hash, "_SLICE", 100)
    assert fingerprint(text) == whole


def test_odd_rows(spark):
    rows = compare_edited(with_clashes(odd(spark))).collect()
    assert len(rows) == len(odd_rows())
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2)} == {"4::"} and len({r.fingerprint for r in rows if r.doc_id in (6, 7, 8)}) == 1
    assert compare_edited(empty(spark)).count() == 0
    alone = compare_edited(odd(spark).where("doc_id = 4")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
