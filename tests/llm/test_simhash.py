import numpy as np
import pytest
import xxhash
from texts import empty, odd, odd_rows, with_clashes

from larkspur.llm.simhash_dedup import _wide, keep_first, links, near_copies, near_duplicates, simhash


def plain(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fps):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4 and find(a) != find(b):
                parent[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def test_fingerprint():
    for text in [None, "", "A b", "One two THREE four five", "ä Ä b c d e f g", "a\xa0b c\x1fd e f"]:
        assert simhash(text) == plain(text)


@pytest.mark.parametrize("limit", [4096, 8])
def test_links_lose_nothing(spark, limit):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**64, 150, dtype=np.uint64)]
    for center in fps[:4]:  # groups of near copies, chains beyond the radius among them
        for _ in range(60):
            center ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.append(center)
    base = fps[100]
    fps += [base ^ (1 << i) ^ (1 << j) for i in range(6) for j in range(6, 20)]
    signed = [f - 2**64 if f >= 2**63 else f for f in set(fps)]
    found = links(spark.createDataFrame([(f,) for f in signed], "fp long"), cell_limit=limit).collect()
    for r in found:
        assert ((r.a ^ r.b) % 2**64).bit_count() <= 4
    parent = {f % 2**64: f % 2**64 for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        a, b = find(r.a % 2**64), find(r.b % 2**64)
        parent[a] = b
    groups = {}
    for f in parent:
        groups.setdefault(find(f), set()).add(f)
    assert {frozenset(g) for g in groups.values()} == components(fps)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_any_radius_in_large_cells(spark, radius):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 2**62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 6), replace=False)) for _ in range(60)}
    rows = links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, cell_limit=2).collect()
    assert all((r.a ^ r.b).bit_count() <= radius for r in rows)
    want = grouped([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius], fps)
    assert grouped([(r.a, r.b) for r in rows], fps) == want


def test_odd_rows(spark):
    rows = near_duplicates(with_clashes(odd(spark))).collect()
    assert len(rows) == len(odd_rows())
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert of[1].fingerprint == "0" * 16 and of[1].component_id == of[2].component_id == of[3].component_id == 1
    assert of[6].component_id == of[7].component_id == of[8].component_id == 6
    assert near_duplicates(empty(spark)).count() == 0


def test_keep_first(spark):
    kept = keep_first(with_clashes(odd(spark)))
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(set(ids)) and {1, 4, 5, 6, 9} <= set(ids) and not {2, 3, 7, 8} & set(ids)
    assert kept.columns == with_clashes(odd(spark)).columns


def test_nulls_only(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert [r.component_id for r in near_duplicates(docs).collect()] == [None, None]
    assert keep_first(docs).count() == 1


def grouped(pairs, nodes):
    parent = {d: d for d in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = {}
    for d in nodes:
        groups.setdefault(find(d), set()).add(d)
    return {frozenset(g) for g in groups.values()}


def edited_copies(n_copies=40, n_words=100, n_edits=2, seed=5):
    """Edits of one original that stand two by two far apart, and the original, by id."""
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(10**6)}" for _ in range(n_words)]
    texts = {n_copies: " ".join(base)}
    for i in range(n_copies):
        own = list(base)
        for at in rng.choice(n_words, n_edits, replace=False):
            own[at] = f"edit{i}x{at}"
        texts[i] = " ".join(own)
    return texts


def components_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.component, set()).add(r.doc_id)
    return {frozenset(g) for g in groups.values()}


def test_large_cells_lose_nothing(spark):
    """A cell over the limit, come in many batches, links what all pairs that share a cell link."""
    texts = edited_copies(n_words=280, n_edits=8)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        found = components_of(near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 52, cell_limit=3, similarity=0.0).collect())
    finally:
        spark.conf.set(name, before)
    wide = {d: _wide(t, 5, 6) for d, t in texts.items()}
    close = lambda a, b: np.bitwise_count(wide[a][0] ^ wide[b][0]).sum() <= 52 and set(wide[a][1]) & set(wide[b][1])
    assert found == grouped([(a, b) for a in texts for b in texts if a < b and close(a, b)], texts)


def test_links_by_exact_similarity(spark):
    texts = {1000 * k + d: t for k, n in enumerate((1, 2, 4, 5)) for d, t in edited_copies(8, 100, n, seed=k).items()}
    texts |= {9000: "x y " * 30 + "a b c d e f g h i j", 9001: "x y a b c d e f g h i j " + "i j " * 30, 9002: "p q r s t u v w", 9003: "p q r s t u v w z", 9004: "p q r s t u v z z"}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in texts.items()}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    expected = grouped([(a, b) for a in texts for b in texts if a < b and alike(a, b)], texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert components_of(near_copies(docs).collect()) == expected
    assert components_of(near_copies(docs, cell_limit=3).collect()) == expected
