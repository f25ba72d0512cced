import random
import re
from collections import Counter

from texts import empty, odd, with_clashes, words

import numpy as np

from larkspur.llm.decontamination import HASHES, RADIUS, decontaminate, matches, near_prints, op10_decontamination


def shingles(own):
    return [tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))]


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def brute(docs, items, threshold=0.8):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = {}
    for i, text in docs:
        own = cut(text)
        for k, item in items:
            want = cut(item)
            if not own or not want:
                continue
            n = min(len(want), len(own))
            best = max(similarity(shingles(own[s : s + n]), shingles(want)) for s in range(len(own) - n + 1))
            if best >= threshold:
                found[i, k] = best
    return found


def test_against_brute_force(spark):
    rng = random.Random(8)
    items = [(k, words(rng, rng.randint(20, 60))) for k in range(8)] + [(8, " ".join(["la", "lo"] * 12 + ["end"] * 5))]
    docs = []
    for i in range(60):
        item = items[i % 9][1].split(" ")
        for _ in range([0, 0, 1, 2, 4, 9][i % 6]):  # edited words
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], ["new"], [item[at], "more"]])
        docs.append((i, words(rng, rng.randint(0, 150)) + ". " + " ".join(item).upper() + "! " + words(rng, rng.randint(0, 150))))
    docs += [(100 + i, words(rng, 200)) for i in range(10)]
    want = brute(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in matches(with_clashes(d), b).collect()}
    assert len(want) >= 25 and set(found) <= set(want)
    assert len(found) >= 0.97 * len(want), set(want) - set(found)
    assert all(s == want[k] for k, s in found.items() if want[k] == 1)
    kept = {r.doc_id for r in decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in found}


def test_index_finds_all_within_the_radius(spark):
    """The multi-index against all pairs: nothing within the radius is lost, few others meet."""
    rng = np.random.default_rng(4)
    bits = 64 * HASHES
    items = rng.integers(0, 2, (60, bits))
    windows = np.concatenate([rng.integers(0, 2, (150, bits)), np.repeat(items, 4, axis=0)])
    for k in range(150, len(windows)):
        at = rng.choice(bits, [0, 30, 71, 85][k % 4], replace=False)
        windows[k, at] ^= 1
    longs = lambda b: [int(x) for x in np.packbits(b.astype(np.uint8), bitorder="little").view("<i8")]
    of = spark.createDataFrame([(k, 40, longs(b)) for k, b in enumerate(items)], "item long, n int, prints array<long>")
    own = spark.createDataFrame([(40, longs(b)) for b in windows], "n int, prints array<long>").distinct()
    met, near = near_prints(own, of, reach=RADIUS)
    found = {(tuple(r.prints), r.item): r.distance for r in near.collect()}
    distances = (windows[:, None, :] != items[None, :, :]).sum(axis=2)
    want = {(tuple(longs(windows[w])), k): int(distances[w, k]) for w, k in np.argwhere(distances <= RADIUS)}
    assert len(want) >= 180 and found == want
    unrelated = met.where("distance > 120").select("prints", "item").distinct().count()
    assert unrelated < 0.06 * (distances > 120).sum()


def test_documents_against_brute_force(spark):
    """All windows of all documents: recall of 0.95 at least, and nothing else."""
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute_quick(docs, items)
    found = {(r.doc_id, r.item_id): r.similarity for r in op10_decontamination(spark, sf).collect()}
    assert want and set(found) <= set(want) and len(found) >= 0.95 * len(want)
    assert all(abs(s - want[k]) < 1e-5 for k, s in found.items())


def test_exact_mode_loses_nothing(spark):
    """Every pair of the brute force, and the index's own results among them."""
    sf = "/root/testdata/sf0.001"
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_quick([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    found = {(r.doc_id, r.item_id): r.similarity for r in matches(d, b, exact=True).collect()}
    assert found.keys() == want.keys() and all(abs(s - want[k]) < 1e-9 for k, s in found.items())
    assert {(r.doc_id, r.item_id) for r in matches(d, b, reach=384).collect()} <= set(want)


def brute_quick(docs, items, threshold=0.8):
    """As ``brute``, with counts that roll along the text."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    wants = [(k, len(cut(t)), Counter(shingles(cut(t)))) for k, t in items if cut(t)]
    by_shingle = {}
    for number, (_, _, want) in enumerate(wants):
        for x in want:
            by_shingle.setdefault(x, set()).add(number)
    found = {}
    for i, text in docs:
        own = cut(text)
        if not own:
            continue
        of = shingles(own)
        for number in set().union(*(by_shingle.get(x, ()) for x in of)):
            k, n, want = wants[number]
            length, total = max(1, min(n, len(own)) - 4), sum(want.values())
            have, both = Counter(), 0
            best = 0.0
            for at, x in enumerate(of):
                have[x] += 1
                both += have[x] <= want[x]
                if at >= length:
                    old = of[at - length]
                    both -= have[old] <= want[old]
                    have[old] -= 1
                if at >= length - 1:
                    best = max(best, both / (length + total - both))
            if best >= threshold:
                found[i, k] = best
    return found


def test_very_long_item(spark):
    """Over 65,535 shingles in a window."""
    rng = random.Random(12)
    item = words(rng, 66_000)
    docs = [(1, "Some words " + item + " at the end."), (2, words(rng, 66_000)), (3, item[: len(item) // 2])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = matches(d, b).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.n_words, r.distance, r.similarity) for r in rows] == [(1, 7, 2, 66_000, 0, 1.0)]


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "x")], "item_id long, text string")
    docs = with_clashes(odd(spark))
    assert [(r.doc_id, r.item_id) for r in matches(docs, bench).collect()] == [(4, 4)]
    assert decontaminate(docs, bench).count() == docs.count() - 1 and decontaminate(docs, bench).columns == docs.columns
    assert matches(empty(spark), bench).count() == 0 and matches(docs, bench.where("false")).count() == 0
