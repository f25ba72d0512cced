"""Retrieval by keys against comparing everything with everything."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import postings, search
from larkspur.operators.postings import Index, misspelt, text_keys, with_deletions, with_ordered_keys, within
from larkspur.plans import search_queries as Q
from larkspur.sources import shop

WORDS = "cold red gear widget bolt ring plate rod anvil gizmo small large blue hot ice è ß 漢字 🙂x a1 42".split()


def catalogue(spark, n, seed=1, null_every=37):
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    rows = [(i, pick(2), pick(1), pick(1), None if i % null_every == 0 else pick(4), f"REF-{i:05d}") for i in range(n)]
    return spark.createDataFrame(rows, "id_product int, name string, brand string, short_desc string, description string, reference string")


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def pairs(df):
    rows = [(r.query_id, r.id_product) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_ten_thousand_queries(spark):
    """Each finds the products that hold it, and the plan joins by keys."""
    cat = catalogue(spark, 3000)
    rng = random.Random(2)
    texts = [f"{rng.randrange(3000):04d}" for _ in range(6000)] + [f"ref-{rng.randrange(3000):05d}" for _ in range(3990)] + ["cold", "🙂x", "漢字", "zzzz", "è ß", "a1 42", "old re", "ar", "ring pl", "d"]
    found = search.candidates(cat, asked(spark, texts), limit=10**6, few=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = pairs(found.select("query_id", "id_product"))
    held = ["\n".join(v or "" for v in (r.name, r.short_desc, r.description, r.reference, r.brand)).lower() for r in cat.collect()]
    terms = {r.query_id: r.terms for r in search.with_words(asked(spark, texts)).select("query_id", "terms").collect()}
    by_term = {t: [i for i, text in enumerate(held) if t in text] for ts in terms.values() for t in ts}
    assert got == {(q, i) for q, ts in terms.items() for t in ts for i in by_term[t]}


def test_few_and_many_agree(spark, tmp_path):
    cat = catalogue(spark, 400)
    words = asked(spark, ["cold gear", "widge", "42", "a1", "gizmo ring plate", "*", "x"])
    folder = str(tmp_path)
    stored = search.search_index(cat).write(folder)
    few = pairs(search.candidates(cat, words, 10**6, few=True))
    assert few and few == pairs(search.candidates(cat, words, 10**6, few=False)) == pairs(search.candidates(cat, words, 10**6, index=stored)) == pairs(search.candidates(cat, words, 10**6, index=Index.read(spark, folder)))
    assert pairs(search.exact_words(cat, words)) == pairs(search.exact_words(cat, words, stored))


@pytest.mark.parametrize("phonetic", [True, False])
def test_fuzzy_few_and_many_agree(spark, phonetic):
    cat = catalogue(spark, 300)
    words = asked(spark, ["colde widgit", "kold", "gzm", "rnig", "plte xyz", "anvl", "🙂xa", "ab"])
    few = pairs(search.fuzzy_candidates(cat, words, 10**6, phonetic, few=True))
    assert few and few == pairs(search.fuzzy_candidates(cat, words, 10**6, phonetic, few=False))
    if phonetic:
        assert few == pairs(search.fuzzy_candidates(cat, words, 10**6, index=search.fuzzy_index(cat)))


def test_rare_pairs_leave_few_walks(spark, sf):
    """Of all products, those that have the rarest ordered pair of a word's letters are few."""
    cat = shop.catalog(spark, sf)
    index = search.fuzzy_index(cat)
    probes = asked(spark, ["wijet", "gzm"]).select("query_id", F.array(postings.ordered_keys(postings.letters_of(F.col("query")))).alias("needs"))
    met = postings.look_up(index, probes).groupBy("query_id").count().collect()
    assert all(r["count"] < 0.3 * cat.count() for r in met)


def test_empty_tables(spark):
    cat, none = catalogue(spark, 20), catalogue(spark, 0)
    words = asked(spark, ["cold"])
    for few in (True, False):
        assert search.candidates(none, words, few=few).count() == 0
        assert search.candidates(cat, words.where("query_id < 0"), few=few).count() == 0
        assert search.fuzzy_candidates(cat, words.where("query_id < 0"), few=few).count() == 0


def test_text_keys(spark):
    row = spark.createDataFrame([("ab🙂\nc",), ("",), (None,)], "t string").select(text_keys(F.col("t")).alias("k")).collect()
    # a letter outside the first plane also leaves keys of its second half, in terms and texts alike
    assert {k for k in row[0].k if "?" not in k} == {"a", "b", "🙂", "\n", "c", "ab", "b🙂", "🙂\n", "\nc", "ab🙂", "b🙂\n", "🙂\nc"} and row[1].k == row[2].k == []


def test_ordered_keys(spark):
    texts = ["cold", "aba", "x y", "", None, "é漢é"]
    rows = with_ordered_keys(spark.createDataFrame([(t,) for t in texts], "t string"), ["t"], "k").collect()
    for r in rows:
        t = (r.t or "").replace(" ", "")
        assert set(r.k) == {">" + t[i] + t[j] for i in range(len(t)) for j in range(i + 1, len(t))}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def misspell(rng, word, edits):
    for _ in range(edits):
        i = rng.randrange(len(word) + 1)
        word = rng.choice([word[:i] + rng.choice("abc") + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice("abc") + word[i + 1 :]])
    return word


def test_neighbourhoods_lose_nothing(spark):
    """All pairs within a distance of three share a key, whatever their length."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde") for _ in range(n)) for n in (1, 2, 3, 4, 6, 9, 12, 17, 18, 19, 20, 21, 22, 23, 24, 25, 27, 40, 90)]
    others = sorted({misspell(rng, w, e) for w in base for e in (0, 1, 2, 3) for _ in range(6)} - {""})
    left = with_deletions(spark.createDataFrame([(w,) for w in base], "word string"), "word", F.lit(3), "__keys")
    right = with_deletions(spark.createDataFrame([(w,) for w in others], "word string"), "word", F.lit(3), "__keys").withColumnRenamed("word", "other")
    met = {(r.word, r.other) for r in within(left, right).collect()}
    assert {(a, b) for a in base for b in others if levenshtein(a, b) <= 3} <= met


@pytest.mark.parametrize("phonetic", [True, False])
def test_misspelt_few_and_many_agree(spark, phonetic):
    rng = random.Random(4)
    names = sorted({misspell(rng, w, e).lower() for w in ["brandish", "acme tools", "gizmo", "nordic", "brand#13", "brand#21", "ooo", "superextraordinarylongbrandname", "a" * 30] for e in (0, 1, 3) for _ in range(8)} - {""})
    words = [(k, misspell(rng, n, k % 4)) for k, n in enumerate(names)] + [(900, "brndsh"), (901, "tools"), (902, "nrdc"), (903, "x")]
    asked_words, known = spark.createDataFrame(words, "query_id int, word string"), spark.createDataFrame([(n,) for n in names], "name string")
    rows = lambda few: sorted((r.query_id, r.word, r.name) for r in misspelt(asked_words, known, phonetic, few).collect())
    many = misspelt(asked_words, known, phonetic)
    assert "NestedLoop" not in many._jdf.queryExecution().executedPlan().toString()
    assert rows(True) == rows(False) and len(rows(False)) > 40


def test_fuzzy_rows_few_and_many_agree(spark, sf):
    terms = search.linguistic_terms(asked(spark, ["widgit", "smal rng", "anvol of", "zz"]), Q.synonyms(spark))
    rows = lambda few: sorted((r.query_id, r.id_product, round(r.fuzzy_score, 6)) for r in search.fuzzy_rows(shop.catalog(spark, sf), terms, few=few).collect())
    assert rows(True) == rows(False) != []


def test_full_search_has_no_nested_loop_over_the_catalogue(spark, sf):
    frame = Q.full_search(spark, sf)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    loops = [line for line in plan.toString().splitlines() if "BroadcastNestedLoopJoin" in line]
    assert all("keywords" in line or "Inner" in line for line in loops) and "CartesianProduct" not in plan.toString()


@pytest.mark.parametrize("name", ["search_corrected", "search_many"])
def test_posting_lists_are_not_broadcast(spark, sf, name):
    """However small the planner takes them for, neither the lists nor the catalogue of many queries go through the driver."""
    frame = Q.QUERIES[name](spark, sf)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not any("salt" in line for line in joins)
    if name == "search_corrected":  # one stated query: a scan, as ``search`` does it
        assert "salt" not in plan
    else:
        assert not any("[id_product" in line or "[query_id" in line for line in joins)
        assert sum("SortMergeJoin" in line and "salt" in line for line in plan.splitlines()) > 0


def test_neighbourhoods_are_not_broadcast(spark):
    left, right = asked(spark, ["cold"]).withColumn("__keys", F.array("query")), asked(spark, ["cold", "gear"]).select(F.col("query").alias("name"), F.array("query").alias("__keys"))
    frame = within(left, right)
    assert [r.name for r in frame.collect()] == ["cold"] and "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()
