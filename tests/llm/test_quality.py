import numpy as np
from pyspark.sql import functions as F
from texts import empty, odd, odd_rows, with_clashes

from larkspur.llm.quality import BUCKETS, FEATURES, LEVELS, QUANTILES, Describer, classify, describe, fit_non_negative, keep_good, learn_describer, op8_quality, surface, trigrams


def test_surface():
    assert surface(None) == surface("") and len(surface("a b")) == len(FEATURES) - 1
    v = dict(zip(FEATURES, surface("AB AB AB cd | !!"), strict=False))
    assert v["repeated_neighbours"] == 2 / 6 and v["bars_per_word"] == 1 / 6 and v["exclaims_per_word"] == 2 / 6 and v["upper_share"] == 6 / 8 and v["repeated_words"] == 1 - 4 / 6


def test_slices_change_nothing(monkeypatch):
    from larkspur.llm import quality

    texts = ["some Words | in a row row! " * 40, "x" * 500, "a a a\n" * 100, "né " * 90, "", " " * 200]
    whole = [(surface(t), trigrams(t).tolist()) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(quality, "_SLICE", size)
        assert [(surface(t), trigrams(t).tolist()) for t in texts] == whole


def test_cells_against_plain_version(spark, sf):
    """Rare buckets, cuts and cells, counted in plain Python over all documents."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and doc_id % 3 > 0").select("doc_id").distinct()
    ids = {r.doc_id for r in good.collect()}

    def plain(text):
        raw, out = "".join(c.lower() if c.isascii() else c for c in text or "").encode(), [0] * BUCKETS
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
            out[((h ^ h >> 15) * 0x2C1B3C6D) % 2**32 >> 23] += 1
        return out

    counts = {r.doc_id: np.array(plain(r.text)) for r in rows}
    every, own = sum(counts.values()) + 1, sum(counts[d] for d in counts if d in ids) + 1
    rare = np.log(own / own.sum()) - np.log(every / every.sum()) < -0.5
    found = learn_describer(spark.read.parquet(f"{sf}/documents.parquet"), good)
    assert found.rare.tolist() == rare.tolist()
    values = {r.doc_id: [*surface(r.text), counts[r.doc_id][rare].sum() / max(1, counts[r.doc_id].sum())] for r in rows}
    cuts = np.quantile([values[d] for d in sorted(ids & values.keys())], QUANTILES, axis=0).T
    assert np.allclose(found.cuts, cuts)
    want = {d: sum(sum(x > c for c in own) * LEVELS ** (len(FEATURES) - 1 - k) for k, (x, own) in enumerate(zip(v, found.cuts, strict=True))) for d, v in values.items()}
    assert {r.doc_id: r.cell for r in found.with_cell(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == want


def test_very_long_text(spark):
    text = "the same few words " * 150_000
    rare = np.zeros(BUCKETS, bool)
    assert describe(text, rare)[5] == 1 - 4 / 600_000 and describe(text, rare)[7] == -600_000
    own = Describer(rare, np.zeros((len(FEATURES), LEVELS - 1)))
    assert own.with_cell(spark.createDataFrame([(text,)], "text string")).count() == 1


def test_risk_finds_prior_and_negatives():
    top = LEVELS ** (len(FEATURES) - 1)
    cells = np.array([0, 1, 3 * top, 3 * top + 1])
    positive, corpus = np.array([500, 300, 2, 1]), np.array([5000, 3000, 1200, 800])
    weights, prior = fit_non_negative(cells, positive, corpus)
    assert 0.7 < prior < 0.9
    from larkspur.llm.quality import _one_hot, _sigmoid

    scores = _sigmoid(_one_hot(cells) @ weights)
    assert scores[:2].min() > 0.8 and scores[2:].max() < 0.2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    good = [r for r in rows if r.quality]
    assert sum(r.predicted for r in good) / len(good) > 0.99


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, None), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = with_clashes(odd(spark))
    rows = classify(docs, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert classify(empty(spark), labels).count() == 0
    assert {r.score for r in classify(docs, labels.where(F.lit(False))).collect()} == {0.5}
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
