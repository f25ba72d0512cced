import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm.whitening import components_of, fit, moments, op11_whitening, symmetric_qr, whiten

SCHEMA = "vec_id long, embedding array<float>"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10**6), st.sampled_from(["full", "low rank", "repeated", "diagonal", "zero"]))
def test_symmetric_qr(d, seed, kind):
    rng = np.random.default_rng(seed)
    b = rng.normal(size=(d, d))
    a = {"full": b @ b.T, "low rank": np.outer(b[0], b[0]), "repeated": np.eye(d) * 3, "diagonal": np.diag(b[0]), "zero": np.zeros((d, d))}[kind]
    values, axes = symmetric_qr(a)
    want = np.linalg.eigvalsh(a)[::-1]
    size = max(1e-300, np.abs(a).max())
    assert np.allclose(values, want, atol=1e-12 * size * d)
    assert np.allclose(axes @ axes.T, np.eye(d), atol=1e-13 * d)
    assert np.allclose(axes.T * values @ axes, a, atol=1e-12 * size * d)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def by_force(rows, components=8):
    """n, sums and {(id, component): (deviation, |whitened|)} with exact sums and the library's eigen-solve."""
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if usable(v)]
    x = np.array([v for _, v in kept], object)
    n, sums = len(kept), [sum(col) for col in x.T.tolist()]
    off = np.array([[n * v - s for v, s in zip(row, sums, strict=True)] for row in x.tolist()], object)
    centred = off.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    white = centred @ axes[:, :components] / np.sqrt(values[:components])
    return n, values, {(i, k + 1): (sum(v * v for v in off[r].tolist()), white[r, k]) for r, (i, _) in enumerate(kept) for k in range(white.shape[1])}


def check(rows, want, n, values):
    assert len(rows) == len(want)
    signs = {}
    for r in rows:
        deviation, white = want[r.vec_id, r.component]
        assert r.deviation == deviation and r.n == n
        assert math.isclose(abs(r.whitened), abs(white), rel_tol=1e-7, abs_tol=1e-8)
        if abs(white) > 1e-6:
            assert signs.setdefault(r.component, r.whitened * white > 0) == (r.whitened * white > 0)
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_query_against_brute_force(spark, sf):
    rows = op11_whitening(spark, sf).collect()
    given_rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, values, want = by_force(given_rows)
    check(rows, want, n, values)


def test_dropped_rows_and_many_partitions(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1 + j) + (j == 2) * rng.random() for j in range(5)]) for k in range(300)]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [math.nan] * 5), (903, [1.0, 2.0, math.inf, 1.0, 1.0]), (904, [-math.inf] * 5), (905, [])]
    hot = [(1000 + k, [0.5] * 5) for k in range(400)]
    docs = spark.createDataFrame(rows + bad + hot, SCHEMA).repartition(170)
    kept = [(r.vec_id, r.embedding) for r in docs.collect()]
    n, values, want = by_force(kept)
    check(components_of(docs).collect(), want, n, values)
    assert {c for _, c in want} == {1, 2, 3, 4, 5} and n == 700


def test_moments_are_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-2e15, 2e15), 7.25, rng.uniform(-1, 1)]) for k in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    found = moments(docs, "embedding")
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    assert found.sums == [sum(col) for col in zip(*x, strict=True)]
    white = whiten(docs, fit(docs)).select("vec_id", "deviation").collect()
    assert {r.vec_id: None if r.deviation is None else int(r.deviation) for r in white} == {k: t if (t := sum((60 * v - s) ** 2 for v, s in zip(row, found.sums, strict=True))) < 10**38 else None for k, row in enumerate(x)}
    assert all(r.deviation is None or r.deviation < 2**63 for r in components_of(docs).collect())


def test_other_lengths_ties_and_no_variance(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0, 2.0, 3.0]), (None, [0.0, 5.0]), (1, [1.0, 2.0])]
    out = components_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)] and {r.n for r in out} == {4}
    assert components_of(spark.createDataFrame([(k, [1.0, 4.0]) for k in range(9)], SCHEMA)).collect() == []
    line = components_of(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and math.isclose(line[0].explained, 1)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [0.5, 0.25])]])
def test_empty(spark, rows):
    assert components_of(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_clashes(spark):
    rows = [(k, [float(k % 7), float(k % 3)]) for k in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "component", "dims", "i", "mean", "deviation", "whitened", "bucket", "__own", "at"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert len(components_of(docs).collect()) == 60
    out = whiten(docs, fit(docs))
    assert out.columns[-2:] == ["deviation", "whitened"] and {r["__own"] for r in out.collect()} == {"clash"}
