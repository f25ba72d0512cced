"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents that the labels call good (training rows only); the
unlabelled text is the whole corpus. No negative label is ever used. A document is described by
nine values: eight of its surface, and the share of its byte trigrams (hashed into buckets) that
are rarer in the positives than in the corpus. Which buckets are rare is counted over all
documents; each value is cut into four levels at quantiles of the positives. So a document falls
into one of 4^9 cells. Counting cells takes one pass over all documents and leaves at most
262,144 rows for the driver, whatever the corpus: the non-negative unbiased risk (Kiryo et al.,
2017) over all documents is then minimised exactly on these counts, with an additive logistic
model (one weight a level). The class prior is estimated from the same counts: the smallest
ratio of the corpus's share to the positives' share over upper level sets of a first model,
where the positives have enough rows to tell."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, held_out, small_batches, stored, table

THRESHOLD = 0.3
#: Trusted positives that quantiles and the positives' counts are taken from, at most (by hash of the id).
MAX_LABELLED = 30_000
LEVELS = 4
#: Quantiles of the positives at which each value is cut: a level is the number of cuts exceeded.
QUANTILES = (0.5, 0.95, 0.999)
FEATURES = ("symbols_per_word", "upper_share", "bars_per_word", "exclaims_per_word", "repeated_neighbours", "repeated_words", "letters_missing", "few_words", "rare_trigrams")
BUCKETS = 512
#: A bucket is rare if its log share in the positives is lower by this than in the corpus.
RARE = 0.5
_SYMBOLS = b"*&%$#@^~<>{}[]=_\\+"


def _outside(keep: bytes) -> bytes:
    return bytes(sorted(set(range(256)) - set(keep)))


_UPPER, _SYMBOL = _outside(bytes(range(65, 91))), _outside(_SYMBOLS)
_LETTER = _outside(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
#: A text is read in slices of about so many characters, which change no value.
_SLICE = 1 << 20
_GAP = re.compile(r"\s")


def surface(text: str | None) -> list[float]:
    """The first eight values of a whole text; null counts as empty."""
    text = text or ""
    total = upper = symbol = letter = bars = bangs = words = neighbours = 0
    seen, last, at = np.empty(0, np.int64), None, 0
    while at < len(text):
        gap = _GAP.search(text, at + _SLICE) if at + _SLICE < len(text) else None
        to = gap.start() if gap else len(text)
        part, at = text[at:to], to
        raw = part.encode("utf-8", "surrogatepass")
        own = part.split()
        total += len(raw) - len(own)
        upper += len(raw.translate(None, _UPPER))
        symbol += len(raw.translate(None, _SYMBOL))
        letter += len(raw.translate(None, _LETTER))
        bars += raw.count(b"|")
        bangs += raw.count(b"!")
        words += len(own)
        if own:
            neighbours += sum(map(eq, own, own[1:])) + (own[0] == last)
            last = own[-1]
            fresh = set(own)  # of a long text the hashes of its words are kept
            seen = np.union1d(seen, np.fromiter(map(hash, fresh), np.int64, len(fresh))) if len(own) < words or at < len(text) else fresh
    n = max(words, 1)
    return [symbol / n, upper / max(letter, 1), bars / n, bangs / n, neighbours / n, 1 - len(seen) / n, 1 - letter / max(total + words, 1), -words]


def trigrams(text: str | None) -> np.ndarray:
    """How many byte trigrams of a whole text, A-Z lower-cased, fall into each bucket."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw) - 2, _SLICE):
        b = np.frombuffer(raw[at : at + _SLICE + 2].lower(), np.uint8).astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out += np.bincount(h >> np.uint32(23), minlength=BUCKETS)
    return out


def describe(text: str | None, rare: np.ndarray) -> list[float]:
    counts = trigrams(text)
    return [*surface(text), float(counts[rare].sum() / max(counts.sum(), 1))]


def cell_of(values: list[float], cuts: np.ndarray) -> int:
    cell = 0
    for own, value in zip(cuts, values, strict=True):
        cell = cell * LEVELS + int((value > own).sum())
    return cell


@dataclass(frozen=True)
class Describer:
    """What turns a text into a cell: the rare buckets and each value's cuts."""

    rare: np.ndarray
    cuts: np.ndarray

    def with_cell(self, docs: DataFrame, text_col: str = "text", to: str = "cell") -> DataFrame:
        small_batches(docs.sparkSession)

        @F.pandas_udf("int")
        def cell(texts: pd.Series) -> pd.Series:
            return pd.Series([cell_of(describe(t, self.rare), self.cuts) for t in texts], dtype=np.int32)

        return docs.withColumn(to, cell(F.col(text_col)))


def _one_hot(cells: np.ndarray) -> np.ndarray:
    n = len(FEATURES)
    digits = (cells[:, None] // LEVELS ** np.arange(n - 1, -1, -1)) % LEVELS
    out = np.zeros((len(cells), n * LEVELS + 1))
    out[np.arange(len(cells))[:, None], digits + np.arange(n) * LEVELS] = 1
    out[:, -1] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(x: np.ndarray, gradient, ridge: float, rounds: int = 800, rate: float = 0.1) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        g = gradient(w) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(scores: np.ndarray, positive: np.ndarray, corpus: np.ndarray, least: float = 0.2) -> float:
    """Smallest share ratio over upper level sets that hold ``least`` of the positives."""
    order = np.argsort(-scores, kind="stable")
    p, u = np.cumsum(positive[order]), np.cumsum(corpus[order])
    ends = np.r_[scores[order][1:] != scores[order][:-1], True] & (p >= least)
    return float(np.clip((u[ends] / p[ends]).min(), 0.05, 0.98)) if ends.any() else 0.5


def fit_non_negative(cells: np.ndarray, n_positive: np.ndarray, n_corpus: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the additive model and the class prior, from counts of cells."""
    x = _one_hot(cells)
    p, u = n_positive / max(n_positive.sum(), 1), n_corpus / max(n_corpus.sum(), 1)
    if not n_positive.sum():
        return np.zeros(x.shape[1]), 0.5
    # few positives say little on levels that none of them has: a prior of three documents holds weights down
    ridge = max(1e-4, 3 / n_positive.sum())
    first = _descend(x, lambda w: x.T @ (u * _sigmoid(x @ w) - p * (1 - _sigmoid(x @ w))), ridge)
    prior = class_prior(x @ first, p, u)

    def gradient(w: np.ndarray) -> np.ndarray:
        s = _sigmoid(x @ w)
        as_negative = float((u * -np.log(1 - s + 1e-12)).sum() - prior * (p * -np.log(1 - s + 1e-12)).sum())
        negative = x.T @ (u * s - prior * p * s)
        if as_negative < 0:  # the negative part of the risk can't be below zero: step back
            return -negative
        return negative - prior * (x.T @ (p * (1 - s)))

    return _descend(x, gradient, ridge), prior


def _trusted(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id) of training rows that are called good: all, or a bounded sample by hash."""
    good = labels.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("good")).where("good = 1 and doc_id is not null").select("doc_id")
    n = good.count()
    return good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n)) if n > max_labelled else good


def learn_describer(docs: DataFrame, good: DataFrame) -> Describer:
    """Rare buckets from the trigrams of all documents and of the positives; cuts from the positives."""
    small_batches(docs.sparkSession)
    marked = docs.select("doc_id", "text").join(broadcast_if_small(good.withColumn("good", F.lit(True))), "doc_id", "left")

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, own = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, is_good in zip(batch["text"], batch["good"], strict=True):
                counts = trigrams(text)
                every += counts
                if is_good is True:
                    own += counts
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "corpus": every, "positive": own})

    counted = marked.select("text", "good").mapInPandas(totals, "bucket int, corpus long, positive long")
    rows = counted.groupBy("bucket").agg(F.sum("corpus").cast("double"), F.sum("positive").cast("double")).collect()  # BUCKETS rows
    share = np.ones((2, BUCKETS))
    for bucket, corpus, positive in rows:
        share[:, bucket] += corpus, positive
    odds = np.log(share[1] / share[1].sum()) - np.log(share[0] / share[0].sum())
    rare = odds < -RARE

    @F.pandas_udf("array<double>")
    def values(texts: pd.Series) -> pd.Series:
        return pd.Series([describe(t, rare) for t in texts])

    own = docs.select("doc_id", "text").join(broadcast_if_small(good), "doc_id", "left_semi").select("doc_id", values("text").alias("v"))
    known = own.groupBy("doc_id").agg(F.min("v").alias("v")).collect()  # a row for each trusted document
    if not known:
        return Describer(rare, np.zeros((len(FEATURES), LEVELS - 1)))
    return Describer(rare, np.quantile(np.array([r.v for r in known]), QUANTILES, axis=0).T)


def fit(described: DataFrame, good: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and class prior from (doc_id, cell) of all documents and the trusted positives.
    At most 4^9 rows of counts reach the driver."""
    positive = described.join(broadcast_if_small(good), "doc_id", "left_semi").groupBy("cell").agg(F.count("*").alias("n_positive"))
    counts = described.groupBy("cell").agg(F.count("*").alias("n_corpus"))
    rows = counts.join(positive, "cell", "left").select("cell", F.coalesce("n_positive", F.lit(0)), "n_corpus").collect()
    rows.sort()
    if not rows:
        return np.zeros(len(FEATURES) * LEVELS + 1), 0.5
    cells, n_positive, n_corpus = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
    return fit_non_negative(cells, n_positive, n_corpus)


def score_of(weights: np.ndarray) -> F.Column:
    """The score of the column ``cell``: an expression that needs no Python."""
    total = F.lit(float(weights[-1]))
    for k in range(len(FEATURES)):
        level = F.floor(F.col("cell") / LEVELS ** (len(FEATURES) - 1 - k)) % LEVELS
        own = [F.lit(float(w)) for w in weights[k * LEVELS : (k + 1) * LEVELS]]
        total = total + F.element_at(F.array(*own), (level + 1).cast("int"))
    return 1 / (1 + F.exp(-total))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out boolean, score double (0
    to 1), predicted int (score >= threshold).

    Labels (doc_id, quality) of held-out documents are not read; null labels are none; a
    document with several labels is positive if one is 1. Texts of any length are described as a
    whole; null and empty texts get the score of their cell. Without positives every score is 0.5.
    Null ids count as '' for the fold and are no positives. Repeated rows stay and equal texts have
    equal scores; an empty table gives no rows; further columns are ignored."""
    good = checkpoint(_trusted(labels, max_labelled))
    described = checkpoint(learn_describer(docs, good).with_cell(docs.select("doc_id", "text")).select("doc_id", "cell"))
    weights, _ = fit(described, good)
    scored = described.select("doc_id", held_out().alias("held_out"), score_of(weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, with all their columns. Rows are stored with
    their cells, so that no text is described again."""
    good = checkpoint(_trusted(labels, max_labelled))
    names = [f"`{c}`" for c in docs.columns]
    described = learn_describer(docs, good).with_cell(docs.select(F.struct(*names).alias("__doc"), "doc_id", "text"), to="__cell")
    described = stored(described.select("__doc", "__cell"))
    weights, _ = fit(described.select("__doc.doc_id", F.col("__cell").alias("cell")), good)
    scored = described.select("__doc", F.col("__cell").alias("cell")).select("__doc", score_of(weights).alias("__score"))
    return scored.where(F.col("__score") >= threshold).select("__doc.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
