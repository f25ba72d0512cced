"""Toxicity by a weighted finite-state pattern grammar.

A lexicon reads words as terminals: insult (I), threat (H), target (T), negation (N), reporting
word (R) or other (.); insults and threats carry a weight. Over the terminals of a clause run
sequential transducers, each of which puts a mark on insults and threats:

* target: one of the four words before it (and, read from right to left, behind it) is a target;
* negation: one of the three words before it is a negation;
* reported speech: a reporting word stands before it in the clause.

The transducers that read from left to right are composed into one machine (``compose``), and with
a last one that weighs each marked pattern: insult at a target, negated threat, reported insult and
so on, sixteen in all. A clause's score is the sum of its terminals' weights times the weights
on their path; a target, negation or reporting word alone scores nothing, and an insult without a
target is a pattern of its own with a lower weight. A document is described by the sum of each
pattern over its clauses and by its best clause, which a logistic curve turns into a score. The
words' weights, further words in any language (whole words and their first five letters) and
the patterns' weights in the curve are learnt from the training labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, held_out, small_batches, stored, table

#: Labelled training rows that the grammar is learnt from, at most (chosen by hash of the id).
MAX_LABELLED = 30_000
#: A word is learnt from so many toxic documents on (or one in a hundred, if that is more, which
#: bounds their number), if its log odds less 1.64 standard errors reach this.
LEAST_DOCS, LEAST_ODDS = 5, 1.8
PREFIX = 5
#: Pieces whose terminals a worker keeps (memory only).
KEEP_PIECES = 300_000
#: Longer lines are read in parts of about so many characters, cut at the end of a clause.
_SLICE = 1 << 20

# Starting terminals; the labels reweigh insults and threats that they know.
INSULTS = "idiot moron stupid dumb fool scum trash garbage loser pathetic worthless disgusting clown imbecile jerk creep bastard".split()
THREATS = "kill hurt destroy punch stab shoot burn beat strangle die".split()
TARGETS = "you your yours u ur he she they them him her his their these those du dich dir ihr euch tu te toi vous il elle ils tú usted ustedes ellos ellas".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't won't without hardly nicht kein keine nie pas jamais sans nunca sin tampoco".split()
REPORTS = "said says say called calls told wrote writes quoted reported according allegedly claims claimed sagte nannte dijo llamó selon".split()
START_WEIGHT = 3.0

# How far targets and negations reach, in words.
TARGET_REACH, NEGATION_REACH = 4, 3
# Starting weights of the marks; an insult or threat without a target has less than half of one with it.
MARK_WEIGHTS = {"t": 1.5, "n": 0.25, "r": 0.5}
BARE_WEIGHT = 0.7

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE_END = ".!?;:\u2026\u3002\uff01\uff1f\uff1b\uff1a\u060c\u061b\u061f\u0964"
_CUT = re.compile(f"[{_CLAUSE_END}]\\s")
_GAP = re.compile(r"\s")

#: Insults and threats with every set of marks.
PATTERNS = [kind + marks for kind in "IH" for marks in ("", "t", "n", "r", "tn", "tr", "nr", "tnr")]
_PLACE = {p: k for k, p in enumerate(PATTERNS)}
TERMINALS = [*"TNR.", *PATTERNS]


def _marked(symbol: str, mark: str) -> str:
    """An insult or threat with one mark more; other terminals as they are."""
    if symbol[0] not in "IH" or mark in symbol[1:]:
        return symbol
    return symbol[0] + "".join(m for m in "tnr" if m == mark or m in symbol[1:])


@dataclass
class Transducer:
    """A sequential transducer: (state, symbol) -> (next state, symbol written, weight)."""

    start: object
    steps: dict[tuple, tuple] = field(default_factory=dict)

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for symbol in symbols:
            state, written, weight = self.steps[state, symbol]
            out.append((written, weight))
        return out

    def compose(self, then: Transducer) -> Transducer:
        """The transducer that does this one and ``then`` on what it writes; weights multiply."""
        out = Transducer((self.start, then.start))
        symbols, todo, known = {s for _, s in self.steps}, [out.start], {out.start}
        while todo:
            here = todo.pop()
            for symbol in symbols:
                first, written, weight = self.steps[here[0], symbol]
                second, last, more = then.steps[here[1], written]
                out.steps[here, symbol] = ((first, second), last, weight * more)
                if (first, second) not in known:
                    known.add((first, second))
                    todo.append((first, second))
        return out


def within(trigger: str, mark: str, reach: int | None) -> Transducer:
    """Marks insults and threats up to ``reach`` words after a trigger (None: anywhere after it). The
    state is how many words the trigger still reaches."""
    full = 1 if reach is None else reach
    out = Transducer(0)
    for state in range(full + 1):
        for symbol in TERMINALS:
            left = full if symbol == trigger else state if reach is None else max(0, state - 1)
            out.steps[state, symbol] = (left, _marked(symbol, mark) if state else symbol, 1.0)
    return out


def pattern_weight(pattern: str) -> float:
    weight = 1.0 if "t" in pattern else BARE_WEIGHT
    for mark in pattern[1:]:
        weight *= MARK_WEIGHTS[mark]
    return weight


def weighing() -> Transducer:
    """Weighs every marked pattern; all else has weight 0."""
    return Transducer(0, {(0, s): (0, s, pattern_weight(s) if s in _PLACE else 0.0) for s in TERMINALS})


#: From right to left: targets behind. From left to right: targets before, negation, report, weight.
BEHIND = within("T", "t", TARGET_REACH)
CLAUSE = within("T", "t", TARGET_REACH).compose(within("N", "n", NEGATION_REACH)).compose(within("R", "r", None)).compose(weighing())


def match(terminals: list[str]) -> list[tuple[str, float]]:
    """The marked pattern and its weight at each terminal of a clause."""
    return CLAUSE.run([s for s, _ in BEHIND.run(reversed(terminals))][::-1])


def learn_terms(train: DataFrame) -> dict[str, float]:
    """{word or ~prefix: weight} from (toxic, text) of the training rows."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}']+"))
    terms = train.select("toxic", words.alias("words"))
    stems = F.transform(F.filter("words", lambda w: F.length(w) > PREFIX), lambda w: F.concat(F.lit("~"), F.substring(w, 1, PREFIX)))
    terms = terms.select("toxic", F.explode(F.array_distinct(F.concat("words", stems))).alias("term")).where("length(term) > 2")
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    size = train.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = (size.bad or 0), (size.n or 0) - (size.bad or 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5))
    least = max(LEAST_DOCS, int(0.01 * bad))
    seed = F.col("term").isin([*INSULTS, *THREATS])
    kept = counts.withColumn("odds", odds).where(((F.col("bad") >= least) & (odds - 1.64 * error >= LEAST_ODDS)) | seed)
    weights = {w: START_WEIGHT for w in [*INSULTS, *THREATS]}
    # each learnt term is in a hundredth of the toxic training documents: a hundred times the words of one at most
    weights |= {r.term: max(0.0, float(r.odds)) for r in kept.where("n >= 3").collect()}
    return weights


class Grammar:
    """Scores texts; built once in a worker from the learnt weights."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.marks = dict.fromkeys(TARGETS, "T") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(REPORTS, "R")
        self.threats = set(THREATS)
        self.pieces: dict[str, bool] = {}

    def holds(self, piece: str) -> bool:
        """Whether a piece between white space holds an insult or threat."""
        if len(self.pieces) >= KEEP_PIECES:
            self.pieces.clear()
        out = self.pieces[piece] = any(self.weight(w) > 0 for w in _WORD.findall(piece.lower()))
        return out

    def weight(self, word: str) -> float:
        own = self.weights.get(word)
        return own if own is not None else self.weights.get("~" + word[:PREFIX], 0.0) if len(word) > PREFIX else 0.0

    def clauses(self, pieces: list[str]) -> Iterator[tuple[list[str], list[float]]]:
        """Terminals and weights of each clause that has an insult or threat."""
        terminals: list[str] = []
        weights: list[float] = []
        for piece in pieces:
            for word in _WORD.findall(piece.lower()):
                weight = self.weight(word)
                terminals.append(("H" if word in self.threats else "I") if weight > 0 else self.marks.get(word, "."))
                weights.append(weight)
            if piece[-1] in _CLAUSE_END:
                if any(weights):
                    yield terminals, weights
                terminals, weights = [], []
        if any(weights):
            yield terminals, weights

    def values(self, text: str | None) -> list[float]:
        """The sum of each pattern over the clauses of a whole text, and the score of the best clause."""
        sums, best = [0.0] * len(PATTERNS), 0.0
        known = self.pieces
        for line in _lines(text or ""):
            pieces = line.split()
            if not any([known[p] if p in known else self.holds(p) for p in pieces]):
                continue
            for terminals, weights in self.clauses(pieces):
                score = 0.0
                for (pattern, on_path), weight in zip(match(terminals), weights, strict=True):
                    if weight > 0:
                        sums[_PLACE[pattern]] += weight
                        score += weight * on_path
                best = max(best, score)
        return [*sums, best]


def _lines(text: str) -> Iterator[str]:
    """Lines; very long ones in parts that end with a clause, or at white space if none ends for as long."""
    for line in text.split("\n"):
        at = 0
        while at < len(line):
            cut = None
            if len(line) - at > 2 * _SLICE:
                cut = _CUT.search(line, at + _SLICE, at + 2 * _SLICE) or _GAP.search(line, at + 2 * _SLICE)
            to = cut.end() if cut else len(line)
            yield line[at:to]
            at = to


def _values(weights: dict[str, float]):
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        grammar = Grammar(weights)
        return pd.Series([grammar.values(t) for t in texts])

    return run


#: Where the curve's weights start: patterns by their weights, the best clause, a bare text well below one half.
_START = np.array([-4.0, *(pattern_weight(p) for p in PATTERNS), 1.0])


def _curve(values: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Logistic weights of 1 and the logs of 1 + each value, by Newton steps with a ridge about ``_START``."""
    if not len(toxic) or toxic.min() == toxic.max():
        return _START.tolist()
    x = np.c_[np.ones(len(values)), np.log1p(values)]
    ridge = np.diag([0.1, *[3.0] * (x.shape[1] - 1)])
    w = _START.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (toxic - p) - ridge @ (w - _START))
        w = w + step * min(1.0, 2.0 / np.abs(step).max()) if np.abs(step).max() else w
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score double (0 to 1),
    predicted int (score >= 0.5), values (of the patterns and the best clause).

    Null and empty texts match nothing and get the score of a text without a match. Texts of any length
    are read as a whole, line by line. Labels (doc_id, toxic) of held-out documents are not read;
    null labels are none; of several labels of a document the largest counts, of several texts the
    first in order. Without labels the starting terminals and curve hold. Repeated rows stay and
    equal texts have equal scores; an empty table gives no rows; further columns are ignored."""
    small_batches(docs.sparkSession)
    known = checkpoint(labels.where(~held_out()).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = known.count()
    if n > max_labelled:  # a bounded sample: the hash decides
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    own = docs.select("doc_id", "text").join(broadcast_if_small(known), "doc_id")
    train = stored(own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))  # a row for each label
    run = _values(learn_terms(train))
    sample = train.select("toxic", run("text").alias("v")).collect()
    sample.sort()
    values, toxic = np.array([r.v for r in sample]).reshape(-1, len(PATTERNS) + 1), np.array([r.toxic for r in sample], float)
    w = _curve(values, toxic)
    scored = docs.select("doc_id", run("text").alias("values"))
    z = F.lit(w[0])
    for k, weight in enumerate(w[1:]):
        z = z + F.lit(weight) * F.log1p(F.get("values", F.lit(k)))
    scored = scored.select("doc_id", held_out().alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"), "values")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
