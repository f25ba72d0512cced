"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes marks boundaries wherever its low bits are all one; the
block size (a power of two) says how many bits. Each piece between boundaries becomes one of 64
characters of its hash. A text's own block size is the one that cuts its bytes into 32 to 64
pieces or so. A fingerprint is ``block:signature:signature:...``: signatures of at most 64
characters (the last piece takes the rest) at twice the block size, at the block size, and at half
the size before down to LEAST_BLOCK.

Fingerprints are compared by the edit distance of signatures made at one block size: the largest
that both have at which both are at least half full. A text that repeats itself may have no
boundary at all at its own block size; halving finds one. Texts whose block sizes differ by more
than a factor of two are not alike."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

WINDOW = 7
LENGTH = 64
LEAST_BLOCK = 4
_SLICE = 1 << 20
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BYTE = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
_POWER = [np.uint32(pow(0x9E3779B1, k, 2**32)) for k in range(WINDOW)]


def _boundaries(raw: bytes, sizes: list[int]) -> list[list[int]]:
    """The first ends of pieces at each of these falling block sizes."""
    found: list[list[int]] = [[] for _ in sizes]
    for at in range(0, len(raw), _SLICE):
        least = max((k for k, ends in enumerate(found) if len(ends) < LENGTH - 1), default=-1)
        if least < 0:
            break
        begin = max(0, at - WINDOW + 1)
        values = _BYTE[np.frombuffer(raw, np.uint8, min(len(raw), at + _SLICE) - begin, begin)]
        rolled = values.copy()
        for k in range(1, min(WINDOW, len(values))):
            rolled[k:] += values[:-k] * _POWER[k]
        rolled = rolled[at - begin :] >> np.uint32(9)
        hit = np.arange(len(rolled))
        for k in range(least, -1, -1):  # a boundary of a larger block is one of each smaller block
            hit = hit[(rolled[hit] & np.uint32(sizes[k] - 1)) == sizes[k] - 1]
            found[k] += (hit[: LENGTH - 1 - len(found[k])] + at + 1).tolist()
    return found


def _signature(raw: bytes, ends: list[int]) -> str:
    if not ends or ends[-1] < len(raw):
        ends = [*ends, len(raw)]
    starts = [0, *ends[:-1]]
    return "".join(_LETTERS[(zlib.crc32(raw[a:b]) >> 7) & 63] for a, b in zip(starts, ends, strict=True)) if raw else ""


def fingerprint(text: str | None) -> str:
    raw = (text or "").encode("utf-8", "surrogatepass")
    block = LEAST_BLOCK
    while block * LENGTH < len(raw):
        block *= 2
    sizes = [2 * block >> k for k in range((2 * block // LEAST_BLOCK).bit_length())]
    return ":".join([str(block), *(_signature(raw, ends) for ends in _boundaries(raw, sizes))])


def with_fingerprint(docs: DataFrame, text_col: str = "text", to: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of the whole text; null counts as empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype=object)

    return docs.withColumn(to, run(F.col(text_col)))


def likeness(a: str, b: str) -> F.Column:
    """0 to 1: of two fingerprint columns. Equal fingerprints: 1."""
    x, y = F.split(a, ":"), F.split(b, ":")
    block_x, block_y = x[0].cast("long"), y[0].cast("long")
    # signatures at the sizes that both have, the smallest first
    shared = F.least(F.size(x), F.size(y)) - 1
    small = lambda fields: F.slice(F.reverse(F.slice(fields, F.lit(2), F.size(fields))), F.lit(1), shared)
    both = F.zip_with(small(x), small(y), lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    full = F.filter(both, lambda p: (F.length(p["s"]) >= LENGTH // 2) & (F.length(p["t"]) >= LENGTH // 2))
    p = F.when(F.size(full) > 0, F.element_at(full, -1)).otherwise(F.get(both, F.lit(0)))
    longest = F.greatest(F.length(p["s"]), F.length(p["t"]))
    alike = F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(p["s"], p["t"]) / longest)
    apart = F.greatest(block_x, block_y) > 2 * F.least(block_x, block_y)
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(apart, F.lit(0.0)).otherwise(alike)


def _bucket(key: F.Column, bounds: list[int]) -> F.Column:
    """Number of bounds below the key, by a tree of comparisons."""

    def tree(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key > bounds[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def with_next(docs: DataFrame, columns: tuple[str, ...], buckets: int) -> DataFrame:
    """Adds next_<column> of the next row in descending doc_id (after the last: the first).

    Rows are dealt to ranges of ids, so no task holds the whole order. The top row of a range is
    also sent, as a guest, to the range above it, whose last row it follows."""
    least = -(2**63)
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(least)))
    shares = [k / buckets for k in range(1, buckets)]
    # of all ids; at most ``buckets`` numbers reach the driver, here and below
    found = keyed.agg(F.percentile_approx("__key", shares, 10_000)).first()[0] if shares else []
    keyed = keyed.withColumn("__bucket", _bucket(F.col("__key"), sorted(set(found or []))))
    tops = dict(map(tuple, keyed.groupBy("__bucket").agg(F.max("__key")).collect()))
    order = sorted(tops)
    above = [(tops[b], order[(k + 1) % len(order)]) for k, b in enumerate(order)]
    guests = docs.sparkSession.createDataFrame(above, "__key long, __above int")
    both = keyed.join(F.broadcast(guests), "__key", "left")
    at = F.when(F.col("__above").isNull(), F.array("__bucket")).otherwise(F.array("__bucket", "__above"))
    both = both.select("*", F.posexplode(at).alias("__guest", "__in")).drop("__bucket", "__above")
    window = Window.partitionBy("__in").orderBy("__guest", F.col("__key").desc(), F.col("text").asc_nulls_first())
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(window))
    return both.where("__guest = 0").drop("__key", "__guest", "__in")


def compare_edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_chars, fingerprint, edited (the
    text with its last half replaced by the next document's beginning), edited_sha256,
    edited_fingerprint, near_edited, near_next.

    A null text counts as empty, whose fingerprint has empty signatures. Rows of equal doc_id
    follow each other by text; null ids come last. A single row is its own next. Texts of any length
    are read whole, a slice at a time. An empty table gives no rows. Further columns are dropped first, so names cannot clash."""
    if buckets is None:
        buckets = min(4096, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if own.limit(1).isEmpty():
        buckets = 1
    own = with_next(with_fingerprint(own), ("text", "fingerprint"), buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    own = own.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    own = with_fingerprint(own, "edited", "edited_fingerprint")
    return own.select(
        "doc_id", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op9_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents")).drop("edited")


QUERIES = {"op9_piecewise_hash": op9_piecewise_hash}
ORACLES: dict[str, str] = {}
