"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

A text's words are the runs of letters and digits in lower case; its shingles are five words. A
window of a document is as many words as a benchmark item has (the whole document where it is
shorter), at any place. The similarity of a window and an item is weighted: the sum of the
smaller counts of their shingles over the sum of the larger ones.

* Which windows. A window can only reach the threshold t with an item if they share
  t / (1 + t) of their shingles together. So one pass marks the places of shingles that some
  item of a size has, and every window of that size with enough marks is kept, wherever it
  starts. This bound loses nothing.
* Fingerprints. A kept window and an item get a SimHash of their shingles, repeats counting, of
  ``HASHES`` times 64 bits. A similarity of 0.8 moves 15.2 % of the bits: 58 of 384 (standard deviation 7).
* Multi-index. Fingerprints are cut into blocks of 16 bits. Of 24 blocks, two fingerprints within
  71 bits have one that differs in two bits at most. So each side enters every value within one
  bit of its blocks (one side more, for a wider radius), and two blocks within two bits meet.
  All fingerprints within the radius are found, and beyond it most pairs meet as well (at 80 bits
  all but one in 10,000); of unrelated pairs some 5 % meet. Equal fingerprints are looked up once.
* Pairs that met and differ in ``reach`` bits at most are verified by the exact similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, free_name, row_key, table

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 6
RADIUS = 71
REACH = 95
_BLOCK = 16
_LANES = 0x0000000100000001


def _words(text: F.Column) -> F.Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(words: str) -> F.Column:
    """Hashes of the shingles of the column ``words``; fewer words make one shingle."""
    column = F.col(words)
    full = F.transform(column, lambda w, i: F.xxhash64(w, *(F.get(column, i + k) for k in range(1, SHINGLE))))
    return F.when(F.size(column) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(full, 1, F.greatest(F.size(column) - (SHINGLE - 1), F.lit(1))))


def _shingles(words: F.Column) -> F.Column:
    """How many shingles a text of so many words has."""
    return F.greatest(words - (SHINGLE - 1), F.lit(1))


def _fingerprints(counts: DataFrame, *by: str) -> DataFrame:
    """(by, h, c) -> (by, prints, total): the SimHash of the hashes h, each c times, as longs. Two
    counts of 32 bits share a sum."""
    rows = counts.select(*by, "c", F.explode(F.array(*map(F.lit, range(HASHES)))).alias("no"), "h")
    rows = rows.withColumn("h", F.xxhash64("h", "no"))
    sums = [F.sum(F.col("c") * F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES))).alias(f"s{k}") for k in range(32)]
    summed = rows.groupBy(*by, "no").agg(F.sum("c").alias("total"), *sums)
    # bits k and k + 32 come from the sum k; a fold, since one expression of 64 bits makes a huge method
    low = lambda s: (s.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("total")).cast("long")
    high = lambda s: (F.shiftrightunsigned(s, 32) * 2 > F.col("total")).cast("long")
    value = F.aggregate(F.array(*(F.col(f"s{k}") for k in reversed(range(32)))), F.lit(0).cast("long"), lambda acc, s: F.shiftleft(acc, 1).bitwiseOR(low(s)).bitwiseOR(F.shiftleft(high(s), 32)))
    one = summed.select(*by, "total", "no", value.alias("value"))
    return one.groupBy(*by).agg(F.array(*(F.max(F.when(F.col("no") == k, F.col("value"))) for k in range(HASHES))).alias("prints"), F.max("total").alias("total"))


def _entries(prints: DataFrame, flips: int, *keep: str) -> DataFrame:
    """(n, prints, ...) -> (keep, key): one key for each block and each value within ``flips`` bits of it."""
    block = lambda i, j: F.shiftleft(F.col("n").cast("long"), 24).bitwiseOR(F.lit((4 * i + j) << _BLOCK)).bitwiseOR(F.shiftrightunsigned(F.get("prints", F.lit(i)), _BLOCK * j).bitwiseAND(F.lit((1 << _BLOCK) - 1)))
    blocks = prints.select(*keep, F.explode(F.array(*(block(i, j) for i in range(HASHES) for j in range(4)))).alias("key"))
    masks = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(_BLOCK), k)]
    if len(masks) == 1:
        return blocks
    each = blocks.select("*", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"))
    return each.select(*keep, F.col("key").bitwiseXOR(F.col("mask")).alias("key"))


def _apart() -> F.Column:
    """How many bits of prints and item_prints differ."""
    apart = F.lit(0)
    for k in range(HASHES):
        apart = apart + F.bit_count(F.get("prints", F.lit(k)).bitwiseXOR(F.get("item_prints", F.lit(k))))
    return apart


def near_prints(windows: DataFrame, items: DataFrame, radius: int = RADIUS, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """(pairs met, those of them within ``reach``) of (n, prints) and (item, n, prints): n, prints,
    item, distance. The multi-index: with 24 blocks some block of a pair within the radius differs in
    radius // 24 bits at most, so all pairs within the radius meet; the sides share these flips."""
    flips = radius // (HASHES * 64 // _BLOCK)
    index = broadcast_if_small(checkpoint(_entries(items, (flips + 1) // 2, "item")))
    keyed = _entries(windows.select("n", "prints"), flips // 2, "n", "prints")
    of_items = broadcast_if_small(items.select("item", F.col("prints").alias("item_prints")))
    met = keyed.join(index, "key").join(of_items, "item")
    met = met.select("n", "prints", "item", _apart().alias("distance"))
    return met, met.where(F.col("distance") <= max(radius, reach)).distinct()


def kept_windows(docs: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, n, start) of every window that shares enough shingles with the items of its size
    (``known``: n, h) to be similar to one."""
    own = docs.select(row_key().alias("row"), _words(F.col("text")).alias("w"))
    own = own.select("row", F.size("w").alias("size"), _hashes("w").alias("all")).select("row", "size", F.posexplode_outer("all").alias("at", "h"))  # the other form tests the size first, and makes the hashes twice
    marked = own.join(broadcast_if_small(known), "h").groupBy("row", "n").agg(F.first("size").alias("size"), F.sort_array(F.collect_set("at")).alias("at"))
    length = _shingles(F.least("n", "size"))
    need = F.ceil((_shingles(F.col("n")) + length) * threshold / (1 + threshold) - 1e-9).cast("int")
    marked = marked.select("row", "n", "at", length.alias("length"), need.alias("need"), (_shingles(F.col("size")) - length).alias("last")).where(F.size("at") >= F.col("need"))

    def starts(x: F.Column, i: F.Column) -> F.Column:
        """Windows whose first mark is x: after the mark before, and early or late enough to hold ``need`` marks."""
        end = F.get("at", i + F.col("need") - 1)
        low = F.greatest(F.lit(0), end - F.col("length") + 1, F.coalesce(F.get("at", i - 1), F.lit(-1)) + 1)
        high = F.least(x, F.col("last"))
        return F.when((end - x < F.col("length")) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    firsts = F.slice("at", F.lit(1), F.size("at") - F.col("need") + 1)
    return marked.select("row", "n", F.explode(F.flatten(F.transform(firsts, starts))).alias("start"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, reach: int = REACH, exact: bool = False) -> DataFrame:
    """Best window of each document and item: row (key of the document's row), doc_id, item_id,
    start_word, n_words (of the window), distance (of 384 bits), similarity.

    Null, empty and wordless texts match nothing; an item of fewer than five words matches only
    documents of just these words. A document shorter than an item is compared as a whole.
    Repeated rows give one row; ties of windows go to the first. Items with equal words all
    match. Empty tables give no rows; further columns are ignored. Texts and windows may have any
    length; around a passage of s shingles some s / 4 windows of s shingles are compared, so the
    work for a passage grows with the square of the item's length (documents: in proportion).
    Windows with a similarity of 0.8 differ in 58 bits (deviation 7): 3 % of those at just 0.8 lie
    beyond the radius of 71, of which the index finds all but one in 10,000. Pairs that met are verified
    up to ``reach`` differing bits (384: all that met). ``exact``: fingerprints thin nothing; every pair of
    window and item with a common shingle is verified, which loses none and takes longer."""
    # documents come and go under names of their own, whatever columns the tables have
    named = benchmark.select("item_id", _words(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    named = checkpoint(named.select("item_id", F.xxhash64("w", F.lit(1)).alias("item"), F.size("w").alias("n"), _hashes("w").alias("of")).coalesce(16))  # few rows against the corpus
    contents = named.groupBy("item", "n").agg(F.first("of").alias("of"))
    parts = checkpoint(contents.select("item", "n", F.explode("of").alias("h")).groupBy("item", "n", "h").agg(F.count("*").alias("c")))
    items = checkpoint(_fingerprints(parts, "item", "n"))
    places = kept_windows(docs, parts.select("n", "h").distinct(), threshold)
    # as many places of a row as its text has words
    places = checkpoint(places.groupBy("row").agg(F.collect_list(F.struct("n", "start")).alias("places")))
    # texts with windows are read again
    again = docs.select(row_key().alias("row"), "doc_id", "text").join(broadcast_if_small(places, 100_000), "row").dropDuplicates(["row"])
    again = again.select("row", "doc_id", "places", _words(F.col("text")).alias("w"))
    again = again.select("row", "doc_id", F.size("w").alias("size"), "places", _hashes("w").alias("all"))
    windows = again.select("row", "doc_id", "size", "all", F.explode("places").alias("p"))
    own = F.slice("all", F.col("p.start") + 1, _shingles(F.least("p.n", "size")))
    cells = windows.select("row", "doc_id", "p.n", "p.start", F.least("p.n", "size").alias("n_words"), F.explode_outer(own).alias("h"))
    cells = checkpoint(cells.groupBy("row", "doc_id", "n", "start", "n_words", "h").agg(F.count("*").alias("c")))
    printed = checkpoint(_fingerprints(cells, "row", "doc_id", "n", "start", "n_words"))
    if exact:
        met = cells.join(broadcast_if_small(parts.select("item", "n", "h")), ["n", "h"]).select("row", "n", "start", "item").distinct()
        met = met.join(printed, ["row", "n", "start"]).join(broadcast_if_small(items.select("item", F.col("prints").alias("item_prints"))), "item")
        near = met.select("row", "n", "start", "item", _apart().alias("distance"), "total")
    else:
        _, near = near_prints(printed.select("n", "prints").distinct(), items, radius, reach)
        near = printed.join(broadcast_if_small(checkpoint(near), 200_000), ["n", "prints"]).select("row", "n", "start", "item", "distance", "total")
    # exact: shared counts of each pair
    shared = cells.join(near, ["row", "n", "start"]).join(broadcast_if_small(parts.select("item", "h", F.col("c").alias("item_c"))), ["item", "h"])
    shared = shared.groupBy("row", "doc_id", "n", "start", "n_words", "item", "distance", "total").agg(F.sum(F.least("c", "item_c")).alias("both"))
    shared = shared.join(broadcast_if_small(items.select("item", F.col("total").alias("item_total"))), "item")
    similarity = F.col("both") / (F.col("total") + F.col("item_total") - F.col("both"))
    tested = shared.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    best = tested.groupBy("row", "doc_id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "distance")).alias("b"))
    best = best.join(broadcast_if_small(named.select("item", "item_id")), "item")
    return best.select("row", "doc_id", "item_id", (-F.col("b.back")).alias("start_word"), "b.n_words", "b.distance", "b.similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, reach: int = REACH) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns; see ``matches``."""
    row = free_name(docs, "__row")
    bad = checkpoint(matches(docs, benchmark, threshold, radius, reach).select(F.col("row").alias(row)).distinct())
    return docs.withColumn(row, row_key()).join(broadcast_if_small(bad), row, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "distance", F.round("similarity", 6).alias("similarity"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
