"""SimHash near-duplicates through pivot distance tables.

A document's fingerprint is the unweighted 64-bit SimHash of its word shingles. Two
fingerprints are linked when they differ in at most ``radius`` bits; linked documents form
components.

How links are found. Take reference fingerprints (pivots). By the triangle inequality the
distances of two fingerprints to one pivot differ by at most their own distance, so a pair
whose pivot tables differ anywhere by more than the radius is no link. Two kinds of pivots
are used:

* families that resolve one block of bits each (the zero word and the unit words of the
  block): the differences of their distances spell out the block, so equal coordinates of a
  family are equal bits, and they need not be stored. A difference in one coordinate costs at
  least one bit of distance; with 7 families and a radius of 4, three families at least agree
  in full. A fingerprint is therefore dealt to the C(7,3) = 35 cells of its pivot space, and
  every link meets in some cell.
* 32 scattered pivots whose distances are tabled for the members of a cell: a pair with a
  larger maximum coordinate difference than the radius is discarded, survivors are verified
  bit by bit.

Only distinct fingerprints are dealt, so copies cost nothing. A cell yields a spanning
forest of its links, not all pairs. A cell of more than ``cell_limit`` members is streamed
instead of held: its members are marked, and marked fingerprints are linked through the words
within half the radius of them (two fingerprints within 4 bits share such a word, and two that
share one are within 4 bits), which is exact and linear in the members.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, connected_components, free_name, join_counted, row_key, small_batches, stored, table, wide_row_key

BLOCKS = 7
RADIUS = 4
CELL_LIMIT = 4096
#: Near copies by exact similarity: candidates within the radius (of 256 bits), links from the similarity on.
WIDE_RADIUS = 76
SIMILARITY = 0.8
#: Members of a cell of candidates that serve as pivots, at most.
WIDE_PIVOTS = 8
#: Cells of up to so many candidates need none.
FEW = 12
#: Groups of candidates with more shingles are compared in blocks of about so many.
SHINGLES_HELD = 2_000_000
_SLICE = 65_536
#: First bit and width of each pivot family's block: 9 bits each, the last 10.
_BLOCK_BITS = [(9 * i, 9 if i < BLOCKS - 1 else 10) for i in range(BLOCKS)]
#: Scattered pivots: 32 words of a seeded generator.
PIVOTS = np.random.default_rng(20240229).integers(0, 2**64, 32, dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a whole text, in order; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    digest = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(digest, shingles), dtype="<u8", count=n)


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of a whole text; null or no words: 0."""
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 4, text_col: str = "text", to: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        values = np.fromiter((simhash(t, shingle) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(values.view(np.int64))

    return docs.withColumn(to, fingerprint(F.col(text_col)))


def _cells(fp: F.Column) -> F.Column:
    """The cells of a fingerprint: one long for each three families."""
    block = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in _BLOCK_BITS]
    keys = []
    for k, (i, j, m) in enumerate(combinations(range(BLOCKS), 3)):
        keys.append(F.lit(k << 40).bitwiseOR(F.shiftleft(block[i], 20)).bitwiseOR(F.shiftleft(block[j], 10)).bitwiseOR(block[m]))
    return F.array(*keys)


def _near(words: np.ndarray, tables: np.ndarray, i: np.ndarray | int, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs pass the pivot tables and then the exact test."""
    passed = (np.abs(tables[i] - tables[j]).max(axis=-1) <= radius).nonzero()[0]
    left = words[i] if np.isscalar(i) else words[i[passed]]
    return passed[np.bitwise_count(left ^ words[j[passed]]) <= radius]


def _forest(words: np.ndarray, tables: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what all links of one cell connect."""
    left, links = np.arange(1, len(words)), []
    queue = [0]
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        hit = _near(words, tables, i, left, radius)
        if len(hit):
            found = left[hit]
            links += [(i, int(j)) for j in found]
            queue += found.tolist()
            left = np.delete(left, hit)
    return links


def _link_cells(radius: int, limit: int):
    small = 12

    def links_of(key: np.ndarray, fp: np.ndarray) -> list[pd.DataFrame]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        many = np.repeat(sizes > 1, sizes)
        key, words, sizes = key[many], fp[many].view(np.uint64), sizes[sizes > 1]
        if not len(key):
            return []
        out = []
        tables = np.bitwise_count(words[:, None] ^ PIVOTS[None, :]).astype(np.int8)
        of = np.repeat(sizes, sizes)
        at = np.flatnonzero(of <= small)
        for d in range(1, small):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            hit = _near(words, tables, at, at + d, radius)
            out.append((words[at[hit]], words[at[hit] + d]))
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        for begin, size in zip(begins[sizes > small], sizes[sizes > small], strict=True):
            part = words[begin : begin + size]
            pairs = np.array(_forest(part, tables[begin : begin + size], radius), dtype=np.int64).reshape(-1, 2)
            out.append((part[pairs[:, 0]], part[pairs[:, 1]]))
        return [pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "marked": False}) for a, b in out if len(a)]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        streamed = None
        for batch in batches:
            more_key, more_fp = batch["cell"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64)
            key, fp = np.concatenate([key, more_key]), np.concatenate([fp, more_fp])
            if streamed is not None:
                n = int((key == streamed).sum())  # sorted: they come first
                if n:
                    yield pd.DataFrame({"a": fp[:n], "b": fp[:n], "marked": True})
                    key, fp = key[n:], fp[n:]
                if len(key):
                    streamed = None
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            for begin, size in zip(starts[sizes > limit], sizes[sizes > limit], strict=True):
                part = fp[begin : begin + size]
                yield pd.DataFrame({"a": part, "b": part, "marked": True})
            if sizes[-1] > limit:
                streamed = key[-1]
                keep = len(key)
            else:
                keep = starts[-1]
            done = np.repeat(sizes <= limit, sizes)
            done[keep:] = False
            yield from links_of(key[done], fp[done])
            key, fp = key[keep:], fp[keep:]
        if len(key):
            yield from links_of(key, fp)

    return link


def _marked_links(marked: DataFrame, radius: int) -> DataFrame:
    """Links between marked fingerprints through words close to them. Two fingerprints are within the
    radius iff some word is within half the radius (rounded down) of one and the rest of the other;
    so all fingerprints about a word are linked to the smallest that is within the lower half."""
    inner, outer = radius // 2, radius - radius // 2
    masks = [(sum(1 << b for b in bits), k <= inner) for k in range(outer + 1) for bits in combinations(range(64), k)]
    signed = F.array(*(F.struct(F.lit(m - 2**64 if m >= 2**63 else m).cast("long").alias("mask"), F.lit(i).alias("inner")) for m, i in masks))
    near = marked.select("a", F.explode(signed).alias("m")).select("a", F.col("m.mask").bitwiseXOR(F.col("a")).alias("mid"), "m.inner")
    low = near.groupBy("mid").agg(F.min(F.when(F.col("inner"), F.col("a"))).alias("b"), F.min("a").alias("least"), F.max("a").alias("top")).where("b is not null and least < top").select("mid", "b")
    return near.join(low, "mid").where("a <> b").select("a", "b").distinct()


def links(distinct_fps: DataFrame, radius: int = RADIUS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(fp) distinct -> (a, b) links that connect exactly what all links connect."""
    if radius > 4:
        raise ValueError("three of seven families agree only up to a radius of 4")
    cells = distinct_fps.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "fp")
    found = dealt.mapInPandas(_link_cells(radius, cell_limit), "a long, b long, marked boolean")
    found = checkpoint(found.distinct())
    plain, marked = found.where("not marked").select("a", "b"), found.where("marked").select("a")
    if marked.isEmpty():
        return plain
    return plain.unionByName(_marked_links(marked, radius))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 4, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): row (key of doc_id and text), doc_id,
    fingerprint (16 hex digits), component_id (the smallest doc_id that links reach, itself
    included), component (long; names the component also where ids are null).

    Null, empty and blank texts have fingerprint zero and are linked like others. Repeated rows
    come out as often as they came in. A null doc_id keeps its row and never names a component
    unless all ids of the component are null. An empty table gives no rows. Further columns of
    ``docs`` are ignored. Two fingerprints are linked at ``radius`` differing bits or fewer."""
    small_batches(docs.sparkSession)
    own = checkpoint(with_fingerprint(docs.select("doc_id", "text", row_key().alias("row")), shingle).select("row", "doc_id", "fp"))
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_same"))
    labels = connected_components(links(fps.select("fp"), radius, cell_limit))
    linked = fps.join(labels, fps.fp == labels.node).select("fp", "root", "low")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_low"))
    linked = linked.join(lows, "root").select("fp", "root", "component_low")
    named = fps.join(linked, "fp", "left")
    named = checkpoint(named.select("fp", "n_same", F.coalesce("component_low", "low").alias("component_id"), F.coalesce("root", "fp").alias("component")))
    out = join_counted(own, named, "fp", "n_same")
    return out.select("row", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")


def _wide(text: str | None, shingle: int, n_keys: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(fingerprint of 4 x 64 bits, the n_keys smallest distinct shingle hashes, digest of the
    set of shingles) of a whole text. All three are of the set, as the similarity is: repeated
    shingles count once. Without words: zeros, and 0 as the only key."""
    hashes = np.unique(shingle_hashes(text, shingle))
    if not len(hashes):
        return np.zeros(4, np.uint64), np.zeros(1, np.uint64), 0
    ones = np.zeros(256, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        base = hashes[at : at + _SLICE]
        mixed = np.stack([base, *(_mix(base, k) for k in (1, 2, 3))], axis=1)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    words = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")
    return words, hashes[:n_keys], xxhash.xxh3_64_intdigest(hashes.tobytes())


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of a hash: a seeded finaliser of shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _wide_links(words: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what all links of the members connect. Pivots are some of the members: their
    distances to all members are tabled, pairs whose tables differ by more than the radius are
    discarded (no link can), and all 256 bits decide on the others. Few members are compared at once."""
    if len(words) <= FEW:
        near = np.bitwise_count(words[:, None, :] ^ words[None, :, :]).sum(axis=2) <= radius
        return [(int(i), int(j)) for i, j in np.argwhere(np.triu(near, 1))]
    pivots = words[:: max(1, -(-len(words) // WIDE_PIVOTS))]
    tables = np.stack([np.bitwise_count(words ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)
    left, links, queue = np.arange(len(words)), [], []
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        near = left[np.abs(tables[left] - tables[i]).max(axis=1) <= radius]
        near = near[np.bitwise_count(words[near] ^ words[i]).sum(axis=1) <= radius]
        if len(near):
            links += [(i, int(j)) for j in near]
            queue += near.tolist()
            left = left[~np.isin(left, near)]
    return links


def _link_copies(radius: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _groups(batches, "cell"):
            ids = held["class"].to_numpy(np.int64)
            found = _wide_links(held[["w0", "w1", "w2", "w3"]].to_numpy(np.int64).view(np.uint64), radius)
            if found:
                pairs = np.array(found, dtype=np.int64)
                yield pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    return link


def _alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what all pairs of sets with a Jaccard similarity of ``similarity`` or more
    connect. Each test is exact: one member is marked, and the marks of all others are counted."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32).ravel()
    ends = np.cumsum(sizes)
    marks = np.zeros(int(flat.max()) + 1, bool)
    left, links, queue = np.arange(len(sets)), [], []
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        n = sizes[i]
        # sizes further apart cannot be so similar
        close = left[np.minimum(sizes[left], n) >= similarity * np.maximum(sizes[left], n) - 1e-9]
        if not len(close):
            continue
        own = flat[ends[i] - n : ends[i]]
        marks[own] = True
        lengths = sizes[close]
        begins = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(ends[close] - lengths - begins, lengths)
        common = np.add.reduceat(marks[flat[at]], begins, dtype=np.int64)
        marks[own] = False
        near = close[common >= similarity * (lengths + n - common) - 1e-9]
        if len(near):
            links += [(i, int(j)) for j in near]
            queue += near.tolist()
            left = left[~np.isin(left, near)]
    return links


def _link_alike(similarity: float):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _groups(batches, "root"):
            held = held.drop_duplicates("class")
            if len(held) < 2:
                continue
            ids = held["class"].to_numpy(np.int64)
            found = _alike([np.frombuffer(x, "<u8") for x in held["shingles"]], similarity)
            if found:
                pairs = np.array(found, dtype=np.int64)
                yield pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    return link


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each value of ``key`` that has several, from batches sorted by it."""
    parts: list[pd.DataFrame] = []

    def held() -> Iterator[pd.DataFrame]:
        if sum(map(len, parts)) > 1:
            yield pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]

    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy(np.int64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for begin, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            if parts and parts[0][key].iloc[0] != keys[begin]:
                yield from held()
                parts = []
            parts.append(batch.iloc[begin:end])
    yield from held()


def _in_blocks(members: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """``members`` (class, ``key``, ...) where the keys of ``blocks`` (key, n_blocks) are cut into
    blocks by the class, and each pair of blocks has a key of its own. So any two members of a key
    still meet, in tasks of two blocks at most, and a member is repeated once for each block."""
    cut = members.join(broadcast_if_small(blocks), key, "left")
    own = F.pmod(F.xxhash64("class", F.lit(1)), F.col("n_blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda other: F.xxhash64(key, F.least(own, other), F.greatest(own, other)))
    keys = F.when(F.col("n_blocks").isNull(), F.array(key)).otherwise(pairs)
    rest = [c for c in members.columns if c != key]
    return cut.select(*rest, F.explode(keys).alias(key)).repartition(key).sortWithinPartitions(key, "class")


def near_copies(docs: DataFrame, radius: int = WIDE_RADIUS, shingle: int = 5, n_keys: int = 6, cell_limit: int = CELL_LIMIT, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): row, doc_id, component (long).

    Two texts are linked when the Jaccard similarity of their sets of shingles is ``similarity`` or
    more. Such texts differ in some 10 of 64 bits: more than cells of equal bits can find. So
    candidates have a fingerprint of the set of 256 bits, where a similarity of 0.8 gives a
    distance of 39 (standard deviation 6; at most 48 for very short texts; unrelated texts 128),
    and the cells are the ``n_keys`` smallest shingle hashes of a text: two texts with a similarity
    of 0.8 have none in common with a probability of about 0.2^6. In a cell the pivot tables
    discard, and a Hamming distance of at most ``radius`` makes candidates. All members of a group
    that candidates connect are then compared with their whole sets of shingles, and only an exact
    similarity links. Texts with the same set of shingles are one member, whatever their number.
    Cells and groups of over ``cell_limit`` members (groups also of over SHINGLES_HELD shingles)
    are compared in blocks, each block with each, in tasks of their own: no pair is left out, and
    the rows grow with the square of the members over the limit.

    Texts without words are one component; whole texts of any length are hashed in a pass (8 bytes a
    word are held). Nulls, repeats and empty tables as in ``near_duplicates``."""

    @F.pandas_udf("struct<class:long,w0:long,w1:long,w2:long,w3:long,cells:array<long>>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words, cells, digest = _wide(text, shingle, n_keys)
            rows.append((np.uint64(digest).view(np.int64), *words.view(np.int64), cells.view(np.int64)))
        return pd.DataFrame(rows, columns=["class", "w0", "w1", "w2", "w3", "cells"])

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts])

    small_batches(docs.sparkSession)
    own = docs.select(wide_row_key().alias("row"), "doc_id", describe("text").alias("d")).select("row", "doc_id", "d.*")
    own = stored(own)
    classes = own.groupBy("class").agg(*(F.first(c).alias(c) for c in ("w0", "w1", "w2", "w3", "cells")))
    members = classes.select("class", "w0", "w1", "w2", "w3", F.explode("cells").alias("cell"))
    large = members.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_limit)
    large = checkpoint(large.select("cell", F.ceil(F.col("n") / cell_limit).alias("n_blocks")))
    candidates = _in_blocks(members, "cell", large).mapInPandas(_link_copies(radius), "a long, b long").distinct()
    # the whole sets of one text of each class in a group of candidates
    groups = connected_components(candidates)
    one = own.groupBy("class").agg(F.min("row").alias("__row"))
    one = checkpoint(groups.join(one, F.col("node") == F.col("class")).select("__row", "class", "root"))
    texts = docs.select(wide_row_key().alias("__row"), "text").join(broadcast_if_small(one), "__row")
    sets = stored(texts.select("class", "root", shingles("text").alias("shingles")))
    large = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("shingles") / 8).alias("size"))
    large = large.select("root", F.ceil(F.greatest(F.col("n") / cell_limit, F.col("size") / SHINGLES_HELD)).alias("n_blocks")).where("n_blocks > 1")
    found = _in_blocks(sets, "root", checkpoint(large)).mapInPandas(_link_alike(similarity), "a long, b long").distinct()
    labels = connected_components(found)
    sizes = own.groupBy("class").agg(F.count("*").alias("n_same"))
    named = checkpoint(labels.join(sizes, F.col("node") == F.col("class")).select("class", "root", "n_same"))
    joined = join_counted(own.select("row", "doc_id", "class"), named, "class", "n_same", "left")
    return joined.select("row", "doc_id", F.coalesce("root", "class").alias("component"))


def keep_first(docs: DataFrame, radius: int = WIDE_RADIUS, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of near copies of ``docs``, the one with the smallest doc_id (null
    last; then by key), with all its columns. Repeated rows count once."""
    found = checkpoint(near_copies(docs, radius, shingle, similarity=similarity))
    by_component = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"), F.count("*").alias("n"))
    first = checkpoint(by_component.select("component", F.col("first.row").alias("first"), "n").where("n > 1"))
    row = free_name(docs, "__row")
    gone = join_counted(found.select("component", "row"), first, "component", "n").where("row <> first").select(F.col("row").alias(row)).distinct()
    twice = checkpoint(found.groupBy(F.col("row").alias(row)).agg(F.count("*").alias("n")).where("n > 1").select(row))
    kept = docs.withColumn(row, wide_row_key()).join(broadcast_if_small(checkpoint(gone)), row, "left_anti")
    if not twice.isEmpty():
        again = broadcast_if_small(twice)
        kept = kept.join(again, row, "left_anti").unionByName(kept.join(again, row, "left_semi").dropDuplicates([row]))
    return kept.select(*(f"`{c}`" for c in docs.columns))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


QUERIES = {"op1_simhash_dedup": op1_simhash_dedup}
ORACLES: dict[str, str] = {}
