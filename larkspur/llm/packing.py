"""Packing of documents into sequences of a fixed number of tokens: large-item matching, then best fit.

A document is its ids and one closing id; longer ones are cut into pieces of the capacity, so a
piece has one of as many sizes as the capacity. Large pieces, above a third of the capacity, stand
at most two to a sequence and are matched greedily, the largest first, each with the largest
that fits: what fits a larger piece fits a smaller one, so this matches as many as can be. Smaller
pieces go, the largest first, each into the fullest sequence that has room for it.

Pieces of one size are interchangeable, so the plan is made for the counts of the sizes: it is a
list of kinds of sequences, so many alike, and the driver sees one number a size whatever the corpus.
Each step splits one kind at most, so there are fewer kinds than twice the sizes and one for each
pair. The pieces themselves stay on the executors: they are numbered within their size, in parts
of about the square root of its count, and the number says which place of the plan a piece takes."""

from __future__ import annotations

import itertools
import math
import zlib
from bisect import insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import WordBpe, _byte_symbols, default_vocabulary
from .common import checkpoint, free_name, small_batches, table

CAPACITY = 2048
CLOSING_ID = 0
#: Bytes of one of the two tables of known pieces of text in a worker (memory only, not results).
KEEP_BYTES = 80 << 20
_SLOTS, _NEVER = 1 << 18, np.iinfo(np.int32).max


class MergingBpe(WordBpe):
    """The same ids; all unknown words are merged at once, in each the pair that comes first."""

    def __init__(self, path: str, keep_bytes: int = KEEP_BYTES):
        super().__init__(path, keep_bytes)
        symbols = _byte_symbols()
        self.first_ids = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last_ids = np.array([self.vocab[s + self.end] for s in symbols], np.int64)
        self.result = np.array([self.vocab[a + b] for a, b in self.rank], np.int64)
        self.slot_keys, self.slot_ranks = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, _NEVER, np.int32)
        for r, (a, b) in enumerate(self.rank):
            key = self.vocab[a] << 20 | self.vocab[b]
            slot = int(self._slots(np.array([key]))[0])
            while self.slot_keys[slot] >= 0:
                slot = (slot + 1) % _SLOTS
            self.slot_keys[slot], self.slot_ranks[slot] = key, r

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def _ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, by open addressing."""
        keys = first << 20 | second
        slots = self._slots(keys)
        found = self.slot_keys[slots]
        out = np.where(found == keys, self.slot_ranks[slots], _NEVER)
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            slots[on] = (slots[on] + 1) % _SLOTS
            found = self.slot_keys[slots[on]]
            same = found == keys[on]
            out[on[same]] = self.slot_ranks[slots[on[same]]]
            on = on[~same & (found >= 0)]
        return out

    def _decide(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        raw = np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)
        ends = raw == 10
        last = np.flatnonzero(ends) - 1
        ids = self.first_ids[raw]
        ids[last] = self.last_ids[raw[last]]
        ids, word = ids[~ends], np.cumsum(ends)[~ends]
        rank = np.full(len(ids), _NEVER, np.int32)  # of the pair that begins here
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best, count = np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)])
            ready = best == _NEVER
            if ready.any():
                out = np.repeat(ready, count)
                done.append((word[out], ids[out]))
                ids, word, rank, best, count = ids[~out], word[~out], rank[~out], best[~ready], count[~ready]
            at = np.flatnonzero(rank == np.repeat(best, count))
            if len(at) > 1 and (np.diff(at) == 1).any():  # a a a: from the left, without overlaps
                begins = np.r_[True, np.diff(at) != 1]
                at = at[(np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 0]
            ids[at] = self.result[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))
            for near in (at, at[at > 0] - 1):
                rank[near] = _NEVER
                inner = near[near + 1 < len(ids)]
                inner = inner[word[inner] == word[inner + 1]]
                rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        words_of, ids_of = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids_of[np.argsort(words_of, kind="stable")], np.bincount(words_of, minlength=len(words))

    def _resolved(self, held: list[tuple[int, list[str] | str]]) -> Iterator[tuple[int, bytes, str]]:
        """As in the class above, without the tokens' texts."""
        self._learn(set().union(*(s for _, s in held if not isinstance(s, str))))
        known = self.known
        lists = [s for _, s in held if not isinstance(s, str)]
        lengths = list(map(len, lists))
        codes = np.fromiter(map(known.at.__getitem__, itertools.chain.from_iterable(lists)), np.int64, sum(lengths))
        ids, sizes = known.take(codes)
        ends = iter(np.r_[0, np.cumsum(sizes)][np.cumsum(lengths, dtype=np.int64)].tolist())
        raw, a = ids.astype("<u4").tobytes(), 0
        for k, segment in held:
            if isinstance(segment, str):
                yield k, self.added[segment].to_bytes(4, "little"), segment
            elif (z := next(ends)) > a:
                yield k, raw[4 * a : 4 * z], ""
                a = z
        if known.bytes > self.keep_bytes:
            self.known, self.older = type(known)(), known if known.bytes < 2 * self.keep_bytes else type(known)()


_LOADED: dict[str, MergingBpe] = {}


def _tokenizer(path: str) -> MergingBpe:
    if path not in _LOADED:
        _LOADED[path] = MergingBpe(path)
    return _LOADED[path]


def _cut(bpe: WordBpe, texts: list[str | None], capacity: int, closing: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(number of the text, piece, start, ids) of texts in order; ids are held for one piece only."""
    width, at, held, piece = 4 * capacity, 0, b"", 0

    def ended() -> Iterator[tuple[int, int, int, bytes]]:
        own = held + closing
        for j, a in enumerate(range(0, len(own), width)):
            yield at, piece + j, (piece + j) * capacity, own[a : a + width]

    for k, raw, _ in bpe.encode(texts):
        while at < k:
            yield from ended()
            at, held, piece = at + 1, b"", 0
        held += raw
        full = len(held) // width
        for j in range(full):
            yield at, piece + j, (piece + j) * capacity, held[j * width : (j + 1) * width]
        held, piece = held[full * width :], piece + full
    while at < len(texts):
        yield from ended()
        at, held, piece = at + 1, b"", 0


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, closing_id: int = CLOSING_ID, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each row of ``docs``: the id, piece int (from 0), start long, length
    long, ids_crc32 long and, with ``keep_ids``, token_ids. A null or empty text is the closing id
    alone. Texts of any length are read in slices. Repeated rows and null ids each give their
    pieces; further columns are dropped; an empty table gives no rows."""
    path, closing = path or default_vocabulary(), closing_id.to_bytes(4, "little")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path)
        for batch in batches:
            found = _cut(bpe, batch.column(1).to_pylist(), capacity, closing)
            while own := [x for x, _ in zip(found, range(4096), strict=False)]:
                columns = [batch.column(0).take(pa.array([x[0] for x in own])), pa.array([x[1] for x in own], pa.int32()), pa.array([x[2] for x in own], pa.int64())]
                columns += [pa.array([len(x[3]) // 4 for x in own], pa.int64()), pa.array([zlib.crc32(x[3]) for x in own], pa.int64())]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(x[3], "<u4").astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "token_ids"][: len(columns)])

    out = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, f"row {kind}, piece int, start long, length long, ids_crc32 long" + ", token_ids array<int>" * keep_ids)
    return out.withColumnRenamed("row", id_col)


@dataclass
class Kind:
    """So many sequences that hold the same sizes: (size, how many) in the order of their places."""

    many: int
    gap: int
    holds: tuple[tuple[int, int], ...]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Kind]:
    """The kinds of sequences for so many pieces of each size."""
    left = {s: c for s, c in counts.items() if c}
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    made: list[Kind] = []
    for s in large:
        for t in (t for t in large if t <= s and s + t <= capacity):  # largest first
            if not left[s]:
                break
            pairs = left[s] // 2 if s == t else min(left[s], left[t])
            if pairs:
                left[s] -= pairs
                left[t] -= pairs
                made.append(Kind(pairs, capacity - s - t, ((s, 2),) if s == t else ((s, 1), (t, 1))))
        if left[s]:
            made.append(Kind(left[s], capacity - s, ((s, 1),)))
            left[s] = 0
    by_gap: dict[int, list[Kind]] = {}
    gaps: list[int] = []

    def put(kind: Kind) -> None:
        if kind.gap not in by_gap:
            by_gap[kind.gap] = []
            insort(gaps, kind.gap)
        by_gap[kind.gap].append(kind)

    for kind in made:
        put(kind)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        c = left[s]
        for gap in [g for g in gaps if g >= s]:
            if not c:
                break
            fits, kinds, by_gap[gap] = gap // s, by_gap[gap], []
            for kind in kinds:
                full = min(kind.many, c // fits)
                c -= full * fits
                rest, kind.many = kind.many - full, full
                if full:
                    put(Kind(full, gap - fits * s, (*kind.holds, (s, fits))))
                if rest and c:  # fewer than fill one
                    put(Kind(1, gap - c * s, (*kind.holds, (s, c))))
                    rest, c = rest - 1, 0
                if rest:
                    put(Kind(rest, gap, kind.holds))
        if c:
            fits = capacity // s
            if c >= fits:
                put(Kind(c // fits, capacity - fits * s, ((s, fits),)))
            if c % fits:
                put(Kind(1, capacity - c % fits * s, ((s, c % fits),)))
    return [kind for gap in gaps for kind in by_gap[gap]]


class Places:
    """Where the pieces of each size go: by a piece's number within its size."""

    def __init__(self, kinds: Iterable[Kind]):
        taken: dict[int, int] = {}
        rows, first = [], 0
        for kind in kinds:
            offset = 0
            for s, k in kind.holds:
                rows.append((s, taken.get(s, 0), k, first, offset))
                taken[s] = taken.get(s, 0) + kind.many * k
                offset += s * k
            first += kind.many
        self.sequences = first
        size, number, self.each, self.first, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.numbers = number
        own, bounds, count = np.unique(size, return_index=True, return_counts=True)
        self.spans = {s: (a, a + n) for s, a, n in zip(own.tolist(), bounds.tolist(), count.tolist(), strict=True)}

    def of(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        row = np.empty(len(size), np.int64)
        for s in np.unique(size).tolist():
            a, z = self.spans[s]
            own = size == s
            row[own] = a + np.searchsorted(self.numbers[a:z], number[own], side="right") - 1
        within = number - self.numbers[row]
        return self.first[row] + within // self.each[row], self.offset[row] + within % self.each[row] * size


def pack(parts: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Adds to each row of ``parts`` (with a length from 1 to the capacity): sequence_id long and
    offset long, its place there, gapless from 0.

    Rows of one length may be most of all rows; repeated rows each get a place. All columns are
    kept, but for columns of these names, which are replaced; an empty table gives no rows. The
    rows are checkpointed first: their numbers must not change when a task runs again."""
    kept = parts.drop(*(c for c in ("sequence_id", "offset") if c != length_col))
    row, share, part, before, at, to = (free_name(kept, f"__{c}") for c in ("row", "share", "part", "before", "at", "to"))
    rows = checkpoint(kept.withColumn(row, F.monotonically_increasing_id()))
    counts = dict(map(tuple, rows.groupBy(length_col).agg(F.count("*")).limit(capacity + 1).collect()))  # a row a size
    if any(s is None or not 0 < s <= capacity for s in counts):
        raise ValueError(f"lengths are to be from 1 to {capacity}")
    places = Places(plan(counts, capacity))
    shares = rows.sparkSession.createDataFrame([(s, max(1, math.isqrt(c))) for s, c in counts.items()], f"`{length_col}` long, `{share}` long")
    dealt = rows.join(F.broadcast(shares), length_col).withColumn(part, F.pmod(F.xxhash64(row), F.col(share)))
    earlier = Window.partitionBy(length_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy(length_col, part).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(length_col, part).orderBy(row)) - 1
    numbered = dealt.withColumn(at, within).join(firsts, [length_col, part])

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(size: pa.Array, number: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in places.of(size.to_numpy(), number.to_numpy())], ["sequence_id", "offset"])

    placed = numbered.withColumn(to, place(F.col(length_col).cast("long"), F.col(before) + F.col(at)))
    return placed.select(*(f"`{c}`" for c in kept.columns), F.col(to)["sequence_id"].alias("sequence_id"), F.col(to)["offset"].alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and token_ids of whole sequences, from placed pieces with their token_ids. A
    group holds at most the capacity of ids."""
    own = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "token_ids"))).alias("own"))
    return own.select("sequence_id", F.flatten(F.transform("own", lambda x: x["token_ids"])).alias("token_ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), keep_ids=False))


QUERIES = {"op13_packing": op13_packing}
ORACLES: dict[str, str] = {}
