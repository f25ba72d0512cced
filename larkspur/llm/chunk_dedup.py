"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes (its value depends on the last 32 only) and cuts where its top
bits are zero, between a least and a largest chunk length, always before a character's first
byte. An insertion therefore changes the chunks around it only. Chunks are compared by a 64-bit
digest. A chunk that also occurs in a document of a smaller doc_id repeats; its source is the
smallest such document. Repeats that follow each other there as here form a seed.

The passage around a seed is longer than its whole chunks: the chunks at its ends differ, since
they also hold other text, and at its begin it takes some chunks until the cuts agree. So the
bytes on both sides of a seed are compared with those of its source, up to ``CONTEXT`` bytes, and
the seed grows as far as they are equal. Only then its length is tested: a span has at least
``min_bytes`` that stand in one other document. Spans that touch are one. The first document
keeps its text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, free_name, join_counted, small_batches, stored, table

LEAST, LARGEST, BITS = 16, 128, 4
MIN_BYTES = 140
#: Shortest seed, and how far it may grow on each side: two of the largest chunks.
SEED_BYTES, CONTEXT = 32, 256
_GEAR = np.random.default_rng(1916).integers(0, 2**32, 256, dtype=np.uint32)
_SLICE = 1 << 20


def _cuts(raw: bytes, bits: int = BITS) -> np.ndarray:
    """Places where the gear hash allows a cut (before the byte), in order."""
    out = []
    for at in range(0, len(raw), _SLICE):
        begin = max(0, at - 31)
        data = np.frombuffer(raw, np.uint8, min(len(raw), at + _SLICE) - begin, begin)
        rolled = _GEAR[data]
        for k in (1, 2, 4, 8, 16):  # the sum over twice as many bytes each time
            if k < len(rolled):
                more = rolled.copy()
                more[k:] += rolled[:-k] << np.uint32(k)
                rolled = more
        out.append(np.flatnonzero((rolled[at - begin :] >> np.uint32(32 - bits)) == 0) + at + 1)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def chunk_ends(raw: bytes, least: int = LEAST, largest: int = LARGEST) -> list[int]:
    n, ends, last = len(raw), [], 0
    for cut in [*_cuts(raw).tolist(), n]:
        while cut - last > largest:
            last = _whole(raw, last + largest)
            ends.append(last)
        if cut - last >= least or cut == n:
            cut = _whole(raw, cut)
            if cut > last:
                ends.append(cut)
                last = cut
    return ends


def _whole(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from xxhash import xxh3_64_intdigest as digest

    for batch in batches:
        ids, rows, starts, ends, digests = [], [], [], [], []

        def flush():
            frame = pd.DataFrame({"row": np.repeat(np.array([r for r, _, _ in ids], np.int64), [k for _, _, k in ids]), "start": np.array(starts, np.int32), "end": np.array(ends, np.int32), "digest": np.array(digests, np.uint64).view(np.int64)})  # noqa: B023
            frame.insert(0, "doc_id", pd.array([d for _, d, k in ids for _ in range(k)], dtype="Int64"))  # noqa: B023
            return frame

        for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            own = chunk_ends(raw)
            if not own:
                continue
            begins = [0, *own[:-1]]
            starts += begins
            ends += own
            digests += [digest(raw[a:b]) for a, b in zip(begins, own, strict=True)]
            ids.append((row, None if pd.isna(doc_id) else int(doc_id), len(own)))
            if len(starts) >= 200_000:
                yield flush()
                ids, starts, ends, digests = [], [], [], []
        if ids:
            yield flush()


def _seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, row, start, end, source, source_row, source_start): runs of chunks that stand in the
    same order, without a gap, in one document of a smaller doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    chunks = stored(texts.mapInPandas(_chunked, "doc_id long, row long, start int, end int, digest long"))
    seen = chunks.groupBy("digest").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.count("doc_id").alias("named"))
    several = stored(seen.where("source is not null and (source < last or named < n)").select("digest", "source", "n"))
    every = stored(join_counted(chunks, several, "digest", "n").select("doc_id", "row", "start", "end", "digest", "source", "n"))
    here = F.col("doc_id").eqNullSafe(F.col("source"))
    first = every.where(here).groupBy("digest").agg(F.min("row").alias("source_row"))
    origin = every.where(here).join(first.withColumnRenamed("source_row", "row"), ["digest", "row"]).groupBy("digest", "row").agg(F.min("start").alias("source_start"))
    copies = every.where(~here)
    counted = copies.groupBy("digest").agg(F.count("*").alias("n"))
    origin = checkpoint(origin.withColumnRenamed("row", "source_row").join(counted, "digest"))
    hits = join_counted(copies.drop("n"), origin, "digest", "n").select("doc_id", "row", "start", "end", "source", "source_row", "source_start").distinct()
    order = Window.partitionBy("doc_id", "row").orderBy("start")
    follows = (F.col("start") == F.lag("end").over(order)) & (F.col("source_row") == F.lag("source_row").over(order))
    here_as_there = F.col("start") - F.col("source_start") == F.lag(F.col("start") - F.col("source_start")).over(order)
    # chunks of a text with a short period have the same places in the source: they are seeds if all together are long enough
    runs = hits.withColumn("first", F.when(follows, 0).otherwise(1)).withColumn("fresh", F.when(follows & here_as_there, 0).otherwise(1))
    runs = runs.withColumn("stretch", F.sum("first").over(order)).withColumn("run", F.sum("fresh").over(order))
    together = Window.partitionBy("doc_id", "row", "stretch")
    runs = runs.withColumn("width", F.max("end").over(together) - F.min("start").over(together)).where(F.col("width") >= SEED_BYTES)
    found = runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("source").alias("source"), F.min("source_row").alias("source_row"), F.min("source_start").alias("source_start"))
    return found.drop("run")


def _around(docs: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """(row, start, end) distinct -> the bytes before start and behind end, as ``name``_before and
    ``name``_behind. Texts stay where they are if there are few places; each is read once."""
    of_row = places.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("places"))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.encode("text", "UTF-8").alias("raw"))
    found = texts.join(broadcast_if_small(checkpoint(of_row), 100_000), "row").dropDuplicates(["row"])
    low = lambda p: F.greatest(p["start"] - CONTEXT, F.lit(0))
    cut = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.substring("raw", low(p) + 1, p["start"] - low(p)).alias(f"{name}_before"), F.substring("raw", p["end"] + 1, F.lit(CONTEXT)).alias(f"{name}_behind")))
    return found.select("row", F.inline(cut))


def _grow(before: pd.Series, source_before: pd.Series, behind: pd.Series, source_behind: pd.Series) -> pd.DataFrame:
    """How many bytes at the ends of ``before`` and the begins of ``behind`` are equal, in whole characters."""
    rows = []
    for a, b, c, d in zip(before, source_before, behind, source_behind, strict=True):
        n, m = min(len(a), len(b)), min(len(c), len(d))
        left = np.frombuffer(a, np.uint8)[len(a) - n :][::-1] != np.frombuffer(b, np.uint8)[len(b) - n :][::-1]
        right = np.frombuffer(c, np.uint8)[:m] != np.frombuffer(d, np.uint8)[:m]
        back = int(left.argmax()) if left.any() else n
        on = int(right.argmax()) if right.any() else m
        while back and a[len(a) - back] & 0xC0 == 0x80:
            back -= 1
        while on and on < len(c) and c[on] & 0xC0 == 0x80:
            on -= 1
        rows.append((back, on))
    return pd.DataFrame(rows, columns=["back", "on"], dtype=np.int32)


def spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Repeated spans of ``docs`` (doc_id, text): doc_id, row (key of the row), start_byte, end_byte (UTF-8),
    source_doc_id (the smallest doc_id that holds a stretch of ``min_bytes`` of it).

    Null and empty texts have no chunks. Repeats inside one document stay; rows of one doc_id
    count as one document, repeated rows as one row. Rows with a null doc_id are never a source.
    Texts of any length are chunked as a whole, in slices. A repeat without a seed of 32 bytes in
    whole equal chunks is not seen: from 200 bytes on that is rare. An empty table gives no rows; further columns are ignored."""
    small_batches(docs.sparkSession)
    seeds = stored(_seeds(docs))
    width = F.col("end") - F.col("start")
    seeds = seeds.withColumn("source_end", F.col("source_start") + width)
    own = _around(docs, seeds.select("row", "start", "end").distinct(), "own")
    of_source = _around(docs, seeds.select(F.col("source_row").alias("row"), F.col("source_start").alias("start"), F.col("source_end").alias("end")).distinct(), "source")
    of_source = of_source.select(F.col("row").alias("source_row"), F.col("start").alias("source_start"), F.col("end").alias("source_end"), "source_before", "source_behind")
    both = seeds.join(own, ["row", "start", "end"]).join(of_source, ["source_row", "source_start", "source_end"])
    grow = F.pandas_udf(_grow, "struct<back:int,on:int>")
    grown = both.select("doc_id", "row", "start", "end", "source", grow("own_before", "source_before", "own_behind", "source_behind").alias("g"))
    long = grown.select("doc_id", "row", (F.col("start") - F.col("g.back")).alias("start"), (F.col("end") + F.col("g.on")).alias("end"), "source").where(F.col("end") - F.col("start") >= min_bytes).distinct()
    order = Window.partitionBy("doc_id", "row").orderBy("start", F.desc("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = long.withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start_byte"), F.max("end").alias("end_byte"), F.min("source").alias("source_doc_id"))
    return found.drop("run")


def deduplicate(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with the repeated spans cut out of the texts; all rows and columns. See ``spans``."""
    row, cut = free_name(docs, "__row"), free_name(docs, "__cut")
    found = spans(docs, min_bytes).groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_set(F.struct("start_byte", "end_byte"))).alias(cut))
    raw = F.encode("text", "UTF-8")
    last = F.element_at(cut, -1)["end_byte"]
    # what lies before each span, then what follows the last
    before = F.transform(cut, lambda s, i: F.decode(F.substring(raw, F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["end_byte"]) + 1, s["start_byte"] - F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["end_byte"])), "UTF-8"))
    after = F.decode(F.substring(raw, last + 1, F.octet_length("text") - last), "UTF-8")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.concat(F.array_join(before, ""), after))
    joined = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(found, row, "left")
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents")).select("doc_id", "start_byte", "end_byte", "source_doc_id")


QUERIES = {"op5_chunk_dedup": op5_chunk_dedup}
ORACLES: dict[str, str] = {}
