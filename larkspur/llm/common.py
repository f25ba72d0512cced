"""What the training-data operators share: checkpoints in the shared folder, joins on
skewed keys, and connected components. Nothing here collects rows to the driver."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on; so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1.0 / 1000


#: Texts that go to a Python worker at once: long ones must not add up.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local one is set only where the
    session names none and all of Spark is one process (tests); on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local($|\[)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder; Spark's cleaner removes it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of the tables that ``stored`` has written in this process.
_STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, but a Parquet table: for large tables that are read several times. It stays
    until ``remove_stored``, or the end of the session."""
    if not _STORED:
        atexit.register(_at_exit, df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def stored_tables() -> list[str]:
    """Folders of the tables of ``stored`` that there are."""
    return list(_STORED)


def remove_stored(spark: SparkSession, tables: list[str] | None = None) -> None:
    """Delete tables of ``stored`` (all, or those given): once the results that read them are written."""
    for path in stored_tables() if tables is None else tables:
        if path in _STORED:
            _STORED.remove(path)
            remove(spark, path)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        remove_stored(spark)


def free_name(df: DataFrame, base: str = "__own") -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def held_out() -> F.Column:
    """True for the fifth of the documents whose labels are never learnt from (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row a key; ``count``: how many rows of left have the
    key) where a few keys may hold most rows of left. Keys from HOT_SHARE of the rows on are at
    most 1/HOT_SHARE many whatever the data, so only those are broadcast; all others are
    shuffled, and none of them can fill a task. how: inner or left. Give tables that are cheap
    to read again: both are read twice."""
    total = right.agg(F.sum(count).alias("__total"))
    marked = right.crossJoin(F.broadcast(total))
    hot = marked.where(F.col(count) >= F.greatest(F.lit(2.0), F.col("__total") * HOT_SHARE)).drop("__total")
    cold = marked.where(F.col(count) < F.greatest(F.lit(2.0), F.col("__total") * HOT_SHARE)).drop("__total")
    hot_rows = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return hot_rows.unionByName(rest.join(cold, key, how))


#: Tables of at most so many narrow rows (a few longs each: some 50 MB) are broadcast; their
#: rows are counted first, and beyond the bound the join is shuffled.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow and cheap to read again, such as a checkpoint), marked for broadcast only
    if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def row_key() -> F.Column:
    """A key of a document's row: repeated rows share it, and so share their decisions."""
    return F.xxhash64("doc_id", "text")


def wide_row_key() -> F.Column:
    """As ``row_key``, of 128 bits as hex digits: where a key decides which document stays."""
    return F.concat(F.hex(F.xxhash64("doc_id", "text")), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), "text", "doc_id")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, root): every node of an edge with the smallest node that it
    reaches. Alternates large-star and small-star steps (Kiveris et al., 2014): the rounds
    grow with the logarithm of a component's length. Each round is checkpointed."""
    pairs = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    pairs = checkpoint(pairs)
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
