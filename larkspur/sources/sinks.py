"""Where results go: tables with key replacement (by versions, or by buckets of which only the
changed ones are rewritten), appended tables, and HTTP posts behind a callable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.merch import upsert


def latest(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The newest version of a table and its number (none: -1). Partition discovery finds it, so
    any store that Spark reads will do."""
    try:
        table = spark.read.parquet(path)
        version = table.agg(F.max("version")).first()[0]
    except AnalysisException:
        return None, -1
    return (None, -1) if version is None else (table.where(F.col("version") == version).drop("version"), version)


def upsert_table(new: DataFrame, path: str, keys: list[str]) -> int:
    """Write the table's next version: rows of ``new`` replace those of their key. Readers of the
    old version are not disturbed, and a failed write leaves it as it was."""
    old, version = latest(new.sparkSession, path)
    rows = new if old is None else upsert(old, new.select(*old.columns), keys)
    rows.write.mode("overwrite").parquet(f"{path}/version={version + 1}")
    return version + 1


#: Buckets of a table; each should be a file or a few. Fixed by the first write: it names the folders.
BUCKETS = 64
_BATCH = "last_batch"


def read_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a bucketed table (none yet: None)."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return None
    return table.drop(_BATCH, *(c for c in table.columns if c.startswith("bucket_of_")))


def upsert_buckets(new: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, batch_id: int | None = None, buckets: int = BUCKETS) -> list[int]:
    """Bring ``new`` into a table of hash buckets and give the buckets that were rewritten: those with
    keys of ``new``, no others, are read and written. ``merge`` (old, new) makes a bucket's rows of what
    it holds and what comes; by default new rows replace those of their key. It may not leave a bucket
    without rows, as those that have none are not overwritten: mark rows that go.

    With ``batch_id`` (growing, as a stream gives it) every bucket knows the last batch it took in. One
    that is replayed, after a failure that left some buckets written, goes only into the others: so merges
    that add up count once. One writer at a time; ``new`` is read twice."""
    spark, bucket = new.sparkSession, f"bucket_of_{buckets}"
    rows = new.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # at most as many as buckets
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        table = None
    if table is not None and bucket not in table.columns:
        raise ValueError(f"{path} is not a table of {buckets} buckets")
    if table is not None:
        table = table.where(F.col(bucket).isin(list(touched)))
        if batch_id is not None:
            touched -= {r[0] for r in table.groupBy(bucket).agg(F.max(_BATCH).alias("b")).where(F.col("b") >= batch_id).collect()}
            table = table.where(F.col(bucket).isin(list(touched)))
    if not touched:
        return []
    own = rows.where(F.col(bucket).isin(list(touched))).drop(bucket)
    last = F.lit(batch_id).cast("long")
    if table is None:
        done = own if merge is None else merge(own.limit(0), own)
    else:
        old = table.drop(bucket, _BATCH)
        done = (merge or (lambda a, b: upsert(a, b, keys)))(old, own.select(*old.columns))
        if batch_id is None:
            last = F.lit(table.agg(F.max(_BATCH)).first()[0]).cast("long")
    out = done.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn(_BATCH, last)
    out.repartition(bucket).write.partitionBy(bucket).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return sorted(touched)


def append(rows: DataFrame, path: str, *partition_by: str) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def webhook(post: Callable[[list[str]], None], batch: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands JSON texts to ``post`` on the executors, ``batch`` at a
    time. ``post`` owns its timeouts and must be safe to repeat: a task may be retried."""

    def send(rows) -> None:
        held: list[str] = []
        for row in rows:
            held.append(row.body)
            if len(held) >= batch:
                post(held)
                held = []
        if held:
            post(held)

    def each(df: DataFrame, _: int = 0) -> None:
        df.select(F.to_json(F.struct("*")).alias("body")).foreachPartition(send)

    return each
