"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

quality: the positive-unlabelled classifier scores every document; rejected ones go.
line_dedup: lines of recurring templates go from all documents but their first.
near_dedup: one document of each component of near copies (five words, 0.8) stays, the one with the smallest doc_id.
decontamination: documents that hold a benchmark passage go.
bpe: whole texts are encoded; ids and checks of the decoded text are returned.

All but the last return the columns of ``documents`` and keep every row that they don't reject.
Rows that are equal in all columns count once from near_dedup on. Nulls, empty and very long texts,
ties and further columns, whatever their names, are treated as the operators of the stages say: a null
or empty text is scored, linked and encoded like any other text without words.

A stage may be called by itself, on a table or on what another stage returns, and its result stays
readable: what it has stored goes only with ``run``, which removes it once the next table is written,
or with ``remove_stored``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.bpe import encode
from larkspur.llm.common import remove, remove_stored, shared_folder, stored_tables, table
from larkspur.llm.decontamination import decontaminate
from larkspur.llm.line_dedup import without_recurring_lines
from larkspur.llm.quality import keep_good
from larkspur.llm.simhash_dedup import keep_first


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = without_recurring_lines(docs)
    return cut.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs.select("doc_id", "text")).drop("text")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]
#: A classifier and fingerprints are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, own in STAGES:
        before = stored_tables()
        own(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        # what the stage was made from can go; only the last output stays
        remove_stored(spark, [t for t in stored_tables() if t not in before])
        if last:
            remove(spark, f"{folder}/{last}")
        last = name
    return docs
