"""From raw documents to shards of a mixed, clean corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``docs``.

1. ``language``: documents whose language can't be told are rejected.
2. ``near_duplicates``: of documents linked by SimHash, the one with the smallest id stays.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``mixing``: all documents stay; they are written in the order of the mixture, file by file and row by
   row, so that any stretch of the output has its sources in their target weights.
5. ``sharding``: every document gets one of eight shards, and a slot in it by its place in the mixture.

Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns are handled
as the operators' modules say. Repeated rows of a document count as near duplicates of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpath.llm.common import scratch, table, with_place
from tillpath.llm.decontamination import decontaminated
from tillpath.llm.language import identified
from tillpath.llm.mixing import mix
from tillpath.llm.sharding import shard_documents
from tillpath.llm.simhash import deduplicated

SHARDS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture.

    Places are worked out on ids and sources alone; texts move once to meet them and once to be sorted.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    read = with_place(docs)
    if read is None:
        whole = docs.select("doc_id", "source", F.struct(*columns).alias("__whole"))
        return mix(whole).orderBy("position").select("__whole.*")
    placed = mix(read.select("doc_id", "source", "__file", "__row"))
    placed = placed.select("__file", "__row", F.col("position").alias("__position"))
    return read.join(placed, ["__file", "__row"]).orderBy("__position").select(*columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their size, shard and slot, in the order in which they were written."""
    read = with_place(docs)
    if read is None:
        return shard_documents(docs, SHARDS)
    part = F.regexp_extract("__file", r"part-(\d{1,9})[^/]*$", 1)
    order = F.coalesce(F.try_to_number(part, F.lit("999999999")).cast("long"), F.lit(0)) * 2**32 + F.col("__row")
    return shard_documents(read, SHARDS, order=order).drop("__file", "__row")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SimHash and CGK can't be said in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
