"""One registered query per text operator, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tillpath.llm import minhash, oracle
from tillpath.llm.centroids import cluster, with_summary
from tillpath.llm.common import table
from tillpath.llm.decontamination import find
from tillpath.llm.html import extract_text
from tillpath.llm.language import identify, train
from tillpath.llm.licences import scan
from tillpath.llm.mixing import mix
from tillpath.llm.quality import judge
from tillpath.llm.secrets import judge_findings, weak_labels, with_features
from tillpath.llm.sharding import shard_documents
from tillpath.llm.simhash import near_duplicates
from tillpath.llm.spelling import variants, vocabulary
from tillpath.llm.urls import judge_urls


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards, under the law of near-equal bytes."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return shard_documents(docs, shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and the component that it belongs to."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in a mixture of the sources."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mix(docs).select(
        "doc_id", "source", "lane", "block", "slot", "release", "deadline", "position"
    )


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's visible text."""
    return extract_text(table(spark, folder, "pages").select("page_id", "html"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language from its text, its declared language and its source."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    languages, model = train(docs, "text", "lang", "doc_id")
    found = identify(docs, languages, model, declared="lang", host="source")
    return found.withColumn("kept", ~F.col("rejected")).drop("rejected")


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL against the rules."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's licence notices."""
    return scan(table(spark, folder, "documents").select("doc_id", "text")).drop("spans")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item that some document holds."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return find(docs, table(spark, folder, "benchmark"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality signals, votes and verdict."""
    return judge(table(spark, folder, "documents").select("doc_id", "text"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate for a secret in the documents, with the forest's verdict."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    found = with_features(docs, path="source")
    judged = judge_findings(found, weak_labels(found))
    return judged.select("doc_id", "position", "candidate", "before", "after", "covered", "p_secret", "is_secret")


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word of the documents with the frequent word that it is a variant of."""
    words = vocabulary(table(spark, folder, "documents").select("doc_id", "text"), slips=97)
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's class of near duplicates by the similarity of its shingles."""
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's cluster after three rounds."""
    return with_summary(*cluster(table(spark, folder, "embeddings").select("vec_id", "embedding")))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_html_text": op4_html_text,
    "op5_language": op5_language,
    "op6_url_rules": op6_url_rules,
    "op7_licences": op7_licences,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_spelling": op11_spelling,
    "op12_minhash": op12_minhash,
    "op13_centroids": op13_centroids,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": oracle.MIXING,
    "op6_url_rules": oracle.URL_RULES,
    "op11_spelling": oracle.SPELLING,
    "op12_minhash": oracle.MINHASH,
    "op13_centroids": oracle.CENTROIDS,
}
