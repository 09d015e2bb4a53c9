"""URL rules by host suffix and path prefix, looked up through short hashes.

Each distinct (host, path) is expanded into the expressions that a rule could be: the host's
suffixes of as many labels as some rule has, each with the path's prefixes as long as some rule's
path. An expression is joined to the rules by the first 32 bits of its SHA-256; a hit counts only
if the whole digests agree. Of the rules that fit, the longest decides, and of equal rules a block.

The expansion depends on the rules' shapes alone, so a long URL or a host with many labels makes no
more rows than a short one. The join back to the pages is by (host, path); the pages of one
URL, and those without a URL, pass through one task if the other side isn't small enough for Spark to broadcast.

A null URL, or one without ``://``, has an empty host and path, which no rule fits. Repeated rows are
judged like others, and an empty table gives no rows. Columns named like an output column are
replaced; all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
PREFIX_DIGITS = 8


def host_and_path(url: str) -> tuple[Column, Column]:
    """The lower-cased host and the path of a URL, both empty where there is no ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def digested(df: DataFrame, expression: str) -> DataFrame:
    digest = F.sha2(F.col(expression), 256)
    return df.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame = RULES,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``pages`` with host, path, the deciding rule (else null) and its verdict (else ``default``).

    ``rules`` holds (host, path, verdict); a rule fits its host and every subdomain, where the
    URL's path starts with the rule's path.
    """
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.select(
        F.concat("host", "path").alias("rule"), "host", "path", F.col("verdict").alias("ruled")
    )
    shape = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    rules = digested(rules.select("rule", "ruled"), "rule").withColumnRenamed("digest", "known")

    host, path = host_and_path(url)
    pages = pages.withColumn("host", host).withColumn("path", path)
    places = pages.select(F.col("host").alias("__host"), F.col("path").alias("__path")).distinct()
    suffixes = [
        F.when(F.size(F.split("__host", r"\.")) >= n, F.substring_index("__host", ".", -n))
        for n in shape["labels"]
    ]
    prefixes = [
        F.when(F.length("__path") >= n, F.substring("__path", 1, n)) for n in shape["lengths"]
    ]
    spoken = F.array(*(F.concat(s, p) for s in suffixes for p in prefixes))
    expressions = places.select("__host", "__path", F.explode(F.array_compact(spoken)).alias("said"))
    hits = digested(expressions, "said").join(rules, "prefix").where("digest = known")
    weight = F.struct(F.length("rule"), (F.col("ruled") == "block"), "rule")
    best = hits.groupBy("__host", "__path").agg(
        F.max_by(F.struct("rule", "ruled"), weight).alias("__best")
    )
    same = (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path"))
    return (
        pages.join(best, same, "left")
        .withColumn("rule", F.col("__best.rule"))
        .withColumn("verdict", F.coalesce(F.col("__best.ruled"), F.lit(default)))
        .drop("__host", "__path", "__best")
    )
