"""Session settings that the jobs in this package rely on."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

SHUFFLE_PARTITION_BYTES = 200 * 1024 * 1024
"""Aimed size of one shuffle partition: small enough to sort in executor memory."""


def shuffle_partitions_for(input_bytes: int, shuffled_share: float = 0.1) -> int:
    """Number of shuffle partitions for a job that reads ``input_bytes``.

    The session-level plans shuffle a pruned, pre-aggregated part of the input; ``shuffled_share``
    is that part. Preparing master events shuffles nearly all of it. Adaptive execution merges the
    partitions that turn out to be small.
    """
    return max(8, math.ceil(input_bytes * shuffled_share / SHUFFLE_PARTITION_BYTES))


def input_size(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files below the paths, asked of their file system; no data is read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = 0
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        found += at.getFileSystem(conf).getContentSummary(at).getLength()
    return found


def size_shuffles(spark: SparkSession, input_bytes: int, shuffled_share: float) -> None:
    """Set the shuffle partitions for an input, unless the user has set them."""
    key = "spark.sql.shuffle.partitions"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(shuffle_partitions_for(input_bytes, shuffled_share)))


def builder(app_name: str = "tillpath", input_bytes: int | None = None) -> SparkSession.Builder:
    """A session builder with UTC dates, ANSI casts and adaptive execution."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        # Recording the Python line of every column costs more than building the plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if input_bytes is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions_for(input_bytes))
    out = SparkSession.builder.appName(app_name)
    for key, value in conf.items():
        out = out.config(key, value)
    return out
