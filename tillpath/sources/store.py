"""Parquet tables, the store that all analyses are meant to read."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tillpath import schema as S
from tillpath.functions import month_label

MONTH_FOLDER, BATCH_FOLDER = S.MONTH_FOLDER, S.BATCH_FOLDER

OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one in ``spark.checkpoint.dir``.

    Where that is unset, a session on a single machine gets a temporary folder of its own, the same one
    each time. On a cluster this raises, as executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tillpath-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/tillpath-{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; unused columns and filtered row groups are not read."""
    return spark.read.parquet(path)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    mode: str = "errorifexists",
    only_given: bool = False,
) -> None:
    """Write ``df`` as Parquet. With ``only_given`` an overwrite leaves partitions alone that ``df`` has no rows of."""
    writer = df.write.mode(mode)
    if only_given:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


@contextlib.contextmanager
def open_folders(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, a task that writes at most ``most`` folders of a partitioned table holds a file of each open.

    Else Spark sorts all rows of a task by folder before it writes the first, in memory that grows with the
    task's input. Each open file has a buffer of its own, so this is for few folders.
    """
    before = spark.conf.get(OPEN_FILES, None)
    # A task that reaches the number goes back to sorting, hence one more.
    spark.conf.set(OPEN_FILES, str(max(most + 1, int(before or 0))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(OPEN_FILES)
        else:
            spark.conf.set(OPEN_FILES, before)


def write_master(
    master: DataFrame,
    path: str,
    rebalance: bool = True,
    mode: str = "errorifexists",
    only_given: bool = False,
) -> None:
    """Write master events with one folder per month, named by ``MONTH_FOLDER``.

    A filter on it skips whole folders; it is no column of the table's own. ``rebalance`` adds a
    shuffle that gives few, evenly sized files per month and splits an oversized month. Without it
    every task writes a file for each month it holds: after a join by session that is tasks times
    months, so leave it out only for rows that come in date order. ``only_given`` replaces the months
    of ``master`` and leaves all others.
    """
    dated = master.withColumn(MONTH_FOLDER, month_label("event_date"))
    if rebalance:
        dated = dated.hint("rebalance", MONTH_FOLDER)
    write_table(dated, path, [MONTH_FOLDER], mode, only_given)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet in ``buckets`` files by the hash of ``key``, each in its order.

    Two tables with the same key and number of buckets are joined on the key without a shuffle, see `read_bucketed`.
    One key's rows are in one file, so ``df`` should be summed per key or so before.
    """
    spark, name = df.sparkSession, _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = df.repartition(buckets, key)
    writer = dealt.write.format("parquet").mode(mode).bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(name)


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that `write_bucketed` wrote, in this session or an earlier one.

    How a folder is bucketed is known to a session's catalog alone, so the folder is named there; its files stay as they are.
    """
    name, columns = _table_name(path), read_table(spark, path).schema
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    ddl = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in columns)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`)"
        f" INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


def _table_name(path: str) -> str:
    return f"tillpath_{hashlib.sha256(path.encode()).hexdigest()[:32]}"


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table can be read at ``path``."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True
