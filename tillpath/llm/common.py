"""Helpers that several text operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpath.sources import scratch_path, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
"""A word is a run of characters other than the six ASCII whitespace characters."""

CELL_ROWS = 512
"""Rows numbered in one window partition, about; a fixed target, so cells grow with the input."""

CELLS_SUMMED = 4096
"""Cells whose counts are added up in one window partition, at most."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the cluster's shared folder, so that a lost executor costs no rerun."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def with_place(docs: DataFrame) -> DataFrame | None:
    """``docs`` with ``__file`` and ``__row``, where each row stands in the files it is read from.

    None if ``docs`` isn't read from files. The two are the same whenever the files are read.
    """
    try:
        return docs.select(
            "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
        )
    except AnalysisException:
        return None


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder."""
    return scratch_path(spark, name)


MARKS = 1 << 23
"""Bits of a set of marks: 1 MB, in 131,072 rows, whatever is marked."""


def marked(df: DataFrame, keys: DataFrame) -> DataFrame:
    """``df`` with ``__marked``: false for rows whose ``row`` is surely not among those of ``keys``.

    A bitmap of the keys' hashes is broadcast, of a fixed size. Where many keys set most of its bits it tells little, and what
    follows takes more rows; results don't depend on it.
    """
    place = F.pmod("row", F.lit(MARKS))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(pmod(row, {MARKS}) & 63 AS int))")
    words = keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    joined = df.withColumn("__word", word).join(F.broadcast(words), "__word", "left")
    found = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return joined.withColumn("__marked", found).drop("__word", "__bits")


def bits_for(rows: int, cell_rows: int = CELL_ROWS) -> int:
    """Leading hash bits that cut ``rows`` rows into cells of about ``cell_rows``."""
    return max(0, (max(rows, 1) // cell_rows).bit_length())


def leading_bits(hashed: Column, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit hash as a number; it rises with the unsigned hash."""
    return F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("long")


def numbered(df: DataFrame, group: list[str], cell: str, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 0, without gaps, as column ``name``.

    ``cell`` must never fall along ``order``; it and the group's columns must not be null. Rows are numbered within (group, cell), and a cell
    starts after the rows of the earlier cells of its group, so no task needs a whole group. Only
    the cells' counts, one row for some hundred input rows, meet per group.
    """
    keys = [*group, cell]
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    counts = df.groupBy(*(F.col(k).alias(n) for k, n in names.items())).agg(
        F.count(F.lit(1)).alias("__rows")
    )
    starts = _starts(counts, [names[k] for k in group], names[cell])
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    ranked = df.withColumn("__within", within)
    on = F.lit(True)
    for k, n in names.items():
        on = on & (ranked[k] == starts[n])
    return (
        ranked.join(starts, on)
        .withColumn(name, (F.col("__start") + F.col("__within")).cast("long"))
        .drop("__within", "__start", *names.values())
    )


def _starts(counts: DataFrame, group: list[str], cell: str) -> DataFrame:
    """``__start`` for each cell: the rows in earlier cells of its group, summed in two levels."""
    blocks = counts.withColumn("__block", F.floor(F.col(cell) / CELLS_SUMMED).cast("long"))
    earlier = Window.partitionBy(*group, "__block").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__near", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    sums = blocks.groupBy(*group, "__block").agg(F.sum("__rows").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    far = F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__far")
    sums = sums.select(*(F.col(g).alias(f"{g}b") for g in [*group, "__block"]), far)
    on = F.lit(True)
    for g in [*group, "__block"]:
        on = on & (blocks[g] == sums[f"{g}b"])
    start = (F.col("__near") + F.col("__far")).alias("__start")
    return blocks.join(sums, on).select(*group, cell, start)
