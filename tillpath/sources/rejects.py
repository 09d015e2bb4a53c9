"""CSV tables with faulty rows: one parse that tells rows that fit from rows that don't.

`read_csv_table` fails at the first faulty row. Here every row is kept, with the reason why it doesn't fit or null, its text and its
file, so accepted and rejected rows together are the rows of the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath import schema as S
from tillpath.sources.csv_files import csv_reader, whole_number
from tillpath.sources.store import open_folders, write_table

REASON, TEXT, FILE, ACCEPTED = "__reason", "__text", "__file", "__accepted"
ADDED = (REASON, TEXT, FILE, ACCEPTED)

SHORT, LONG, QUOTES = "too few fields", "too many fields", "quotes don't match"
"""Reasons that concern a row as a whole; others name the column, as in ``session_id isn't bigint``."""


def _given(name: str) -> Column:
    column = F.col(f"`{name}`")
    return F.when(~column.isin(*S.NULL_TOKENS), column)


def _cast(name: str, data_type: T.DataType) -> Column:
    return whole_number(_given(name), data_type).try_cast(data_type)


def _of_fields(broken: Column, width: int) -> Column:
    """Why a row has not ``width`` fields, from its text: commas outside quotes tell."""
    commas = F.regexp_count(F.regexp_replace(broken, '"([^"]|"")*"', ""), F.lit(","))
    return F.when(commas < width - 1, SHORT).when(commas > width - 1, LONG).otherwise(QUOTES)


def read_csv_judged(
    spark: SparkSession,
    path: str,
    table: T.StructType,
    dates: Sequence[str] = (),
    multiline: bool = False,
    keep_others: bool = False,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """All rows of CSV files, as `read_csv_table` gives them, with ``__reason``, ``__text`` and ``__file``.

    ``__reason`` is null for rows that fit; a row with several faults has the first one's: the number of fields, then the columns in
    the table's order. A value that doesn't fit is null. Texts of ``dates`` must be days as ``yyyyMMdd``. ``names`` are the columns of
    files without a header line. Files whose header differs from the others', or that lack a column, fail the job
    as ever: every row of them would be faulty.
    """
    reader = csv_reader(spark, multiline).option("header", names is None)
    header = list(names or reader.csv(path).columns)
    if clashing := [c for c in header if c in ADDED]:
        raise ValueError(f"columns of {path} are named like added ones: {', '.join(clashing)}")
    fields = [T.StructField(c, T.StringType()) for c in [*header, "__broken"]]
    text = (
        reader.schema(T.StructType(fields))
        .option("enforceSchema", names is not None)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "__broken")
        .option("columnPruning", False)
        .csv(path)
    )
    known = {f.name for f in table.fields}
    present = [f for f in table.fields if f.name in header or f.name != "event_id"]
    others = [c for c in header if c not in known] if keep_others else []
    reasons = [F.when(F.col("__broken").isNotNull(), _of_fields(F.col("__broken"), len(header)))]
    for f in present:
        given, value = _given(f.name), _cast(f.name, f.dataType)
        if f.name in dates:
            value = F.when(given.rlike(r"^\d{8}$"), F.try_to_timestamp(given, F.lit("yyyyMMdd")))
        elif isinstance(f.dataType, T.StringType):
            continue
        reasons.append(F.when(given.isNotNull() & value.isNull(), f"{f.name} isn't {'a day' if f.name in dates else f.dataType.simpleString()}"))
    row = F.to_csv(F.struct(*(F.col(f"`{c}`") for c in header)))
    return text.select(
        *(_cast(f.name, f.dataType).alias(f.name) for f in present),
        *(_given(c).alias(c) for c in others),
        F.coalesce(*reasons).alias(REASON),
        F.coalesce("__broken", row).alias(TEXT),
        F.col("_metadata.file_path").alias(FILE),
    )


def land_csv_judged(judged: DataFrame, path: str) -> DataFrame:
    """``judged`` parsed once and written below ``path``, rows that fit and others in folders of their own; read from there."""
    fits = F.col(REASON).isNull()
    # Texts of rows that fit aren't kept twice.
    told = judged.withColumn(ACCEPTED, fits).withColumn(TEXT, F.when(~fits, F.col(TEXT)))
    with open_folders(told.sparkSession, 2):
        write_table(told, path, [ACCEPTED])
    # With its schema, as a table without rows has no files.
    return told.sparkSession.read.schema(told.schema).parquet(path)


def accepted(landed: DataFrame) -> DataFrame:
    """The rows that fit; those of the other folder aren't read."""
    return landed.where(F.col(ACCEPTED)).drop(*ADDED)


def reject_counts(landed: DataFrame) -> DataFrame:
    """(reason, n_rows) of the rows that don't fit."""
    faulty = landed.where(~F.col(ACCEPTED))
    return faulty.groupBy(F.col(REASON).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def at_most(landed: DataFrame, limit: int) -> DataFrame:
    """The rows that fit, if no more than ``limit`` don't; else an error that counts them by reason."""
    counts = reject_counts(landed).orderBy("reason").collect()  # a row for each column at most
    if sum(r["n_rows"] for r in counts) > limit:
        told = "; ".join(f"{r['reason']}: {r['n_rows']}" for r in counts)
        raise ValueError(f"more than {limit} rows rejected: {told}")
    return accepted(landed)
