"""Counts that describe a table: values, shapes, null shares and attribution coverage."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.functions import pct_of


def value_counts(df: DataFrame, column: str, event: str | None = None) -> DataFrame:
    """Rows per non-null value of ``column``, of all events or of one, most frequent first."""
    rows = df.filter(F.col(column).isNotNull())
    if event is not None:
        rows = rows.filter(F.col("event_name") == event)
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def attribution_coverage(events: DataFrame) -> DataFrame:
    """Sessions with a source among all sessions."""
    sessions = (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.max(F.col("source").isNotNull().cast("int")).alias("attributed"))
    )
    attributed = F.coalesce(F.sum("attributed"), F.lit(0)).alias("attributed_sessions")
    counts = sessions.agg(attributed, F.count(F.lit(1)).alias("total_sessions"))
    share = pct_of(F.col("attributed_sessions"), F.col("total_sessions"), 2)
    return counts.select("*", share.alias("coverage_pct"))


def table_shapes(
    tables: Mapping[str, DataFrame], columns: Mapping[str, int] | None = None
) -> DataFrame:
    """Row and column count of each table.

    ``columns`` gives the width of a table whose rows are counted on a narrower one.
    """
    widths = columns or {}
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(widths.get(name, len(df.columns))).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.union, counts).orderBy("table_name")


def null_profile(df: DataFrame) -> DataFrame:
    """Non-null rows of every column, counted in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("all_rows"), *[F.count(c).alias(f"{c}__n") for c in df.columns]
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("all_rows").alias("n_rows"),
                F.col(f"{c}__n").alias("n_non_null"),
            )
            for c in df.columns
        ]
    )
    share = pct_of(F.col("n_non_null"), F.col("n_rows"), 2).alias("coverage_pct")
    return counts.select(F.inline(per_column)).select("*", share).orderBy("column_name")


def coverage_by_event(events: DataFrame) -> DataFrame:
    """Share of each event's rows that carry a source."""
    counts = events.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("source").alias("rows_with_source")
    )
    share = pct_of(F.col("rows_with_source"), F.col("n_rows"), 2).alias("coverage_pct")
    return counts.select("*", share).orderBy("event_name")
