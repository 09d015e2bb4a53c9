"""Sessions, purchases and revenue per dimension and per month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpath.functions import month_label, month_start, pct_of, pct_ratio, per_unit
from tillpath.operators.sessions import session_rollup, sessions_where


def kpis_of_sessions(
    rollup: DataFrame, by: str, exclude: Sequence[str] = (), ordered: bool = True
) -> DataFrame:
    """`kpis_by` on an existing session rollup."""
    kept = rollup.filter(F.col(by).isNotNull())
    if exclude:
        kept = kept.filter(~F.col(by).isin(*exclude))
    report = (
        kept.groupBy(by)
        .agg(
            F.count("session").alias("sessions"),
            sessions_where(F.col("purchase_rows") > 0).alias("purchase"),
            F.sum("purchase_revenue").alias("revenue"),
            F.sum("purchase_rows").alias("purchase_rows"),
        )
        .filter(F.col("purchase_rows") > 0)
        .select(
            by,
            "sessions",
            "purchase",
            "revenue",
            per_unit(F.col("revenue"), F.col("sessions"), 2).alias("revenue_per_session"),
            pct_of(F.col("purchase"), F.col("sessions"), 1).alias("cvr_pct"),
        )
    )
    return report.orderBy(F.desc("revenue"), by) if ordered else report


def kpis_by(
    events: DataFrame,
    by: str,
    exclude: Sequence[str] = (),
    session_key: str | Sequence[str] = "session_id",
    ordered: bool = True,
) -> DataFrame:
    """Sessions, purchase sessions and purchase revenue per value of ``by``.

    Only revenue on purchase rows counts. Values without a purchase, the null value and the
    values in ``exclude`` are left out; the highest revenue comes first. ``ordered=False`` spares
    the sort for a report that is built on top.
    """
    rollup = session_rollup(events, by, session_key=session_key)
    return kpis_of_sessions(rollup, by, exclude, ordered)


def monthly_trend(
    events: DataFrame, session_key: str | Sequence[str] = "session_id", ordered: bool = True
) -> DataFrame:
    """Purchase sessions, sessions and revenue per month, for months with a purchase.

    Here revenue counts on every row, not on purchase rows alone. ``ordered=False`` spares the
    sort for a report that is built on top.
    """
    # Rows without a date are dropped as one month at the end: a filter on the parsed date would be
    # pushed below the parsing and evaluate it twice for every row.
    dated = events.withColumn("month", month_start("event_date"))
    months = (
        session_rollup(dated, "month", session_key=session_key)
        .groupBy("month")
        .agg(
            sessions_where(F.col("purchase_rows") > 0).alias("purchase_sessions"),
            F.count("session").alias("total_sessions"),
            F.sum("revenue").alias("total_revenue"),
            F.sum("purchase_rows").alias("purchase_rows"),
            F.count("month").alias("dated"),
        )
        .filter((F.col("purchase_rows") > 0) & (F.col("dated") > 0))
    )
    sessions = F.col("total_sessions")
    trend = months.select(
        month_label("month").alias("year_month"),
        "purchase_sessions",
        "total_sessions",
        "total_revenue",
        pct_ratio(F.col("purchase_sessions"), sessions, 2).alias("cvr_pct"),
        per_unit(F.col("total_revenue"), sessions, 2).alias("revenue_per_session"),
    )
    return trend.orderBy("year_month") if ordered else trend


def monthly_growth(trend: DataFrame) -> DataFrame:
    """Change of sessions and of revenue per session against the month before and the first month.

    Takes a `monthly_trend` report, so the window spans one row per month.
    """
    in_order = Window.partitionBy().orderBy("year_month")
    columns = [F.col("year_month")]
    for column, short in (("total_sessions", "sessions"), ("revenue_per_session", "rps")):
        now = F.col(column)
        before = F.lag(column).over(in_order)
        first = F.first(column).over(in_order)
        columns += [
            now,
            pct_of(now - before, before, 2).alias(f"{short}_change_pct"),
            per_unit(now, first, 2).alias(f"{short}_vs_first"),
        ]
    return trend.select(columns).orderBy("year_month")


def shares(report: DataFrame, by: str) -> DataFrame:
    """Each value's share of the sessions and of the revenue of a `kpis_by` report.

    The window spans the report's rows, one per value.
    """
    overall = Window.partitionBy()
    return report.select(
        by,
        pct_of(F.col("sessions"), F.sum("sessions").over(overall), 2).alias("session_share_pct"),
        pct_of(F.col("revenue"), F.sum("revenue").over(overall), 2).alias("revenue_share_pct"),
    ).orderBy(by)


def rps_ratio(report: DataFrame, by: str = "channel", baseline: str | None = None) -> DataFrame:
    """Revenue per session of each group as a multiple of ``baseline``, or of the lowest group.

    Takes a `kpis_by` report; the base is one value, read as a scalar subquery.
    """
    rate = F.col("revenue_per_session")
    chosen = report if baseline is None else report.filter(F.col(by) == baseline)
    base = chosen.agg(F.min(rate).alias("base"))
    return report.select(
        by, rate, per_unit(rate, base.scalar(), 2).alias("rps_ratio")
    ).orderBy(F.desc("revenue_per_session"), by)
