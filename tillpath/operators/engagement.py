"""Bounce rates, and new against returning users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpath import schema as S
from tillpath.functions import pct_of, pct_ratio, per_unit, session_key_column
from tillpath.operators.sessions import session_rollup


def bounce_rate_of_sessions(
    rollup: DataFrame, by: str | None = None, min_sessions: int | None = None
) -> DataFrame:
    """`bounce_rate` on an existing session rollup."""
    total = F.count("session").alias("total_sessions")
    bounced = F.count_if(F.col("named_rows") == 1).alias("bounced_sessions")
    rate = pct_ratio(F.col("bounced_sessions"), F.col("total_sessions"), 2).alias("bounce_rate_pct")
    if by is None:
        counts = rollup.agg(total, bounced)
        some = F.col("bounced_sessions") > 0
        return counts.select(
            F.when(some, F.col("total_sessions")).alias("total_sessions"),
            "bounced_sessions",
            F.when(some, rate).alias("bounce_rate_pct"),
        )
    counts = (
        rollup.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(total, bounced)
        .filter(F.col("bounced_sessions") > 0)
    )
    if min_sessions is None:
        return counts.select("*", rate).orderBy(F.desc("total_sessions"), by)
    large = counts.filter(F.col("total_sessions") >= min_sessions)
    return large.select("*", rate).orderBy("bounce_rate_pct", by)


def bounce_rate(
    events: DataFrame,
    by: str | None = None,
    min_sessions: int | None = None,
    session_key: str | Sequence[str] = "session_id",
) -> DataFrame:
    """Share of sessions with exactly one named event.

    With ``by`` a session counts once in every group it touches, and bounces in a group where it
    has one event; groups without a bounce and the null group are left out, the largest groups
    come first. ``min_sessions`` keeps the groups of that size and puts the lowest rate first. The
    overall report always is one row, with nulls when no session bounced. The group of rows
    without a session id can count as bounced but is no session.
    """
    return bounce_rate_of_sessions(session_rollup(events, by, session_key=session_key), by, min_sessions)


def new_vs_returning(
    events: DataFrame, session_key: str | Sequence[str] = "session_id"
) -> DataFrame:
    """Sessions, purchases and revenue of users with one session against those with more.

    A user with no session id at all counts as returning. A session shared by both kinds of user
    counts in both rows, and is a purchase of the kind whose user bought.

    Users are labelled by comparing their lowest and highest session. No label is joined back to
    the events, as one very active user would then meet all its rows in one task: a session's
    returning users are all its users less the new ones, and a new user has one session only.
    The events are read and shuffled once, merged by session and user; groupings of that by user and
    by session give every count.
    """
    known = events.filter(F.col("user_pseudo_id").isNotNull()).withColumn(
        "session", session_key_column(session_key)
    )
    bought = F.coalesce(F.col("event_name") == S.PURCHASE_EVENT, F.lit(False))
    visits = known.groupBy("session", "user_pseudo_id").agg(
        F.max(bought.cast("int")).alias("buyer"),
        F.sum(F.col("revenue").cast("double")).alias("revenue"),
    )
    has_session = F.col("session").isNotNull()
    is_new = F.coalesce(F.col("session") == F.col("last_session"), F.lit(False))
    users = (
        visits.groupBy("user_pseudo_id")
        .agg(
            F.min("session").alias("session"),
            F.max("session").alias("last_session"),
            F.max(F.when(has_session, F.col("buyer")).otherwise(0)).alias("buyer"),
            F.sum("revenue").alias("revenue"),
        )
        .select(
            F.when(is_new, F.col("session")).alias("session"),
            F.lit(0).alias("users"),
            F.lit(0).alias("buyers"),
            is_new.cast("int").alias("new_users"),
            F.when(is_new, F.col("buyer")).otherwise(0).alias("new_buyers"),
            F.when(is_new, F.col("revenue")).alias("new_revenue"),
            (~is_new).cast("int").alias("old_users"),
            F.when(~is_new, F.col("revenue")).alias("old_revenue"),
        )
    )
    # Always true; with the revenue both branches read the same columns, so they come from one shuffle.
    counts = has_session & F.coalesce(F.abs("revenue") >= 0, F.lit(True))
    visitors = visits.select(
        "session",
        F.when(counts, 1).otherwise(0).alias("users"),
        F.when(counts, F.col("buyer")).otherwise(0).alias("buyers"),
        F.lit(0).alias("new_users"),
        F.lit(0).alias("new_buyers"),
    )
    sums = [c for c in users.columns if c != "session"]
    totals = (
        users.unionByName(visitors, allowMissingColumns=True)
        .groupBy("session")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .agg(
            F.sum("new_users").alias("new_users"),
            F.sum("old_users").alias("old_users"),
            F.count_if(F.col("new_users") > 0).alias("new_sessions"),
            F.count_if(F.col("users") > F.col("new_users")).alias("old_sessions"),
            F.count_if(F.col("new_buyers") > 0).alias("new_purchases"),
            F.count_if(F.col("buyers") > F.col("new_buyers")).alias("old_purchases"),
            F.sum("new_revenue").alias("new_revenue"),
            F.sum("old_revenue").alias("old_revenue"),
        )
    )
    kinds = F.array(
        *[
            F.struct(
                F.lit(label).alias("user_type"),
                F.col(f"{kind}_users").alias("users"),
                F.col(f"{kind}_sessions").alias("sessions"),
                F.col(f"{kind}_purchases").alias("purchases"),
                F.col(f"{kind}_revenue").alias("revenue"),
            )
            for kind, label in (("new", S.NEW_USER), ("old", S.RETURNING_USER))
        ]
    )
    return (
        totals.select(F.inline(kinds))
        .filter(F.col("users") > 0)
        .select(
            "user_type",
            "sessions",
            "purchases",
            F.round("revenue", 2).alias("revenue"),
            per_unit(F.col("revenue"), F.col("sessions"), 2).alias("revenue_per_session"),
            pct_of(F.col("purchases"), F.col("sessions"), 2).alias("cvr_pct"),
        )
        .orderBy("user_type")
    )


def user_type_lift(report: DataFrame) -> DataFrame:
    """Each user type's share of sessions and revenue, and its rates as multiples of new users'.

    Takes a `new_vs_returning` report, so the window spans two rows at most.
    """
    overall = Window.partitionBy()

    def of_new(column: str):
        return F.max(F.when(F.col("user_type") == S.NEW_USER, F.col(column))).over(overall)

    return report.select(
        "user_type",
        pct_of(F.col("sessions"), F.sum("sessions").over(overall), 2).alias("session_share_pct"),
        pct_of(F.col("revenue"), F.sum("revenue").over(overall), 2).alias("revenue_share_pct"),
        per_unit(F.col("cvr_pct"), of_new("cvr_pct"), 2).alias("cvr_lift"),
        per_unit(F.col("revenue_per_session"), of_new("revenue_per_session"), 2).alias(
            "revenue_per_session_lift"
        ),
    ).orderBy("user_type")
