"""Sessions with their channel in one pass over raw events, and the channel reports on them.

A channel belongs to a session, so reports per channel need no event-level join: one grouping by
session yields the attribution and the session's counts together. It reads the events once,
shuffles one merged row per session and task, and is small enough to store and share between all
channel reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath import schema as S
from tillpath.functions import session_key_column
from tillpath.operators.attribution import (
    ATTRIBUTES,
    attribution_aggregates,
    fill_missing,
    group_channels,
)
from tillpath.operators.engagement import bounce_rate_of_sessions
from tillpath.operators.funnel import funnel_of_sessions
from tillpath.operators.products import channel_category_of_purchases
from tillpath.operators.revenue import kpis_of_sessions
from tillpath.operators.sessions import Stages, rollup_aggregates


def session_mart(
    raw_events: DataFrame,
    priority: Sequence[str] | None = None,
    own_hosts: Sequence[str] = S.OWN_HOSTS,
    stages: Stages = S.STAGES,
    session_key: str | Sequence[str] = "session_id",
) -> DataFrame:
    """One row per session: its counts and revenue, source, medium, campaign and channel.

    Rows without a session form one row with a null ``session`` and the Unknown channel.
    """
    columns = raw_events.columns
    sessions = raw_events.groupBy(session_key_column(session_key).alias("session")).agg(
        *rollup_aggregates(columns, stages), *attribution_aggregates(columns, priority)
    )
    known = F.col("session").isNotNull()
    own = {name: F.when(known, F.col(name)) for name in ATTRIBUTES.values()}
    return group_channels(fill_missing(sessions.withColumns(own)), own_hosts)


def channel_kpis(mart: DataFrame) -> DataFrame:
    """Sessions, purchases and revenue of every reliable channel."""
    return kpis_of_sessions(mart, "channel", S.UNRELIABLE_CHANNELS)


def channel_funnel(
    mart: DataFrame, stages: Stages = S.STAGES, drop_unmapped: bool = False
) -> DataFrame:
    """The funnel of every channel."""
    return funnel_of_sessions(mart, "channel", stages, drop_unmapped)


def channel_bounce(mart: DataFrame) -> DataFrame:
    """The bounce rate of every channel with a bounce."""
    return bounce_rate_of_sessions(mart, "channel")


def row_counts(mart: DataFrame, column: str, rows: str = "rows") -> DataFrame:
    """Events (``rows``) or purchase events (``purchase_rows``) per channel or source."""
    return (
        mart.groupBy(column)
        .agg(F.sum(rows).alias("n"))
        .filter(F.col("n") > 0)
        .orderBy(F.desc("n"), column)
    )


def known_sessions(mart: DataFrame) -> DataFrame:
    """session_id, channel and purchase rows of every session with an id."""
    compound = isinstance(mart.schema["session"].dataType, T.StructType)
    key = F.col("session.session_id" if compound else "session").alias("session_id")
    return mart.filter(F.col("session").isNotNull()).select(key, "channel", "purchase_rows")


def channel_items(
    items: DataFrame, mart: DataFrame, dedup: bool = False, ordered: bool = True
) -> DataFrame:
    """Revenue and orders of every reliable channel and category.

    Items name no user, so with a compound session key they meet every session with their id.
    """
    return channel_category_of_purchases(items, purchasing_sessions(mart), dedup, ordered)


def purchasing_sessions(mart: DataFrame) -> DataFrame:
    """`known_sessions` with a purchase."""
    return known_sessions(mart).filter(F.col("purchase_rows") > 0)
