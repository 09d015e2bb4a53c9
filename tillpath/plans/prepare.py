"""From raw tables to the two tables every analysis reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath import schema as S
from tillpath.operators.attribution import (
    HOT_SHARE,
    attach_sessions,
    attribute_sessions,
    fill_missing,
    group_channels,
)


def parsed_date(column: str = "event_date") -> Column:
    """Date of a ``yyyyMMdd`` text or number; other texts fail the job.

    Eight-digit numbers are taken apart by arithmetic, at less than half the cost of the pattern
    parser, which is left to judge the rest.
    """
    number = F.col(column).cast("int")
    parts = F.make_date(
        F.floor(number / 10000).cast("int"), F.floor(number / 100).cast("int") % 100, number % 100
    )
    pattern = F.to_date(F.col(column).cast("string"), "yyyyMMdd")
    return F.when(number.between(10000101, 99991231), parts).otherwise(pattern)


def build_items(raw_items: DataFrame) -> DataFrame:
    """Items with a parsed date."""
    return raw_items.withColumn("event_date", parsed_date())


def without_clashes(raw_events: DataFrame) -> DataFrame:
    """``raw_events`` with further columns that are named like an added one renamed, as in ``raw_channel``.

    Names differ by more than their case, as in all of Spark.
    """
    taken = {c.lower() for c in raw_events.columns}
    renamed = {}
    for name in raw_events.columns:
        if name.lower() in S.RESERVED or name.startswith(S.RESERVED_START):
            new = S.RENAMED + name.lstrip("_")
            while new.lower() in taken:
                new = S.RENAMED + new
            taken.add(new.lower())
            renamed[name] = new
    return raw_events.withColumnsRenamed(renamed) if renamed else raw_events


def without_attribution(raw_events: DataFrame) -> DataFrame:
    """Events with a parsed date and without the source columns of the single event.

    All that reports need which do not look at channels; they read this and skip the join.
    """
    events = without_clashes(raw_events).drop("source", "medium", "campaign")
    return events.withColumn("event_date", parsed_date())


def build_master(
    raw_events: DataFrame,
    priority: Sequence[str] | None = None,
    own_hosts: Sequence[str] = S.OWN_HOSTS,
    hot_share: float = HOT_SHARE,
    session_key: str | Sequence[str] = "session_id",
) -> DataFrame:
    """Every event with the source, medium, campaign and channel of its session.

    One row in gives one row out. Sessions without any source, and rows without a session, get
    the Unknown channel. Further columns are carried along, see `without_clashes`.
    """
    sessions = attribute_sessions(raw_events, priority, session_key)
    joined = attach_sessions(without_attribution(raw_events), sessions, hot_share, session_key)
    return group_channels(fill_missing(joined), own_hosts)
