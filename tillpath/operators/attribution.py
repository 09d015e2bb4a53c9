"""A marketing source, medium and campaign for every session, and the channel they stand for."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath import schema as S
from tillpath.functions import as_columns, channel_label

ATTRIBUTES = {"source": "session_source", "medium": "session_medium", "campaign": "session_campaign"}

HOT_SHARE = 1e-4
"""Share of all rows that one session may bring to a task of a join, see `attach_sessions`."""

NOWHERE = 1 << 20
"""Parts that rows without a session are dealt to; they meet nothing there."""


def attributed_rows(events: DataFrame) -> DataFrame:
    """Events that carry a source; their medium and campaign may be null."""
    return events.filter(F.col("source").isNotNull())


def precedence(columns: Sequence[str], value: str, priority: Sequence[str] | None) -> Column:
    """Sort key of an event for one attribute: lowest first, null where the value is missing.

    Without ``priority`` event names count in ascending order, null names last. Ties inside one
    event name go to the lowest ``event_id``, or to the lowest value in tables without one.
    """
    name = F.col("event_name")
    if priority is None:
        order = [name.isNull(), name]
    else:
        rank = F.lit(len(priority))
        for position, event in reversed(list(enumerate(priority))):
            rank = F.when(name == event, position).otherwise(rank)
        order = [rank]
    tie = F.col("event_id" if "event_id" in columns else value)
    return F.when(F.col(value).isNotNull(), F.struct(*order, tie))


def attribution_aggregates(
    columns: Sequence[str], priority: Sequence[str] | None = None
) -> list[Column]:
    """First non-null source, medium and campaign among the rows with a source.

    Each attribute is taken by itself, so the three may come from different events. They merge
    map-side, which leaves at most one row per session and task to shuffle.
    """
    has_source = F.col("source").isNotNull()
    return [
        F.min_by(value, F.when(has_source, precedence(columns, value, priority))).alias(alias)
        for value, alias in ATTRIBUTES.items()
    ]


def attribute_sessions(
    events: DataFrame,
    priority: Sequence[str] | None = None,
    session_key: str | Sequence[str] = "session_id",
) -> DataFrame:
    """One row per session that has a source: ``session_source``, ``_medium``, ``_campaign``.

    ``priority`` lists event names from strongest to weakest; the rest follow as equals.
    """
    parts = as_columns(session_key)
    return (
        attributed_rows(events)
        .dropna(subset=parts)
        .groupBy(*parts)
        .agg(*attribution_aggregates(events.columns, priority))
    )


def fill_missing(df: DataFrame) -> DataFrame:
    """Name a missing session source and medium; a missing campaign stays null."""
    return df.fillna({"session_source": S.MISSING_SOURCE, "session_medium": S.MISSING_SOURCE})


def group_channels(df: DataFrame, own_hosts: Sequence[str] = S.OWN_HOSTS) -> DataFrame:
    """Add ``channel`` from ``session_source`` and ``session_medium``."""
    return df.withColumn("channel", channel_label("session_source", "session_medium", own_hosts))


def _complete(parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts])


def _bucket(parts: Sequence[str], hot_share: float) -> Column:
    """One of ``4 / hot_share`` buckets for a session, by its hash."""
    buckets = math.ceil(4 / hot_share) if hot_share > 0 else 1
    return F.when(_complete(parts), F.pmod(F.xxhash64(*parts), F.lit(buckets)))


def crowded_buckets(
    events: DataFrame,
    hot_share: float = HOT_SHARE,
    session_key: str | Sequence[str] = "session_id",
) -> DataFrame:
    """(bucket, salts) of the buckets of sessions with more than ``hot_share`` of all rows.

    The counts per bucket are a sketch of how often each session occurs: they never fall below a session's
    own count, merge by adding up, and take one row per bucket, however many sessions there are. So one
    aggregate that merges map-side replaces counting the sessions, and a hot session is never missed. ``salts`` is the
    number of parts that leave no more than the share in each. There are under ``1 / hot_share`` such
    buckets, with under ``2 / hot_share`` salts in all.

    The counts are exact, so evaluating this twice gives the same rows twice.
    """
    parts = as_columns(session_key)
    counts = events.groupBy(_bucket(parts, hot_share).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    whole = counts.agg(
        F.sum("rows").alias("total"), F.collect_list(F.struct("bucket", "rows")).alias("buckets")
    )
    limit = F.greatest(F.lit(hot_share) * F.col("total"), F.lit(1.0))
    return (
        whole.select(limit.alias("limit"), F.inline("buckets"))
        .filter(F.col("bucket").isNotNull() & (F.col("rows") > F.col("limit")))
        .select("bucket", F.ceil(F.col("rows") / F.col("limit")).cast("int").alias("salts"))
    )


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def attach_sessions(
    events: DataFrame,
    sessions: DataFrame,
    hot_share: float = HOT_SHARE,
    session_key: str | Sequence[str] = "session_id",
) -> DataFrame:
    """Left join of event rows to ``sessions``, which holds a session at most once.

    Rows of one session would meet in one task of a shuffled join, and so would all rows without a
    session; a single key can hold a third of the table. So rows meet by session and salt: those of sessions in a
    crowded bucket are dealt to the bucket's salts by a hash of the row, and the attributes of these sessions are repeated
    for every salt. Sessions share a bucket at random, so on average less than half a row per session is
    added, and mostly none. Rows without a session are spread the same way and match nothing.

    Salts depend on the rows alone: tasks that run again give the same rows. Only rows that are equal in every
    column stay together.
    """
    parts = as_columns(session_key)
    attributes = [c for c in sessions.columns if c not in parts]
    crowded = F.broadcast(crowded_buckets(events, hot_share, session_key).toDF("__bucket", "__salts"))
    bucket = _bucket(parts, hot_share).alias("__bucket")
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in events.schema if not _has_map(f.dataType)])
    salt = (
        F.when(~_complete(parts), F.pmod(row, F.lit(NOWHERE)))
        .when(F.col("__salts").isNotNull(), F.pmod(row, F.col("__salts")))
        .otherwise(F.lit(0))
    )
    dealt = events.select("*", bucket).join(crowded, "__bucket", "left").withColumn("__salt", salt.cast("int"))
    salts = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    repeated = (
        sessions.select("*", bucket)
        .join(crowded, "__bucket", "left")
        .select(*sessions.columns, F.explode(salts).alias("__salt"))
    )
    found = dealt.join(repeated, [*parts, "__salt"], "left")
    return found.select(*[F.col(f"`{c}`") for c in [*events.columns, *attributes]])
