"""What is known of each session so far, in a form that can be merged with later events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath import schema as S
from tillpath.functions import as_columns, session_key_column
from tillpath.operators.attribution import ATTRIBUTES, precedence
from tillpath.operators.sessions import Stages, rollup_aggregates

NO_MONTH = "none"
"""The month of events without a date."""


def first_column(value: str) -> str:
    """Name of the state column with the first event's value of an attribute."""
    return f"first_{value}"


def session_state(
    events: DataFrame,
    month: Column,
    priority: Sequence[str] | None = None,
    stages: Stages = S.STAGES,
    session_key: str | Sequence[str] = "session_id",
) -> DataFrame:
    """One row per session: its counts and revenue, its months, and for each attribute the first event's value.

    The first event is kept with its precedence, so states of different events merge to the state of
    all. Rows without a session form one row with a null ``session``. A session has one entry in ``months`` for each calendar
    month it has events in.
    """
    columns = events.columns
    has_source = F.col("source").isNotNull()
    firsts = [
        F.min(
            F.when(
                has_source & F.col(value).isNotNull(),
                F.struct(precedence(columns, value, priority).alias("order"), F.col(value).alias("value")),
            )
        ).alias(first_column(value))
        for value in ATTRIBUTES
    ]
    return events.groupBy(session_key_column(session_key).alias("session")).agg(
        *rollup_aggregates(columns, stages),
        *firsts,
        F.sort_array(F.collect_set(month)).alias("months"),
    )


def merged(states: Sequence[DataFrame]) -> DataFrame:
    """The state of all events that ``states`` were made from; they must not share any."""
    every = reduce(DataFrame.unionByName, states)
    firsts = [first_column(value) for value in ATTRIBUTES]
    counts = [c for c in every.columns if c not in ("session", "months", *firsts)]
    return every.groupBy("session").agg(
        *[F.sum(c).alias(c) for c in counts],
        *[F.min(c).alias(c) for c in firsts],
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("months")))).alias("months"),
    )


def attributes(state: DataFrame) -> list[Column]:
    """Source, medium and campaign of each session; null for the row of events without a session."""
    known = F.col("session").isNotNull()
    return [
        F.when(known, F.col(f"{first_column(value)}.value")).alias(alias)
        for value, alias in ATTRIBUTES.items()
    ]


def session_attributes(state: DataFrame, session_key: str | Sequence[str] = "session_id") -> DataFrame:
    """The key's columns and the attributes of every session with a key."""
    parts = as_columns(session_key)
    compound = isinstance(state.schema["session"].dataType, T.StructType)
    key = [F.col(f"session.{p}" if compound else "session").alias(p) for p in parts]
    return state.filter(F.col("session").isNotNull()).select(*key, *attributes(state))


def months_to_rewrite(before: DataFrame, added: DataFrame) -> DataFrame:
    """(month) of all earlier events whose session's attributes change by the state ``added``."""
    firsts = [first_column(value) for value in ATTRIBUTES]
    later = added.select("session", *[F.col(c).alias(f"added_{c}") for c in firsts])
    changes = [
        ~F.least(c, f"added_{c}").getField("value").eqNullSafe(F.col(c).getField("value")) for c in firsts
    ]
    met = before.select("session", "months", *firsts).join(later, "session")
    changed = met.filter(reduce(lambda a, b: a | b, changes))
    return changed.select(F.explode("months").alias("month")).distinct()
