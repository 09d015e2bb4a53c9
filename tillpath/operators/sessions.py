"""Events rolled up to sessions, the grain on which the session reports count.

The rollup is the only event-sized shuffle of those reports. It merges rows map-side, so a
session, page, device or channel that holds much of the table still shuffles a few rows per task,
and the distinct session counts above it become plain counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath import schema as S
from tillpath.functions import as_columns, session_key_column

Stages = Sequence[tuple[str, str]]


def stage_column(position: int) -> str:
    """Name of the rollup column that counts the rows of the stage at ``position``."""
    return f"stage_{position}_rows"


def rollup_aggregates(columns: Sequence[str], stages: Stages = S.STAGES) -> list[Column]:
    """What every session report needs to know of a session; unused ones are pruned."""
    name = F.col("event_name")
    mapped = F.coalesce(name.isin(*[event for event, _ in stages]), F.lit(False))
    out = [
        F.count(F.lit(1)).alias("rows"),
        F.count(name).alias("named_rows"),
        F.count_if(name == S.PURCHASE_EVENT).alias("purchase_rows"),
        F.count_if(~mapped).alias("unmapped_rows"),
    ]
    for position, (event, _) in enumerate(stages):
        out.append(F.count_if(name == event).alias(stage_column(position)))
    if "revenue" in columns:
        revenue = F.col("revenue").cast("double")
        out.append(F.sum(revenue).alias("revenue"))
        out.append(F.sum(F.when(name == S.PURCHASE_EVENT, revenue)).alias("purchase_revenue"))
    return out


def session_rollup(
    events: DataFrame,
    by: str | Sequence[str] | None = None,
    stages: Stages = S.STAGES,
    session_key: str | Sequence[str] = "session_id",
) -> DataFrame:
    """One row per session, or per session and value of ``by``, with its row counts and revenue.

    ``session`` is the key; rows without one form a group with a null key, which no session count
    includes.
    """
    keyed = events.withColumn("session", session_key_column(session_key))
    return keyed.groupBy("session", *as_columns(by)).agg(
        *rollup_aggregates(events.columns, stages)
    )


def sessions_where(condition: Column) -> Column:
    """Number of sessions for which ``condition`` holds."""
    return F.count_if(condition & F.col("session").isNotNull())
