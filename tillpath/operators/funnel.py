"""Sessions per funnel stage, the loss between stages and the share that is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpath import schema as S
from tillpath.functions import as_columns, pct_of
from tillpath.operators.sessions import (
    Stages,
    session_rollup,
    sessions_where,
    stage_column,
)


def funnel_of_sessions(
    rollup: DataFrame,
    by: str | Sequence[str] | None = None,
    stages: Stages = S.STAGES,
    drop_unmapped: bool = False,
) -> DataFrame:
    """`funnel` on an existing session rollup."""
    keys = as_columns(by)
    slots = [(stage_column(i), label) for i, (_, label) in enumerate(stages)]
    if not drop_unmapped:
        slots.insert(0, ("unmapped_rows", None))
    counts = rollup.groupBy(*keys).agg(
        *[F.sum(column).alias(column) for column, _ in slots],
        *[sessions_where(F.col(column) > 0).alias(f"{column}_n") for column, _ in slots],
    )
    # One row per stage that occurs: at most one more than there are stages.
    stage_rows = F.array(
        *[
            F.struct(
                F.lit(label).cast("string").alias("funnel_stage"),
                F.col(f"{column}_n").alias("sessions"),
                F.col(column).alias("rows"),
            )
            for column, label in slots
        ]
    )
    present = counts.select(*keys, F.inline(stage_rows)).filter(F.col("rows") > 0)
    in_order = Window.partitionBy(*keys).orderBy("funnel_stage")
    before = F.lag("sessions").over(in_order)
    top = F.first("sessions").over(in_order)
    sessions = F.col("sessions")
    return present.select(
        *keys,
        "funnel_stage",
        "sessions",
        pct_of(before - sessions, before, 1).alias("dropoff_pct"),
        pct_of(sessions, top, 1).alias("cvr_from_top_pct"),
    ).orderBy(*keys, "funnel_stage")


def funnel(
    events: DataFrame,
    by: str | Sequence[str] | None = None,
    stages: Stages = S.STAGES,
    drop_unmapped: bool = False,
    session_key: str | Sequence[str] = "session_id",
) -> DataFrame:
    """Funnel report, overall or per value of ``by``.

    ``dropoff_pct`` compares with the stage before among those that occur, and ``cvr_from_top_pct``
    with the first that occurs; a group with more sessions at a later stage gets a negative
    drop-off. Events outside the stages form a stage with a null label that sorts first and so
    becomes the top; ``drop_unmapped`` leaves them out.
    """
    rollup = session_rollup(events, by, stages, session_key)
    return funnel_of_sessions(rollup, by, stages, drop_unmapped)


def funnel_matrix(
    report: DataFrame, by: str = "channel", stages: Stages = S.STAGES
) -> DataFrame:
    """One row per group of a `funnel` report: the drop-off into each stage and the final rate."""
    columns = []
    for event, label in stages[1:]:
        at_stage = F.col("funnel_stage") == label
        columns.append(F.max(F.when(at_stage, F.col("dropoff_pct"))).alias(f"{event}_dropoff_pct"))
    at_end = F.col("funnel_stage") == stages[-1][1]
    columns.append(F.max(F.when(at_end, F.col("cvr_from_top_pct"))).alias("final_cvr_pct"))
    return report.groupBy(by).agg(*columns).orderBy(by)
