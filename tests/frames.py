"""Small hand-made tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillpath import schema as S


def raw(spark: SparkSession, *rows: dict) -> DataFrame:
    """Raw events; unnamed columns are null but for the id, the day and the event."""
    base = {name: None for name in S.RAW_EVENTS.names}
    full = []
    for number, row in enumerate(rows):
        day = {"event_id": number, "event_date": "20201101", "event_name": "view_item"}
        full.append(tuple({**base, **day, **row}[c] for c in S.RAW_EVENTS.names))
    return spark.createDataFrame(full, S.RAW_EVENTS)


def items(spark: SparkSession, *rows: dict) -> DataFrame:
    """Raw items."""
    base = {"event_date": "20201101", "session_id": 1, "item_name": "hat", "item_category": "Hats"}
    base |= {"item_revenue": 1.0, "quantity": 1.0}
    full = [tuple({**base, **row}[c] for c in S.RAW_ITEMS.names) for row in rows]
    return spark.createDataFrame(full, S.RAW_ITEMS)


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def records(df: DataFrame, key: str) -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
