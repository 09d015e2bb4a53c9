"""Session keys, grouping columns and month keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_columns(by: str | Sequence[str] | None) -> list[str]:
    """Column names given as one name, several names or none."""
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def session_key_column(session_key: str | Sequence[str]) -> Column:
    """One column that identifies a session; null as soon as one part is null.

    Session ids recur across users, so a compound key such as
    ``["user_pseudo_id", "session_id"]`` counts more sessions than the bare id.
    """
    parts = as_columns(session_key)
    if len(parts) == 1:
        return F.col(parts[0])
    complete = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts])
    return F.when(complete, F.struct(*parts))


def month_start(date: str | Column) -> Column:
    """First day of the month: a fixed-width grouping key, cheaper than its text."""
    return F.trunc(date, "month")


def month_label(date: str | Column) -> Column:
    """``yyyy-MM`` text of a date."""
    return F.date_format(date, "yyyy-MM")
