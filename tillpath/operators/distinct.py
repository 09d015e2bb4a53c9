"""Distinct sessions and users over any range of months, from sketches that merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.functions import month_label, session_key_column

ALL = "all"
DIMENSIONS = ("device_category", "country")
SKETCH_BITS = 12
"""A sketch has 2 ** 12 registers: 4 KB for each month and value, however many sessions there are."""
ERROR_BOUND = 0.05
"""Three standard errors of such a sketch, 3 * 1.04 / sqrt(2 ** 12), rounded up."""


def _sketch(value: Column) -> Column:
    return F.hll_sketch_agg(value, F.lit(SKETCH_BITS))


def distinct_sketches(
    events: DataFrame,
    dimensions: Sequence[str] = DIMENSIONS,
    session_key: str | Sequence[str] = "session_id",
) -> DataFrame:
    """(month, dimension, value, sessions, users): sketches of each month's sessions and users.

    One pass over the events makes them for each month and combination of values, merged map-side; those of a dimension and
    of all rows are merged from them. Rows without a date are of no month and left out; rows without a session or user count as none.
    """
    session, user = session_key_column(session_key), F.col("user_pseudo_id")
    month = month_label("event_date").alias("month")
    finest = (
        events.filter(F.col("event_date").isNotNull())
        .groupBy(month, *dimensions)
        .agg(
            _sketch(F.when(session.isNotNull(), F.xxhash64(session))).alias("sessions"),
            _sketch(F.when(user.isNotNull(), F.xxhash64(user))).alias("users"),
        )
    )
    ways = [F.struct(F.lit(ALL).alias("dimension"), F.lit(None).cast("string").alias("value"))]
    ways += [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    each = finest.select("month", F.explode(F.array(*ways)).alias("way"), "sessions", "users")
    return _united(each.select("month", "way.dimension", "way.value", "sessions", "users"), "month", "dimension", "value")


def _united(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by).agg(
        F.hll_union_agg("sessions").alias("sessions"), F.hll_union_agg("users").alias("users")
    )


def _counted(sketches: DataFrame) -> DataFrame:
    return sketches.withColumns({c: F.hll_sketch_estimate(c) for c in ("sessions", "users")})


def active(
    sketches: DataFrame, first: str | None = None, last: str | None = None, dimension: str = ALL
) -> DataFrame:
    """Sessions and users of a dimension's values from month ``first`` to month ``last``, within the error bound."""
    chosen = sketches.filter(F.col("dimension") == dimension)
    if first is not None:
        chosen = chosen.filter(F.col("month") >= first)
    if last is not None:
        chosen = chosen.filter(F.col("month") <= last)
    return _counted(_united(chosen, "value")).orderBy("value")


def month_ranges(months: DataFrame) -> DataFrame:
    """(first_month, last_month, month): every range of the given months with the months in it.

    Takes distinct calendar months; one row holds them all.
    """
    listed = months.agg(F.sort_array(F.collect_set("month")).alias("months"))
    firsts = listed.select("months", F.posexplode("months").alias("start", "first_month"))
    rest = F.slice("months", F.col("start") + 1, F.size("months"))
    ranges = firsts.select("first_month", F.posexplode(rest).alias("length", "last_month"), rest.alias("rest"))
    within = F.slice("rest", F.lit(1), F.col("length") + 1)
    return ranges.select("first_month", "last_month", F.explode(within).alias("month"))


def active_by_range(sketches: DataFrame, dimension: str = ALL) -> DataFrame:
    """Sessions and users of every range of months and value of a dimension, within the error bound."""
    chosen = sketches.filter(F.col("dimension") == dimension)
    ranges = month_ranges(chosen.select("month"))
    united = _united(chosen.join(ranges, "month"), "first_month", "last_month", "value")
    return _counted(united).orderBy("first_month", "last_month", "value")


def exact_by_range(
    events: DataFrame, dimension: str | None = None, session_key: str | Sequence[str] = "session_id"
) -> DataFrame:
    """The same counted exactly, which reads and shuffles the sessions and users of every month."""
    value = F.lit(None).cast("string") if dimension is None else F.col(dimension).cast("string")
    dated = events.filter(F.col("event_date").isNotNull()).select(
        month_label("event_date").alias("month"),
        value.alias("value"),
        session_key_column(session_key).alias("session"),
        F.col("user_pseudo_id").alias("user"),
    )
    out = None
    for kind in ("session", "user"):
        seen = dated.select("month", "value", kind).distinct()
        ranges = month_ranges(seen.select("month"))
        counts = (
            seen.join(ranges, "month")
            .groupBy("first_month", "last_month", "value")
            .agg(F.count_distinct(kind).alias(f"exact_{kind}s"))
        )
        key = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("first_month", "last_month", "value")]
        if out is None:
            out = counts
        else:
            named = counts.select(*[F.col(c).alias(f"__{c}") for c in counts.columns[:3]], counts.columns[3])
            out = out.join(named, key).drop("__first_month", "__last_month", "__value")
    return out


def sketch_errors(
    sketches: DataFrame, events: DataFrame, dimension: str | None = None, session_key: str | Sequence[str] = "session_id"
) -> DataFrame:
    """Exact counts of every range of months and value, and whether the sketched ones are within the error bound."""
    exact = exact_by_range(events, dimension, session_key)
    ranges = active_by_range(sketches, dimension or ALL)
    named = ranges.select(*[F.col(c).alias(f"__{c}") for c in ranges.columns])
    key = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("first_month", "last_month", "value")]
    near = {
        f"{kind}_within_bound": F.abs(F.col(f"__{kind}") - F.col(f"exact_{kind}"))
        <= F.ceil(ERROR_BOUND * F.col(f"exact_{kind}"))
        for kind in ("sessions", "users")
    }
    joined = exact.join(named, key, "left").withColumns(near)
    return joined.select("first_month", "last_month", "value", "exact_sessions", "exact_users", *near).orderBy(
        "first_month", "last_month", "value"
    )
