"""Most visited pages and entry pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpath import schema as S
from tillpath.functions import normalized_page


LOW = 1 << 16
"""Counts below it have their ranks broadcast."""

CELL_BITS = 10


def page_counts(events: DataFrame, event: str | None = None, name: str = "total_visits") -> DataFrame:
    """Rows with a user per page, of all events or of one; a null page is a page."""
    rows = events if event is None else events.filter(F.col("event_name") == event)
    return rows.groupBy("page_location").agg(F.count("user_pseudo_id").alias(name))


def _largest(counts: DataFrame, name: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc(name), "page_location").limit(k)


def _merged_spellings(counts: DataFrame, name: str) -> DataFrame:
    """Counts per normalized page; the text work is done once per page, not once per event."""
    page = normalized_page("page_location").alias("page_location")
    return counts.groupBy(page).agg(F.sum(name).alias(name))


def top_pages(events: DataFrame, k: int = 10, normalize: bool = False) -> DataFrame:
    """The ``k`` most visited pages; equal counts go by page."""
    counts = page_counts(events)
    if normalize:
        counts = _merged_spellings(counts, "total_visits")
    return _largest(counts, "total_visits", k)


def entry_pages(events: DataFrame, k: int = 10, normalize: bool = False) -> DataFrame:
    """The ``k`` pages on which most sessions start."""
    name = "sessions_entering_here"
    counts = page_counts(events, S.ENTRY_EVENT, name)
    if normalize:
        counts = _merged_spellings(counts, name)
    return _largest(counts, name, k)


def _ranks(long: DataFrame) -> DataFrame:
    """(kind, n, rank) of each distinct count ``n`` of the rows of a kind, the highest first.

    Counts are cut into cells by their leading ``CELL_BITS`` bits, so that a window never holds all of them: one runs within each
    cell, and one over the cells, of which a kind has under ``64 * 2 ** CELL_BITS`` whatever the counts.
    """
    pages = long.groupBy("kind", "n").agg(F.count(F.lit(1)).alias("pages"))
    bits = "length(bin(n))"
    cell = F.expr(f"{bits} * {2**CELL_BITS} + shiftright(n, greatest({bits} - {CELL_BITS}, 0))")
    pages = pages.withColumn("cell", cell)
    before = Window.unboundedPreceding, -1
    within = Window.partitionBy("kind", "cell").orderBy(F.desc("n")).rowsBetween(*before)
    across = Window.partitionBy("kind").orderBy(F.desc("cell")).rowsBetween(*before)
    cells = pages.groupBy("kind", "cell").agg(F.sum("pages").alias("held"))
    cells = cells.select("kind", "cell", F.coalesce(F.sum("held").over(across), F.lit(0)).alias("far"))
    near = F.coalesce(F.sum("pages").over(within), F.lit(0))
    placed = pages.withColumn("near", near).join(F.broadcast(cells), ["kind", "cell"])
    return placed.select("kind", "n", (F.col("near") + F.col("far") + 1).alias("rank"))


def page_rank_compare(events: DataFrame) -> DataFrame:
    """Every page with its rank among visited pages and among entry pages.

    The entry columns are null for a page on which no session starts.

    A window over all pages would pass through one task. The rank of a count is one more than the
    number of pages with a higher count, so it is enough to rank the distinct counts, see `_ranks`. Most pages share few low
    counts, whose ranks are broadcast: under ``2 * LOW`` rows. Pages with higher counts are few, at most one for ``LOW`` events,
    and are joined by their count. Events are read and shuffled once, as the counts per page serve both the ranking and the result.
    """
    enters = F.col("event_name") == S.ENTRY_EVENT
    counts = events.groupBy("page_location").agg(
        F.count("user_pseudo_id").alias("visits"),
        F.count(F.when(enters, F.col("user_pseudo_id"))).alias("entries"),
        F.count_if(enters).alias("entry_rows"),
    )
    entries = F.when(F.col("entry_rows") > 0, F.col("entries"))
    kinds = F.array(
        F.struct(F.lit("visit").alias("kind"), F.col("visits").alias("n")),
        F.struct(F.lit("entry").alias("kind"), entries.alias("n")),
    )
    long = counts.select("page_location", F.inline(kinds)).filter(F.col("n").isNotNull())
    ranks, low = _ranks(long), F.col("n") < LOW
    of_low = long.filter(low).join(F.broadcast(ranks.filter(low)), ["kind", "n"])
    of_high = long.filter(~low).join(ranks.filter(~low), ["kind", "n"])

    def of_kind(kind: str, column: str):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    return (
        of_low.unionByName(of_high)
        .groupBy("page_location")
        .agg(
            of_kind("visit", "n").alias("total_visits"),
            of_kind("visit", "rank").alias("visit_rank"),
            of_kind("entry", "n").alias("sessions_entering_here"),
            of_kind("entry", "rank").alias("entry_rank"),
        )
        .orderBy("visit_rank", "page_location")
    )
