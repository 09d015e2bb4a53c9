"""Every report by name, ready to run on a folder of the generic test tables.

Sums of money are rounded to cents here, as their last digits depend on the order in which tasks
add them; the reports themselves leave them exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpath import schema as S
from tillpath.operators.distinct import sketch_errors
from tillpath.operators.products import (
    channel_category_aov,
    channel_category_of_sold,
    top_category_per_channel,
)
from tillpath.plans.growing import GrowingStore
from tillpath.plans.prepare import build_items
from tillpath.plans.reports import REPORTS, USER_SESSION, bounce_by_country
from tillpath.plans.tables import Options, RawTables, StoredSales, StoredTables
from tillpath.sources import (
    accepted,
    land_csv_judged,
    raw_events,
    raw_items,
    read_csv_judged,
    read_csv_table,
    read_table,
    reject_counts,
    scratch_path,
    write_csv_table,
    write_table,
)

Query = Callable[[SparkSession, str], DataFrame]

LARGE_COUNTRY = 160
"""Smallest country of the variant; the test tables' countries are all above the usual 50."""

OWN_HOSTS = ("partner.example.com",)
"""Another shop's own host, for the variant that names it."""

BY_USER = Options(session_key=USER_SESSION)

CENTS = {
    "channel_attribution": ["revenue"],
    "revenue_by_device": ["revenue"],
    "revenue_by_device_user_session": ["revenue"],
    "channel_attribution_user_session": ["revenue"],
    "channel_attribution_own_hosts": ["revenue"],
    "monthly_trend": ["total_revenue"],
    "top_products": ["total_revenue"],
    "category_revenue": ["total_revenue"],
    "top_product_per_category": ["total_revenue"],
    "category_monthly": ["total_revenue"],
    "category_share": ["total_revenue"],
    "category_change": ["first_revenue", "last_revenue"],
    "category_vs_sessions": ["total_revenue"],
}


def tables(
    spark: SparkSession,
    folder: str,
    keep_unmapped: bool = False,
    options: Options | None = None,
) -> RawTables:
    """The raw tables derived from a folder of test tables."""
    return RawTables(raw_events(spark, folder, keep_unmapped), raw_items(spark, folder), options)


def _query(name: str, report: str | None = None, options: Options | None = None) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = REPORTS[report or name](tables(spark, folder, options=options))
        return found.withColumns({c: F.round(c, 2) for c in CENTS.get(name, [])})

    return run


def _on_unmapped(name: str) -> Query:
    return lambda spark, folder: REPORTS[name](tables(spark, folder, keep_unmapped=True))


def csv_roundtrip_events(spark: SparkSession, folder: str) -> DataFrame:
    """Master events written to CSV files and read back."""
    path = scratch_path(spark, "events-csv")
    write_csv_table(tables(spark, folder).master, path)
    return read_csv_table(spark, path, S.MASTER_EVENTS)


def csv_roundtrip_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items written to CSV files and read back."""
    path = scratch_path(spark, "items-csv")
    write_csv_table(tables(spark, folder).items, path)
    return read_csv_table(spark, path, S.ITEMS_CLEAN)


def faulty_item_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a CSV file of items in which sessions that end in 1 to 4 have a fault each."""
    items = tables(spark, folder).raw_items
    line = F.to_csv(F.struct(*S.RAW_ITEMS.names))
    digit = F.pmod("session_id", F.lit(10))
    others = F.to_csv(F.struct("event_date", F.lit("unknown"), *S.RAW_ITEMS.names[2:]))
    undated = F.to_csv(F.struct(F.lit("20201399"), *S.RAW_ITEMS.names[1:]))
    faulty = (
        F.when(digit == 1, F.regexp_replace(line, ",[^,]*$", ""))
        .when(digit == 2, F.concat(line, F.lit(",1")))
        .when(digit == 3, others)
        .when(digit == 4, undated)
    )
    return items.select(F.coalesce(faulty, line).alias("value"))


def _judged_items(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "faulty-items")
    faulty_item_rows(spark, folder).write.text(path)
    judged = read_csv_judged(spark, path, S.RAW_ITEMS, ["event_date"], names=S.RAW_ITEMS.names)
    return land_csv_judged(judged, scratch_path(spark, "judged-items"))


def csv_reject_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of a file with faults are rejected, by reason."""
    return reject_counts(_judged_items(spark, folder))


def csv_accepted_items(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a file with faults that fit."""
    return build_items(accepted(_judged_items(spark, folder)))


def added_in_two_halves(spark: SparkSession, folder: str) -> StoredTables:
    """The tables of a folder, added to a store in two batches that share sessions and months."""
    shop = tables(spark, folder)
    path = scratch_path(spark, "growing")
    store = GrowingStore(spark, path)
    by_event = F.pmod(F.xxhash64("event_id"), F.lit(2))
    by_item = F.pmod(F.xxhash64("session_id", "item_name"), F.lit(2))
    for half in (0, 1):
        events = shop.raw_events.filter(by_event == half)
        store.add(f"half-{half}", events, shop.raw_items.filter(by_item == half))
    return StoredTables(spark, path)


def _growing(report: str) -> Query:
    return lambda spark, folder: REPORTS[report](added_in_two_halves(spark, folder))


def _on_stored_sales(report: Callable[[DataFrame], DataFrame], dedup: bool = False) -> Query:
    """A report on channels and categories from the two bucketed tables, written and read back."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, "sales")
        tables(spark, folder).store_sales(path)
        sales = StoredSales(spark, path)
        return report(channel_category_of_sold(sales.sold, sales.purchases, dedup, ordered=False))

    return run


def _sketch_errors(dimension: str | None = None) -> Query:
    """Sketches written and read back, beside the exact counts from the events."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        shop, path = tables(spark, folder), scratch_path(spark, "sketches")
        write_table(shop.sketches, path)
        return sketch_errors(read_table(spark, path), shop.events, dimension)

    return run


CATALOG: dict[str, Query] = {name: _query(name) for name in REPORTS} | {
    "csv_roundtrip_events": csv_roundtrip_events,
    "csv_roundtrip_items": csv_roundtrip_items,
    "csv_reject_counts": csv_reject_counts,
    "csv_accepted_items": csv_accepted_items,
    "funnel_unmapped": _on_unmapped("funnel"),
    "funnel_drop_unmapped": _on_unmapped("funnel_drop_unmapped"),
    "master_events_incremental": _growing("master_events"),
    "bounce_by_channel_incremental": _growing("bounce_by_channel"),
    "channel_category_stored": _on_stored_sales(lambda found: found),
    "channel_category_aov_stored": _on_stored_sales(channel_category_aov),
    "top_category_per_channel_stored": _on_stored_sales(top_category_per_channel),
    "active_by_range": _sketch_errors(),
    "active_by_range_and_country": _sketch_errors("country"),
    "bounce_by_large_country": lambda spark, folder: bounce_by_country(
        tables(spark, folder), LARGE_COUNTRY
    ),
    "channel_attribution_user_session": _query(
        "channel_attribution_user_session", "channel_attribution", BY_USER
    ),
    "funnel_by_channel_user_session": _query(
        "funnel_by_channel_user_session", "funnel_by_channel", BY_USER
    ),
    "channel_attribution_own_hosts": _query(
        "channel_attribution_own_hosts", "channel_attribution", Options(own_hosts=OWN_HOSTS)
    ),
}
