"""Products and categories: revenue, quantity, shares, trends and channels.

"Orders" counts item rows with a session id, as one purchase of three items has three rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpath import schema as S
from tillpath.functions import month_label, month_start, pct_of, per_unit


def with_category(items: DataFrame) -> DataFrame:
    """Items whose category is present and not a placeholder."""
    category = F.col("item_category")
    return items.filter(category.isNotNull() & ~category.isin(*S.EMPTY_CATEGORIES))


def _totals(orders: bool = True) -> list:
    out = [
        F.sum("item_revenue").alias("total_revenue"),
        F.sum("quantity").alias("total_quantity"),
    ]
    return [*out, F.count("session_id").alias("no_of_orders")] if orders else out


def top_products(items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` products with the highest revenue; equal revenues go by name."""
    totals = items.groupBy("item_name").agg(*_totals())
    return totals.orderBy(F.desc("total_revenue"), "item_name").limit(k)


def category_revenue(items: DataFrame) -> DataFrame:
    """Revenue, quantity, orders and revenue per order of each category."""
    totals = with_category(items).groupBy("item_category").agg(*_totals())
    aov = per_unit(F.col("total_revenue"), F.col("no_of_orders"), 2).alias("aov")
    return totals.select("*", aov).orderBy(F.desc("total_revenue"), "item_category")


def top_per_group(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows with the highest ``metric`` of their group; ties all stay.

    The rank limit is applied before the shuffle too, so a group sends its best rows only.
    """
    best_first = Window.partitionBy(group).orderBy(F.desc(metric))
    return df.withColumn("rank", F.rank().over(best_first)).filter("rank = 1").drop("rank")


def top_product_per_category(items: DataFrame) -> DataFrame:
    """The best-selling product of each category by revenue."""
    revenue = (
        with_category(items)
        .groupBy("item_category", "item_name")
        .agg(F.sum("item_revenue").alias("total_revenue"))
    )
    return top_per_group(revenue, "item_category", "total_revenue").orderBy(
        F.desc("total_revenue"), "item_category", "item_name"
    )


def category_monthly(items: DataFrame) -> DataFrame:
    """Revenue and quantity of each category and month."""
    return (
        with_category(items)
        .groupBy(month_start("event_date").alias("month"), "item_category")
        .agg(*_totals(orders=False))
        .select(
            month_label("month").alias("year_month"),
            "item_category",
            "total_revenue",
            "total_quantity",
        )
        .orderBy("year_month", F.desc("total_revenue"), "item_category")
    )


def purchases_per_session(events: DataFrame) -> DataFrame:
    """Number of purchase rows of each session and channel."""
    return (
        events.filter(F.col("event_name") == S.PURCHASE_EVENT)
        .filter(F.col("session_id").isNotNull())
        .groupBy("session_id", "channel")
        .agg(F.count(F.lit(1)).alias("purchase_rows"))
    )


def sold_per_session(items: DataFrame) -> DataFrame:
    """Revenue and item rows of each session and category."""
    return (
        with_category(items)
        .filter(F.col("session_id").isNotNull())
        .groupBy("session_id", "item_category")
        .agg(F.sum("item_revenue").alias("revenue"), F.count(F.lit(1)).alias("item_rows"))
    )


def channel_category_of_purchases(
    items: DataFrame, purchases: DataFrame, dedup: bool = False, ordered: bool = True
) -> DataFrame:
    """`channel_category` on purchase rows already counted per session and channel.

    Every item row of a session meets every purchase row of it. Both sides are therefore summed
    per session first and the sums multiplied, which gives the totals of all pairs without
    building them. ``ordered=False`` spares the sort for a report that is built on top.
    """
    return channel_category_of_sold(sold_per_session(items), purchases, dedup, ordered)


def channel_category_of_sold(
    sold: DataFrame, purchases: DataFrame, dedup: bool = False, ordered: bool = True
) -> DataFrame:
    """The same on items already summed as in `sold_per_session`."""
    times = F.lit(1) if dedup else F.col("purchase_rows")
    reliable = purchases.filter(~F.col("channel").isin(*S.UNRELIABLE_CHANNELS))
    report = (
        sold.join(reliable, "session_id")
        .groupBy("channel", "item_category")
        .agg(
            F.round(F.sum(F.col("revenue") * times), 2).alias("total_revenue"),
            F.sum(F.col("item_rows") * times).alias("orders"),
        )
    )
    if not ordered:
        return report
    return report.orderBy("channel", F.desc("total_revenue"), "item_category")


def channel_category(items: DataFrame, events: DataFrame, dedup: bool = False) -> DataFrame:
    """Revenue and orders of each channel and category, joined on the session.

    A session with several purchase rows counts its items once per purchase row; ``dedup`` counts
    them once.
    """
    return channel_category_of_purchases(items, purchases_per_session(events), dedup)


def category_share(items: DataFrame) -> DataFrame:
    """Each category's share of the revenue of all categories."""
    revenue = (
        with_category(items)
        .groupBy("item_category")
        .agg(F.sum("item_revenue").alias("total_revenue"))
    )
    whole = revenue.agg(F.sum("total_revenue").alias("whole"))
    share = pct_of(F.col("total_revenue"), whole.scalar(), 2).alias("share_pct")
    return revenue.select("*", share).orderBy(F.desc("total_revenue"), "item_category")


def category_change(items: DataFrame) -> DataFrame:
    """Revenue of each category in its first and last month, and the change between them."""
    dated = with_category(items).filter(F.col("event_date").isNotNull())
    first, last = F.col("first_revenue"), F.col("last_revenue")
    return (
        dated.groupBy("item_category", month_start("event_date").alias("month"))
        .agg(F.sum("item_revenue").alias("revenue"))
        .groupBy("item_category")
        .agg(
            F.min("month").alias("first_month"),
            F.max("month").alias("last_month"),
            F.min_by("revenue", "month").alias("first_revenue"),
            F.max_by("revenue", "month").alias("last_revenue"),
        )
        .select(
            "item_category",
            month_label("first_month").alias("first_month"),
            month_label("last_month").alias("last_month"),
            "first_revenue",
            "last_revenue",
            pct_of(last - first, first, 2).alias("change_pct"),
        )
        .orderBy("item_category")
    )


def category_vs_sessions(by_month: DataFrame, trend: DataFrame) -> DataFrame:
    """Category revenue of a month beside all sessions of that month.

    Takes the `category_monthly` and `monthly_trend` reports; the latter has one row per calendar
    month, which bounds the broadcast.
    """
    sessions = trend.select("year_month", "total_sessions")
    return (
        by_month.select("year_month", "item_category", "total_revenue")
        .join(F.broadcast(sessions), "year_month")
        .orderBy("year_month", F.desc("total_revenue"), "item_category")
    )


def channel_category_aov(report: DataFrame) -> DataFrame:
    """Revenue per order of a `channel_category` report."""
    aov = per_unit(F.col("total_revenue"), F.col("orders"), 2).alias("aov")
    return report.select("*", aov).orderBy("channel", F.desc("aov"), "item_category")


def top_category_per_channel(report: DataFrame) -> DataFrame:
    """The category with the highest revenue in each channel of a `channel_category` report."""
    return top_per_group(report, "channel", "total_revenue").orderBy("channel", "item_category")


def missing_channel_category(
    report: DataFrame, items: DataFrame, channels: DataFrame
) -> DataFrame:
    """Pairs of a reliable channel and a category without any sale.

    ``channels`` holds the channels that occur. Where it has the purchase rows that ``report`` reads
    too, it reads them as well, so that both come from one shuffle. There are eight labels at
    most, so they travel as one array to each category; the pairs in ``report`` are then taken away.
    """
    reliable = channels.filter(~F.col("channel").isin(*S.UNRELIABLE_CHANNELS))
    occurring = F.col("channel")
    if "purchase_rows" in channels.columns:
        occurring = F.when(F.col("purchase_rows") >= 0, occurring)
    labels = reliable.agg(F.array_sort(F.collect_set(occurring)).alias("labels"))
    categories = with_category(items).select("item_category").distinct()
    pairs = categories.select(F.explode(labels.scalar()).alias("channel"), "item_category")
    return pairs.join(report, ["channel", "item_category"], "left_anti").orderBy(
        "channel", "item_category"
    )
