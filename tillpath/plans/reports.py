"""Every report by name, as a function of the shop's tables.

Reports without a channel read ``events``, those per channel read ``sessions``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from tillpath import schema as S
from tillpath.operators import engagement, pages, products, profile, revenue
from tillpath.operators.attribution import (
    attribute_sessions,
    attributed_rows,
    fill_missing,
    group_channels,
)
from tillpath.operators.funnel import funnel, funnel_matrix
from tillpath.plans import channel_mart as mart
from tillpath.plans.tables import Tables

Report = Callable[[Tables], DataFrame]

COUNTRY_MIN_SESSIONS = 50
PURCHASE_FIRST = (S.PURCHASE_EVENT, "begin_checkout")
USER_SESSION = ("user_pseudo_id", "session_id")


def bounce_by_country(t: Tables, min_sessions: int = COUNTRY_MIN_SESSIONS) -> DataFrame:
    return engagement.bounce_rate(t.events, "country", min_sessions, t.options.session_key)


def channel_category(t: Tables, dedup: bool = False, ordered: bool = True) -> DataFrame:
    return products.channel_category_of_sold(t.sold, t.purchases, dedup, ordered)


def session_attribution(t: Tables) -> DataFrame:
    return attribute_sessions(t.raw_events, t.options.priority, t.options.session_key)


def overall_funnel(t: Tables, drop_unmapped: bool = False) -> DataFrame:
    return funnel(t.events, None, t.options.stages, drop_unmapped, t.options.session_key)


def channel_funnel(t: Tables) -> DataFrame:
    return mart.channel_funnel(t.sessions, t.options.stages)


def device_kpis(
    t: Tables, session_key: Sequence[str] | None = None, ordered: bool = True
) -> DataFrame:
    key = session_key or t.options.session_key
    return revenue.kpis_by(t.events, "device_category", session_key=key, ordered=ordered)


def monthly_trend(t: Tables, ordered: bool = True) -> DataFrame:
    return revenue.monthly_trend(t.events, t.options.session_key, ordered)


def new_vs_returning(t: Tables) -> DataFrame:
    return engagement.new_vs_returning(t.events, t.options.session_key)


def table_shapes(t: Tables) -> DataFrame:
    # Master events have a row for each event; counting those spares the channel join.
    counted = {"master_events": t.events, "items_clean": t.items}
    return profile.table_shapes(counted, {"master_events": len(t.master.columns)})


PREPARATION: dict[str, Report] = {
    "attribution_filter": lambda t: attributed_rows(t.raw_events),
    "session_attribution": session_attribution,
    "session_attribution_purchase_first": lambda t: attribute_sessions(
        t.raw_events, PURCHASE_FIRST, t.options.session_key
    ),
    "channel_grouping": lambda t: group_channels(
        fill_missing(session_attribution(t)), t.options.own_hosts
    ),
    "master_events": lambda t: t.master,
    "items_clean": lambda t: t.items,
    "source_value_counts": lambda t: mart.row_counts(t.sessions, "session_source"),
    "channel_value_counts": lambda t: mart.row_counts(t.sessions, "channel"),
    "purchases_by_channel": lambda t: mart.row_counts(t.sessions, "channel", "purchase_rows"),
    "attribution_coverage": lambda t: profile.attribution_coverage(t.raw_events),
    "table_shapes": table_shapes,
    "null_profile": lambda t: profile.null_profile(t.raw_events),
    "coverage_by_event": lambda t: profile.coverage_by_event(t.raw_events),
}

FUNNELS: dict[str, Report] = {
    "funnel": overall_funnel,
    "funnel_drop_unmapped": lambda t: overall_funnel(t, drop_unmapped=True),
    "funnel_by_channel": channel_funnel,
    "funnel_matrix": lambda t: funnel_matrix(channel_funnel(t), stages=t.options.stages),
}

REVENUE: dict[str, Report] = {
    "channel_attribution": lambda t: mart.channel_kpis(t.sessions),
    "channel_rps_ratio": lambda t: revenue.rps_ratio(mart.channel_kpis(t.sessions)),
    "channel_rps_vs_paid": lambda t: revenue.rps_ratio(
        mart.channel_kpis(t.sessions), baseline=S.GOOGLE_PAID
    ),
    "revenue_by_device": device_kpis,
    "revenue_by_device_user_session": lambda t: device_kpis(t, USER_SESSION),
    "device_share": lambda t: revenue.shares(device_kpis(t, ordered=False), "device_category"),
    "monthly_trend": monthly_trend,
    "monthly_growth": lambda t: revenue.monthly_growth(monthly_trend(t, ordered=False)),
}

ENGAGEMENT: dict[str, Report] = {
    "bounce_overall": lambda t: engagement.bounce_rate(
        t.events, session_key=t.options.session_key
    ),
    "bounce_by_device": lambda t: engagement.bounce_rate(
        t.events, "device_category", session_key=t.options.session_key
    ),
    "bounce_by_country": bounce_by_country,
    "bounce_by_channel": lambda t: mart.channel_bounce(t.sessions),
    "new_vs_returning": new_vs_returning,
    "user_type_lift": lambda t: engagement.user_type_lift(new_vs_returning(t)),
}

PRODUCTS: dict[str, Report] = {
    "top_products": lambda t: products.top_products(t.items),
    "category_revenue": lambda t: products.category_revenue(t.items),
    "top_product_per_category": lambda t: products.top_product_per_category(t.items),
    "category_monthly": lambda t: products.category_monthly(t.items),
    "channel_category": channel_category,
    "channel_category_dedup": lambda t: channel_category(t, dedup=True),
    "category_share": lambda t: products.category_share(t.items),
    "category_change": lambda t: products.category_change(t.items),
    "category_vs_sessions": lambda t: products.category_vs_sessions(
        products.category_monthly(t.items), monthly_trend(t)
    ),
    "channel_category_aov": lambda t: products.channel_category_aov(
        channel_category(t, ordered=False)
    ),
    "top_category_per_channel": lambda t: products.top_category_per_channel(
        channel_category(t, ordered=False)
    ),
    "missing_channel_category": lambda t: products.missing_channel_category(
        channel_category(t, ordered=False), t.items, mart.known_sessions(t.sessions)
    ),
}

PAGES: dict[str, Report] = {
    "top_pages": lambda t: pages.top_pages(t.events),
    "entry_pages": lambda t: pages.entry_pages(t.events),
    "page_rank_compare": lambda t: pages.page_rank_compare(t.events),
    "top_pages_normalized": lambda t: pages.top_pages(t.events, normalize=True),
    "entry_pages_normalized": lambda t: pages.entry_pages(t.events, normalize=True),
}

REPORTS: dict[str, Report] = (
    PREPARATION | FUNNELS | REVENUE | ENGAGEMENT | PRODUCTS | PAGES
)
