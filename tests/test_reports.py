"""One tiny table for every corner of the reports' definitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.frames import items, raw, records, rows
from tillpath import schema as S
from tillpath.operators import engagement, pages, products, profile, revenue
from tillpath.operators.funnel import funnel, funnel_matrix
from tillpath.plans import channel_mart as mart
from tillpath.plans.prepare import build_items, build_master, without_attribution


def prepared(spark, *given):
    return without_attribution(raw(spark, *given))


def event(session, name="view_item", **more):
    return {"session_id": session, "event_name": name, **more}


# --- funnel --------------------------------------------------------------------------------------


def test_funnel_counts_a_session_once_per_stage(spark):
    events = prepared(
        spark,
        *[event(1, "session_start"), event(2, "session_start"), event(None, "session_start")],
        *[event(1), event(1), event(1, "purchase")],
    )
    assert rows(funnel(events)) == [
        ("1 - Session Start", 2, None, 100.0),
        ("2 - View Item", 1, 50.0, 50.0),
        ("6 - Purchase", 1, 0.0, 50.0),
    ]


def test_unmapped_events_take_the_top_unless_dropped(spark):
    events = prepared(
        spark, *[event(n, "scroll") for n in range(4)], event(1, "session_start"), event(1, None)
    )
    assert rows(funnel(events)) == [
        (None, 4, None, 100.0),
        ("1 - Session Start", 1, 75.0, 25.0),
    ]
    assert rows(funnel(events, drop_unmapped=True)) == [("1 - Session Start", 1, None, 100.0)]


def test_missing_stages_and_negative_dropoff(spark):
    events = prepared(
        spark,
        *[event(1, "add_to_cart", country="A"), event(1, "purchase", country="A")],
        *[event(2, "session_start", country="B"), event(2, country="B"), event(3, country="B")],
        event(4, "session_start"),
    )
    assert rows(funnel(events, "country")) == [
        (None, "1 - Session Start", 1, None, 100.0),
        ("A", "3 - Add to Cart", 1, None, 100.0),
        ("A", "6 - Purchase", 1, 0.0, 100.0),
        ("B", "1 - Session Start", 1, None, 100.0),
        ("B", "2 - View Item", 2, -100.0, 200.0),
    ]


def test_a_stage_without_any_session_still_shows(spark):
    events = prepared(spark, event(None, "session_start"), event(1))
    assert rows(funnel(events)) == [
        ("1 - Session Start", 0, None, None),
        ("2 - View Item", 1, None, None),
    ]


def test_funnel_with_own_stages_and_compound_key(spark):
    events = prepared(
        spark,
        event(1, "visit", user_pseudo_id=1),
        event(1, "visit", user_pseudo_id=2),
        event(1, "buy", user_pseudo_id=2),
    )
    stages = [("visit", "a"), ("buy", "b")]
    assert rows(funnel(events, stages=stages)) == [("a", 1, None, 100.0), ("b", 1, 0.0, 100.0)]
    by_user = funnel(events, stages=stages, session_key=["user_pseudo_id", "session_id"])
    assert rows(by_user) == [("a", 2, None, 100.0), ("b", 1, 50.0, 50.0)]


def test_empty_tables_give_empty_reports(spark):
    events = prepared(spark)
    sold = build_items(items(spark))
    assert rows(funnel(events)) == []
    assert rows(engagement.bounce_rate(events)) == [(None, 0, None)]
    assert rows(engagement.bounce_rate(events, "country")) == []
    assert rows(engagement.new_vs_returning(events)) == []
    assert rows(revenue.monthly_trend(events)) == []
    assert rows(revenue.kpis_by(events, "device_category")) == []
    assert rows(products.category_share(sold)) == []
    assert rows(pages.page_rank_compare(events)) == []
    assert rows(mart.channel_kpis(mart.session_mart(raw(spark)))) == []
    assert rows(profile.attribution_coverage(raw(spark))) == [(0, 0, None)]


def test_funnel_matrix_has_one_row_per_group(spark):
    events = prepared(
        spark,
        *[event(1, "session_start", country="A"), event(1, country="A")],
        *[event(2, "session_start", country="B"), event(2, "purchase", country="B")],
    )
    found = records(funnel_matrix(funnel(events, "country"), "country"), "country")
    assert found["A"]["view_item_dropoff_pct"] == 0.0
    assert found["A"]["final_cvr_pct"] is None
    assert (found["B"]["purchase_dropoff_pct"], found["B"]["final_cvr_pct"]) == (0.0, 100.0)


# --- sessions shared between groups --------------------------------------------------------------


def test_a_session_on_two_devices_bounces_on_each(spark):
    events = prepared(
        spark, event(1, device_category="desktop"), event(1, device_category="mobile")
    )
    assert rows(engagement.bounce_rate(events)) == [(None, 0, None)]
    assert rows(engagement.bounce_rate(events, "device_category")) == [
        ("desktop", 1, 1, 100.0),
        ("mobile", 1, 1, 100.0),
    ]


def test_a_session_of_two_users_counts_for_both_kinds(spark):
    events = prepared(
        spark,
        event(1, user_pseudo_id=1),
        event(1, "purchase", user_pseudo_id=2, revenue=5.0),
        event(2, user_pseudo_id=2),
    )
    assert rows(engagement.new_vs_returning(events)) == [
        ("New", 1, 0, None, None, 0.0),
        ("Returning", 2, 1, 5.0, 2.5, 50.0),
    ]
    by_user = engagement.new_vs_returning(events, ["user_pseudo_id", "session_id"])
    assert [r[1] for r in rows(by_user)] == [1, 2]


def test_a_purchase_belongs_to_the_user_who_made_it(spark):
    events = prepared(
        spark,
        event(1, "purchase", user_pseudo_id=1, revenue=3.0),
        event(1, user_pseudo_id=2),
        event(2, user_pseudo_id=2),
        event(3, "purchase", user_pseudo_id=None, revenue=9.0),
    )
    assert rows(engagement.new_vs_returning(events)) == [
        ("New", 1, 1, 3.0, 3.0, 100.0),
        ("Returning", 2, 0, None, None, 0.0),
    ]


def test_a_user_without_sessions_is_returning(spark):
    events = prepared(spark, event(None, "purchase", user_pseudo_id=1, revenue=4.0))
    assert rows(engagement.new_vs_returning(events)) == [("Returning", 0, 0, 4.0, None, None)]


def test_user_type_lift(spark):
    report = spark.createDataFrame(
        [("New", 22730, 134, 6546.0, 0.29, 0.59), ("Returning", 5418, 64, 4258.0, 0.79, 1.18)],
        "user_type string, sessions long, purchases long, revenue double, "
        "revenue_per_session double, cvr_pct double",
    )
    assert rows(engagement.user_type_lift(report)) == [
        ("New", 80.75, 60.59, 1.0, 1.0),
        ("Returning", 19.25, 39.41, 2.0, 2.72),
    ]


# --- nulls ---------------------------------------------------------------------------------------


def test_bounce_and_nulls(spark):
    events = prepared(spark, event(None), event(1), event(1, None), event(2), event(2))
    assert rows(engagement.bounce_rate(events)) == [(2, 2, 100.0)]


def test_null_groups_are_no_groups_in_rates_but_are_in_counts(spark):
    given = [event(1, "session_start"), event(1, "purchase", revenue=1.0)]
    events = prepared(spark, *given)
    assert rows(revenue.kpis_by(events, "device_category")) == []
    assert rows(engagement.bounce_rate(events, "country")) == []
    users = [event(1, "session_start", user_pseudo_id=3), event(2, user_pseudo_id=3)]
    assert rows(pages.top_pages(prepared(spark, *users))) == [(None, 2)]
    sold = build_items(items(spark, {"item_name": None}, {"item_category": None}))
    assert rows(products.top_products(sold)) == [(None, 1.0, 1.0, 1), ("hat", 1.0, 1.0, 1)]
    assert [r[0] for r in rows(products.category_revenue(sold))] == ["Hats"]


def test_a_month_without_a_date_is_left_out(spark):
    events = prepared(
        spark,
        event(1, "purchase", revenue=2.0),
        event(2, "purchase", revenue=9.0, event_date=None),
        event(3, event_date="20201201"),
    )
    assert rows(revenue.monthly_trend(events)) == [("2020-11", 1, 1, 2.0, 100.0, 2.0)]


# --- revenue -------------------------------------------------------------------------------------


def test_revenue_outside_purchases(spark):
    events = prepared(
        spark,
        event(1, "purchase", revenue=2.0, device_category="mobile", user_pseudo_id=1),
        event(1, "view_item", revenue=5.0, device_category="mobile", user_pseudo_id=1),
    )
    assert rows(revenue.kpis_by(events, "device_category"))[0][3] == 2.0
    assert rows(revenue.monthly_trend(events))[0][3] == 7.0
    assert rows(engagement.new_vs_returning(events))[0][3] == 7.0


def test_revenue_given_as_text_is_cast_and_bad_text_fails(spark):
    events = prepared(spark, event(1, "purchase", revenue=2.5, device_category="mobile"))
    text = events.withColumn("revenue", F.col("revenue").cast("string"))
    assert rows(revenue.kpis_by(text, "device_category"))[0][3] == 2.5
    bad = events.withColumn("revenue", F.lit("n.a."))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        revenue.kpis_by(bad, "device_category").collect()


def test_a_group_needs_a_purchase_row_and_may_have_no_session(spark):
    events = prepared(
        spark,
        event(1, device_category="tablet"),
        event(None, "purchase", device_category="mobile", revenue=3.0),
        event(2, "purchase", device_category="desktop"),
    )
    assert rows(revenue.kpis_by(events, "device_category")) == [
        ("mobile", 0, 0, 3.0, None, None),
        ("desktop", 1, 1, None, None, 100.0),
    ]


def test_bounce_by_country_keeps_large_countries_lowest_rate_first(spark):
    events = prepared(
        spark,
        *[event(n, country="A") for n in range(3)],
        *[event(n, country="B") for n in (4, 5, 6, 6)],
        event(7, country="C"),
    )
    assert rows(engagement.bounce_rate(events, "country", 3)) == [
        ("B", 3, 2, 66.67),
        ("A", 3, 3, 100.0),
    ]


def test_growth_compares_with_the_month_before_and_the_first(spark):
    trend = spark.createDataFrame(
        [("2020-11", 2188, 0.68), ("2020-12", 8325, 0.64), ("2021-01", 17505, 0.23)],
        "year_month string, total_sessions long, revenue_per_session double",
    )
    last = records(revenue.monthly_growth(trend), "year_month")["2021-01"]
    assert (last["sessions_vs_first"], last["sessions_change_pct"]) == (8.0, 110.27)
    assert (last["rps_vs_first"], last["rps_change_pct"]) == (0.34, -64.06)


def test_ratio_between_channels(spark):
    report = spark.createDataFrame(
        [("Referral", 21.90), ("Google Paid", 1.54)], "channel string, revenue_per_session double"
    )
    assert rows(revenue.rps_ratio(report)) == [
        ("Referral", 21.9, 14.22),
        ("Google Paid", 1.54, 1.0),
    ]
    named = revenue.rps_ratio(report, baseline="Referral")
    assert [r[2] for r in rows(named)] == [1.0, 0.07]


# --- products ------------------------------------------------------------------------------------


def test_orders_are_item_rows_with_a_session(spark):
    sold = build_items(items(spark, {}, {}, {}, {"session_id": None}))
    assert rows(products.top_products(sold)) == [("hat", 4.0, 4.0, 3)]
    assert rows(products.category_revenue(sold)) == [("Hats", 4.0, 4.0, 3, 1.33)]


def test_several_purchase_rows_multiply_items_unless_deduplicated(spark):
    google = {"source": "google", "medium": "cpc"}
    events = raw(spark, event(1, "purchase", **google), event(1, "purchase"), event(1))
    sold = build_items(items(spark, {"item_revenue": 2.0}, {"item_revenue": 3.0}))
    master, sessions = build_master(events), mart.session_mart(events)
    double = [("Google Paid", "Hats", 10.0, 4)]
    assert rows(products.channel_category(sold, master)) == double
    assert rows(mart.channel_items(sold, sessions)) == double
    single = [("Google Paid", "Hats", 5.0, 2)]
    assert rows(products.channel_category(sold, master, dedup=True)) == single
    assert rows(mart.channel_items(sold, sessions, dedup=True)) == single


def test_ties_for_the_top_product_all_stay(spark):
    sold = build_items(
        items(
            spark,
            *[{"item_name": "a"}, {"item_name": "b"}, {"item_name": "c", "item_revenue": 0.5}],
            {"item_name": "d", "item_category": "(not set)", "item_revenue": 9.0},
        )
    )
    found = rows(products.top_product_per_category(sold))
    assert found == [("Hats", "a", 1.0), ("Hats", "b", 1.0)]


def test_category_change_spans_first_and_last_month(spark):
    sold = build_items(
        items(
            spark,
            {"event_date": "20201101", "item_revenue": 75070.0},
            {"event_date": "20201201", "item_revenue": 66962.0},
            {"event_date": "20210101", "item_revenue": 29695.0},
        )
    )
    found = ("Hats", "2020-11", "2021-01", 75070.0, 29695.0, -60.44)
    assert rows(products.category_change(sold)) == [found]


def test_pairs_without_sales(spark):
    google = {"source": "google", "medium": "cpc"}
    fb = {"source": "fb", "medium": "referral"}
    events = raw(
        spark,
        event(1, "purchase", **google),
        event(2, **fb),
        event(3, source="<Other>"),
        event(4),
    )
    sold = build_items(items(spark, {}, {"session_id": 9, "item_category": "Mugs"}))
    master = build_master(events)
    report = products.channel_category(sold, master)
    assert rows(products.missing_channel_category(report, sold, master)) == [
        ("Google Paid", "Mugs"),
        ("Referral", "Hats"),
        ("Referral", "Mugs"),
    ]


# --- pages ---------------------------------------------------------------------------------------


def test_ties_at_the_limit_go_by_page(spark):
    events = prepared(
        spark,
        *[event(1, user_pseudo_id=1, page_location=f"p{n:02}") for n in reversed(range(11))],
    )
    assert [r[0] for r in rows(pages.top_pages(events))] == [f"p{n:02}" for n in range(10)]
    assert len(rows(pages.top_pages(events, k=11))) == 11


def test_page_ranks_share_ties_and_stay_null_without_entries(spark):
    start = "session_start"
    events = prepared(
        spark,
        *[event(1, start, user_pseudo_id=1, page_location="home") for _ in range(3)],
        *[event(1, user_pseudo_id=1, page_location="hats") for _ in range(3)],
        event(1, start, user_pseudo_id=1, page_location="mugs"),
        event(1, start, user_pseudo_id=None, page_location="mugs"),
        event(1, start, user_pseudo_id=None, page_location="nobody"),
    )
    assert rows(pages.page_rank_compare(events)) == [
        ("hats", 3, 1, None, None),
        ("home", 3, 1, 3, 1),
        ("mugs", 1, 3, 1, 2),
        ("nobody", 0, 4, 0, 3),
    ]


def test_spellings_of_a_page_count_together(spark):
    urls = ["https://shop.x.com/", "http://www.x.com", "https://x.com/?a=1", "https://x.com/b"]
    events = prepared(spark, *[event(1, user_pseudo_id=1, page_location=u) for u in urls])
    assert rows(pages.top_pages(events, normalize=True)) == [("x.com", 3), ("x.com/b", 1)]
    starts = events.withColumn("event_name", F.lit("session_start"))
    assert rows(pages.entry_pages(starts, normalize=True)) == [("x.com", 3), ("x.com/b", 1)]


# --- profiles ------------------------------------------------------------------------------------


def test_profiles(spark):
    events = raw(
        spark,
        event(1, "purchase", source="google"),
        event(1, "purchase"),
        event(2, "session_start"),
        event(None, None, source="fb"),
    )
    assert rows(profile.value_counts(events, "event_name")) == [
        ("purchase", 2),
        ("session_start", 1),
    ]
    assert rows(profile.value_counts(events, "source", "purchase")) == [("google", 1)]
    assert rows(profile.attribution_coverage(events)) == [(1, 2, 50.0)]
    assert rows(profile.coverage_by_event(events)) == [
        (None, 1, 1, 100.0),
        ("purchase", 2, 1, 50.0),
        ("session_start", 1, 0, 0.0),
    ]
    nulls = records(profile.null_profile(events), "column_name")
    assert nulls["source"] == {
        "column_name": "source",
        "n_rows": 4,
        "n_non_null": 2,
        "coverage_pct": 50.0,
    }
    shapes = rows(profile.table_shapes({"b": events, "a": events.limit(1)}))
    assert shapes == [("a", 1, 12), ("b", 4, 12)]


# --- the session mart gives what master events give ----------------------------------------------


def test_mart_reports_equal_event_level_reports(spark):
    given = [
        event(
            [1, 2, 3, 4, None][n % 5],
            [e for e, _ in S.STAGES][n % 6],
            source=[None, "google", "fb", None][n % 4],
            medium=[None, "cpc", "organic"][n % 3],
            revenue=float(n) if n % 6 == 5 else None,
        )
        for n in range(60)
    ]
    events = raw(spark, *given)
    master, sessions = build_master(events), mart.session_mart(events)
    sold = build_items(items(spark, *[{"session_id": n % 4} for n in range(9)]))
    pairs = [
        (mart.channel_kpis(sessions), revenue.kpis_by(master, "channel", S.UNRELIABLE_CHANNELS)),
        (mart.channel_funnel(sessions), funnel(master, "channel")),
        (mart.channel_bounce(sessions), engagement.bounce_rate(master, "channel")),
        (mart.row_counts(sessions, "channel"), profile.value_counts(master, "channel")),
        (
            mart.row_counts(sessions, "session_source"),
            profile.value_counts(master, "session_source"),
        ),
        (
            mart.row_counts(sessions, "channel", "purchase_rows"),
            profile.value_counts(master, "channel", "purchase"),
        ),
        (mart.channel_items(sold, sessions), products.channel_category(sold, master)),
    ]
    for ours, theirs in pairs:
        assert ours.columns == theirs.columns
        assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("low, cell_bits", [(1 << 16, 10), (3, 2), (1, 1), (1000, 3)])
def test_page_ranks_do_not_depend_on_cells(spark, monkeypatch, low, cell_bits):
    monkeypatch.setattr(pages, "LOW", low)
    monkeypatch.setattr(pages, "CELL_BITS", cell_bits)
    visits = {f"p{i:02}": (i * i) % 37 for i in range(40)}
    data = [{"page_location": p, "event_name": "session_start" if k % 3 else "view_item"} for p, n in visits.items() for k in range(n)]
    found = pages.page_rank_compare(raw(spark, *({"user_pseudo_id": 1} | d for d in data))).collect()
    enter = {p: sum(k % 3 > 0 for k in range(n)) for p, n in visits.items()}
    rank = lambda counts, p: 1 + sum(n > counts[p] for n in counts.values())
    seen = {p for p, n in visits.items() if n}
    entered = {p: n for p, n in enter.items() if n}
    assert {r["page_location"] for r in found} == seen
    for r in found:
        page = r["page_location"]
        assert (r["total_visits"], r["visit_rank"]) == (visits[page], rank(visits, page))
        want = (entered[page], rank(entered, page)) if page in entered else (None, None)
        assert (r["sessions_entering_here"], r["entry_rank"]) == want
