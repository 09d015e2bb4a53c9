"""The registered reports in plain SQL, written apart from the Spark plans.

Each text derives the shop tables from the test tables with the same fixed rules, then answers its
report in the most direct way: event-level joins, distinct counts and windows, none of the
rollups the Spark side uses. Ratios stay in DOUBLE, and sums of money are rounded to cents.
"""

from __future__ import annotations

FIXTURE = """
WITH parsed AS (
    SELECT event_id, ts, user_id, event_type, value,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           CAST(ts - to_months(CAST((user_id // 2) % 3 AS INTEGER)) AS DATE) AS day
    FROM events
),
named AS (
    SELECT *,
           CASE event_type
               WHEN 'signup' THEN 'session_start'
               WHEN 'view' THEN 'view_item'
               WHEN 'click' THEN CASE WHEN k < 60 THEN 'add_to_cart' ELSE 'begin_checkout' END
               WHEN 'error' THEN 'add_payment_info'
               ELSE event_type
           END AS stage_event
    FROM parsed
),
all_events AS (
    SELECT event_id,
           strftime(day, '%Y%m%d') AS event_date,
           CASE WHEN event_type = 'error' AND coalesce(k, 100) >= 50 THEN 'error'
                ELSE stage_event END AS event_name,
           stage_event,
           user_id * 100 + CASE WHEN user_id % 3 = 0 THEN 0 ELSE day(ts) END AS user_pseudo_id,
           CAST(strftime(day, '%Y%m%d') AS BIGINT) * 1000000 + user_id
               - CASE WHEN user_id % 40 = 1 THEN 1 ELSE 0 END AS session_id,
           CASE WHEN k % 20 = 7 THEN 'tablet' WHEN user_id % 2 = 0 THEN 'desktop'
                ELSE 'mobile' END AS device_category,
           n_name AS country,
           CASE k % 15
               WHEN 0 THEN 'https://shop.example.com/'
               WHEN 1 THEN 'https://example.com/'
               WHEN 2 THEN 'https://www.example.com/'
               ELSE 'https://shop.example.com/p/' || CAST(k % 15 AS VARCHAR)
           END AS page_location,
           CASE WHEN stage_event IS NOT DISTINCT FROM 'session_start' THEN NULL ELSE
               CASE k % 12
                   WHEN 0 THEN 'google' WHEN 1 THEN 'google' WHEN 2 THEN '(direct)'
                   WHEN 3 THEN 'shop.googlemerchandisestore.com'
                   WHEN 4 THEN 'partner.example.com' WHEN 5 THEN '<Other>'
                   WHEN 6 THEN '(data deleted)' WHEN 7 THEN 'newsletter' WHEN 8 THEN 'google'
               END END AS source,
           CASE WHEN stage_event IS NOT DISTINCT FROM 'session_start' THEN NULL ELSE
               CASE k % 12
                   WHEN 0 THEN 'cpc' WHEN 1 THEN 'organic' WHEN 2 THEN '(none)'
                   WHEN 3 THEN 'referral' WHEN 4 THEN 'referral' WHEN 5 THEN '<Other>'
                   WHEN 6 THEN '(data deleted)' WHEN 7 THEN 'email'
               END END AS medium,
           CASE WHEN stage_event IS DISTINCT FROM 'session_start' AND k % 5 = 0
                THEN 'c' || CAST(k AS VARCHAR) END AS campaign,
           CASE WHEN stage_event = 'purchase' THEN value END AS revenue
    FROM named LEFT JOIN nation ON n_nationkey = user_id % 25
),
raw_events AS (
    SELECT * EXCLUDE (stage_event) REPLACE (stage_event AS event_name) FROM all_events
),
raw_items AS (
    SELECT coalesce(e.event_date, strftime(l_shipdate, '%Y%m%d')) AS event_date, e.session_id,
           p_name AS item_name,
           CASE p_size WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN '(not set)'
                ELSE p_type || ' ' || CAST(p_size AS VARCHAR) END AS item_category,
           CAST(floor(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS item_revenue,
           l_quantity AS quantity
    FROM lineitem
    LEFT JOIN raw_events e ON e.event_id = l_orderkey AND e.event_name = 'purchase'
    LEFT JOIN part ON p_partkey = l_partkey
)
"""

SHOP = """
numbered AS (
    SELECT *, coalesce(event_name, '~') || lpad(CAST(event_id AS VARCHAR), 12, '0') AS place
    FROM raw_events
    WHERE source IS NOT NULL AND session_id IS NOT NULL
),
session_origin AS (
    SELECT session_id,
           arg_min(source, place) AS session_source,
           arg_min(medium, place) FILTER (WHERE medium IS NOT NULL) AS session_medium,
           arg_min(campaign, place) FILTER (WHERE campaign IS NOT NULL) AS session_campaign
    FROM numbered
    GROUP BY session_id
),
joined AS (
    SELECT e.event_id,
           CAST(strptime(e.event_date, '%Y%m%d') AS DATE) AS event_date,
           e.event_name, e.user_pseudo_id, e.session_id, e.device_category, e.country,
           e.page_location, e.revenue,
           coalesce(o.session_source, 'unknown') AS session_source,
           coalesce(o.session_medium, 'unknown') AS session_medium,
           o.session_campaign
    FROM raw_events e LEFT JOIN session_origin o ON o.session_id = e.session_id
),
master AS (
    SELECT *,
           CASE
               WHEN session_source = 'unknown' THEN 'Unknown'
               WHEN session_source = 'shop.googlemerchandisestore.com' THEN 'Self-Referral'
               WHEN (session_source, session_medium) = ('google', 'cpc') THEN 'Google Paid'
               WHEN (session_source, session_medium) = ('google', 'organic') THEN 'Google Organic'
               WHEN session_source = '(direct)' OR session_medium = '(none)' THEN 'Direct'
               WHEN session_medium = 'referral' THEN 'Referral'
               WHEN session_source IN ('<Other>', '(data deleted)')
                 OR session_medium IN ('<Other>', '(data deleted)') THEN 'Obfuscated'
               ELSE 'Other'
           END AS channel
    FROM joined
),
items AS (
    SELECT * REPLACE (CAST(strptime(event_date, '%Y%m%d') AS DATE) AS event_date) FROM raw_items
),
shelved AS (
    SELECT * FROM items WHERE coalesce(item_category, '') NOT IN ('', '(not set)')
),
stages(event_name, funnel_stage) AS (
    VALUES ('session_start', '1 - Session Start'),
           ('view_item', '2 - View Item'),
           ('add_to_cart', '3 - Add to Cart'),
           ('begin_checkout', '4 - Begin Checkout'),
           ('add_payment_info', '5 - Add Payment Info'),
           ('purchase', '6 - Purchase')
)
"""


def complete(body: str, fixture: str = FIXTURE) -> str:
    """One statement from the raw tables to the report.

    ``body`` continues the list of common tables or is the final SELECT.
    """
    joint = "" if body.lstrip().upper().startswith("SELECT") else ","
    return f"{fixture.strip()},\n{SHOP.strip()}{joint}\n{body.strip()}"


def _funnel(table: str, by: str = "", unmapped: bool = True) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    join = "LEFT JOIN" if unmapped else "JOIN"
    return f"""
reached AS (
    SELECT {keys}funnel_stage, count(DISTINCT session_id) AS sessions
    FROM {table} {join} stages USING (event_name)
    GROUP BY ALL
),
compared AS (
    SELECT *, lag(sessions) OVER w AS before, first_value(sessions) OVER w AS top
    FROM reached
    WINDOW w AS ({part}ORDER BY funnel_stage NULLS FIRST)
),
report AS (
    SELECT {keys}funnel_stage, sessions,
           round((before - sessions) * CAST(100 AS DOUBLE) / nullif(before, 0), 1) AS dropoff_pct,
           round(sessions * CAST(100 AS DOUBLE) / nullif(top, 0), 1) AS cvr_from_top_pct
    FROM compared
)"""


def _kpis(by: str, session: str = "session_id", where: str = "TRUE") -> str:
    return f"""
report AS (
    SELECT {by},
           count(DISTINCT {session}) AS sessions,
           count(DISTINCT {session}) FILTER (WHERE event_name = 'purchase') AS purchase,
           sum(revenue) FILTER (WHERE event_name = 'purchase') AS revenue
    FROM master
    WHERE {by} IS NOT NULL AND {where}
    GROUP BY {by}
    HAVING bool_or(event_name = 'purchase')
),
rated AS (
    SELECT {by}, sessions, purchase, round(revenue, 2) AS revenue,
           round(revenue / nullif(sessions, 0), 2) AS revenue_per_session,
           round(purchase * CAST(100 AS DOUBLE) / nullif(sessions, 0), 1) AS cvr_pct
    FROM report
)"""


USER_SESSION = """CASE WHEN user_pseudo_id IS NOT NULL AND session_id IS NOT NULL
                               THEN (user_pseudo_id, session_id) END"""

# Master events whose channel is that of the user's own session.
USER_MASTER = """
user_origin AS (
    SELECT user_pseudo_id, session_id,
           arg_min(source, place) AS source,
           arg_min(medium, place) FILTER (WHERE medium IS NOT NULL) AS medium
    FROM numbered WHERE user_pseudo_id IS NOT NULL
    GROUP BY user_pseudo_id, session_id
),
user_joined AS (
    SELECT e.* EXCLUDE (session_source, session_medium, channel),
           coalesce(o.source, 'unknown') AS session_source,
           coalesce(o.medium, 'unknown') AS session_medium
    FROM master e LEFT JOIN user_origin o
      ON o.session_id = e.session_id AND o.user_pseudo_id = e.user_pseudo_id
),
user_master AS (
    SELECT *,
           CASE
               WHEN session_source = 'unknown' THEN 'Unknown'
               WHEN session_source = 'shop.googlemerchandisestore.com' THEN 'Self-Referral'
               WHEN session_source = 'google' AND session_medium = 'cpc' THEN 'Google Paid'
               WHEN session_source = 'google' AND session_medium = 'organic'
                   THEN 'Google Organic'
               WHEN session_source = '(direct)' OR session_medium = '(none)' THEN 'Direct'
               WHEN session_medium = 'referral' THEN 'Referral'
               WHEN session_source IN ('<Other>', '(data deleted)')
                 OR session_medium IN ('<Other>', '(data deleted)') THEN 'Obfuscated'
               ELSE 'Other'
           END AS channel
    FROM user_joined
),"""

RELIABLE = "channel NOT IN ('Unknown', 'Obfuscated')"


def _bounce(by: str, having: str = "TRUE") -> str:
    return f"""
single AS (
    SELECT session_id, {by} FROM master GROUP BY session_id, {by} HAVING count(event_name) = 1
),
visits AS (
    SELECT {by}, count(DISTINCT session_id) AS total_sessions FROM master GROUP BY {by}
)
SELECT v.{by}, v.total_sessions, count(*) AS bounced_sessions,
       round(count(*) / CAST(nullif(v.total_sessions, 0) AS DOUBLE) * 100, 2) AS bounce_rate_pct
FROM single s JOIN visits v ON s.{by} = v.{by}
WHERE {having}
GROUP BY v.{by}, v.total_sessions"""


MONTHS = """
months AS (
    SELECT strftime(event_date, '%Y-%m') AS year_month,
           count(DISTINCT session_id) FILTER (WHERE event_name = 'purchase') AS purchase_sessions,
           count(DISTINCT session_id) AS total_sessions,
           sum(revenue) AS total_revenue
    FROM master
    WHERE event_date IS NOT NULL
    GROUP BY 1
    HAVING bool_or(event_name = 'purchase')
),
trend AS (
    SELECT year_month, purchase_sessions, total_sessions, round(total_revenue, 2) AS total_revenue,
           round(purchase_sessions / CAST(total_sessions AS DOUBLE) * 100, 2) AS cvr_pct,
           round(total_revenue / total_sessions, 2) AS revenue_per_session
    FROM months
)"""

def _active_by_range(value: str = "CAST(NULL AS VARCHAR)") -> str:
    """Exact counts; the sketched ones have to be within their bound."""
    return f"""
dated AS (
    SELECT strftime(event_date, '%Y-%m') AS month, {value} AS value, session_id, user_pseudo_id
    FROM master WHERE event_date IS NOT NULL
),
months AS (SELECT DISTINCT month FROM dated),
ranges AS (
    SELECT a.month AS first_month, b.month AS last_month FROM months a JOIN months b ON a.month <= b.month
)
SELECT first_month, last_month, value, count(DISTINCT session_id) AS exact_sessions,
       count(DISTINCT user_pseudo_id) AS exact_users,
       TRUE AS sessions_within_bound, TRUE AS users_within_bound
FROM ranges JOIN dated ON month BETWEEN first_month AND last_month
GROUP BY first_month, last_month, value"""


USERS = """
labels AS (
    SELECT user_pseudo_id,
           CASE WHEN count(DISTINCT session_id) = 1 THEN 'New' ELSE 'Returning' END AS user_type
    FROM master WHERE user_pseudo_id IS NOT NULL GROUP BY user_pseudo_id
),
kinds AS (
    SELECT user_type, count(DISTINCT session_id) AS sessions,
           count(DISTINCT session_id) FILTER (WHERE event_name = 'purchase') AS purchases,
           sum(revenue) AS revenue
    FROM master JOIN labels USING (user_pseudo_id)
    GROUP BY user_type
),
report AS (
    SELECT user_type, sessions, purchases, round(revenue, 2) AS revenue,
           round(revenue / nullif(sessions, 0), 2) AS revenue_per_session,
           round(purchases * CAST(100 AS DOUBLE) / nullif(sessions, 0), 2) AS cvr_pct
    FROM kinds
)"""


def _channel_category(distinct: str = "") -> str:
    return f"""
buys AS (
    SELECT {distinct} session_id, channel FROM master WHERE event_name = 'purchase' AND {RELIABLE}
),
report AS (
    SELECT channel, item_category, round(sum(item_revenue), 2) AS total_revenue,
           count(*) AS orders
    FROM shelved JOIN buys USING (session_id)
    GROUP BY channel, item_category
)"""


CATEGORY_MONTHS = """
by_month AS (
    SELECT strftime(event_date, '%Y-%m') AS year_month, item_category,
           sum(item_revenue) AS revenue, sum(quantity) AS total_quantity
    FROM shelved GROUP BY 1, 2
)"""


def _pages(name: str, where: str = "TRUE", normalize: bool = False) -> str:
    page = "page_location"
    if normalize:
        page = r"""regexp_replace(
            regexp_replace(
                lower(regexp_extract(page_location, '^[^:]+://([^/?#]*)', 1)), '^(www|shop)\.', '')
            || regexp_extract(page_location, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '')"""
    return f"""
SELECT {page} AS page_location, count(user_pseudo_id) AS {name}
FROM master WHERE {where}
GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10"""


EVENT_COLUMNS = (
    "event_id event_date event_name user_pseudo_id session_id device_category country "
    "page_location source medium campaign revenue"
).split()

ENTRY = "event_name = 'session_start'"

BODIES: dict[str, str] = {
    "csv_roundtrip_events": "SELECT * FROM master",
    "csv_roundtrip_items": """
        SELECT event_date, session_id, item_name, nullif(item_category, '') AS item_category,
               item_revenue, quantity
        FROM items""",
    "csv_reject_counts": """
        SELECT CASE session_id % 10 WHEN 1 THEN 'too few fields' WHEN 2 THEN 'too many fields'
                    WHEN 3 THEN 'session_id isn''t bigint' ELSE 'event_date isn''t a day' END AS reason,
               count(*) AS n_rows
        FROM raw_items WHERE session_id % 10 BETWEEN 1 AND 4 GROUP BY 1""",
    "csv_accepted_items": """
        SELECT event_date, session_id, item_name, nullif(item_category, '') AS item_category,
               item_revenue, quantity
        FROM items WHERE coalesce(session_id % 10, 0) NOT BETWEEN 1 AND 4""",
    "items_clean": "SELECT * FROM items",
    "attribution_filter": "SELECT * FROM raw_events WHERE source IS NOT NULL",
    "session_attribution": "SELECT * FROM session_origin",
    "session_attribution_purchase_first": """
        placed AS (
            SELECT *, CASE event_name WHEN 'purchase' THEN 0 WHEN 'begin_checkout' THEN 1 ELSE 2 END
                      * 1000000000000 + event_id AS slot
            FROM raw_events WHERE source IS NOT NULL AND session_id IS NOT NULL
        )
        SELECT session_id,
               arg_min(source, slot) AS session_source,
               arg_min(medium, slot) FILTER (WHERE medium IS NOT NULL) AS session_medium,
               arg_min(campaign, slot) FILTER (WHERE campaign IS NOT NULL) AS session_campaign
        FROM placed GROUP BY session_id""",
    "master_events": "SELECT * FROM master",
    "master_events_incremental": "SELECT * FROM master",
    "channel_grouping": """
        SELECT DISTINCT session_id, session_source, session_medium, session_campaign, channel
        FROM master
        WHERE session_id IN (SELECT session_id FROM raw_events WHERE source IS NOT NULL)""",
    "source_value_counts": "SELECT session_source, count(*) AS n FROM master GROUP BY 1",
    "channel_value_counts": "SELECT channel, count(*) AS n FROM master GROUP BY 1",
    "purchases_by_channel": """
        SELECT channel, count(*) AS n FROM master WHERE event_name = 'purchase' GROUP BY 1""",
    "attribution_coverage": """
        SELECT count(DISTINCT session_id) FILTER (WHERE source IS NOT NULL) AS attributed_sessions,
               count(DISTINCT session_id) AS total_sessions,
               round(count(DISTINCT session_id) FILTER (WHERE source IS NOT NULL)
                     * CAST(100 AS DOUBLE) / count(DISTINCT session_id), 2) AS coverage_pct
        FROM raw_events""",
    "table_shapes": """
        SELECT 'master_events' AS table_name, (SELECT count(*) FROM master) AS n_rows,
               CAST(13 AS INTEGER) AS n_columns
        UNION ALL
        SELECT 'items_clean', (SELECT count(*) FROM items), CAST(6 AS INTEGER)""",
    "null_profile": "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_non_null, "
        f"round(count({c}) * CAST(100 AS DOUBLE) / count(*), 2) AS coverage_pct FROM raw_events"
        for c in EVENT_COLUMNS
    )
    + ")",
    "coverage_by_event": """
        SELECT event_name, count(*) AS n_rows, count(source) AS rows_with_source,
               round(count(source) * CAST(100 AS DOUBLE) / count(*), 2) AS coverage_pct
        FROM raw_events GROUP BY event_name""",
    "funnel": _funnel("master") + "\nSELECT * FROM report",
    "funnel_unmapped": _funnel("all_events") + "\nSELECT * FROM report",
    "funnel_drop_unmapped": _funnel("all_events", unmapped=False) + "\nSELECT * FROM report",
    "funnel_by_channel": _funnel("master", "channel") + "\nSELECT * FROM report",
    "funnel_matrix": _funnel("master", "channel")
    + """
        SELECT channel,
               max(dropoff_pct) FILTER (WHERE funnel_stage[1] = '2') AS view_item_dropoff_pct,
               max(dropoff_pct) FILTER (WHERE funnel_stage[1] = '3') AS add_to_cart_dropoff_pct,
               max(dropoff_pct) FILTER (WHERE funnel_stage[1] = '4') AS begin_checkout_dropoff_pct,
               max(dropoff_pct) FILTER (WHERE funnel_stage[1] = '5')
                   AS add_payment_info_dropoff_pct,
               max(dropoff_pct) FILTER (WHERE funnel_stage[1] = '6') AS purchase_dropoff_pct,
               max(cvr_from_top_pct) FILTER (WHERE funnel_stage[1] = '6') AS final_cvr_pct
        FROM report GROUP BY channel""",
    "channel_attribution": _kpis("channel", where=RELIABLE) + "\nSELECT * FROM rated",
    "channel_attribution_own_hosts": """
        regrouped AS (
            SELECT * REPLACE (CASE
                WHEN session_source = 'partner.example.com' THEN 'Self-Referral'
                WHEN session_source = 'shop.googlemerchandisestore.com'
                    THEN CASE WHEN session_medium = '(none)' THEN 'Direct'
                              WHEN session_medium = 'referral' THEN 'Referral'
                              WHEN session_medium IN ('<Other>', '(data deleted)')
                                  THEN 'Obfuscated' ELSE 'Other' END
                ELSE channel END AS channel)
            FROM master
        ),"""
    + _kpis("channel", where=RELIABLE).replace("FROM master", "FROM regrouped")
    + "\nSELECT * FROM rated",
    "channel_attribution_user_session": USER_MASTER
    + _kpis("channel", USER_SESSION, RELIABLE).replace("FROM master", "FROM user_master")
    + "\nSELECT * FROM rated",
    "funnel_by_channel_user_session": USER_MASTER
    + _funnel("user_master", "channel").replace("DISTINCT session_id", f"DISTINCT {USER_SESSION}")
    + "\nSELECT * FROM report",
    "channel_rps_ratio": _kpis("channel", where=RELIABLE)
    + """
        SELECT channel, revenue_per_session,
               round(revenue_per_session / min(revenue_per_session) OVER (), 2) AS rps_ratio
        FROM rated""",
    "channel_rps_vs_paid": _kpis("channel", where=RELIABLE)
    + """
        SELECT channel, revenue_per_session,
               round(revenue_per_session / (SELECT revenue_per_session FROM rated
                                            WHERE channel = 'Google Paid'), 2) AS rps_ratio
        FROM rated""",
    "revenue_by_device": _kpis("device_category") + "\nSELECT * FROM rated",
    "revenue_by_device_user_session": _kpis("device_category", USER_SESSION)
    + "\nSELECT * FROM rated",
    "device_share": _kpis("device_category")
    + """
        SELECT device_category,
               round(sessions * CAST(100 AS DOUBLE) / sum(sessions) OVER (), 2)
                   AS session_share_pct,
               round(revenue * CAST(100 AS DOUBLE) / sum(revenue) OVER (), 2) AS revenue_share_pct
        FROM report""",
    "monthly_trend": MONTHS + "\nSELECT * FROM trend",
    "monthly_growth": MONTHS
    + """
        SELECT year_month, total_sessions,
               round((total_sessions - lag(total_sessions) OVER w) * CAST(100 AS DOUBLE)
                     / lag(total_sessions) OVER w, 2) AS sessions_change_pct,
               round(total_sessions / CAST(first_value(total_sessions) OVER w AS DOUBLE), 2)
                   AS sessions_vs_first,
               revenue_per_session,
               round((revenue_per_session - lag(revenue_per_session) OVER w) * CAST(100 AS DOUBLE)
                     / lag(revenue_per_session) OVER w, 2) AS rps_change_pct,
               round(revenue_per_session / first_value(revenue_per_session) OVER w, 2)
                   AS rps_vs_first
        FROM trend WINDOW w AS (ORDER BY year_month)""",
    "bounce_overall": """
        single AS (
            SELECT session_id FROM master GROUP BY session_id HAVING count(event_name) = 1
        )
        SELECT max(n) AS total_sessions, count(*) AS bounced_sessions,
               round(count(*) / nullif(CAST(max(n) AS DOUBLE), 0) * 100, 2) AS bounce_rate_pct
        FROM single CROSS JOIN (SELECT count(DISTINCT session_id) AS n FROM master)""",
    "bounce_by_device": _bounce("device_category"),
    "bounce_by_country": _bounce("country", "v.total_sessions >= 50"),
    "bounce_by_large_country": _bounce("country", "v.total_sessions >= 160"),
    "bounce_by_channel": _bounce("channel"),
    "bounce_by_channel_incremental": _bounce("channel"),
    "new_vs_returning": USERS + "\nSELECT * FROM report",
    "user_type_lift": USERS
    + """
        SELECT user_type,
               round(sessions * CAST(100 AS DOUBLE) / sum(sessions) OVER (), 2)
                   AS session_share_pct,
               round(revenue * CAST(100 AS DOUBLE) / sum(revenue) OVER (), 2) AS revenue_share_pct,
               round(cvr_pct / (SELECT cvr_pct FROM report WHERE user_type = 'New'), 2)
                   AS cvr_lift,
               round(revenue_per_session
                     / (SELECT revenue_per_session FROM report WHERE user_type = 'New'), 2)
                   AS revenue_per_session_lift
        FROM report""",
    "top_products": """
        ranked AS (
            SELECT item_name, sum(item_revenue) AS revenue, sum(quantity) AS total_quantity,
                   count(session_id) AS no_of_orders
            FROM items GROUP BY item_name
            ORDER BY revenue DESC NULLS LAST, item_name NULLS FIRST LIMIT 10
        )
        SELECT item_name, round(revenue, 2) AS total_revenue, total_quantity, no_of_orders
        FROM ranked""",
    "category_revenue": """
        SELECT item_category, round(sum(item_revenue), 2) AS total_revenue,
               sum(quantity) AS total_quantity, count(session_id) AS no_of_orders,
               round(sum(item_revenue) / nullif(count(session_id), 0), 2) AS aov
        FROM shelved GROUP BY item_category""",
    "top_product_per_category": """
        sums AS (
            SELECT item_category, item_name, sum(item_revenue) AS revenue
            FROM shelved GROUP BY item_category, item_name
        )
        SELECT item_category, item_name, round(revenue, 2) AS total_revenue
        FROM sums s
        WHERE revenue IS NOT DISTINCT FROM
            (SELECT max(revenue) FROM sums t WHERE t.item_category = s.item_category)
        """,
    "category_monthly": CATEGORY_MONTHS
    + """
        SELECT year_month, item_category, round(revenue, 2) AS total_revenue, total_quantity
        FROM by_month""",
    "channel_category": _channel_category() + "\nSELECT * FROM report",
    "channel_category_dedup": _channel_category("DISTINCT") + "\nSELECT * FROM report",
    "channel_category_stored": _channel_category() + "\nSELECT * FROM report",
    "channel_category_aov_stored": _channel_category()
    + "\nSELECT *, round(total_revenue / orders, 2) AS aov FROM report",
    "top_category_per_channel_stored": _channel_category()
    + """
        SELECT * FROM report
        QUALIFY rank() OVER (PARTITION BY channel ORDER BY total_revenue DESC) = 1""",
    "active_by_range": _active_by_range(),
    "active_by_range_and_country": _active_by_range("country"),
    "category_share": """
        sums AS (
            SELECT item_category, sum(item_revenue) AS revenue FROM shelved GROUP BY item_category
        )
        SELECT item_category, round(revenue, 2) AS total_revenue,
               round(revenue * CAST(100 AS DOUBLE) / sum(revenue) OVER (), 2) AS share_pct
        FROM sums""",
    "category_change": CATEGORY_MONTHS
    + """
        SELECT item_category, min(year_month) AS first_month, max(year_month) AS last_month,
               round(arg_min(revenue, year_month), 2) AS first_revenue,
               round(arg_max(revenue, year_month), 2) AS last_revenue,
               round((arg_max(revenue, year_month) - arg_min(revenue, year_month))
                     * CAST(100 AS DOUBLE) / arg_min(revenue, year_month), 2) AS change_pct
        FROM by_month GROUP BY item_category""",
    "category_vs_sessions": CATEGORY_MONTHS
    + ","
    + MONTHS
    + """
        SELECT year_month, item_category, round(revenue, 2) AS total_revenue, total_sessions
        FROM by_month JOIN trend USING (year_month)""",
    "channel_category_aov": _channel_category()
    + "\nSELECT *, round(total_revenue / orders, 2) AS aov FROM report",
    "top_category_per_channel": _channel_category()
    + """
        SELECT * FROM report
        QUALIFY rank() OVER (PARTITION BY channel ORDER BY total_revenue DESC) = 1""",
    "missing_channel_category": _channel_category()
    + f"""
        SELECT channel, item_category
        FROM (SELECT DISTINCT channel FROM master WHERE {RELIABLE})
        CROSS JOIN (SELECT DISTINCT item_category FROM shelved)
        EXCEPT
        SELECT channel, item_category FROM report""",
    "top_pages": _pages("total_visits"),
    "entry_pages": _pages("sessions_entering_here", ENTRY),
    "page_rank_compare": f"""
        visited AS (
            SELECT page_location, count(user_pseudo_id) AS total_visits,
                   rank() OVER (ORDER BY count(user_pseudo_id) DESC) AS visit_rank
            FROM master GROUP BY page_location
        ),
        entered AS (
            SELECT page_location, count(user_pseudo_id) AS sessions_entering_here,
                   rank() OVER (ORDER BY count(user_pseudo_id) DESC) AS entry_rank
            FROM master WHERE {ENTRY} GROUP BY page_location
        )
        SELECT coalesce(v.page_location, e.page_location) AS page_location, total_visits,
               visit_rank, sessions_entering_here, entry_rank
        FROM visited v FULL JOIN entered e ON v.page_location IS NOT DISTINCT FROM e.page_location
        """,
    "top_pages_normalized": _pages("total_visits", normalize=True),
    "entry_pages_normalized": _pages("sessions_entering_here", ENTRY, normalize=True),
}


def oracle_sql() -> dict[str, str]:
    """SQL text per registered report."""
    return {name: complete(body) for name, body in BODIES.items()}
