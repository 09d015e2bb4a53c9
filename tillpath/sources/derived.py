"""Raw events and items derived from the generic star-schema test tables.

The test tables hold no sessions, channels, devices or pages. These mappings derive them from
whole tables with fixed rules, so that the derived tables grow with the test tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillpath import schema as S

# Columns read of each test table; naming them keeps readers from opening files for their schema.
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)
NATION = "n_nationkey int, n_name string"
LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, "
    "l_discount double, l_shipdate timestamp_ntz"
)
PART = "p_partkey bigint, p_name string, p_type string, p_size int"

# The event name of a test event, by its type and its number k.
EVENT_NAME = """
CASE event_type
    WHEN 'signup' THEN 'session_start'
    WHEN 'view' THEN 'view_item'
    WHEN 'click' THEN if(k < 60, 'add_to_cart', 'begin_checkout')
    WHEN 'error' THEN if(k < 50, 'add_payment_info', '{otherwise}')
    WHEN 'purchase' THEN 'purchase'
    ELSE event_type
END
"""

# Source and medium of an event that is no session start, by k modulo 12.
ORIGINS = {
    0: ("google", "cpc"),
    1: ("google", "organic"),
    2: ("(direct)", "(none)"),
    3: (S.OWN_HOSTS[0], "referral"),
    4: ("partner.example.com", "referral"),
    5: ("<Other>", "<Other>"),
    6: ("(data deleted)", "(data deleted)"),
    7: ("newsletter", "email"),
    8: ("google", None),
}


def _origin(part: int) -> str:
    cases = " ".join(
        f"WHEN {k} THEN '{names[part]}'" for k, names in ORIGINS.items() if names[part] is not None
    )
    return f"if(event_name = '{S.ENTRY_EVENT}', NULL, CASE k % 12 {cases} END)"


def _load(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def raw_events(spark: SparkSession, folder: str, keep_unmapped: bool = False) -> DataFrame:
    """Raw shop events, one for each test event.

    With ``keep_unmapped`` half of the errors stay errors, which belong to no funnel stage; otherwise
    they are payment events like the rest. Other event types keep their names.
    """
    otherwise = "error" if keep_unmapped else "add_payment_info"
    events = (
        _load(spark, folder, "events", EVENTS)
        .selectExpr(
            "event_id",
            "event_type",
            "value",
            "user_id",
            "cast(get_json_object(props, '$.k') AS int) AS k",
            "add_months(to_date(ts), -cast((user_id div 2) % 3 AS int)) AS day",
        )
        .selectExpr(
            "*",
            f"{EVENT_NAME.format(otherwise=otherwise)} AS event_name",
            "year(day) * 10000 + month(day) * 100 + dayofmonth(day) AS day_number",
        )
    )
    # 25 nations whatever the scale; left to Spark's own size check, no broadcast hint.
    nations = _load(spark, folder, "nation", NATION).selectExpr(
        "cast(n_nationkey AS bigint) AS nation", "n_name AS country"
    )
    return events.join(nations, events.user_id % 25 == nations.nation, "left").selectExpr(
        "event_id",
        "cast(day_number AS string) AS event_date",
        "event_name",
        "user_id * 100 + if(user_id % 3 = 0, 0, dayofmonth(day)) AS user_pseudo_id",
        "day_number * 1000000L + user_id - if(user_id % 40 = 1, 1, 0) AS session_id",
        "CASE WHEN k % 20 = 7 THEN 'tablet' WHEN user_id % 2 = 0 THEN 'desktop' ELSE 'mobile' END"
        " AS device_category",
        "country",
        "CASE k % 15 WHEN 0 THEN 'https://shop.example.com/' WHEN 1 THEN 'https://example.com/'"
        " WHEN 2 THEN 'https://www.example.com/'"
        " ELSE concat('https://shop.example.com/p/', k % 15) END AS page_location",
        f"{_origin(0)} AS source",
        f"{_origin(1)} AS medium",
        f"if(event_name <> '{S.ENTRY_EVENT}' AND k % 5 = 0, concat('c', k), NULL) AS campaign",
        f"if(event_name = '{S.PURCHASE_EVENT}', value, NULL) AS revenue",
    )


def raw_items(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item.

    An item whose order is no purchase event has no session and the date it was shipped; an unknown part
    has no name and no category.
    """
    purchases = (
        raw_events(spark, folder)
        .filter(f"event_name = '{S.PURCHASE_EVENT}'")
        .select("event_id", "event_date", "session_id")
    )
    # Whole amounts, so that their sums don't depend on the order of adding up.
    lines = _load(spark, folder, "lineitem", LINEITEM).selectExpr(
        "l_orderkey AS event_id",
        "l_partkey AS part",
        "l_quantity AS quantity",
        "cast(floor(l_extendedprice * (1 - l_discount)) AS double) AS item_revenue",
        "date_format(l_shipdate, 'yyyyMMdd') AS ship_date",
    )
    # A category for each type and size, fine enough that some channels lack some.
    parts = _load(spark, folder, "part", PART).selectExpr(
        "p_partkey AS part",
        "p_name AS item_name",
        "CASE p_size WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN '(not set)'"
        " ELSE concat(p_type, ' ', p_size) END AS item_category",
    )
    return (
        lines.join(purchases, "event_id", "left")
        .join(parts, "part", "left")
        .selectExpr(
            "coalesce(event_date, ship_date) AS event_date",
            "session_id",
            "item_name",
            "item_category",
            "item_revenue",
            "quantity",
        )
    )
