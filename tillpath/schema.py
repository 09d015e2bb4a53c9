"""Table schemas, labels and other fixed values shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_date", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("user_pseudo_id", T.LongType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("device_category", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("page_location", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("medium", T.StringType()),
        T.StructField("campaign", T.StringType()),
        T.StructField("revenue", T.DoubleType()),
    ]
)

# User ids in exports need not be whole numbers; as text they stay apart and unrounded.
CSV_EVENTS = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name == "user_pseudo_id" else f.dataType)
        for f in RAW_EVENTS.fields
    ]
)

MASTER_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("user_pseudo_id", T.LongType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("device_category", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("page_location", T.StringType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("session_source", T.StringType()),
        T.StructField("session_medium", T.StringType()),
        T.StructField("session_campaign", T.StringType()),
        T.StructField("channel", T.StringType()),
    ]
)

# The CSV copy of master events, where user ids may be text as well.
CSV_MASTER_EVENTS = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name == "user_pseudo_id" else f.dataType)
        for f in MASTER_EVENTS.fields
    ]
)

RAW_ITEMS = T.StructType(
    [
        T.StructField("event_date", T.StringType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("item_name", T.StringType()),
        T.StructField("item_category", T.StringType()),
        T.StructField("item_revenue", T.DoubleType()),
        T.StructField("quantity", T.DoubleType()),
    ]
)

ITEMS_CLEAN = T.StructType(
    [T.StructField("event_date", T.DateType()), *RAW_ITEMS.fields[1:]]
)

# Event name of each funnel stage and the stage label in reports.
STAGES = (
    ("session_start", "1 - Session Start"),
    ("view_item", "2 - View Item"),
    ("add_to_cart", "3 - Add to Cart"),
    ("begin_checkout", "4 - Begin Checkout"),
    ("add_payment_info", "5 - Add Payment Info"),
    ("purchase", "6 - Purchase"),
)
ENTRY_EVENT = "session_start"
PURCHASE_EVENT = "purchase"

# Channel labels, and the source / medium texts they are read from.
UNKNOWN = "Unknown"
SELF_REFERRAL = "Self-Referral"
GOOGLE_PAID = "Google Paid"
GOOGLE_ORGANIC = "Google Organic"
DIRECT = "Direct"
REFERRAL = "Referral"
OBFUSCATED = "Obfuscated"
OTHER = "Other"
MISSING_SOURCE = "unknown"
OWN_HOSTS = ("shop.googlemerchandisestore.com",)
MASKED = ("<Other>", "(data deleted)")

# Channels left out of channel reports, and category texts that mean "no category".
UNRELIABLE_CHANNELS = (UNKNOWN, OBFUSCATED)
EMPTY_CATEGORIES = ("", "(not set)")

# The texts pandas reads as missing in a CSV file.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Columns that preparation adds. A further column of the input with such a name, in any case, is renamed.
MONTH_FOLDER = "tillpath_month"
BATCH_FOLDER = "tillpath_batch"
RESERVED = ("session_source", "session_medium", "session_campaign", "channel", MONTH_FOLDER, BATCH_FOLDER)
RESERVED_START = "__"
RENAMED = "raw_"

# Labels of the two kinds of user.
NEW_USER = "New"
RETURNING_USER = "Returning"
