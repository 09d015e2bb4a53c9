"""Column expressions: ratios, keys, channel labels and URLs."""

from tillpath.functions.channels import channel_label
from tillpath.functions.keys import as_columns, month_label, month_start, session_key_column
from tillpath.functions.ratios import pct_of, pct_ratio, per_unit
from tillpath.functions.urls import normalized_page

__all__ = [
    "as_columns",
    "channel_label",
    "month_label",
    "month_start",
    "normalized_page",
    "pct_of",
    "pct_ratio",
    "per_unit",
    "session_key_column",
]
