"""One spelling per page, so that variants of the same address count together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_page(url: str | Column) -> Column:
    """Host in lower case without ``www.`` or ``shop.``, plus the path.

    Scheme, query, fragment and trailing slashes go; the path keeps its case. A null stays null.
    """
    text = F.col(url) if isinstance(url, str) else url
    bare = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host = F.regexp_replace(F.lower(F.substring_index(bare, "/", 1)), r"^(www|shop)\.", "")
    path = F.regexp_replace(bare, r"^[^/]*|/+$", "")
    return F.concat(host, path)
