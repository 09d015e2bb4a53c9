"""The marketing channel of a session as one native expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillpath import schema as S


def channel_label(
    source: str | Column, medium: str | Column, own_hosts: Sequence[str] = S.OWN_HOSTS
) -> Column:
    """Channel of a session's source and medium; the first rule that holds decides.

    Texts are compared exactly, upper and lower case apart. A null medium matches no rule that
    asks for a medium.
    """
    src = F.col(source) if isinstance(source, str) else source
    med = F.col(medium) if isinstance(medium, str) else medium
    rules = (
        (src == S.MISSING_SOURCE, S.UNKNOWN),
        (src.isin(*own_hosts), S.SELF_REFERRAL),
        ((src == "google") & (med == "cpc"), S.GOOGLE_PAID),
        ((src == "google") & (med == "organic"), S.GOOGLE_ORGANIC),
        ((src == "(direct)") | (med == "(none)"), S.DIRECT),
        (med == "referral", S.REFERRAL),
        (src.isin(*S.MASKED) | med.isin(*S.MASKED), S.OBFUSCATED),
    )
    label = F.when(*rules[0])
    for condition, name in rules[1:]:
        label = label.when(condition, name)
    return label.otherwise(S.OTHER)
