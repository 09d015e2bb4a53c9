"""Published counts must give the published percentages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.frames import rows
from tillpath.functions import pct_of, pct_ratio, per_unit

FUNNEL = [27901, 4691, 811, 486, 298, 198]
DROPOFF = [83.2, 82.7, 40.1, 38.7, 33.6]
FUNNEL_RATE = [100.0, 16.8, 2.9, 1.7, 1.1, 0.7]

# sessions, purchases, revenue, revenue per session, conversion rate
CHANNELS = [
    (1222, 113, 5380, 4.40, 9.2),
    (306, 30, 1002, 3.27, 9.8),
    (98, 9, 2146, 21.90, 9.2),
    (148, 11, 425, 2.87, 7.4),
    (26, 3, 40, 1.54, 11.5),
]
DEVICES = [
    (16388, 112, 7252, 0.44, 0.7),
    (11113, 79, 3141, 0.28, 0.7),
    (698, 7, 411, 0.59, 1.0),
]
USERS = [(22730, 134, 6546, 0.29, 0.59), (5418, 64, 4258, 0.79, 1.18)]
MONTHS = [
    (2188, 21, 1483, 0.68, 0.96),
    (8325, 63, 5360, 0.64, 0.76),
    (17505, 114, 3961, 0.23, 0.65),
]

# sessions, bounced sessions, rate
BOUNCES = [
    (28018, 23055, 82.29),
    (16388, 13581, 82.87),
    (11113, 9187, 82.67),
    (698, 576, 82.52),
    (104, 81, 77.88),
    (121, 96, 79.34),
    (378, 300, 79.37),
    (54, 43, 79.63),
    (490, 395, 80.61),
    (12419, 10257, 82.59),
    (2686, 2253, 83.88),
    (2112, 1779, 84.23),
    (118, 110, 93.22),
    (47, 44, 93.62),
    (26054, 23047, 88.46),
    (1222, 6, 0.49),
    (164, 2, 1.22),
]

# revenue, orders, average
ORDERS = [
    (171727, 4984, 34.46),
    (25813, 1445, 17.86),
    (23860, 704, 33.89),
    (20061, 1497, 13.40),
    (17815, 1276, 13.96),
]


def _ratios(spark, ratio, digits, pairs):
    """The ratio of every pair, in the order given."""
    given = [(n, float(a), float(b)) for n, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(given, "n int, a double, b double")
    answer = frame.select("n", ratio(F.col("a"), F.col("b"), digits)).orderBy("n")
    return [r[1] for r in rows(answer)]


def test_funnel(spark):
    lost = [(before - now, before) for before, now in zip(FUNNEL, FUNNEL[1:])]
    assert _ratios(spark, pct_of, 1, lost) == DROPOFF
    assert _ratios(spark, pct_of, 1, [(n, FUNNEL[0]) for n in FUNNEL]) == FUNNEL_RATE


def test_revenue_per_session(spark):
    table = [*CHANNELS, *DEVICES, *USERS, *MONTHS]
    assert _ratios(spark, per_unit, 2, [(r[2], r[0]) for r in table]) == [r[3] for r in table]


def test_conversion_rates(spark):
    for table, ratio, digits in (
        (CHANNELS + DEVICES, pct_of, 1),
        (USERS, pct_of, 2),
        (MONTHS, pct_ratio, 2),
    ):
        found = _ratios(spark, ratio, digits, [(r[1], r[0]) for r in table])
        assert found == [r[4] for r in table]


def test_bounce_rates(spark):
    found = _ratios(spark, pct_ratio, 2, [(r[1], r[0]) for r in BOUNCES])
    assert found == [r[2] for r in BOUNCES]


def test_average_order_value(spark):
    found = _ratios(spark, per_unit, 2, [(r[0], r[1]) for r in ORDERS])
    assert found == [r[2] for r in ORDERS]


def test_order_of_operations_shows_in_rounding(spark):
    assert _ratios(spark, pct_of, 2, [(23, 160)]) == [14.38]
    assert _ratios(spark, pct_ratio, 2, [(23, 160)]) == [14.37]


def test_zero_denominator_is_null(spark):
    for ratio in (pct_of, pct_ratio, per_unit):
        assert _ratios(spark, ratio, 2, [(5, 0)]) == [None]
