"""What the physical plans may and may not contain, and that skew changes no result."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.frames import rows
from tillpath.operators import engagement, pages, revenue
from tillpath.operators.funnel import funnel
from tillpath.plans import channel_mart as mart
from tillpath.plans.catalog import CATALOG
from tillpath.plans.prepare import build_master, without_attribution
from tillpath.sources import raw_events

FOLDER = "/root/testdata/sf0.001"
LAZY = [name for name in CATALOG if not name.startswith("csv_roundtrip")]
NARROW = ("Project", "Filter", "Generate", "Sort", "Window", "WindowGroupLimit")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    text = plan(df)
    return re.sub(r"\+- == Initial Plan ==.*?(?=\+- == Final Plan ==|\Z)", "", text, flags=re.S)


def _operators(text: str) -> list[tuple[int, str]]:
    """Indentation and name of each operator line."""
    found = []
    for line in text.splitlines():
        match = re.match(r"^([\s:+-]*)(?:\*?\(\d+\)\s*)?(\w+.*)$", line)
        if match:
            found.append((len(match.group(1)), match.group(2)))
    return found


@pytest.mark.parametrize("name", LAZY)
def test_plan_is_native_and_scales(spark, name):
    text = plan(CATALOG[name](spark, FOLDER))
    for forbidden in ("PythonUDF", "EvalPython", "MapInPandas", "CartesianProduct", "NestedLoop"):
        assert forbidden not in text
    operators = _operators(text)
    for at, (depth, operator) in enumerate(operators):
        if not operator.startswith("Exchange SinglePartition"):
            continue
        below = at + 1
        while operators[below][1].startswith(NARROW):
            below += 1
        # One task only ever receives rows that were aggregated before.
        assert operators[below][0] > depth
        assert re.match(r"(Hash|Sort|ObjectHash)Aggregate", operators[below][1]), text


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "events")
    raw_events(spark, FOLDER).write.parquet(path)
    return spark.read.parquet(path)


def _scan_columns(text: str) -> set[str]:
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    return {column.split(":")[0] for part in schemas for column in part.split(",") if column}


def test_scans_read_only_the_columns_a_report_needs(stored):
    events = without_attribution(stored)
    for report, columns in (
        (funnel(events), {"session_id", "event_name"}),
        (engagement.bounce_rate(events, "country"), {"session_id", "event_name", "country"}),
        (pages.top_pages(events), {"page_location", "user_pseudo_id"}),
        (
            mart.channel_kpis(mart.session_mart(stored)),
            {"session_id", "event_id", "event_name", "source", "medium", "revenue"},
        ),
    ):
        full = report._jdf.queryExecution().explainString(
            report.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(
                "formatted"
            )
        )
        assert _scan_columns(full) == columns


def test_filters_reach_the_scan(stored):
    text = plan(pages.entry_pages(without_attribution(stored)))
    assert "EqualTo(event_name,session_start)" in text


def test_reports_shuffle_events_once_and_merged(stored):
    events = without_attribution(stored)
    for report in (
        funnel(events),
        engagement.bounce_rate(events, "device_category"),
        revenue.kpis_by(events, "device_category"),
        revenue.monthly_trend(events),
        mart.channel_kpis(mart.session_mart(stored)),
        mart.channel_funnel(mart.session_mart(stored)),
    ):
        text = plan(report)
        assert text.count("FileScan") == 1
        operators = [name for _, name in _operators(text)]
        scan = next(i for i, name in enumerate(operators) if name.startswith("FileScan"))
        shuffle = max(i for i in range(scan) if operators[i].startswith("Exchange"))
        assert any("partial_" in name for name in operators[shuffle:scan])


def test_page_ranks_read_the_events_once(stored):
    text = final_plan(pages.page_rank_compare(without_attribution(stored)))
    assert text.count("FileScan") == 1
    assert "ReusedExchange" in text


def test_master_events_pass_over_the_events_three_times(stored):
    for events in (stored, _hot(stored)):
        master = build_master(events)
        # The crowded buckets are planned for both sides, and run once.
        assert plan(master).count("FileScan") == 4
        text = final_plan(master)
        assert text.count("FileScan") == 3 and "ReusedExchange" in text
        assert len(re.findall(r"(SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin) ", text)) == 3


def test_new_and_returning_users_come_from_one_pass(stored):
    text = final_plan(engagement.new_vs_returning(without_attribution(stored)))
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def _hot(events):
    """A third of all rows in one session, of one user, on one page and without a country."""
    third = F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0
    return events.withColumns(
        {
            "session_id": F.when(third, F.lit(7)).otherwise(F.col("session_id")),
            "user_pseudo_id": F.when(third, F.lit(1)).otherwise(F.col("user_pseudo_id")),
            "page_location": F.when(third, F.lit("https://a/")).otherwise(F.col("page_location")),
            "country": F.when(~third, F.col("country")),
        }
    )


def test_a_third_of_all_rows_in_one_key(spark, stored):
    hot = _hot(stored)
    master = build_master(hot)
    dated = without_attribution(hot)
    master.createOrReplaceTempView("hot_master")
    by_channel = "SELECT channel, count(DISTINCT session_id) AS n FROM hot_master GROUP BY channel"
    expected = {r["channel"]: r["n"] for r in spark.sql(by_channel).collect()}
    sessions = mart.session_mart(hot)
    found = sessions.groupBy("channel").agg(F.count("session").alias("n")).collect()
    assert {r["channel"]: r["n"] for r in found} == expected
    assert master.count() == stored.count()
    labels = (
        "SELECT user_pseudo_id, if(count(DISTINCT session_id) = 1, 'New', 'Returning') AS kind "
        "FROM hot_master GROUP BY user_pseudo_id"
    )
    users = spark.sql(
        "SELECT kind, count(DISTINCT session_id) AS sessions, "
        "count(DISTINCT if(event_name = 'purchase', session_id, NULL)) AS purchases "
        f"FROM hot_master JOIN ({labels}) USING (user_pseudo_id) GROUP BY kind ORDER BY kind"
    )
    ours = engagement.new_vs_returning(dated).select("user_type", "sessions", "purchases")
    assert rows(ours) == rows(users)
