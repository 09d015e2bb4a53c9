"""Every registered report against independent SQL, on the test tables and on random ones."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from checks.compare import difference, open_tables
from checks.oracle import BODIES, complete
from tillpath import schema as S
from tillpath.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


def test_every_report_has_sql():
    assert set(catalog.CATALOG) <= set(contract.queries())
    assert set(catalog.CATALOG) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_is_the_funnel(spark):
    report = contract.entry(spark)
    assert report.columns == ["funnel_stage", "sessions", "dropoff_pct", "cvr_from_top_pct"]
    assert report.count() == 6


@pytest.mark.parametrize("name", list(catalog.CATALOG))
def test_on_test_tables(spark, tables, name):
    assert difference(spark, tables, FOLDER, name) is None


# Random raw tables, with what the test tables lack: nulls anywhere, events outside the stages,
# repeated rows of one session, revenue on any event, tied counts and one dominant session.

RAW_TABLES = """
WITH raw_events AS (SELECT * FROM given_events),
all_events AS (SELECT * FROM given_events),
raw_items AS (SELECT * FROM given_items)
"""


def _random_tables(spark, folder: Path, seed: int) -> None:
    rng = random.Random(seed)

    def some(values, null=0.1):
        return None if rng.random() < null else rng.choice(values)

    names = [event for event, _ in S.STAGES] + ["scroll"]
    urls = [
        "https://Shop.Example.com/",
        "http://example.com",
        "https://www.example.com/?a=/b/",
        "https://example.com/Hats/",
        "https://shop.example.com/Hats#top",
        "https://example.com/hats?x=1#y",
    ]
    months = ["202011", "202012", "202101"]

    def session():
        return 1 if rng.random() < 0.3 else some(range(1, 60), 0.05)

    events = [
        (
            number,
            some([m + d for m in months for d in ("01", "15", "30")], 0.02),
            some(names, 0.04),
            some(range(100, 125)),
            session(),
            some(["desktop", "mobile", "tablet"]),
            some(["Greece", "Chile", "Japan"]),
            some(urls),
            some(["google", "(direct)", S.OWN_HOSTS[0], "fb", "(data deleted)", "unknown"], 0.6),
            some(["cpc", "organic", "(none)", "referral", "<Other>"], 0.5),
            some(["c1", "c2"], 0.7),
            some([10.0, 2.5, 0.25, 0.0], 0.7),
        )
        for number in rng.sample(range(10_000), 600)
    ]
    items = [
        (
            some([m + d for m in months for d in ("01", "15")], 0.02),
            session(),
            some(["hat", "cap", "mug", "bag"]),
            some(["Hats", "Mugs", "", "(not set)", "Bags"]),
            some([10.0, 2.5, 0.25], 0.05),
            some([1.0, 2.0], 0.05),
        )
        for _ in range(200)
    ]
    spark.createDataFrame(events, S.RAW_EVENTS).write.parquet(str(folder / "events"))
    spark.createDataFrame(items, S.RAW_ITEMS).write.parquet(str(folder / "items"))


@pytest.fixture(scope="module", params=[1, 2])
def random_folder(spark, tmp_path_factory, request):
    folder = tmp_path_factory.mktemp("random")
    _random_tables(spark, folder, request.param)
    return folder


@pytest.fixture
def on_random(random_folder, monkeypatch):
    def events(spark, folder, keep_unmapped=False):
        return spark.read.parquet(f"{folder}/events")

    monkeypatch.setattr(catalog, "raw_events", events)
    monkeypatch.setattr(
        catalog, "raw_items", lambda spark, folder: spark.read.parquet(f"{folder}/items")
    )
    monkeypatch.setattr(
        "checks.compare.oracle_sql",
        lambda: {name: complete(body, RAW_TABLES) for name, body in BODIES.items()},
    )
    con = duckdb.connect()
    for table in ("events", "items"):
        con.execute(
            f"CREATE VIEW given_{table} AS "
            f"SELECT * FROM read_parquet('{random_folder}/{table}/*.parquet')"
        )
    return con, str(random_folder)


@pytest.mark.parametrize("name", list(catalog.CATALOG))
def test_on_random_tables(spark, on_random, name):
    con, folder = on_random
    assert difference(spark, con, folder, name) is None
