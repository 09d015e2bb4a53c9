"""Tables stored once give the same reports, from Python, the command line and SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.frames import items, raw, rows
from tillpath import schema as S
from tillpath.__main__ import main
from tillpath.operators.distinct import active, active_by_range, distinct_sketches, exact_by_range, sketch_errors
from tillpath.plans.reports import REPORTS
from tillpath.plans.tables import Options, RawTables, StoredTables
from tillpath.sources import read_csv_table, write_csv_table


@pytest.fixture(scope="module")
def given(spark):
    stages = [event for event, _ in S.STAGES]
    events = raw(
        spark,
        *[
            {
                "event_date": ["20201105", "20201220", "20210110"][n % 3],
                "event_name": stages[n % 6],
                "user_pseudo_id": n % 7,
                "session_id": [None, *range(1, 14)][n % 14],
                "device_category": ["desktop", "mobile"][n % 2],
                "country": "Greece",
                "page_location": f"https://shop.example.com/p/{n % 3}",
                "source": [None, "google", "fb", S.OWN_HOSTS[0]][n % 4],
                "medium": [None, "cpc", "referral"][n % 3],
                "revenue": n / 4 if n % 6 == 5 else None,
            }
            for n in range(90)
        ],
        {"session_id": 99, "event_name": "session_start", "user_pseudo_id": 99},
    )
    sold = items(
        spark,
        *[
            {
                "session_id": n % 14,
                "item_name": f"item {n % 5}",
                "item_category": ["Hats", "Mugs", None][n % 3],
                "item_revenue": n / 2,
                "event_date": ["20201105", "20210110"][n % 2],
            }
            for n in range(40)
        ],
    )
    return RawTables(events, sold)


@pytest.fixture(scope="module")
def store(spark, given, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shop")
    write_csv_table(given.raw_events, str(folder / "events.csv"))
    write_csv_table(given.raw_items, str(folder / "items.csv"))
    files = ["--events", str(folder / "events.csv"), "--items", str(folder / "items.csv")]
    main(["prepare", *files, "--out", str(folder / "store"), "--csv-copy"])
    return str(folder / "store")


def cents(found):
    """Rows with sums of money as cents; their last digits depend on the order of adding up."""
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", list(REPORTS))
def test_stored_tables_give_the_same_report(spark, given, store, name):
    ours = REPORTS[name](StoredTables(spark, store))
    theirs = REPORTS[name](given)
    kinds = dict(theirs.dtypes) | {"user_pseudo_id": "string"}  # exports keep user ids as text
    assert ours.columns == theirs.columns
    assert {c: kinds[c] for c in ours.columns} == dict(ours.dtypes) | (
        {"user_pseudo_id": "string"} if "user_pseudo_id" in ours.columns else {}
    )
    text = lambda df: [
        tuple(str(v) if c == "user_pseudo_id" and v is not None else v for c, v in zip(df.columns, r))
        for r in rows(df)
    ]
    assert cents(text(ours)) == cents(text(theirs))


def test_both_kinds_of_tables_have_thirteen_columns(spark, given, store):
    for tables in (given, StoredTables(spark, store)):
        shapes = {r["table_name"]: r["n_columns"] for r in REPORTS["table_shapes"](tables).collect()}
        assert shapes == {"master_events": 13, "items_clean": 6}
        assert len(tables.master.columns) == 13


def test_few_files_per_month(spark, given, store):
    files = [f for f in StoredTables(spark, store).master.inputFiles()]
    months = {f.split(f"{S.MONTH_FOLDER}=")[1].split("/")[0] for f in files}
    assert len(files) <= 2 * len(months)


def test_options_are_stored_with_the_tables(spark, given, tmp_path):
    options = Options(("purchase", "begin_checkout"), ("fb",), (("purchase", "1 - Bought"),), ("user_pseudo_id", "session_id"))
    shop = RawTables(given.raw_events, given.raw_items, options)
    shop.store(str(tmp_path))
    stored = StoredTables(spark, str(tmp_path))
    assert stored.options.to_json() == options.to_json()
    for name in ("channel_attribution", "funnel", "funnel_by_channel", "bounce_by_channel", "channel_category", "master_events"):
        assert cents(rows(REPORTS[name](stored))) == cents(rows(REPORTS[name](shop)))
    assert {r[0] for r in rows(REPORTS["funnel"](stored))} <= {"1 - Bought", None}


def test_options_from_the_command_line(spark, given, tmp_path, capsys):
    given.raw_events.write.parquet(str(tmp_path / "events"))
    given.raw_items.write.parquet(str(tmp_path / "items"))
    main(
        ["prepare", "--events", str(tmp_path / "events"), "--items", str(tmp_path / "items"), "--format", "parquet"]
        + ["--out", str(tmp_path / "store"), "--own-host", "a", "--own-host", "b", "--priority", "purchase,view_item"]
        + ["--session-key", "user_pseudo_id,session_id", "--stage", "view_item=1 - Seen", "--stage", "purchase=2 - Bought"]
    )
    options = StoredTables(spark, str(tmp_path / "store")).options
    assert tuple(options.own_hosts) == ("a", "b") and tuple(options.priority) == ("purchase", "view_item")
    assert tuple(options.session_key) == ("user_pseudo_id", "session_id")
    assert options.stages == [("view_item", "1 - Seen"), ("purchase", "2 - Bought")]
    capsys.readouterr()
    main(["report", "funnel", "--store", str(tmp_path / "store"), "--rows", "1"])
    assert "only showing top 1 row" in capsys.readouterr().out


def test_further_columns_reach_the_master_events(spark, tmp_path):
    head = ",".join(f.name for f in S.RAW_EVENTS.fields)
    (tmp_path / "events.csv").write_text(
        f'{head},note,os\n1,20201101,purchase,u1,11,mobile,Greece,https://a/,google,cpc,,12.5,"two\nlines",NA\n'
    )
    (tmp_path / "items.csv").write_text(",".join(f.name for f in S.RAW_ITEMS.fields) + "\n")
    files = ["--events", str(tmp_path / "events.csv"), "--items", str(tmp_path / "items.csv")]
    main(["prepare", *files, "--multiline", "--csv-copy", "--out", str(tmp_path / "store")])
    found = StoredTables(spark, str(tmp_path / "store")).master.first()
    assert (found["note"], found["os"], found["channel"]) == ("two\nlines", None, "Google Paid")
    copy = read_csv_table(spark, f"{tmp_path}/store/master_events_csv", S.CSV_MASTER_EVENTS, True, True)
    assert copy.first()["user_pseudo_id"] == "u1" and copy.first()["note"] == "two\nlines"


@pytest.mark.parametrize("name", [*S.RESERVED, "Channel", "year_month", "bucket", "salts", "rows", "__salt", "__bucket"])
def test_further_columns_with_names_of_added_ones(spark, tmp_path, name):
    events = raw(spark, {"session_id": 1, "source": "google", "medium": "cpc"}, {"session_id": None}, {"session_id": 2})
    theirs = events.withColumn(name, F.concat(F.lit("theirs "), "event_id")).withColumn("raw_channel", F.lit("as well"))
    shop = RawTables(theirs, items(spark, {"session_id": 1}))
    shop.store(str(tmp_path))
    clashes = name.lower() in S.RESERVED or name.startswith("__")
    kept = {"Channel": "raw_raw_Channel", "channel": "raw_raw_channel"}.get(name, "raw_" + name.lstrip("_")) if clashes else name
    for tables in (shop, StoredTables(spark, str(tmp_path))):
        found = {r["event_id"]: r for r in tables.master.collect()}
        assert [found[n][kept] for n in range(3)] == ["theirs 0", "theirs 1", "theirs 2"]
        assert [found[n]["channel"] for n in range(3)] == ["Google Paid", "Unknown", "Unknown"]
        assert found[0]["session_source"] == "google" and found[0]["raw_channel"] == "as well"
        assert rows(REPORTS["channel_value_counts"](tables)) == [("Unknown", 2), ("Google Paid", 1)]


def test_an_export_without_event_ids_and_with_fractional_user_ids(spark, tmp_path):
    (tmp_path / "events.csv").write_text(
        "event_date,event_name,user_pseudo_id,session_id,device_category,country,page_location,"
        "source,medium,campaign,revenue\n"
        "20201101,session_start,1026932.0858862293,11,desktop,Greece,https://a/,,,,\n"
        "20201101,purchase,1026932.0858862293,11,desktop,Greece,https://a/,google,cpc,,12.5\n"
        "20201102,session_start,1026932.0858862294,12,mobile,Greece,https://a/,,,,\n"
    )
    (tmp_path / "items.csv").write_text(
        "event_date,session_id,item_name,item_category,item_revenue,quantity\n"
        "20201101,11,hat,Hats,12.5,1\n"
    )
    out = str(tmp_path / "store")
    files = ["--events", str(tmp_path / "events.csv"), "--items", str(tmp_path / "items.csv")]
    main(["prepare", *files, "--out", out])
    shop = StoredTables(spark, out)
    assert "event_id" not in shop.master.columns
    assert rows(REPORTS["new_vs_returning"](shop)) == [("New", 2, 1, 12.5, 6.25, 50.0)]
    found = [("Google Paid", 1, 1, 12.5, 12.5, 100.0)]
    assert rows(REPORTS["channel_attribution"](shop)) == found
    assert rows(REPORTS["channel_category"](shop)) == [("Google Paid", "Hats", 12.5, 1)]


def test_csv_copy_holds_the_master_events(spark, given, store):
    copy = read_csv_table(spark, f"{store}/master_events_csv", S.MASTER_EVENTS)
    assert sorted(rows(copy), key=repr) == sorted(rows(given.master), key=repr)


def test_channels_and_categories_join_without_a_shuffle(spark, given, store):
    shop = StoredTables(spark, store)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = REPORTS["channel_category"](shop)
        text = report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = text[text.index("SortMergeJoin") :]
    assert "Exchange" not in below
    assert below.count("FileScan") == 2 and below.count("Bucketed: true") == 2
    assert "raw_events" not in text and "master_events" not in text
    assert sorted(rows(report)) == sorted(rows(REPORTS["channel_category"](given)))


def test_distinct_counts_come_from_the_sketches(spark, given, store):
    shop = StoredTables(spark, store)
    for found in (active_by_range(shop.sketches), active(shop.sketches, "2020-12", "2021-01", "country")):
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "distinct_sketches" in text and "master_events" not in text and "raw_events" not in text
    # So few are counted exactly.
    exact = {(r[0], r[1]): (r[3], r[4]) for r in exact_by_range(given.events).collect()}
    counted = {(r["first_month"], r["last_month"]): (r["sessions"], r["users"]) for r in active_by_range(shop.sketches).collect()}
    assert counted == exact and len(exact) == 6
    assert rows(active(shop.sketches, "2020-12", "2021-01")) == [(None, *exact["2020-12", "2021-01"])]
    assert rows(active(shop.sketches)) == [(None, *exact["2020-11", "2021-01"])]


def test_sketches_of_many_sessions_are_within_the_bound(spark):
    ids = spark.range(60_000)
    events = ids.select(
        F.col("id").alias("event_id"),
        F.expr("date_add(DATE'2020-11-01', cast(id % 91 AS int))").alias("event_date"),
        F.expr("id * 7 % 41011").alias("session_id"),
        F.expr("if(id % 10 = 0, NULL, id % 20011)").alias("user_pseudo_id"),
        F.expr("array('a', 'b', NULL)[id % 3]").alias("device_category"),
        F.expr("if(id % 3 = 0, 'Greece', 'Chile')").alias("country"),
    )
    for dimension in (None, "device_category", "country"):
        found = sketch_errors(distinct_sketches(events), events, dimension).collect()
        assert len(found) == 6 * {None: 1, "device_category": 3, "country": 2}[dimension]
        assert all(r["sessions_within_bound"] and r["users_within_bound"] for r in found)


def test_report_from_the_command_line(spark, given, store, tmp_path, capsys):
    main(["report", "funnel", "--store", store])
    assert "1 - Session Start" in capsys.readouterr().out
    out = str(tmp_path / "funnel")
    main(["report", "funnel", "--store", store, "--out", out, "--format", "parquet"])
    assert sorted(rows(spark.read.parquet(out))) == sorted(rows(REPORTS["funnel"](given)))


def test_stored_tables_answer_sql(spark, given, store):
    StoredTables(spark, store).register()
    found = spark.sql(
        "SELECT channel, count(DISTINCT session_id) AS sessions FROM master_events "
        "WHERE event_name = 'purchase' GROUP BY channel"
    )
    purchases = {r["channel"]: r["purchase"] for r in REPORTS["channel_attribution"](given).collect()}
    counted = {r["channel"]: r["sessions"] for r in found.collect()}
    assert {c: n for c, n in counted.items() if c in purchases} == purchases
    assert spark.table("items_clean").count() == 40
    assert spark.table("session_mart").count() == 15
