"""Attribution, channel rules, dates, master events and CSV files on tiny tables."""

from __future__ import annotations

import datetime
import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.frames import items, raw, records, rows
from tillpath import schema as S
from tillpath.functions import channel_label, normalized_page
from tillpath.operators.attribution import attach_sessions, attribute_sessions, crowded_buckets
from tillpath.plans.channel_mart import session_mart
from tillpath.plans.prepare import build_items, build_master, parsed_date, without_attribution
from tillpath.session import input_size, shuffle_partitions_for, size_shuffles
from tillpath.sources import (
    raw_events,
    raw_items,
    read_csv_table,
    read_table,
    scratch_path,
    write_csv_table,
    write_master,
    write_table,
)


def test_attributes_come_from_the_first_event_that_has_them(spark):
    events = raw(
        spark,
        {"session_id": 1, "event_name": "purchase", "source": "google", "medium": "cpc"},
        {"session_id": 1, "event_name": "begin_checkout", "source": S.OWN_HOSTS[0]},
        {
            "session_id": 1,
            "event_name": "add_payment_info",
            "source": "fb",
            "campaign": "c",
        },
    )
    assert rows(attribute_sessions(events)) == [(1, "fb", "cpc", "c")]


def test_priority_overrides_the_event_order(spark):
    events = raw(
        spark,
        {"session_id": 1, "event_name": "add_to_cart", "source": "fb", "medium": "social"},
        {"session_id": 1, "event_name": "begin_checkout", "source": "shop"},
        {"session_id": 1, "event_name": "purchase", "source": "google"},
    )
    found = rows(attribute_sessions(events, ["purchase", "begin_checkout"]))
    assert found == [(1, "google", "social", None)]


def test_ties_go_to_the_lowest_event_id_for_any_partitioning(spark):
    events = raw(
        spark,
        *[
            {"event_id": 100 - n, "session_id": 1, "event_name": "purchase", "source": f"s{n}"}
            for n in range(50)
        ],
    )
    for parts in (1, 2, 7):
        assert rows(attribute_sessions(events.repartition(parts)))[0][1] == "s49"
    no_ids = events.drop("event_id").repartition(3)
    assert rows(attribute_sessions(no_ids))[0][1] == "s0"


def test_null_event_name_comes_last(spark):
    events = raw(
        spark,
        {"session_id": 1, "event_name": None, "source": "a", "medium": "m"},
        {"session_id": 1, "event_name": "view_item", "source": "b"},
    )
    assert rows(attribute_sessions(events)) == [(1, "b", "m", None)]


def test_rows_without_source_or_session_attribute_nothing(spark):
    events = raw(
        spark,
        {"session_id": 1, "medium": "cpc"},
        {"session_id": None, "source": "google", "medium": "cpc"},
    )
    assert rows(attribute_sessions(events)) == []
    assert {r["channel"] for r in build_master(events).collect()} == {"Unknown"}
    assert {r["channel"] for r in session_mart(events).collect()} == {"Unknown"}


@pytest.mark.parametrize(
    ("source", "medium", "channel"),
    [
        ("unknown", "cpc", "Unknown"),
        (S.OWN_HOSTS[0], "referral", "Self-Referral"),
        (S.OWN_HOSTS[0].upper(), "x", "Other"),
        ("google", "cpc", "Google Paid"),
        ("google", "organic", "Google Organic"),
        ("google", "(none)", "Direct"),
        ("google", None, "Other"),
        ("Google", "cpc", "Other"),
        ("(direct)", "cpc", "Direct"),
        ("partner", "(none)", "Direct"),
        ("partner", "referral", "Referral"),
        ("<Other>", "referral", "Referral"),
        ("<Other>", None, "Obfuscated"),
        ("(data deleted)", "x", "Obfuscated"),
        ("partner", "<Other>", "Obfuscated"),
        ("partner", "(data deleted)", "Obfuscated"),
        ("newsletter", "email", "Other"),
    ],
)
def test_channel_rules(spark, source, medium, channel):
    frame = spark.createDataFrame([(source, medium)], "source string, medium string")
    assert rows(frame.select(channel_label("source", "medium")))[0][0] == channel


def test_own_hosts_are_a_parameter(spark):
    frame = spark.createDataFrame([("mine.example", "referral")], "source string, medium string")
    label = channel_label("source", "medium", ["mine.example", "other.example"])
    assert rows(frame.select(label)) == [("Self-Referral",)]


def test_master_has_one_row_per_event_and_fills_missing_names(spark):
    events = raw(
        spark,
        {"session_id": 1, "source": "google"},
        {"session_id": 1},
        {"session_id": 2},
        {"session_id": None, "source": "fb"},
    )
    master = build_master(events)
    assert master.columns == S.MASTER_EVENTS.names
    assert [f.dataType for f in master.schema] == [f.dataType for f in S.MASTER_EVENTS]
    found = records(master, "event_id")
    assert len(found) == 4
    assert (found[1]["session_source"], found[1]["session_medium"]) == ("google", "unknown")
    assert found[1]["channel"] == "Other"
    assert found[1]["session_campaign"] is None
    assert found[2]["channel"] == "Unknown"
    assert found[3]["session_source"] == "unknown"
    assert found[0]["event_date"] == datetime.date(2020, 11, 1)


@pytest.mark.parametrize("hot_share", [0.0, 0.2, 0.5, 1.0])
def test_a_dominant_session_joins_like_any_other(spark, hot_share):
    many = [{"session_id": 7} for _ in range(40)] + [{"session_id": 7, "source": "google"}]
    silent = [{"session_id": 8} for _ in range(25)]
    few = [{"session_id": n, "source": f"s{n}"} for n in range(20, 30)]
    nowhere = [{"session_id": None} for _ in range(30)]
    events = raw(spark, *many, *silent, *few, *nowhere).repartition(5)
    dated = without_attribution(events)
    sessions = attribute_sessions(events)
    expected = dated.join(sessions, "session_id", "left").select(
        *dated.columns, "session_source", "session_medium", "session_campaign"
    )
    found = attach_sessions(dated, sessions, hot_share)
    assert found.columns == expected.columns
    assert sorted(rows(found), key=repr) == sorted(rows(expected), key=repr)


@pytest.mark.parametrize("hot_share", [0.001, 0.02, 0.05, 0.3, 0.9])
def test_crowded_buckets_hold_all_hot_sessions(spark, hot_share):
    sizes = {n: n for n in range(1, 25)} | {99: 200, None: 100}
    events = raw(spark, *[{"session_id": s} for s, rows_ in sizes.items() for _ in range(rows_)])
    limit = max(1, hot_share * sum(sizes.values()))
    buckets = math.ceil(4 / hot_share)
    keyed = spark.createDataFrame([(s,) for s in sizes if s is not None], "session_id long")
    place = dict(rows(keyed.select("session_id", F.pmod(F.xxhash64("session_id"), F.lit(buckets)))))
    counts = {}
    for session, rows_ in sizes.items():
        if session is not None:
            counts[place[session]] = counts.get(place[session], 0) + rows_
    expected = {(b, math.ceil(n / limit)) for b, n in counts.items() if n > limit}
    assert set(rows(crowded_buckets(events.repartition(3), hot_share))) == expected
    assert sum(salts for _, salts in expected) <= 2 / hot_share


def test_rows_of_a_hot_session_are_dealt_to_many_parts(spark):
    hot = [{"session_id": 7, "source": "google"} for _ in range(600)]
    nowhere = [{"session_id": None} for _ in range(600)]
    few = [{"session_id": n} for n in range(100, 700)]
    events = raw(spark, *hot, *nowhere, *few)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = attach_sessions(events, attribute_sessions(events), 0.02)
        sizes = rows(found.groupBy(F.spark_partition_id()).count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # A plain join has 600 rows in one task, twice.
    assert sum(n for _, n in sizes) == 1800 and max(n for _, n in sizes) < 250


@pytest.mark.parametrize("text", ["20201131", "2020-11-01", "x", "202011", "20201301", ""])
def test_bad_dates_fail(spark, text):
    frame = spark.createDataFrame([(text,)], "event_date string")
    with pytest.raises(Exception, match="(?i)cast|parse|date"):
        frame.select(parsed_date()).collect()


def test_dates_from_text_and_numbers(spark):
    day = datetime.date(2020, 2, 29)
    for value, kind in (("20200229", "string"), (20200229, "int"), (20200229, "bigint")):
        frame = spark.createDataFrame([(value,), (None,)], f"event_date {kind}")
        assert rows(frame.select(parsed_date())) == [(day,), (None,)]


def test_csv_keeps_text_and_reads_missing_texts_as_null(spark, tmp_path):
    tricky = ['say "hi", twice', " padded ", "a,b", "back\\slash", "(none)", "(not set)"]
    table = items(spark, *[{"item_name": n, "item_category": "NA"} for n in [*tricky, None]])
    write_csv_table(build_items(table), str(tmp_path / "items"))
    back = read_csv_table(spark, str(tmp_path / "items"), S.ITEMS_CLEAN)
    assert sorted(r["item_name"] or "" for r in back.collect()) == sorted([*tricky, ""])
    assert {r["item_category"] for r in back.collect()} == {None}
    assert {r["event_date"] for r in back.collect()} == {datetime.date(2020, 11, 1)}


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(
        "session_id,source,event_name,event_date,extra,event_id,user_pseudo_id,device_category,"
        "country,page_location,medium,campaign,revenue\n"
        '12.0,(none),purchase,20201101,x,1,5,desktop,nan,"https://a/?q=""1""",NULL,<NA>,1.5\n'
        ",null,view_item,20201102,x,2,,mobile,Greece,,,,\n"
    )
    table = read_csv_table(spark, str(path), S.RAW_EVENTS)
    assert table.schema.names == S.RAW_EVENTS.names
    first, second = sorted(table.collect(), key=lambda r: r["event_id"])
    assert (first["session_id"], first["source"], first["country"]) == (12, "(none)", None)
    assert (first["page_location"], first["medium"]) == ('https://a/?q="1"', None)
    assert (first["campaign"], first["revenue"]) == (None, 1.5)
    assert (second["session_id"], second["source"], second["revenue"]) == (None, None, None)


def test_csv_rejects_fractions_in_whole_numbers(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text(
        "event_date,session_id,item_name,item_category,item_revenue,quantity\n"
        "20201101,12.5,hat,Hats,1,1\n"
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv_table(spark, str(path), S.RAW_ITEMS).collect()


ITEM_HEAD = "event_date,session_id,item_name,item_category,item_revenue,quantity\n"


@pytest.mark.parametrize("row", ["20201101,1,hat,Hats,1", "20201101,1,hat,Hats,1,1,1", '20201101,1,"hat\ncap",Hats,1,1'])
def test_csv_rows_must_fit_the_header(spark, tmp_path, row):
    (tmp_path / "items.csv").write_text(ITEM_HEAD + "20201101,1,mug,Mugs,1,1\n" + row + "\n")
    for columns in (["item_name"], S.RAW_ITEMS.names):
        with pytest.raises(Exception, match="(?i)malformed"):
            read_csv_table(spark, str(tmp_path), S.RAW_ITEMS).select(columns).collect()


def test_csv_files_must_share_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(ITEM_HEAD + "20201101,1,mug,Mugs,1,1\n")
    (tmp_path / "b.csv").write_text(
        "event_date,session_id,item_category,item_name,item_revenue,quantity\n20201101,1,Mugs,mug,1,1\n"
    )
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_table(spark, str(tmp_path), S.RAW_ITEMS).collect()


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_derived_tables_are_whole(spark, scale):
    folder = f"/root/testdata/{scale}"
    whole = lambda name: spark.read.parquet(f"{folder}/{name}.parquet").count()
    for unmapped in (False, True):
        assert raw_events(spark, folder, unmapped).filter("event_name IS NOT NULL").count() == whole("events")
    items = raw_items(spark, folder)
    assert items.count() == whole("lineitem")
    assert 0 < items.filter("session_id IS NULL").count() < items.count()


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]", "yarn"])
def test_scratch_needs_a_shared_folder_on_a_cluster(master):
    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        scratch_path(session, "x")
    session.conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert scratch_path(session, "x").startswith("hdfs://shared/tillpath-x-")


def test_job_sizing(spark, tmp_path):
    (tmp_path / "a").write_text("x" * 1000)
    assert input_size(spark, str(tmp_path)) == 1000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    size_shuffles(spark, 10**13, 1.0)  # the session has a setting of its own
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert shuffle_partitions_for(10**14, 1.0) > 9 * shuffle_partitions_for(10**14, 0.1)


@pytest.mark.parametrize("rebalance", [False, True])
def test_master_is_stored_by_month_and_read_by_month(spark, tmp_path, rebalance):
    events = raw(
        spark,
        *[{"event_date": f"2020{m}{d}", "session_id": 1} for m in (11, 12) for d in (10, 20)],
    )
    path = str(tmp_path / "master")
    write_master(build_master(events), path, rebalance=rebalance)
    stored = read_table(spark, path)
    assert stored.count() == 4
    december = stored.filter(F.col(S.MONTH_FOLDER) == "2020-12")
    assert december.count() == 2
    scan = december._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({S.MONTH_FOLDER}" in scan


def test_plain_parquet_table(spark, tmp_path):
    table = items(spark, {"item_name": "hat"}, {"item_name": None})
    write_table(table, str(tmp_path / "t"))
    found = sorted(rows(read_table(spark, str(tmp_path / "t"))), key=repr)
    assert found == sorted(rows(table), key=repr)


@pytest.mark.parametrize(
    ("url", "page"),
    [
        ("https://shop.example.com/", "example.com"),
        ("http://www.Example.com", "example.com"),
        ("https://example.com/A/b/?q=1#top", "example.com/A/b"),
        ("https://example.com?next=http://other.com/", "example.com"),
        ("https://example.com//", "example.com"),
        ("/store.html", "/store.html"),
        ("https://shopping.example.com/x", "shopping.example.com/x"),
        (None, None),
    ],
)
def test_page_spellings(spark, url, page):
    frame = spark.createDataFrame([(url,)], "page_location string")
    assert rows(frame.select(normalized_page("page_location"))) == [(page,)]


def test_shuffle_partitions_grow_with_the_input():
    assert shuffle_partitions_for(1) == 8
    assert shuffle_partitions_for(100 * 10**12) > 40_000
