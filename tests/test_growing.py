"""A store that grows by batches holds what one made from all events holds."""

from __future__ import annotations

import random

import pytest

from tests.frames import items, raw, rows
from tests.test_store import cents
from tillpath import schema as S
from tillpath.__main__ import main
from tillpath.plans import growing
from tillpath.plans.growing import GrowingStore
from tillpath.plans.reports import REPORTS
from tillpath.plans.tables import Options, RawTables, StoredTables
from tillpath.sources import read_table, write_csv_table

REPORTED = ("master_events", "channel_attribution", "funnel_by_channel", "bounce_by_channel", "new_vs_returning")
REPORTED += ("channel_category", "source_value_counts", "attribution_coverage", "monthly_trend", "null_profile")


def made_up(seed, count=240):
    """Events with nulls in every column, repeated rows and a session with a third of them."""
    rng = random.Random(seed)

    def some(values, null=0.15):
        return None if rng.random() < null else rng.choice(values)

    out = [
        {
            "event_id": some(range(10_000), 0.02),
            "event_date": some(["20201105", "20201220", "20210110", "20210131"], 0.05),
            "event_name": some([event for event, _ in S.STAGES]),
            "user_pseudo_id": some(range(12)),
            "session_id": 1 if rng.random() < 0.33 else some(range(2, 30)),
            "device_category": some(["desktop", "mobile"]),
            "country": some(["Greece", "Chile"]),
            "page_location": some(["https://a/", "https://b/"]),
            "source": some(["google", "fb", "(direct)", S.OWN_HOSTS[0]], 0.6),
            "medium": some(["cpc", "referral"]),
            "campaign": some(["c1", "c2"]),
            "revenue": some([1.25, 10.0], 0.5),
        }
        for _ in range(count)
    ]
    return out + out[:7]


def sold(seed, count=60):
    rng = random.Random(seed)
    return [
        {"session_id": rng.choice([None, *range(1, 30)]), "item_category": rng.choice(["Hats", "Mugs", None]), "item_revenue": rng.randrange(9) / 2}
        for _ in range(count)
    ]


@pytest.mark.parametrize("options", [None, Options(("purchase",), ("fb",), session_key=("user_pseudo_id", "session_id"))])
@pytest.mark.parametrize("cuts", [(0, 80, 81, 247), (0, 0, 247)])
def test_batches_give_what_one_table_gives(spark, tmp_path, cuts, options):
    events, things = made_up(1), sold(2)
    shop = RawTables(raw(spark, *events), items(spark, *things), options)
    store = GrowingStore(spark, str(tmp_path), options)
    for number, (start, stop) in enumerate(zip(cuts, cuts[1:])):
        part = raw(spark, *events[start:stop]) if stop > start else raw(spark, {}).limit(0)
        store.add(f"b{number}", part, items(spark, *things[number :: len(cuts) - 1]))
    found = StoredTables(spark, str(tmp_path))
    assert found.master.columns == shop.master.columns
    assert sorted(found.sessions.columns) == sorted(shop.sessions.columns)
    for name in REPORTED:
        assert cents(rows(REPORTS[name](found))) == cents(rows(REPORTS[name](shop))), name


def files_by_month(spark, folder):
    out = {}
    for path in StoredTables(spark, folder).master.inputFiles():
        out.setdefault(path.split(f"{S.MONTH_FOLDER}=")[1].split("/")[0], set()).add(path)
    return out


def test_a_late_event_rewrites_the_months_of_its_session_only(spark, tmp_path):
    folder = str(tmp_path)
    store = GrowingStore(spark, folder)
    day = lambda date, session, **more: {"event_date": date, "session_id": session, **more}
    first = [
        day("20201105", 1, event_id=1),
        day("20201105", 2, event_id=2, source="fb", medium="referral"),
        day("20201210", 2, event_id=3),
        day("20210110", 3, event_id=4, source="google", medium="cpc"),
        day("20210210", 4, event_id=5),
    ]
    assert store.add("one", raw(spark, *first), items(spark)) == ["2020-11", "2020-12", "2021-01", "2021-02"]
    before = files_by_month(spark, folder)
    # Session 2 has events of November and December; its first source is now an earlier event's.
    late = [day("20210301", 2, event_id=0, event_name="add_to_cart", source="google", medium="organic")]
    assert store.add("two", raw(spark, *late), items(spark)) == ["2020-11", "2020-12", "2021-03"]
    after = files_by_month(spark, folder)
    assert {m for m in before if before[m] == after[m]} == {"2021-01", "2021-02"}
    channels = {r["event_id"]: r["channel"] for r in StoredTables(spark, folder).master.collect()}
    assert channels == {0: "Google Organic", 1: "Unknown", 2: "Google Organic", 3: "Google Organic", 4: "Google Paid", 5: "Unknown"}
    # A later event of the same session changes nothing that was written before.
    assert store.add("three", raw(spark, day("20210301", 2, event_id=9, source="x")), items(spark)) == ["2021-03"]


@pytest.mark.parametrize("step", ["write_master", "build_items"])
def test_a_batch_that_failed_is_added_again(spark, tmp_path, monkeypatch, step):
    events = made_up(3)
    store = GrowingStore(spark, str(tmp_path))
    store.add("one", raw(spark, *events[:100]), items(spark, *sold(4)))

    def fails(*args, **more):
        raise OSError("no space")

    with monkeypatch.context() as broken:
        broken.setattr(growing, step, fails)
        with pytest.raises(OSError, match="no space"):
            store.add("two", raw(spark, *events[50:]), items(spark))
    with pytest.raises(ValueError, match="batch two was not completed"):
        store.add("three", raw(spark, *events[100:]), items(spark))
    store.add("two", raw(spark, *events[100:]), items(spark))
    assert store.batches() == ["one", "two"]
    shop = RawTables(raw(spark, *events), items(spark, *sold(4)))
    found = StoredTables(spark, str(tmp_path))
    for name in REPORTED:
        assert cents(rows(REPORTS[name](found))) == cents(rows(REPORTS[name](shop))), name


def test_what_does_not_fit_is_refused(spark, tmp_path):
    store = GrowingStore(spark, str(tmp_path))
    store.add("one", raw(spark, {}), items(spark))
    with pytest.raises(ValueError, match="added before"):
        store.add("one", raw(spark, {}), items(spark))
    with pytest.raises(ValueError, match="name"):
        store.add("a/b", raw(spark, {}), items(spark))
    with pytest.raises(ValueError, match="other options"):
        GrowingStore(spark, str(tmp_path), Options(own_hosts=("x",)))
    with pytest.raises(ValueError, match="of earlier batches"):
        store.add("two", raw(spark, {}).drop("country"), items(spark))


def test_batches_from_the_command_line(spark, tmp_path, capsys):
    events = [e | {"event_id": n, "campaign": None} for n, e in enumerate(made_up(5, 60))]
    for n in (0, 1):
        write_csv_table(raw(spark, *events[n::2]), f"{tmp_path}/events{n}")
        write_csv_table(items(spark, {"session_id": n}), f"{tmp_path}/items{n}")
        main(["add", "--events", f"{tmp_path}/events{n}", "--items", f"{tmp_path}/items{n}", "--out", f"{tmp_path}/store", "--batch", f"day{n}"])
        assert f"added day{n}" in capsys.readouterr().out
    found = REPORTS["channel_value_counts"](StoredTables(spark, f"{tmp_path}/store"))
    shop = RawTables(raw(spark, *events), items(spark))
    assert rows(found) == rows(REPORTS["channel_value_counts"](shop))
    assert read_table(spark, f"{tmp_path}/store/batches").count() == 2
