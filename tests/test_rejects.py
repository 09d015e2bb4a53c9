"""CSV files with faulty rows: the rows that fit, and the others with their reason."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from tillpath import schema as S
from tillpath.__main__ import main
from tillpath.plans.tables import StoredTables
from tillpath.sources import accepted, at_most, land_csv_judged, read_csv_judged, read_csv_table, reject_counts
from tillpath.sources.store import OPEN_FILES, open_folders

HEAD = "event_date,session_id,item_name,item_category,item_revenue,quantity"
FINE = ["20201101,1,mug,Mugs,1,1", '20201102,2.0,"a, ""b""",NA,2.5,1', ",,,,,"]
FAULTY = {
    "20201101,1,hat,Hats,1": "too few fields",
    "20201101": "too few fields",
    "20201101,1,hat,Hats,1,1,1": "too many fields",
    '20201101,1,"hat, cap",Hats,1,1,1': "too many fields",
    "20201101,1.5,hat,Hats,1,1": "session_id isn't bigint",
    "20201101,x,hat,Hats,y,1": "session_id isn't bigint",
    "20201101,1,hat,Hats,much,1": "item_revenue isn't double",
    "20201399,1,hat,Hats,1,1": "event_date isn't a day",
    "2020-11-01,1,hat,Hats,1,1": "event_date isn't a day",
}


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [*FINE, *FAULTY]
    (folder / "a.csv").write_text("\n".join([HEAD, *lines[::2]]) + "\n")
    (folder / "b.csv").write_text("\n".join([HEAD, *lines[1::2]]) + "\n")
    return folder


def test_every_row_is_accepted_or_has_its_reason(spark, files, tmp_path):
    landed = land_csv_judged(read_csv_judged(spark, str(files), S.RAW_ITEMS, ["event_date"]), str(tmp_path / "out"))
    rejected = landed.where("not __accepted").collect()
    assert {r["__text"]: r["__reason"] for r in rejected} == FAULTY
    assert {r["__file"].rsplit("/", 1)[1] for r in rejected} == {"a.csv", "b.csv"}
    assert landed.count() == len(FINE) + len(FAULTY)
    counts = {r["reason"]: r["n_rows"] for r in reject_counts(landed).collect()}
    assert counts == {reason: list(FAULTY.values()).count(reason) for reason in FAULTY.values()}


def test_accepted_rows_equal_the_strict_reader(spark, files, tmp_path):
    (tmp_path / "fine.csv").write_text("\n".join([HEAD, *FINE]) + "\n")
    strict = read_csv_table(spark, str(tmp_path / "fine.csv"), S.RAW_ITEMS)
    landed = land_csv_judged(read_csv_judged(spark, str(files), S.RAW_ITEMS, ["event_date"]), str(tmp_path / "out"))
    fits = accepted(landed)
    assert fits.schema == strict.schema
    assert sorted(fits.collect(), key=str) == sorted(strict.collect(), key=str)


def test_a_limit_on_rejected_rows(spark, files, tmp_path):
    landed = land_csv_judged(read_csv_judged(spark, str(files), S.RAW_ITEMS, ["event_date"]), str(tmp_path / "out"))
    assert at_most(landed, len(FAULTY)).count() == len(FINE)
    with pytest.raises(ValueError, match="too few fields: 2"):
        at_most(landed, len(FAULTY) - 1)


def test_no_rows_other_columns_and_clashing_ones(spark, tmp_path):
    (tmp_path / "none.csv").write_text(HEAD + "\n")
    landed = land_csv_judged(read_csv_judged(spark, str(tmp_path / "none.csv"), S.RAW_ITEMS), str(tmp_path / "out"))
    assert at_most(landed, 0).count() == 0 and reject_counts(landed).count() == 0
    (tmp_path / "more.csv").write_text(HEAD + ",colour\n" + FINE[0] + ",red\n")
    more = read_csv_judged(spark, str(tmp_path / "more.csv"), S.RAW_ITEMS, keep_others=True)
    assert [r["colour"] for r in more.collect()] == ["red"]
    (tmp_path / "clash.csv").write_text(HEAD + ",__reason\n" + FINE[0] + ",red\n")
    with pytest.raises(ValueError, match="__reason"):
        read_csv_judged(spark, str(tmp_path / "clash.csv"), S.RAW_ITEMS)


def test_prepare_with_faulty_rows(spark, files, tmp_path):
    events = tmp_path / "events.csv"
    events.write_text(
        ",".join(S.CSV_EVENTS.names) + "\n1,20201101,purchase,u1,1,desktop,Greece,https://a/,google,cpc,x,1.5\n2,never,purchase,u1,1,,,,,,,\n"
    )
    given = ["prepare", "--events", str(events), "--items", str(files)]
    main([*given, "--out", str(tmp_path / "store"), "--rejects", "9"])
    stored = StoredTables(spark, str(tmp_path / "store"))
    assert stored.master.count() == 1 and stored.items.count() == len(FINE)
    with pytest.raises(ValueError, match="more than 8 rows rejected"):
        main([*given, "--out", str(tmp_path / "other"), "--rejects", "8"])


LANDING = """
import sys
from tillpath import schema as S
from tillpath.session import builder
from tillpath.sources import land_csv_judged, read_csv_judged

folder = sys.argv[1]
logged = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{folder}/log", "spark.eventLog.compress": "false"}
logged |= {"spark.eventLog.rolling.enabled": "false", "spark.ui.enabled": "false"}
spark = builder("landing").master("local[1]").config(map=logged).getOrCreate()
land_csv_judged(read_csv_judged(spark, f"{folder}/in", S.RAW_ITEMS, ["event_date"]), f"{folder}/out")
spark.stop()
"""


def test_landing_sorts_no_rows(tmp_path):
    """A task that writes both folders holds none of its rows in memory, however long its part of the input is."""
    (tmp_path / "in").mkdir()
    (tmp_path / "log").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([HEAD, *[*FINE[:2], *FAULTY] * 500]) + "\n")
    root = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", LANDING, str(tmp_path)], cwd=root, check=True, timeout=300)
    (log,) = (tmp_path / "log").iterdir()
    told = [json.loads(line) for line in log.read_text().splitlines()]
    ended = [e["Task Metrics"] for e in told if e["Event"] == "SparkListenerTaskEnd"]
    written = [m["Output Metrics"]["Records Written"] for m in ended]
    assert max(written) == 500 * (2 + len(FAULTY))
    assert max(m["Peak Execution Memory"] for m in ended) == 0
    folders = [path for path in (tmp_path / "out").iterdir() if path.is_dir()]
    assert sorted(len(list(path.glob("*.parquet"))) for path in folders) == [1, 1]


@pytest.mark.parametrize("before", [None, "7"])
def test_open_folders_leaves_the_setting_as_it_was(spark, before):
    if before is not None:
        spark.conf.set(OPEN_FILES, before)
    try:
        with pytest.raises(RuntimeError), open_folders(spark, 2):
            assert spark.conf.get(OPEN_FILES) == (before or "3")
            raise RuntimeError
        assert spark.conf.get(OPEN_FILES, None) == before
    finally:
        spark.conf.unset(OPEN_FILES)
