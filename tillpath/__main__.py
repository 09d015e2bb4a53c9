"""Prepare a shop's tables, or print or store one of its reports.

    python -m tillpath prepare --events dataset.csv --items items.csv --out store
    python -m tillpath add --events day.csv --items day_items.csv --out store --batch 2021-01-31
    python -m tillpath report channel_attribution --store store
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession

from tillpath import schema as S
from tillpath.plans.growing import GrowingStore
from tillpath.plans.reports import REPORTS
from tillpath.plans.tables import ITEMS, MASTER, Options, RawTables, StoredTables
from tillpath.session import builder, input_size, size_shuffles
from tillpath.sources import (
    at_most,
    land_csv_judged,
    read_csv_judged,
    read_csv_table,
    read_table,
    write_csv_table,
    write_table,
)


PREPARE_SHARE, REPORT_SHARE = 1.0, 0.1
"""Part of the input that a command shuffles: nearly all columns of all rows, or merged rows."""


PARSED = "parsed"
"""Folders below the store with a command's parsed rows: those that fit, and rejected ones with reason, text and file."""


def _read(spark: SparkSession, name: str, table, given: argparse.Namespace) -> DataFrame:
    path = getattr(given, name)
    if given.format == "parquet":
        return read_table(spark, path)
    if given.rejects is None:
        return read_csv_table(spark, path, table, given.multiline, keep_others=True)
    judged = read_csv_judged(spark, path, table, ["event_date"], given.multiline, keep_others=True)
    return at_most(land_csv_judged(judged, f"{given.out}/{PARSED}_{uuid.uuid4().hex}/{name}"), given.rejects)


def _options(given: argparse.Namespace) -> Options:
    out = {"session_key": tuple(given.session_key.split(","))}
    if given.own_host:
        out["own_hosts"] = tuple(given.own_host)
    if given.priority:
        out["priority"] = tuple(given.priority.split(","))
    if given.stage:
        out["stages"] = tuple(tuple(stage.split("=", 1)) for stage in given.stage)
    return Options(**out)


def _input_arguments(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--events", required=True)
    parser.add_argument("--items", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--multiline", action="store_true", help="CSV has quoted line breaks")
    parser.add_argument(
        "--rejects", type=int, help="go on with up to so many faulty CSV rows per table; without it the first one fails the job"
    )
    parser.add_argument("--own-host", action="append", help="a source that is the shop itself")
    parser.add_argument("--priority", help="events for attribution, strongest first, by commas")
    parser.add_argument(
        "--session-key", default="session_id", help="columns that identify a session, by commas"
    )
    parser.add_argument(
        "--stage", action="append", metavar="EVENT=LABEL", help="a funnel stage; give all in order"
    )


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tillpath", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    prepare = commands.add_parser("prepare", help="raw tables to stored tables")
    _input_arguments(prepare)
    prepare.add_argument("--csv-copy", action="store_true", help="also write the tables as CSV")
    prepare.add_argument(
        "--in-date-order",
        action="store_true",
        help="skip the shuffle that gives few, even files per month",
    )
    add = commands.add_parser("add", help="new raw rows to a growing store, which the first batch starts")
    _input_arguments(add)
    add.add_argument("--batch", required=True, help="a name for these rows; a failed batch is added again")
    report = commands.add_parser("report", help="one report on stored tables")
    report.add_argument("name", choices=sorted(REPORTS))
    report.add_argument("--store", required=True)
    report.add_argument("--raw-events", help="raw events in Parquet, if not landed in the store")
    report.add_argument("--out", help="folder for the rows; without it they are printed")
    report.add_argument("--rows", type=int, help="print so many rows at most; else all")
    report.add_argument("--format", choices=["csv", "parquet"], default="csv")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    options = _arguments(given)
    spark = builder().getOrCreate()
    if options.command == "prepare":
        size_shuffles(spark, input_size(spark, options.events, options.items), PREPARE_SHARE)
        raw = RawTables(
            _read(spark, "events", S.CSV_EVENTS, options),
            _read(spark, "items", S.RAW_ITEMS, options),
            _options(options),
        )
        if options.format == "csv":
            raw = raw.landed(spark, options.out)
        raw.store(options.out, rebalance=not options.in_date_order)
        if options.csv_copy:
            stored = StoredTables(spark, options.out)
            write_csv_table(stored.master, f"{options.out}/{MASTER}_csv")
            write_csv_table(stored.items, f"{options.out}/{ITEMS}_csv")
        return
    if options.command == "add":
        size_shuffles(spark, input_size(spark, options.events, options.items), PREPARE_SHARE)
        events = _read(spark, "events", S.CSV_EVENTS, options)
        sold = _read(spark, "items", S.RAW_ITEMS, options)
        months = GrowingStore(spark, options.out, _options(options)).add(options.batch, events, sold)
        print(f"added {options.batch}; months written: {' '.join(months)}")
        return
    size_shuffles(spark, input_size(spark, options.store), REPORT_SHARE)
    raw_events = None if options.raw_events is None else read_table(spark, options.raw_events)
    rows = REPORTS[options.name](StoredTables(spark, options.store, raw_events))
    if options.out is None:
        # Reports are small; one that is not should get --rows or --out.
        rows.show(rows.count() if options.rows is None else options.rows, truncate=False)
    elif options.format == "csv":
        write_csv_table(rows, options.out)
    else:
        write_table(rows, options.out)


if __name__ == "__main__":
    main()
