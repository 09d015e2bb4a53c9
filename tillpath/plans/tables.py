"""The tables reports read: built on the fly from raw tables, or stored once and read back."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpath import schema as S
from tillpath.operators.distinct import distinct_sketches
from tillpath.operators.products import sold_per_session
from tillpath.plans.channel_mart import purchasing_sessions, session_mart
from tillpath.plans.prepare import build_items, build_master, without_attribution
from tillpath.sources import (
    BATCH_FOLDER,
    MONTH_FOLDER,
    read_bucketed,
    read_table,
    table_exists,
    write_bucketed,
    write_master,
    write_table,
)

MASTER = "master_events"
ITEMS = "items_clean"
SESSIONS = "session_mart"
RAW_EVENTS = "raw_events"
RAW_ITEMS = "raw_items"
OPTIONS = "options"
SOLD = "sold_per_session"
PURCHASES = "purchasing_sessions"
BUCKETS = "buckets"
SKETCHES = "distinct_sketches"


@dataclass(frozen=True)
class Options:
    """What a shop may define for itself; stored beside its tables, so reports can't disagree.

    ``priority`` lists event names from strongest to weakest for attribution, ``own_hosts`` the sources
    that are the shop's own, ``stages`` the funnel's events with their labels, and ``session_key`` the
    columns that identify a session.
    """

    priority: Sequence[str] | None = None
    own_hosts: Sequence[str] = S.OWN_HOSTS
    stages: Sequence[tuple[str, str]] = S.STAGES
    session_key: Sequence[str] = ("session_id",)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Options:
        given = json.loads(text)
        given["stages"] = [tuple(stage) for stage in given["stages"]]
        return cls(**given)


class RawTables:
    """Raw events and items; what a report needs beyond them becomes part of its own plan."""

    def __init__(
        self, raw_events: DataFrame, raw_items: DataFrame, options: Options | None = None
    ):
        self.raw_events = raw_events
        self.raw_items = raw_items
        self.options = options or Options()

    @cached_property
    def events(self) -> DataFrame:
        """Events for reports that look at no channel."""
        return without_attribution(self.raw_events)

    @cached_property
    def master(self) -> DataFrame:
        """Events with the channel of their session."""
        o = self.options
        return build_master(self.raw_events, o.priority, o.own_hosts, session_key=o.session_key)

    @cached_property
    def sessions(self) -> DataFrame:
        """One row per session with its channel."""
        o = self.options
        return session_mart(self.raw_events, o.priority, o.own_hosts, o.stages, o.session_key)

    @cached_property
    def items(self) -> DataFrame:
        """Items with a date."""
        return build_items(self.raw_items)

    @cached_property
    def sold(self) -> DataFrame:
        """Revenue and item rows of each session and category."""
        return sold_per_session(self.items)

    @cached_property
    def purchases(self) -> DataFrame:
        """Sessions with a purchase, with their channel and purchase rows."""
        return purchasing_sessions(self.sessions)

    @cached_property
    def sketches(self) -> DataFrame:
        """Sketches of each month's sessions and users."""
        return distinct_sketches(self.events, session_key=self.options.session_key)

    def landed(self, spark: SparkSession, folder: str, mode: str = "errorifexists") -> RawTables:
        """The same tables, written as Parquet below ``folder`` and read from there.

        Preparation passes over the events several times; text files should be parsed once.
        """
        write_table(self.raw_events, f"{folder}/{RAW_EVENTS}", mode=mode)
        write_table(self.raw_items, f"{folder}/{RAW_ITEMS}", mode=mode)
        return RawTables(
            read_table(spark, f"{folder}/{RAW_EVENTS}"),
            read_table(spark, f"{folder}/{RAW_ITEMS}"),
            self.options,
        )

    def store(self, folder: str, rebalance: bool = True, mode: str = "errorifexists") -> None:
        """Write master events, sessions, items and the options as Parquet below ``folder``."""
        spark = self.raw_events.sparkSession
        options = spark.range(1).select(F.lit(self.options.to_json()).alias("options"))
        write_table(options, f"{folder}/{OPTIONS}", mode=mode)
        write_master(self.master, f"{folder}/{MASTER}", rebalance, mode)
        write_table(self.sessions, f"{folder}/{SESSIONS}", mode=mode)
        write_table(self.items, f"{folder}/{ITEMS}", mode=mode)
        self.store_sales(folder, mode)
        write_table(self.sketches, f"{folder}/{SKETCHES}", mode=mode)

    def store_sales(self, folder: str, mode: str = "errorifexists") -> None:
        """Write what reports on channels and categories join, both parts bucketed by session.

        Both are summed per session first, so a session with a third of all items is a few rows.
        """
        spark = self.raw_items.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        write_bucketed(self.sold, f"{folder}/{SOLD}", "session_id", buckets, mode)
        write_bucketed(self.purchases, f"{folder}/{PURCHASES}", "session_id", buckets, mode)
        number = spark.range(1).select(F.lit(buckets).alias("buckets"))
        write_table(number, f"{folder}/{BUCKETS}", mode=mode)


class StoredSales:
    """The two tables that `RawTables.store_sales` wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        buckets = read_table(spark, f"{folder}/{BUCKETS}").first()[0]
        self.sold = read_bucketed(spark, f"{folder}/{SOLD}", "session_id", buckets)
        self.purchases = read_bucketed(spark, f"{folder}/{PURCHASES}", "session_id", buckets)


class StoredTables:
    """Tables that `RawTables.store` or `GrowingStore.add` wrote.

    Channel reports read the sessions, which are far fewer than the events; the attribution is not
    computed again. Reports on raw columns need the raw events, given or landed in the folder.
    """

    def __init__(self, spark: SparkSession, folder: str, raw_events: DataFrame | None = None):
        self._spark, self._folder = spark, folder
        landed = f"{folder}/{RAW_EVENTS}"
        self._landed_events = lambda: read_table(spark, landed).drop(MONTH_FOLDER, BATCH_FOLDER)
        self._raw_events = raw_events
        stored = read_table(spark, f"{folder}/{MASTER}")
        self.master = stored.drop(MONTH_FOLDER)
        self.sessions = read_table(spark, f"{folder}/{SESSIONS}")
        self.items = read_table(spark, f"{folder}/{ITEMS}").drop(BATCH_FOLDER)
        self.events = self.master
        self.options = Options.from_json(read_table(spark, f"{folder}/{OPTIONS}").first()[0])

    @cached_property
    def _sales(self) -> StoredSales | None:
        """Not in a store that grows by batches."""
        there = table_exists(self._spark, f"{self._folder}/{BUCKETS}")
        return StoredSales(self._spark, self._folder) if there else None

    @cached_property
    def sold(self) -> DataFrame:
        """Revenue and item rows of each session and category."""
        return sold_per_session(self.items) if self._sales is None else self._sales.sold

    @cached_property
    def purchases(self) -> DataFrame:
        """Sessions with a purchase, with their channel and purchase rows."""
        return purchasing_sessions(self.sessions) if self._sales is None else self._sales.purchases

    @cached_property
    def sketches(self) -> DataFrame:
        """Sketches of each month's sessions and users."""
        path = f"{self._folder}/{SKETCHES}"
        if table_exists(self._spark, path):
            return read_table(self._spark, path)
        return distinct_sketches(self.events, session_key=self.options.session_key)

    @cached_property
    def raw_events(self) -> DataFrame:
        """Raw events."""
        return self._landed_events() if self._raw_events is None else self._raw_events

    def register(self) -> None:
        """Name the tables for ``spark.sql``."""
        self.master.createOrReplaceTempView(MASTER)
        self.sessions.createOrReplaceTempView(SESSIONS)
        self.items.createOrReplaceTempView(ITEMS)


Tables = RawTables | StoredTables
