"""A store that takes new events batch by batch and rewrites only the months that they change."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpath.functions import month_label
from tillpath.operators.attribution import attach_sessions, fill_missing, group_channels
from tillpath.operators.state import (
    NO_MONTH,
    attributes,
    merged,
    months_to_rewrite,
    session_attributes,
    session_state,
)
from tillpath.plans.prepare import build_items, parsed_date, without_attribution, without_clashes
from tillpath.plans.tables import ITEMS, MASTER, OPTIONS, RAW_EVENTS, SESSIONS, Options
from tillpath.sources import (
    BATCH_FOLDER,
    MONTH_FOLDER,
    read_table,
    table_exists,
    write_master,
    write_table,
)

STATE = "session_state"
BATCHES = "batches"
BEGUN = "batch_begun"
FEW_NAMES = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


class GrowingStore:
    """Stored tables below ``folder`` that `add` extends; `StoredTables` reads them.

    Raw events are kept by batch and month, the state of every session is kept merged, and the master events follow from the
    two. An event may come late and change the channel of a session whose other events
    are old: then the months of that session are made again, and no others. Each step replaces what it
    writes as a whole, and the batch is entered last, so a batch that failed midway is simply added again.
    """

    def __init__(self, spark: SparkSession, folder: str, options: Options | None = None):
        self.spark, self.folder = spark, folder
        path = f"{folder}/{OPTIONS}"
        if table_exists(spark, path):
            stored = read_table(spark, path).first()[0]
            if options is not None and options.to_json() != stored:
                raise ValueError(f"the store at {folder} has other options")
            self.options = Options.from_json(stored)
        else:
            self.options = options or Options()
            given = spark.range(1).select(F.lit(self.options.to_json()).alias("options"))
            write_table(given, path)

    def batches(self) -> list[str]:
        """Names of the batches that were added, in their order."""
        path = f"{self.folder}/{BATCHES}"
        if not table_exists(self.spark, path):
            return []
        return [r["batch"] for r in read_table(self.spark, path).orderBy("number").collect()]

    def add(self, batch: str, raw_events: DataFrame, raw_items: DataFrame) -> list[str]:
        """Add events and items that no earlier batch has; returns the months that were written.

        Months are calendar months, so there are few of them on the driver.
        """
        if not FEW_NAMES.fullmatch(batch):
            raise ValueError(f"a batch's name has letters, digits and _ . - only, not {batch!r}")
        earlier = self.batches()
        if batch in earlier:
            raise ValueError(f"batch {batch} was added before")
        self._begin(batch, earlier)
        o = self.options
        landed = self._landed(batch, raw_events, bool(earlier))
        month = F.coalesce(month_label(parsed_date()), F.lit(NO_MONTH))
        added = session_state(landed, month, o.priority, o.stages, o.session_key)

        # Two folders by turns: the one read stays until the other is complete.
        number = len(earlier)
        path = f"{self.folder}/{STATE}/{number % 2}"
        before = read_table(self.spark, f"{self.folder}/{STATE}/{(number + 1) % 2}") if earlier else None
        write_table(merged([before, added] if earlier else [added]), path, mode="overwrite")
        state = read_table(self.spark, path)

        months = landed.select(month.alias("month")).distinct()
        if earlier:
            months = months.union(months_to_rewrite(before, added)).distinct()
        written = sorted(r["month"] for r in months.collect())
        self._rewrite(state, written)
        mart = state.select(*[c for c in state.columns if c != "months" and not c.startswith("first_")], *attributes(state))
        write_table(group_channels(fill_missing(mart), o.own_hosts), f"{self.folder}/{SESSIONS}", mode="overwrite")
        write_table(build_items(raw_items), f"{self.folder}/{ITEMS}/{BATCH_FOLDER}={batch}", mode="overwrite")
        entry = self.spark.createDataFrame([(number, batch)], "number int, batch string")
        write_table(entry.coalesce(1), f"{self.folder}/{BATCHES}", mode="append")
        return written

    def _begin(self, batch: str, earlier: list[str]) -> None:
        """Note the batch, so that after a failure no other one is added before it."""
        path = f"{self.folder}/{BEGUN}"
        begun = read_table(self.spark, path).first()[0] if table_exists(self.spark, path) else batch
        if begun != batch and begun not in earlier:
            raise ValueError(f"batch {begun} was not completed; add it again first")
        entry = self.spark.createDataFrame([(batch,)], "batch string")
        write_table(entry.coalesce(1), path, mode="overwrite")

    def _landed(self, batch: str, raw_events: DataFrame, more: bool) -> DataFrame:
        """The batch's events, stored by month and read from there."""
        events = without_clashes(raw_events)
        path = f"{self.folder}/{RAW_EVENTS}"
        if more and table_exists(self.spark, path):
            known = set(read_table(self.spark, path).columns) - {MONTH_FOLDER, BATCH_FOLDER}
            if set(events.columns) != known:
                raise ValueError(f"columns {sorted(events.columns)} against {sorted(known)} of earlier batches")
        month = F.coalesce(month_label(parsed_date()), F.lit(NO_MONTH))
        dated = events.withColumn(MONTH_FOLDER, month).hint("rebalance", MONTH_FOLDER)
        own = f"{path}/{BATCH_FOLDER}={batch}"
        write_table(dated, own, [MONTH_FOLDER], "overwrite")
        # Earlier batches are not listed; a batch without events has no file to take the columns from.
        return self.spark.read.schema(events.schema).parquet(own)

    def _rewrite(self, state: DataFrame, months: list[str]) -> None:
        """Make the master events of the given months again, from all batches."""
        if not months:
            return
        o = self.options
        raw = read_table(self.spark, f"{self.folder}/{RAW_EVENTS}")
        raw = raw.filter(F.col(MONTH_FOLDER).isin(months)).drop(MONTH_FOLDER, BATCH_FOLDER)
        of_months = state.filter(F.arrays_overlap("months", F.array(*map(F.lit, months))))
        sessions = session_attributes(of_months, o.session_key)
        joined = attach_sessions(without_attribution(raw), sessions, session_key=o.session_key)
        master = group_channels(fill_missing(joined), o.own_hosts)
        write_master(master, f"{self.folder}/{MASTER}", mode="overwrite", only_given=True)
