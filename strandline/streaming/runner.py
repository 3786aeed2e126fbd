"""Rules over a stream: the ordered layer as keyed state, and watermarks as plans."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators.engine import OUTPUT, Engine, Topology, event_of, rows_of
from ..plans.rule_text import Limits, Ruleset

FLUSH = "flush"


def run_stream(events: DataFrame, root: str, rules: Ruleset, catalog: Catalog, limits: Limits = Limits(), topology: Topology | None = None, live: bool = False) -> DataFrame:
    """What is new or changed in each root that a micro-batch touches (update mode): causes by their last confidence, problems, audit.

    A row of event_type "flush" decides all that waits in its root, as the end of the input does in batch.  Where events
    have a watermark on event_time (see event_time), a timer wakes a root when the stream's time has passed the end of the
    first window that waits there, so an anchor is decided without another row of its root.  State holds what windows can
    still reach, and the causes.
    """
    timed = "event_time" in events.columns

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        engine: Engine = pickle.loads(state.get[0]) if state.exists else Engine(rules, catalog, limits, topology, live)
        if state.hasTimedOut:
            engine.advance(state.getCurrentWatermarkMs())
        else:
            for row in pd.concat(list(parts)).sort_values(["time_ms", "event_id"]).itertuples(index=False):
                if row.event_type == FLUSH:
                    engine.finish()
                else:
                    engine.ingest(event_of(row))
        found = rows_of(str(key[0]), engine.drain())
        state.update((pickle.dumps(engine),))
        if timed and engine.waiting:
            state.setTimeoutTimestamp(max(engine.waiting[0][0], state.getCurrentWatermarkMs()) + 1)
        yield found

    return events.groupBy(root).applyInPandasWithState(step, OUTPUT, "engine binary", "update", "EventTimeTimeout" if timed else "NoTimeout")


def watermarks(events: DataFrame, slot: int, order: tuple[str, ...] = ("arrival",), time: str = "time_ms") -> DataFrame:
    """events with wm, the greatest time that has arrived with or before each row.

    order[0] is a number of arrival; rows are dealt into slots of it.  The greatest time of earlier slots is carried
    over by a window over one row a slot, so no task sees all rows.
    """
    rows = events.withColumn("_slot", F.floor(F.col(order[0]) / slot))
    inside = F.max(time).over(Window.partitionBy("_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    tops = rows.groupBy("_slot").agg(F.max(time).alias("_top")).withColumn("_group", F.floor(F.col("_slot") / 4096))
    groups = tops.groupBy("_group").agg(F.max("_top").alias("_all"))
    before = F.max("_all").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("_carry", before).select("_group", "_carry")
    own = F.max("_top").over(Window.partitionBy("_group").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.withColumn("_own", own).join(groups, "_group").select("_slot", F.greatest("_own", "_carry").alias("_past"))
    return rows.withColumn("_in", inside).join(tops, "_slot").withColumn("wm", F.greatest("_in", "_past")).drop("_slot", "_in", "_past")


def split_late(marked: DataFrame, lateness: int, before: Column, time: str = "time_ms") -> tuple[DataFrame, DataFrame]:
    """(in time, late): late is at or behind the watermark before the row, less the allowed lateness."""
    late = F.coalesce(F.col(time) <= before - lateness, F.lit(False))
    return marked.where(~late), marked.where(late)


def event_time(events: DataFrame, disorder: int, time: str = "time_ms") -> DataFrame:
    """events with a timestamp column that Structured Streaming can put a watermark on."""
    return events.withColumn("event_time", F.timestamp_millis(F.col(time))).withWatermark("event_time", f"{disorder} milliseconds")
