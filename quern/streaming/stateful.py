"""Stateful operators on streams: what the batch operators carry along ordered lines or events is kept in a state store
and goes on from one micro-batch to the next.

Lines of a file have to arrive in their order from batch to batch; within a batch they are put in order. A key's rows of
one batch are held in memory, so the source's batch size bounds them. The state store has to be RocksDB (`STORE`).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from quern.functions.scalars import resolve_date
from quern.operators.reports import DATE_LINE, FIRST_DATE, sheet_fields

#: The state store that these operators need, as a setting of the session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_store(spark: SparkSession) -> None:
    spark.conf.set(*STORE)


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


class _LastDate(StatefulProcessor):
    """Carries the last date line of a file."""

    def __init__(self, file: str, number: str, text: str):
        self.names = file, number, text

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "raw string")

    def handleInputRows(self, key, rows, timerValues):
        file, number, text = self.names
        frame = _in_order(rows, number)
        raw = self.last.get()[0] if self.last.exists() else FIRST_DATE
        frame["raw"] = frame["heading"].where(frame["heading"].notna()).ffill().fillna(raw)
        if frame["heading"].notna().any():
            self.last.update((frame["raw"].iloc[-1],))
        kept = frame[frame["heading"].isna() & frame["filled"]]
        yield pd.DataFrame({"raw": kept["raw"], file: key[0], number: kept[number], text: kept[text]})


def dated_lines(lines: DataFrame, file: str = "file", number: str = "line_num", text: str = "text") -> DataFrame:
    """The stream of reports.dated_lines: every note line with the date line above it in its file, whichever batch that
    came in. Lines before a file's first date belong to 1900-01-01."""
    marked = lines.select(file, number, text, F.when(F.col(text).rlike(DATE_LINE), F.trim(text)).alias("heading"), F.coalesce(F.trim(text) != "", F.lit(False)).alias("filled"))
    schema = StructType([StructField("raw", StringType()), *(lines.schema[c] for c in (file, number, text))])
    out = marked.groupBy(file).transformWithStateInPandas(_LastDate(file, number, text), schema, "append", "none")
    return out.select(resolve_date(F.col("raw")).alias("date"), "raw", file, number, text)


class _OpenDay(StatefulProcessor):
    """Carries the week, the day and the day's sums of a sheet."""

    def __init__(self, file: str, number: str):
        self.names = file, number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "week long, day_num long, day string, hours double, stated double, weekly boolean, lines long")

    def handleInputRows(self, key, rows, timerValues):
        file, number = self.names
        week, day_num, day, hours, stated, weekly, lines = self.open.get() if self.open.exists() else (0, 0, None, None, None, False, 0)
        out = []

        def told():
            if day_num:
                out.append((key[0], week, day_num, day, hours, stated, lines))

        for row in _in_order(rows, number).itertuples(index=False):
            if weekly or isinstance(row.name, str):  # a week ends after its line, a day begins with its own
                told()
                week, day_num = week + bool(weekly), day_num + isinstance(row.name, str)
                day, hours, stated, weekly = None, None, None, False
            day = day if day is not None or not isinstance(row.name, str) else row.name
            hours = hours if pd.isna(row.hours) else (hours or 0.0) + row.hours
            stated = stated if pd.isna(row.stated) else max(stated, row.stated) if stated is not None else row.stated
            weekly, lines = bool(row.weekly), lines + 1
        told()
        self.open.update((week, day_num, day, hours, stated, weekly, lines))
        yield pd.DataFrame(out, columns=[file, "week", "day_num", "day", "hours", "stated", "lines"])


def timesheet(lines: DataFrame, number: str = "line_num", text: str = "text", file: str = "file") -> DataFrame:
    """The stream of reports.timesheet, in update mode: (file, week, day_num, day, hours, stated, matches, lines), where
    a day is told again as long as its lines come in; the row of most `lines` holds, see latest_days."""
    fields = sheet_fields(lines, text).select(file, number, "name", "hours", "stated", "weekly")
    schema = StructType([lines.schema[file], *StructType.fromDDL("week long, day_num long, day string, hours double, stated double, lines long")])
    out = fields.groupBy(file).transformWithStateInPandas(_OpenDay(file, number), schema, "update", "none")
    hours = F.round("hours", 2)
    return out.select(file, "week", "day_num", "day", hours.alias("hours"), "stated", (F.col("stated").isNull() | (F.abs(hours - F.col("stated")) < 0.005)).alias("matches"), "lines")


def latest_days(told: DataFrame, file: str = "file") -> DataFrame:
    """What holds of the days that a timesheet stream has told."""
    rest = [c for c in told.columns if c not in (file, "week", "day_num", "lines")]
    best = told.groupBy(file, "week", "day_num").agg(F.max_by(F.struct(*rest), "lines").alias("x"))
    return best.select(file, "week", "day_num", "x.*")


class _LastValue(StatefulProcessor):
    """Carries a series' last value, the next point of its grid and the events after it."""

    def __init__(self, key: str, step: int, initial: float):
        self.key, self.step, self.initial = key, step, initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grid = handle.getValueState("grid", "next long, value double")
        self.waiting = handle.getMapState("waiting", "ts long", "value double")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for ts, value in zip(frame["ts"].tolist(), frame["value"].tolist(), strict=True):
                known = self.waiting.getValue((ts,))[0] if self.waiting.containsKey((ts,)) else None
                new = None if pd.isna(value) else value
                self.waiting.updateValue((ts,), (new if known is None else known if new is None else max(known, new),))
        # A timer is due once the watermark has passed it: every waiting event gets its turn then.
        for (ts,) in list(self.waiting.keys()):
            self.handle.registerTimer(ts * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = expiredTimerInfo.getExpiryTimeInMs() // 1000
        due = sorted((ts, v) for (ts,), (v,) in list(self.waiting.iterator()) if ts <= until)
        out = []
        if due:
            following, value = self.grid.get() if self.grid.exists() else (due[0][0], self.initial)
            for ts, new in due:
                while following < ts:  # points before this event have the value before it
                    out.append((key[0], following, value))
                    following += self.step
                value = value if new is None else new
                if following == ts:
                    out.append((key[0], following, value))
                    following += self.step
                self.waiting.removeKey((ts,))
            self.grid.update((following, value))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "t", "value"])


def resample(events: DataFrame, key: str, ts: str, value: str, step: int, late: str, initial: float = 0.0) -> DataFrame:
    """The stream of timeseries.resample: (key, t, value) on a grid from a series' first event to its last one so far;
    each point has the last value at or before it. Points are told once the watermark, `late` behind the newest event of
    all series, has passed the event that settles them; events later than that are dropped. Times are in whole seconds,
    of equal ones the greatest value counts."""
    rows = events.withWatermark(ts, late).select(key, F.col(ts).alias("at"), F.col(ts).cast("long").alias("ts"), F.col(value).cast("double").alias("value"))
    schema = StructType([events.schema[key], *StructType.fromDDL("t long, value double")])
    return rows.groupBy(key).transformWithStateInPandas(_LastValue(key, step, initial), schema, "append", "eventTime")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
