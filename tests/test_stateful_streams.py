import os

import pytest

from quern.operators import reports, timeseries
from quern.streaming import stateful

NOTES = ["before any date", "Thu 13 Nov 2014", "first note", "", "second note", "14 Nov 2014", "15 Nov 2014", "third", "Mon 2 Feb 2015", "last"]
SHEET = ["# a comment", "Mon", "9:00 11:30 reading", "13:00 14:00 mail", "hours: 3.5", "Tue", "8:00 9:00 tests", "hours: 2", "weekly: 5.5", "10:00 10:30 late", "Wed", "9:15 10:00 plans", "Thu", "weekly: 1", "Fri", "7:00 8:00 run"]


@pytest.fixture(scope="module")
def store(spark):
    old = spark.conf.get(stateful.STORE[0])
    stateful.use_store(spark)
    yield spark
    spark.conf.set(stateful.STORE[0], old)


def run(spark, batches, schema, operator, tmp_path, mode="append"):
    """The stream's rows for batches of rows, one file and one micro-batch each."""
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate(batches):
        path = source / f"{k:04}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.rename(path / part, source / f"{k:04}.parquet")
        os.utime(source / f"{k:04}.parquet", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(source))
    found = []
    query = operator(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, k: found.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    return found


def cut_everywhere(lines):
    """Two batches of numbered lines: of file k the first k lines come first, the rest later, in reversed order."""
    first = [(str(k), i, x) for k in range(len(lines) + 1) for i, x in enumerate(lines) if i < k]
    rest = [(str(k), i, x) for k in range(len(lines) + 1) for i, x in enumerate(lines) if i >= k]
    return [first, rest[::-1]]


LINES = "file string, line_num int, text string"


def test_dates_are_carried_over_every_cut(store, tmp_path):
    batches = cut_everywhere(NOTES)
    found = run(store, batches, LINES, stateful.dated_lines, tmp_path)
    expected = reports.dated_lines(store.createDataFrame([r for b in batches for r in b], LINES))
    assert sorted(found, key=str) == sorted(map(tuple, expected.collect()), key=str) and len(found) == 11 * 5


def test_line_by_line(store, tmp_path):
    lines = [[("a", i, x)] for i, x in enumerate(NOTES)]
    found = run(store, lines, LINES, stateful.dated_lines, tmp_path)
    assert sorted(found, key=str) == sorted(map(tuple, reports.dated_lines(store.createDataFrame([r for b in lines for r in b], LINES)).collect()), key=str)


def test_sheets_go_on_over_every_cut(store, tmp_path):
    batches = cut_everywhere(SHEET)
    told = run(store, batches, LINES, stateful.timesheet, tmp_path, "update")
    names = "file string, week long, day_num long, day string, hours double, stated double, matches boolean, lines long"
    held = stateful.latest_days(store.createDataFrame(told, names)).select("file", "week", "day_num", "day", "hours", "stated", "matches")
    expected = reports.timesheet(store.createDataFrame([r for b in batches for r in b], LINES))
    assert sorted(map(str, (tuple(r) for r in held.collect()))) == sorted(map(str, (tuple(r) for r in expected.collect())))
    assert len(told) > held.count()  # open days are told again


def test_values_are_carried_over_every_cut(store, tmp_path):
    events = [(1000, 1.0), (1060, 2.0), (1065, 5.0), (1200, None), (1320, 3.0), (1320, 4.0), (1390, 7.0)]
    batches = [[(str(k), t, v) for k in range(len(events) + 1) for i, (t, v) in enumerate(events) if (i < k) == early] for early in (True, False)]
    rows = [b + [("end", 5000 * (k == 2) + 1000, 0.0)] for k, b in enumerate([*batches, []])]
    schema = "k string, s long, v double"
    found = run(store, rows, schema, lambda d: stateful.resample(d.selectExpr("k", "timestamp_seconds(s) as at", "v"), "k", "at", "v", 60, "10 minutes"), tmp_path)
    series = store.createDataFrame([r for b in batches for r in b], schema).selectExpr("k", "s as ts", "v as value")
    expected = timeseries.resample(series, "k", 60)
    assert sorted(r for r in found if r[0] != "end") == sorted(map(tuple, expected.collect())) and len(found) >= 8 * 7
