"""Reports over semi-structured lines: dated notes, time sheets, section listings, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import clock_hours, resolve_date
from quern.operators.graph import checkpoint_dir

DATE_LINE = r"^\s*((?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+)?[0-9]{1,2}\s+(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{2,4}\s*$"

#: The date of lines before a file's first date line.
FIRST_DATE = "1 Jan 1900"


def dated_lines(lines: DataFrame, file: str = "file", number: str = "line_num", text: str = "text") -> DataFrame:
    """(date, raw, file, line_num, text): every note line with the date line above it in the same file, one row a line,
    so that any number of notes of a day is fine; sorted by the caller as needed. Lines before a file's first date
    belong to 1900-01-01."""
    w = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    is_date = F.col(text).rlike(DATE_LINE)
    at = lines.withColumn("raw", F.coalesce(F.last(F.when(is_date, F.trim(text)), ignorenulls=True).over(w), F.lit(FIRST_DATE)))
    return at.where(~is_date & (F.trim(text) != "")).select(resolve_date(F.col("raw")).alias("date"), "raw", file, number, text)


def merge_notes(lines: DataFrame, file: str = "file", number: str = "line_num", text: str = "text") -> DataFrame:
    """(date, raw, notes): dated_lines gathered into one text a date, which therefore has to fit into a row.
    Lines before a file's first date belong to 1900-01-01."""
    grouped = dated_lines(lines, file, number, text).groupBy("date", "raw").agg(F.array_sort(F.collect_list(F.struct(file, number, text))).alias("n"))
    return grouped.select("date", "raw", F.array_join(F.transform("n", lambda x: x[text]), "\n").alias("notes"))


def timesheet(lines: DataFrame, number: str = "line_num", text: str = "text", file: str = "file") -> DataFrame:
    """(file, week, day_num, day, hours, stated, matches): hours of the `start end task` lines of each day of a sheet,
    against a stated `hours: n`. `day` lines begin with a weekday's name; a `weekly: n` line ends a week. Sheets are
    read side by side, each in the order of its lines; lines without a column `file` are one sheet."""
    days = _sheet_days(lines, number, text, file).where("d > 0")
    return days.select(file, "week", F.col("d").alias("day_num"), "day", "hours", "stated", (F.col("stated").isNull() | (F.abs(F.col("hours") - F.col("stated")) < 0.005)).alias("matches"))


#: Line numbers of a block, in which a task counts a sheet's days and weeks.
SHEET_BLOCK = 1 << 18


def _sheet_days(lines: DataFrame, number: str, text: str, file: str, block: int = SHEET_BLOCK) -> DataFrame:
    """(file, week, d, day, hours, stated, w, t): the days of the sheets with what their lines state of the day, the week
    (w) and the sheet (t); d is 0 before the first day. Days and weeks are counted inside blocks of lines, then over the
    blocks, so that a long sheet is no hot key."""
    lines = lines if file in lines.columns else lines.withColumn(file, F.lit(""))
    said = lambda word: F.regexp_extract(text, rf"(?i)^\s*{word}:\s*([0-9]+(\.[0-9]+)?)", 1).try_cast("double")
    fields = sheet_fields(lines, text).select(file, F.col(number).alias("__n"), F.floor(F.col(number) / block).alias("__b"), "name", "hours", "stated", F.col("weekly").cast("int").alias("__w"), F.col("name").isNotNull().cast("int").alias("__d"), said("weekly").alias("w"), said("total").alias("t"))
    blocks = Window.partitionBy(file).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = fields.groupBy(file, "__b").agg(F.sum("__w").alias("__w"), F.sum("__d").alias("__d"))
    offsets = counts.select(F.col(file).alias("__file"), F.col("__b").alias("__at"), *[F.coalesce(F.sum(c).over(blocks), F.lit(0)).alias(f"{c}0") for c in ("__w", "__d")])  # a row a block
    inside = Window.partitionBy(file, "__b").orderBy("__n")
    week = F.coalesce(F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    day = F.sum("__d").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = fields.withColumn("week", week).withColumn("d", day).join(offsets, F.col(file).eqNullSafe(F.col("__file")) & F.col("__b").eqNullSafe(F.col("__at")))
    placed = numbered.withColumn("week", F.col("week") + F.col("__w0")).withColumn("d", F.col("d") + F.col("__d0"))
    return placed.groupBy(file, "week", "d").agg(F.max("name").alias("day"), F.round(F.sum("hours"), 2).alias("hours"), F.max("stated").alias("stated"), F.max("w").alias("w"), F.max("t").alias("t"))


def sheet_fields(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines without comments and empty ones, with what each says: name (of a weekday), hours (of a slot), stated (hours
    of a day), weekly (whether it ends a week)."""
    slot = r"^\s*([0-9]{1,2}(?::[0-9]{2})?)\s+([0-9]{1,2}(?::[0-9]{2})?)\b"
    at = lines.where(~F.col(text).rlike(r"^\s*([#;]|$)"))
    at = at.withColumn("name", F.lower(F.nullif(F.regexp_extract(text, r"^(?i)\s*(mon|tue|wed|thu|fri|sat|sun)", 1), F.lit(""))))
    at = at.withColumn("hours", F.when(F.col(text).rlike(slot), clock_hours(F.regexp_extract(text, slot, 1), F.regexp_extract(text, slot, 2))))
    at = at.withColumn("stated", F.regexp_extract(text, r"(?i)^\s*hours:\s*([0-9.]+)", 1).try_cast("double"))
    return at.withColumn("weekly", F.col(text).rlike(r"(?i)^\s*weekly:"))


def sheet_messages(lines: DataFrame, number: str = "line_num", text: str = "text", file: str = "file") -> DataFrame:
    """(file, level, part, hours, stated, message): what the lines `hours: n`, `weekly: n` and `total: n` of a sheet state
    against the sums of its slots, where they differ; part is the number of the day or week, 0 for the whole sheet. Lines
    that state no number say nothing; of several the largest counts."""
    checkpoint_dir(lines.sparkSession)
    parts = _sheet_days(lines, number, text, file).checkpoint()  # a row a day; read three times below
    by_day = parts.where("d > 0").select(file, F.lit("day").alias("level"), F.col("d").cast("long").alias("part"), "hours", "stated")
    summed = lambda keys, said: parts.groupBy(*keys).agg(F.sum(F.when(F.col("d") > 0, F.col("hours"))).alias("hours"), F.max(said).alias("stated"), F.count_if(F.col("d") > 0).alias("days")).where("days > 0")
    weeks, sheets = summed([file, "week"], "w"), summed([file], "t")
    every = by_day.unionByName(weeks.select(file, F.lit("week").alias("level"), F.col("week").cast("long").alias("part"), "hours", "stated"))
    every = every.unionByName(sheets.select(file, F.lit("sheet").alias("level"), F.lit(0).cast("long").alias("part"), "hours", "stated"))
    wrong = every.withColumn("hours", F.round(F.coalesce("hours", F.lit(0.0)), 2)).where(F.abs(F.col("hours") - F.col("stated")) >= 0.005)
    message = F.concat_ws(" ", "level", F.when(F.col("level") != "sheet", F.col("part").cast("string")), F.lit("has"), F.col("hours").cast("string"), F.lit("hours,"), F.col("stated").cast("string"), F.lit("stated"))
    return wrong.select(file, "level", "part", "hours", "stated", message.alias("message"))


def weekly_pivot(days: DataFrame, file: str = "file") -> DataFrame:
    """A row a sheet and week, a column a weekday, and the total; days come from timesheet."""
    names = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    wide = days.groupBy(file, "week").pivot("day", names).agg(F.sum("hours"))
    return wide.withColumn("total", sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0)))


def filter_triples(triples: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(subj, rel, obj) of allowed entities and relations, not reflexive, at most `most` an entity."""
    kept = triples.where("subj <> obj").distinct()
    kept = kept.join(entities.select(F.col("entity").alias("subj")), "subj", "left_semi") if entities is not None else kept
    kept = kept.join(relations.select(F.col("relation").alias("rel")), "rel", "left_semi") if relations is not None else kept
    w = Window.partitionBy("subj").orderBy("rel", "obj")
    return kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("subj", "rel", "obj")


def section(lines: DataFrame, begin: str, end: str, number: str = "line_num", text: str = "text", file: str = "file") -> DataFrame:
    """Lines between a line that matches begin and the next that matches end, markers left out."""
    w = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col(text).rlike(end), F.lit(False)).when(F.col(text).rlike(begin), F.lit(True)), ignorenulls=True).over(w)
    return lines.withColumn("__in", F.coalesce(state, F.lit(False))).where(F.col("__in") & ~F.col(text).rlike(begin)).drop("__in")


def size_rollup(files: DataFrame, path: str, size: str) -> DataFrame:
    """(folder, size, n): sizes added up over every folder above a file."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select(F.explode(folders).alias("folder"), F.col(size).alias("s")).groupBy("folder").agg(F.sum("s").alias("size"), F.count("*").alias("n"))
