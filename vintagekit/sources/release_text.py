"""Release texts, archive indexes and the calendar of expected releases."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit.functions import calendar as cal
from vintagekit.functions import text as tx

# How release texts state their number cells, time stamps and table.
NUMBER = (r"((?<!\w)[-+]?\d{1,3}(?:,\s*\d{3})+(?:\.\d+)?|(?<!\w)[-+]?\d+\.\d+"
          r"|(?<!\w)[-+]?\d+(?!\w))")
MODERN_STAMP = (r"(?i)FOR RELEASE AT\s+8:30\s+(?:A\.M\.|AM)\s+(E[DS]\s*T),\s+[A-Z]+,\s+"
                r"([A-Z]+\s+\d{1,2},\s+\d{4})")
LEGACY_STAMP = (r"(?i)(?:MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY),?\s+"
                r"([A-Z]+\s+\d{1,2},\s+\d{4}),\s+AT\s+8:30\s+(?:A\.M\.|AM)\s+(E[DS]\s*T)")
TOTAL_ROW = r"(?is)Retail & food services,\s*total\b(.*?)(?=\s*Total \(excl\.)"
CELLS, CURRENT_CELL, PRIOR_CELL = 12, 8, 9
EASTERN = "America/New_York"
LAG_DAYS = 100
CENTURY_SPLIT = 50


def eastern_to_utc(day: Column, clock: str) -> Column:
    """A local Eastern time of day as a UTC instant."""
    local = F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(f" {clock}")),
                               F.lit("yyyy-MM-dd HH:mm"))
    return F.convert_timezone(F.lit(EASTERN), F.lit("UTC"), local)


def extract_text_flow(
    docs: DataFrame, text: str = "text", period: str = "target_period", clock: str = "08:30",
    total_row: str = TOTAL_ROW, least_level: float = 100_000,
) -> DataFrame:
    """Current and prior level of the total row, their flow, and the release stamp in UTC.

    The stamp's EST or EDT must be right for its date, and the text must name the target month.
    """
    compact = tx.squeeze(text)
    modern, legacy = (F.regexp_extract(compact, MODERN_STAMP, i) for i in (1, 2)), (
        F.regexp_extract(compact, LEGACY_STAMP, i) for i in (1, 2))
    zone_m, day_m = modern
    day_l, zone_l = legacy
    both = (day_m != "") & (day_l != "")
    raw_day = F.when(day_m != "", day_m).otherwise(day_l)
    zone = F.upper(F.regexp_replace(F.when(day_m != "", zone_m).otherwise(zone_l), r"\s", ""))
    stamp_day = F.try_to_date(F.initcap(F.lower(tx.squeeze(raw_day))), "MMMM d, yyyy")
    at = F.instr(compact, "Table 1.")
    row = F.regexp_extract(F.substr(compact, at, F.length(compact)), total_row, 1)
    cells = F.transform(F.regexp_extract_all(row, F.lit(NUMBER), F.lit(1)),
                        lambda c: F.regexp_replace(c, r"[,\s]", "").try_cast("double"))
    rows = docs.withColumns({
        "_both": both, "_zone": zone, "_day": stamp_day, "_cells": cells, "_at": at,
        "_compact": F.upper(compact)})
    release = eastern_to_utc(F.col("_day"), clock)
    rows = rows.withColumn("release_at", release)
    hours = F.timestamp_diff(
        "HOUR", F.to_timestamp_ntz(F.concat(F.col("_day").cast("string"), F.lit(f" {clock}")),
                                   F.lit("yyyy-MM-dd HH:mm")), F.col("release_at"))
    want_zone = F.when(hours == 4, "EDT").otherwise("EST")
    cur = F.try_element_at("_cells", F.lit(CURRENT_CELL))
    prior = F.try_element_at("_cells", F.lit(PRIOR_CELL))
    lag = F.datediff("_day", period)
    problem = (
        F.when(F.col("_both"), "two stamp formats")
        .when(F.col("_day").isNull(), "no release stamp")
        .when(F.col("_zone") != want_zone, "time zone label differs")
        .when(~F.contains("_compact", F.upper(F.date_format(period, "MMMM yyyy"))),
              "target month absent")
        .when((lag <= 0) | (lag > LAG_DAYS), "release lag")
        .when((F.col("_at") == 0) | (F.size("_cells") == 0), "table absent")
        .when(F.size("_cells") != CELLS, "row shape changed")
        .when((cur <= least_level) | (prior <= least_level), "level invalid"))
    keep = [c for c in docs.columns if c != text]
    return rows.select(
        *keep, "release_at", cur.alias("current_level"), prior.alias("prior_level"),
        (cur - prior).alias("flow"), problem.alias("problem"))


def discover_by_pattern(
    docs: DataFrame, prefix: str, suffix: str, text: str = "text", start: date | str | None = None
) -> DataFrame:
    """Dated addresses `prefix YYMM suffix` of an index text as (period, url).

    Years below 50 are 20xx. `url_count` above one, or a month that is none, is an error; check the
    months with `check_continuity`.
    """
    quoted = rf"\Q{prefix}\E(\d{{4}})\Q{suffix}\E"
    urls = docs.select(F.explode(F.regexp_extract_all(text, F.lit(quoted), F.lit(0))).alias("url"))
    code = F.substring("url", len(prefix) + 1, 4)
    short, month = F.substring(code, 1, 2).cast("int"), F.substring(code, 3, 2).cast("int")
    year = F.when(short < CENTURY_SPLIT, short + 2000).otherwise(short + 1900)
    period = F.when(month.between(1, 12), F.last_day(F.make_date(year, month, F.lit(1))))
    out = urls.select("url", period.alias("period")).groupBy("period").agg(
        F.min("url").alias("url"), F.count_distinct("url").alias("url_count"))
    if start is not None:
        out = out.filter(F.col("period").isNull() | (F.col("period") >= F.lit(start).cast("date")))
    return out


def release_calendar(
    spark: SparkSession, start: date | str | Column, end: date | str | Column, announced: DataFrame,
    holidays: DataFrame, weekly_name: str = "Weekly", weekly_clock: str = "16:15",
) -> DataFrame:
    """Expected releases in a window, times in UTC; what is unknown is an explicit blocked row.

    `announced` holds name, month, release_date (null while unknown), clock (null if only the day
    is known). The weekly release is on Fridays, on the Thursday before a holiday Friday. The window's
    ends may be scalar subqueries.
    """
    first, last = (d if isinstance(d, Column) else F.lit(d).cast("date") for d in (start, end))
    span = spark.range(1).select(first.alias("_a"), last.alias("_z"))
    fridays = span.select(F.explode(F.filter(
        F.sequence("_a", "_z"), lambda d: F.weekday(d) == 4)).alias("friday"))
    off = holidays.select(F.col("day").alias("friday"), F.lit(True).alias("_off")).distinct()
    moved = F.when(F.col("_off"), F.date_sub("friday", 1)).otherwise(F.col("friday"))
    weekly = fridays.join(off, "friday", "left").select(
        F.concat(F.lit(f"{weekly_name} week "), F.col("friday").cast("string"))
        .alias("release_name"),
        eastern_to_utc(moved, weekly_clock).alias("expected_at"),
        F.lit("EXPECTED_RULE").alias("status"))
    known = F.col("release_date").isNotNull() & F.col("clock").isNotNull()
    local = F.to_timestamp_ntz(
        F.concat(F.col("release_date").cast("string"), F.lit(" "), F.col("clock")),
        F.lit("yyyy-MM-dd HH:mm"))
    fixed = announced.filter(cal.month_end("month").between(
        F.last_day(first), F.last_day(last))).select(
        F.concat("name", F.lit(" "), F.date_format("month", "yyyy-MM")).alias("release_name"),
        F.when(known, F.convert_timezone(F.lit(EASTERN), F.lit("UTC"), local))
        .alias("expected_at"),
        F.when(known, "EXPECTED_OFFICIAL").when(
            F.col("release_date").isNotNull(), "BLOCKED_TIME_UNANNOUNCED").otherwise(
            "BLOCKED_DATE_UNANNOUNCED").alias("status"))
    return weekly.unionByName(fixed).withColumn(
        "actual_at", F.lit(None).cast("timestamp_ntz"))
