"""Readers of delimited schedules, fiscal statements and wide sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.functions import calendar as cal


def read_schedule(
    spark: SparkSession, path: str, fields: Sequence[str], key: str = "CU_NUMBER",
    cycle: str = "CYCLE_DATE",
) -> DataFrame:
    """One schedule with its header; columns are picked by name, amounts are whole numbers."""
    raw = spark.read.option("header", True).csv(path)
    date = F.coalesce(F.try_to_date(cycle, "M/d/yyyy H:mm:ss"), F.try_to_date(cycle, "M/d/yyyy"),
                      F.try_to_date(cycle, "yyyy-MM-dd"))
    return raw.select(F.col(key), date.alias("cycle_date"),
                      *[F.col(f).try_cast("decimal(20,0)").cast("bigint").alias(f)
                        for f in fields])


def read_multi_schedule_csv(
    spark: SparkSession, schedules: Mapping[str, tuple[str, Sequence[str]]],
    key: str = "CU_NUMBER",
) -> DataFrame:
    """All schedules side by side by reporter; `in_<schedule>` tells where it was found."""
    parts = []
    for name, (path, fields) in schedules.items():
        part = read_schedule(spark, path, fields, key)
        parts.append(part.select(key, F.col("cycle_date").alias(f"cycle_{name}"), *fields,
                                 F.lit(True).alias(f"in_{name}")))
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
    return joined.fillna(False, [f"in_{n}" for n in schedules])


def schedule_violations(
    joined: DataFrame, names: Sequence[str], report_date: str, key: str = "CU_NUMBER"
) -> DataFrame:
    """Reporters absent from a schedule, listed twice, or of another cycle."""
    want = F.lit(report_date).cast("date")
    absent = [F.when(~F.col(f"in_{n}"), F.lit(f"absent from {n}")) for n in names]
    other = [F.when(F.col(f"in_{n}") & ~F.col(f"cycle_{n}").eqNullSafe(want),
                    F.lit(f"cycle differs in {n}")) for n in names]
    rows = joined.select(key, F.explode(F.array_compact(F.array(*absent, *other)))
                         .alias("problem"))
    twice = joined.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        key, F.lit("listed twice").alias("problem"))
    return rows.unionByName(twice)


def select_current_month_row(
    rows: DataFrame, period: str = "obs_period", keys: Sequence[str] = ()
) -> DataFrame:
    """The month row whose parent is that month's fiscal year; `match_count` must be one.

    Fiscal years start in October. Rows hold classification_id, parent_id, classification_desc,
    data_type_cd and record_type_cd, and belong to one statement (keys, period).
    """
    year = F.year(period) + F.when(F.month(period) >= 10, 1).otherwise(0)
    parents = rows.filter(
        F.col("classification_desc") == F.concat(F.lit("FY "), year.cast("string"))).select(
        *keys, period, F.col("classification_id").alias("parent_id")).distinct()
    months = rows.filter(
        (F.col("data_type_cd") == "D") & (F.col("record_type_cd") == "MTH")
        & (F.col("classification_desc") == F.date_format(period, "MMMM")))
    hit = months.join(parents, [*keys, period, "parent_id"], "left_semi")
    counts = hit.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("match_count"))
    return hit.join(counts, [*keys, period])


def statement_violations(
    rows: DataFrame, selected: DataFrame, period: str = "obs_period", keys: Sequence[str] = ()
) -> DataFrame:
    """Statements without exactly one current-month row."""
    counts = selected.select(*keys, period, "match_count").distinct()
    return rows.select(*keys, period).distinct().join(counts, [*keys, period], "left").fillna(
        0, ["match_count"]).filter("match_count <> 1")


def unpivot_wide_sheet(
    sheet: DataFrame, period: str = "period", series: Sequence[str] | None = None
) -> DataFrame:
    """Series in columns and `YY:Qn` in the first one, to long rows with quarter ends."""
    cols = list(series or [c for c in sheet.columns if c != period])
    text = F.concat(F.col(period))
    short = F.regexp_extract(text, r"^(\d{2}):Q[1-4]$", 1).try_cast("int")
    quarter = F.regexp_extract(text, r"^\d{2}:Q([1-4])$", 1).try_cast("int")
    year = F.when(short < 50, short + 2000).otherwise(short + 1900)
    end = F.last_day(F.make_date(year, quarter * 3, F.lit(1)))
    doubles = sheet.select(period, *[F.col(c).cast("double").alias(c) for c in cols])
    long = doubles.unpivot([period], cols, "series_id", "value")
    return long.filter(F.col(period).isNotNull()).select(
        "series_id", end.alias("obs_period"), "value",
        F.when(end.isNull(), "bad period").when(
            F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0), "bad value")
        .alias("problem"))


def sheet_lag_violations(
    long: DataFrame, report_period: str, lag_quarters: Mapping[str, int]
) -> DataFrame:
    """Series whose latest period is not the report period less the declared lag."""
    spark = long.sparkSession
    lags = spark.createDataFrame(list(lag_quarters.items()), T.StructType([
        T.StructField("series_id", T.StringType()), T.StructField("lag", T.IntegerType())]))
    latest = long.groupBy("series_id").agg(F.max("obs_period").alias("latest"))
    report = F.lit(report_period).cast("date")
    want = F.last_day(F.add_months(cal.quarter_end(report), F.col("lag") * -3))
    return lags.join(latest, "series_id", "left").withColumn("expected", want).filter(
        ~F.col("latest").eqNullSafe(F.col("expected")))
