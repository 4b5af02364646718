"""Ragged-edge features of mixed frequency, built only from what was released by the boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.functions import calendar as cal
from vintagekit.functions import keys as k
from vintagekit.operators import pit

# Fixed value: weekly observations end on Wednesday (0 = Monday).
WEEKDAY = 2
# Fixed value: a spread at or below this counts as constant and scales by one.
FLAT = 1e-12


def period_change(
    df: DataFrame, series: str, period: str, value: str, days: int = 7
) -> DataFrame:
    """Value minus the value exactly `days` earlier; null where that predecessor is missing.

    Joined on the date, as a bare lag would step over a hole.
    """
    before = df.select(series, F.date_add(period, days).alias(period),
                       F.col(value).alias("previous_value"))
    return df.join(before, [series, period], "left").withColumn(
        "change", F.col(value) - F.col("previous_value"))


def missing_predecessors(
    df: DataFrame, series: str, period: str, value: str, days: int = 7
) -> DataFrame:
    """Periods after the series' first one that lack a value exactly `days` earlier."""
    first = df.groupBy(series).agg(F.min(period).alias("_first"))
    changed = period_change(df, series, period, value, days)
    return changed.filter(F.col("previous_value").isNull()).join(first, series).filter(
        F.col(period) > F.col("_first")).select(series, period)


def expected_slots(df: DataFrame, month: str, weekday: int = WEEKDAY) -> DataFrame:
    """One row per expected weekly slot of each month row."""
    return df.withColumn("slot", F.explode(cal.weekdays_in_month(month, weekday)))


def coverage_and_pace(
    changes: DataFrame, slots: DataFrame, keys: Sequence[str], change: str = "change"
) -> DataFrame:
    """Observed over expected slots, and the sum paced up to a full month (null with none seen)."""
    seen = F.count(change)
    covered = seen / F.count(F.lit(1))
    joined = slots.join(changes, [*[c for c in keys if c in changes.columns], "slot"], "left")
    return joined.groupBy(*keys).agg(
        F.coalesce(F.sum(change), F.lit(0.0)).alias("change_sum"),
        seen.alias("weeks_observed"),
        F.count(F.lit(1)).alias("weeks_expected"),
        covered.alias("coverage"),
        F.when(seen > 0, F.sum(change) / covered).alias("paced_change"),
    )


def reached_edges(weekly: DataFrame) -> DataFrame:
    """(series_id, release_date, latest_release, latest_observation): how far each release reached."""
    per_release = weekly.groupBy("series_id", "release_date").agg(F.max("obs_period").alias("_p"))
    return per_release.select(
        "series_id", "release_date", F.col("release_date").alias("latest_release"),
        F.max("_p").over(Window.partitionBy("series_id").orderBy("release_date"))
        .alias("latest_observation"))


EDGE = ["latest_release", "latest_observation"]


def ragged_edge_feature(
    targets: DataFrame, weekly: DataFrame, monthly: DataFrame, bound: str = "origin"
) -> DataFrame:
    """One feature row per (series, target period, boundary).

    A month asks only for its own weeks and the one before them, so weeks, flows and questions are one
    tagged union keyed by (series, month): a single shuffle brings a month's few vintages together, and
    each question reads its answers from them. `weekly` and `monthly` hold series_id, obs_period,
    value, release_date (weekly also checksum). Targets that carry `latest_release` and
    `latest_observation` already, as those of `historical_features` do, are not asked for them again.
    """
    id_cols = ["series_id", "target_period", bound]
    if not set(EDGE) <= set(targets.columns):
        targets = pit.as_of_join(targets.select(*id_cols).dropDuplicates(), reached_edges(weekly),
                                 ["series_id"], bound, "release_date", EDGE)
    key = ["series_id", "target_period"]
    asked = targets.select(*key, F.struct(bound, *EDGE).alias("_q"))
    months = F.array_distinct(F.array(
        F.last_day("obs_period"), F.last_day(F.date_add("obs_period", 7))))
    weeks = weekly.select("series_id", F.explode(months).alias("target_period"), F.struct(
        "obs_period", "release_date", "checksum", F.col("value").cast("double").alias("value")).alias("_w"))
    flows = monthly.select("series_id", F.col("obs_period").alias("target_period"), F.struct(
        F.col("release_date").alias("r"), F.col("value").alias("m")).alias("_f"))
    union = asked.unionByName(weeks, True).unionByName(flows, True)
    rows = union.groupBy(*key).agg(
        F.collect_set("_q").alias("_qs"), F.collect_list("_w").alias("_w"),
        F.collect_list("_f").alias("_f")).select(*key, F.explode("_qs").alias("_q"), "_w", "_f")
    at = F.col("_q").getField(bound)
    slots = cal.weekdays_in_month("target_period", WEEKDAY)
    rows = rows.select(
        *key, at.alias(bound), *[F.col(f"_q.{c}").alias(c) for c in EDGE],
        F.array_insert(slots, 1, F.date_sub(slots[0], 7)).alias("_dates"),
        F.filter("_w", lambda x: x["release_date"] <= at).alias("_w"),
        F.array_min(F.filter("_f", lambda x: x["r"] <= at)).alias("_f"))
    # The latest vintage of each date known at the boundary, null where there is none.
    rows = rows.withColumn("_levels", F.transform("_dates", lambda d: F.array_max(F.transform(
        F.filter("_w", lambda x: x["obs_period"] == d), lambda x: F.struct(
            x["release_date"], x["checksum"], x["value"])))))
    places = F.sequence(F.lit(1), F.size("_dates") - 1)
    seen = F.filter(places, lambda i: F.get("_levels", i).isNotNull())
    rows = rows.withColumn("weekly_changes", F.transform(seen, lambda i: F.struct(
        F.get("_dates", i).alias("obs_period"),
        (F.get("_levels", i)["value"] - F.get("_levels", i - 1)["value"]).alias("change"))))
    total = F.aggregate("weekly_changes", F.lit(0.0),
                        lambda acc, c: acc + F.coalesce(c["change"], F.lit(0.0)))
    missing = F.size(F.filter("weekly_changes", lambda c: c["change"].isNull()))
    evidence = F.array_compact(F.zip_with("_dates", "_levels", lambda d, v: F.when(
        v.isNotNull(), k.row_text([d, v["release_date"], v["checksum"]]))))
    rows = rows.select(
        *id_cols, "weekly_changes", total.alias("change_sum"),
        F.size("weekly_changes").alias("weeks_observed"),
        (F.size("_dates") - 1).alias("weeks_expected"), missing.alias("missing_predecessors"), *EDGE,
        F.col("_f.m").alias("monthly_change"), F.col("_f.r").alias("monthly_release"),
        F.sha2(F.array_join(evidence, ""), 256).alias("_weekly_hash"))
    coverage = F.col("weeks_observed") / F.col("weeks_expected")
    return rows.select(
        *id_cols, "change_sum", "weeks_observed", "weeks_expected", coverage.alias("coverage"),
        F.when(F.col("weeks_observed") > 0, F.col("change_sum") / coverage).alias("paced_change"),
        *EDGE, "monthly_change", "monthly_release", "missing_predecessors", "weekly_changes",
        k.row_hash([*id_cols, "_weekly_hash", "monthly_release",
                    F.round("monthly_change", 9).cast("decimal(38,9)")]).alias("inputs_hash"),
    )


def historical_features(
    targets: DataFrame, weekly: DataFrame, monthly: DataFrame
) -> DataFrame:
    """The feature of every target at its own origin, the last release strictly before its own.

    One as-of join answers the origin and how far the weeks reached by then.
    """
    edges = reached_edges(weekly).withColumn("origin", F.col("release_date"))
    at = pit.as_of_join(targets.select("series_id", "target_period", "release_at"), edges, ["series_id"],
                        "release_at", "release_date", ["origin", *EDGE], strict=True)
    return ragged_edge_feature(at.filter(F.col("origin").isNotNull()), weekly, monthly, "origin")


def window_scale(
    df: DataFrame, series: str, order: str, cols: Sequence[str]
) -> DataFrame:
    """Mean and population spread of strictly earlier rows, nulls ignored; none seen gives (0, 1)."""
    w = Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for c in cols:
        spread = F.stddev_pop(c).over(w)
        out[f"{c}_mean"] = F.coalesce(F.avg(c).over(w), F.lit(0.0))
        out[f"{c}_std"] = F.when(spread > FLAT, spread).otherwise(1.0)
    return df.withColumns(out)


def design_row(
    df: DataFrame, paced: str = "paced_change", coverage: str = "coverage",
    monthly: str = "monthly_change", month: str = "target_period", out: str = "design",
) -> DataFrame:
    """Sixteen columns: intercept, scaled paced change, coverage, scaled flow, flag, month dummies.

    Expects the `_mean` and `_std` columns of `window_scale`. A null takes the mean, so it is 0.
    """

    def scaled(c: str):
        return F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"), F.lit(0.0))

    parts = [F.lit(1.0), scaled(paced), F.col(coverage).cast("double"), scaled(monthly),
             F.col(monthly).isNotNull().cast("double")]
    parts += [(F.month(month) == m).cast("double") for m in range(2, 13)]
    return df.withColumn(out, F.array(*parts))
