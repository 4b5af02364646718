"""Forecasts keyed by series; every training row is strictly earlier than its target.

A series holds one row per month, so a window or a fit over one series is bounded by the calendar.
Scale comes from the number of series, which the shuffle spreads.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.functions import calendar as cal
from vintagekit.operators import features as feat
from vintagekit.operators import pit
from vintagekit.operators.bridge import (  # noqa: F401  (offered here with the other models)
    MIN_MONTHS, RIDGE, RIDGE_ALPHA, Z80, Z95, ridge_bridge,
)
from vintagekit.operators.state_space import KALMAN, kalman_nowcast  # noqa: F401

# Fixed values.
MIN_BASELINE_MONTHS = 24
MIN_ERRORS = 24
RANDOM_WALK, SEASONAL, AR2 = "random_walk", "seasonal_naive", "ar2"


def _solve_ar2(y0: Column, a: Column, b: Column, w) -> tuple[Column, Column]:
    """Forecast and sample count from running centred moments; a 2x2 solve in SQL.

    Values are measured from `y0`, the series' first one, so that no digits are lost to the level.
    """
    y = F.col("_v") - y0
    ok = a.isNotNull() & b.isNotNull() & F.col("_v").isNotNull()
    a0, b0 = a - y0, b - y0

    def s(e: Column) -> Column:
        return F.sum(F.when(ok, e)).over(w)

    n = F.count(F.when(ok, F.lit(1))).over(w)
    sa, sb, sy = s(a0), s(b0), s(y)
    saa, sbb = s(a0 * a0) - sa * sa / n, s(b0 * b0) - sb * sb / n
    sab = s(a0 * b0) - sa * sb / n
    say, sby = s(a0 * y) - sa * sy / n, s(b0 * y) - sb * sy / n
    det = saa * sbb - sab * sab
    b1, b2 = (say * sbb - sby * sab) / det, (sby * saa - say * sab) / det
    point = y0 + (sy - b1 * sa - b2 * sb) / n + b1 * a0 + b2 * b0
    full_rank = (n >= 3) & (det > saa * sbb * 1e-12)
    return F.when(full_rank, point), n


def baseline_points(
    h: DataFrame, series: str = "series_id", period: str = "obs_period", value: str = "value",
    min_history: int = MIN_BASELINE_MONTHS, gap_aware: bool = False,
) -> DataFrame:
    """Random walk, seasonal naive and AR(2) side by side, from one sort per series.

    Lags count calendar months through RANGE frames, so a hole in the history is a null lag. A row
    with a null value is an open period: it is forecast but never trained on. `min_history` counts
    earlier months (or, gap aware, earlier complete samples).
    """
    base = h.withColumn("_v", F.col(value).cast("double"))
    by_month = Window.partitionBy(series).orderBy("_m")
    prior = by_month.rowsBetween(Window.unboundedPreceding, -1)
    whole_prior = by_month.rowsBetween(Window.unboundedPreceding, 0)

    def back(months: int) -> Column:
        return F.max("_v").over(by_month.rangeBetween(-months, -months))

    rows = base.withColumn("_m", cal.month_index(period)).withColumns({
        "_a": back(1), "_b": back(2), "_s": back(12),
        "_y0": F.first("_v", True).over(whole_prior),
        "_last": F.last("_v", True).over(prior),
        "_n": F.count("_v").over(prior),
    })
    ar2_point, samples = _solve_ar2(F.col("_y0"), F.col("_a"), F.col("_b"), prior)
    rows = rows.withColumns({"_ar2": ar2_point, "_samples": samples})
    enough = F.col("_samples" if gap_aware else "_n") >= min_history
    return rows.select(
        *h.columns,
        F.col("_last").alias(RANDOM_WALK),
        F.col("_s").alias(SEASONAL),
        F.when(enough, F.col("_ar2")).alias(AR2),
        F.col("_samples").alias("ar2_samples"),
        F.col("_n").alias("prior_months"),
    )


def random_walk(h, series="series_id", period="obs_period", value="value") -> DataFrame:
    return _one(h, RANDOM_WALK, series, period, value)


def seasonal_naive(h, series="series_id", period="obs_period", value="value") -> DataFrame:
    return _one(h, SEASONAL, series, period, value)


def ar2(h, series="series_id", period="obs_period", value="value",
        min_history=MIN_BASELINE_MONTHS) -> DataFrame:
    return _one(h, AR2, series, period, value, min_history)


def ar2_gap_aware(h, series="series_id", period="obs_period", value="value",
                  min_samples=MIN_BASELINE_MONTHS) -> DataFrame:
    return _one(h, AR2, series, period, value, min_samples, True)


def _one(h, model, series, period, value, min_history=MIN_BASELINE_MONTHS, gap_aware=False):
    points = baseline_points(h, series, period, value, min_history, gap_aware)
    return points.select(series, period, F.lit(model).alias("model"),
                         F.col(model).alias("point")).filter("point is not null")


def rank_deficient(
    h: DataFrame, series: str = "series_id", period: str = "obs_period", value: str = "value",
    min_history: int = MIN_BASELINE_MONTHS,
) -> DataFrame:
    """Periods with history and lags enough but no AR(2) fit: a violation for continuous series."""
    p = baseline_points(h, series, period, value, min_history)
    return p.filter(F.col(AR2).isNull() & (F.col("prior_months") >= min_history)
                    & (F.col("ar2_samples") >= 3)).select(series, period)


def expanding_baselines(
    h: DataFrame, start: date | str | None = None, series: str = "series_id",
    period: str = "obs_period", value: str = "value", min_history: int = MIN_BASELINE_MONTHS,
    gap_aware: bool = False,
) -> DataFrame:
    """Every baseline for every period from `start`, long form, one pass over the history."""
    p = baseline_points(h, series, period, value, min_history, gap_aware)
    if start is not None:
        p = p.filter(F.col(period) >= F.lit(start).cast("date"))
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("point"))
                      for m in (RANDOM_WALK, SEASONAL, AR2)])
    return p.select(series, period, F.inline(pairs)).filter("point is not null")


def select_benchmark(metrics: DataFrame, series: str = "series_id") -> DataFrame:
    """Lowest MAE per series, the earlier name on a tie."""
    return metrics.groupBy(series).agg(
        F.min(F.struct("mae", "model")).alias("_best")
    ).select(series, F.col("_best.model").alias("model"), F.col("_best.mae").alias("mae"))


def higher_quantile(sorted_values: Column, q: float) -> Column:
    """The "higher" rule: the value at index ceil(q * (n - 1)), never interpolated."""
    at = F.ceil((F.size(sorted_values) - 1) * F.lit(q)).cast("int") + 1
    return F.try_element_at(sorted_values, at)


def empirical_bands(
    forecasts: DataFrame, actuals: DataFrame, q: Sequence[float] = (0.80, 0.95),
    min_errors: int = MIN_ERRORS, series: str = "series_id", period: str = "obs_period",
    value: str = "value",
) -> DataFrame:
    """Half-widths from strictly earlier absolute errors of the same series and model, nested."""
    joined = forecasts.join(actuals.select(series, period, F.col(value).alias("actual")),
                            [series, period], "left")
    err = joined.withColumn("abs_error", F.abs(F.col("point") - F.col("actual")))
    w = Window.partitionBy(series, "model").orderBy(period).rowsBetween(
        Window.unboundedPreceding, -1)
    past = err.withColumn("_past", F.array_sort(F.collect_list("abs_error").over(w)))
    enough = F.size("_past") >= min_errors
    w80 = F.when(enough, higher_quantile(F.col("_past"), q[0]))
    w95 = F.when(enough, higher_quantile(F.col("_past"), q[1]))
    p = F.col("point")
    return past.withColumns({"width80": w80, "width95": F.greatest(w80, w95)}).select(
        *forecasts.columns, "actual", "abs_error", F.size("_past").alias("prior_errors"),
        "width80", "width95", (p - F.col("width80")).alias("low80"),
        (p + F.col("width80")).alias("high80"), (p - F.col("width95")).alias("low95"),
        (p + F.col("width95")).alias("high95"),
    )


def open_period_rows(
    targets: DataFrame, weekly: DataFrame, monthly: DataFrame, t: date | datetime | str
) -> DataFrame:
    """Training rows known at `t` and one row per open month, with features at its boundary.

    Open months run from the one after the last target to the month of the latest weekly
    observation. `origin_ok` tells whether the boundary is a Thursday or Friday 1 to 10 days after
    that observation.
    """
    known = pit.as_of(targets, t, "release_at")
    week = pit.as_of(weekly, t)
    edge = week.groupBy("series_id").agg(F.max("release_date").alias("origin"),
                                         F.max("obs_period").alias("latest_week"))
    last = known.groupBy("series_id").agg(F.max("target_period").alias("last_target"))
    months = cal.month_ends_between(cal.shift_month_end("last_target", 1), "latest_week")
    open_rows = last.join(edge, "series_id").select(
        "series_id", F.explode(months).alias("target_period"), "origin")
    past = feat.historical_features(known, week, monthly)
    ahead = feat.ragged_edge_feature(open_rows, week, monthly, "origin")
    lag = F.datediff("origin", "latest_observation")
    ok = F.weekday("origin").isin(3, 4) & lag.between(1, 10)
    rows = past.withColumn("is_open", F.lit(False)).unionByName(
        ahead.withColumn("is_open", F.lit(True)))
    values = known.select("series_id", "target_period", "value")
    return rows.join(values, ["series_id", "target_period"], "left").withColumn("origin_ok", ok)


def predict_open_periods(
    targets: DataFrame, weekly: DataFrame, monthly: DataFrame, t: date | datetime | str,
    alpha: float = RIDGE_ALPHA, min_history: int = MIN_MONTHS,
) -> DataFrame:
    """One ridge forecast per series and unreleased month, under the hash of all its inputs."""
    rows = open_period_rows(targets, weekly, monthly, t)
    made = ridge_bridge(rows, alpha, min_history)
    ahead = rows.filter("is_open").select(
        "series_id", "target_period", F.col("origin").alias("made_at"), "origin_ok")
    return ahead.join(made, ["series_id", "target_period"])


def predict_benchmark_period(
    h: DataFrame, schedule: DataFrame, selected: DataFrame, t: date | datetime | str,
    start: date | str | None = None, min_errors: int = MIN_ERRORS, series: str = "series_id",
    period: str = "obs_period", value: str = "value", release: str = "release_date",
) -> DataFrame:
    """Next month's benchmark forecast with empirical bands, if its release is still ahead.

    `schedule` holds (period, scheduled_at). Unscheduled months are reported without a forecast;
    a release already past is PAST, which the caller treats as an error.
    """
    known = pit.as_of(h, t, release).select(series, period, value)
    ahead = known.groupBy(series).agg(F.max(period).alias("_p")).select(
        series, cal.shift_month_end("_p", 1).alias(period), F.lit(None).cast("double").alias(value),
        F.lit(True).alias("_open"))
    rows = known.withColumn("_open", F.lit(False)).unionByName(ahead)
    points = expanding_baselines(rows, start, series, period, value, gap_aware=True)
    chosen = points.join(selected.select(series, "model"), [series, "model"], "left_semi")
    banded = empirical_bands(chosen, known, min_errors=min_errors, series=series, period=period,
                             value=value)
    out = ahead.drop("_open", value).join(banded, [series, period], "left").join(
        schedule.select(period, "scheduled_at").distinct(), period, "left")
    bound = pit.boundary_literal(schedule, "scheduled_at", t)
    status = F.when(F.col("scheduled_at").isNull(), "UNSCHEDULED").when(
        F.col("scheduled_at") <= bound, "PAST").when(
        F.col("point").isNull() | F.col("width80").isNull(), "UNAVAILABLE").otherwise("PREDICTED")
    shown = [F.when(status == "PREDICTED", F.col(c)).alias(c)
             for c in ("point", "low80", "high80", "low95", "high95")]
    return out.select(series, period, "model", "scheduled_at", status.alias("status"), *shown)
