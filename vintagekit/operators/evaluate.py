"""Scores of forecasts against first prints."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.operators import forecast as fc

BANDS = ("low80", "high80", "low95", "high95")
# The four acceptance bars.
MIN_IMPROVEMENT = 0.10
COVERAGE80 = (0.70, 0.90)
COVERAGE95 = (0.90, 1.00)
MIN_ACCELERATION = 0.55
TOLERANCE = 1e-9


def acceleration_match(point: Column, actual: Column, previous: Column) -> Column:
    """Same three-way sign of the change from the previous actual."""
    return F.signum(point - previous) == F.signum(actual - previous)


def with_previous(actuals: DataFrame, series: str, period: str, value: str) -> DataFrame:
    w = Window.partitionBy(series).orderBy(period)
    return actuals.select(series, period, F.col(value).alias("actual"),
                          F.lag(value).over(w).alias("previous_actual"))


def _with_bands(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumns(
        {c: F.lit(None).cast("double") for c in BANDS if c not in forecasts.columns})


def score_rows(
    forecasts: DataFrame, actuals: DataFrame, series: str = "series_id",
    period: str = "obs_period", value: str = "value",
) -> DataFrame:
    """Each forecast beside its actual and the actual before it."""
    joined = _with_bands(forecasts).join(
        with_previous(actuals, series, period, value), [series, period])
    a, p = F.col("actual"), F.col("point")
    return joined.withColumns({
        "error": p - a,
        "accelerates": acceleration_match(p, a, F.col("previous_actual")),
        "inside80": a.between(F.col("low80"), F.col("high80")),
        "inside95": a.between(F.col("low95"), F.col("high95")),
    })


def evaluate(
    forecasts: DataFrame, actuals: DataFrame, start: date | str | None = None,
    series: str = "series_id", period: str = "obs_period", value: str = "value",
) -> DataFrame:
    """MAE, RMSE, coverage and acceleration accuracy per (series, model)."""
    rows = score_rows(forecasts, actuals, series, period, value)
    if start is not None:
        rows = rows.filter(F.col(period) >= F.lit(start).cast("date"))
    return rows.groupBy(series, "model").agg(
        F.count(F.lit(1)).alias("observations"),
        F.min(period).alias("period_start"),
        F.max(period).alias("period_end"),
        F.avg(F.abs("error")).alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg(F.col("inside80").cast("double")).alias("coverage80"),
        F.avg(F.col("inside95").cast("double")).alias("coverage95"),
        F.avg(F.col("accelerates").cast("double")).alias("acceleration_accuracy"),
    )


def check_comparable(
    forecasts: DataFrame, actuals: DataFrame, start: date | str, models: Sequence[str] = (),
    series: str = "series_id", period: str = "obs_period",
) -> DataFrame:
    """What makes models incomparable, as (series, model, problem, rows).

    Every model needs each period from `start` once; bands are all there or all absent, and nested.
    """
    since = F.col(period) >= F.lit(start).cast("date")
    wanted = actuals.filter(since).groupBy(series).agg(F.count(F.lit(1)).alias("expected"))
    f = _with_bands(forecasts).join(
        actuals.filter(since).select(series, period, F.lit(True).alias("_known")),
        [series, period], "left")
    per_key = f.groupBy(series, "model", period).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce("_known", F.lit(False))).alias("known"),
        F.max(sum(F.col(c).isNotNull().cast("int") for c in BANDS)).alias("bands"),
        F.max(
            ~((F.col("low95") <= F.col("low80")) & (F.col("low80") <= F.col("point"))
              & (F.col("point") <= F.col("high80")) & (F.col("high80") <= F.col("high95")))
        ).alias("unordered"),
        F.max(F.coalesce(F.isnan("point") | F.col("point").isNull(), F.lit(False))).alias("nan"),
    )
    per_model = per_key.groupBy(series, "model").agg(
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(~F.col("known")).alias("unexpected"),
        F.count_if(F.col("known")).alias("matched"),
        F.min("bands").alias("b0"), F.max("bands").alias("b1"),
        F.count_if("unordered").alias("unordered"),
        F.count_if("nan").alias("nan"),
    )
    if models:
        named = wanted.select(series, F.explode(F.array(*[F.lit(m) for m in models]))
                              .alias("model"))
        per_model = named.join(per_model, [series, "model"], "left")
    per_model = per_model.join(wanted, series, "left")
    missing = F.coalesce("expected", F.lit(0)) - F.coalesce("matched", F.lit(0))
    partial = (F.col("b0") != F.col("b1")) | ~F.col("b1").isin(0, len(BANDS))
    counts = {
        "missing period": missing,
        "unexpected period": F.coalesce("unexpected", F.lit(0)),
        "repeated forecast": F.coalesce("repeated", F.lit(0)),
        "partial bands": F.coalesce(partial, F.lit(False)).cast("bigint"),
        "bands not nested": F.coalesce("unordered", F.lit(0)),
        "point not finite": F.coalesce("nan", F.lit(0)),
    }
    problems = F.array(*[F.struct(F.lit(name).alias("problem"), n.cast("bigint").alias("row_count"))
                         for name, n in counts.items()])
    return per_model.select(series, "model", F.inline(problems)).filter("row_count > 0")


def headline_decision(
    metrics: DataFrame, candidates: Sequence[str], naive: Sequence[str], series: str = "series_id"
) -> DataFrame:
    """The better candidate against the best naive model, and the four bars it must clear."""
    is_candidate = F.col("model").isin(list(candidates))
    row = F.struct("mae", "model", "coverage80", "coverage95", "acceleration_accuracy")
    best = metrics.groupBy(series).agg(
        F.min(F.when(is_candidate, row)).alias("h"),
        F.min(F.when(F.col("model").isin(list(naive)), F.struct("mae", "model"))).alias("n"),
    )
    improvement = 1 - F.try_divide(F.col("h.mae"), F.col("n.mae"))
    out = best.select(
        series, F.col("h.model").alias("model"), F.col("h.mae").alias("mae"),
        F.col("n.model").alias("best_naive"), F.col("n.mae").alias("naive_mae"),
        improvement.alias("improvement"),
        F.coalesce(improvement >= MIN_IMPROVEMENT, F.lit(False)).alias("bar_improvement"),
        F.coalesce(F.col("h.coverage80").between(*COVERAGE80), F.lit(False)).alias("bar_coverage80"),
        F.coalesce(F.col("h.coverage95").between(*COVERAGE95), F.lit(False)).alias("bar_coverage95"),
        F.coalesce(F.col("h.acceleration_accuracy") >= MIN_ACCELERATION, F.lit(False))
        .alias("bar_acceleration"),
    )
    return out.withColumn("all_bars_pass", F.col("bar_improvement") & F.col("bar_coverage80")
                          & F.col("bar_coverage95") & F.col("bar_acceleration"))


def expanding_interval_coverage(
    forecasts: DataFrame, actuals: DataFrame, min_errors: int = fc.MIN_ERRORS,
    series: str = "series_id", period: str = "obs_period", value: str = "value",
) -> DataFrame:
    """Coverage judged only with widths from strictly earlier errors, once there are enough."""
    rows = fc.empirical_bands(forecasts, actuals, min_errors=min_errors, series=series,
                              period=period, value=value)
    judged = F.col("width80").isNotNull() & F.col("abs_error").isNotNull()
    return rows.filter("actual is not null").groupBy(series, "model").agg(
        F.count_if(judged).alias("interval_observations"),
        F.avg(F.when(judged, (F.col("abs_error") <= F.col("width80")).cast("double")))
        .alias("coverage80"),
        F.avg(F.when(judged, (F.col("abs_error") <= F.col("width95")).cast("double")))
        .alias("coverage95"),
    )


def benchmark_backtest(
    h: DataFrame, start: date | str, series: str = "series_id", period: str = "obs_period",
    value: str = "value",
) -> DataFrame:
    """Gap-aware baselines scored with expanding bands; `selected` marks the lowest MAE."""
    f = fc.expanding_baselines(h, start, series, period, value, gap_aware=True)
    scores = evaluate(f, h, None, series, period, value).drop("coverage80", "coverage95")
    covered = expanding_interval_coverage(f, h, series=series, period=period, value=value)
    joined = scores.join(covered, [series, "model"])
    best = fc.select_benchmark(joined, series).select(series, F.col("model").alias("_best"))
    return joined.join(best, series).withColumn(
        "selected", F.col("model") == F.col("_best")).drop("_best")


def best_naive(metrics: DataFrame, naive: Sequence[str], series: str = "series_id") -> DataFrame:
    """Best naive model per series, ties broken by name."""
    return fc.select_benchmark(metrics.filter(F.col("model").isin(list(naive))), series)


def live_calibration(
    predictions: DataFrame, grades: DataFrame, history: DataFrame, best: DataFrame,
    min_history: int = 3, scheduled: Sequence[str] = (),
) -> DataFrame:
    """Per grade: inside the bands, the error, and the best naive forecast made with what was known.

    `history` holds series_id, obs_period, value, release_date, and source_url where grades name their
    vintage; `best` holds series_id, model. The naive point uses only months before the target whose
    release was out when the prediction was made; AR(2) steps from the months before the target for
    `scheduled` series, else from the last two known ones. Broken relations come out in `problem`, one
    row per grade; none is dropped, and a prediction or a first print that stands twice is a problem.
    """
    one = predictions.withColumnRenamed("target_series", "series_id").groupBy("prediction_id").agg(
        F.count(F.lit(1)).alias("_predictions"), *[F.any_value(c).alias(c) for c in (
            "series_id", "target_period", "made_at", "point", "low80", "high80", "low95", "high95")])
    g = grades.join(one, "prediction_id", "left")
    url = F.col("source_url") if "source_url" in history.columns else F.lit(None).cast("string")
    first = F.min(F.struct("release_date", "value", url.alias("url")))
    actual = history.groupBy("series_id", F.col("obs_period").alias("target_period")).agg(
        F.count(F.lit(1)).alias("_prints"), first.alias("_first")).select(
        "series_id", "target_period", "_prints", F.col("_first.value").alias("_actual"),
        F.col("_first.release_date").alias("_rel"), F.col("_first.url").alias("_url"))
    rows = g.join(actual, ["series_id", "target_period"], "left").join(
        best.select("series_id", F.col("model").alias("naive_model")), "series_id", "left")
    naive = naive_at(rows.filter("made_at is not null"), history, min_history)
    rows = rows.join(naive, ["series_id", "target_period", "made_at"], "left")
    ar2 = F.when(F.col("series_id").isin(list(scheduled)), F.col("_ar2_calendar")).otherwise(F.col("_ar2"))
    point = F.when(F.col("naive_model") == fc.RANDOM_WALK, F.col("_walk")).when(
        F.col("naive_model") == fc.SEASONAL, F.col("_season")).when(F.col("naive_model") == fc.AR2, ar2)
    a = F.col("actual_first_print")
    named = F.col("vintage_url") if "vintage_url" in grades.columns else F.lit(None).cast("string")
    problem = (
        F.when(F.col("_predictions").isNull(), "no prediction")
        .when(F.col("_predictions") > 1, "prediction repeated")
        .when(F.col("_prints").isNull(), "no first print")
        .when(F.col("_prints") > 1, "first print repeated")
        .when(F.abs(F.col("_actual") - a) > TOLERANCE, "first print differs")
        .when(F.col("_url").isNotNull() & ~F.col("_url").eqNullSafe(named), "vintage differs")
        .when(F.col("_rel") <= F.col("made_at"), "already released")
        .when(F.abs(F.abs(F.col("point") - a) - F.col("abs_error")) > TOLERANCE, "error differs")
        .when(F.col("naive_model").isNull(), "no comparator")
        .when(point.isNull(), "comparator unavailable")
    )
    return rows.select(
        "series_id", "prediction_id", "target_period",
        a.between(F.col("low80"), F.col("high80")).alias("inside80"),
        a.between(F.col("low95"), F.col("high95")).alias("inside95"),
        "abs_error", "naive_model", point.alias("naive_point"),
        F.abs(point - a).alias("naive_abs_error"), problem.alias("problem"),
    )


def naive_at(
    asked: DataFrame, history: DataFrame, min_history: int = 3
) -> DataFrame:
    """Random walk, seasonal and AR(2) points per (series, target, made_at), as known when made.

    Each distinct question meets the earlier months of its series once; the fit is a plain
    aggregate. `_ar2` steps from the last two known months, `_ar2_calendar` from the two months before
    the target, which must be known.
    """
    key = ["series_id", "target_period", "made_at"]
    h = history.select("series_id", "obs_period", F.col("value").cast("double").alias("_v"),
                       "release_date")

    def lagged(months: int, name: str) -> DataFrame:
        return h.select(
            "series_id", F.last_day(F.add_months("obs_period", months)).alias("obs_period"),
            F.col("_v").alias(f"_{name}"), F.col("release_date").alias(f"_r{name}"))

    samples = h.join(lagged(1, "a"), ["series_id", "obs_period"], "left").join(
        lagged(2, "b"), ["series_id", "obs_period"], "left")
    made = F.col("made_at")
    known = asked.select(*key).distinct().join(samples, "series_id").filter(
        (F.col("obs_period") < F.col("target_period")) & (F.col("release_date") <= made))
    lag_known = F.col("_ra") <= made
    ok = lag_known & (F.col("_rb") <= made)
    y, x1, x2 = F.col("_v"), F.col("_a"), F.col("_b")

    def s(e: Column, name: str) -> Column:
        return F.sum(F.when(ok, e)).alias(name)

    back = F.months_between("target_period", "obs_period", False)
    sums = known.groupBy(*key).agg(
        F.max_by("_v", "obs_period").alias("_walk"),
        F.max(F.when(back == 12, y)).alias("_season"), F.max_by("_v", "obs_period").alias("_p1"),
        F.max_by(F.when(lag_known, x1), F.col("obs_period")).alias("_p2"),
        F.max(F.when(back == 1, y)).alias("_c1"), F.max(F.when(back == 2, y)).alias("_c2"),
        F.count(F.lit(1)).alias("_months"),
        F.count(F.when(ok, 1)).alias("_n"), s(x1, "_sa"), s(x2, "_sb"), s(y, "_sy"),
        s(x1 * x1, "_saa"), s(x2 * x2, "_sbb"), s(x1 * x2, "_sab"), s(x1 * y, "_say"),
        s(x2 * y, "_sby"),
    )
    c = F.col
    n = c("_n")
    saa, sbb = c("_saa") - c("_sa") * c("_sa") / n, c("_sbb") - c("_sb") * c("_sb") / n
    sab = c("_sab") - c("_sa") * c("_sb") / n
    say, sby = c("_say") - c("_sa") * c("_sy") / n, c("_sby") - c("_sb") * c("_sy") / n
    det = saa * sbb - sab * sab
    b1, b2 = (say * sbb - sby * sab) / det, (sby * saa - say * sab) / det
    level = (c("_sy") - b1 * c("_sa") - b2 * c("_sb")) / n
    enough = (n >= 3) & (c("_months") >= min_history) & (det > saa * sbb * 1e-12)
    return sums.select(
        *key, "_walk", "_season", F.when(enough, level + b1 * c("_p1") + b2 * c("_p2")).alias("_ar2"),
        F.when(enough, level + b1 * c("_c1") + b2 * c("_c2")).alias("_ar2_calendar"))


def calibration_by_series(comparisons: DataFrame, series: DataFrame) -> DataFrame:
    """Counts, coverages and errors per series; a series without grades keeps nulls."""
    good = comparisons.filter("problem is null")
    per = good.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("graded_count"),
        F.count_if("inside80").alias("inside80_count"),
        F.count_if("inside95").alias("inside95_count"),
        F.avg(F.col("inside80").cast("double")).alias("coverage80"),
        F.avg(F.col("inside95").cast("double")).alias("coverage95"),
        F.avg("abs_error").alias("mae"),
        F.avg("naive_abs_error").alias("naive_mae"),
    )
    out = series.select("series_id").distinct().join(per, "series_id", "left")
    return out.withColumn("mae_difference", F.col("mae") - F.col("naive_mae")).fillna(
        0, ["graded_count", "inside80_count", "inside95_count"])


def first_miss_callout(
    predictions: DataFrame, grades: DataFrame, metrics: DataFrame
) -> DataFrame:
    """A series' earliest graded prediction, if its sign is wrong and it missed the 80 band.

    `metrics` (series_id, model, mae) gives the backtest error shown beside it.
    """
    graded = predictions.join(grades, "prediction_id")
    first = graded.groupBy("target_series").agg(
        F.min_by(F.struct("prediction_id", "target_period", "model_version", "point", "low80",
                          "high80", "actual_first_print", "abs_error"),
                 F.struct("made_at", "prediction_id")).alias("f")
    ).select("target_series", "f.*")
    a, p = F.col("actual_first_print"), F.col("point")
    sign_miss = ((p < 0) & (a > 0)) | ((p > 0) & (a < 0))
    mae = metrics.select(F.col("series_id").alias("target_series"),
                         F.col("model").alias("model_version"), F.col("mae").alias("backtest_mae"))
    return first.filter(sign_miss & ~a.between(F.col("low80"), F.col("high80"))).join(
        mae, ["target_series", "model_version"], "left")


def scoreboard_summary(predictions: DataFrame, grades: DataFrame) -> DataFrame:
    """Prediction, graded and pending counts, with the live error and coverage so far."""
    joined = predictions.join(grades, "prediction_id", "left")
    a = F.col("actual_first_print")
    graded = a.isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.count_if(graded).alias("graded_count"),
        F.count_if(~graded).alias("pending_count"),
        F.avg("abs_error").alias("mae"),
        F.avg(F.when(graded, a.between(F.col("low80"), F.col("high80")).cast("double")))
        .alias("coverage80"),
    )
