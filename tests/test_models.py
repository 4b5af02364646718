import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintagekit.operators import evaluate as ev
from vintagekit.operators import features as feat
from vintagekit.operators import forecast as fc

MONTHS = [dt.date(2015 + i // 12, i % 12 + 1, 1) for i in range(73)]
ENDS = [a - dt.timedelta(days=1) for a in MONTHS[1:]]


def history(spark, values, start=0, series="s"):
    rows = [(series, ENDS[start + i], float(v) if v is not None else None)
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, obs_period date, value double")


def points(df, model):
    return {r.obs_period: r.point for r in df.collect() if r.model == model}


def ar2_by_lstsq(values, i):
    y = np.asarray(values[:i], dtype=float)
    x = np.column_stack([np.ones(len(y) - 2), y[1:-1], y[:-2]])
    beta = np.linalg.lstsq(x, y[2:], rcond=None)[0]
    return float(beta @ [1.0, y[-1], y[-2]])


def test_ar2_matches_least_squares_at_any_level(spark):
    rng = np.random.default_rng(3)
    values = [1e6, 1e6 + 3]
    for _ in range(58):
        values.append(4e5 + 0.4 * values[-1] + 0.2 * values[-2] + rng.normal())
    got = points(fc.ar2(history(spark, values)), "ar2")
    assert len(got) == 60 - 24
    for i in (24, 40, 59):
        assert got[ENDS[i]] == pytest.approx(ar2_by_lstsq(values, i), rel=1e-9)


def test_ar2_without_spread_gives_no_forecast(spark):
    flat = history(spark, [5.0] * 40)
    assert fc.ar2(flat).count() == 0
    assert fc.rank_deficient(flat).count() == 40 - 24


def test_gap_aware_lags_are_calendar_lags(spark):
    rng = np.random.default_rng(4)
    values = list(rng.normal(10, 2, 60))
    rows = history(spark, values).filter(F.col("obs_period") != F.lit(ENDS[50]))
    got = points(fc.ar2_gap_aware(rows), "ar2")
    assert ENDS[51] not in got and ENDS[52] not in got and ENDS[53] in got
    season = points(fc.seasonal_naive(rows), "seasonal_naive")
    assert season[ENDS[20]] == values[8]


def test_future_rows_change_no_earlier_forecast(spark):
    rng = np.random.default_rng(5)
    values = list(rng.normal(10, 2, 50))
    clean = fc.expanding_baselines(history(spark, values)).filter(
        F.col("obs_period") <= F.lit(ENDS[48])).collect()
    poisoned = fc.expanding_baselines(history(spark, values[:49] + [9e9])).filter(
        F.col("obs_period") <= F.lit(ENDS[48])).collect()
    assert sorted(clean) == sorted(poisoned)


def test_higher_quantile_is_never_interpolated(spark):
    row = spark.createDataFrame([([float(x) for x in range(1, 27)],)], "v array<double>").select(
        fc.higher_quantile(F.col("v"), 0.8).alias("a"),
        fc.higher_quantile(F.col("v"), 0.95).alias("b")).first()
    v = np.arange(1.0, 27.0)
    assert (row.a, row.b) == tuple(np.quantile(v, q, method="higher") for q in (0.8, 0.95))


def bridge_frame(spark, n=60, noise=0.0, open_row=True):
    rows = []
    for i in range(n + (1 if open_row else 0)):
        a, b = float(i % 9) * 20, float(i % 7) * 15
        if i == n:
            a, b = 250.0, 120.0
        m = ENDS[i].month
        y = 50 + 0.8 * a + 0.35 * b + 4 * m
        weeks = [(ENDS[i] - dt.timedelta(days=7 * k), a / 4) for k in (3, 2, 1, 0)]
        rows.append(("s", ENDS[i], None if i == n else y + noise * ((i * 37) % 11 - 5), a, 1.0, b,
                     weeks))
    return spark.createDataFrame(
        rows, "series_id string, target_period date, value double, paced_change double, "
              "coverage double, monthly_change double, "
              "weekly_changes array<struct<obs_period:date,change:double>>")


def test_ridge_recovers_a_known_signal(spark):
    rows = bridge_frame(spark)
    want = 50 + 0.8 * 250 + 0.35 * 120 + 4 * ENDS[60].month
    got = {r.target_period: r for r in fc.ridge_bridge(rows, alpha=1e-6).collect()}
    assert got[ENDS[60]].point == pytest.approx(want, abs=1e-3)
    assert got[ENDS[60]].training_months == 60 and min(got) == ENDS[36]


def test_ridge_agrees_with_the_normal_equations(spark):
    rows = bridge_frame(spark, noise=3.0)
    got = {r.target_period: r for r in fc.ridge_bridge(rows).collect()}[ENDS[60]]
    pdf = rows.toPandas()
    scaled = feat.window_scale(rows, "series_id", "target_period",
                               ["paced_change", "monthly_change"])
    design = {r.target_period: r.design for r in feat.design_row(scaled).collect()}
    ahead = np.array(design[ENDS[60]])
    train = pdf[:60]
    z = np.column_stack([
        np.ones(60), (train.paced_change - train.paced_change.mean()) / train.paced_change.std(ddof=0),
        train.coverage, (train.monthly_change - train.monthly_change.mean())
        / train.monthly_change.std(ddof=0), np.ones(60),
        *[[float(e.month == m) for e in ENDS[:60]] for m in range(2, 13)]]).astype(float)
    penalty = np.diag([0.0] + [10.0] * 15)
    inverse = np.linalg.inv(z.T @ z + penalty)
    beta = inverse @ z.T @ train.value.to_numpy(float)
    rss = float(((train.value - z @ beta) ** 2).sum())
    std = (rss / (60 - np.linalg.matrix_rank(z)) * (1 + ahead @ inverse @ ahead)) ** 0.5
    assert got.point == pytest.approx(float(ahead @ beta), rel=1e-9)
    assert got.high80 - got.point == pytest.approx(fc.Z80 * std, rel=1e-6)


@pytest.mark.parametrize("model", [fc.ridge_bridge, fc.kalman_nowcast])
def test_training_is_strictly_earlier(spark, model):
    rows = bridge_frame(spark, noise=2.0, open_row=False)
    last = F.col("target_period") == F.lit(ENDS[59])
    poisoned = rows.withColumn("value", F.when(last, 1e9).otherwise(F.col("value")))
    assert sorted(model(rows).collect()) == sorted(model(poisoned).collect())


def test_kalman_bands_and_switch(spark):
    rows = bridge_frame(spark, noise=2.0)
    a = {r.target_period: r for r in fc.kalman_nowcast(rows).collect()}
    b = {r.target_period: r for r in fc.kalman_nowcast(rows, entering=True).collect()}
    assert set(a) == set(b) == set(ENDS[36:61])
    assert all(r.low95 <= r.low80 <= r.point <= r.high80 <= r.high95 for r in a.values())
    assert any(abs(a[k].point - b[k].point) > 1e-6 for k in a)


def test_kalman_follows_a_strong_weekly_signal(spark):
    rows = bridge_frame(spark)
    last = {r.target_period: r for r in fc.kalman_nowcast(rows).collect()}[ENDS[60]]
    typical = rows.agg(F.avg("value")).first()[0]
    assert last.point > typical + 50


def test_coverage_is_null_safe(spark):
    slots = spark.createDataFrame([("s", ENDS[0], ENDS[0])], "series_id string, "
                                  "target_period date, slot date")
    none = spark.createDataFrame([], "series_id string, slot date, change double")
    row = feat.coverage_and_pace(none, slots, ["series_id", "target_period"]).first()
    assert row.coverage == 0 and row.paced_change is None and row.weeks_expected == 1


def test_evaluate_and_comparability(spark):
    h = history(spark, [1.0, 2.0, 4.0, 3.0])
    f = spark.createDataFrame(
        [("s", ENDS[i], "m", p) for i, p in ((1, 3.0), (2, 3.0), (3, 5.0))],
        "series_id string, obs_period date, model string, point double")
    row = ev.evaluate(f, h).first()
    assert (row.observations, row.mae) == (3, pytest.approx(4 / 3))
    assert row.acceleration_accuracy == pytest.approx(2 / 3) and row.coverage80 is None
    assert ev.check_comparable(f, h, ENDS[1], ["m"]).count() == 0
    short = ev.check_comparable(f.filter(F.col("point") < 5), h, ENDS[1], ["m", "n"])
    assert {(r.model, r.problem, r.row_count) for r in short.collect()} == {
        ("m", "missing period", 1), ("n", "missing period", 3)}


def calibration_frames(spark, n=40):
    h = spark.createDataFrame(
        [("s", ENDS[i], float((i * 7) % 11), ENDS[i] + dt.timedelta(days=40), f"https://x/{i}") for i in range(n)],
        "series_id string, obs_period date, value double, release_date date, source_url string")
    p = spark.createDataFrame(
        [("p", "s", ENDS[n - 1], ENDS[n - 1], 3.0, 2.0, 4.0, 1.0, 5.0)],
        "prediction_id string, target_series string, target_period date, made_at date, point double, "
        "low80 double, high80 double, low95 double, high95 double")
    value = float(((n - 1) * 7) % 11)
    g = spark.createDataFrame([("p", value, f"https://x/{n - 1}", abs(3.0 - value))],
                              "prediction_id string, actual_first_print double, vintage_url string, "
                              "abs_error double")
    return p, g, h, spark.createDataFrame([("s", fc.AR2)], "series_id string, model string")


def test_calibration_rules(spark):
    p, g, h, best = calibration_frames(spark)

    def problem(*frames):
        rows = ev.live_calibration(*frames).collect()
        assert len(rows) == 1
        return rows[0].problem

    assert problem(p, g, h, best) is None
    assert problem(p.union(p), g, h, best) == "prediction repeated"
    assert problem(p, g.withColumn("vintage_url", F.lit("https://y")), h, best) == "vintage differs"
    assert problem(p, g, h.union(h), best) == "first print repeated"
    assert problem(p, g, h.withColumn("value", F.col("value") + 1), best) == "first print differs"
    assert problem(p, g, h, best.limit(0)) == "no comparator"
    assert problem(p.limit(0), g, h, best) == "no prediction"


def test_scheduled_series_step_from_the_calendar(spark):
    p, g, h, best = calibration_frames(spark)
    a = ev.live_calibration(p, g, h, best).first()
    b = ev.live_calibration(p, g, h, best, scheduled=["s"]).first()
    # The month before the target is not out when the prediction is made.
    assert a.problem is None and b.problem == "comparator unavailable"
    early = h.withColumn("release_date", F.col("obs_period"))
    late = early.filter(F.col("obs_period") < F.lit(ENDS[39])).union(
        h.filter(F.col("obs_period") == F.lit(ENDS[39])))
    a = ev.live_calibration(p, g, late, best).first()
    b = ev.live_calibration(p, g, late, best, scheduled=["s"]).first()
    assert a.naive_point == pytest.approx(b.naive_point)
