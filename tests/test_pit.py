import datetime as dt

import pytest
from pyspark.sql import functions as F

from vintagekit.functions import calendar as cal
from vintagekit.operators import contracts as c
from vintagekit.operators import pit

UTC = dt.UTC
OBS = "series_id string, obs_period date, value double, release_date timestamp, checksum string"


def d(text):
    return dt.date.fromisoformat(text)


def ts(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


@pytest.fixture
def canary(spark):
    return spark.createDataFrame([
        ("s", d("2024-01-01"), 1.0, ts("2024-02-01"), "a"),
        ("s", d("2024-02-01"), 999999.0, ts("2024-03-01"), "b")], OBS)


def test_future_row_never_leaks(canary):
    assert [r.value for r in pit.as_of(canary, ts("2024-02-15")).collect()] == [1.0]
    assert canary.count() == 2


def test_bare_date_means_end_of_day(canary):
    assert pit.as_of(canary, d("2024-03-01")).count() == 2
    assert pit.as_of(canary, d("2024-02-29")).count() == 1


def test_as_of_needs_a_zone(canary):
    with pytest.raises(ValueError):
        pit.as_of(canary, dt.datetime(2024, 2, 15))


def test_latest_and_first_break_ties(spark):
    rows = spark.createDataFrame([
        ("s", d("2024-01-31"), 1.0, ts("2024-02-01"), "a"),
        ("s", d("2024-01-31"), 2.0, ts("2024-03-01"), "a"),
        ("s", d("2024-01-31"), 3.0, ts("2024-03-01"), "b")], OBS)
    key = ["series_id", "obs_period"]
    assert pit.latest_vintage(rows, key).first().value == 3.0
    assert pit.first_print(rows, key, ["release_date", "checksum"]).first().value == 1.0
    assert pit.vintage_conflicts(rows, [*key, "release_date"], "value").count() == 1


def brute_as_of(left, right, strict):
    out = []
    for key, at in left:
        seen = [(t, v) for k, t, v in right if k == key and (t < at if strict else t <= at)]
        out.append((key, at, max(seen)[1] if seen else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", ["year", "month"])
def test_as_of_join_equals_brute_force(spark, strict, bucket):
    start = d("2019-11-20")
    right = [(i % 3, start + dt.timedelta(days=(i * 37) % 900), i) for i in range(120)]
    left = [(i % 4, start + dt.timedelta(days=(i * 53) % 1000 - 40)) for i in range(90)]
    lf = spark.createDataFrame(left, "k int, at date")
    rf = spark.createDataFrame(right, "k int, t date, v int")
    got = pit.as_of_join(lf, rf, ["k"], "at", "t", ["v"], strict, bucket)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_as_of(left, right, strict)


def test_as_of_join_at_the_boundary(spark):
    lf = spark.createDataFrame([("s", d("2024-01-05"))], "k string, at date")
    rf = spark.createDataFrame([("s", d("2024-01-05"), 7), ("s", d("2023-01-05"), 6)],
                               "k string, t date, v int")
    assert pit.as_of_join(lf, rf, ["k"], "at", "t", ["v"]).first().v == 7
    assert pit.as_of_join(lf, rf, ["k"], "at", "t", ["v"], strict=True).first().v == 6


def test_continuity_and_history_violations(spark):
    rows = spark.createDataFrame([
        ("s", d("2024-01-31"), 1.0, ts("2024-02-10"), "a"),
        ("s", d("2024-02-29"), 1.0, ts("2024-02-20"), "a"),
        ("s", d("2024-04-30"), 1.0, ts("2024-05-10"), "a"),
        ("s", d("2024-05-31"), 1.0, ts("2024-05-05"), "a")], OBS)
    found = {(r.obs_period, r.problem) for r in
             pit.target_history_violations(rows, d("2024-12-31")).collect()}
    assert found == {(d("2024-02-29"), "released before period end"), (d("2024-04-30"), "gap"),
                     (d("2024-05-31"), "released before period end"),
                     (d("2024-05-31"), "release order")}
    with pytest.raises(c.ContractError):
        c.require(pit.target_history_violations(rows, d("2024-12-31")), "history")


def test_latest_complete_quarter(spark):
    rows = [(s, d(m), v, ts(r)) for s, v in (("a", 10.0), ("b", 20.0))
            for m, r in (("2026-01-31", "2026-03-05"), ("2026-02-28", "2026-04-05"),
                         ("2026-03-31", "2026-05-05"))]
    rows.append(("a", d("2026-04-30"), 99.0, ts("2026-06-05")))
    df = spark.createDataFrame(rows, "series_id string, obs_period date, value double, "
                                     "release_date timestamp")
    got = {r.series_id: (r.quarter, r.total, r.data_vintage.replace(tzinfo=UTC))
           for r in pit.latest_complete_group(df, d("2026-12-31")).collect()}
    assert got == {"a": ("2026-Q1", 30.0, ts("2026-05-05")), "b": ("2026-Q1", 60.0,
                                                                    ts("2026-05-05"))}
    assert pit.latest_complete_group(df, d("2026-05-01")).count() == 0


def test_month_ends(spark):
    row = spark.range(1).select(
        cal.shift_month_end(F.lit(d("2024-02-29")), 1).alias("a"),
        cal.month_ends_between(F.lit(d("2024-01-15")), F.lit(d("2024-03-01"))).alias("b"),
        cal.month_ends_between(F.lit(d("2024-03-01")), F.lit(d("2024-01-15"))).alias("c"),
        cal.weekdays_in_month(F.lit(d("2024-05-31"))).alias("w")).first()
    assert row.a == d("2024-03-31") and len(row.b) == 3 and row.c == []
    assert [x.day for x in row.w] == [1, 8, 15, 22, 29]


def test_contract_checks(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0)], "k int, v double")
    assert c.check_not_null(df, ["k", "v"]).collect()[0].rule == "v not null"
    assert c.check_unique(df, ["k"]).first().row_count == 2
    assert {(r.rule, r.column_name) for r in c.check_columns(df, ["k", "w"]).collect()} == {
        ("missing", "w"), ("extra", "v")}
    same = spark.createDataFrame([(1, 2.0), (1, None)], "k int, v double")
    assert c.batch_conflicts(df, same, ["k"]).count() == 0
    other = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, v double")
    assert c.batch_conflicts(df, other, ["k"]).count() == 2
