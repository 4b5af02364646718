"""Row identity, exact weights and repeated targets."""

from decimal import Decimal

from pyspark.sql import functions as F

from vintagekit.functions import keys
from vintagekit.operators import attribution as at
from vintagekit.operators import ledger as lg


def test_row_text_tells_rows_apart(spark):
    rows = [("x|y", "z"), ("x", "y|z"), (None, "a"), ("\\N", "a"), ("~", "a"), ("", "a"), ("1:", "a"),
            ("a", None), ("3:a", "~")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(keys.row_hash(["a", "b"])).distinct().count() == len(rows)


def test_weights_keep_every_digit(spark):
    df = spark.createDataFrame(
        [("a", 1.005), ("b", 2.0041), ("c", 0.001), ("d", 0.0)], "k string, v double")
    got = {r["k"]: r["weight"] for r in at.normalized_weights(df, "k", "v").collect()}
    total = Decimal("3.0101")
    for key, value in (("a", "1.005"), ("b", "2.0041"), ("c", "0.001")):
        assert abs(Decimal(got[key]) - Decimal(value) / total) < Decimal("1e-11")
    assert sum(Decimal(str(round(w, 12))) for w in got.values()) == 1


def test_weight_violations(spark):
    df = spark.createDataFrame(
        [("g", "a", 0.0), ("g", "b", 0.0), ("h", "a", 1.0), ("h", "b", None), ("i", "a", 2.0)],
        "g string, k string, v double")
    bad = {r["g"]: (r["total"], r["bad_values"]) for r in at.weight_violations(df, "v", ["g"]).collect()}
    assert set(bad) == {"g", "h"} and bad["h"][1] == 1
    weights = {(r["g"], r["k"]): r["weight"] for r in at.normalized_weights(df, "k", "v", ["g"]).collect()}
    assert weights["g", "a"] is None and weights["i", "a"] == 1.0


def test_repeated_targets_are_not_graded(spark):
    p = spark.sql("SELECT 'p' AS prediction_id, 's' AS target_series, DATE '2000-01-31' AS target_period,"
                  " DATE '2000-01-31' AS made_at, 1.0D AS point")
    one = spark.sql("SELECT 's' AS series_id, DATE '2000-01-31' AS obs_period, 2.0D AS value,"
                    " DATE '2000-03-01' AS release_date, 'u' AS source_url")
    none = spark.createDataFrame([], "prediction_id string")
    new, counts = lg.grade_matured(p, one.union(one), none, "2000-06-30")
    assert new.count() == 0
    row = counts.first()
    assert (row["attempted"], row["appended"], row["repeated_target"]) == (1, 0, 1)
    assert lg.grade_matured(p, one, none, "2000-06-30")[0].count() == 1
    assert lg.grade_matured(p, one, none, "2000-02-01")[1].select(
        F.col("not_matured")).first()[0] == 1
