import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.functions import keys as k
from vintagekit.operators import contracts as c
from vintagekit.operators import ledger as lg
from vintagekit.schemas import required_columns, schema_for, table_names
from vintagekit.sinks import feeds, lake
from vintagekit.sources import tables as tb
from vintagekit.streaming import incremental as inc

PERIOD, MADE = dt.date(2024, 3, 31), dt.date(2024, 4, 5)


def forecasts(spark, point=10.0, made=MADE):
    return spark.createDataFrame(
        [("m", "h", "s", PERIOD, made, point, point - 1, point + 1, point - 2, point + 2)],
        "model_version string, inputs_hash string, target_series string, target_period date, "
        "made_at date, point double, low80 double, high80 double, low95 double, high95 double")


def test_append_keeps_the_first_time_and_stops_conflicts(spark):
    first = lg.to_predictions(forecasts(spark))
    assert lg.check_predictions(first).count() == 0
    empty = first.filter(F.lit(False))
    assert lg.append_predictions(first, empty).first().outcome == "append"
    later = lg.to_predictions(forecasts(spark, 10.0 + 1e-12, dt.date(2024, 4, 9)))
    assert lg.append_predictions(later, first).first().outcome == "present"
    other = lg.to_predictions(forecasts(spark, 11.0))
    assert lg.append_predictions(other, first).first().outcome == "conflict"
    both = first.unionByName(later)
    assert lg.append_predictions(both, empty).first().made_at == MADE


def targets(spark, value, released):
    return spark.createDataFrame(
        [("s", PERIOD, value, released, "u")], "series_id string, obs_period date, value double, "
        "release_date date, source_url string")


def test_grading_needs_a_release_after_the_prediction(spark):
    p = lg.to_predictions(forecasts(spark))
    none = p.select("prediction_id").filter(F.lit(False))
    t = targets(spark, 12.5, dt.date(2024, 5, 7))
    early = lg.grade_outcomes(p, t, none, "2024-05-06").first()
    assert early.outcome == "not matured"
    new, counts = lg.grade_matured(p, t, none, "2024-05-07")
    assert new.first().abs_error == 2.5 and counts.first().appended == 1
    assert lg.grade_matured(p, t, new, "2024-05-08")[0].count() == 0
    assert lg.verify_regrade(p, new, t).count() == 0
    assert lg.verify_regrade(p, new, targets(spark, 13.0, dt.date(2024, 5, 7))).first().problem == (
        "value differs")
    past = targets(spark, 12.5, MADE)
    assert lg.grade_outcomes(p, past, none, "2024-05-08").first().outcome == (
        "released before prediction")


def test_first_publication_wins(spark):
    rows = spark.createDataFrame(
        [("a", dt.date(2024, 1, 3)), ("a", dt.date(2024, 1, 2)), ("b", dt.date(2024, 1, 5))],
        "prediction_id string, published_at date")
    stored = rows.filter("prediction_id = 'b'")
    assert [tuple(r) for r in lg.append_publications(rows, stored).collect()] == [
        ("a", dt.date(2024, 1, 2))]


def test_receipts_show_tampering(spark):
    made = k.receipt(spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"), ["a", "b"],
                     "rid")
    assert k.tampered_receipts(made, ["a", "b"], "rid").count() == 0
    assert k.tampered_receipts(made.withColumn("a", F.lit(1)), ["a", "b"], "rid").count() == 1


def test_batch_hash_ignores_order_but_not_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    b = a.orderBy(F.desc("a"))
    twice = a.unionByName(a.limit(1))

    def h(df):
        return k.batch_hash(df).first().batch_hash

    assert h(a) == h(b) != h(twice)


def calendar_row(spark, name="x", status="OK"):
    return spark.createDataFrame([(name, None, None, status)], schema_for("releases_calendar"))


def test_sixteen_contracts(spark):
    assert len(table_names()) == 16
    assert len(schema_for("auto_abs_aggregates")) == 34
    assert schema_for("auto_abs_aggregates")["recovered_amount_sum"].dataType.scale == 8
    assert "verified_at" not in required_columns("series_registry")
    with pytest.raises(KeyError):
        schema_for("nothing")


def test_append_is_idempotent_and_strict(spark, folder):
    assert tb.read_table(spark, folder, "releases_calendar").count() == 0
    row = calendar_row(spark)
    assert not lake.append_batch(row, folder, "releases_calendar").already_present
    assert lake.append_batch(row, folder, "releases_calendar").already_present
    assert tb.read_table(spark, folder, "releases_calendar").count() == 1
    with pytest.raises(c.ContractError):
        lake.append_batch(row.drop("status"), folder, "releases_calendar")
    loose = spark.createDataFrame([("x", None, None, None)],
                                  "release_name string, expected_at timestamp, "
                                  "actual_at timestamp, status string")
    with pytest.raises(c.ContractError):
        lake.append_batch(loose, folder, "releases_calendar")


def test_same_identity_other_rows_is_an_error(spark, folder):
    lake.append_new(calendar_row(spark), folder, "releases_calendar", ["release_name"])
    assert lake.append_new(calendar_row(spark), folder, "releases_calendar",
                           ["release_name"]) is None
    with pytest.raises(c.ContractError):
        lake.append_new(calendar_row(spark, "x", "LATE"), folder, "releases_calendar",
                        ["release_name"])


def test_conflicts_can_be_recorded_while_the_rest_goes_on(spark, folder):
    lake.append_new(calendar_row(spark), folder, "releases_calendar", ["release_name"])
    both = calendar_row(spark, "x", "LATE").unionByName(calendar_row(spark, "y"))
    again = both.unionByName(calendar_row(spark, "y"))
    receipt = lake.append_new(again, folder, "releases_calendar", ["release_name"],
                              failures=f"{folder}/failures")
    assert receipt.row_count == 1
    assert [r.release_name for r in spark.read.parquet(f"{folder}/failures").collect()] == ["x"]
    names = sorted(r.release_name for r in
                   tb.read_table(spark, folder, "releases_calendar").collect())
    assert names == ["x", "y"]


def test_failed_publication_keeps_the_old_version(spark, folder):
    good = spark.range(3)
    lake.publish_atomically(good, folder, "v1")
    broken = spark.range(3).select(F.assert_true(F.col("id") < 2).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="assert|true|failed"):
        lake.publish_atomically(broken, folder, "v2")
    assert lake.published_version(spark, folder) == "v1"
    assert lake.read_published(spark, folder, good.schema).count() == 3


def test_manifest_sees_a_changed_byte(spark, folder, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one")
    (tmp_path / "y.txt").write_text("two")
    rows = {r.file: r.bytes for r in lake.file_manifest(spark, folder).collect()}
    assert rows == {"a/x.txt": 3, "y.txt": 3}
    before = lake.tree_hash(lake.file_manifest(spark, folder)).first().tree_hash
    (tmp_path / "y.txt").write_text("twp")
    assert lake.tree_hash(lake.file_manifest(spark, folder)).first().tree_hash != before


def test_second_feed_version_only_adds(spark):
    for feed in feeds.FEEDS:
        old, new = feeds.feed_columns(feed, 1), feeds.feed_columns(feed, 2)
        assert [n for n in new if n in old] == list(old)
    assert "lift" not in feeds.feed_columns("companies", 1)


def test_late_earlier_release_wins_in_a_stream(spark, folder):
    schema = spark.createDataFrame([], "s string, p date, r date, v int").schema
    keys, order = ["s", "p"], ["r", "v"]
    p = dt.date(2024, 1, 31)
    for name, row in (("1", ("a", p, dt.date(2024, 3, 1), 2)), ("2", ("a", p, dt.date(2024, 2, 1), 1)),
                      ("3", ("a", p, dt.date(2024, 4, 1), 3))):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(
            f"{folder}/in")
        stream = inc.file_stream(spark, f"{folder}/in", schema)
        inc.first_print_stream(stream, folder, f"{folder}/check", keys, order).awaitTermination()
        assert name
    assert [r.v for r in inc.first_prints(spark, folder, schema, keys, order).collect()] == [1]
    assert tb.read_table(spark, folder, "first_prints", schema).count() == 2


LISTS = "name string, tags array<string>, ingested_at timestamp"


def listed(spark, *rows):
    return spark.createDataFrame([(n, tags, None) for n, tags in rows], LISTS)


def test_rows_that_differ_in_a_list_are_both_kept(spark, folder):
    rows = listed(spark, ("x", ["a"]), ("x", ["b"]), ("x", ["b"]), ("x", None), ("x", []))
    receipt = lake.append_new(rows, folder, "tagged", ["name"], rows.schema)
    assert receipt.row_count == 4
    stored = tb.read_table(spark, folder, "tagged", rows.schema).collect()
    assert sorted(str(r.tags) for r in stored) == ["None", "['a']", "['b']", "[]"]
    assert lake.append_new(rows, folder, "tagged", ["name"], rows.schema) is None
    with pytest.raises(c.ContractError):
        lake.append_new(listed(spark, ("x", ["c"])), folder, "tagged", ["name"], rows.schema)


def test_null_identity_is_one_identity(spark, folder):
    rows = listed(spark, (None, ["a"]), ("y", ["b"]))
    assert lake.append_new(rows, folder, "tagged", ["name"], rows.schema).row_count == 2
    assert lake.append_new(rows, folder, "tagged", ["name"], rows.schema) is None


def test_index_is_read_by_pieces_and_can_be_compacted(spark, folder):
    for i in range(4):
        rows = listed(spark, *[(f"k{i}-{j}", ["a"]) for j in range(5)])
        assert lake.append_new(rows, folder, "tagged", ["name"], rows.schema).row_count == 5
    ids = spark.read.parquet(f"{folder}/tagged_index").select(
        "name", "content_hash", F.col("piece").cast("bigint").alias("piece")).schema
    before = {r.name for r in spark.read.parquet(f"{folder}/tagged_index").collect()}
    lake.compact_index(spark, folder, "tagged", ids)
    after = spark.read.parquet(f"{folder}/tagged_index")
    assert {r.name for r in after.collect()} == before and len(before) == 20
    assert after.select("batch_id").distinct().count() == 1
    assert lake.append_new(rows, folder, "tagged", ["name"], rows.schema) is None


def test_null_in_a_required_column_leaves_nothing(spark, folder):
    schema = T.StructType([T.StructField("a", T.StringType(), False)])
    loose = spark.createDataFrame([(None,)], "a string")
    with pytest.raises(Exception, match="null|contract"):
        lake.append_batch(loose, folder, "strict", schema)
    assert tb.read_table(spark, folder, "strict", schema).count() == 0


def test_replayed_publication_leaves_the_published_files(spark, folder, tmp_path):
    lake.publish_atomically(spark.range(3), folder, "v1")
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("data/**/*.parquet")}
    lake.publish_atomically(spark.range(3), folder, "v1")
    assert files and all(p.stat().st_mtime_ns == at for p, at in files.items())
    assert lake.read_published(spark, folder, spark.range(1).schema).count() == 3
