import datetime as dt
import gzip
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vintagekit.functions import text as tx
from vintagekit.operators import loans as ln
from vintagekit.operators import quality as qa
from vintagekit.sources import html as hs
from vintagekit.sources import json_sources as js
from vintagekit.sources import release_text as rt
from vintagekit.sources import sheets as sh
from vintagekit.sources import xml_sources as xs

TAPE = """<?xml version="1.0"?>
<assetData xmlns="http://data.example/tape">
 <assets><assetNumber>n-1</assetNumber>
  <reportingPeriodBeginningDate>06-01-2026</reportingPeriodBeginningDate>
  <reportingPeriodEndingDate>06-30-2026</reportingPeriodEndingDate>
  <originalLoanAmount>17148.76000000</originalLoanAmount><originalLoanTerm>86</originalLoanTerm>
  <originalInterestRatePercentage>0.14000000</originalInterestRatePercentage>
  <reportingPeriodBeginningLoanBalanceAmount>4057.23</reportingPeriodBeginningLoanBalanceAmount>
  <reportingPeriodActualEndBalanceAmount>3717.93</reportingPeriodActualEndBalanceAmount>
  <remainingTermToMaturityNumber>11</remainingTermToMaturityNumber>
  <assetAddedIndicator>false</assetAddedIndicator><recoveredAmount>0</recoveredAmount></assets>
 <assets><assetNumber>n-2</assetNumber>
  <reportingPeriodBeginningDate>06/01/2026</reportingPeriodBeginningDate>
  <reportingPeriodEndingDate>2026-06-30</reportingPeriodEndingDate>
  <recoveredAmount>12.50</recoveredAmount></assets>
</assetData>"""


def test_gzip_tape_to_exact_aggregates(spark, tmp_path):
    with gzip.open(tmp_path / "t.xml.gz", "wt") as f:
        f.write(TAPE)
    rows = xs.read_loan_tape(spark, str(tmp_path)).withColumn("trust_id", F.lit("t"))
    r = ln.loan_aggregate(rows).first()
    assert (r.asset_count, r.core_metric_asset_count, r.recovery_only_asset_count) == (2, 1, 1)
    assert r.period_end == dt.date(2026, 6, 30)
    assert r.original_loan_amount_sum == Decimal("17148.76")
    assert r.beginning_balance_sum == Decimal("4057.23")
    assert r.ending_balance_sum == Decimal("3717.93")
    assert r.recovered_amount_sum == Decimal("12.50")
    assert r.weighted_avg_original_interest_rate == Decimal("0.14")
    assert (r.weighted_avg_original_loan_term, r.weighted_avg_remaining_term) == (86, 11)
    assert r.weighted_avg_reporting_interest_rate is None
    assert [x.metric for x in ln.zero_weights(ln.loan_aggregate(rows), ["trust_id"]).collect()] == [
        "weighted_avg_reporting_interest_rate"]
    assert xs.bad_tape_values(spark, str(tmp_path)).count() == 0


def test_quotient_rounds_half_to_even_exactly(spark):
    cases = [("0.00000000025", "1"), ("0.00000000035", "1"), ("1", "3"), ("2", "3"),
             ("0.0441741399499955757", "1"), ("-2", "3"), ("5", "0")]
    df = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in cases],
                               "n decimal(32,16), d decimal(24,8)")
    got = [r[0] for r in df.select(ln.ratio(F.col("n"), F.col("d"), 10)).collect()]
    want = [None if b == "0" else (Decimal(a) / Decimal(b)).quantize(Decimal("1e-10"))
            for a, b in cases]
    want[0] = Decimal("0.0000000002")
    want[1] = Decimal("0.0000000004")
    assert got == want


def test_table_cells_context_and_scripts(spark):
    page = ("<p>Segment note</p><script>x='<table>'</script><table><tr><th>Name<th>2025</tr>"
            "<tr><td>Net&nbsp;sales</td><td>$ <b>1,234</b></td></tr><tr></tr></table>"
            "<p>after</p><table><tr><td>b</td></tr></table>")
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    rows = {r.table_no: r for r in hs.extract_html_tables(df).collect()}
    assert set(rows) == {1, 2} and rows[1].context == "Segment note"
    assert rows[1].rows == [["Name", "2025"], ["Net sales", "$ 1,234"]]
    tables = hs.extract_html_tables(df)
    assert hs.choose_table(tables, "SEGMENT", ["net sales"]).first().match_count == 1
    assert hs.choose_table(tables, "segment", ["gross"]).count() == 0


def test_cell_numbers(spark):
    df = spark.createDataFrame([("$ 1,234.5",), ("(2.5)",), ("12%",), ("—",), ("",)], "c string")
    got = [r[0] for r in df.select(tx.cell_number("c")).collect()]
    assert got == [Decimal("1234.5"), Decimal("-2.5"), Decimal(12), None, None]


def test_issuer_names(spark):
    df = spark.createDataFrame([("Société Générale SA",), ("AT&T Inc.",), ("The Coca-Cola Company",)],
                               "n string")
    assert [r[0] for r in df.select(tx.normalize_issuer("n")).collect()] == [
        "societegenerale", "atandt", "cocacola"]


def test_week_headers_cross_the_year(spark):
    page = ("<table><tr><th>Dec 18</th><th>Dec 25</th><th>Jan 1</th><th>Jan 8</th></tr>"
            "<tr><td>1</td><td>All</td><td>3.0</td><td>3.1</td><td>3.2</td><td>3.3</td></tr>"
            "<tr><td>2</td><td>Part</td><td>3.0</td><td>3.1</td><td>3.2</td><td>2.0</td></tr></table>")
    df = spark.createDataFrame([(1, page, dt.date(2025, 1, 17))],
                               "page_id int, html string, release_date date")
    tables = hs.extract_html_tables(df).join(df.drop("html"), "page_id")
    out = hs.extract_weekly_block(tables, {"All": "T", "Part": "P"}, "All").collect()
    assert {r.obs_period for r in out} == {dt.date(2024, 12, 18), dt.date(2024, 12, 25),
                                           dt.date(2025, 1, 1), dt.date(2025, 1, 8)}
    assert {r.problem for r in out if r.obs_period == dt.date(2025, 1, 8)} == {
        "parts do not sum to total"}
    assert {r.value for r in out if r.series_id == "T"} == {3000, 3100, 3200, 3300}


def test_release_text_checks_the_zone(spark):
    text = ("{zone} MONDAY, JULY 15, 2024 June 2024 Table 1. Retail & food services, total 1 2 3 4 5 "
            "6 7 701,000 700,250 10 11 12 Total (excl. x)")
    df = spark.createDataFrame(
        [(i, dt.date(2024, 6, 30), text.format(zone=f"FOR RELEASE AT 8:30 A.M. {z},"))
         for i, z in enumerate(("EDT", "EST"))], "i int, target_period date, text string")
    a, b = rt.extract_text_flow(df).orderBy("i").collect()
    assert (a.flow, a.problem, a.release_at) == (750.0, None, dt.datetime(2024, 7, 15, 12, 30))
    assert b.problem == "time zone label differs"


def test_company_facts_keep_digits(spark):
    doc = ('{"cik":1,"facts":{"us-gaap":{"R":{"label":"L","units":{"USD":['
           '{"end":"2025-12-31","val":1.50,"accn":"a","form":"10-K"},'
           '{"end":"2025-12-31","val":12345678901234567890,"accn":"b","form":"10-K"}]}}}}}')
    df = spark.createDataFrame([("d", doc)], "doc string, text string")
    rows = js.flatten_company_facts(df).orderBy("fact_index").collect()
    assert [r.value_json for r in rows] == ["1.50", "12345678901234567890"]
    pinned = spark.createDataFrame([("d", "b")], "doc string, accession string")
    assert [r.fact_index for r in js.flatten_company_facts(df, pinned).collect()] == [1]


def test_wide_sheet_lag(spark):
    df = spark.createDataFrame([("03:Q1", 1.0), ("26:Q1", 2.0), ("26-Q2", 3.0)], "period string, a double")
    long = sh.unpivot_wide_sheet(df)
    assert {r.problem for r in long.collect()} == {None, "bad period"}
    good = long.filter("problem is null")
    assert sh.sheet_lag_violations(good, "2026-03-31", {"a": 0}).count() == 0
    assert sh.sheet_lag_violations(good, "2026-06-30", {"a": 0}).count() == 1


@pytest.mark.parametrize("watermark, now, reason", [
    ("2026-01-10 00:00:00", "2026-01-10T10:00:00", "CURRENT"),
    ("2026-01-08 00:00:00", "2026-01-09T13:00:00", "AWAITING_RELEASE_WITHIN_SLA"),
    ("2026-01-08 00:00:00", "2026-01-09T15:00:00", "MISSED_RELEASE_SLA"),
    ("2026-01-10 00:00:00", "2026-01-20T00:00:00", "MAX_AGE_EXCEEDED"),
    ("2026-02-10 00:00:00", "2026-01-20T00:00:00", "NO_OBSERVATION"),
])
def test_freshness_ladder(spark, watermark, now, reason):
    obs = spark.createDataFrame([("S", "a", watermark)], "source string, series_id string, at string")
    obs = obs.select("source", "series_id", F.col("at").cast("timestamp_ntz").alias("ingested_at"))
    cal = spark.createDataFrame([("Weekly 1", "2026-01-09 12:00:00", "EXPECTED_RULE")],
                                "release_name string, e string, status string")
    cal = cal.select("release_name", F.col("e").cast("timestamp_ntz").alias("expected_at"),
                     F.lit(None).cast("timestamp_ntz").alias("actual_at"), "status")
    rules = spark.createDataFrame(
        [("p", "S", ["a"], ["Weekly"], 5 * 86400, 7200, False)],
        "source_id string, source string, entities array<string>, calendar_prefixes array<string>, "
        "max_age_seconds int, grace_seconds int, optional boolean")
    assert qa.freshness(obs, cal, rules, now).first().reason == reason


def test_path_rules_name_lines_not_text(spark):
    df = spark.createDataFrame(
        [("a", "ok\nsee C:\\Users\\kim\\x and /home/kim/y\r\non DESKTOP-AB12")], "d string, t string")
    got = {(r.line, r.rule) for r in qa.scan_text(df, "d", "t").collect()}
    assert got == {(2, "windows-user-profile"), (2, "unix-user-profile"), (3, "workstation-name")}
    assert qa.scan_text(df, "d", "t").columns == ["d", "line", "rule"]


def test_repeated_audit_key_stops_the_audit(spark):
    row = ("g", "s", "a", dt.date(2024, 1, 31), "u", "https://x", "c", 1.0)
    cols = [*qa.AUDIT_KEYS, "value"]
    one = spark.createDataFrame([row], cols)
    two = spark.createDataFrame([row, (*row[:-1], 2.0)], cols)
    assert [r.status for r in qa.spot_audit(one, one, "seed", 5).collect()] == ["PASS"]
    for stored, live in ((two, one), (one, two)):
        with pytest.raises(Exception, match="audit key is repeated"):
            qa.spot_audit(stored, live, "seed", 5).collect()
