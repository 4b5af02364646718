import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vintagekit.operators import attribution as at

PRIOR = "assumption_id string, low double, mid double, high double, tier int"


def bundle(spark):
    assumptions = spark.createDataFrame(
        [("a1", 0.2, 0.3, 0.4, 1), ("a2", 0.1, 0.2, 0.3, 3), ("b1", 0.3, 0.4, 0.5, 2),
         ("s1", 0.5, 0.6, 0.7, 1), ("s2", 0.8, 0.8, 0.8, 1)], PRIOR)
    flows = spark.createDataFrame([("p", "2026-Q1", 900.0, 1000.0, 1200.0)],
                                  "product string, quarter string, low double, mid double, "
                                  "high double")
    a = spark.createDataFrame(
        [("p", "food", 1, 0.2, 0.3, 0.4, "a1"), ("p", "broad", 3, 0.1, 0.2, 0.3, "a2")],
        "product string, category string, tier int, low double, mid double, high double, "
        "assumption_id string")
    b = spark.createDataFrame(
        [("food", "X", 0.3, 0.4, 0.5, "b1"), ("broad", "X", 0.25, 0.25, 0.25, None),
         ("broad", "Y", 0.5, 0.5, 0.5, None)],
        "category string, ticker string, low double, mid double, high double, "
        "assumption_id string")
    companies = spark.createDataFrame(
        [("X", "X Inc", 4000.0, "s1"), ("Y", "Y Inc", 8000.0, "s2")],
        "ticker string, company_name string, revenue_millions double, share_assumption_id string")
    return assumptions, flows, a, b, companies


def test_good_bundle_has_no_violation_and_bad_ones_do(spark):
    assumptions, flows, a, b, companies = bundle(spark)
    assert at.check_bundle(assumptions, flows, a, b, companies).count() == 0
    heavy = b.withColumn("high", F.lit(0.9)).withColumn("low", F.lit(0.1))
    rules = {r.rule for r in at.check_bundle(assumptions, flows, a, heavy, companies).collect()}
    assert rules == {"matrix B above one", "matrix B band without assumption",
                     "matrix B differs from assumption"}
    lone = companies.unionByName(companies.limit(1).withColumn("ticker", F.lit("Z")))
    assert {r.rule for r in at.check_bundle(assumptions, flows, a, b, lone).collect()} == {
        "company not covered"}


@pytest.fixture(scope="module")
def run(spark):
    assumptions, flows, a, b, companies = bundle(spark)
    draws = at.draw_blocks(at.all_priors(assumptions, flows), 10_000, 11).persist()
    contrib = at.contributions(flows, a, b, draws)
    ratios = at.company_ratios(contrib, companies, draws, ["broad"]).persist()
    return assumptions, flows, a, b, companies, draws, contrib, ratios


def test_bands_agree_with_the_midpoint_formula(run):
    assumptions, flows, a, b, companies, _, _, ratios = run
    bands = at.company_bands(ratios)
    est = at.midpoint_estimate(flows, a, b, companies, assumptions)
    assert {r.ticker: r.estimate for r in est.collect()} == {
        "X": pytest.approx((1000 * .3 * .4 + 1000 * .2 * .25) / 600 * 100),
        "Y": pytest.approx(1000 * .2 * .5 / 1600 * 100)}
    assert at.recompute_gaps(est, bands, 1.0).count() == 0
    assert all(r.low <= r.mid <= r.high for r in bands.collect())


def test_draws_follow_the_triangle_and_their_identity(spark, run):
    assumptions, flows = run[0], run[1]
    long = at.long_draws(run[5])
    values = np.array([r.value for r in long.filter("assumption_id = 'a1'").collect()])
    assert values.min() >= 0.2 and values.max() <= 0.4
    assert values.mean() == pytest.approx(0.3, abs=0.002)
    assert values.std() == pytest.approx(0.2 / 24 ** 0.5, rel=0.03)
    fewer = at.triangular_draws(at.all_priors(assumptions.filter("assumption_id = 'a1'"), flows),
                                10_000, 11).filter("assumption_id = 'a1'")
    assert sorted(r.value for r in fewer.collect()) == sorted(values)
    assert long.filter("assumption_id = 's2'").agg(F.min("value"), F.max("value")).first() == (
        0.8, 0.8)
    with pytest.raises(ValueError):
        at.triangular_draws(assumptions, 9_999, 1)


def test_lift_tiers_and_sensitivity(run):
    _, _, a, b, companies, draws, contrib, ratios = run
    lifts = {r.ticker: r for r in at.baseline_and_lift(ratios, b, ["broad"]).collect()}
    assert lifts["Y"].lift == 1 and lifts["Y"].lift_status == "baseline-only"
    assert lifts["X"].lift > 1 and lifts["X"].lift_status == "evidence-supported"
    shares = {r.ticker: r for r in at.tier_shares(contrib).collect()}
    assert shares["Y"].tier3_share == 1 and shares["Y"].tier1_share == 0
    for r in shares.values():
        assert r.tier1_share + r.tier2_share + r.tier3_share == pytest.approx(1)
    top = at.sensitivity_top_k(ratios, draws, at.used_assumptions(a, b, companies)).collect()
    assert {r.assumption_id for r in top if r.ticker == "Y"} == {"a2"}
    assert {r.assumption_id: r.direction for r in top if r.ticker == "X"}["s1"] == "decreases"


def test_block_size_changes_no_draw(spark):
    priors = bundle(spark)[0]
    whole = {(r.assumption_id, r.draw): r.value for r in at.triangular_draws(priors, 10_000, 3).collect()}
    odd = at.long_draws(at.draw_blocks(priors, 10_000, 3, size=777), 777)
    assert {(r.assumption_id, r.draw): r.value for r in odd.collect()} == whole


def test_blocks_agree_with_numpy(run):
    _, _, a, b, companies, draws, _, ratios = run
    values = {}
    for r in sorted(draws.collect(), key=lambda r: r.block):
        values.setdefault(r.assumption_id, []).extend(r["values"])
    rows = {}
    for r in sorted(ratios.collect(), key=lambda r: r.block):
        rows.setdefault(r.ticker, []).extend(r.ratio)
    x = {k: np.array(v) for k, v in values.items()}
    want = x["flow:p"] * (x["a1"] * x["b1"] + x["a2"] * 0.25) / (4000 / 4 * x["s1"]) * 100
    assert np.allclose(rows["X"], want, rtol=1e-12)
    band = {r.ticker: r for r in at.company_bands(ratios).collect()}["X"]
    assert np.allclose([band.low, band.mid, band.high], np.quantile(want, [0.1, 0.5, 0.9]), rtol=1e-12)
    top = at.sensitivity_top_k(ratios, draws, at.used_assumptions(a, b, companies)).collect()
    for r in top:
        c = np.corrcoef(x[r.assumption_id], rows[r.ticker])[0, 1]
        assert r.absolute_correlation == pytest.approx(abs(c), rel=1e-9)


def test_named_assumption_without_draws_stops(spark, run):
    _, flows, a, b, _, draws, _, _ = run
    with pytest.raises(Exception, match="no draws for assumption b1"):
        at.contributions(flows, a, b, draws.filter("assumption_id <> 'b1'")).collect()


def test_fallback_needs_another_group_and_widens(spark):
    reg = spark.createDataFrame(
        [("x", 0.2, 0.3, 0.9, "p", ["same", "far"], 2.0), ("y", 0.2, 0.3, 0.4, "p", ["same"], 2.0),
         ("z", 0.2, 0.3, 0.4, "far", ["same"], 2.0)],
        "assumption_id string, low double, mid double, high double, primary_source_id string, "
        "fallback_source_ids array<string>, band_multiplier double")
    src = spark.createDataFrame(
        [("p", "g", "PERMITTED", True), ("same", "g", "PERMITTED", True),
         ("far", "h", "PERMITTED", True)],
        "source_id string, independent_group string, terms_status string, available boolean")
    got = {r.assumption_id: r for r in at.resolve_sources(reg, src, ["p"]).collect()}
    assert (got["x"].active_source_id, got["x"].source_status) == ("far", "FALLBACK")
    assert got["x"].low == pytest.approx(0.1) and got["x"].high == 1.0
    assert got["y"].source_status == "BLOCKED" and got["z"].source_status == "PRIMARY"
    flows = bundle(spark)[1]
    resolved = at.resolve_sources(reg, src, ["p"])
    with pytest.raises(Exception, match="BLOCKED: no source left for y"):
        at.draw_blocks(at.all_priors(resolved, flows), 10_000, 1).collect()
    at.draw_blocks(at.all_priors(resolved.filter("assumption_id <> 'y'"), flows), 10_000, 1).collect()


def test_unregistered_and_repeated_sources_are_violations(spark):
    reg = spark.createDataFrame(
        [("x", 0.2, 0.3, 0.9, "p", ["far", "far"], 2.0), ("y", 0.2, 0.3, 0.4, "none", ["far"], 2.0),
         ("z", 0.2, 0.3, 0.4, "p", ["gone"], 2.0)],
        "assumption_id string, low double, mid double, high double, primary_source_id string, "
        "fallback_source_ids array<string>, band_multiplier double")
    src = spark.createDataFrame(
        [("p", "g", "PERMITTED", True), ("p", "g", "PERMITTED", True), ("far", "h", "REVIEW", True)],
        "source_id string, independent_group string, terms_status string, available boolean")
    rows = at.source_violations(reg, src, at.resolve_sources(reg, src.distinct()))
    assert sorted(map(tuple, rows.collect())) == [
        ("BLOCKED", "y"), ("available without permission", "far"), ("fallback named twice", "x"),
        ("fallback not registered", "z"), ("primary not registered", "y"), ("source listed twice", "p")]


def test_ttm_from_a_filing_pair(spark):
    facts = spark.createDataFrame(
        [("X", "10-K", "FY", "2025-01-01", "2025-12-31", "2026-02-20", "k", 100.0),
         ("X", "10-Q", "Q1", "2026-01-01", "2026-03-31", "2026-05-01", "q", 30.0),
         ("X", "10-Q", "Q1", "2025-01-01", "2025-03-31", "2026-05-01", "q", 20.0),
         ("X", "10-Q", "Q1", "2026-02-15", "2026-03-31", "2026-05-01", "q", 15.0)],
        "ticker string, form string, fp string, start string, end string, filed string, "
        "accession string, value double")
    for col in ("start", "end", "filed"):
        facts = facts.withColumn(col, F.to_date(col))
    filings = facts.filter("year(end) = 2026 or form = '10-K'").select(
        "ticker", "form", "filed", F.col("end").alias("period"), "accession").distinct()
    annual = at.annual_fact(facts, "2026-06-01", "2026-03-31")
    pair = at.ytd_pair(facts, at.latest_filing(filings, "10-Q", "2026-06-01", annual, "2026-03-31"))
    row = at.ttm_revenue(annual, pair).first()
    assert (row.revenue, row.status, row.plausible) == (110.0, "UPDATED_TTM_FROM_10Q", True)
    late = at.latest_filing(filings, "10-Q", "2026-04-30", annual, "2026-03-31")
    base = at.ttm_revenue(annual, at.ytd_pair(facts, late)).first()
    assert (base.revenue, base.status) == (100.0, "BASELINE_NO_NEW_10Q")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=9))
def test_weights_sum_to_exactly_one(spark, cents):
    df = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(cents)], "k string, v bigint")
    got = sorted((r.k, r.weight) for r in at.normalized_weights(df, "k", "v").collect())
    units = [round(w * 10**12) for _, w in got]
    assert sum(units) == 10**12
    assert units[:-1] == [v * 10**12 // sum(cents) for v in cents[:-1]]
