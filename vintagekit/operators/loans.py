"""Loan-tape and trust aggregates with exact decimals.

A tape row has trust_id, period_start, period_end, asset_number, original_amount,
beginning_balance, ending_balance, original_rate, reporting_rate, original_term, remaining_term,
added, recovered. Every aggregate here is one groupBy that combines before its exchange, so a trust
with a third of all loans costs no more than its share of the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.functions import calendar as cal
from vintagekit.operators import contracts as c

MONEY, RATE_PLACES, TERM_PLACES = "decimal(38,8)", 10, 8
# At 18 digits a decimal is one long; an amount of ten billion or more raises.
AMOUNT, VALUE = "decimal(18,8)", "decimal(14,8)"
CORE_FIELDS = ("original_amount", "beginning_balance", "ending_balance", "original_rate",
               "original_term")
OPTIONAL_FIELDS = ("reporting_rate", "remaining_term", "added")
IDENTIFIERS = ("asset_number",)


def parse_mixed_dates(col: str | Column) -> Column:
    """ISO, MM-DD-YYYY or MM/DD/YYYY; anything else is null."""
    text = F.col(col) if isinstance(col, str) else col
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    dash = F.when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(text, "M-d-yyyy"))
    slash = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy"))
    return F.coalesce(iso, dash, slash)


def ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """Decimal quotient rounded half to even; null for a weight that is not positive.

    Decimal division gives up fraction digits, and rounding twice can move a near tie. So the
    digits come from whole quotients and remainders, which are exact, and the last remainder
    decides the rounding. `places` is even; operands keep 16 whole digits.
    """
    step = F.lit(10 ** (places // 2)).cast("decimal(6,0)")
    d = F.nullif(denominator.cast("decimal(24,8)"), F.lit(0).cast("decimal(24,8)"))

    def divide(x: Column) -> tuple[Column, Column]:
        return F.call_function("div", x, d), (x % d).cast("decimal(32,16)")

    whole, rest = divide(F.abs(numerator.cast("decimal(32,16)")))
    high, rest = divide(rest * step)
    low, rest = divide(rest * step)
    units = (whole.cast("decimal(18,0)") * step + high) * step + low
    twice, odd = rest * 2, F.pmod(low, F.lit(2)) == 1
    units = units + F.when((twice > d) | ((twice == d) & odd), 1).otherwise(0)
    signed = units * F.when(numerator < 0, -1).otherwise(1)
    scaled = signed.cast("decimal(28,0)") / F.lit(10 ** places).cast(f"decimal({places + 1},0)")
    return F.when(denominator > 0, scaled.cast(f"decimal(18,{places})"))


def _weighted(value: Column, weight: Column) -> tuple[Column, Column]:
    """Sums of value times weight, and of the weight, where the value is present."""
    return (F.sum(value.cast(VALUE) * weight.cast(AMOUNT)),
            F.sum(F.when(value.isNotNull(), weight.cast(AMOUNT))))


def weighted_average(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, places: int = RATE_PLACES
) -> DataFrame:
    """sum(v w) / sum(w) over rows that have v; a zero weight gives null, which is a violation."""
    num, den = _weighted(F.col(value), F.col(weight))
    return df.groupBy(*keys).agg(
        num.alias("_n"), den.alias("weight"), F.count(value).alias("row_count")
    ).select(*keys, ratio(F.col("_n"), F.col("weight"), places).alias(f"weighted_{value}"),
             "weight", "row_count")


def loan_kind() -> Column:
    """CORE with all required fields, RECOVERY_ONLY with none but a recovery, else UNKNOWN."""
    core = F.lit(True)
    bare = F.col("recovered").isNotNull()
    for f in CORE_FIELDS:
        core = core & F.col(f).isNotNull()
        bare = bare & F.col(f).isNull()
    for f in OPTIONAL_FIELDS:
        bare = bare & F.col(f).isNull()
    return F.when(core, "CORE").when(bare, "RECOVERY_ONLY").otherwise("UNKNOWN")


def classify_partial(loans: DataFrame) -> DataFrame:
    return loans.withColumn("loan_kind", loan_kind())


def unknown_partials(loans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups holding rows of an unknown field set, counted."""
    return classify_partial(loans).filter("loan_kind = 'UNKNOWN'").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"))


def gathered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal keys next to each other, in partitions that AQE evens out.

    The number they are dealt by is not the keys themselves, so an aggregate still exchanges its partial
    sums and Spark is free to split a hot key.
    """
    return rows.withColumn("_deal", F.pmod(F.xxhash64(*keys), F.lit(1 << 20))).hint("rebalance", "_deal").drop(
        "_deal")


def loan_aggregate(
    loans: DataFrame, keys: Sequence[str] = ("trust_id", "period_end")
) -> DataFrame:
    """Counts, sums, weighted averages and their denominators per key, in one pass.

    A buffer of all sums is several times as wide as a loan, so where a task meets many keys loans are
    dealt out first, those of a key together; a large key is split, as it only combines once more.
    """
    core = F.col("loan_kind") == "CORE"
    added = F.col("added").cast("boolean")
    rows = gathered(classify_partial(loans).select(
        *keys, "loan_kind", *CORE_FIELDS, *OPTIONAL_FIELDS, "recovered"), keys)

    def money(col: str, when: Column = core) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(col).cast(AMOUNT))), F.lit(0)).cast(MONEY)

    def part(col: str) -> Column:
        return F.when(core, F.col(col))

    original, ending = part("original_amount"), part("ending_balance")
    pairs = {
        "reporting_rate": _weighted(part("reporting_rate"), ending),
        "remaining_term": _weighted(part("remaining_term"), ending),
    }
    # Core rows always have their original rate and term, so one sum is the weight of both.
    always = {n: _weighted(part(n), original)[0] for n in ("original_rate", "original_term")}
    aggs = [
        F.count(F.lit(1)).alias("asset_count"),
        F.count_if(core).alias("core_metric_asset_count"),
        F.count_if(F.col("loan_kind") == "RECOVERY_ONLY").alias("recovery_only_asset_count"),
        F.count_if(core & added).alias("asset_added_count"),
        F.count(part("added")).alias("asset_added_indicator_observed_count"),
        money("recovered", F.lit(True)).alias("recovered_amount_sum"),
        F.count("recovered").alias("recovered_amount_observed_asset_count"),
        money("original_amount").alias("original_loan_amount_sum"),
        money("original_amount", core & added).alias("asset_added_original_loan_amount_sum"),
        money("beginning_balance").alias("beginning_balance_sum"),
        money("ending_balance").alias("ending_balance_sum"),
        F.count(part("reporting_rate")).alias("reporting_interest_rate_asset_count"),
        F.count(part("remaining_term")).alias("remaining_term_asset_count"),
        F.count_if(F.col("loan_kind") == "UNKNOWN").alias("unknown_asset_count"),
    ]
    for name, (num, den) in pairs.items():
        aggs += [num.alias(f"_n_{name}"), den.alias(f"_d_{name}")]
    aggs += [num.alias(f"_n_{name}") for name, num in always.items()]
    out = rows.groupBy(*keys).agg(*aggs)

    def average(name: str, places: int) -> Column:
        weight = "original_loan_amount_sum" if name in always else f"_d_{name}"
        return ratio(F.col(f"_n_{name}"), F.col(weight), places)

    zero = F.lit(0).cast(MONEY)
    return out.withColumns({
        "weighted_avg_original_interest_rate": average("original_rate", RATE_PLACES),
        "weighted_avg_reporting_interest_rate": average("reporting_rate", RATE_PLACES),
        "weighted_avg_original_loan_term": average("original_term", TERM_PLACES),
        "weighted_avg_remaining_term": average("remaining_term", TERM_PLACES),
        "reporting_interest_rate_balance_sum":
            F.coalesce(F.col("_d_reporting_rate").cast(MONEY), zero),
        "remaining_term_balance_sum": F.coalesce(F.col("_d_remaining_term").cast(MONEY), zero),
    }).drop(*[f"_{x}_{name}" for x in "nd" for name in (*pairs, *always)])


def coverage_denominators(
    loans: DataFrame, keys: Sequence[str], fields: Sequence[str], weight: str
) -> DataFrame:
    """How many rows, and how much weight, stand behind each optional field."""
    counts = loans.groupBy(*keys).agg(
        *[F.count(f).alias(f"_c{i}") for i, f in enumerate(fields)],
        *[F.coalesce(F.sum(F.when(F.col(f).isNotNull(), F.col(weight).cast(AMOUNT))), F.lit(0))
          .alias(f"_w{i}") for i, f in enumerate(fields)])
    return counts.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"_c{i}").alias("row_count"),
                 F.col(f"_w{i}").alias("weight")) for i, f in enumerate(fields)])))


def zero_weights(aggregates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted averages that have no weight behind them."""
    names = [n for n in aggregates.columns if n.startswith("weighted_avg_")]
    hit = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    return aggregates.select(*keys, F.explode(hit).alias("metric"))


def duplicate_assets(
    loans: DataFrame, keys: Sequence[str] = ("trust_id", "period_end"),
    asset: str = "asset_number",
) -> DataFrame:
    """Repeated asset numbers of one tape; only their hash leaves the operator."""
    return loans.groupBy(*keys, F.sha2(F.col(asset).cast("string"), 256).alias("asset_hash")).agg(
        F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def one_period_check(
    loans: DataFrame, tape: Sequence[str], period: str, expected: DataFrame | None = None,
    expected_col: str = "expected_period",
) -> DataFrame:
    """Tapes with more than one period, or another than their filing's."""
    seen = loans.groupBy(*tape).agg(F.min(period).alias("first_period"),
                                    F.max(period).alias("last_period"))
    if expected is None:
        return seen.filter("first_period <> last_period")
    j = seen.join(expected.select(*tape, expected_col), list(tape), "full_outer")
    bad = (F.col("first_period") != F.col("last_period")) | ~F.col("last_period").eqNullSafe(
        F.col(expected_col))
    return j.filter(F.coalesce(bad, F.lit(True)))


def contiguous_months(
    df: DataFrame, windows: DataFrame, key: str, period: str, accession: str | None = None,
    constant: Sequence[str] = (), min_months: int = 0,
) -> DataFrame:
    """What breaks a pinned month window: missing, extra or too few months, reuse, a changed label.

    `windows` holds key, start, end. Returns (key, problem, detail).
    """
    grid = windows.select(key, F.explode(cal.month_ends_between("start", "end")).alias(period))
    cover = c.check_coverage(df, grid, [key, period]).select(
        key, F.concat(F.col("problem"), F.lit(" month")).alias("problem"),
        F.col(period).cast("string").alias("detail"))
    out = cover
    if min_months:
        few = df.select(key, period).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(few.filter(F.col("n") < min_months).select(
            key, F.lit("too few months").alias("problem"), F.col("n").cast("string")
            .alias("detail")))
    if accession:
        used = c.check_unique(df.select(key, period, accession).distinct(), [key, accession])
        out = out.unionByName(used.select(key, F.lit("accession reused").alias("problem"),
                                          F.col(accession).cast("string").alias("detail")))
    for col in constant:
        moved = df.groupBy(key).agg(F.min(col).alias("a"), F.max(col).alias("b")).filter("a <> b")
        out = out.unionByName(moved.select(key, F.lit("label changed").alias("problem"),
                                           F.lit(col).alias("detail")))
    return out


REQUIRED_METRICS = ("ending_principal_receivables", "principal_payment_rate_pct",
                    "portfolio_yield_pct", "chargeoff_rate_pct")
OPTIONAL_METRIC = "chargeoff_amount"


def card_metrics(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extracted (metric, value) rows to one row per report; an absent amount is never derived."""
    names = [*REQUIRED_METRICS, OPTIONAL_METRIC]
    wide = metrics.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    status = F.when(F.col(OPTIONAL_METRIC).isNull(), "NOT_REPORTED").otherwise("REPORTED")
    return wide.withColumn(f"{OPTIONAL_METRIC}_status", status)


def missing_metrics(cards: DataFrame, keys: Sequence[str]) -> DataFrame:
    hit = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n))
                                    for n in REQUIRED_METRICS]))
    return cards.select(*keys, F.explode(hit).alias("metric"))


def drop_identifiers(df: DataFrame, identifiers: Sequence[str] = IDENTIFIERS) -> DataFrame:
    """Every column but the loan-level ones."""
    return df.select(*[n for n in df.columns if n not in identifiers])


def bank_panel_sum(
    reports: DataFrame, fields: Sequence[str], total: str, parts: Sequence[str],
    group: Sequence[str] = (),
) -> DataFrame:
    """Field sums over reporters, with the residual of the total; a negative one is a violation."""
    sums = reports.groupBy(*group).agg(
        F.count(F.lit(1)).alias("reporter_count"), *[F.sum(f).alias(f) for f in fields])
    residual = F.col(total)
    for p in parts:
        residual = residual - F.col(p)
    return sums.withColumn("residual", residual).withColumn("valid", F.col("residual") >= 0)
