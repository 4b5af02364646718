"""Queries for loan tapes: suppliers are trusts, ship months are reporting periods."""

from pyspark.sql import functions as F

from vintagekit.operators import loans as ln
from vintagekit.plans.registry import query, view
from vintagekit.plans.tables import cents

KEYS = ["trust_id", "period_end"]


def tape(t):
    """Line items as loans; line 7 reports a recovery only, some rates and terms are absent."""
    core = F.col("l_linenumber") != 7
    money = "decimal(14,2)"

    def known(c, when=core):
        return F.when(when, c)

    price = F.col("l_extendedprice").cast(money)
    return t.lineitem.select(
        F.col("l_suppkey").alias("trust_id"),
        F.last_day(F.to_date("l_shipdate")).alias("period_end"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("asset_number"),
        known(price).alias("original_amount"), known(price).alias("beginning_balance"),
        known(price - F.col("l_quantity").cast(money)).alias("ending_balance"),
        known(F.col("l_discount").cast("decimal(6,4)")).alias("original_rate"),
        known(F.col("l_tax").cast("decimal(6,4)"), core & (F.col("l_linestatus") == "F"))
        .alias("reporting_rate"),
        known(F.col("l_quantity").cast("int")).alias("original_term"),
        known(F.col("l_quantity").cast("int") - 1, core & (F.col("l_returnflag") != "R"))
        .alias("remaining_term"),
        known(F.when(F.col("l_returnflag") == "A", "true").when(
            F.col("l_returnflag") == "N", "false")).alias("added"),
        F.when(~core | (F.col("l_tax") == 0), F.col("l_quantity").cast(money)).alias("recovered"),
        "l_returnflag")


view("tape", """
SELECT l_suppkey AS trust_id, last_day(CAST(l_shipdate AS DATE)) AS period_end,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey AS asset_number, l_linenumber <> 7 AS core,
  CASE WHEN l_linenumber <> 7 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS orig,
  CASE WHEN l_linenumber <> 7 THEN CAST(round(l_extendedprice * 100) AS BIGINT)
       - CAST(round(l_quantity * 100) AS BIGINT) END AS ending,
  CASE WHEN l_linenumber <> 7 THEN CAST(round(l_discount * 10000) AS BIGINT) END AS orate,
  CASE WHEN l_linenumber <> 7 AND l_linestatus = 'F' THEN CAST(round(l_tax * 10000) AS BIGINT) END
    AS rrate,
  CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS BIGINT) END AS oterm,
  CASE WHEN l_linenumber <> 7 AND l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) - 1 END AS rterm,
  CASE WHEN l_linenumber <> 7 AND l_returnflag <> 'R' THEN l_returnflag = 'A' END AS added,
  CASE WHEN l_linenumber = 7 OR l_tax = 0 THEN CAST(round(l_quantity * 100) AS BIGINT) END AS rec,
  l_returnflag
FROM lineitem
""")
AGG = """
SELECT trust_id, period_end, count(*) AS asset_count, count(orig) AS core_metric_asset_count,
  count(*) FILTER (NOT core) AS recovery_only_asset_count,
  count(*) FILTER (added) AS asset_added_count,
  count(added) AS asset_added_indicator_observed_count,
  coalesce(sum(rec), 0) / 100 AS recovered_amount_sum,
  count(rec) AS recovered_amount_observed_asset_count,
  coalesce(sum(orig), 0) / 100 AS original_loan_amount_sum,
  coalesce(sum(orig) FILTER (added), 0) / 100 AS asset_added_original_loan_amount_sum,
  coalesce(sum(orig), 0) / 100 AS beginning_balance_sum,
  coalesce(sum(ending), 0) / 100 AS ending_balance_sum,
  count(rrate) AS reporting_interest_rate_asset_count, count(rterm) AS remaining_term_asset_count,
  0::BIGINT AS unknown_asset_count,
  round(sum(orate * orig) / 10000 / sum(orig), 10) AS weighted_avg_original_interest_rate,
  round(sum(rrate * ending) / 10000 / sum(ending) FILTER (rrate IS NOT NULL), 10)
    AS weighted_avg_reporting_interest_rate,
  round(sum(oterm * orig) / sum(orig), 8) AS weighted_avg_original_loan_term,
  round(sum(rterm * ending) / sum(ending) FILTER (rterm IS NOT NULL), 8)
    AS weighted_avg_remaining_term,
  coalesce(sum(ending) FILTER (rrate IS NOT NULL), 0) / 100 AS reporting_interest_rate_balance_sum,
  coalesce(sum(ending) FILTER (rterm IS NOT NULL), 0) / 100 AS remaining_term_balance_sum
FROM tape GROUP BY ALL
"""


@query("t01_loan_aggregate", AGG, "tape")
def _(t):
    out = ln.loan_aggregate(tape(t), KEYS)
    return out.withColumns({f.name: F.col(f.name).cast("double") for f in out.schema.fields
                            if f.dataType.typeName() == "decimal"})


@query("t02_weighted_average", """
SELECT trust_id, round(sum(rrate * ending) / 10000 / sum(ending) FILTER (rrate IS NOT NULL), 10)
         AS weighted_reporting_rate,
       sum(ending) FILTER (rrate IS NOT NULL) / 100 AS weight, count(rrate) AS row_count
FROM tape GROUP BY 1
""", "tape")
def _(t):
    out = ln.weighted_average(tape(t), ["trust_id"], "reporting_rate", "ending_balance")
    return out.withColumns({
        "weighted_reporting_rate": F.col("weighted_reporting_rate").cast("double"),
        "weight": F.col("weight").cast("double")})


@query("t02_zero_weights", """
SELECT trust_id, period_end, metric FROM (
  SELECT trust_id, period_end, 'weighted_avg_original_interest_rate' AS metric, count(orig) AS n
  FROM tape GROUP BY ALL UNION ALL
  SELECT trust_id, period_end, 'weighted_avg_original_loan_term', count(orig) FROM tape GROUP BY ALL
  UNION ALL SELECT trust_id, period_end, 'weighted_avg_reporting_interest_rate', count(rrate)
  FROM tape GROUP BY ALL UNION ALL
  SELECT trust_id, period_end, 'weighted_avg_remaining_term', count(rterm) FROM tape GROUP BY ALL)
WHERE n = 0
""", "tape")
def _(t):
    return ln.zero_weights(ln.loan_aggregate(tape(t), KEYS), KEYS)


@query("t03_coverage_denominators", """
SELECT trust_id, 'reporting_rate' AS field, count(rrate) AS row_count,
       coalesce(sum(ending) FILTER (rrate IS NOT NULL), 0) / 100 AS weight FROM tape GROUP BY 1
UNION ALL SELECT trust_id, 'remaining_term', count(rterm),
       coalesce(sum(ending) FILTER (rterm IS NOT NULL), 0) / 100 FROM tape GROUP BY 1
""", "tape")
def _(t):
    out = ln.coverage_denominators(tape(t), ["trust_id"], ["reporting_rate", "remaining_term"],
                                   "ending_balance")
    return out.withColumn("weight", F.col("weight").cast("double"))


@query("t04_classify_partial", """
SELECT trust_id, CASE WHEN NOT core THEN 'RECOVERY_ONLY' WHEN oterm = 13 THEN 'UNKNOWN' ELSE 'CORE'
       END AS loan_kind, count(*) AS row_count FROM tape GROUP BY ALL
""", "tape")
def _(t):
    hole = tape(t).withColumn("original_rate", F.when(
        F.coalesce(F.col("original_term"), F.lit(0)) != 13, F.col("original_rate")))
    return ln.classify_partial(hole).groupBy("trust_id", "loan_kind").agg(
        F.count(F.lit(1)).alias("row_count"))


@query("t05_duplicate_assets", """
SELECT trust_id, sha256(asset_number) AS asset_hash, count(*) AS row_count
FROM tape GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL
SELECT -1, sha256(CAST(l_orderkey AS VARCHAR)), count(*) FROM lineitem GROUP BY l_orderkey
HAVING count(*) > 1
""", "tape")
def _(t):
    a = ln.duplicate_assets(tape(t), ["trust_id"])
    orders = t.lineitem.select(F.lit(-1).cast("bigint").alias("trust_id"),
                               F.col("l_orderkey").alias("asset_number"))
    return a.unionByName(ln.duplicate_assets(orders, ["trust_id"]))


@query("t06_one_period_check", """
SELECT o_custkey AS tape, min(last_day(CAST(o_orderdate AS DATE))) AS first_period,
       max(last_day(CAST(o_orderdate AS DATE))) AS last_period,
       DATE '1999-01-31' AS expected_period
FROM orders GROUP BY 1 HAVING min(last_day(CAST(o_orderdate AS DATE))) <> DATE '1999-01-31'
 OR max(last_day(CAST(o_orderdate AS DATE))) <> DATE '1999-01-31'
""")
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("tape"),
                           F.last_day(F.to_date("o_orderdate")).alias("p"))
    want = rows.select("tape").distinct().withColumn(
        "expected_period", F.lit("1999-01-31").cast("date"))
    return ln.one_period_check(rows, ["tape"], "p", want)


@query("t07_parse_mixed_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS parsed
FROM orders
""")
def _(t):
    d = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(
        F.col("o_orderkey") % 4 == 1, F.date_format(d, "MM-dd-yyyy")).when(
        F.col("o_orderkey") % 4 == 2, F.date_format(d, "MM/dd/yyyy")).otherwise(
        F.date_format(d, "dd.MM.yyyy"))
    return t.orders.select("o_orderkey", ln.parse_mixed_dates(text).alias("parsed"))


@query("t08_contiguous_months", """
WITH have AS (SELECT DISTINCT trust_id, period_end FROM tape),
grid AS (SELECT s_suppkey AS trust_id, last_day(CAST(CAST(m AS DATE) AS DATE)) AS period_end
  FROM supplier CROSS JOIN range(TIMESTAMP '1996-01-01', TIMESTAMP '2001-01-01', INTERVAL 1 MONTH) r(m))
SELECT trust_id, 'missing month' AS problem, CAST(period_end AS VARCHAR) AS detail
FROM grid ANTI JOIN have USING (trust_id, period_end) UNION ALL
SELECT trust_id, 'extra month', CAST(period_end AS VARCHAR)
FROM have ANTI JOIN grid USING (trust_id, period_end) UNION ALL
SELECT trust_id, 'label changed', 'l_returnflag' FROM tape GROUP BY 1
HAVING min(l_returnflag) <> max(l_returnflag)
""", "tape")
def _(t):
    windows = t.supplier.select(
        F.col("s_suppkey").alias("trust_id"), F.lit("1996-01-31").cast("date").alias("start"),
        F.lit("2000-12-31").cast("date").alias("end"))
    return ln.contiguous_months(tape(t), windows, "trust_id", "period_end",
                                constant=["l_returnflag"])


@query("t09_card_metrics", """
SELECT o_custkey AS trust_id,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS BIGINT)
    AS ending_principal_receivables,
  count(*) AS principal_payment_rate_pct, count(DISTINCT o_orderpriority) AS portfolio_yield_pct,
  count(*) FILTER (o_orderstatus = 'O') AS chargeoff_rate_pct,
  CASE WHEN o_custkey % 3 = 0 THEN count(*) END AS chargeoff_amount,
  CASE WHEN o_custkey % 3 = 0 THEN 'REPORTED' ELSE 'NOT_REPORTED' END AS chargeoff_amount_status
FROM orders GROUP BY 1
""")
def _(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("trust_id")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", cents("o_totalprice"))).alias("a"),
        F.count(F.lit(1)).alias("b"), F.count_distinct("o_orderpriority").alias("c"),
        F.count_if(F.col("o_orderstatus") == "O").alias("d"))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in (
        ("ending_principal_receivables", "a"), ("principal_payment_rate_pct", "b"),
        ("portfolio_yield_pct", "c"), ("chargeoff_rate_pct", "d"))])
    amount = per.filter("trust_id % 3 = 0").select(
        "trust_id", F.lit("chargeoff_amount").alias("metric"), F.col("b").alias("value"))
    return ln.card_metrics(per.select("trust_id", F.inline(pairs)).unionByName(amount),
                           ["trust_id"])


@query("t10_drop_identifiers", """
SELECT trust_id, period_end, count(*) AS row_count, 12 AS column_count FROM tape GROUP BY ALL
""", "tape")
def _(t):
    rows = ln.drop_identifiers(tape(t))
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(rows.columns)))


@query("t11_bank_panel_sum", """
SELECT n_regionkey, count(*) AS reporter_count, CAST(sum(a) AS BIGINT) AS total, CAST(sum(f) AS BIGINT) AS f,
       CAST(sum(o) AS BIGINT) AS o, CAST(sum(a) - sum(f) - sum(o) AS BIGINT) AS residual,
       sum(a) - sum(f) - sum(o) >= 0 AS valid
FROM (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS a,
    sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS f,
    sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS o
  FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
""")
def _(t):
    v = cents("o_totalprice")
    per = t.orders.groupBy("o_custkey").agg(
        F.sum(v).alias("total"),
        *[F.sum(F.when(F.col("o_orderstatus") == x, v).otherwise(0)).alias(x.lower())
          for x in ("F", "O")])
    who = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    return ln.bank_panel_sum(per.join(who, "o_custkey"), ["total", "f", "o"], "total", ["f", "o"],
                             ["n_regionkey"])
