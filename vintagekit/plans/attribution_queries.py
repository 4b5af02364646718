"""Queries for attribution: priorities are products, segments categories, nations companies."""

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.functions import keys as k
from vintagekit.operators import attribution as at
from vintagekit.operators import pit
from vintagekit.plans.model_queries import rounded
from vintagekit.plans.registry import query, view
from vintagekit.plans.tables import cents, to_places
from vintagekit.session import materialize

BROAD = ["HOUSEHOLD", "MACHINERY"]
DRAWS, SEED = 20_000, 7
BAND = ["low", "mid", "high"]


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def per_nation(t, *keys):
    """Order cents by keys and customer segment and nation; orders are summed before the join."""
    o = t.orders.select("*", cents("o_totalprice").alias("c"))
    o = o.groupBy(F.col("o_custkey").alias("k"), *keys).agg(F.sum("c").alias("c"))
    cust = t.customer.select(
        F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("category"),
        F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("ticker"),
        "c_nationkey")
    return o.join(cust, "k")


class Bundle:
    """The attribution inputs as frames, all derived from one small aggregate.

    Registries are stored tables to those who use them, so they are written once per query.
    """

    def __init__(self, t):
        mid = F.col("mid")
        self.oc = oc = materialize(
            per_nation(t, F.col("o_orderpriority").alias("product")).groupBy(
                "product", "category", "ticker", "c_nationkey").agg(F.sum("c").alias("c")),
            "amounts")
        tenth = [to_places(mid * 0.9, 9).alias("low"), mid, to_places(mid * 1.1, 9).alias("high")]
        self.flows = oc.groupBy("product").agg(F.sum("c").alias("c")).select(
            "product", F.lit("2001-Q3").alias("quarter"), to_places(F.col("c") / 1e8, 6).alias("mid")
        ).select("product", "quarter", *tenth)
        w = Window.partitionBy("product")
        pc = oc.groupBy("product", "category").agg(F.sum("c").alias("c"))
        tier = F.when(F.col("category") == "AUTOMOBILE", 1).when(
            F.col("category").isin("BUILDING", "FURNITURE"), 2).otherwise(3)
        self.a = pc.select(
            "product", "category", tier.alias("tier"),
            to_places(F.col("c") * 0.8 / F.sum("c").over(w), 9).alias("mid"),
            F.concat(F.lit("A:"), "product", F.lit("/"), "category").alias("assumption_id"),
        ).select("product", "category", "tier", *tenth, "assumption_id")
        ct = oc.groupBy("category", "ticker").agg(F.sum("c").alias("c"))
        weights = at.normalized_weights(ct, "ticker", "c", ["category"])
        moving = F.col("category") == "FURNITURE"
        weights = weights.withColumn(
            "mid", F.when(moving, to_places(F.col("weight") * 0.8, 9)).otherwise(F.col("weight")))
        self.b = materialize(weights.select(
            "category", "ticker", F.when(moving, to_places(mid * 0.9, 9)).otherwise(mid).alias("low"),
            "mid", F.when(moving, to_places(mid * 1.1, 9)).otherwise(mid).alias("high"),
            F.when(moving, F.concat(F.lit("B:"), "category", F.lit("/"), "ticker"))
            .alias("assumption_id")), "matrix_b")
        self.companies = oc.groupBy("ticker", "c_nationkey").agg(F.sum("c").alias("c")).select(
            "ticker", F.concat(F.lit("Nation "), "ticker").alias("company_name"), "c_nationkey",
            to_places(F.col("c") / 1e8, 6).alias("revenue_millions"),
            F.concat(F.lit("S:"), "ticker").alias("share_assumption_id"))
        share = self.companies.select(
            F.col("share_assumption_id").alias("assumption_id"),
            (F.lit(0.4) + F.col("c_nationkey") / 100).alias("mid")).select(
            "assumption_id", *tenth).withColumn("tier", F.lit(1))
        self.assumptions = materialize(union(
            self.a.select("assumption_id", *BAND, "tier"),
            self.b.filter("assumption_id is not null").select("assumption_id", *BAND).withColumn(
                "tier", F.lit(2)),
            share), "assumptions")

    @cached_property
    def draw_table(self):
        priors = at.all_priors(self.assumptions, self.flows)
        return materialize(at.draw_blocks(priors, DRAWS, SEED), "draws")

    def draws(self):
        return self.draw_table

    def contributions(self, draws):
        return at.contributions(self.flows, self.a, self.b, draws)

    def ratios(self):
        d = self.draws()
        return at.company_ratios(self.contributions(d), self.companies, d, BROAD)

    def sourced(self):
        """Assumptions with a primary source and fallbacks, and the source registry."""
        a = self.assumptions
        kind, rest = F.substring("assumption_id", 1, 2), F.substring("assumption_id", 3, 99)
        product = F.split_part(rest, F.lit("/"), F.lit(1))
        category = F.split_part(rest, F.lit("/"), F.lit(2))
        a = a.withColumns({
            "primary_source_id": F.when(kind == "A:", F.concat(F.lit("P-"), product)).otherwise(
                F.lit("NATIONS")),
            "fallback_source_ids": F.when(kind == "A:", F.array(F.concat(F.lit("C-"), category)))
            .otherwise(F.array().cast("array<string>")),
            "band_multiplier": F.lit(1.5)})
        s = union(
            self.flows.select(F.concat(F.lit("P-"), "product").alias("source_id"),
                              F.lit("orders").alias("independent_group")),
            self.a.select(F.concat(F.lit("C-"), "category").alias("source_id"),
                          F.when(F.col("category") == "HOUSEHOLD", "orders").otherwise("customers")
                          .alias("independent_group")).distinct(),
            self.flows.select(F.lit("NATIONS").alias("source_id"),
                              F.lit("nations").alias("independent_group")).distinct())
        return a, s.withColumn("terms_status", F.lit("PERMITTED")).withColumn(
            "available", F.lit(True))


view("oc", """
SELECT o_orderpriority AS product, c_mktsegment AS category,
       'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ticker, c_nationkey,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""")
view("at_flows", """
SELECT product, '2001-Q3' AS quarter, round(mid * 0.9::DOUBLE, 9) AS low, mid,
       round(mid * 1.1::DOUBLE, 9) AS high
FROM (SELECT product, round(CAST(sum(c) AS BIGINT) / 1e8, 6) AS mid FROM oc GROUP BY 1)
""", "oc")
view("at_a", """
SELECT product, category, CASE WHEN category = 'AUTOMOBILE' THEN 1
       WHEN category IN ('BUILDING', 'FURNITURE') THEN 2 ELSE 3 END AS tier,
       round(mid * 0.9::DOUBLE, 9) AS low, mid, round(mid * 1.1::DOUBLE, 9) AS high,
       'A:' || product || '/' || category AS assumption_id
FROM (SELECT product, category, round(CAST(sum(c) AS BIGINT) * 0.8::DOUBLE
        / CAST(sum(sum(c)) OVER (PARTITION BY product) AS BIGINT), 9) AS mid FROM oc GROUP BY 1, 2)
""", "oc")
view("at_weights", """
SELECT category, ticker, CASE WHEN ticker = last THEN
    CAST(1000000000000 - sum(CASE WHEN ticker <> last THEN w ELSE 0 END)
         OVER (PARTITION BY category) AS BIGINT) / 1e12 ELSE CAST(w AS BIGINT) / 1e12 END AS weight
FROM (SELECT category, ticker, max(ticker) OVER (PARTITION BY category) AS last,
             (c::HUGEINT * 1000000000000) // (sum(c) OVER (PARTITION BY category))::HUGEINT AS w
      FROM (SELECT category, ticker, sum(c) AS c FROM oc GROUP BY 1, 2))
""", "oc")
view("at_b", """
SELECT category, ticker,
  CASE WHEN category = 'FURNITURE' THEN round(mid * 0.9::DOUBLE, 9) ELSE mid END AS low, mid,
  CASE WHEN category = 'FURNITURE' THEN round(mid * 1.1::DOUBLE, 9) ELSE mid END AS high,
  CASE WHEN category = 'FURNITURE' THEN 'B:' || category || '/' || ticker END AS assumption_id
FROM (SELECT category, ticker, CASE WHEN category = 'FURNITURE'
        THEN round(weight * 0.8::DOUBLE, 9) ELSE weight END AS mid FROM at_weights)
""", "at_weights")
view("at_companies", """
SELECT ticker, 'Nation ' || ticker AS company_name, c_nationkey,
       round(CAST(sum(c) AS BIGINT) / 1e8, 6) AS revenue_millions,
       'S:' || ticker AS share_assumption_id FROM oc GROUP BY ALL
""", "oc")
view("at_assumptions", """
SELECT assumption_id, low, mid, high, tier FROM at_a UNION ALL
SELECT assumption_id, low, mid, high, 2 FROM at_b WHERE assumption_id IS NOT NULL UNION ALL
SELECT share_assumption_id, round(m * 0.9::DOUBLE, 9), m, round(m * 1.1::DOUBLE, 9), 1
FROM (SELECT share_assumption_id, 0.4::DOUBLE + c_nationkey / 100 AS m FROM at_companies)
""", "at_a at_b at_companies")
view("at_draws", f"""
SELECT assumption_id, draw, CASE WHEN low = high THEN mid
    WHEN u * (high - low) < mid - low THEN low + sqrt(u * (high - low) * (mid - low))
    ELSE high - sqrt((1 - u) * (high - low) * (high - mid)) END AS value
FROM (SELECT *, CAST('0x' || substr(md5('{SEED}:' || assumption_id || ':' || draw), 1, 13) AS BIGINT)
                / 4503599627370496.0::DOUBLE AS u
      FROM (SELECT assumption_id, low, mid, high FROM at_assumptions UNION ALL
            SELECT 'flow:' || product, low, mid, high FROM at_flows) p
      CROSS JOIN (SELECT CAST(range AS INTEGER) AS draw FROM range(1, {DRAWS + 1})) r)
""", "at_assumptions at_flows")
view("at_contrib", """
SELECT b.category, p.tier, b.ticker, p.draw, p.amount * coalesce(d.value, b.mid) AS amount
FROM (SELECT a.category, a.tier, x.draw, sum(x.value * f.value) AS amount
      FROM at_a a JOIN at_draws x ON x.assumption_id = a.assumption_id
      JOIN at_draws f ON f.assumption_id = 'flow:' || a.product AND f.draw = x.draw
      GROUP BY ALL) p
JOIN at_b b ON b.category = p.category
LEFT JOIN at_draws d ON d.assumption_id = b.assumption_id AND d.draw = p.draw
""", "at_a at_b at_draws")
view("at_ratios", """
SELECT n.ticker, n.draw, n.numerator, n.broad, s.denominator,
       n.numerator / s.denominator * 100 AS ratio, n.broad / s.denominator * 100 AS broad_ratio
FROM (SELECT ticker, draw, sum(amount) AS numerator,
             sum(CASE WHEN category IN ('HOUSEHOLD', 'MACHINERY') THEN amount ELSE 0 END) AS broad
      FROM at_contrib GROUP BY ALL) n
JOIN (SELECT c.ticker, d.draw, c.revenue_millions / 4 * d.value AS denominator
      FROM at_companies c JOIN at_draws d ON d.assumption_id = c.share_assumption_id) s
  ON n.ticker = s.ticker AND n.draw = s.draw
""", "at_contrib at_companies at_draws")
view("at_lift", """
SELECT ticker, quantile_cont(ratio, 0.5) AS mid, quantile_cont(broad_ratio, 0.5) AS baseline_mid,
       quantile_cont(ratio, 0.5) / nullif(quantile_cont(broad_ratio, 0.5), 0) AS lift
FROM at_ratios GROUP BY 1
""", "at_ratios")
view("at_mid", """
SELECT a.product, a.category, a.tier, b.ticker, f.mid * a.mid * b.mid AS amount
FROM at_a a JOIN at_flows f USING (product) JOIN at_b b ON a.category = b.category
""", "at_a at_b at_flows")


@query("a01_check_bundle", """
SELECT 'matrix A above one' AS rule, product AS key FROM at_flows UNION ALL
SELECT 'matrix B above one', category FROM at_b WHERE category = 'BUILDING' GROUP BY 2 UNION ALL
SELECT 'matrix A differs from assumption', product || '/' || category FROM at_a
WHERE category = 'AUTOMOBILE' UNION ALL
SELECT 'matrix B repeated', category || '/' || ticker FROM at_b WHERE category = 'BUILDING' UNION ALL
SELECT 'company without share', 'none' UNION ALL
SELECT 'matrix B without assumption', 'B:none' UNION ALL
SELECT 'assumption tier', assumption_id FROM at_a WHERE tier = 3
""", "at_a at_b at_flows")
def _(t):
    x = Bundle(t)
    a = x.a.withColumns({c: F.when(F.col("category") == "AUTOMOBILE", F.lit(0.9)).otherwise(
        F.col(c)) for c in BAND})
    b = x.b.unionByName(x.b.filter("category = 'BUILDING'")).withColumn("assumption_id", F.when(
        F.col("assumption_id") == "B:FURNITURE/N05", "B:none").otherwise(F.col("assumption_id")))
    who = x.companies.withColumn("share_assumption_id", F.when(
        F.col("ticker") == "N03", "none").otherwise(F.col("share_assumption_id")))
    reg = x.assumptions.withColumn("tier", F.when(F.col("tier") == 3, 9).otherwise(F.col("tier")))
    return at.check_bundle(reg, x.flows, a, b, who)


@query("a01_check_evidence", """
SELECT 'o_text missing' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders
WHERE o_orderstatus = 'P' UNION ALL
SELECT 'address and excerpt go together', CAST(o_orderkey AS VARCHAR) FROM orders
WHERE (o_custkey % 5 = 0) <> (o_orderpriority <> '5-LOW') UNION ALL
SELECT 'excerpt too long', CAST(o_orderkey AS VARCHAR) FROM orders
WHERE o_orderpriority = '4-NOT SPECIFIED'
""")
def _(t):
    words = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.repeat(F.lit("word "), 16)).when(
        F.col("o_orderpriority") != "5-LOW", "a few words")
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", "x").alias("o_text"),
        F.when(F.col("o_custkey") % 5 == 0, "https://data.example").alias("url"),
        words.alias("excerpt"))
    return at.check_evidence(rows, "o_orderkey", ["o_text"], ("url", "excerpt"))


@query("a02_resolve_sources", """
WITH l AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
src AS (SELECT s_suppkey AS s, s_nationkey AS g,
               s_acctbal > 1000 AND s_acctbal < 9000 AS ok FROM supplier),
pr AS (SELECT p, min(s) AS s0 FROM l GROUP BY 1),
fb AS (SELECT l.p, min(l.s) AS f FROM l JOIN pr ON pr.p = l.p AND l.s <> pr.s0
       JOIN src a ON a.s = pr.s0 JOIN src b ON b.s = l.s WHERE b.ok AND b.g <> a.g GROUP BY 1)
SELECT pr.p AS assumption_id, CASE WHEN a.ok THEN pr.s0 ELSE fb.f END AS active_source_id,
       CASE WHEN a.ok THEN 'PRIMARY' WHEN f IS NOT NULL THEN 'FALLBACK' ELSE 'BLOCKED' END
         AS source_status,
       round(CASE WHEN NOT a.ok AND f IS NOT NULL THEN greatest(0, 0.5 - (p_size / 100.0) * 1.5)
             ELSE 0.5 - p_size / 100.0 END, 6) AS low,
       round(CASE WHEN NOT a.ok AND f IS NOT NULL THEN least(1, 0.5 + (p_size / 100.0) * 1.5)
             ELSE 0.5 + p_size / 100.0 END, 6) AS high
FROM pr JOIN src a ON a.s = pr.s0 JOIN part ON p_partkey = pr.p LEFT JOIN fb ON fb.p = pr.p
""")
def _(t):
    pairs = t.lineitem.select(F.col("l_partkey").alias("assumption_id"),
                              F.col("l_suppkey").alias("source_id")).distinct()
    first = pairs.groupBy("assumption_id").agg(F.min("source_id").alias("primary_source_id"))
    size = t.part.select(F.col("p_partkey").alias("assumption_id"),
                         (F.col("p_size") / 100).alias("w"))
    reg = first.join(size, "assumption_id").select(
        "assumption_id", "primary_source_id", F.lit(1.5).alias("band_multiplier"),
        (0.5 - F.col("w")).alias("low"), F.lit(0.5).alias("mid"), (0.5 + F.col("w")).alias("high"))
    others = pairs.withColumn("position", F.col("source_id"))
    src = t.supplier.select(
        F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("independent_group"),
        F.when(F.col("s_acctbal") < 9000, "PERMITTED").otherwise("REVIEW").alias("terms_status"),
        (F.col("s_acctbal") > 1000).alias("available"))
    return rounded(at.resolve_sources(reg, src, fallbacks=others), ["low", "high"]).select(
        "assumption_id", "active_source_id", "source_status", "low", "high")


@query("a02_source_violations", """
WITH l AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
pr AS (SELECT p, min(s) AS s0 FROM l GROUP BY 1),
src AS (SELECT s_suppkey AS s, s_nationkey AS g, s_acctbal > 1000 AS av, s_acctbal < 9000 AS pm FROM supplier
        WHERE s_nationkey <> 24),
fb AS (SELECT p, s FROM l UNION ALL SELECT p, s FROM l WHERE p % 7 = 0),
ok AS (SELECT DISTINCT pr.p FROM pr JOIN fb ON fb.p = pr.p JOIN src a ON a.s = pr.s0
       JOIN src b ON b.s = fb.s WHERE b.av AND b.pm AND a.g <> b.g)
SELECT 'source listed twice' AS rule, CAST(s AS VARCHAR) AS key FROM src WHERE g = 3 UNION ALL
SELECT 'available without permission', CAST(s AS VARCHAR) FROM src WHERE av AND NOT pm UNION ALL
SELECT 'available without permission', CAST(s AS VARCHAR) FROM src WHERE av AND NOT pm AND g = 3 UNION ALL
SELECT 'primary not registered', CAST(p AS VARCHAR) FROM pr WHERE s0 NOT IN (SELECT s FROM src) UNION ALL
SELECT DISTINCT 'fallback not registered', CAST(p AS VARCHAR) FROM l WHERE s NOT IN (SELECT s FROM src) UNION ALL
SELECT DISTINCT 'fallback named twice', CAST(p AS VARCHAR) FROM l WHERE p % 7 = 0 UNION ALL
SELECT 'BLOCKED', CAST(pr.p AS VARCHAR) FROM pr LEFT JOIN src a ON a.s = pr.s0
WHERE NOT coalesce(a.av AND a.pm, false) AND pr.p NOT IN (SELECT p FROM ok)
""")
def _(t):
    # Faults on purpose: one nation's sources unregistered, another's listed twice, lists repeated.
    pairs = t.lineitem.select(F.col("l_partkey").alias("assumption_id"),
                              F.col("l_suppkey").alias("source_id")).distinct()
    pairs = t.once("pairs", lambda: pairs).withColumn("position", F.col("source_id"))
    reg = pairs.groupBy("assumption_id").agg(F.min("source_id").alias("primary_source_id")).select(
        "*", F.lit(1.5).alias("band_multiplier"), F.lit(0.4).alias("low"), F.lit(0.5).alias("mid"),
        F.lit(0.6).alias("high"))
    once = t.supplier.filter("s_nationkey <> 24").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("independent_group"),
        F.when(F.col("s_acctbal") < 9000, "PERMITTED").otherwise("REVIEW").alias("terms_status"),
        (F.col("s_acctbal") > 1000).alias("available"))
    fallbacks = pairs.unionByName(pairs.filter("assumption_id % 7 = 0"))
    resolved = at.resolve_sources(reg, once, fallbacks=fallbacks)
    twice = once.unionByName(once.filter("independent_group = 3"))
    return at.source_violations(reg, twice, resolved, fallbacks)


@query("a03_triangular_draws", """
SELECT assumption_id, count(*) AS n, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS BIGINT)
         AS checksum, round(min(value), 6) AS least, round(max(value), 6) AS greatest
FROM at_draws GROUP BY 1
""", "at_draws")
def _(t):
    v = F.col("value")
    return at.long_draws(Bundle(t).draws()).groupBy("assumption_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(v * 1000000).cast("bigint")).alias("checksum"),
        F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("greatest"))


@query("a04_contributions", """
SELECT category, tier, ticker, count(*) AS draws, round(sum(amount) / count(*), 6) AS mean_amount,
       round(max(amount), 6) AS greatest FROM at_contrib GROUP BY ALL
""", "at_contrib")
def _(t):
    x = Bundle(t)
    out = x.contributions(x.draws()).groupBy("category", "tier", "ticker").agg(
        F.sum(F.size("amounts")).alias("draws"),
        (F.sum(F.aggregate("amounts", F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size("amounts")))
        .alias("mean_amount"), F.max(F.array_max("amounts")).alias("greatest"))
    return rounded(out, ["mean_amount", "greatest"])


@query("a05_company_bands", """
SELECT ticker, round(quantile_cont(ratio, 0.1), 6) AS low, round(quantile_cont(ratio, 0.5), 6) AS mid,
       round(quantile_cont(ratio, 0.9), 6) AS high,
       round(quantile_cont(numerator, 0.5), 6) AS numerator_mid,
       round(quantile_cont(denominator, 0.5), 6) AS denominator_mid FROM at_ratios GROUP BY 1
""", "at_ratios")
def _(t):
    return rounded(at.company_bands(Bundle(t).ratios()), [*BAND, "numerator_mid", "denominator_mid"])


@query("a05_result_violations", """
SELECT 'denominator' AS rule, ticker FROM at_companies WHERE c_nationkey % 5 = 0 UNION ALL
SELECT 'quantiles', ticker FROM at_companies WHERE c_nationkey % 5 = 1 UNION ALL
SELECT 'lift', ticker FROM at_lift WHERE lift * (CASE WHEN CAST(substr(ticker, 2) AS INTEGER) % 5 = 2
  THEN 0.001 ELSE 1 END) < 1
""", "at_companies at_lift")
def _(t):
    # Results damaged on purpose: a draw of zero, a band upside down, a shrunken lift.
    x = Bundle(t)
    key = F.substring("ticker", 2, 2).cast("int") % 5
    ratios = materialize(x.ratios(), "ratios")
    bands = at.company_bands(ratios).withColumn("high", F.when(key == 1, -1.0).otherwise(F.col("high")))
    lifts = at.baseline_and_lift(ratios, x.b, BROAD).withColumn(
        "lift", F.col("lift") * F.when(key == 2, 0.001).otherwise(1.0))
    spoilt = ratios.withColumn("denominator", F.when(
        key == 0, F.transform("denominator", lambda d, i: F.when(i == 7, 0.0).otherwise(d))
    ).otherwise(F.col("denominator")))
    return at.result_violations(spoilt, bands, lifts)


@query("a06_baseline_and_lift", """
SELECT ticker, round(mid, 6) AS mid, round(baseline_mid, 6) AS baseline_mid, round(lift, 6) AS lift,
       'evidence-supported' AS lift_status FROM at_lift
""", "at_lift")
def _(t):
    x = Bundle(t)
    out = at.baseline_and_lift(x.ratios(), x.b, BROAD)
    return rounded(out, ["mid", "baseline_mid", "lift"])


@query("a07_tier_shares", """
WITH d AS (SELECT ticker, draw, sum(CASE WHEN tier = 1 THEN amount ELSE 0 END) AS a,
    sum(CASE WHEN tier = 2 THEN amount ELSE 0 END) AS b,
    sum(CASE WHEN tier = 3 THEN amount ELSE 0 END) AS c FROM at_contrib GROUP BY ALL),
m AS (SELECT ticker, quantile_cont(a, 0.5) AS a, quantile_cont(b, 0.5) AS b,
             quantile_cont(c, 0.5) AS c FROM d GROUP BY 1)
SELECT ticker, round(a / (a + b + c), 6) AS tier1_share, round(b / (a + b + c), 6) AS tier2_share,
       round(1 - a / (a + b + c) - b / (a + b + c), 6) AS tier3_share FROM m
""", "at_contrib")
def _(t):
    x = Bundle(t)
    out = at.tier_shares(x.contributions(x.draws()))
    return rounded(out, ["tier1_share", "tier2_share", "tier3_share"])


@query("a08_aggregate_band", """
SELECT round(quantile_cont(n / d * 100, 0.1), 6) AS low, round(quantile_cont(n / d * 100, 0.5), 6)
         AS mid, round(quantile_cont(n / d * 100, 0.9), 6) AS high,
       round(quantile_cont(n, 0.5), 5) AS numerator_mid,
       round(quantile_cont(d, 0.5), 5) AS denominator_mid
FROM (SELECT draw, sum(numerator) AS n, sum(denominator) AS d FROM at_ratios GROUP BY 1)
""", "at_ratios")
def _(t):
    out = at.aggregate_band(Bundle(t).ratios())
    return rounded(rounded(out, BAND), ["numerator_mid", "denominator_mid"], 5)


@query("a09_sensitivity_top_k", """
WITH u AS (SELECT b.ticker, a.assumption_id FROM at_b b JOIN at_a a USING (category) UNION
           SELECT ticker, assumption_id FROM at_b WHERE assumption_id IS NOT NULL UNION
           SELECT ticker, share_assumption_id FROM at_companies),
s AS (SELECT u.ticker, u.assumption_id, corr(d.value, r.ratio) AS c FROM u
      JOIN at_ratios r ON r.ticker = u.ticker
      JOIN at_draws d ON d.assumption_id = u.assumption_id AND d.draw = r.draw GROUP BY ALL)
SELECT ticker, assumption_id, round(abs(c), 6) AS absolute_correlation,
       CASE WHEN c >= 0 THEN 'increases' ELSE 'decreases' END AS direction,
       CAST(place AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(c) DESC, assumption_id) AS place
      FROM s) WHERE place <= 5
""", "at_b at_a at_companies at_ratios at_draws")
def _(t):
    x = Bundle(t)
    out = at.sensitivity_top_k(x.ratios(), x.draws(),
                               at.used_assumptions(x.a, x.b, x.companies))
    return rounded(out, ["absolute_correlation"])


@query("a10_lift_headline", """
SELECT max_by(ticker, lift) AS ticker, round(max(lift), 6) AS lift,
       round(quantile_cont(lift, 0.5), 6) AS median_lift FROM at_lift
""", "at_lift")
def _(t):
    x = Bundle(t)
    out = at.lift_headline(at.baseline_and_lift(x.ratios(), x.b, BROAD))
    return rounded(out, ["lift", "median_lift"])


view("at_estimate", """
SELECT c.ticker, n.numerator, c.revenue_millions / 4 * s.mid AS denominator,
       n.numerator / (c.revenue_millions / 4 * s.mid) * 100 AS estimate
FROM at_companies c JOIN at_assumptions s ON s.assumption_id = c.share_assumption_id
JOIN (SELECT ticker, sum(amount) AS numerator FROM at_mid GROUP BY 1) n USING (ticker)
""", "at_companies at_assumptions at_mid")


def estimate(x):
    return at.midpoint_estimate(x.flows, x.a, x.b, x.companies, x.assumptions)


@query("a11_midpoint_estimate", """
SELECT ticker, round(numerator, 6) AS numerator, round(denominator, 6) AS denominator,
       round(estimate, 6) AS estimate FROM at_estimate
""", "at_estimate")
def _(t):
    return rounded(estimate(Bundle(t)), ["numerator", "denominator", "estimate"])


@query("a11_recompute_gaps", """
SELECT e.ticker, round(estimate, 6) AS estimate, round(r.mid, 6) AS mid FROM at_estimate e
JOIN (SELECT ticker, quantile_cont(ratio, 0.5) AS mid FROM at_ratios GROUP BY 1) r USING (ticker)
WHERE abs(estimate - r.mid) > 0.5
""", "at_estimate at_ratios")
def _(t):
    x = Bundle(t)
    out = at.recompute_gaps(estimate(x), at.company_bands(x.ratios()))
    return rounded(out, ["estimate", "mid"])


CRITICAL = """
SELECT s.assumption_id, CASE WHEN greatest(n, d) >= 0.05 THEN 'CRITICAL' ELSE 'NONCRITICAL' END
         AS rating, greatest(n, d) AS share, n AS numerator_share, d AS denominator_share,
       CASE WHEN s.assumption_id LIKE 'A:%' AND s.assumption_id NOT LIKE '%/HOUSEHOLD' THEN 1
            ELSE 0 END AS independent_fallbacks
FROM (SELECT s.assumption_id, coalesce(n.v, 0) / tn AS n, coalesce(d.v, 0) / td AS d
  FROM at_assumptions s
  LEFT JOIN (SELECT id, sum(amount) AS v FROM (
      SELECT 'A:' || product || '/' || category AS id, amount FROM at_mid UNION ALL
      SELECT 'B:' || category || '/' || ticker, amount FROM at_mid WHERE category = 'FURNITURE')
    GROUP BY 1) n ON n.id = s.assumption_id
  LEFT JOIN (SELECT 'S:' || ticker AS id, denominator AS v FROM at_estimate) d
    ON d.id = s.assumption_id
  CROSS JOIN (SELECT sum(amount) AS tn FROM at_mid)
  CROSS JOIN (SELECT sum(denominator) AS td FROM at_estimate)) s
"""
view("at_critical", CRITICAL, "at_assumptions at_mid at_estimate")


def critical(x):
    a, s = x.sourced()
    return at.criticality(x.flows, x.a, x.b, x.companies, a, s)


@query("a12_criticality", """
SELECT assumption_id, rating, round(share, 8) AS share, round(numerator_share, 8)
         AS numerator_share, round(denominator_share, 8) AS denominator_share,
       independent_fallbacks::BIGINT AS independent_fallbacks,
       rating = 'CRITICAL' AND independent_fallbacks = 0 AS warning FROM at_critical
""", "at_critical")
def _(t):
    return rounded(critical(Bundle(t)), ["share", "numerator_share", "denominator_share"], 8)


@query("a13_criticality_drift", """
SELECT assumption_id, CASE WHEN rating = 'CRITICAL' THEN 'rating' ELSE 'share' END AS problem
FROM at_critical WHERE rating = 'CRITICAL' OR assumption_id LIKE 'B:%'
""", "at_critical")
def _(t):
    c = critical(Bundle(t))
    stored = c.select(
        "assumption_id", F.lit("NONCRITICAL").alias("rating"),
        F.when(F.col("assumption_id").startswith("B:"), F.col("share") + 1e-9).otherwise(
            F.col("share")).alias("share"))
    return at.criticality_drift(stored, c)


view("members", """
SELECT o_orderpriority AS product, o_custkey AS member,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount,
       o_custkey % 4 = 0 AS covered FROM orders GROUP BY ALL
""")
LOO = """
SELECT product, count(*) AS member_count, any_value(tc) / any_value(tt) AS share,
       min((tc - CASE WHEN covered THEN amount ELSE 0 END) / (tt - amount)) AS least_share,
       max((tc - CASE WHEN covered THEN amount ELSE 0 END) / (tt - amount)) AS greatest_share
FROM (SELECT *, CAST(sum(amount) OVER p AS BIGINT) AS tt,
             CAST(sum(CASE WHEN covered THEN amount ELSE 0 END) OVER p AS BIGINT) AS tc
      FROM members WINDOW p AS (PARTITION BY product)) GROUP BY 1
"""
view("loo", LOO, "members")


def members(t):
    return t.orders.select(
        F.col("o_orderpriority").alias("product"), F.col("o_custkey").alias("member"),
        cents("o_totalprice").alias("amount"), (F.col("o_custkey") % 4 == 0).alias("covered"))


@query("a14_leave_one_out_share", """
SELECT product, member_count, round(share, 9) AS share, round(least_share, 9) AS least_share,
       round(greatest_share, 9) AS greatest_share FROM loo
""", "loo")
def _(t):
    out = at.leave_one_out_share(members(t), "member", "amount", "covered", ["product"])
    return rounded(out, ["share", "least_share", "greatest_share"], 9)


@query("a15_regulated_shares", """
WITH r AS (SELECT o_orderpriority AS product, o_orderstatus AS report,
    sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS a,
    sum(CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS b,
    CASE WHEN o_orderstatus = 'F' THEN 1000 ELSE 1 END AS m
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT product, CAST(sum(a * m) AS BIGINT) AS auto_total, CAST(sum((a + b) * m) AS BIGINT) AS all_total,
       round(min(a / (a + b)), 9) AS least_share, round(max(a / (a + b)), 9) AS greatest_share,
       false AS invalid, round(sum(a * m) / sum((a + b) * m), 9) AS combined_share FROM r GROUP BY 1
""")
def _(t):
    rows = per_nation(t, F.col("o_orderpriority").alias("product"),
                      F.col("o_orderstatus").alias("report"))
    auto = F.col("category") == "AUTOMOBILE"
    reports = rows.groupBy("product", "report").agg(
        F.sum(F.when(auto, F.col("c")).otherwise(0)).alias("auto"),
        F.sum(F.when(~auto, F.col("c")).otherwise(0)).alias("other"),
    ).withColumn("unit_multiplier", F.when(F.col("report") == "F", 1000).otherwise(1))
    out = at.regulated_shares(reports, ["product"])
    return rounded(out, ["least_share", "greatest_share", "combined_share"], 9)


@query("a15_reconcile_share", """
SELECT product, round(0.25 * share, 9) AS derived_mid, round(0.25 * least_share, 9) AS derived_low,
       round(0.25 * greatest_share, 9) AS derived_high,
       product <> '2-HIGH' AS midpoint_ok, true AS ordered, product <> '5-LOW' AS encloses FROM loo
""", "loo")
def _(t):
    m = members(t)
    loo = at.leave_one_out_share(m, "member", "amount", "covered", ["product"])
    n = F.lit(0.25)
    off = F.when(F.col("product") == "2-HIGH", 1e-9).otherwise(0.0)
    pad = F.when(F.col("product") == "5-LOW", 0.0).otherwise(0.01)
    priors = loo.select("product", (n * F.col("share") + off).alias("mid"),
                        (n * F.col("share") - pad).alias("low"),
                        (n * F.col("share") + pad).alias("high"))
    national = loo.select("product", n.alias("national_share"))
    out = at.reconcile_share(national, m, priors, ["product"])
    return rounded(out, ["derived_mid", "derived_low", "derived_high"], 9)


@query("a16_normalized_weights", "SELECT * FROM at_weights", "at_weights")
def _(t):
    ct = Bundle(t).oc.groupBy("category", "ticker").agg(F.sum("c").alias("c"))
    return at.normalized_weights(ct, "ticker", "c", ["category"])


@query("a17_reweight_matrix_b", """
WITH v AS (SELECT c.ticker, CAST(round(c.revenue_millions * s.mid * 1e8) AS HUGEINT) AS v
  FROM at_companies c JOIN at_assumptions s ON s.assumption_id = c.share_assumption_id),
x AS (SELECT 'all' AS g, ticker, v FROM v UNION ALL SELECT 'sub', ticker, v FROM v WHERE ticker < 'N08'),
w AS (SELECT g, ticker, max(ticker) OVER (PARTITION BY g) AS last,
             v * 1000000000000 // (sum(v) OVER (PARTITION BY g))::HUGEINT AS w FROM x),
n AS (SELECT g, ticker, CASE WHEN ticker = last THEN CAST(1000000000000
        - sum(CASE WHEN ticker <> last THEN w ELSE 0 END) OVER (PARTITION BY g) AS BIGINT) / 1e12
        ELSE CAST(w AS BIGINT) / 1e12 END AS mid FROM w)
SELECT category, ticker, round(mid, 12) AS mid, assumption_id FROM at_b
WHERE category NOT IN ('HOUSEHOLD', 'MACHINERY', 'AUTOMOBILE') UNION ALL
SELECT c, ticker, mid, NULL FROM n CROSS JOIN (VALUES ('HOUSEHOLD'), ('MACHINERY')) k(c)
WHERE g = 'all' UNION ALL SELECT 'AUTOMOBILE', ticker, mid, NULL FROM n WHERE g = 'sub'
""", "at_b at_companies at_assumptions")
def _(t):
    x = Bundle(t)
    out = at.reweight_matrix_b(x.b, x.companies, x.assumptions, BROAD, "AUTOMOBILE",
                               x.companies.filter("ticker < 'N08'"))
    return out.select("category", "ticker", "mid", "assumption_id")


# ---- company facts --------------------------------------------------------------------------

T, QUARTER_END = "2000-08-20", "2000-06-30"


def company_facts(t):
    """Annual and year-to-date facts by nation, with the filings that carry them."""
    q = t.once("nation_quarters", lambda: per_nation(
        t, F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2)).alias("end")
    ).groupBy("ticker", "end").agg(F.sum("c").alias("c")))
    y = F.year("end")
    w = Window.partitionBy("ticker", y).orderBy("end")
    ytd = q.select("ticker", "end", y.alias("y"), F.quarter("end").alias("n"),
                   F.sum("c").over(w).alias("value"))
    jan = F.make_date("y", F.lit(1), F.lit(1))
    annual = ytd.filter("n = 4").select(
        "ticker", F.lit("10-K").alias("form"), F.lit("FY").alias("fp"), jan.alias("start"), "end",
        F.date_add("end", 60).alias("filed"),
        F.concat_ws("-", "ticker", "y", F.lit("K")).alias("accession"), "value")
    cur = ytd.filter("n < 4")
    own = cur.select(
        "ticker", F.lit("10-Q").alias("form"), F.concat(F.lit("Q"), "n").alias("fp"),
        jan.alias("start"), "end", F.date_add("end", 40).alias("filed"),
        F.concat_ws("-", "ticker", "y", F.concat(F.lit("Q"), "n")).alias("accession"), "value")
    before = cur.select("ticker", (F.col("y") + 1).alias("y"), "n", "value",
                        jan.alias("start"), "end")
    now = cur.select("ticker", "y", "n", F.date_add("end", 40).alias("filed"))
    prior = before.join(now, ["ticker", "y", "n"]).select(
        "ticker", F.lit("10-Q").alias("form"), F.concat(F.lit("Q"), "n").alias("fp"), "start",
        "end", "filed", F.concat_ws("-", "ticker", "y", F.concat(F.lit("Q"), "n"))
        .alias("accession"), "value")
    facts = union(annual, own, prior)
    filings = union(annual, own).select(
        "ticker", "form", "filed", F.col("end").alias("period"), "accession")
    return facts, filings


view("nq", """
SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ticker,
       last_day(CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) + INTERVAL 2 MONTH AS DATE)) AS e,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""")
view("fact_ytd", """
SELECT ticker, e, year(e) AS y, CAST(sum(c) OVER (PARTITION BY ticker, year(e) ORDER BY e) AS BIGINT)
       AS v FROM nq
""", "nq")


def selected(t):
    facts, filings = company_facts(t)
    annual = at.annual_fact(facts, T, QUARTER_END)
    latest = at.latest_filing(filings, "10-Q", T, annual, QUARTER_END)
    return facts, filings, annual, latest


@query("a18_annual_fact", """
SELECT ticker, make_date(1999, 1, 1) AS start, e AS "end", CAST(e + 60 AS DATE) AS filed,
       ticker || '-1999-K' AS accession, v AS value FROM fact_ytd WHERE e = DATE '1999-12-31'
""", "fact_ytd")
def _(t):
    return selected(t)[2].select("ticker", "start", "end", "filed", "accession", "value")


@query("a19_latest_filing", """
SELECT ticker, '10-Q' AS form, CAST(e + 40 AS DATE) AS filed, e AS period,
       ticker || '-2000-Q2' AS accession FROM fact_ytd WHERE e = DATE '2000-06-30'
""", "fact_ytd")
def _(t):
    return selected(t)[3]


@query("a20_ytd_pair", """
SELECT a.ticker, a.ticker || '-2000-Q2' AS accession, a.e AS period, a.v AS current_ytd,
       b.v AS prior_ytd FROM fact_ytd a JOIN fact_ytd b ON a.ticker = b.ticker
WHERE a.e = DATE '2000-06-30' AND b.e = DATE '1999-06-30'
""", "fact_ytd")
def _(t):
    facts, _, _, latest = selected(t)
    return at.ytd_pair(facts, latest)


def ttm(t):
    facts, filings, annual, latest = selected(t)
    return at.ttm_revenue(annual, at.ytd_pair(facts, latest)), filings


@query("a21_ttm_revenue", """
SELECT ticker, 'UPDATED_TTM_FROM_10Q' AS status, DATE '2000-06-30' AS period,
       CAST(sum(c) AS BIGINT) AS revenue, true AS plausible FROM nq
WHERE e BETWEEN DATE '1999-09-30' AND DATE '2000-06-30' GROUP BY 1
""", "nq")
def _(t):
    return ttm(t)[0].select("ticker", "status", "period", "revenue", "plausible")


@query("a22_refresh_record", """
SELECT '2000-Q2' AS target_quarter, DATE '2000-08-09' AS effective_at,
       DATE '2000-08-06' AS data_vintage, 'weights-1' AS methodology_version,
       count(DISTINCT ticker) AS company_count, count(DISTINCT ticker) AS updated_company_count,
       28 + 40 AS id_length FROM nq
""", "nq")
def _(t):
    inputs, filings = ttm(t)
    flows = pit.latest_complete_group(t.monthly, "2000-08-25", value="value_cents")
    out = at.refresh_record(flows, inputs, filings, "weights-1")
    return out.select("target_quarter", "effective_at", "data_vintage", "methodology_version",
                      "company_count", "updated_company_count",
                      F.length("refresh_id").alias("id_length"))


# ---- published views ------------------------------------------------------------------------

@query("a23_flow_rollup", """
WITH n AS (SELECT category AS g FROM at_mid GROUP BY 1 ORDER BY sum(amount) DESC, 1 LIMIT 1),
b AS (SELECT ticker AS g FROM at_lift ORDER BY lift DESC, ticker LIMIT 2)
SELECT product, CASE WHEN category IN (SELECT g FROM n) THEN category
       ELSE 'other-tier-' || tier END AS category_group, tier,
       CASE WHEN ticker IN (SELECT g FROM b) THEN ticker ELSE 'all-other' END AS company_group,
       round(sum(amount), 6) AS amount FROM at_mid GROUP BY 1, 2, 3, 4
""", "at_mid at_lift")
def _(t):
    x = Bundle(t)
    lifts = at.baseline_and_lift(x.ratios(), x.b, BROAD)
    return rounded(at.flow_rollup(at.midpoint_amounts(x.flows, x.a, x.b), lifts), ["amount"])


@query("a24_methodology_comparison", """
SELECT ticker, round(estimate, 6) AS prior_mid, round(estimate * 0.5, 6) AS original_mid,
       round(estimate * 1.25, 6) AS current_mid, round(estimate * 0.25, 6) AS delta_mid
FROM at_estimate
""", "at_estimate")
def _(t):
    e = estimate(Bundle(t))

    def version(f):
        m = F.col("estimate") * f
        return e.select("ticker", (m * 0.9).alias("low"), m.alias("mid"), (m * 1.1).alias("high"))

    out = at.methodology_comparison(version(0.5), version(1.0), version(1.25))
    cols = ["prior_mid", "original_mid", "current_mid", "delta_mid"]
    return rounded(out, cols).select("ticker", *cols)


@query("a25_company_history", """
SELECT ticker, year(e) || '-Q' || quarter(e) || ' refresh' AS label, CAST(e + 40 AS DATE)
         AS effective_at, round(c / 1e8, 4) AS mid, 'SEEN' AS status FROM nq UNION ALL
SELECT ticker, '2001-Q3 methodology snapshot', DATE '2001-09-30', round(estimate, 4),
       'VERSIONED_BASELINE' FROM at_estimate
""", "nq at_estimate")
def _(t):
    q = per_nation(t, F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2))
                   .alias("e")).groupBy("ticker", "e").agg((F.sum("c") / 1e8).alias("v"))
    one = F.struct("ticker", F.col("v").alias("low"), F.col("v").alias("mid"),
                   F.col("v").alias("high"), F.lit("SEEN").alias("status"))
    stored = q.groupBy("e").agg(
        F.to_json(F.struct(F.collect_list(one).alias("companies"))).alias("payload_json")).select(
        F.concat(F.year("e"), F.lit("-Q"), F.quarter("e")).alias("target_quarter"),
        F.date_add("e", 40).alias("effective_at"), "payload_json")
    m = F.col("estimate")
    now = estimate(Bundle(t)).select(
        "ticker", F.lit("2001-Q3").alias("quarter"),
        F.lit("2001-09-30").cast("date").alias("effective_at"), m.alias("low"), m.alias("mid"),
        m.alias("high"))
    out = at.company_history(stored, now)
    return rounded(out, ["mid"], 4).select("ticker", "label", "effective_at", "mid", "status")


@query("a26_extremes", """
SELECT arg_min(ticker, estimate) AS lowest_ticker, round(min(estimate), 6) AS lowest_mid,
       arg_max(ticker, estimate) AS highest_ticker, round(max(estimate), 6) AS highest_mid
FROM at_estimate
""", "at_estimate")
def _(t):
    e = estimate(Bundle(t)).withColumnRenamed("estimate", "mid")
    return rounded(at.extremes(e), ["lowest_mid", "highest_mid"])


META = {"methodology_version": "weights-1", "publication_mode": "preview", "license": "CC-BY-4.0"}


view("at_used", """
SELECT b.ticker, a.assumption_id FROM at_b b JOIN at_a a USING (category) UNION
SELECT ticker, assumption_id FROM at_b WHERE assumption_id IS NOT NULL UNION
SELECT ticker, share_assumption_id FROM at_companies
""", "at_a at_b at_companies")


@query("a27_company_feed", """
WITH q AS (SELECT ticker, quantile_cont(ratio, 0.1) AS low, quantile_cont(ratio, 0.9) AS high,
  quantile_cont(numerator, 0.5) AS nm, quantile_cont(denominator, 0.5) AS dm FROM at_ratios GROUP BY 1),
d AS (SELECT ticker, draw, sum(CASE WHEN tier = 1 THEN amount ELSE 0 END) AS a,
    sum(CASE WHEN tier = 2 THEN amount ELSE 0 END) AS b,
    sum(CASE WHEN tier = 3 THEN amount ELSE 0 END) AS c FROM at_contrib GROUP BY ALL),
m AS (SELECT ticker, quantile_cont(a, 0.5) AS a, quantile_cont(b, 0.5) AS b,
             quantile_cont(c, 0.5) AS c FROM d GROUP BY 1),
s AS (SELECT u.ticker, u.assumption_id, corr(d.value, r.ratio) AS c FROM at_used u
      JOIN at_ratios r ON r.ticker = u.ticker
      JOIN at_draws d ON d.assumption_id = u.assumption_id AND d.draw = r.draw GROUP BY ALL),
top AS (SELECT ticker, string_agg(assumption_id || CASE WHEN c >= 0 THEN ' increases' ELSE ' decreases' END,
          ',' ORDER BY place) AS sensitivity
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(c) DESC, assumption_id) AS place FROM s)
  WHERE place <= 5 GROUP BY 1)
SELECT l.ticker, round(q.low, 6) AS low, round(l.mid, 6) AS mid, round(q.high, 6) AS high,
       round(nm, 6) AS numerator_mid, round(dm, 6) AS denominator_mid,
       round(l.baseline_mid, 6) AS baseline_mid, round(l.lift, 6) AS lift,
       'evidence-supported' AS lift_status, round(a / (a + b + c), 6) AS tier1_share,
       round(b / (a + b + c), 6) AS tier2_share, round(1 - a / (a + b + c) - b / (a + b + c), 6) AS tier3_share,
       u.ids AS assumption_ids, top.sensitivity, '/companies/' || lower(l.ticker) || '/' AS permalink,
       'weights-1' AS methodology_version, 'preview' AS publication_mode, 'CC-BY-4.0' AS license
FROM at_lift l JOIN q USING (ticker) JOIN m USING (ticker) JOIN top USING (ticker)
JOIN (SELECT ticker, string_agg(assumption_id, '|' ORDER BY assumption_id) AS ids FROM at_used GROUP BY 1) u
  USING (ticker)
""", "at_lift at_used at_ratios at_contrib at_draws")
def _(t):
    x = Bundle(t)
    ratios = materialize(x.ratios(), "ratios")
    used = at.used_assumptions(x.a, x.b, x.companies)
    feed = at.company_feed(
        at.company_bands(ratios), at.baseline_and_lift(ratios, x.b, BROAD),
        at.tier_shares(x.contributions(x.draws())), used,
        at.sensitivity_top_k(ratios, x.draws(), used), META)
    # Correlations are compared in a09; here their order and direction.
    read = F.from_json("sensitivity", "array<struct<assumption_id string, absolute_correlation double, "
                       "direction string>>")
    text = F.array_join(F.transform(read, lambda r: F.concat_ws(
        " ", r["assumption_id"], r["direction"])), ",")
    return rounded(feed, [c for c in feed.columns if feed.schema[c].dataType.typeName() == "double"]
                   ).withColumn("sensitivity", text)


@query("a27_assumption_feed", """
SELECT assumption_id, low AS value_low, mid AS value_mid, high AS value_high, tier,
       'weights-1' AS methodology_version, 'preview' AS publication_mode, 'CC-BY-4.0' AS license
FROM at_assumptions
""", "at_assumptions")
def _(t):
    return at.assumption_feed(Bundle(t).assumptions, META)


@query("a27_exclusion_feed", """
SELECT s_name AS company_name, 'no market share' AS reason, 'weights-1' AS methodology_version,
       'preview' AS publication_mode, 'CC-BY-4.0' AS license FROM supplier
WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
""")
def _(t):
    n = t.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    out = t.supplier.join(n, "s_nationkey", "left_anti").select(
        F.col("s_name").alias("company_name"), F.lit("no market share").alias("reason"))
    return at.exclusion_feed(out, META)
