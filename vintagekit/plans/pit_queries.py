"""Queries for point-in-time selection."""

from pyspark.sql import functions as F

from vintagekit.functions import calendar as cal
from vintagekit.operators import pit
from vintagekit.plans.registry import query

KEYS = ["series_id", "obs_period"]


@query("p01_as_of", "SELECT * FROM vintages WHERE release_date <= DATE '1999-06-30'", "vintages")
def _(t):
    return pit.as_of(t.vintages, "1999-06-30")


@query("p02_as_of_many", """
SELECT v.series_id, v.obs_period, v.release_date, v.value_cents, b.bound
FROM (SELECT *, lead(release_date) OVER (PARTITION BY series_id, obs_period ORDER BY release_date)
             AS nxt FROM vintages) v
JOIN (SELECT DISTINCT series_id, CAST(last_day(obs_period) + 15 AS DATE) AS bound
      FROM vintages WHERE month(obs_period) IN (3, 6, 9, 12)) b
  ON v.series_id = b.series_id AND v.release_date <= b.bound
 AND (v.nxt IS NULL OR b.bound < v.nxt)
""", "vintages")
def _(t):
    bounds = t.vintages.filter(F.month("obs_period").isin(3, 6, 9, 12)).select(
        "series_id", F.date_add("obs_period", 15).alias("bound")).distinct()
    return pit.as_of_many(t.vintages, bounds, KEYS, ["series_id"], "bound", ["value_cents"])


@query("p03_latest_vintage", """
SELECT series_id, obs_period, max(release_date) AS release_date,
       max_by(value_cents, release_date) AS value_cents
FROM vintages WHERE release_date <= DATE '1999-06-30' GROUP BY ALL
""", "vintages")
def _(t):
    return pit.latest_vintage(pit.as_of(t.vintages, "1999-06-30"), KEYS,
                              ["release_date", "value_cents"])


@query("p04_first_print", """
SELECT series_id, obs_period, release_date, value_cents, checksum, source_url FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, obs_period
                               ORDER BY release_date, ingested_at, checksum) AS rn
  FROM observations WHERE regexp_matches(source_url, '/sales/[0-9]{6}/')) WHERE rn = 1
""", "observations")
def _(t):
    return pit.first_print(
        t.observations, KEYS, url="source_url", url_pattern="/sales/[0-9]{6}/"
    ).select(*KEYS, "release_date", "value_cents", "checksum", "source_url")


@query("p05_vintage_conflicts", """
SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS release_date,
       min(l_quantity) AS min_value, max(l_quantity) AS max_value
FROM lineitem GROUP BY ALL HAVING min(l_quantity) <> max(l_quantity)
""")
def _(t):
    li = t.lineitem.select(F.col("l_partkey").alias("part"),
                           F.to_date("l_shipdate").alias("release_date"), "l_quantity")
    return pit.vintage_conflicts(li, ["part", "release_date"], "l_quantity")


@query("p06_exact_dedupe", """
SELECT DISTINCT o_orderpriority AS series_id, last_day(CAST(o_orderdate AS DATE)) AS obs_period,
       l_quantity AS value, CAST(l_shipdate AS DATE) AS release_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("series_id"),
                        F.last_day(F.to_date("o_orderdate")).alias("obs_period"))
    li = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("value"),
                           F.to_date("l_shipdate").alias("release_date"))
    cols = ["series_id", "obs_period", "value", "release_date"]
    return pit.exact_dedupe(li.join(o, "k").select(*cols), cols)


@query("p07_release_coherent_change", """
SELECT a.series_id, a.obs_period, a.release_date, a.value_cents,
       b.value_cents AS previous_value, a.value_cents - b.value_cents AS change
FROM vintages a JOIN vintages b ON a.series_id = b.series_id AND a.release_date = b.release_date
 AND a.obs_period = last_day(CAST(b.obs_period + INTERVAL 1 MONTH AS DATE))
""", "vintages")
def _(t):
    return pit.release_coherent_change(t.vintages, "series_id", "obs_period", "value_cents",
                                       "release_date")


@query("p08_check_continuity", """
WITH d AS (SELECT s, p, lag(p) OVER (PARTITION BY s ORDER BY p) AS pp
           FROM (SELECT DISTINCT l_suppkey AS s, last_day(CAST(l_shipdate AS DATE)) AS p
                 FROM lineitem))
SELECT s AS supplier, p AS period, pp AS previous_period, 'gap' AS problem FROM d
WHERE pp IS NOT NULL AND p <> last_day(CAST(pp + INTERVAL 1 MONTH AS DATE))
""")
def _(t):
    li = t.lineitem.select(F.col("l_suppkey").alias("supplier"),
                           F.last_day(F.to_date("l_shipdate")).alias("period"))
    return pit.check_continuity(li, "supplier", "period")


@query("p09_target_history", """
SELECT series_id, obs_period, release_date, value_cents, value FROM first_prints
WHERE release_date <= DATE '2000-12-31' AND obs_period >= DATE '1996-01-31'
""", "first_prints")
def _(t):
    return pit.target_history(t.first_prints, "2000-12-31", start="1996-01-31")


@query("p09_target_history_violations", """
WITH k AS (SELECT series_id, obs_period, min(release_date) AS r0, max(release_date) AS r1
           FROM vintages WHERE release_date <= DATE '2000-12-31' GROUP BY ALL)
SELECT series_id, obs_period, 'several releases' AS problem FROM k WHERE r0 <> r1
UNION ALL
SELECT series_id, obs_period, CASE WHEN gap THEN 'gap' ELSE 'release order' END AS problem FROM (
  SELECT series_id, obs_period,
         obs_period <> last_day(CAST(lag(obs_period) OVER w + INTERVAL 1 MONTH AS DATE)) AS gap,
         r1 <= lag(r1) OVER w AS late
  FROM k WINDOW w AS (PARTITION BY series_id ORDER BY obs_period)) WHERE gap OR late
""", "vintages")
def _(t):
    return pit.target_history_violations(t.vintages, "2000-12-31", value="value_cents")


@query("p10_target_history_with_gaps", """
SELECT series_id, obs_period, release_date, value_cents, value FROM first_prints
WHERE release_date <= DATE '2000-12-31' AND month(obs_period) <> 9
  AND release_date = last_day(CAST(obs_period + INTERVAL 1 MONTH AS DATE))
""", "first_prints")
def _(t):
    schedule = t.first_prints.filter(F.month("obs_period") != 9).select(
        "obs_period", cal.shift_month_end("obs_period", 1).alias("release_date")).distinct()
    return pit.target_history(t.first_prints, "2000-12-31", schedule=schedule)


@query("p11_shared_latest_vintage", """
SELECT count(*) AS series_count, min(r) AS earliest_latest, max(r) AS latest_latest,
       CASE WHEN min(r) = max(r) THEN max(r) END AS shared_release
FROM (SELECT series_id, max(release_date) AS r FROM vintages
      WHERE release_date <= DATE '1999-06-30' GROUP BY ALL)
""", "vintages")
def _(t):
    return pit.shared_latest_vintage(t.vintages, "1999-06-30")


@query("p12_forecast_origin", """
SELECT t.series_id, t.target_period, t.release_at, max(w.release_date) AS origin
FROM targets t LEFT JOIN (SELECT DISTINCT series_id, release_date FROM weekly) w
  ON t.series_id = w.series_id AND w.release_date < t.release_at GROUP BY ALL
""", "targets weekly")
def _(t):
    return pit.forecast_origin(
        t.targets.select("series_id", "target_period", "release_at"), t.weekly, ["series_id"])


@query("p12_as_of_join_orders", """
SELECT o.o_orderkey, o.o_custkey, CAST(o.o_orderdate AS DATE) AS o_day,
       max(p.d) AS previous_day, max_by(p.c, p.d) AS previous_cents
FROM orders o LEFT JOIN (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS d,
         max(CAST(round(o_totalprice * 100) AS BIGINT)) AS c FROM orders GROUP BY ALL) p
  ON o.o_custkey = p.o_custkey AND p.d < CAST(o.o_orderdate AS DATE)
GROUP BY ALL
""")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_day"),
                        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    right = o.select("o_custkey", F.col("o_day").alias("previous_day"),
                     F.col("c").alias("previous_cents"))
    return pit.as_of_join(o.drop("c"), right, ["o_custkey"], "o_day", "previous_day",
                          ["previous_day", "previous_cents"], strict=True)


@query("p13_period_cutoff",
       "SELECT * FROM vintages WHERE obs_period <= DATE '1997-12-31'", "vintages")
def _(t):
    return pit.period_cutoff(t.vintages, "1997-12-31")


@query("p14_revision_log", """
SELECT series_id, obs_period, release_date, value_cents,
       CAST(row_number() OVER w AS INTEGER) AS vintage_no,
       value_cents - lag(value_cents) OVER w AS revision
FROM vintages WINDOW w AS (PARTITION BY series_id, obs_period ORDER BY release_date)
""", "vintages")
def _(t):
    return pit.revision_log(t.vintages, KEYS, "value_cents")


@query("p15_latest_complete_group", """
WITH q AS (SELECT series_id, last_day(CAST(date_trunc('quarter', obs_period) + INTERVAL 2 MONTH
                  AS DATE)) AS quarter_end, count(*) AS n, count(DISTINCT month(obs_period)) AS m,
                  sum(value_cents) AS total, max(release_date) AS v
           FROM monthly WHERE release_date <= DATE '1999-02-20' GROUP BY ALL),
c AS (SELECT quarter_end, max(v) AS data_vintage FROM q WHERE n = 3 AND m = 3
      GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT series_id) FROM monthly
                                    WHERE release_date <= DATE '1999-02-20'))
SELECT year(q.quarter_end) || '-Q' || quarter(q.quarter_end) AS quarter, q.quarter_end,
       series_id, CAST(total AS BIGINT) AS total, data_vintage
FROM q JOIN c USING (quarter_end) WHERE quarter_end = (SELECT max(quarter_end) FROM c)
""", "monthly")
def _(t):
    return pit.latest_complete_group(t.monthly, "1999-02-20", value="value_cents")
