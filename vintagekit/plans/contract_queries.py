"""Queries for table contracts, keys and calendar keys."""

from pyspark.sql import functions as F

from vintagekit.functions import calendar as cal
from vintagekit.functions import keys
from vintagekit.operators import contracts as c
from vintagekit.plans.registry import query, row_sha, row_text, view
from vintagekit.schemas import schema_for

OBS = ["source", "series_id", "obs_period", "value", "unit", "release_date", "vintage_date",
       "ingested_at", "source_url", "checksum"]


def loan_rules():
    return {
        "price positive": F.col("l_extendedprice") > 0,
        "discount at most 5 percent": F.col("l_discount") <= 0.05,
        "ships after 1995": F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"),
        "flag known": F.col("l_returnflag").isin("A", "N"),
    }


def profile_sql(columns, source):
    """DuckDB SQL of a column profile: (name, kind, text of the column, type to convert to)."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, '{kind}' AS kind, count(*) AS row_count, "
        f"count(*) FILTER ({text} IS NULL) AS null_count, count(*) FILTER ({text} IS NOT NULL AND "
        f"try_cast({text} AS {duck}) IS NULL) AS unconvertible_count, "
        f"CAST(min(try_cast({text} AS {duck})) AS VARCHAR) AS least, "
        f"CAST(max(try_cast({text} AS {duck})) AS VARCHAR) AS greatest FROM {source}"
        for name, kind, text, duck in columns)


@query("c01_table_columns", "WITH x AS (SELECT *, CASE WHEN month(obs_period) = 3 THEN 'soon' "
       "ELSE CAST(obs_period AS VARCHAR) END AS p, CASE WHEN month(obs_period) <> 4 THEN unit END AS u "
       "FROM observations) " + profile_sql([
           ("source", "string", "source", "VARCHAR"), ("series_id", "string", "series_id", "VARCHAR"),
           ("obs_period", "date", "p", "DATE"), ("unit", "string", "u", "VARCHAR"),
           ("release_date", "timestamp", "release_date", "TIMESTAMP"),
           ("vintage_date", "date", "vintage_date", "DATE"),
           ("ingested_at", "timestamp", "ingested_at", "TIMESTAMP"),
           ("source_url", "string", "source_url", "VARCHAR"), ("checksum", "string", "checksum", "VARCHAR"),
       ], "x"), "observations")
def _(t):
    # Dates as text, a month of them unreadable, and a month without a unit.
    month = F.month("obs_period")
    raw = t.observations.withColumns({
        "obs_period": F.when(month == 3, "soon").otherwise(F.col("obs_period").cast("string")),
        "unit": F.when(month != 4, F.col("unit"))})
    return c.column_profile(raw, schema_for("raw_observations")).filter("column_name <> 'value'")


@query("c02_check_columns", """
SELECT 'missing' AS rule, 'l_comment' AS column_name, 0::BIGINT AS rows_with_value, count(*) AS row_count
FROM lineitem UNION ALL
SELECT 'extra', 'l_tax', count(*) FILTER (l_linenumber <> 2), count(*) FROM lineitem
""")
def _(t):
    want = [x for x in t.lineitem.columns if x != "l_tax"] + ["l_comment"]
    rows = t.lineitem.withColumn("l_tax", F.when(F.col("l_linenumber") != 2, F.col("l_tax")))
    return c.column_differences(rows, want)


@query("c03_check_not_null", """
SELECT 'quality not null' AS rule, count(*) AS checked_rows,
       count(*) FILTER (l.quality IS NULL) AS failed_rows
FROM documents d LEFT JOIN labels l USING (doc_id) HAVING count(*) FILTER (l.quality IS NULL) > 0
""")
def _(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return c.check_not_null(d, ["doc_id", "lang", "quality"])


@query("c04_check_rows", """
WITH r AS (SELECT l_linestatus, count(*) AS checked_rows,
    count(*) FILTER (NOT l_extendedprice > 0) AS a, count(*) FILTER (NOT l_discount <= 0.05) AS b,
    count(*) FILTER (NOT l_shipdate >= TIMESTAMP '1996-01-01') AS c,
    count(*) FILTER (NOT l_returnflag IN ('A', 'N')) AS d FROM lineitem GROUP BY 1)
SELECT l_linestatus, checked_rows, rule, failed_rows FROM (
  SELECT l_linestatus, checked_rows, 'price positive' AS rule, a AS failed_rows FROM r UNION ALL
  SELECT l_linestatus, checked_rows, 'discount at most 5 percent', b FROM r UNION ALL
  SELECT l_linestatus, checked_rows, 'ships after 1995', c FROM r UNION ALL
  SELECT l_linestatus, checked_rows, 'flag known', d FROM r) WHERE failed_rows > 0
""")
def _(t):
    return c.check_rows(t.lineitem, loan_rules(), ["l_linestatus"])


@query("c04_observation_rules", """
SELECT rule, checked_rows, 0 AS failed_rows FROM (SELECT count(*) AS checked_rows FROM observations)
CROSS JOIN (VALUES ('value finite'), ('checksum form'), ('vintage day is release day'),
  ('ingested after release'), ('period before release'), ('unit')) v(rule)
""", "observations")
def _(t):
    counted = c.count_rules(t.observations, c.observation_rules("million"))
    return counted.withColumn("failed_rows", F.col("failed_rows").cast("int"))


@query("c05_check_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2
HAVING count(*) > 1
""")
def _(t):
    return c.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("c06_check_coverage", """
SELECT p_partkey AS part, 'missing' AS problem FROM part
WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 10)
UNION ALL
SELECT DISTINCT l_partkey, 'extra' FROM lineitem
WHERE l_quantity < 10 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)
""")
def _(t):
    sold = t.lineitem.filter("l_quantity < 10").select(F.col("l_partkey").alias("part"))
    want = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("part"))
    return c.check_coverage(sold, want, ["part"])


@query("c07_check_group_shape", """
WITH m AS (SELECT l_suppkey, l_linenumber, count(*) AS n, min(l_returnflag) AS lo,
                  max(l_returnflag) AS hi FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS member_count,
       min(n) AS min_rows_per_member, max(n) AS max_rows_per_member,
       min(lo) <> max(hi) AS l_returnflag_differs
FROM m GROUP BY 1 HAVING sum(n) <> 600 OR min(lo) <> max(hi)
""")
def _(t):
    return c.check_group_shape(t.lineitem, ["l_suppkey"], "l_linenumber", rows=600,
                               same=["l_returnflag"])


@query("c08_check_same_periods", """
WITH p AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey,
                  last_day(CAST(l_shipdate AS DATE)) AS p FROM lineitem),
h AS (SELECT l_returnflag, l_linestatus, p, count(*) AS held FROM p GROUP BY ALL),
s AS (SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS series_count
      FROM p GROUP BY ALL)
SELECT l_returnflag, l_linestatus, any_value(series_count) AS series_count,
       count(*) AS period_count, max(p) AS latest_period,
       min(held) = any_value(series_count) AS aligned, true AS fresh
FROM h JOIN s USING (l_returnflag, l_linestatus) GROUP BY 1, 2
HAVING min(held) <> any_value(series_count)
""")
def _(t):
    li = t.lineitem.select("l_returnflag", "l_linestatus", "l_suppkey",
                           F.last_day(F.to_date("l_shipdate")).alias("p"))
    return c.check_same_periods(li, ["l_returnflag", "l_linestatus"], "l_suppkey", "p")


@query("c09_check_snapshot_honesty", """
SELECT series_id, obs_period, release_date, value_cents,
       CAST(obs_period + 37 AS DATE) AS ingested_at FROM vintages
WHERE release_date <> CAST(obs_period + 37 AS DATE)
""", "vintages")
def _(t):
    snap = t.vintages.withColumn("ingested_at", F.date_add("obs_period", 37))
    return c.check_snapshot_honesty(snap)


@query("c10_new_batches", """
SELECT series_id, obs_period, release_date, value_cents, source_url, checksum FROM observations
WHERE release_date > DATE '1999-06-30'
""", "observations")
def _(t):
    names = ["series_id", "obs_period", "release_date", "value_cents", "source_url", "checksum"]
    obs = t.observations.select(*names)
    return c.new_batches(obs, obs.filter("release_date <= date'1999-06-30'")).select(*names)


@query("c11_batch_conflicts", """
WITH a AS (SELECT series_id, obs_period, release_date, value_cents FROM vintages
           WHERE release_date <= DATE '1999-12-31'),
b AS (SELECT series_id, obs_period, release_date,
             CASE WHEN month(obs_period) = 5 THEN value_cents + 1 ELSE value_cents END AS value_cents
      FROM vintages WHERE release_date >= DATE '1999-01-31')
SELECT *, 'incoming' AS only_in, 1 AS row_count FROM (
  SELECT * FROM a WHERE release_date >= DATE '1999-01-31' EXCEPT ALL SELECT * FROM b) UNION ALL
SELECT *, 'stored' AS only_in, 1 AS row_count FROM (
  SELECT * FROM b WHERE release_date <= DATE '1999-12-31' EXCEPT ALL SELECT * FROM a)
""", "vintages")
def _(t):
    v = t.vintages
    stored = v.filter("release_date >= date'1999-01-31'").withColumn(
        "value_cents", F.when(F.month("obs_period") == 5, F.col("value_cents") + 1)
        .otherwise(F.col("value_cents")))
    found = c.batch_conflicts(v.filter("release_date <= date'1999-12-31'"), stored,
                              ["release_date"], v.columns)
    return found.withColumn("row_count", F.col("row_count").cast("int"))


@query("c12_check_registry_match", """
WITH j AS (SELECT l.l_partkey AS part, l.l_linenumber % 3 AS ask, p.p_size, p.p_partkey,
                  CAST(l.l_quantity AS INTEGER) AS q FROM lineitem l
           LEFT JOIN (SELECT * FROM part WHERE p_size < 40) p ON l.l_partkey = p.p_partkey)
SELECT problem, count(*) AS row_count FROM (
  SELECT 'unregistered' AS problem FROM j WHERE p_partkey IS NULL UNION ALL
  SELECT 'p_size' FROM j WHERE p_partkey IS NOT NULL AND p_size <> q) GROUP BY 1
""")
def _(t):
    li = t.lineitem.select(F.col("l_partkey").alias("part"),
                           F.col("l_quantity").cast("int").alias("p_size"))
    reg = t.part.filter("p_size < 40").select(F.col("p_partkey").alias("part"), "p_size")
    bad = c.check_registry_match(li, reg, ["part"], ["p_size"])
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("row_count"))


@query("c13_check_component_sum", """
WITH s AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS total,
    sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS f,
    sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS o
  FROM orders GROUP BY 1)
SELECT o_custkey, CAST(total AS BIGINT) AS total, CAST(f AS BIGINT) AS f, CAST(o AS BIGINT) AS o,
       CAST(total - f - o AS BIGINT) AS residual FROM s WHERE abs(total - f - o) > 20000
""")
def _(t):
    v = F.round(F.col("o_totalprice") * 100).cast("bigint")
    s = t.orders.groupBy("o_custkey").agg(
        F.sum(v).alias("total"),
        *[F.sum(F.when(F.col("o_orderstatus") == x, v).otherwise(0)).alias(x.lower())
          for x in ("F", "O")])
    return c.check_component_sum(s, "total", ["f", "o"], 20000)


@query("c14_range_summary", """
SELECT source, series_no, count(*) AS row_count, max(obs_date) AS latest_period,
       min(ingested_at) AS first_release, max(ingested_at) AS last_release
FROM seen GROUP BY GROUPING SETS ((source, series_no), (source))
""", "seen")
def _(t):
    return c.range_summary(t.seen, "source", "series_no", "obs_date", "ingested_at")


view("moved", """
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
       CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'deleted'
            WHEN a.s <> b.s THEN 'changed' END AS change
FROM (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderdate < '2000-01-01') a
FULL JOIN (SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS s
           FROM orders WHERE o_orderdate >= '1996-01-01') b ON a.o_orderkey = b.o_orderkey
""")


def _moved(t):
    o = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice",
                        F.col("o_orderstatus").alias("s"))
    new = o.filter("o_orderdate >= timestamp_ntz'1996-01-01'").withColumn(
        "s", F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("s")))
    return o.filter("o_orderdate < timestamp_ntz'2000-01-01'"), new


@query("c15_append_only_superset", "SELECT * FROM moved WHERE change IS NOT NULL", "moved")
def _(t):
    old, new = _moved(t)
    return c.append_only_superset(old, new, ["o_orderkey"], ["s"])


@query("c17_snapshot_diff", """
SELECT o_orderkey, CASE change WHEN 'deleted' THEN 'removed' ELSE change END AS change
FROM moved WHERE change IS NOT NULL
""", "moved")
def _(t):
    pinned, current = _moved(t)
    return c.snapshot_diff(current, pinned, ["o_orderkey"], ["s"])


@query("c16_check_ledger_relations", """
WITH p AS (SELECT DISTINCT o_custkey AS k FROM orders),
g AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 5000),
u AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT k AS prediction_id, 'grade without prediction' AS problem FROM g
WHERE k NOT IN (SELECT k FROM p) UNION ALL
SELECT k, 'publication without prediction' FROM u WHERE k NOT IN (SELECT k FROM p) UNION ALL
SELECT k, 'prediction not published' FROM p WHERE k NOT IN (SELECT k FROM u)
""")
def _(t):
    cust = t.customer.select(F.col("c_custkey").alias("prediction_id"), "c_acctbal")
    return c.check_ledger_relations(
        t.orders.select(F.col("o_custkey").alias("prediction_id")),
        cust.filter("c_acctbal > 5000"), cust.filter("c_acctbal > 0"))


@query("c18_partition_check", """
WITH i AS (SELECT p_partkey FROM part WHERE p_size < 30 AND p_type = 'ECONOMY'),
e AS (SELECT p_partkey FROM part WHERE p_size > 20)
SELECT p_partkey, CASE WHEN p_partkey IN (SELECT * FROM i) THEN 'assigned twice'
                       ELSE 'unassigned' END AS problem FROM part
WHERE (p_partkey IN (SELECT * FROM i)) = (p_partkey IN (SELECT * FROM e))
""")
def _(t):
    return c.partition_check(t.part, t.part.filter("p_size < 30 and p_type = 'ECONOMY'"),
                             t.part.filter("p_size > 20"), ["p_partkey"])


DIGEST = """
sha256(concat_ws('|', CAST(count(h) AS VARCHAR),
  CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR),
  CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR),
  CAST(sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) AS VARCHAR),
  CAST(sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)) AS VARCHAR)))
"""


@query("k01_batch_hash", f"""
SELECT o_orderpriority, count(h) AS row_count, {DIGEST} AS batch_hash FROM (
  SELECT o_orderpriority, {row_sha("o_custkey", "o_orderkey", "o_orderstatus")} AS h
  FROM orders) GROUP BY 1
""")
def _(t):
    return keys.batch_hash(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus"],
                           ["o_orderpriority"])


@query("k02_record_id", f"""
SELECT o_orderkey, 'prd_' || {row_sha("o_custkey", "o_orderpriority", "CAST(o_orderdate AS DATE)")}
  AS record_id FROM orders
""")
def _(t):
    return t.orders.select("o_orderkey", keys.record_id(
        ["o_custkey", "o_orderpriority", F.to_date("o_orderdate")]).alias("record_id"))


@query("k03_inputs_hash", f"""
WITH r AS (SELECT series_id, obs_period, {row_sha("obs_period", "release_date", "value_cents")} AS h
           FROM first_prints),
s AS (SELECT series_id, obs_period, count(h) OVER w AS n,
  sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) OVER w AS a,
  sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) OVER w AS b,
  sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) OVER w AS c,
  sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)) OVER w AS d FROM r
  WINDOW w AS (PARTITION BY series_id ORDER BY obs_period
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series_id, obs_period, sha256(concat_ws('|', {row_text("'ar2'", "obs_period")},
  CAST(n AS VARCHAR), CAST(coalesce(a, 0) AS VARCHAR), CAST(coalesce(b, 0) AS VARCHAR),
  CAST(coalesce(c, 0) AS VARCHAR), CAST(coalesce(d, 0) AS VARCHAR))) AS inputs_hash FROM s
""", "first_prints")
def _(t):
    out = keys.inputs_hash(t.first_prints, ["series_id"], ["obs_period"],
                           ["obs_period", "release_date", "value_cents"], "ar2")
    return out.select("series_id", "obs_period", "inputs_hash")


@query("k04_canonical_round", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
       round(l_extendedprice * (1 - l_discount) / 3, 4) AS net FROM lineitem
""")
def _(t):
    net = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 3).alias("net"))
    return keys.canonical_round(net, ["net"], 4)


@query("k05_receipt_id", f"""
SELECT event_id, 'rcp_' || {row_sha("event_id", "event_type", "user_id")} AS receipt_id,
       event_type = 'error' AS tampered FROM events
""")
def _(t):
    cols = ["event_id", "event_type", "user_id"]
    made = keys.receipt(t.events.select(*cols), cols)
    touched = made.withColumn("user_id", F.when(F.col("event_type") == "error", -1)
                              .otherwise(F.col("user_id")))
    bad = keys.tampered_receipts(touched, cols).select("event_id", F.lit(True).alias("tampered"))
    return made.join(bad, "event_id", "left").select(
        "event_id", "receipt_id", F.coalesce("tampered", F.lit(False)).alias("tampered"))


@query("f08_calendar_keys", """
SELECT d, last_day(d) AS month_end, last_day(CAST(d + INTERVAL 1 MONTH AS DATE)) AS next_month_end,
       last_day(CAST(last_day(d) - INTERVAL 1 MONTH AS DATE)) AS previous_month_end,
       last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE)) AS quarter_end,
       last_day(CAST(date_trunc('quarter', d) - INTERVAL 4 MONTH AS DATE)) AS two_quarters_before,
       year(d) || '-Q' || quarter(d) AS quarter_label,
       len(range(CAST(date_trunc('month', d) AS TIMESTAMP), TIMESTAMP '2002-01-01',
           INTERVAL 1 MONTH)) AS months_to_2001_end, day_count
FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS day_count FROM orders GROUP BY 1)
""")
def _(t):
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(
        F.count(F.lit(1)).alias("day_count"))
    return days.select(
        "d", "day_count", cal.month_end("d").alias("month_end"),
        cal.shift_month_end("d", 1).alias("next_month_end"),
        cal.shift_month_end("d", -1).alias("previous_month_end"),
        cal.quarter_end("d").alias("quarter_end"),
        cal.shift_quarter_end("d", -2).alias("two_quarters_before"),
        cal.quarter_label("d").alias("quarter_label"),
        F.size(cal.month_ends_between("d", F.lit("2001-12-31").cast("date"))).cast("bigint")
        .alias("months_to_2001_end"))
