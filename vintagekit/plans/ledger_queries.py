"""Queries for ledgers, live calibration and serving."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintagekit.functions import keys as k
from vintagekit.operators import contracts as c
from vintagekit.operators import evaluate as ev
from vintagekit.operators import forecast as fc
from vintagekit.operators import ledger as lg
from vintagekit.operators import serving as sv
from vintagekit.plans.model_queries import METRICS_SQL, long_view, points_view, rounded
from vintagekit.plans.registry import query, row_sha, view

START = "1997-01-31"
NUMBERS = list(lg.NUMBERS)


def flows(t):
    """Month-on-month change of order value as the graded target, with its release address."""
    return t.once("flows", lambda: _flows(t))


def _flows(t):
    w = Window.partitionBy("series_id").orderBy("obs_period")
    d = (F.col("value_cents") - F.lag("value_cents").over(w)) / 1e8
    return t.monthly.withColumn("value", d).filter("value is not null").select(
        "series_id", "obs_period", "value", "release_date",
        F.concat(F.lit("https://data.example/flow/"), F.date_format("release_date", "yyyyMM"))
        .alias("source_url"))


def flow_forecasts(t):
    return fc.expanding_baselines(flows(t), START)


def predictions(t):
    return t.once("predictions", lambda: _predictions(t))


def _predictions(t):
    rows = fc.empirical_bands(flow_forecasts(t), flows(t)).filter("width80 is not null")
    return lg.to_predictions(rows.select(
        F.col("series_id").alias("target_series"), F.col("obs_period").alias("target_period"),
        F.col("model").alias("model_version"), F.col("obs_period").alias("made_at"), *NUMBERS,
        k.row_hash(["series_id", "obs_period"]).alias("inputs_hash")))


def grades(t, until="2000-06-30"):
    p = predictions(t)
    empty = p.select("prediction_id").filter(F.lit(False))
    return lg.grade_matured(p, flows(t), empty, until)[0]


def publications(t):
    return predictions(t).filter("month(target_period) <> 7").select(
        "prediction_id", F.date_add("made_at", 1).alias("published_at"),
        F.col("made_at").alias("data_vintage"), F.lit("1").alias("methodology_version"))


view("flows", """
SELECT series_id, obs_period, d / 1e8 AS value, release_date,
       'https://data.example/flow/' || strftime(release_date, '%Y%m') AS source_url
FROM (SELECT *, value_cents - lag(value_cents) OVER (PARTITION BY series_id ORDER BY obs_period) AS d
      FROM monthly) WHERE d IS NOT NULL
""", "monthly")
view("flow_points", points_view("flows", False), "flows")
view("flow_baselines", long_view("flow_points"), "flow_points")
view("flow_metrics", METRICS_SQL.format(b="flow_baselines", h="flows", start=START),
     "flow_baselines flows")
view("preds", f"""
SELECT 'prd_' || {row_sha("model_version", "inputs_hash", "target_series", "target_period")}
  AS prediction_id, *
FROM (SELECT obs_period AS made_at, model AS model_version,
             {row_sha("series_id", "obs_period")} AS inputs_hash,
             series_id AS target_series, obs_period AS target_period, round(point, 9) AS point,
             round(point - w80, 9) AS low80, round(point + w80, 9) AS high80,
             round(point - w95, 9) AS low95, round(point + w95, 9) AS high95,
             'PENDING_FIRST_PRINT' AS status
      FROM (SELECT *, past[CAST(ceil(0.80::DOUBLE * (len(past) - 1)) AS BIGINT) + 1] AS w80,
                   past[CAST(ceil(0.95::DOUBLE * (len(past) - 1)) AS BIGINT) + 1] AS w95
            FROM (SELECT b.*, list_sort(coalesce(list(abs(b.point - h.value)) OVER (
                           PARTITION BY b.series_id, b.model ORDER BY b.obs_period
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS past
                  FROM flow_baselines b JOIN flows h USING (series_id, obs_period)
                  WHERE b.obs_period >= DATE '1997-01-31')
            WHERE len(past) >= 24))
""", "flow_baselines flows")
view("graded", """
SELECT p.prediction_id, f.value AS actual_first_print, f.source_url AS vintage_url,
       abs(p.point - f.value) AS abs_error, f.release_date AS graded_at, p.target_series,
       p.target_period
FROM preds p JOIN flows f ON p.target_series = f.series_id AND p.target_period = f.obs_period
""", "preds flows")
view("grades", "SELECT * FROM graded WHERE graded_at <= DATE '2000-06-30'", "graded")
view("pubs", """
SELECT prediction_id, CAST(made_at + 1 AS DATE) AS published_at, made_at AS data_vintage,
       '1' AS methodology_version FROM preds WHERE month(target_period) <> 7
""", "preds")
view("naive", """
SELECT series_id, arg_min(model, mae) AS model FROM flow_metrics GROUP BY 1
""", "flow_metrics")


@query("l01_to_predictions", "SELECT * FROM preds", "preds")
def _(t):
    return predictions(t)


@query("l02_check_predictions", """
SELECT 'nested' AS rule, count(*) AS checked_rows, count(*) FILTER (month(target_period) = 5)
         AS failed_rows FROM preds
UNION ALL SELECT 'month end', count(*), count(*) FILTER (month(target_period) = 6) FROM preds
""", "preds")
def _(t):
    p = predictions(t).withColumn("low80", F.when(
        F.month("target_period") == 5, F.col("high80") + 1).otherwise(F.col("low80")))
    return lg.check_predictions(p.withColumn("target_period", F.when(
        F.month("target_period") == 6, F.date_sub("target_period", 1)).otherwise(
        F.col("target_period"))))


@query("l03_append_predictions", """
SELECT prediction_id, CASE WHEN target_period > DATE '2000-06-30' THEN 'append'
       WHEN month(target_period) = 3 THEN 'conflict' ELSE 'present' END AS outcome FROM preds
""", "preds")
def _(t):
    p = predictions(t)
    stored = p.filter("target_period <= date'2000-06-30'").withColumn("point", F.when(
        F.month("target_period") == 3, F.col("point") + 1).otherwise(F.col("point")))
    again = p.withColumn("made_at", F.date_add("made_at", 2))
    return lg.append_predictions(again, stored).select("prediction_id", "outcome")


def repeating_flows(t):
    """The flows, with the first prints of September 2000 there twice."""
    again = flows(t).filter("obs_period = '2000-09-30'").withColumn("value", F.col("value") + 1)
    return flows(t).unionByName(again)


@query("l04_grade_matured", """
SELECT prediction_id, actual_first_print, vintage_url, round(abs_error, 9) AS abs_error, graded_at
FROM graded WHERE graded_at > DATE '2000-06-30' AND graded_at <= DATE '2001-03-31'
  AND target_period <> DATE '2000-09-30'
""", "graded")
def _(t):
    new, _ = lg.grade_matured(predictions(t), repeating_flows(t), grades(t), "2001-03-31")
    return rounded(new, ["abs_error"], 9)


@query("l04_grade_counts", """
SELECT count(*) FILTER (open) AS attempted,
  count(*) FILTER (open AND target_period <> DATE '2000-09-30') AS appended,
  count(*) FILTER (graded_at <= DATE '2000-06-30') AS already_present,
  count(*) FILTER (graded_at > DATE '2001-03-31') AS not_matured, 0::BIGINT AS invalid,
  count(*) FILTER (open AND target_period = DATE '2000-09-30') AS repeated_target
FROM (SELECT *, graded_at > DATE '2000-06-30' AND graded_at <= DATE '2001-03-31' AS open FROM graded)
""", "graded")
def _(t):
    return lg.grade_matured(predictions(t), repeating_flows(t), grades(t), "2001-03-31")[1]


@query("l05_verify_regrade", """
SELECT prediction_id, CASE month(target_period) WHEN 1 THEN 'value differs'
       ELSE 'vintage differs' END AS problem FROM grades WHERE month(target_period) IN (1, 2)
""", "grades")
def _(t):
    p = predictions(t)
    g = grades(t).join(p.select("prediction_id", F.month("target_period").alias("m")),
                       "prediction_id")
    g = g.withColumn("actual_first_print", F.when(F.col("m") == 1, F.col("actual_first_print") + 1)
                     .otherwise(F.col("actual_first_print")))
    g = g.withColumn("vintage_url", F.when(F.col("m") == 2, F.lit("x")).otherwise(
        F.col("vintage_url"))).drop("m")
    return lg.verify_regrade(p, g, flows(t))


@query("l06_append_publications", """
SELECT * FROM pubs WHERE month(data_vintage) > 6
""", "pubs")
def _(t):
    pubs = publications(t)
    stored = pubs.filter("month(data_vintage) <= 6")
    later = pubs.withColumn("published_at", F.date_add("published_at", 9))
    return lg.append_publications(pubs.unionByName(later), stored)


@query("l06_check_publications", """
SELECT 'vintage before publication' AS rule, count(*) AS checked_rows,
       count(*) FILTER (month(data_vintage) = 8) AS failed_rows FROM pubs
""", "pubs")
def _(t):
    pubs = publications(t).withColumn("data_vintage", F.when(
        F.month("data_vintage") == 8, F.date_add("published_at", 1)).otherwise(
        F.col("data_vintage")))
    return lg.check_publications(pubs, predictions(t))


BOARD = """
SELECT p.prediction_id, p.target_series, p.target_period, p.point, g.actual_first_print,
       CASE WHEN g.graded_at IS NULL THEN 'PENDING_FIRST_PRINT' ELSE 'GRADED' END AS status,
       u.published_at, 'live' AS publication_mode
FROM preds p LEFT JOIN grades g USING (prediction_id) LEFT JOIN pubs u USING (prediction_id)
"""
BOARD_COLS = ["prediction_id", "target_series", "target_period", "point", "actual_first_print",
              "status", "published_at", "publication_mode"]


def board(t):
    return lg.scoreboard(predictions(t), grades(t), publications(t))


@query("l07_scoreboard", BOARD, "preds grades pubs")
def _(t):
    return board(t).select(*BOARD_COLS)


@query("l08_grading_job", """
SELECT count(*) FILTER (graded_at > DATE '2000-06-30' AND graded_at <= DATE '2001-03-31') AS attempted,
  count(*) FILTER (graded_at > DATE '2000-06-30' AND graded_at <= DATE '2001-03-31') AS appended,
  count(*) FILTER (graded_at <= DATE '2000-06-30') AS already_present,
  count(*) FILTER (graded_at > DATE '2001-03-31') AS not_matured, 0::BIGINT AS invalid,
  0::BIGINT AS repeated_target,
  max(graded_at) FILTER (graded_at <= DATE '2001-03-31') AS latest_graded_at FROM graded
""", "graded")
def _(t):
    f = flows(t)
    halves = [f.filter("series_id < '3'"), f.filter("series_id >= '3'")]
    return lg.grading_job(predictions(t), grades(t), halves, "2001-03-31")[1]


def change_log(t):
    return t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("change_id")).agg(
        F.max(F.to_date("o_orderdate")).alias("changed_at"),
        F.concat(F.lit("orders "), F.count(F.lit(1)).cast("string")).alias("title"))


@query("l09_event_feed", """
SELECT 'prediction:' || prediction_id AS event_id, 'prediction' AS event_type,
       made_at AS occurred_at, target_series || ' ' || CAST(target_period AS VARCHAR) AS title
FROM preds UNION ALL
SELECT 'grade:' || prediction_id, 'grade', graded_at, prediction_id FROM grades UNION ALL
SELECT 'change:' || year(o_orderdate), 'change', CAST(max(o_orderdate) AS DATE),
       'orders ' || count(*) FROM orders GROUP BY year(o_orderdate)
""", "preds grades")
def _(t):
    return lg.event_feed(predictions(t), grades(t), change_log(t))


@query("l10_changelog_check", """
SELECT year(o_orderdate) AS change_id, CASE WHEN year(o_orderdate) = 1996 THEN 'baseline changed'
       ELSE 'out of order' END AS problem FROM orders
WHERE year(o_orderdate) IN (1996, 1999) GROUP BY 1
""")
def _(t):
    log = change_log(t)
    new = log.withColumn("changed_at", F.when(
        F.col("change_id") == 1999, F.lit("1995-06-01").cast("date")).otherwise(
        F.col("changed_at"))).withColumn("at", F.col("change_id"))
    old = log.filter("change_id < 1998").select("change_id", "title").withColumn(
        "title", F.when(F.col("change_id") == 1996, "other").otherwise(F.col("title")))
    return lg.changelog_check(new, old, "change_id", "at", "changed_at")


@query("l11_resolve_refreshes", """
SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'runtime' ELSE 'committed' END AS origin
FROM orders
""")
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice", F.lit("committed").alias("origin"))
    run = o.filter("o_totalprice > 250000").withColumn("origin", F.lit("runtime"))
    return lg.resolve_refreshes(o, run, ["o_orderkey"]).select("o_orderkey", "origin")


# ---- live calibration -----------------------------------------------------------------------

def naive(t):
    scores = ev.evaluate(fc.expanding_baselines(flows(t)), flows(t), START)
    return fc.select_benchmark(scores)


CALIBRATED = """
SELECT g.target_series AS series_id, g.prediction_id, g.target_period,
       g.actual_first_print BETWEEN p.low80 AND p.high80 AS inside80,
       g.actual_first_print BETWEEN p.low95 AND p.high95 AS inside95,
       g.abs_error, n.model AS naive_model, q.point AS naive_point,
       abs(q.point - g.actual_first_print) AS naive_abs_error
FROM grades g JOIN preds p USING (prediction_id) JOIN naive n ON n.series_id = g.target_series
LEFT JOIN calibration_points q ON q.series_id = g.target_series
 AND q.target_period = g.target_period AND q.model = n.model
"""
view("calibration_points", """
SELECT series_id, target_period, 'random_walk' AS model, max_by(value, obs_period) AS point
FROM calibration_known GROUP BY ALL UNION ALL
SELECT series_id, target_period, 'seasonal_naive', max(value) FILTER (
  target_period = last_day(CAST(obs_period + INTERVAL 12 MONTH AS DATE)))
FROM calibration_known GROUP BY ALL UNION ALL
SELECT series_id, target_period, 'ar2',
  my - b1 * ma - b2 * mb + b1 * p1 + b2 * p2 FROM (
  SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS b1,
         (sby * saa - say * sab) / (saa * sbb - sab * sab) AS b2 FROM (
    SELECT series_id, target_period, max_by(value, obs_period) AS p1, max_by(a, obs_period) AS p2,
           covar_pop(a, a) FILTER (ok) AS saa, covar_pop(b, b) FILTER (ok) AS sbb,
           covar_pop(a, b) FILTER (ok) AS sab, covar_pop(a, value) FILTER (ok) AS say,
           covar_pop(b, value) FILTER (ok) AS sby, avg(a) FILTER (ok) AS ma,
           avg(b) FILTER (ok) AS mb, avg(value) FILTER (ok) AS my
    FROM calibration_known GROUP BY ALL))
""", "calibration_known")
view("calibration_known", """
SELECT t.series_id, t.target_period, h.obs_period, h.value, h.a, h.b,
       h.a IS NOT NULL AND h.b IS NOT NULL AS ok
FROM (SELECT DISTINCT target_series AS series_id, target_period, made_at FROM preds) t
JOIN (SELECT series_id, obs_period, release_date, value,
             lag(value) OVER (PARTITION BY series_id ORDER BY obs_period) AS a,
             lag(value, 2) OVER (PARTITION BY series_id ORDER BY obs_period) AS b FROM flows) h
  ON h.series_id = t.series_id AND h.obs_period < t.target_period AND h.release_date <= t.made_at
""", "preds flows")
view("calibrated", CALIBRATED, "grades preds naive calibration_points")


def calibrated(t):
    return ev.live_calibration(predictions(t), grades(t), flows(t), naive(t))


@query("e07_live_calibration", """
SELECT series_id, prediction_id, target_period, inside80, inside95, round(abs_error, 6) AS abs_error,
       naive_model, round(naive_point, 5) AS naive_point,
       round(naive_abs_error, 5) AS naive_abs_error, CAST(NULL AS VARCHAR) AS problem FROM calibrated
""", "calibrated")
def _(t):
    out = rounded(calibrated(t), ["naive_point", "naive_abs_error"], 5)
    return rounded(out, ["abs_error"], 6)


@query("e07_calibration_problems", """
SELECT prediction_id, CASE month(target_period) WHEN 1 THEN 'prediction repeated'
  WHEN 2 THEN 'first print repeated' WHEN 3 THEN 'vintage differs' WHEN 4 THEN 'first print differs'
  WHEN 5 THEN 'error differs' WHEN 6 THEN 'no prediction' END AS problem
FROM grades WHERE month(target_period) <= 6
""", "grades")
def _(t):
    # A fault on purpose in the rows of every month from January to June.
    month, p, g = F.month("target_period"), predictions(t), t.once("grades", lambda: grades(t))
    p = p.filter(month != 6).unionByName(p.filter(month == 1))
    periods = predictions(t).select("prediction_id", "target_period")
    g = g.join(periods, "prediction_id").withColumns({
        "vintage_url": F.when(month == 3, "https://data.example/other").otherwise(F.col("vintage_url")),
        "actual_first_print": F.col("actual_first_print") + F.when(month == 4, 1.0).otherwise(0.0),
        "abs_error": F.col("abs_error") + F.when(month == 5, 1.0).otherwise(0.0)}).drop("target_period")
    h = flows(t).unionByName(flows(t).filter(F.month("obs_period") == 2).withColumn(
        "release_date", F.date_add("release_date", 9)))
    return ev.live_calibration(p, g, h, naive(t)).filter("problem is not null").select(
        "prediction_id", "problem")


@query("e08_calibration_by_series", """
SELECT s.series_id, count(prediction_id) AS graded_count,
       count(*) FILTER (inside80) AS inside80_count, count(*) FILTER (inside95) AS inside95_count,
       round(avg(CASE WHEN inside80 THEN 1.0 WHEN NOT inside80 THEN 0 END), 6) AS coverage80,
       round(avg(CASE WHEN inside95 THEN 1.0 WHEN NOT inside95 THEN 0 END), 6) AS coverage95,
       round(avg(abs_error), 5) AS mae, round(avg(naive_abs_error), 5) AS naive_mae,
       round(avg(abs_error) - avg(naive_abs_error), 5) AS mae_difference
FROM (SELECT DISTINCT series_id FROM flows UNION ALL SELECT '6-NONE') s
LEFT JOIN calibrated c ON c.series_id = s.series_id
GROUP BY 1
""", "calibrated flows")
def _(t):
    # A series without any grade is added, as every given one has some.
    series = flows(t).select("series_id")
    out = ev.calibration_by_series(calibrated(t), series.unionByName(series.filter(
        "series_id = '5-LOW'").select(F.lit("6-NONE").alias("series_id"))))
    out = rounded(out, ["coverage80", "coverage95"], 6)
    return rounded(out, ["mae", "naive_mae", "mae_difference"], 5)


@query("e10_first_miss_callout", """
WITH f AS (SELECT p.*, g.actual_first_print, g.abs_error, row_number() OVER (
             PARTITION BY p.target_series ORDER BY p.made_at, p.prediction_id) AS rn
           FROM preds p JOIN grades g USING (prediction_id))
SELECT f.target_series, f.target_period, f.prediction_id, f.model_version, f.point, f.low80,
       f.high80, f.actual_first_print, round(f.abs_error, 6) AS abs_error,
       round(m.mae, 5) AS backtest_mae
FROM f LEFT JOIN flow_metrics m ON m.series_id = f.target_series AND m.model = f.model_version
WHERE rn = 1 AND point * actual_first_print < 0 AND NOT actual_first_print BETWEEN low80 AND high80
""", "preds grades flow_metrics")
def _(t):
    scores = ev.evaluate(fc.expanding_baselines(flows(t)), flows(t), START)
    out = ev.first_miss_callout(predictions(t), grades(t), scores)
    return rounded(rounded(out, ["backtest_mae"], 5), ["abs_error"], 6)


@query("e11_scoreboard_summary", """
SELECT count(*) AS prediction_count, count(g.graded_at) AS graded_count,
       count(*) - count(g.graded_at) AS pending_count, round(avg(g.abs_error), 6) AS mae,
       round(avg(CASE WHEN g.actual_first_print BETWEEN p.low80 AND p.high80 THEN 1.0
                      WHEN g.graded_at IS NOT NULL THEN 0 END), 6) AS coverage80
FROM preds p LEFT JOIN grades g USING (prediction_id)
""", "preds grades")
def _(t):
    return rounded(ev.scoreboard_summary(predictions(t), grades(t)), ["mae", "coverage80"])


# ---- serving --------------------------------------------------------------------------------

@query("v01_latest_per_series", """
SELECT target_series, target_period, model_version, made_at, point FROM (
  SELECT *, row_number() OVER (PARTITION BY target_series ORDER BY made_at DESC, prediction_id) AS rn
  FROM preds) WHERE rn = 1
""", "preds")
def _(t):
    return sv.latest_per_series(predictions(t), "target_series", "made_at", "prediction_id").select(
        "target_series", "target_period", "model_version", "made_at", "point")


@query("v02_tail", """
SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000
""")
def _(t):
    return sv.tail(t.events.select("event_id", "ts", "user_id"), ["ts", "event_id"], 1000)


@query("v03_lookup", """
SELECT c_custkey, c_name, true AS found FROM customer WHERE upper(c_name) = 'CUSTOMER#000000042'
UNION ALL SELECT NULL, 'customer#999999999', false
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE upper(c_name) = 'CUSTOMER#999999999')
""")
def _(t):
    a = sv.lookup(t.customer.select("c_custkey", "c_name"), "c_name", "customer#000000042")
    b = sv.lookup(t.customer.select("c_custkey", "c_name"), "c_name", "customer#999999999")
    return a.unionByName(b)


@query("v04_list_feed", f"SELECT target_series, count(*) AS listed, count(actual_first_print) AS graded "
       f"FROM ({BOARD}) GROUP BY 1", "preds grades pubs")
def _(t):
    feed = sv.list_feed(board(t), ["target_series", "actual_first_print"])
    return feed.groupBy("target_series").agg(
        F.count(F.lit(1)).alias("listed"), F.count("actual_first_print").alias("graded"))
