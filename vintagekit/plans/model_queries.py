"""Queries for features, forecasts and their evaluation."""

from pyspark.sql import functions as F

from vintagekit.operators import bridge as br
from vintagekit.operators import evaluate as ev
from vintagekit.operators import features as feat
from vintagekit.operators import forecast as fc
from vintagekit.plans.registry import query, row_sha, row_text, view

NAIVE = (fc.RANDOM_WALK, fc.SEASONAL, fc.AR2)


def rounded(df, cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


# ---- features -------------------------------------------------------------------------------

view("weekly_all", "SELECT * FROM weekly WHERE release_date = obs_period + 16", "weekly")


def weekly_all(t):
    return t.stored("weekly").filter("release_date = date_add(obs_period, 16)")


@query("f01_period_change", """
SELECT a.series_id, a.obs_period, a.value_cents, b.value_cents AS previous_value,
       a.value_cents - b.value_cents AS change
FROM weekly_all a LEFT JOIN weekly_all b ON a.series_id = b.series_id
 AND a.obs_period = CAST(b.obs_period + 7 AS DATE)
""", "weekly_all")
def _(t):
    rows = weekly_all(t).select("series_id", "obs_period", "value_cents")
    return feat.period_change(rows, "series_id", "obs_period", "value_cents")


@query("f02_expected_slots", """
SELECT m.series_id, m.target_period, CAST(d AS DATE) AS slot FROM targets m
CROSS JOIN range(0, 31) r(i)
CROSS JOIN LATERAL (SELECT CAST(date_trunc('month', m.target_period) AS DATE) + CAST(i AS INTEGER) AS d)
WHERE isodow(d) = 3 AND d <= m.target_period
""", "targets")
def _(t):
    return feat.expected_slots(t.targets.select("series_id", "target_period"), "target_period")


@query("f03_coverage_and_pace", """
WITH c AS (SELECT a.series_id, a.obs_period AS slot, a.value_cents - b.value_cents AS change
           FROM weekly_all a JOIN weekly_all b ON a.series_id = b.series_id
            AND a.obs_period = CAST(b.obs_period + 7 AS DATE) WHERE day(a.obs_period) <= 21),
s AS (SELECT m.series_id, m.target_period, CAST(date_trunc('month', m.target_period) AS DATE)
             + CAST(i AS INTEGER) AS slot FROM targets m CROSS JOIN range(0, 31) r(i)
      WHERE isodow(CAST(date_trunc('month', m.target_period) AS DATE) + CAST(i AS INTEGER)) = 3
        AND CAST(date_trunc('month', m.target_period) AS DATE) + CAST(i AS INTEGER)
            <= m.target_period)
SELECT s.series_id, s.target_period, CAST(coalesce(sum(change), 0) AS DOUBLE) AS change_sum,
       count(change) AS weeks_observed, count(*) AS weeks_expected,
       round(count(change) / count(*), 6) AS coverage,
       round(sum(change) / (count(change) / count(*)), 2) AS paced_change
FROM s LEFT JOIN c ON s.series_id = c.series_id AND s.slot = c.slot GROUP BY ALL
""", "targets weekly_all")
def _(t):
    rows = weekly_all(t).select("series_id", "obs_period", "value_cents")
    changes = feat.period_change(rows, "series_id", "obs_period", "value_cents").filter(
        "day(obs_period) <= 21").select(
        "series_id", F.col("obs_period").alias("slot"), "change")
    slots = feat.expected_slots(t.targets.select("series_id", "target_period"), "target_period")
    out = feat.coverage_and_pace(changes, slots, ["series_id", "target_period"])
    return out.withColumns({"coverage": F.round("coverage", 6),
                            "paced_change": F.round("paced_change", 2)})


FEATURE_VIEW = """
SELECT q.series_id, q.target_period, q.origin,
       (SELECT max(w.release_date) FROM weekly w
        WHERE w.series_id = q.series_id AND w.release_date <= q.origin) AS latest_release,
       (SELECT max(w.obs_period) FROM weekly w
        WHERE w.series_id = q.series_id AND w.release_date <= q.origin) AS latest_observation,
       x.change_cents, x.weeks_observed, x.weeks_expected, x.missing_predecessors, x.weekly_changes,
       f.value_cents AS flow_cents, f.release_date AS monthly_release, sha256(coalesce((
         SELECT string_agg({text}, '' ORDER BY e.obs_period) FROM known e
         WHERE e.series_id = q.series_id AND e.origin = q.origin AND isodow(e.obs_period) = 3
           AND e.obs_period BETWEEN CAST(date_trunc('month', q.target_period) + INTERVAL
             ((10 - isodow(date_trunc('month', q.target_period))) % 7 - 7) DAY AS DATE) AND q.target_period
       ), '')) AS weekly_hash
FROM asked q
JOIN (SELECT s.series_id, s.target_period, s.origin, count(*) AS weeks_expected,
             count(a.v) AS weeks_observed, coalesce(sum(a.v - b.v), 0) AS change_cents,
             count(*) FILTER (a.v IS NOT NULL AND b.v IS NULL) AS missing_predecessors,
             coalesce(string_agg(CAST(s.d AS VARCHAR) || '=' || coalesce(CAST(a.v - b.v AS VARCHAR), '?'),
               ' ' ORDER BY s.d) FILTER (a.v IS NOT NULL), '') AS weekly_changes
      FROM (SELECT asked.*, CAST(date_trunc('month', target_period) AS DATE) + CAST(i AS INTEGER)
                   AS d FROM asked CROSS JOIN range(0, 31) r(i)) s
      LEFT JOIN known a ON a.series_id = s.series_id AND a.origin = s.origin AND a.obs_period = s.d
      LEFT JOIN known b ON b.series_id = s.series_id AND b.origin = s.origin
                       AND b.obs_period = CAST(s.d - 7 AS DATE)
      WHERE isodow(s.d) = 3 AND s.d <= s.target_period GROUP BY ALL) x
  ON x.series_id = q.series_id AND x.target_period = q.target_period AND x.origin = q.origin
LEFT JOIN monthly_flow f ON f.series_id = q.series_id AND f.obs_period = q.target_period
                        AND f.release_date <= q.origin
""".format(text=row_text("e.obs_period", "e.r", "e.c"))
KNOWN_VIEW = """
SELECT o.series_id, o.origin, w.obs_period, max_by(w.value_cents, w.release_date) AS v,
       max(w.release_date) AS r, max_by(w.checksum, w.release_date) AS c
FROM (SELECT DISTINCT series_id, origin FROM asked) o JOIN weekly w
  ON w.series_id = o.series_id AND w.release_date <= o.origin
 AND w.obs_period >= CAST(o.origin - 95 AS DATE) GROUP BY ALL
"""
view("asked", """
SELECT t.series_id, t.target_period, max(w.release_date) AS origin FROM targets t
JOIN (SELECT DISTINCT series_id, release_date FROM weekly) w
  ON w.series_id = t.series_id AND w.release_date < t.release_at GROUP BY ALL
""", "targets weekly")
view("known", KNOWN_VIEW, "asked weekly")
view("features", FEATURE_VIEW, "asked known weekly monthly_flow")

FEATURE_SQL = """
SELECT series_id, target_period, origin, latest_release, latest_observation,
       round(change_cents / 1e8, 8) AS change_sum, CAST(weeks_observed AS INTEGER) AS weeks_observed,
       CAST(weeks_expected AS INTEGER) AS weeks_expected,
       round(weeks_observed / weeks_expected, 6) AS coverage,
       CASE WHEN weeks_observed > 0
            THEN round(change_cents / 1e8 / (weeks_observed / weeks_expected), 10) END AS paced_change,
       round(flow_cents / 1e8, 8) AS monthly_change, monthly_release,
       CAST(missing_predecessors AS INTEGER) AS missing_predecessors, weekly_changes,
       {hash} AS inputs_hash
FROM features
""".format(hash=row_sha("series_id", "target_period", "origin", "weekly_hash", "monthly_release",
                        "CAST(round(flow_cents / 1e8, 9) AS DECIMAL(38, 9))"))


def shown_features(df):
    df = rounded(rounded(df, ["coverage"]), ["change_sum", "monthly_change"], 8)
    changes = F.transform("weekly_changes", lambda c: F.concat(
        c["obs_period"].cast("string"), F.lit("="),
        F.coalesce(F.round(c["change"] * 1e8).cast("bigint").cast("string"), F.lit("?"))))
    return rounded(df, ["paced_change"], 10).withColumn("weekly_changes", F.array_join(changes, " "))


@query("f04_ragged_edge_feature", FEATURE_SQL.replace("features", "mid_features"), "mid_features")
def _(t):
    at = t.targets.select("series_id", "target_period",
                          F.date_sub("target_period", 5).alias("origin"))
    return shown_features(feat.ragged_edge_feature(at, t.stored("weekly"), t.monthly_flow))


view("mid_asked", """
SELECT series_id, target_period, CAST(target_period - 5 AS DATE) AS origin FROM targets
""", "targets")
view("mid_known", KNOWN_VIEW.replace("asked", "mid_asked"), "mid_asked weekly")
view("mid_features", FEATURE_VIEW.replace("asked", "mid_asked").replace("known", "mid_known"),
     "mid_asked mid_known weekly monthly_flow")


def history(t):
    return feat.historical_features(t.targets, t.stored("weekly"), t.monthly_flow)


@query("f05_historical_features", FEATURE_SQL, "features")
def _(t):
    return shown_features(history(t))


def scaled(t):
    return feat.window_scale(history(t), "series_id", "target_period",
                             ["paced_change", "monthly_change"])


view("feature_values", """
SELECT series_id, target_period, weeks_observed / weeks_expected AS coverage,
       CASE WHEN weeks_observed > 0
            THEN change_cents / 1e8 / (weeks_observed / weeks_expected) END AS paced_change,
       flow_cents / 1e8 AS monthly_change FROM features
""", "features")
view("feature_scale", """
SELECT *, coalesce(avg(paced_change) OVER w, 0) AS pm,
       CASE WHEN stddev_pop(paced_change) OVER w > 1e-12 THEN stddev_pop(paced_change) OVER w
            ELSE 1 END AS ps,
       coalesce(avg(monthly_change) OVER w, 0) AS mm,
       CASE WHEN stddev_pop(monthly_change) OVER w > 1e-12 THEN stddev_pop(monthly_change) OVER w
            ELSE 1 END AS ms
FROM feature_values WINDOW w AS (PARTITION BY series_id ORDER BY target_period
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""", "feature_values")


@query("f06_window_scale", """
SELECT series_id, target_period, round(pm, 6) AS paced_change_mean, round(ps, 6) AS paced_change_std,
       round(mm, 6) AS monthly_change_mean, round(ms, 6) AS monthly_change_std FROM feature_scale
""", "feature_scale")
def _(t):
    cols = ["paced_change_mean", "paced_change_std", "monthly_change_mean", "monthly_change_std"]
    return rounded(scaled(t).select("series_id", "target_period", *cols), cols)


@query("f07_design_row", """
SELECT series_id, target_period, 16 AS width,
       round(coalesce((paced_change - pm) / ps, 0), 5) AS paced,
       round(coverage, 6) AS coverage, round(coalesce((monthly_change - mm) / ms, 0), 5) AS flow,
       CASE WHEN monthly_change IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS has_flow,
       CASE WHEN month(target_period) = 1 THEN 0 ELSE month(target_period) + 4 END AS dummy_at
FROM feature_scale
""", "feature_scale")
def _(t):
    d = feat.design_row(scaled(t))
    x = F.col("design")
    return d.select(
        "series_id", "target_period", F.size(x).alias("width"), F.round(x[1], 5).alias("paced"),
        F.round(x[2], 6).alias("coverage"), F.round(x[3], 5).alias("flow"), x[4].alias("has_flow"),
        F.when(F.month("target_period") == 1, 0).otherwise(
            F.array_position(F.slice(x, 6, 11), 1.0) + 5).cast("bigint").alias("dummy_at"))


# ---- forecasts ------------------------------------------------------------------------------

def points_view(source: str, gap_aware: bool) -> str:
    """Baselines over a history in SQL: lags by month number, running centred moments."""
    enough = "n >= 24" if gap_aware else "months >= 24"
    return f"""
SELECT series_id, obs_period, value, random_walk, seasonal_naive, months, n,
  CASE WHEN {enough} AND n >= 3 AND saa * sbb - sab * sab > saa * sbb * 1e-12 THEN
    y0 + (sy - (say * sbb - sby * sab) / (saa * sbb - sab * sab) * sa
             - (sby * saa - say * sab) / (saa * sbb - sab * sab) * sb) / n
       + (say * sbb - sby * sab) / (saa * sbb - sab * sab) * a
       + (sby * saa - say * sab) / (saa * sbb - sab * sab) * b END AS ar2
FROM (
  SELECT *, raa - sa * sa / n AS saa, rbb - sb * sb / n AS sbb, rab - sa * sb / n AS sab,
         ray - sa * sy / n AS say, rby - sb * sy / n AS sby FROM (
    SELECT series_id, obs_period, value, random_walk, seasonal_naive, months, y0, a, b,
      count(*) FILTER (ok) OVER w AS n,
      sum(a) FILTER (ok) OVER w AS sa, sum(b) FILTER (ok) OVER w AS sb,
      sum(y) FILTER (ok) OVER w AS sy, sum(a * a) FILTER (ok) OVER w AS raa,
      sum(b * b) FILTER (ok) OVER w AS rbb, sum(a * b) FILTER (ok) OVER w AS rab,
      sum(a * y) FILTER (ok) OVER w AS ray, sum(b * y) FILTER (ok) OVER w AS rby
    FROM (
      SELECT series_id, obs_period, value, random_walk, seasonal_naive, months, y0,
             value - y0 AS y, a - y0 AS a, b - y0 AS b,
             value IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AS ok
      FROM (
        SELECT h.series_id, h.obs_period, h.value, x.value AS a, z.value AS b,
               s.value AS seasonal_naive,
               lag(h.value) OVER o AS random_walk, row_number() OVER o - 1 AS months,
               first(h.value) OVER o AS y0
        FROM {source} h
        LEFT JOIN {source} x ON x.series_id = h.series_id
          AND h.obs_period = last_day(CAST(x.obs_period + INTERVAL 1 MONTH AS DATE))
        LEFT JOIN {source} z ON z.series_id = h.series_id
          AND h.obs_period = last_day(CAST(z.obs_period + INTERVAL 2 MONTH AS DATE))
        LEFT JOIN {source} s ON s.series_id = h.series_id
          AND h.obs_period = last_day(CAST(s.obs_period + INTERVAL 12 MONTH AS DATE))
        WINDOW o AS (PARTITION BY h.series_id ORDER BY h.obs_period)))
    WINDOW w AS (PARTITION BY series_id ORDER BY obs_period
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
"""


view("points", points_view("monthly", False), "monthly")
view("gappy", "SELECT * FROM monthly WHERE month(obs_period) <> 9 OR year(obs_period) > 1998",
     "monthly")
view("gap_points", points_view("gappy", True), "gappy")
view("print_points", points_view("first_prints", False), "first_prints")


def long_view(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT series_id, obs_period, '{m}' AS model, {m} AS point FROM {source} "
        f"WHERE {m} IS NOT NULL" for m in NAIVE)


view("baselines", long_view("points"), "points")
view("gap_baselines", long_view("gap_points"), "gap_points")
view("print_baselines", long_view("print_points"), "print_points")


def gappy(t):
    return t.stored("monthly").filter("month(obs_period) <> 9 or year(obs_period) > 1998")


for name, model, maker in (
    ("m01_random_walk", "random_walk", fc.random_walk),
    ("m02_seasonal_naive", "seasonal_naive", fc.seasonal_naive),
    ("m03_ar2", "ar2", fc.ar2),
):
    query(name, f"SELECT series_id, obs_period, model, round(point, 5) AS point FROM baselines "
                f"WHERE model = '{model}'", "baselines")(
        lambda t, maker=maker: rounded(maker(t.monthly), ["point"], 5))


@query("m04_ar2_gap_aware", "SELECT series_id, obs_period, model, round(point, 5) AS point "
       "FROM gap_baselines WHERE model = 'ar2'", "gap_baselines")
def _(t):
    return rounded(fc.ar2_gap_aware(gappy(t)), ["point"], 5)


@query("m05_expanding_baselines", "SELECT series_id, obs_period, model, round(point, 5) AS point "
       "FROM print_baselines WHERE obs_period >= DATE '1996-06-30'", "print_baselines")
def _(t):
    return rounded(fc.expanding_baselines(t.first_prints, "1996-06-30"), ["point"], 5)


def bridge_rows(t):
    values = t.targets.select("series_id", "target_period", "value")
    return history(t).join(values, ["series_id", "target_period"])


view("bridge_train", """
SELECT f.series_id, f.target_period, t.value AS y, month(f.target_period) AS m,
       change_cents / 1e8 / (weeks_observed / weeks_expected) AS p,
       weeks_observed / weeks_expected AS c, flow_cents / 1e8 AS w
FROM features f JOIN targets t USING (series_id, target_period)
""", "features targets")
view("bridge_scale", """
SELECT o.series_id, o.target_period, count(*) AS n, coalesce(avg(t.p), 0) AS pm,
       coalesce(avg(t.w), 0) AS wm,
       CASE WHEN stddev_pop(t.p) > 1e-12 THEN stddev_pop(t.p) ELSE 1 END AS ps,
       CASE WHEN stddev_pop(t.w) > 1e-12 THEN stddev_pop(t.w) ELSE 1 END AS ws, avg(t.y) AS ym
FROM bridge_train o JOIN bridge_train t
  ON t.series_id = o.series_id AND t.target_period < o.target_period GROUP BY ALL HAVING count(*) >= 36
""", "bridge_train")
DESIGN = """[1.0::DOUBLE, coalesce(({t}.p - s.pm) / s.ps, 0), {t}.c, coalesce(({t}.w - s.wm) / s.ws, 0),
  CASE WHEN {t}.w IS NULL THEN 0.0 ELSE 1.0 END] || list_transform(range(2, 13),
  lambda k: CASE WHEN {t}.m = k THEN 1.0::DOUBLE ELSE 0.0 END)"""
view("bridge_rows", f"""
SELECT s.series_id, s.target_period, s.n, s.ym, t.y - s.ym AS y, {DESIGN.format(t="t")} AS x,
       {DESIGN.format(t="o")} AS a
FROM bridge_scale s
JOIN bridge_train o ON o.series_id = s.series_id AND o.target_period = s.target_period
JOIN bridge_train t ON t.series_id = s.series_id AND t.target_period < s.target_period
""", "bridge_scale bridge_train")
view("bridge_cells", """
SELECT series_id, target_period, i, j, sum(x[i] * x[j]) AS g, sum(x[i] * y) AS xy, any_value(a[i]) AS a
FROM bridge_rows CROSS JOIN range(1, 17) r(i) CROSS JOIN range(1, 17) q(j) GROUP BY ALL
""", "bridge_rows")
view("bridge_system", """
SELECT series_id, target_period, list(g ORDER BY i) AS g, list(r ORDER BY i) AS m FROM (
  SELECT series_id, target_period, i, list(g ORDER BY j) AS g,
    list(g + CASE WHEN i = j AND i > 1 THEN 10.0 ELSE 0.0 END ORDER BY j)
      || [any_value(xy), any_value(a)] AS r
  FROM bridge_cells GROUP BY ALL) GROUP BY ALL
""", "bridge_cells")


@query("m06_ridge_bridge", """
WITH RECURSIVE el AS (
  SELECT series_id, target_period, 1 AS k, g, m, list_transform(range(1, 17), lambda i: g[i][i]) AS d
  FROM bridge_system UNION ALL
  SELECT series_id, target_period, k + 1,
    CASE WHEN g[k][k] <= d[k] * 1e-11 THEN g ELSE list_transform(range(1, 17), lambda i:
      CASE WHEN i <= k THEN g[i]
      ELSE list_transform(range(1, 17), lambda j: g[i][j] - g[i][k] / g[k][k] * g[k][j]) END) END,
    list_transform(range(1, 17), lambda i: list_transform(range(1, 19), lambda j:
      CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)), d
  FROM el WHERE k <= 16),
b AS (SELECT series_id, target_period, list_transform(range(1, 17), lambda i: m[i][17]) AS beta,
        list_transform(range(1, 17), lambda i: m[i][18]) AS back,
        len(list_filter(range(1, 17), lambda i: g[i][i] > d[i] * 1e-11)) AS rank FROM el WHERE k = 17),
f AS (SELECT series_id, target_period, any_value(n) AS n, any_value(ym) + list_inner_product(
        any_value(a), any_value(beta)) AS point,
        sum((y - list_inner_product(x, beta)) ** 2) / greatest(any_value(n) - any_value(rank), 1)
          * (1 + list_inner_product(any_value(a), any_value(back))) AS v
      FROM bridge_rows JOIN b USING (series_id, target_period) GROUP BY ALL)
SELECT series_id, target_period, 'ridge_bridge' AS model, CAST(n AS INTEGER) AS training_months,
       round(point, 4) AS point, round(point - 1.2815515655446004 * sqrt(v), 4) AS low80,
       round(point + 1.2815515655446004 * sqrt(v), 4) AS high80,
       round(point - 1.959963984540054 * sqrt(v), 4) AS low95,
       round(point + 1.959963984540054 * sqrt(v), 4) AS high95, 64 AS hash_length FROM f
""", "bridge_rows bridge_system")
def _(t):
    out = fc.ridge_bridge(bridge_rows(t)).withColumn("hash_length", F.length("inputs_hash"))
    return rounded(out, ["point", "low80", "high80", "low95", "high95"], 4).drop("inputs_hash")


@query("m06_bridge_violations", """
SELECT 'feature after release' AS rule, series_id, target_period FROM features WHERE month(target_period) = 2
UNION ALL SELECT 'coverage', series_id, target_period FROM features WHERE month(target_period) = 3
UNION ALL SELECT 'feature hash', series_id, target_period FROM features WHERE month(target_period) = 4
UNION ALL SELECT 'period twice', series_id, target_period FROM features WHERE month(target_period) = 5
""", "features")
def _(t):
    # A fault on purpose in the features of four months.
    month = F.month("target_period")
    releases = t.targets.select("series_id", "target_period", "release_at")
    rows = bridge_rows(t).join(releases, ["series_id", "target_period"]).withColumns({
        "origin": F.when(month == 2, F.col("release_at")).otherwise(F.col("origin")),
        "coverage": F.when(month == 3, 1.5).otherwise(F.col("coverage")),
        "inputs_hash": F.when(month == 4, "none").otherwise(F.col("inputs_hash"))})
    return br.bridge_violations(rows.unionByName(rows.filter(month == 5)))


view("kalman_rows", """
SELECT f.series_id, f.target_period, t.value AS y, month(f.target_period) AS m, flow_cents / 1e8 AS f,
       nw, sw, sww, row_number() OVER o - 1 AS i, lag(t.value) OVER o AS l,
       lag(month(f.target_period)) OVER o AS lm
FROM features f JOIN targets t USING (series_id, target_period) JOIN (
  SELECT s.series_id, s.target_period, count(a.v - b.v) AS nw, coalesce(sum((a.v - b.v) / 1e8), 0) AS sw,
         coalesce(sum(((a.v - b.v) / 1e8) ** 2), 0) AS sww
  FROM (SELECT asked.*, CAST(date_trunc('month', target_period) AS DATE) + CAST(i AS INTEGER) AS d
        FROM asked CROSS JOIN range(0, 31) r(i)) s
  LEFT JOIN known a ON a.series_id = s.series_id AND a.origin = s.origin AND a.obs_period = s.d
  LEFT JOIN known b ON b.series_id = s.series_id AND b.origin = s.origin
                   AND b.obs_period = CAST(s.d - 7 AS DATE)
  WHERE isodow(s.d) = 3 AND s.d <= s.target_period GROUP BY ALL) w USING (series_id, target_period)
WINDOW o AS (PARTITION BY f.series_id ORDER BY f.target_period)
""", "features targets asked known")
view("kalman_scale", """
SELECT * FROM (
  SELECT o.series_id, o.i AS k, count(*) AS n, avg(t.y) AS ym, stddev_pop(t.y) AS ys, sum(t.nw) AS wn,
         sum(t.sw) / sum(t.nw) AS wm, sqrt(sum(t.sww) / sum(t.nw) - (sum(t.sw) / sum(t.nw)) ** 2) AS ws,
         avg(t.f) AS fm, stddev_pop(t.f) AS fs, count(t.f) AS fn
  FROM kalman_rows o JOIN kalman_rows t ON t.series_id = o.series_id AND t.i < o.i GROUP BY ALL)
WHERE n >= 36 AND wn >= n AND fn >= 24 AND ys > 1e-12 AND ws > 1e-12 AND fs > 1e-12
""", "kalman_rows")
view("kalman_train", """
SELECT s.*, t.i, t.m, (y - ym) / ys AS z, (l - ym) / ys AS zl, (f - fm) / fs AS zf, nw,
       (sw - nw * wm) / ws AS zw, [1.0::DOUBLE, (l - ym) / ys] || list_transform(range(2, 13),
         lambda x: CASE WHEN t.m = x THEN 1.0::DOUBLE ELSE 0.0 END) AS x
FROM kalman_scale s JOIN kalman_rows t ON t.series_id = s.series_id AND t.i < s.k
""", "kalman_scale kalman_rows")
view("kalman_system", """
SELECT series_id, k, list(r ORDER BY i) AS m FROM (
  SELECT series_id, k, i, list(g ORDER BY j) || [any_value(v)] AS r FROM (
    SELECT series_id, k, a.i, b.j, sum(x[a.i] * x[b.j])
             + any_value(CASE WHEN a.i = b.j AND a.i > 1 THEN 1e-6 ELSE 0 END) AS g, sum(x[a.i] * z) AS v
    FROM kalman_train CROSS JOIN range(1, 14) a(i) CROSS JOIN range(1, 14) b(j)
    WHERE zl IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY ALL
""", "kalman_train")
view("kalman_lines", """
SELECT series_id, k, w1, -sz * w1 / n AS w0, f1, -fz * f1 / fn AS f0,
  greatest((n - 2 * w1 * sxz + (sz * w1) ** 2 / n - 2 * sz * w1 / n * w1 * sz + w1 ** 2 * szz) / n, 1e-6) AS wr,
  greatest((fn - 2 * f1 * fxz + (fz * f1) ** 2 / fn - 2 * fz * f1 / fn * f1 * fz + f1 ** 2 * fzz) / fn, 1e-6) AS fr
FROM (SELECT *, n * sxz / (n * (szz + 1e-6) - sz * sz) AS w1, fn * fxz / (fn * (fzz + 1e-6) - fz * fz) AS f1
  FROM (SELECT series_id, k, sum(nw) AS n, sum(nw * z) AS sz, sum(nw * z * z) AS szz, sum(zw * z) AS sxz,
               count(zf) AS fn, sum(z) FILTER (zf IS NOT NULL) AS fz,
               sum(z * z) FILTER (zf IS NOT NULL) AS fzz, sum(z * zf) AS fxz
        FROM kalman_train GROUP BY ALL))
""", "kalman_train")


@query("m07_kalman_nowcast", """
WITH RECURSIVE el AS (
  SELECT series_id, k, 1 AS pos, m FROM kalman_system UNION ALL
  SELECT series_id, k, pos + 1, list_transform(range(1, 14), lambda i: list_transform(range(1, 15), lambda j:
    CASE WHEN i = pos THEN m[pos][j] / m[pos][pos] ELSE m[i][j] - m[i][pos] * m[pos][j] / m[pos][pos] END))
  FROM el WHERE pos <= 13),
beta AS (SELECT series_id, k, greatest(least(m[2][14], 0.98), -0.98) AS phi,
  list_transform(range(1, 13), lambda x: m[1][14] + CASE WHEN x = 1 THEN 0 ELSE m[x + 1][14] END) AS step
  FROM el WHERE pos = 14),
noise AS (SELECT series_id, k, any_value(phi) AS phi, any_value(step) AS step,
  greatest(avg((z - step[t.m] - phi * zl) ** 2) FILTER (zl IS NOT NULL), 1e-6) AS q
  FROM kalman_train t JOIN beta USING (series_id, k) GROUP BY ALL),
par AS (SELECT *, greatest(q * 1e-6, 1e-8) AS r FROM noise JOIN kalman_lines USING (series_id, k)
        JOIN kalman_scale USING (series_id, k)),
fl AS (
  SELECT series_id, k, CAST(-1 AS BIGINT) AS i, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS var FROM par UNION ALL
  SELECT series_id, k, i, CASE WHEN f THEN m2 + v2 * f1 / (f1 * f1 * v2 + fr) * (zf - f0 - f1 * m2) ELSE m2 END,
    CASE WHEN f THEN (1 - v2 * f1 / (f1 * f1 * v2 + fr) * f1) * v2 ELSE v2 END
  FROM (SELECT *, v2 * (m1 / v1 + w1 / wr * (zw - nw * w0)) AS m2
  FROM (SELECT *, 1 / (1 / v1 + nw * w1 * w1 / wr) AS v2
  FROM (SELECT *, CASE WHEN i < k THEN pm + pv / (pv + r) * (z - pm) ELSE pm END AS m1,
               CASE WHEN i < k THEN r / (pv + r) * pv ELSE pv END AS v1
  FROM (SELECT fl.series_id, fl.k, t.i, (t.y - ym) / ys AS z, (t.f - fm) / fs AS zf, t.f IS NOT NULL AS f,
               t.nw, (t.sw - t.nw * wm) / ws AS zw, w0, w1, wr, f0, f1, fr, r,
               CASE WHEN t.i = 0 THEN 0 ELSE phi * mean + step[t.lm] END AS pm,
               CASE WHEN t.i = 0 THEN 1 ELSE phi * phi * var + q END AS pv
        FROM fl JOIN par USING (series_id, k)
        JOIN kalman_rows t ON t.series_id = fl.series_id AND t.i = fl.i + 1 AND t.i <= fl.k)))))
SELECT fl.series_id, t.target_period, 'kalman_nowcast' AS model, CAST(n AS INTEGER) AS training_months,
       round(ym + ys * mean, 5) AS point,
       round(ym + ys * mean - 1.2815515655446004 * ys * sqrt(var + r), 5) AS low80,
       round(ym + ys * mean + 1.2815515655446004 * ys * sqrt(var + r), 5) AS high80,
       round(ym + ys * mean - 1.959963984540054 * ys * sqrt(var + r), 5) AS low95,
       round(ym + ys * mean + 1.959963984540054 * ys * sqrt(var + r), 5) AS high95
FROM fl JOIN par USING (series_id, k) JOIN kalman_rows t ON t.series_id = fl.series_id AND t.i = fl.k
WHERE fl.i = fl.k
""", "kalman_rows kalman_system kalman_lines")
def _(t):
    return rounded(fc.kalman_nowcast(bridge_rows(t)), ["point", "low80", "high80", "low95", "high95"], 5)


METRICS_SQL = """
SELECT series_id, model, count(*) AS observations, min(obs_period) AS period_start,
       max(obs_period) AS period_end, avg(abs(point - value)) AS mae,
       sqrt(avg((point - value) * (point - value))) AS rmse,
       avg(CASE WHEN sign(point - pv) = sign(value - pv) THEN 1.0 ELSE 0.0 END)
         AS acceleration_accuracy
FROM {b} b JOIN (SELECT series_id, obs_period, value, lag(value) OVER (
                        PARTITION BY series_id ORDER BY obs_period) AS pv FROM {h}) h
  USING (series_id, obs_period) WHERE obs_period >= DATE '{start}' GROUP BY ALL
"""
START = "1997-01-31"
view("metrics", METRICS_SQL.format(b="baselines", h="monthly", start=START), "baselines monthly")
view("gap_metrics", METRICS_SQL.format(b="gap_baselines", h="gappy", start=START),
     "gap_baselines gappy")
view("print_metrics", METRICS_SQL.format(b="print_baselines", h="first_prints", start=START),
     "print_baselines first_prints")


def metrics(t):
    return ev.evaluate(
        fc.expanding_baselines(t.stored("monthly")), t.stored("monthly"), START)


def benchmark(t):
    return ev.benchmark_backtest(gappy(t), START)


@query("m08_select_benchmark", """
SELECT series_id, arg_min(model, mae) AS model, round(min(mae), 5) AS mae FROM metrics GROUP BY 1
""", "metrics")
def _(t):
    return rounded(fc.select_benchmark(metrics(t)), ["mae"], 5)


BANDS_VIEW = """
SELECT *, CASE WHEN len(past) >= 24 THEN past[CAST(ceil(0.80::DOUBLE * (len(past) - 1)) AS BIGINT) + 1]
          END AS width80,
       CASE WHEN len(past) >= 24 THEN past[CAST(ceil(0.95::DOUBLE * (len(past) - 1)) AS BIGINT) + 1]
          END AS width95
FROM (SELECT b.series_id, b.obs_period, b.model, b.point, h.value AS actual,
             abs(b.point - h.value) AS abs_error,
             list_sort(coalesce(list(abs(b.point - h.value)) OVER (
               PARTITION BY b.series_id, b.model ORDER BY b.obs_period
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS past
      FROM {b} b JOIN {h} h USING (series_id, obs_period) WHERE b.obs_period >= DATE '{start}')
"""
view("bands", BANDS_VIEW.format(b="baselines", h="monthly", start=START), "baselines monthly")
view("gap_bands", BANDS_VIEW.format(b="gap_baselines", h="gappy", start=START),
     "gap_baselines gappy")


def banded(t):
    return fc.empirical_bands(
        fc.expanding_baselines(t.stored("monthly"), START), t.stored("monthly"))


@query("m09_empirical_bands", """
SELECT series_id, obs_period, model, round(point, 5) AS point,
       CAST(len(past) AS INTEGER) AS prior_errors, round(width80, 5) AS width80,
       round(width95, 5) AS width95, round(point - width80, 5) AS low80,
       round(point + width80, 5) AS high80, round(point - width95, 5) AS low95,
       round(point + width95, 5) AS high95 FROM bands
""", "bands")
def _(t):
    cols = ["point", "width80", "width95", "low80", "high80", "low95", "high95"]
    return rounded(banded(t), cols, 5).drop("actual", "abs_error")


@query("m10_predict_open_periods")
def _(t):
    return fc.predict_open_periods(
        t.targets, t.stored("weekly"), t.stored("monthly_flow"), "2001-05-28")


@query("m11_predict_benchmark_period", """
WITH best AS (SELECT series_id, arg_min(model, mae) AS model FROM metrics GROUP BY 1),
f AS (SELECT *, point IS NOT NULL AND w80 IS NOT NULL AND obs_period + 37 > DATE '2001-03-15' AS ok
  FROM (SELECT o.*, best.model, CASE best.model WHEN 'ar2' THEN ar2
               WHEN 'random_walk' THEN random_walk ELSE seasonal_naive END AS point, w80, w95
  FROM open_points o JOIN best USING (series_id) LEFT JOIN (
    SELECT series_id, model, errs[CAST(ceil(0.80::DOUBLE * (len(errs) - 1)) AS BIGINT) + 1] AS w80,
           errs[CAST(ceil(0.95::DOUBLE * (len(errs) - 1)) AS BIGINT) + 1] AS w95
    FROM (SELECT series_id, model, list_sort(list(abs(point - value))) AS errs
          FROM known_baselines JOIN known_monthly USING (series_id, obs_period)
          WHERE obs_period >= DATE '1997-01-31' GROUP BY ALL) WHERE len(errs) >= 24) e
    USING (series_id, model) WHERE value IS NULL))
SELECT series_id, obs_period, model, CAST(obs_period + 37 AS DATE) AS scheduled_at,
       CASE WHEN obs_period + 37 <= DATE '2001-03-15' THEN 'PAST' WHEN ok THEN 'PREDICTED'
            ELSE 'UNAVAILABLE' END AS status,
       CASE WHEN ok THEN round(point, 5) END AS point,
       CASE WHEN ok THEN round(point - w80, 5) END AS low80,
       CASE WHEN ok THEN round(point + w80, 5) END AS high80,
       CASE WHEN ok THEN round(point - w95, 5) END AS low95,
       CASE WHEN ok THEN round(point + w95, 5) END AS high95 FROM f
""", "metrics open_points known_baselines known_monthly")
def _(t):
    schedule = t.stored("monthly").groupBy("obs_period").agg(F.max("release_date").alias("scheduled_at"))
    out = fc.predict_benchmark_period(t.stored("monthly"), schedule, fc.select_benchmark(metrics(t)),
                                      "2001-03-15", START)
    return rounded(out, ["point", "low80", "high80", "low95", "high95"], 5)


view("known_monthly", """
SELECT series_id, obs_period, value FROM monthly WHERE release_date <= DATE '2001-03-15'
""", "monthly")
view("open_monthly", """
SELECT * FROM known_monthly UNION ALL
SELECT series_id, last_day(CAST(max(obs_period) + INTERVAL 1 MONTH AS DATE)), NULL
FROM known_monthly GROUP BY 1
""", "known_monthly")
view("open_points", points_view("open_monthly", True), "open_monthly")
view("known_points", points_view("known_monthly", True), "known_monthly")
view("known_baselines", long_view("known_points"), "known_points")


# ---- evaluation -----------------------------------------------------------------------------

SCORES = ["mae", "rmse", "acceleration_accuracy"]
SHOWN = """
SELECT series_id, model, observations, period_start, period_end, round(mae, 5) AS mae,
       round(rmse, 5) AS rmse, round(acceleration_accuracy, 5) AS acceleration_accuracy FROM {m}
"""


@query("e01_evaluate", SHOWN.format(m="metrics"), "metrics")
def _(t):
    return rounded(metrics(t), SCORES, 5).drop("coverage80", "coverage95")


@query("e01_first_print_backtest", SHOWN.format(m="print_metrics"), "print_metrics")
def _(t):
    scores = ev.evaluate(
        fc.expanding_baselines(t.stored("first_prints")), t.stored("first_prints"), START)
    return rounded(scores, SCORES, 5).drop("coverage80", "coverage95")


@query("e01_evaluate_bands", """
SELECT series_id, model, count(*) AS observations,
       round(avg(CASE WHEN actual BETWEEN point - width80 AND point + width80 THEN 1.0 ELSE 0 END), 5)
         AS coverage80,
       round(avg(CASE WHEN actual BETWEEN point - width95 AND point + width95 THEN 1.0 ELSE 0 END), 5)
         AS coverage95
FROM bands WHERE width80 IS NOT NULL GROUP BY ALL
""", "bands")
def _(t):
    out = ev.evaluate(banded(t).drop("actual").filter("width80 is not null"), t.stored("monthly"))
    return rounded(out.select("series_id", "model", "observations", "coverage80", "coverage95"),
                   ["coverage80", "coverage95"], 5)


@query("e02_check_comparable", """
WITH w AS (SELECT series_id, count(*) AS expected FROM monthly
           WHERE obs_period >= DATE '1996-06-30' GROUP BY 1),
g AS (SELECT series_id, model, count(*) AS n FROM baselines
      WHERE obs_period >= DATE '1996-06-30' GROUP BY ALL)
SELECT series_id, model, 'missing period' AS problem, expected - n AS row_count
FROM w JOIN g USING (series_id) WHERE expected > n
""", "monthly baselines")
def _(t):
    return ev.check_comparable(
        fc.expanding_baselines(t.stored("monthly"), "1996-06-30"), t.stored("monthly"),
        "1996-06-30", NAIVE)


@query("e03_acceleration_match", """
SELECT series_id, obs_period, model, sign(point - pv) = sign(value - pv) AS accelerates
FROM baselines b JOIN (SELECT series_id, obs_period, value, lag(value) OVER (
                         PARTITION BY series_id ORDER BY obs_period) AS pv FROM monthly) h
  USING (series_id, obs_period)
""", "baselines monthly")
def _(t):
    rows = ev.score_rows(fc.expanding_baselines(t.stored("monthly")), t.stored("monthly"))
    return rows.select("series_id", "obs_period", "model", "accelerates")


@query("e04_headline_decision", """
WITH c AS (SELECT series_id, model,
    avg(CASE WHEN actual BETWEEN point - width80 AND point + width80 THEN 1.0 ELSE 0 END) AS c80,
    avg(CASE WHEN actual BETWEEN point - width95 AND point + width95 THEN 1.0 ELSE 0 END) AS c95
  FROM bands WHERE width80 IS NOT NULL GROUP BY ALL),
m AS (SELECT * FROM metrics LEFT JOIN c USING (series_id, model)),
h AS (SELECT series_id, arg_min(model, mae) AS model FROM m WHERE model <> 'random_walk' GROUP BY 1),
n AS (SELECT series_id, mae FROM m WHERE model = 'random_walk')
SELECT m.series_id, m.model, round(m.mae, 5) AS mae, 'random_walk' AS best_naive,
       round(n.mae, 5) AS naive_mae, round(1 - m.mae / n.mae, 5) AS improvement,
       1 - m.mae / n.mae >= 0.1 AS bar_improvement, c80 BETWEEN 0.7 AND 0.9 AS bar_coverage80,
       c95 BETWEEN 0.9 AND 1.0 AS bar_coverage95,
       acceleration_accuracy >= 0.55 AS bar_acceleration,
       1 - m.mae / n.mae >= 0.1 AND c80 BETWEEN 0.7 AND 0.9 AND c95 BETWEEN 0.9 AND 1.0
         AND acceleration_accuracy >= 0.55 AS all_bars_pass
FROM h JOIN m USING (series_id, model) JOIN n USING (series_id)
""", "metrics bands")
def _(t):
    covered = ev.evaluate(banded(t).drop("actual").filter("width80 is not null"), t.stored("monthly"))
    m = metrics(t).drop("coverage80", "coverage95").join(
        covered.select("series_id", "model", "coverage80", "coverage95"),
        ["series_id", "model"], "left")
    out = ev.headline_decision(m, [fc.SEASONAL, fc.AR2], [fc.RANDOM_WALK])
    return rounded(out, ["mae", "naive_mae", "improvement"], 5)


COVERED = """
SELECT series_id, model, count(width80) AS interval_observations,
       round(avg(CASE WHEN abs_error <= width80 THEN 1.0 WHEN width80 IS NOT NULL THEN 0 END), 5)
         AS coverage80,
       round(avg(CASE WHEN abs_error <= width95 THEN 1.0 WHEN width95 IS NOT NULL THEN 0 END), 5)
         AS coverage95 FROM {b} GROUP BY ALL
"""
view("gap_covered", COVERED.format(b="gap_bands"), "gap_bands")


@query("e05_expanding_interval_coverage", COVERED.format(b="bands"), "bands")
def _(t):
    f = fc.expanding_baselines(t.stored("monthly"), START)
    return rounded(ev.expanding_interval_coverage(f, t.stored("monthly")), ["coverage80", "coverage95"], 5)


@query("e06_benchmark_backtest", """
SELECT m.series_id, m.model, observations, period_start, period_end, round(mae, 5) AS mae,
       round(rmse, 5) AS rmse, round(acceleration_accuracy, 5) AS acceleration_accuracy,
       interval_observations, coverage80, coverage95,
       model = arg_min(model, mae) OVER (PARTITION BY m.series_id) AS selected
FROM gap_metrics m JOIN gap_covered USING (series_id, model)
""", "gap_metrics gap_covered")
def _(t):
    return rounded(benchmark(t), [*SCORES, "coverage80", "coverage95"], 5)


@query("e09_best_naive", """
SELECT series_id, arg_min(model, mae) AS model, round(min(mae), 5) AS mae FROM print_metrics
GROUP BY 1
""", "print_metrics")
def _(t):
    scores = ev.evaluate(
        fc.expanding_baselines(t.stored("first_prints")), t.stored("first_prints"), START)
    return rounded(ev.best_naive(scores, NAIVE), ["mae"], 5)
