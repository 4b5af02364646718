"""Nowcast of a target by a scalar Kalman filter over target, weekly changes and monthly flow.

Every month is an origin with its own parameters, which come from running sums over strictly earlier
months: means and spreads, a regression of the state on its last value and the month, and two lines
from the state to its channels. All are linear maps and small eliminations of those sums, so nothing is
refitted over history.

The filter of an origin starts `FILTER_MONTHS` months before it. That is no approximation at double
precision: a target is observed with noise r against a predicted variance of q at least, and r is at
most a hundredth of q, as r = max(q / 10^6, 10^-8) and q >= 10^-6. So each month leaves less than a
hundredth of what was believed before it, and twelve months less than 10^-24.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.operators.bridge import MIN_MONTHS, Z80, Z95, solved, sql_array
from vintagekit.operators.features import FLAT

# Fixed values.
KALMAN = "kalman_nowcast"
MIN_FLOW_MONTHS = 24
TRANSITION_RIDGE = 1e-6
MAX_ABS_PHI = 0.98
VARIANCE_FLOOR = 1e-6
TARGET_VARIANCE_FLOOR = 1e-8
FILTER_MONTHS = 12
MONTHS = range(2, 13)


def _raw_rows(rows: DataFrame, series: str, period: str, value: str) -> DataFrame:
    """Per month: the target and the one before it, the weeks' number, sum and squares, the flow.

    Targets and flows are measured from the series' first ones, so that no digits are lost to the level.
    """
    whole = Window.partitionBy(series).orderBy(period).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.partitionBy(series).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    weeks = F.filter(F.transform("weekly_changes", lambda c: c["change"].cast("double")),
                     lambda c: c.isNotNull())
    y, flow = F.col(value).cast("double"), F.col("monthly_change").cast("double")
    rows = rows.select(series, period, y.alias("_value"), flow.alias("_raw_flow"),
                       F.coalesce(weeks, F.array().cast("array<double>")).alias("_weeks"))
    rows = rows.withColumns({
        "_level": F.first("_value", ignorenulls=True).over(whole),
        "_flow_level": F.first("_raw_flow", ignorenulls=True).over(whole)})
    rows = rows.withColumns({
        "_y": F.col("_value") - F.col("_level"), "_f": F.col("_raw_flow") - F.col("_flow_level"),
        "_month": F.month(period), "_nw": F.size("_weeks").cast("double"),
        "_sw": F.aggregate("_weeks", F.lit(0.0), lambda s, c: s + c),
        "_sww": F.aggregate("_weeks", F.lit(0.0), lambda s, c: s + c * c)}).drop("_weeks")
    return rows.withColumns({
        "_l": F.last("_y", ignorenulls=True).over(earlier),  # the target before, over months without
        "_seen": F.count("_y").over(earlier)})


def _running_sums(rows: DataFrame, series: str, period: str) -> DataFrame:
    """Sums over strictly earlier months with a target, as SQL text: many columns plan faster so."""
    pair, flow = "_l IS NOT NULL", "_f IS NOT NULL"
    sums = {"y": "_y", "yy": "_y * _y"}
    for name, text in (("n1", "1D"), ("l", "_l"), ("ll", "_l * _l"), ("y1", "_y"), ("yy1", "_y * _y"),
                       ("ly", "_l * _y")):
        sums[name] = f"CASE WHEN {pair} THEN {text} END"
    for m in MONTHS:
        for name, text in (("n", "1D"), ("l", "_l"), ("y", "_y")):
            sums[f"{name}_{m}"] = f"CASE WHEN {pair} AND _month = {m} THEN {text} END"
    sums |= {"nw": "_nw", "sw": "_sw", "sww": "_sww", "nwy": "_nw * _y", "nwyy": "_nw * _y * _y",
             "swy": "_sw * _y"}
    for name, text in (("nf", "1D"), ("f", "_f"), ("ff", "_f * _f"), ("fy", "_f * _y"), ("yf", "_y"),
                       ("yyf", "_y * _y")):
        sums[name] = f"CASE WHEN {flow} THEN {text} END"
    over = (f"OVER (PARTITION BY `{series}` ORDER BY `{period}` "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return rows.selectExpr("*", *[
        f"coalesce(sum(CASE WHEN _y IS NOT NULL THEN {text} END) {over}, 0D) AS s_{name}"
        for name, text in sums.items()])


def _scaled(df: DataFrame) -> DataFrame:
    """Means and population spreads of target, weeks and flow; origins where one is flat go."""
    for name, n, total, squares in (("y", "_seen", "s_y", "s_yy"), ("w", "s_nw", "s_sw", "s_sww"),
                                    ("f", "s_nf", "s_f", "s_ff")):
        mean_square = F.try_divide(squares, n)
        df = df.withColumn(f"{name}m", F.try_divide(total, n)).withColumn(f"{name}s", F.sqrt(F.greatest(
            mean_square - F.col(f"{name}m") * F.col(f"{name}m"), F.lit(0.0))))
        # Squares of equal values differ from their mean's square by rounding only.
        trace = F.sqrt(F.abs(mean_square)) * 1e-7
        df = df.filter(F.col(f"{name}s") > F.greatest(F.lit(FLAT), trace))
    return df


def _transition(df: DataFrame) -> DataFrame:
    """phi, the steps by month, q and r: the state's regression on its last value and the month."""
    z_l, z_y = "(s_l - s_n1 * ym) / ys", "(s_y1 - s_n1 * ym) / ys"
    months_l = [f"(s_l_{m} - ym * s_n_{m}) / ys" for m in MONTHS]
    gram = [["s_n1", z_l, *[f"s_n_{m}" for m in MONTHS]],
            [z_l, "(s_ll - 2 * ym * s_l + s_n1 * ym * ym) / (ys * ys)", *months_l]]
    for i, m in enumerate(MONTHS):
        gram.append([f"s_n_{m}", months_l[i], *[f"s_n_{m}" if o == m else "0D" for o in MONTHS]])
    target = [z_y, "(s_ly - ym * (s_l + s_y1) + s_n1 * ym * ym) / (ys * ys)",
              *[f"(s_y_{m} - ym * s_n_{m}) / ys" for m in MONTHS]]
    df = df.selectExpr("*", f"{sql_array([sql_array(row) for row in gram])} AS _gram",
                       f"{sql_array(target)} AS _xy",
                       "(s_yy1 - 2 * ym * s_y1 + s_n1 * ym * ym) / (ys * ys) AS _zz")
    size = len(gram)
    full = F.transform("_gram", lambda row, i: F.concat(
        F.transform(row, lambda v, j: F.when((i == j) & (i > 0), v + TRANSITION_RIDGE).otherwise(v)),
        F.array(F.get("_xy", i))))
    df = df.withColumn("_beta", F.transform(solved(full, size), lambda row: F.get(row, F.lit(size))))
    phi = F.greatest(F.least(F.get("_beta", F.lit(1)), F.lit(MAX_ABS_PHI)), F.lit(-MAX_ABS_PHI))
    df = df.withColumn("phi", phi).withColumn("_beta", F.transform(
        "_beta", lambda b, i: F.when(i == 1, F.col("phi")).otherwise(b)))

    def dot(a: Column | str, b: Column | str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    rss = F.col("_zz") - 2 * dot("_beta", "_xy") + dot(
        "_beta", F.transform("_gram", lambda row: dot(row, "_beta")))
    df = df.withColumn("q", F.greatest(rss / F.col("s_n1"), F.lit(VARIANCE_FLOOR)))
    step = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.get("_beta", F.lit(0)) + F.when(
        m > 1, F.get("_beta", m)).otherwise(0.0))
    return df.withColumns({
        "r": F.greatest(F.col("q") * 1e-6, F.lit(TARGET_VARIANCE_FLOOR)), "step": step}).drop(
        "_gram", "_xy", "_zz", "_beta")


def _lines(df: DataFrame) -> DataFrame:
    """Base, load and noise of both channels: their lines on the state, weighted by observations."""
    for name, n, y, yy, xy, total in (("w", "s_nw", "s_nwy", "s_nwyy", "s_swy", "s_sw"),
                                      ("f", "s_nf", "s_yf", "s_yyf", "s_fy", "s_f")):
        df = df.selectExpr(
            "*", f"{n} AS _n", f"({y} - ym * {n}) / ys AS _z",
            f"({yy} - 2 * ym * {y} + ym * ym * {n}) / (ys * ys) AS _zz",
            f"({xy} - {name}m * {y} - ym * ({total} - {name}m * {n})) / ({name}s * ys) AS _xz")
        df = df.selectExpr("*", f"_n * (_zz + {TRANSITION_RIDGE}D) - _z * _z AS _det").selectExpr(
            "*", f"-_z * _xz / _det AS {name}0", f"_n * _xz / _det AS {name}1")
        df = df.selectExpr(
            "*", f"greatest((_n - 2 * {name}1 * _xz + {name}0 * {name}0 * _n + 2 * {name}0 * {name}1 * _z "
            f"+ {name}1 * {name}1 * _zz) / _n, {VARIANCE_FLOOR}D) AS {name}r").drop(
            "_n", "_z", "_zz", "_xz", "_det")
    return df


def _observed(mean: Column, var: Column, nw: Column, sw: Column, flow: Column,
              target: Column | None = None) -> Column:
    """The state after a month's observations: each adds its information, in whatever order."""
    def c(name: str) -> Column:
        return F.col(name)

    info = 1 / var + nw * c("w1") * c("w1") / c("wr")
    pull = mean / var + c("w1") / c("wr") * ((sw - nw * c("wm")) / c("ws") - nw * c("w0"))
    info = info + F.when(flow.isNotNull(), c("f1") * c("f1") / c("fr")).otherwise(0.0)
    pull = pull + F.when(flow.isNotNull(), c("f1") / c("fr") * (
        (flow - c("fm")) / c("fs") - c("f0"))).otherwise(0.0)
    if target is not None:
        info, pull = info + 1 / c("r"), pull + (target - c("ym")) / c("ys") / c("r")
    return F.struct((pull / info).alias("mean"), (1 / info).alias("var"))


def kalman_nowcast(
    rows: DataFrame, min_history: int = MIN_MONTHS, start: date | str | None = None,
    entering: bool = False, series: str = "series_id", period: str = "target_period",
    value: str = "value",
) -> DataFrame:
    """Nowcast of every month from strictly earlier targets and its own weeks and flow.

    `rows` holds the target (null while open), weekly_changes and monthly_change, one row per series
    and period. Missing channels are skipped. A step takes the month effect of the period being left,
    unless `entering` asks for that of the period being entered.
    """
    raw = _raw_rows(rows, series, period, value)
    behind = Window.partitionBy(series).orderBy("_seen").rangeBetween(-FILTER_MONTHS, -1)
    past = F.sort_array(F.collect_list(F.when(F.col("_y").isNotNull(), F.struct(
        F.col("_seen").alias("at"), F.col("_y").alias("y"), F.col("_month").alias("month"),
        F.col("_nw").alias("nw"), F.col("_sw").alias("sw"), F.col("_f").alias("f")))).over(behind))
    made = _running_sums(raw.withColumn("_past", past), series, period).filter(
        (F.col("_seen") >= min_history) & (F.col("s_nw") >= F.col("_seen"))
        & (F.col("s_nf") >= MIN_FLOW_MONTHS))
    made = _lines(_transition(_scaled(made)))

    def moved(state: Column, left: Column, entered: Column) -> tuple[Column, Column]:
        month = entered if entering else left
        return (F.col("phi") * state["mean"] + F.get("step", month - 1),
                F.col("phi") * F.col("phi") * state["var"] + F.col("q"))

    def step(acc: Column, x: Column) -> Column:
        mean, var = moved(acc, acc["month"], x["month"])
        first = acc["month"].isNull()
        seen = _observed(F.when(first, 0.0).otherwise(mean), F.when(first, 1.0).otherwise(var),
                         x["nw"], x["sw"], x["f"], x["y"])
        return F.struct(seen["mean"].alias("mean"), seen["var"].alias("var"), x["month"].alias("month"))

    begin = F.struct(F.lit(0.0).alias("mean"), F.lit(1.0).alias("var"),
                     F.lit(None).cast("int").alias("month"))
    made = made.withColumn("_state", F.aggregate("_past", begin, step))
    mean, var = moved(F.col("_state"), F.col("_state.month"), F.col("_month"))
    made = made.withColumn("_now", _observed(mean, var, F.col("_nw"), F.col("_sw"), F.col("_f")))
    point = F.col("_level") + F.col("ym") + F.col("ys") * F.col("_now.mean")
    spread = F.col("ys") * F.sqrt(F.greatest(F.col("_now.var"), F.lit(0.0)) + F.col("r"))
    out = made.select(series, period, F.lit(KALMAN).alias("model"),
                      F.col("_seen").cast("int").alias("training_months"), point.alias("point"),
                      spread.alias("_std"))
    p, s = F.col("point"), F.col("_std")
    out = out.select(series, period, "model", "training_months", "point", (p - Z80 * s).alias("low80"),
                     (p + Z80 * s).alias("high80"), (p - Z95 * s).alias("low95"),
                     (p + Z95 * s).alias("high95"))
    return out.filter(F.col(period) >= F.lit(start).cast("date")) if start else out
