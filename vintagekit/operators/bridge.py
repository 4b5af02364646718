"""Ridge forecasts of a target from its ragged-edge features, refitted at every month.

Nothing is refitted over history. Each month's sums of products of raw columns (values, and whether
they are there) run along its series; centring, scaling and filling of absent values are a linear map
of those sums, and the sixteen equations that remain are eliminated inside one expression. So a row
costs the same however long its series is, and no series meets in a Python task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagekit.functions import keys as k
from vintagekit.operators.features import FLAT

# Fixed values.
Z80 = 1.2815515655446004
Z95 = 1.959963984540054
RIDGE_ALPHA = 10.0
MIN_MONTHS = 36
RANK_TOLERANCE = 1e-11
RIDGE = "ridge_bridge"

RAW = ("one", "paced", "has_paced", "cover", "flow", "has_flow")
EVIDENCE = ("release_at", "checksum", "inputs_hash")
SIZE = 16


def solved(matrix: Column | str, size: int) -> Column:
    """Gauss-Jordan on the first `size` columns of an array of rows; what stands right of them remains.

    For matrices whose pivots are positive, as those of a ridge are.
    """

    def step(m: Column, at: Column) -> Column:
        pivot = F.transform(F.get(m, at), lambda v: v / F.get(F.get(m, at), at))
        return F.transform(m, lambda row, i: F.when(i == at, pivot).otherwise(
            F.zip_with(row, pivot, lambda v, p: v - F.get(row, at) * p)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.col(matrix) if isinstance(
        matrix, str) else matrix, step)


def rank_of(gram: Column | str, size: int) -> Column:
    """Rank of a matrix of products: pivots that stay above a trace of their first size."""
    gram = F.col(gram) if isinstance(gram, str) else gram
    diagonal = F.transform(gram, lambda row, i: F.get(row, i))

    def step(m: Column, at: Column) -> Column:
        pivot = F.get(m, at)
        size_of = F.get(pivot, at)
        return F.when(size_of <= F.get(diagonal, at) * RANK_TOLERANCE, m).otherwise(
            F.transform(m, lambda row, i: F.when(i <= at, row).otherwise(
                F.zip_with(row, pivot, lambda v, p: v - F.get(row, at) / size_of * p))))

    left = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), gram, step)
    return F.size(F.filter(F.transform(left, lambda row, i: F.when(
        F.get(row, i) > F.get(diagonal, i) * RANK_TOLERANCE, 1)), lambda x: x.isNotNull()))


def _running_products(rows: DataFrame, series: str, period: str) -> DataFrame:
    """Sums over strictly earlier rows with a target of all products of raw columns and months.

    Written as SQL text, as a hundred columns built call by call take longer to plan than to compute.
    """
    names = [*RAW, "y"]
    sums = {f"_s_{a}_{b}": f"_{a} * _{b}" for i, a in enumerate(names) for b in names[i:]}
    sums |= {f"_m{m}_{a}": f"CASE WHEN _month = {m} THEN _{a} END"
             for m in range(2, 13) for a in names}
    over = (f"OVER (PARTITION BY `{series}` ORDER BY `{period}` "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return rows.selectExpr("*", *[
        f"coalesce(sum(CASE WHEN _trains THEN {text} END) {over}, 0D) AS {name}"
        for name, text in sums.items()])


def _raw_rows(rows: DataFrame, series: str, period: str, value: str) -> DataFrame:
    """Raw columns measured from the series' first values, so that no digits are lost to the level."""
    first = Window.partitionBy(series).orderBy(period).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    # Months before a value's first one do not use it, so its level there does not matter.
    level = {c: F.first(F.col(c).cast("double"), ignorenulls=True).over(first)
             for c in (value, "paced_change", "monthly_change")}

    def from_level(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double") - level[c], F.lit(0.0))

    return rows.withColumns({
        "_trains": F.col(value).isNotNull(), "_month": F.month(period), "_one": F.lit(1.0),
        "_level": F.coalesce(level[value], F.lit(0.0)), "_y": from_level(value),
        "_paced": from_level("paced_change"),
        "_has_paced": F.col("paced_change").isNotNull().cast("double"),
        "_cover": F.coalesce(F.col("coverage").cast("double"), F.lit(0.0)),
        "_flow": from_level("monthly_change"),
        "_has_flow": F.col("monthly_change").isNotNull().cast("double"),
    })


# The first five design columns as sums of raw columns: scaled values are linear in them.
DESIGN = (
    {"one": "1D"}, {"paced": "(1 / _std_paced)", "has_paced": "(-_mean_paced / _std_paced)"},
    {"cover": "1D"}, {"flow": "(1 / _std_flow)", "has_flow": "(-_mean_flow / _std_flow)"},
    {"has_flow": "1D"},
)


def _times(column: dict[str, str], other: dict[str, str]) -> str:
    """The running product of two such columns, from those of their raw ones."""
    names = [*RAW, "y"]

    def product(a: str, b: str) -> str:
        a, b = sorted((a, b), key=names.index)
        return f"_s_{a}_{b}"

    return " + ".join(f"{x} * {z} * {product(a, b)}" for a, x in column.items() for b, z in other.items())


def sql_array(parts: Sequence[str]) -> str:
    return f"array({', '.join(parts)})"


def ridge_bridge(
    rows: DataFrame, alpha: float = RIDGE_ALPHA, min_history: int = MIN_MONTHS,
    start: date | str | None = None, series: str = "series_id", period: str = "target_period",
    value: str = "value",
) -> DataFrame:
    """Ridge of the target on its design row, refitted for each month on all earlier months.

    `rows` holds the target (null while open) with paced_change, coverage and monthly_change, one row
    per series and period. Absent values stand at their mean. `inputs_hash` covers the model, every
    training row (its period, value, and what is there of release_at, checksum and its feature's
    inputs_hash) and the hash of the forecast's own feature.
    """
    if alpha <= 0 or min_history < 24:
        raise ValueError("alpha must be positive and min_history at least 24")
    there = [c for c in EVIDENCE if c in rows.columns]
    w = Window.partitionBy(series).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    salt = k.row_text([F.lit(f"{RIDGE}-{alpha:g}"), *[c for c in there if c == "inputs_hash"]])
    hashed = F.when(F.col(value).isNotNull(), k.row_hash([period, value, *there]))
    need = rows.select(series, period, value, "paced_change", "coverage", "monthly_change",
                       k.digest(hashed, w, salt).alias("_hash"))
    moments = _running_products(_raw_rows(need, series, period, value), series, period)
    moments = moments.filter(F.col("_s_one_one") >= min_history)

    for c, flag in (("paced", "has_paced"), ("flow", "has_flow")):
        n = F.col(f"_s_one_{flag}")
        mean = F.when(n > 0, F.col(f"_s_one_{c}") / n).otherwise(0.0)
        spread = F.when(n > 0, F.sqrt(F.greatest(F.col(f"_s_{c}_{c}") / n - mean * mean, F.lit(0.0))))
        # Squares of equal values differ from their mean's square by rounding only.
        flat = F.sqrt(F.abs(F.col(f"_s_{c}_{c}") / F.greatest(n, F.lit(1.0)))) * 1e-7
        moments = moments.withColumns({
            f"_mean_{c}": mean,
            f"_std_{c}": F.when(spread > F.greatest(F.lit(FLAT), flat), spread).otherwise(1.0)})

    months = [[" + ".join(f"{x} * _m{m}_{a}" for a, x in column.items()) for m in range(2, 13)]
              for column in DESIGN]
    gram = [sql_array([*[_times(a, b) for b in DESIGN], *months[i]]) for i, a in enumerate(DESIGN)] + [
        sql_array([*[of[m - 2] for of in months],
                *[f"_m{m}_one" if other == m else "0D" for other in range(2, 13)]])
        for m in range(2, 13)]
    target = [_times(column, {"y": "1D"}) for column in DESIGN] + [f"_m{m}_y" for m in range(2, 13)]
    ahead = [" + ".join(f"{x} * _{a}" for a, x in column.items()) for column in DESIGN] + [
        f"CAST(_month = {m} AS DOUBLE)" for m in range(2, 13)]
    laid = moments.selectExpr(
        f"`{series}`", f"`{period}`", "_hash", "CAST(_s_one_one AS INT) AS training_months", "_level",
        "_s_y_y AS _yy", f"{sql_array(gram)} AS _gram", f"{sql_array(target)} AS _xy", f"{sql_array(ahead)} AS _x")
    full = F.transform("_gram", lambda row, i: F.concat(
        F.transform(row, lambda v, j: F.when((i == j) & (i > 0), v + alpha).otherwise(v)),
        F.array(F.get("_xy", i), F.get("_x", i))))
    done = laid.withColumn("_done", solved(full, SIZE)).withColumns({
        "_beta": F.transform("_done", lambda row: F.get(row, F.lit(SIZE))),
        "_back": F.transform("_done", lambda row: F.get(row, F.lit(SIZE + 1)))})

    def dot(a: Column | str, b: Column | str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    fitted = F.transform("_gram", lambda row: dot(row, "_beta"))
    rss = F.greatest(F.col("_yy") - 2 * dot("_beta", "_xy") + dot("_beta", fitted), F.lit(0.0))
    free = F.greatest(F.col("training_months") - rank_of("_gram", SIZE), F.lit(1))
    out = done.select(
        series, period, F.lit(RIDGE).alias("model"), "training_months",
        (dot("_x", "_beta") + F.col("_level")).alias("point"),
        F.sqrt(F.greatest(rss / free * (1 + dot("_x", "_back")), F.lit(0.0))).alias("_std"),
        F.col("_hash").alias("inputs_hash"))
    p, s = F.col("point"), F.col("_std")
    out = out.select(
        series, period, "model", "training_months", "point", (p - Z80 * s).alias("low80"),
        (p + Z80 * s).alias("high80"), (p - Z95 * s).alias("low95"), (p + Z95 * s).alias("high95"),
        "inputs_hash")
    return out.filter(F.col(period) >= F.lit(start).cast("date")) if start else out


def bridge_violations(
    rows: DataFrame, made: str = "origin", release: str = "release_at", series: str = "series_id",
    period: str = "target_period", value: str = "value",
) -> DataFrame:
    """What no bridge may train on, as (rule, series, period).

    A feature made on or after its target's release, a coverage outside 0 to 1, a value or feature that
    is not finite, a feature without a hash, a period that stands twice.
    """

    def finite(c: str) -> Column:
        x = F.col(c).cast("double")
        return x.isNull() | (~F.isnan(x) & (F.abs(x) < float("inf")))

    rules = {
        "feature after release": F.col(value).isNull() | (F.col(made) < F.col(release)),
        "coverage": F.col("coverage").between(0, 1),
        "not finite": finite(value) & finite("paced_change") & finite("monthly_change"),
        "feature hash": F.col("inputs_hash").rlike("^[0-9a-f]{64}$"),
    }
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]
    twice = rows.groupBy(series, period).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.select(F.explode(F.array_compact(F.array(*broken))).alias("rule"), series, period) \
        .unionByName(twice.select(F.lit("period twice").alias("rule"), series, period))
