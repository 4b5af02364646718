"""Point-in-time selection: what was known when.

Windows here run over one row per (series, period), so their length is bounded by the calendar.
Raw vintages and copies are first reduced by plain aggregates, which combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.functions import calendar as cal


def boundary_literal(df: DataFrame, column: str, t: date | datetime | str) -> Column:
    """The as-of instant as a literal of the column's type; a bare date means the end of its day."""
    if isinstance(t, str):
        t = datetime.fromisoformat(t) if ("T" in t or " " in t) else date.fromisoformat(t)
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.lit(t.date() if isinstance(t, datetime) else t)
    if not isinstance(t, datetime):
        t = datetime.combine(t, time.max)
        zone = "" if isinstance(kind, T.TimestampNTZType) else "+00:00"
        return F.lit(t.isoformat(sep=" ") + zone).cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        if t.tzinfo is not None:
            raise ValueError("a zone-free column takes a zone-free as-of")
        return F.lit(t.isoformat(sep=" ")).cast(kind)
    if t.tzinfo is None:
        raise ValueError("as-of must carry a time zone")
    return F.lit(t.isoformat(sep=" ")).cast(kind)


def as_of(df: DataFrame, t: date | datetime | str, release: str = "release_date") -> DataFrame:
    """Rows released by `t`: a plain filter, so it reaches the scan. Order is left to the reader."""
    return df.filter(F.col(release) <= boundary_literal(df, release, t))


def latest_vintage(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("release_date", "checksum")
) -> DataFrame:
    """Per key the row with the greatest order columns."""
    return _pick(df, keys, order, F.max_by)


def first_print(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("release_date", "ingested_at", "checksum"),
    url: str | None = None,
    url_pattern: str | None = None,
) -> DataFrame:
    """Per key the row released first; with a pattern only dated-release addresses take part."""
    if url is not None and url_pattern is not None:
        df = df.filter(F.col(url).rlike(url_pattern))
    return _pick(df, keys, order, F.min_by)


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], how) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(how(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def vintage_conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that carry more than one value. Least and greatest decide it without a distinct."""
    return df.groupBy(*keys).agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value")
    ).filter(F.col("min_value") != F.col("max_value"))


def exact_dedupe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(cols))


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    strict: bool = False,
    bucket: str = "year",
) -> DataFrame:
    """Each left row with the latest right row at or before (strict: before) its time.

    Only distinct (key, time) questions are answered, by one tagged union and one forward fill per
    (key, time bucket); the left rows then look their answer up in an equi-join. What a bucket
    inherits from earlier ones comes from a summary of one row per (key, bucket). So a key that
    holds a third of all rows is spread over its buckets and times, and `bucket` can be made finer
    where instants are many. Right rows at one instant are reduced first; the greatest one wins,
    which makes ties the same on every run.
    """
    keys = list(keys)
    right_rows = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(
        F.max(F.struct(*take)).alias("_r"))
    asked = left.select(*keys, F.col(left_time).alias("_t")).distinct()
    asked_tag, right_tag = (0, 1) if strict else (1, 0)
    both = asked.withColumn("_tag", F.lit(asked_tag)).unionByName(
        right_rows.withColumn("_tag", F.lit(right_tag)), allowMissingColumns=True
    ).withColumn("_b", F.date_trunc(bucket, "_t"))
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_tag").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_in", F.last("_r", True).over(w))
    ends = filled.groupBy(*keys, "_b").agg(F.max_by("_in", F.struct("_t", "_tag")).alias("_end"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_b", F.last("_end", True).over(wb).alias("_before"))
    answers = filled.filter(F.col("_tag") == asked_tag).join(carried, [*keys, "_b"], "left").select(
        *keys, F.col("_t").alias(left_time), F.coalesce("_in", "_before").alias("_got"))
    joined = left.join(answers, [*keys, left_time], "left")
    return joined.select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in take])


def validity(
    df: DataFrame, keys: Sequence[str], value: Sequence[str], release: str
) -> DataFrame:
    """One row per distinct (key, release) with the release that replaces it."""
    rows = df.groupBy(*keys, release).agg(F.max(F.struct(*value)).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(release)
    return rows.select(
        *keys, release, *[F.col(f"_v.{c}").alias(c) for c in value],
        F.lead(release).over(w).alias("replaced_at"),
    )


def as_of_many(
    df: DataFrame,
    bounds: DataFrame,
    keys: Sequence[str],
    on: Sequence[str],
    bound_col: str,
    value: Sequence[str] = ("value",),
    release: str = "release_date",
    strict: bool = False,
) -> DataFrame:
    """For every boundary, each key's latest row by then. `on` are the keys both sides share.

    Vintages become validity intervals, so the join emits exactly the answer rows: one interval of
    a key holds any boundary. Both sides meet by the quarters they touch, so an interval is compared
    with the boundaries of its own quarters only.
    """
    v = validity(df, keys, value, release)

    def quarter(c: Column) -> Column:
        return F.year(c) * 4 + F.quarter(c)

    until = F.coalesce(F.least(F.col("replaced_at"), F.col("_last")), F.col("_last"))
    v = v.withColumn("_last", bounds.agg(F.max(bound_col).alias("m")).scalar()).filter(
        F.col(release) <= until).withColumn(
        "_quarter", F.explode(F.sequence(quarter(F.col(release)), quarter(until)))).drop("_last")
    bounds = bounds.withColumn("_quarter", quarter(F.col(bound_col)))
    b, r0, r1 = F.col(bound_col), F.col(release), F.col("replaced_at")
    inside = (r0 < b) & (r1.isNull() | (b <= r1)) if strict else (
        (r0 <= b) & (r1.isNull() | (b < r1))
    )
    return v.join(bounds, [*on, "_quarter"]).filter(inside).drop("replaced_at", "_quarter")


def release_coherent_change(
    df: DataFrame, series: str, period: str, value: str, release: str, months: int = 1
) -> DataFrame:
    """Level minus the prior period's level inside one release, never across releases."""
    now = df.select(series, period, release, value)
    before = df.select(
        F.col(series), F.col(release), cal.shift_month_end(period, months).alias(period),
        F.col(value).alias("previous_value"),
    )
    joined = now.join(before, [series, period, release])
    return joined.withColumn("change", F.col(value) - F.col("previous_value"))


def check_continuity(
    df: DataFrame, series: str, period: str, months: int = 1, release: str | None = None
) -> DataFrame:
    """Periods that do not follow the one before, and releases that do not rise."""
    rows = df.groupBy(series, period).agg(
        *([F.max(release).alias("_rel")] if release else [F.lit(None).cast("date").alias("_rel")])
    )
    w = Window.partitionBy(series).orderBy(period)
    seen = rows.select(
        series, period, F.lag(period).over(w).alias("previous_period"), F.col("_rel"),
        F.lag("_rel").over(w).alias("_prel"),
    ).filter(F.col("previous_period").isNotNull())
    problem = F.when(
        F.col(period) != cal.shift_month_end("previous_period", months), "gap"
    ).when(F.col("_rel") <= F.col("_prel"), "release order")
    return seen.withColumn("problem", problem).filter("problem is not null").select(
        series, period, "previous_period", "problem"
    )


def target_history(
    df: DataFrame,
    t: date | datetime | str,
    series: str = "series_id",
    period: str = "obs_period",
    value: str = "value",
    release: str = "release_date",
    start: date | str | None = None,
    schedule: DataFrame | None = None,
) -> DataFrame:
    """First prints known at `t`. With a schedule only releases on it count, and gaps are allowed.

    The start filter comes last, as the checks look at the whole history.
    """
    known = as_of(df, t, release)
    if schedule is not None:
        known = known.join(schedule.select(period, release).distinct(), [period, release],
                           "left_semi")
    rows = exact_dedupe(known, [series, period, value, release])
    return rows.filter(F.col(period) >= F.lit(start).cast("date")) if start else rows


def target_history_violations(
    df: DataFrame,
    t: date | datetime | str,
    series: str = "series_id",
    period: str = "obs_period",
    value: str = "value",
    release: str = "release_date",
    schedule: DataFrame | None = None,
) -> DataFrame:
    """What makes the history unusable: conflicts, repeats, early releases, gaps, off-schedule."""
    known = as_of(df, t, release)
    cols = [series, period]

    def tag(d: DataFrame, problem: str | Column) -> DataFrame:
        p = F.lit(problem) if isinstance(problem, str) else problem
        return d.select(series, period, p.alias("problem"))

    per_key = known.groupBy(*cols).agg(
        F.min(release).alias("r0"), F.max(release).alias("r1"),
        F.min(value).alias("v0"), F.max(value).alias("v1"),
    )
    problem = (
        F.when((F.col("r0") == F.col("r1")) & (F.col("v0") != F.col("v1")), "conflicting values")
        .when(F.col("r0") != F.col("r1"), "several releases")
        .when(F.to_date("r0") <= F.col(period), "released before period end")
    )
    out = tag(per_key, problem).filter("problem is not null")
    if schedule is None:
        gaps = check_continuity(known, series, period, 1, release)
        return out.unionByName(gaps.select(series, period, "problem"))
    off = known.join(schedule.select(period, release).distinct(), [period, release], "left_anti")
    return out.unionByName(tag(off.dropDuplicates(cols), "off schedule"))


def shared_latest_vintage(
    df: DataFrame, t: date | datetime | str, series: str = "series_id",
    release: str = "release_date", series_set: Sequence[str] | None = None,
) -> DataFrame:
    """The one latest release the series share; null, with the spread, when they differ."""
    known = as_of(df, t, release)
    if series_set is not None:
        known = known.filter(F.col(series).isin(list(series_set)))
    per_series = known.groupBy(series).agg(F.max(release).alias("r"))
    same = F.min("r") == F.max("r")
    return per_series.agg(
        F.count(F.lit(1)).alias("series_count"),
        F.min("r").alias("earliest_latest"),
        F.max("r").alias("latest_latest"),
        F.when(same, F.max("r")).alias("shared_release"),
    )


def forecast_origin(
    targets: DataFrame, releases: DataFrame, keys: Sequence[str],
    target_release: str = "release_at", release: str = "release_date",
) -> DataFrame:
    """Last input release strictly before the target's own release."""
    r = releases.select(*keys, release).distinct().withColumn("origin", F.col(release))
    return as_of_join(targets, r, keys, target_release, release, ["origin"], strict=True)


def period_cutoff(df: DataFrame, t: date | str, period: str = "obs_period") -> DataFrame:
    """Replay of a frozen snapshot: valid time, not knowledge time, is cut."""
    return df.filter(F.col(period) <= F.lit(t).cast("date"))


def revision_log(
    df: DataFrame, keys: Sequence[str], value: str = "value", release: str = "release_date"
) -> DataFrame:
    """Successive vintages of one period with their change."""
    rows = df.groupBy(*keys, release).agg(F.max(value).alias(value))
    w = Window.partitionBy(*keys).orderBy(release)
    return rows.select(
        *keys, release, value,
        F.row_number().over(w).alias("vintage_no"),
        (F.col(value) - F.lag(value).over(w)).alias("revision"),
    )


def latest_complete_group(
    df: DataFrame, t: date | datetime | str, series: str = "series_id",
    period: str = "obs_period", value: str = "value", release: str = "release_date",
    series_set: Sequence[str] | None = None,
) -> DataFrame:
    """Newest quarter in which every series has each of its months once: sums and vintage."""
    known = as_of(df, t, release)
    if series_set is not None:
        known = known.filter(F.col(series).isin(list(series_set)))
        wanted = F.lit(len(set(series_set)))
    else:
        wanted = known.agg(F.count_distinct(series)).scalar()
    per_series = known.groupBy(series, cal.quarter_end(period).alias("quarter_end")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.month(period) % 3 == i).alias(f"m{i}") for i in range(3)],
        F.sum(value).alias("total"),
        F.max(release).alias("vintage"),
    )
    whole = per_series.filter("n = 3 and m0 = 1 and m1 = 1 and m2 = 1")
    complete = whole.groupBy("quarter_end").agg(
        F.count(F.lit(1)).alias("series_count"), F.max("vintage").alias("data_vintage")
    ).filter(F.col("series_count") == wanted)
    newest = complete.agg(F.max("quarter_end")).scalar()
    picked = complete.filter(F.col("quarter_end") == newest)
    return whole.join(picked, "quarter_end").select(
        cal.quarter_label("quarter_end").alias("quarter"), "quarter_end", series, "total",
        "data_vintage",
    )
