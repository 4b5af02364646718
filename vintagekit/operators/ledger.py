"""Append-only ledgers of predictions, grades and publications.

A ledger step never edits rows: it splits the incoming ones into append, present and conflict, and
the caller writes the first part only when the third is empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.functions import keys as k
from vintagekit.operators import contracts as c
from vintagekit.operators import pit

NUMBERS = ("point", "low80", "high80", "low95", "high95")
PENDING, GRADED = "PENDING_FIRST_PRINT", "GRADED"
IDENTITY = ("model_version", "inputs_hash", "target_series", "target_period")
TOLERANCE = 1e-9


def to_predictions(forecasts: DataFrame, places: int = 9) -> DataFrame:
    """Forecast rows to ledger records: rounded numbers, id from the identity fields, status."""
    rounded = k.canonical_round(forecasts, NUMBERS, places)
    return rounded.select(
        k.record_id(list(IDENTITY), "prd_").alias("prediction_id"), "made_at", *IDENTITY, *NUMBERS,
        F.lit(PENDING).alias("status"),
    )


def prediction_rules() -> dict[str, Column]:
    return {
        "id form": F.col("prediction_id").rlike("^prd_[0-9a-f]{64}$"),
        "month end": F.col("target_period") == F.last_day("target_period"),
        "finite": c.is_finite("point") & c.is_finite("low95") & c.is_finite("high95"),
        "nested": (F.col("low95") <= F.col("low80")) & (F.col("low80") <= F.col("point"))
        & (F.col("point") <= F.col("high80")) & (F.col("high80") <= F.col("high95")),
        "status": F.col("status") == PENDING,
    }


def check_predictions(predictions: DataFrame) -> DataFrame:
    return c.check_rows(predictions, prediction_rules())


def split_append(
    new: DataFrame, ledger: DataFrame, key: str, content: Sequence[str], first: str | None = None
) -> DataFrame:
    """Incoming rows with `outcome`: append, present, or conflict.

    Same key and same content is a no-op that keeps the stored row, with its first time. Incoming
    repeats of a key collapse to the earliest one, unless their content differs.
    """
    text = k.row_hash(list(content))
    order = [c_ for c_ in ([first] if first else []) if c_] + list(content)
    names = new.columns
    rest = [n for n in names if n != key]
    one = new.withColumn("_h", text).groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"),
        F.min("_h").alias("_h0"), F.max("_h").alias("_h1"))
    stored = ledger.select(key, text.alias("_stored"))
    outcome = (
        F.when(F.col("_h0") != F.col("_h1"), "conflict")
        .when(F.col("_stored").isNull(), "append")
        .when(F.col("_stored") == F.col("_h0"), "present")
        .otherwise("conflict")
    )
    return one.join(stored, key, "left").select(
        key, *[F.col(f"_row.{n}").alias(n) for n in rest], outcome.alias("outcome"))


def append_predictions(new: DataFrame, ledger: DataFrame, places: int = 9) -> DataFrame:
    """Outcome of each incoming prediction; `made_at` is not content, so the first one is kept."""
    scaled = [F.round(F.col(n) * 10**places).cast("decimal(38,0)") for n in NUMBERS]

    def with_text(df: DataFrame) -> DataFrame:
        return df.withColumn("_content", k.row_hash([*IDENTITY, "status", *scaled]))

    return split_append(with_text(new), with_text(ledger), "prediction_id", ["_content"],
                        "made_at").drop("_content")


def grade_outcomes(
    predictions: DataFrame, targets: DataFrame, grades: DataFrame, t: date | datetime | str,
    series: str = "series_id", period: str = "obs_period", value: str = "value",
    release: str = "release_date", url: str = "source_url",
) -> DataFrame:
    """Every prediction with its outcome: append, present, not matured, released too early, or a
    target that is there more than once, which is never graded."""
    actual = targets.groupBy(
        F.col(series).alias("target_series"), F.col(period).alias("target_period")).agg(
        F.min_by(value, release).alias("actual_first_print"), F.min(release).alias("_rel"),
        F.min_by(url, release).alias("vintage_url"), F.count("*").alias("_targets"))
    done = grades.select("prediction_id", F.lit(True).alias("_done"))
    rows = predictions.join(actual, ["target_series", "target_period"], "left").join(
        done, "prediction_id", "left")
    due = F.col("_rel") <= pit.boundary_literal(targets, release, t)
    outcome = (
        F.when(F.col("_rel").isNull() | ~due, "not matured")
        .when(F.col("_rel") <= F.col("made_at"), "released before prediction")
        .when(F.col("_done"), "present")
        .when(F.col("_targets") > 1, "repeated target")
        .otherwise("append")
    )
    return rows.select(
        "prediction_id", "target_series", "target_period", "actual_first_print", "vintage_url",
        F.abs(F.col("point") - F.col("actual_first_print")).alias("abs_error"),
        F.col("_rel").alias("graded_at"), outcome.alias("outcome"))


def grade_matured(
    predictions: DataFrame, targets: DataFrame, grades: DataFrame, t: date | datetime | str,
    **names: str,
) -> tuple[DataFrame, DataFrame]:
    """New grades, and the counts of matured open predictions attempted and of every outcome."""
    rows = grade_outcomes(predictions, targets, grades, t, **names)
    new = rows.filter("outcome = 'append'").select(
        "prediction_id", "actual_first_print", "vintage_url", "abs_error", "graded_at")
    return new, grade_counts(rows)


def grade_counts(rows: DataFrame) -> DataFrame:
    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return rows.agg(
        F.count_if(F.col("outcome").isin(
            "append", "repeated target", "released before prediction")).alias("attempted"),
        n("append").alias("appended"),
        n("present").alias("already_present"), n("not matured").alias("not_matured"),
        n("released before prediction").alias("invalid"),
        n("repeated target").alias("repeated_target"))


def verify_regrade(
    predictions: DataFrame, grades: DataFrame, targets: DataFrame,
    series: str = "series_id", period: str = "obs_period", value: str = "value",
    release: str = "release_date", url: str = "source_url",
) -> DataFrame:
    """Stored grades that a fresh grading does not reproduce, and why."""
    actual = targets.select(
        F.col(series).alias("target_series"), F.col(period).alias("target_period"),
        F.col(value).alias("_actual"), F.col(release).alias("_rel"), F.col(url).alias("_url"))
    rows = grades.join(predictions.select("prediction_id", "target_series", "target_period",
                                          "point"), "prediction_id", "left").join(
        actual, ["target_series", "target_period"], "left")
    problem = (
        F.when(F.col("target_series").isNull(), "no prediction")
        .when(F.col("_actual").isNull(), "no first print")
        .when(F.abs(F.col("_actual") - F.col("actual_first_print")) > TOLERANCE, "value differs")
        .when(~F.col("_url").eqNullSafe(F.col("vintage_url")), "vintage differs")
        .when(F.abs(F.abs(F.col("point") - F.col("_actual")) - F.col("abs_error")) > TOLERANCE,
              "error differs")
        .when(~F.col("_rel").eqNullSafe(F.col("graded_at")), "time differs")
    )
    return rows.select("prediction_id", problem.alias("problem")).filter("problem is not null")


def append_publications(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """The first publication of an id wins; a later one is a no-op."""
    rest = [n for n in new.columns if n != "prediction_id"]
    one = new.groupBy("prediction_id").agg(
        F.min_by(F.struct(*rest), F.struct("published_at", *[r for r in rest
                                                             if r != "published_at"])).alias("r"))
    fresh = one.join(ledger.select("prediction_id"), "prediction_id", "left_anti")
    return fresh.select("prediction_id", *[F.col(f"r.{n}").alias(n) for n in rest])


def check_publications(publications: DataFrame, predictions: DataFrame) -> DataFrame:
    """A publication needs its prediction, a vintage no later than itself, and the order made, published."""
    rows = publications.join(predictions.select("prediction_id", "made_at"), "prediction_id",
                             "left")
    return c.check_rows(rows, {
        "prediction known": F.col("made_at").isNotNull(),
        "vintage before publication": F.col("data_vintage") <= F.col("published_at"),
        "published after made": F.col("published_at") >= F.col("made_at"),
    })


def scoreboard(
    predictions: DataFrame, grades: DataFrame, publications: DataFrame, mode: str = "live"
) -> DataFrame:
    """Predictions with grade and publication; order by made_at, prediction_id when shown."""
    if mode not in ("live", "preview"):
        raise ValueError("mode must be live or preview")
    rows = predictions.join(grades, "prediction_id", "left").join(
        publications, "prediction_id", "left")
    status = F.when(F.col("graded_at").isNotNull(), GRADED).otherwise(F.col("status"))
    return rows.withColumn("status", status).withColumn("publication_mode", F.lit(mode))


def grading_job(
    predictions: DataFrame, grades: DataFrame, families: Sequence[DataFrame],
    t: date | datetime | str, **names: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All target families at once: new grades, counts with the latest graded time, violations."""
    targets = families[0]
    for more in families[1:]:
        targets = targets.unionByName(more)
    rows = grade_outcomes(predictions, targets, grades, t, **names)
    new = rows.filter("outcome = 'append'").select(
        "prediction_id", "actual_first_print", "vintage_url", "abs_error", "graded_at")
    counts = grade_counts(rows).withColumn("latest_graded_at", new.agg(F.max("graded_at")).scalar())
    bad = verify_regrade(predictions, grades.unionByName(new.select(*grades.columns)), targets,
                         **names)
    return new, counts, bad


def event_feed(predictions: DataFrame, grades: DataFrame, changes: DataFrame) -> DataFrame:
    """Predictions, grades and change entries as one typed feed; newest first when shown."""
    p = predictions.select(
        F.concat(F.lit("prediction:"), "prediction_id").alias("event_id"),
        F.lit("prediction").alias("event_type"), F.col("made_at").alias("occurred_at"),
        F.concat_ws(" ", "target_series", F.col("target_period").cast("string")).alias("title"))
    g = grades.select(
        F.concat(F.lit("grade:"), "prediction_id").alias("event_id"),
        F.lit("grade").alias("event_type"), F.col("graded_at").alias("occurred_at"),
        F.col("prediction_id").alias("title"))
    x = changes.select(
        F.concat(F.lit("change:"), F.col("change_id").cast("string")).alias("event_id"),
        F.lit("change").alias("event_type"), F.col("changed_at").alias("occurred_at"),
        F.col("title"))
    return p.unionByName(g).unionByName(x)


def changelog_check(
    entries: DataFrame, baseline: DataFrame, key: str, position: str, at: str
) -> DataFrame:
    """Repeated ids, entries out of order, and baseline entries that are not a kept prefix."""
    same = entries.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        key, F.lit("repeated id").alias("problem"))
    step = entries.select(F.col(position).alias("_p"), F.col(at).alias("_at"), key)
    before = step.select((F.col("_p") + 1).alias("_p"), F.col("_at").alias("_prev"))
    late = step.join(before, "_p").filter("_at < _prev").select(
        key, F.lit("out of order").alias("problem"))
    cols = [c_ for c_ in baseline.columns if c_ != key]
    moved = c.append_only_superset(baseline, entries, [key], cols).filter("change <> 'added'")
    return same.unionByName(late).unionByName(
        moved.select(key, F.concat(F.lit("baseline "), "change").alias("problem")))


def resolve_refreshes(committed: DataFrame, runtime: DataFrame, key: Sequence[str]) -> DataFrame:
    """A runtime row wins over the committed row of the same source identity."""
    names = committed.columns
    both = committed.withColumn("_rank", F.lit(1)).unionByName(runtime.withColumn("_rank", F.lit(0)))
    rest = [n for n in names if n not in key]
    best = both.groupBy(*key).agg(F.min(F.struct("_rank", *rest)).alias("r"))
    return best.select(*key, *[F.col(f"r.{n}").alias(n) for n in rest]).select(*names)
