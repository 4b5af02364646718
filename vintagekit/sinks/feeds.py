"""Published feeds: files in three formats with their meta row, and the column documentation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("json", "csv", "parquet")
COMMON = {
    "methodology_version": ("string", "Version of the method the row was made with", 1),
    "data_vintage": ("timestamp", "Latest release among the inputs", 1),
    "published_at": ("timestamp", "First publication of the row", 1),
    "publication_mode": ("string", "live or preview", 1),
    "license": ("string", "Licence of the feed", 1),
}
_BAND = {
    "point": ("double", "Forecast of the first print", 1),
    "low80": ("double", "Lower end of the 80 percent band", 1),
    "high80": ("double", "Upper end of the 80 percent band", 1),
    "low95": ("double", "Lower end of the 95 percent band", 1),
    "high95": ("double", "Upper end of the 95 percent band", 1),
}
_PREDICTION = {
    "prediction_id": ("string", "Hash of the prediction's identity", 1),
    "made_at": ("timestamp", "When the prediction was first made", 1),
    "model_version": ("string", "Model that made it", 1),
    "inputs_hash": ("string", "Hash of the exact evidence used", 1),
    "target_series": ("string", "Series predicted", 1),
    "target_period": ("date", "Month end predicted", 1),
    **_BAND,
    "status": ("string", "PENDING_FIRST_PRINT or GRADED", 1),
}
_COMPANY = {
    "ticker": ("string", "Company", 1),
    "quarter": ("string", "Calendar quarter", 1),
    "low": ("double", "10th percentile of the share, percent", 1),
    "mid": ("double", "Median of the share, percent", 1),
    "high": ("double", "90th percentile of the share, percent", 1),
    "tier1_share": ("double", "Part of the median that rests on tier 1 evidence", 1),
    "tier2_share": ("double", "Part of the median that rests on tier 2 evidence", 1),
    "tier3_share": ("double", "Part of the median that rests on tier 3 evidence", 1),
    "assumption_ids": ("string", "Assumptions used, joined by a bar", 1),
    "sensitivity": ("string", "Strongest correlations as JSON", 1),
    "baseline_mid": ("double", "Median from broad categories alone, percent", 2),
    "lift": ("double", "Median over the broad-category median", 2),
    "lift_status": ("string", "evidence-supported or baseline-only", 2),
    "permalink": ("string", "Path of the company's page", 2),
}
# Column name: (type, description, feed version that added it).
FEEDS: dict[str, dict[str, tuple[str, str, int]]] = {
    "predictions": {**_PREDICTION, **COMMON},
    "scoreboard": {
        **_PREDICTION,
        "actual_first_print": ("double", "Value first released", 1),
        "abs_error": ("double", "Distance of the forecast from it", 1),
        "graded_at": ("timestamp", "Release of the first print", 1),
        "vintage_url": ("string", "Address of the release graded against", 1),
        **COMMON,
    },
    "companies": {**_COMPANY, **COMMON},
    "assumptions": {
        "assumption_id": ("string", "Assumption", 1),
        "statement": ("string", "What is assumed", 1),
        "value_low": ("double", "Least value of the prior", 1),
        "value_mid": ("double", "Most likely value of the prior", 1),
        "value_high": ("double", "Greatest value of the prior", 1),
        "tier": ("int", "Evidence tier, 1 to 3", 1),
        "source_url": ("string", "Evidence address", 1),
        "review_status": ("string", "State of the review", 2),
        **COMMON,
    },
    "company_history": {
        "ticker": ("string", "Company", 2),
        "label": ("string", "Refresh or snapshot", 2),
        "effective_at": ("timestamp", "Latest input of the row", 2),
        "low": ("double", "10th percentile, percent", 2),
        "mid": ("double", "Median, percent", 2),
        "high": ("double", "90th percentile, percent", 2),
        "status": ("string", "How revenue was updated", 2),
    },
    "events": {
        "event_id": ("string", "Kind and id of the event", 1),
        "event_type": ("string", "prediction, grade or change", 1),
        "occurred_at": ("timestamp", "When it happened", 1),
        "title": ("string", "One line about it", 1),
    },
}


def feed_struct(feed: str, version: int = 2) -> T.StructType:
    """A feed's schema with its documentation as column metadata; version 2 only adds columns."""
    fields = []
    for name, (kind, text, since) in FEEDS[feed].items():
        if since <= version:
            t = T.StructType.fromDDL(f"c {kind}")["c"].dataType
            fields.append(T.StructField(name, t, True, {"description": text, "since": since}))
    return T.StructType(fields)


def feed_schema(spark: SparkSession, version: int = 2) -> DataFrame:
    """Documentation rows of all feeds at a version."""
    rows = [
        (feed, i, f.name, f.dataType.simpleString(), f.metadata["description"],
         f.metadata["since"])
        for feed in FEEDS
        for i, f in enumerate(feed_struct(feed, version).fields, start=1)
    ]
    return spark.createDataFrame(
        rows, "feed string, position int, column_name string, column_type string, "
              "description string, since_version int")


def as_version(df: DataFrame, feed: str, version: int) -> DataFrame:
    """The columns of an older feed version, in documented order."""
    return df.select(*[n for n in feed_struct(feed, version).fieldNames() if n in df.columns])


def write_feed(df: DataFrame, path: str, fmt: str, meta: Mapping[str, str]) -> None:
    """Data files in one format, and beside them a one-row meta file with the row count."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    path = path.rstrip("/")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(f"{path}/data")
    elif fmt == "json":
        writer.option("ignoreNullFields", "false").json(f"{path}/data")
    else:
        writer.parquet(f"{path}/data")
    counted = df.agg(F.count(F.lit(1)).alias("row_count")).withColumns(
        {n: F.lit(v) for n, v in meta.items()})
    counted.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_feed(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType
) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(f"{path.rstrip('/')}/data")


def feed_columns(feed: str, version: int = 2) -> Sequence[str]:
    return feed_struct(feed, version).fieldNames()
