"""Read queries over published feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TAIL = 1000


def latest_per_series(df: DataFrame, series: str, made_at: str, tie: str) -> DataFrame:
    """The newest row of each series; on equal times the least `tie` wins."""
    newest = df.groupBy(series).agg(F.max(made_at).alias("_at"))
    at = df.join(newest, series).filter(F.col(made_at) == F.col("_at"))
    rest = [c for c in df.columns if c != series]
    picked = at.groupBy(series).agg(F.min_by(F.struct(*rest), tie).alias("r"))
    return picked.select(series, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def tail(df: DataFrame, order: Sequence[str], n: int = MAX_TAIL) -> DataFrame:
    """Last n rows in feed order. The limit is the feature: a top-k, so nothing is fully sorted."""
    if not 1 <= n <= MAX_TAIL:
        raise ValueError(f"n must be 1 to {MAX_TAIL}")
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def lookup(df: DataFrame, column: str, key: str) -> DataFrame:
    """Case-insensitive point lookup; an absent key is one explicit row with found = false."""
    hit = df.filter(F.upper(column) == key.upper())
    asked = df.sparkSession.createDataFrame([(key,)], "_key string")
    joined = asked.join(hit, F.upper(F.col(column)) == F.upper(F.col("_key")), "left")
    found = F.col(column).isNotNull()
    return joined.select(
        *[F.coalesce(c, F.col("_key")).alias(c) if c == column else F.col(c) for c in df.columns],
        found.alias("found"))


def list_feed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)
