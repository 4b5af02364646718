"""Ingest, grading, first prints and watermarks as file streams.

Every step is safe to repeat: batches are content-addressed, logs only grow, and a reader reduces
the log. A restart after a lost executor or driver replays the last micro-batch onto itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vintagekit.operators import ledger as lg
from vintagekit.operators import pit
from vintagekit.sinks import lake
from vintagekit.sources.tables import read_table


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_batches(
    stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None],
    mode: str = "append",
) -> StreamingQuery:
    """Handle all that is there now, batch by batch, and stop."""
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(step).start())


def ingest_stream(
    spark: SparkSession, path: str, root: str, table: str, checkpoint: str,
    identity: Sequence[str] = ("source_url", "checksum"), schema: T.StructType | None = None,
    files_per_trigger: int | None = None, failures: str | None = None,
) -> StreamingQuery:
    """Append each new release batch once; a stored identity with other rows stops the stream.

    With a `failures` path such identities are recorded there, and the stream goes on.
    """
    from vintagekit.schemas import schema_for

    schema = schema or schema_for(table)

    def step(batch: DataFrame, _: int) -> None:
        lake.append_new(batch, root, table, identity, schema, failures)

    return run_batches(file_stream(spark, path, schema, files_per_trigger), checkpoint, step)


GRADES = T.StructType([
    T.StructField("prediction_id", T.StringType()),
    T.StructField("actual_first_print", T.DoubleType()),
    T.StructField("vintage_url", T.StringType()),
    T.StructField("abs_error", T.DoubleType()),
    T.StructField("graded_at", T.DateType()),
])


def grade_stream(
    targets: DataFrame, predictions: DataFrame, root: str, checkpoint: str,
    t: date | datetime | str, schema: T.StructType = GRADES, **names: str,
) -> StreamingQuery:
    """Grade open predictions as first prints arrive; grades land in `root/grades` once each.

    Prints are stored in `root/targets` before they are graded against, so one that is not due yet, or
    whose prediction comes later, is looked at again by every later batch and run.
    """
    spark, prints = predictions.sparkSession, targets.schema

    def grade() -> None:
        known = read_table(spark, root, "targets", prints).distinct()
        stored = read_table(spark, root, "grades", schema)
        new, _counts = lg.grade_matured(predictions, known, stored, t, **names)
        if not new.isEmpty():
            lake.append_batch(new, root, "grades", schema)

    def step(batch: DataFrame, _: int) -> None:
        lake.append_batch(batch, root, "targets", prints)
        grade()

    grade()
    return run_batches(targets, checkpoint, step)


def first_print_stream(
    stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], order: Sequence[str],
    name: str = "first_prints",
) -> StreamingQuery:
    """Keep the first release per key whatever the order of arrival.

    A batch first shrinks to one candidate per key; those that beat the log are appended. Late
    earlier releases therefore win, where a watermark would drop them. Read with `first_prints`.
    """
    spark, schema = stream.sparkSession, stream.schema

    def step(batch: DataFrame, _: int) -> None:
        best = pit.first_print(batch, keys, order)
        known = first_prints(spark, root, schema, keys, order, name)
        old = known.select(*keys, F.struct(*order).alias("_old"))
        ahead = best.join(old, list(keys), "left").filter(
            F.col("_old").isNull() | (F.struct(*order) < F.col("_old"))).select(*schema.names)
        if not ahead.isEmpty():
            lake.append_batch(ahead, root, name, schema)

    return run_batches(stream, checkpoint, step)


def first_prints(
    spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str],
    order: Sequence[str], name: str = "first_prints",
) -> DataFrame:
    """The log reduced to the first release per key."""
    return pit.first_print(read_table(spark, root, name, schema), keys, order)


def watermark_stream(
    stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], time: str
) -> StreamingQuery:
    """Latest seen time per key, published as a new version after each batch."""
    latest = stream.groupBy(*keys).agg(F.max(time).alias("latest"))

    def step(batch: DataFrame, number: int) -> None:
        lake.publish_atomically(batch, root, f"{number:012d}")

    return run_batches(latest, checkpoint, step, "complete")
