"""Tables of the lake: strict schema, one series, a kept snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from vintagekit.schemas import schema_for


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whichever file system it names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_table(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """All committed batches of a table with its contract's schema; none gives a typed empty frame."""
    schema = schema or schema_for(name)
    path = f"{root.rstrip('/')}/{name}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def read_series(df: DataFrame, series_id: str, column: str = "series_id") -> DataFrame:
    """One series; the filter reaches the Parquet scan."""
    return df.filter(F.col(column) == series_id)


def cache_series(df: DataFrame) -> DataFrame:
    """Keep a snapshot that is read again and again; lost blocks are recomputed from its source."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
