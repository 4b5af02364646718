"""Append-only tables and published versions.

One writer per table, as no table format with transactions is assumed. A batch lives in a folder
named by its content hash, so a repeated or restarted write lands on itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.functions import keys as k
from vintagekit.operators import contracts as c
from vintagekit.schemas import schema_for
from vintagekit.sources.tables import path_exists, read_table


# Folders of an identity index; a fixed number, as stored folders depend on it.
INDEX_PIECES = 64


@dataclass(frozen=True)
class Receipt:
    batch_id: str
    row_count: int
    already_present: bool


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in contract order and type; a value that does not convert raises when read."""
    c.require(c.check_columns(df, schema), "columns differ from the contract")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _content(schema: T.StructType, leave_out: Sequence[str] = ()) -> dict[str, Column]:
    """Each column as what identity is made of: lists as JSON text, all else as it is."""
    return {f.name: F.to_json(F.struct(f.name)) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in schema.fields if f.name not in leave_out}


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def append_batch(
    df: DataFrame, root: str, table: str, schema: T.StructType | None = None
) -> Receipt:
    """Content-addressed append; the same rows in any order are the same batch, and a no-op.

    The rows are written aside, the contract check, the hash and the count read what was written, and
    one rename commits it: what is stored is what was hashed, and the plan runs once. A run that ends
    early leaves nothing in the table.
    """
    spark = df.sparkSession
    schema = schema or schema_for(table)
    root = root.rstrip("/")
    aside = f"{root}/_aside/{table}-{uuid.uuid4().hex[:12]}"
    conform(df, schema).write.parquet(aside)
    fs, source = _hadoop(spark, aside)
    try:
        content = _content(schema)
        text = [content[n] for n in sorted(content)]
        needed = [f.name for f in schema.fields if not f.nullable]
        nulls = [F.count_if(F.col(n).isNull()).alias(f"_null_{n}") for n in needed]
        seen = spark.read.schema(schema).parquet(aside).withColumn("_h", k.row_hash(text)).agg(
            F.count(F.lit(1)).alias("n"), k.digest("_h").alias("h"), *nulls).first()
        bad = {n: seen[f"_null_{n}"] for n in needed if seen[f"_null_{n}"]}
        if bad:
            raise c.ContractError(f"{table}: null in required columns {bad}")
        path = f"{root}/{table}/batch_id={seen['h']}"
        if path_exists(spark, f"{path}/_SUCCESS"):
            return Receipt(seen["h"], seen["n"], True)
        _, target = _hadoop(spark, path)
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"cannot commit {path}")
        return Receipt(seen["h"], seen["n"], False)
    finally:
        fs.delete(source, True)


def append_new(
    df: DataFrame, root: str, table: str, identity: Sequence[str],
    schema: T.StructType | None = None, failures: str | None = None,
) -> Receipt | None:
    """Append the rows whose identity is new; a stored identity with other rows is a conflict.

    An index holds one content hash per stored identity, in folders by a piece of the identity's hash,
    so a batch reads only the index of its own pieces and the table itself is never read again. It is
    written after the batch: a crash in between is healed by the repeat, which finds the batch and
    writes the index. Lists are part of a row's content; when it was taken in is not. Copies within the
    input count once. A conflict raises, or with a `failures` path is recorded there while the rest
    goes on.
    """
    spark = df.sparkSession
    schema = schema or schema_for(table)
    content = _content(schema, ("ingested_at",))
    keyed = {n: f"_c{i}" for i, n in enumerate(content)}
    lists = [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)]
    rest = [n for n in schema.fieldNames() if n in lists or n == "ingested_at"]
    rows = conform(df, schema).withColumns({keyed[n]: content[n] for n in content}).groupBy(
        *[F.col(c_) for c_ in keyed.values()]).agg(
        *[F.any_value(n).alias(n) if n in lists else F.min(n).alias(n) for n in rest]
        or [F.lit(1).alias("_one")]).withColumns(
        {n: F.col(c_) for n, c_ in keyed.items() if n not in lists})
    rows = rows.withColumn("_h", k.row_hash(list(keyed.values()))).select(*schema.fieldNames(), "_h")
    piece = F.pmod(F.xxhash64(*[F.col(n).cast("string") for n in identity]), F.lit(INDEX_PIECES))
    ids = T.StructType([*[schema[n] for n in identity], T.StructField("content_hash", T.StringType()),
                        T.StructField("piece", T.LongType())])
    seen = rows.groupBy(*identity).agg(k.digest("_h").alias("content_hash")).withColumn("piece", piece)
    seen = seen.persist()
    try:
        # At most INDEX_PIECES numbers: the folders of the index that this batch has to read.
        asked = [r[0] for r in seen.select("piece").distinct().collect()]
        index = read_table(spark, root, f"{table}_index", ids).filter(F.col("piece").isin(asked))
        known = index.groupBy(*identity).agg(F.min("content_hash").alias("_stored"))
        both = [F.col(f"s.{n}").eqNullSafe(F.col(f"k.{n}")) for n in identity]
        state = seen.alias("s").join(known.alias("k"), both, "left").select("s.*", "_stored")
        bad = state.filter(F.col("_stored") != F.col("content_hash")).select(*identity)
        if failures is None:
            c.require(bad, f"{table}: conflicting batch")
        elif not bad.isEmpty():
            bad.write.mode("append").parquet(failures)
        fresh_ids = state.filter("_stored is null").select(*identity, "content_hash", "piece")
        if fresh_ids.isEmpty():
            return None
        new = [F.col(f"r.{n}").eqNullSafe(F.col(f"i.{n}")) for n in identity]
        fresh = rows.alias("r").join(fresh_ids.alias("i"), new, "left_semi").select(*schema.fieldNames())
        receipt = append_batch(fresh, root, table, schema)
        fresh_ids.repartition("piece").write.mode("overwrite").partitionBy("piece").parquet(
            f"{root.rstrip('/')}/{table}_index/batch_id={receipt.batch_id}")
        return receipt
    finally:
        seen.unpersist()


def compact_index(spark: SparkSession, root: str, table: str, ids: T.StructType) -> None:
    """Rewrite an index of many batches as one: aside first, then put in the others' place."""
    at = f"{root.rstrip('/')}/{table}_index"
    fs, source = _hadoop(spark, at)
    if not fs.exists(source):
        return
    old = [s.getPath() for s in fs.listStatus(source)]
    whole = spark.read.schema(ids).parquet(at).distinct().repartition("piece")
    aside = f"{root.rstrip('/')}/_aside/{table}_index-{uuid.uuid4().hex[:12]}"
    whole.write.partitionBy("piece").parquet(aside)
    # Both together are still a right index, so a stop between these steps loses nothing.
    name = f"{at}/batch_id=compact-{uuid.uuid4().hex[:12]}"
    if not fs.rename(_hadoop(spark, aside)[1], _hadoop(spark, name)[1]):
        raise OSError(f"cannot commit {name}")
    for path in old:
        fs.delete(path, True)


def stable_write(df: DataFrame, path: str, files: int = 8) -> str:
    """Rows in a total order on all non-list columns in a fixed number of files.

    Returns the content hash, which is the identity: file bytes may differ between writers.
    """
    order = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType)]
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode(
        "overwrite").parquet(path)
    return k.batch_hash(df.sparkSession.read.schema(df.schema).parquet(path), order).first()[
        "batch_hash"]


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Relative path, bytes and SHA-256 of every file below a path, marker files left out."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"),
                              r"^\Q" + root.rstrip("/") + r"\E/", "")
    return files.select(inside.alias("file"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))


def tree_hash(manifest: DataFrame) -> DataFrame:
    """One hash over all files; the path is part of each line, so no order is needed."""
    return manifest.select(k.row_hash(["file", "bytes", "sha256"]).alias("h"), "bytes").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"),
        k.digest("h").alias("tree_hash"))


POINTERS = "sequence bigint, version string, folder string"


def publish_atomically(df: DataFrame, root: str, version: str) -> None:
    """Build a folder of this attempt aside, then append a pointer row that names it.

    A failed build leaves the old version, and a repeat of a published version never touches its files.
    """
    spark = df.sparkSession
    root = root.rstrip("/")
    folder = f"data/version={version}/attempt={uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{root}/{folder}")
    at = f"{root}/pointers"
    last = 0
    if path_exists(spark, at):
        last = spark.read.schema(POINTERS).parquet(at).agg(F.max("sequence")).first()[0] or 0
    spark.createDataFrame([(last + 1, version, folder)], POINTERS).coalesce(1).write.mode(
        "append").parquet(at)


def _latest(spark: SparkSession, root: str) -> Row | None:
    at = f"{root.rstrip('/')}/pointers"
    if not path_exists(spark, at):
        return None
    newest = F.max_by(F.struct("version", "folder"), "sequence")
    return spark.read.schema(POINTERS).parquet(at).agg(newest).first()[0]


def published_version(spark: SparkSession, root: str) -> str | None:
    latest = _latest(spark, root)
    return latest["version"] if latest else None


def read_published(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The version the latest pointer names; none yet gives a typed empty frame."""
    latest = _latest(spark, root)
    if latest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{latest['folder']}")
