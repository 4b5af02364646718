"""Shared pieces: words, ASCII case, folds by checksum, bounded samples and a bounded word cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagekit.session import materialize

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else; the fast path is for texts without other letters."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a computed array to a name inside an expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, by remainder; a null id gives null."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII blanks; null gives none.

    Bytes lower and split by exactly the ASCII rules.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most `rows` rows, the ones whose id hashes lowest; an id's rows are in or out together.

    The cut is found from counts of rows by twelve bits of the hash, then by the next twelve within
    the step at the cut, and so on, so that only counts reach the driver. The hashes are written once,
    as the rows may come from a long scan.
    """
    hashed = F.xxhash64(F.col(id_col).cast("string"))
    keys, key = materialize(df.select(hashed.alias("h")), "keys"), F.col("h")
    edge, within, taken = -(1 << 63), F.lit(True), 0
    for shift in (52, 40, 28, 16, 4):
        step = F.shiftright(key, shift)
        counts = {r["s"]: r["count"] for r in keys.where(within).groupBy(step.alias("s")).count().collect()}
        for s in sorted(counts):
            if taken + counts[s] > rows:
                edge, within = s << shift, step == s
                break
            taken += counts[s]
        else:
            edge = (max(counts) + 1) << shift if counts else edge
            break
    return df.where(hashed < F.lit(edge)) if edge < 1 << 63 else df
