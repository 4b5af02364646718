"""Row text, content hashes, record ids and seeded uniform numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

NULL_TEXT = "~"
PIECES = 4
PIECE_HEX = 15


def row_text(cols: Sequence[str | Column]) -> Column:
    """Text of the columns in the given order, each field after its length.

    Different rows have different texts: lengths say where fields end, and a null is a mark that no
    field can be, as fields begin with a digit.
    """
    fields = []
    for c in cols:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        fields.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text),
                                 F.lit(NULL_TEXT)))
    return F.concat(*fields)


def row_hash(cols: Sequence[str | Column]) -> Column:
    return F.sha2(row_text(cols), 256)


def _piece(hash_col: Column, i: int) -> Column:
    part = F.substring(hash_col, 1 + i * PIECE_HEX, PIECE_HEX)
    return F.conv(part, 16, 10).cast("decimal(20,0)")


def digest(hash_col: str | Column, window: WindowSpec | None = None, salt: Column | None = None):
    """Order-free SHA-256 over a set of row hashes.

    The row hashes are added up piece by piece, so the digest is a plain sum: it combines on the
    map side, never sorts or collects, and works as a running total over a window.
    """
    h = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    sums = [F.sum(_piece(h, i)) for i in range(PIECES)]
    count = F.count(h)
    if window is not None:
        sums, count = [s.over(window) for s in sums], count.over(window)
    parts = [count.cast("string")]
    parts += [F.coalesce(s, F.lit(0)).cast("string") for s in sums]
    if salt is not None:
        parts.insert(0, salt)
    return F.sha2(F.concat_ws("|", *parts), 256)


def batch_hash(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()):
    """One content hash for the table (or one per `by` group), the same in any row order."""
    names = sorted(cols or [c for c in df.columns if c not in by])
    hashed = df.select(*by, row_hash(names).alias("h"))
    return hashed.groupBy(*by).agg(
        F.count("h").alias("row_count"), digest("h").alias("batch_hash")
    )


def record_id(cols: Sequence[str | Column], prefix: str = "prd_") -> Column:
    return F.concat(F.lit(prefix), row_hash(cols))


def canonical_round(df: DataFrame, cols: Sequence[str], places: int = 9) -> DataFrame:
    """Half-even rounding, so platform noise is not a change."""
    return df.withColumns({c: F.bround(F.col(c), places) for c in cols})


def inputs_hash(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    evidence: Sequence[str],
    label: str = "",
    out: str = "inputs_hash",
) -> DataFrame:
    """Hash of all strictly earlier evidence rows of the key, one per row, as a running sum."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    salt = row_text([F.lit(label), *order])
    hashed = df.withColumn("_row_hash", row_hash(evidence))
    return hashed.withColumn(out, digest("_row_hash", w, salt)).drop("_row_hash")


def receipt(df: DataFrame, cols: Sequence[str], out: str = "receipt_id") -> DataFrame:
    """Content-addressed id of each event row."""
    return df.withColumn(out, record_id(sorted(cols), "rcp_"))


def tampered_receipts(df: DataFrame, cols: Sequence[str], out: str = "receipt_id") -> DataFrame:
    """Rows whose stored id is not the hash of their content."""
    return df.filter(~F.col(out).eqNullSafe(record_id(sorted(cols), "rcp_")))


def uniform(*parts: str | Column) -> Column:
    """Uniform number in [0, 1) from the text of the parts: same parts, same number anywhere."""
    text = F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)
