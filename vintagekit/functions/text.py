"""Text helpers: numbers in cells, issuer names, whitespace."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not tell issuers apart.
COMPANY_WORDS = (
    r"\b(the|plc|nv|sa|ag|ltd|limited|holdings?|group|corporation|corp|company|co|"
    r"incorporated|inc|class [abc])\b"
)
# Texts that mean no value, by kind of source.
NULL_MARKS_COMMA = ("", "(NA)", "NA", "--")
NULL_MARKS_PLAIN = ("", "NA", "N", "S", "Z")


def squeeze(c: Column | str) -> Column:
    """Whitespace runs to one blank, ends trimmed."""
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(col, r"[\s\u00a0]+", " "))


def fold(c: Column | str) -> Column:
    return F.lower(squeeze(c))


def cell_number(c: Column | str, scale: float = 1) -> Column:
    """Number in a table cell: commas, $ and % dropped, (x) negative; null when it is none."""
    text = F.col(c) if isinstance(c, str) else c
    bare = F.trim(F.regexp_replace(text, r"[,$%]", ""))
    inner = F.regexp_extract(bare, r"^\(\s*(.*?)\s*\)$", 1)
    plain = bare.try_cast("decimal(30,8)")
    negative = -inner.try_cast("decimal(30,8)")
    number = F.when(inner != "", negative).otherwise(plain)
    return number * F.lit(scale).cast("decimal(12,6)") if scale != 1 else number


def marked_number(c: Column | str, null_marks: tuple[str, ...], commas: bool) -> Column:
    """Number text to an exact decimal; a null mark is null, other text is null too.

    Tell the two apart with `is_bad_number`.
    """
    text = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(text, ",", "") if commas else text
    return F.when(~text.isin(*null_marks), bare.try_cast("decimal(30,8)"))


def is_bad_number(c: Column | str, null_marks: tuple[str, ...], commas: bool) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    return ~text.isin(*null_marks) & marked_number(text, null_marks, commas).isNull()


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition with all that is not ASCII dropped; Spark has no built-in one."""

    @F.pandas_udf("string")
    def fold_batch(names: pd.Series) -> pd.Series:
        return names.map(
            lambda s: None if s is None
            else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())

    return fold_batch(c)


def normalize_issuer(c: Column | str) -> Column:
    """Lower-case letters and digits of a name, without company words."""
    low = F.regexp_replace(F.lower(ascii_fold(F.col(c) if isinstance(c, str) else c)), "&", " and ")
    return F.regexp_replace(F.regexp_replace(low, COMPANY_WORDS, " "), "[^a-z0-9]+", "")
