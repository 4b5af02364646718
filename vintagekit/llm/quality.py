"""Line-first cleaning in DataFrame expressions.

Every line is judged alone by punctuation, navigation and boilerplate rules; failing and repeated
lines go, and a document that loses too much text is rejected. One pass, no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.llm.common import SPACES, SPACE_CLASS, let

SYMBOLS = r"[#*$%&|<>]"
ENDINGS = r"""[.!?:;…"'”’)\]}>,。！？]$"""
SHOUTS = r"[!?]{2,}"
SEPARATORS = r"(^|[\x20\x09-\x0D])[|>»·•/]($|[\x20\x09-\x0D])"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "click here", "enable javascript", "subscribe to our newsletter", "sign up for our newsletter",
    "lorem ipsum",
)
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Integer thresholds, so that every engine decides alike."""

    min_words: int = 20
    repeat_percent: int = 30
    short_line_words: int = 4
    symbol_percent: int = 12
    shout_percent: int = 30
    separator_percent: int = 20
    min_separators: int = 2
    kept_percent: int = 50
    boilerplate_words: int = 30


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def word_list(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    clean = trimmed(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(
        F.split(clean, SPACE_CLASS + "+"))


def n_words(text: Column) -> Column:
    clean = trimmed(text)
    return F.when(clean == "", 0).otherwise(
        F.regexp_count(clean, F.lit(SPACE_CLASS + "+")) + 1)


def n_characters(text: Column) -> Column:
    """Code points that are no ASCII blank."""
    return F.length(F.translate(text, SPACES, ""))


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that stand twice or more in the list.

    Windows are compared by a 64-bit hash of their words' hashes. Lists with no repeated hash, most of
    them, end after one hashed set; the rest sort (hash, position), so time is n log n.
    """

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            return F.sort_array(F.filter(
                F.transform(s, lambda e, j: F.when(
                    (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"])),
                lambda p: p.isNotNull()))

        def length(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, j: F.least(
                    F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))).cast("long")),
                F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")) \
            .otherwise(let(let(order, positions), length))

    def windows(hashed: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashed) - width),
            lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(width)]))

    def counted(hashed: Column) -> Column:
        return F.when(F.size(hashed) < width, F.lit(0).cast("long")).otherwise(
            let(windows(hashed), covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), counted)


def any_of(text: Column, *parts: str) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in parts])


def line_fails(line: Column, rules: Rules) -> Column:
    """Punctuation, navigation and boilerplate rules of one line that holds a word.

    Each rule starts with a cheap search, so that ordinary lines are counted by none of them.
    """
    count = n_words(line)
    no_end = ~F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1)).rlike(ENDINGS)
    short = F.when(no_end, count <= rules.short_line_words)
    symbol_heavy = F.when(
        line.rlike(SYMBOLS), 100 * symbols(line) > rules.symbol_percent * n_characters(line))
    shouted = F.when(any_of(line, "!!", "!?", "?!", "??"), 100 * F.regexp_count(line, F.lit(SHOUTS))
                     > rules.shout_percent * count)
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    listed = F.when(
        any_of(line, *"|>»·•/"),
        (separators >= rules.min_separators) & (100 * separators > rules.separator_percent * count))
    boilerplate = F.when(let(F.lower(line), lambda x: any_of(x, *BOILERPLATE)), count <= rules.boilerplate_words)
    return F.coalesce(short, F.lit(False)) | F.coalesce(symbol_heavy, F.lit(False)) | F.coalesce(
        shouted, F.lit(False)) | F.coalesce(listed, F.lit(False)) | F.coalesce(
        boilerplate, F.lit(False))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules: Rules = Rules()) -> DataFrame:
    """One row per input row: base counts, the cleaned text, and whether the document is kept.

    Null and blank texts have no words, fail the base rule (fewer than `min_words` words) and are not
    kept. Repeated rows are judged alike and each returned. A line equal to an earlier passing line is
    removed. Other columns of the input do not matter and are not returned.
    """
    base = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).select(
        F.col(id_col), F.col("_text"),
        F.filter(F.split("_text", "\n"), has_word).alias("_lines"),
        word_list(F.col("_text")).alias("_words"))
    passing = F.array_distinct(F.filter("_lines", lambda x: ~line_fails(x, rules)))
    counted = base.select(
        F.col(id_col),
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.when(F.col("_text").rlike(SYMBOLS), symbols(F.col("_text"))).otherwise(0)
        .cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.array_join(passing, "\n").alias("clean_text"))
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    enough = 100 * n_words(F.col("clean_text")) >= rules.kept_percent * F.col("n_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)


def quality_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return clean_lines(df, id_col, text_col).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept")


def _sql() -> str:
    r = Rules()
    phrases = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
    ends = ENDINGS.replace("'", "''")
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda l: trim(l, {blank}) <> '') AS ls FROM d),
win AS (
  SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM b WHERE len(w) >= {WINDOW}),
ww AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM win),
rep AS (SELECT r, i FROM ww QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
cov AS (
  SELECT r, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM rep) GROUP BY r),
j AS (
  SELECT b.*, coalesce(n, 0)::BIGINT AS rw,
    list_distinct(list_filter(ls, lambda l: NOT (
      (NOT regexp_matches(trim(l, {blank}), '{ends}')
        AND len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) <= {r.short_line_words})
      OR 100 * len(regexp_extract_all(l, '{SYMBOLS}')) >
         {r.symbol_percent} * length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g'))
      OR 100 * len(regexp_extract_all(l, '{SHOUTS}')) >
         {r.shout_percent} * len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'))
      OR (len(regexp_extract_all(l, '{SEPARATORS}')) >= {r.min_separators}
        AND 100 * len(regexp_extract_all(l, '{SEPARATORS}')) >
         {r.separator_percent} * len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')))
      OR (({phrases})
        AND len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) <= {r.boilerplate_words})))) AS ok
  FROM b LEFT JOIN cov USING (r)),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, rw AS n_repeat_words,
    len(w) < {r.min_words} OR 100 * rw > {r.repeat_percent} * len(w) AS base_failed,
    100 * len(regexp_extract_all(array_to_string(ok, chr(10)), '[^\\x20\\x09-\\x0D]+')) >=
      {r.kept_percent} * len(w) AS enough
  FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND enough AS kept
FROM c
"""


SQL = _sql()
