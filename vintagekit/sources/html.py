"""Tables in HTML pages: a parse per page spread over the cluster, then plain column work."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.functions import text as tx

# Fixed values.
HIDDEN = frozenset({"script", "style"})
SUM_TOLERANCE = 200
WEEK_AGE_DAYS = (1, 40)
MONTH_ABBREVIATIONS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct",
                       "nov", "dec")


class _Page(HTMLParser):
    """Collects (text before, rows of cell texts) of each outermost table."""

    def __init__(self, context_chars: int | None) -> None:
        super().__init__()
        self._reach = context_chars or 0
        self.found: list[tuple[str, list[list[str]]]] = []
        self._hidden = self._level = 0
        self._text: list[str] = []
        self._before = ""
        self._rows: list[list[str]] = []
        self._cell: list[str] | None = None

    def _close_cell(self) -> None:
        if self._cell is not None:
            text = " ".join("".join(self._cell).split())
            if text and self._rows:
                self._rows[-1].append(text)
            self._cell = None

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self._hidden += 1
        elif tag == "table":
            self._level += 1
            if self._level == 1:
                self._before = " ".join("".join(self._text).split())[-self._reach:]
                self._rows = []
        elif self._level == 1 and tag == "tr":
            self._close_cell()
            self._rows.append([])
        elif self._level == 1 and tag in ("td", "th"):
            self._close_cell()
            self._cell = []
        self._gap()

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self._hidden = max(self._hidden - 1, 0)
        elif tag == "table" and self._level:
            if self._level == 1:
                self._close_cell()
                rows = [r for r in self._rows if r]
                if rows:
                    self.found.append((self._before, rows))
            self._level -= 1
        elif self._level == 1 and tag in ("td", "th", "tr"):
            self._close_cell()
        self._gap()

    def handle_data(self, data):
        if not self._hidden:
            self._text.append(data)
            if self._cell is not None:
                self._cell.append(data)

    def _gap(self) -> None:
        self._text.append(" ")
        if self._cell is not None:
            self._cell.append(" ")


def _tables_of(
    html: str | None, context_chars: int | None = None
) -> list[tuple[str, list[list[str]]]]:
    page = _Page(context_chars)
    page.feed(html or "")
    page.close()
    return page.found


def extract_html_tables(
    pages: DataFrame, key: str = "page_id", html: str = "html", context_chars: int | None = None
) -> DataFrame:
    """(key, table_no, context, rows) of every outermost table, rows as arrays of cell texts.

    The context is all text before the table; `context_chars` keeps only its last characters.
    """
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, n, before, rows)
                   for k, h in zip(batch[key], batch[html], strict=True)
                   for n, (before, rows) in enumerate(_tables_of(h, context_chars), start=1)]
            yield pd.DataFrame(out, columns=[key, "table_no", "context", "rows"])

    schema = f"{key} {kind}, table_no int, context string, rows array<array<string>>"
    return pages.select(key, html).mapInPandas(parse, schema)


def table_text(rows: str | Column = "rows") -> Column:
    col = F.col(rows) if isinstance(rows, str) else rows
    return F.array_join(F.transform(col, lambda r: F.array_join(r, " ")), " ")


def table_cells(tables: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per table row: (key, table_no, row_no, cells)."""
    return tables.select(key, "table_no", F.posexplode("rows").alias("row_no", "cells"))


def choose_table(
    tables: DataFrame, anchor: str, terms: Sequence[str], key: str = "page_id"
) -> DataFrame:
    """Tables with the anchor before them and all terms inside, case folded; one per page.

    `match_count` other than one is an error.
    """
    inside = tx.fold(table_text())
    hit = F.contains(F.lower("context"), F.lit(anchor.lower()))
    for t in terms:
        hit = hit & F.contains(inside, F.lit(t.lower()))
    found = tables.filter(hit)
    counts = found.groupBy(key).agg(F.count(F.lit(1)).alias("match_count"))
    return found.join(counts, key)


def extract_metric_rows(
    tables: DataFrame, contracts: DataFrame, key: str = "page_id", source: str = "source",
    label: str = "period_label",
) -> DataFrame:
    """The number after each contract's label cell, for tables that fit the contract.

    `tables` also hold the source and the period label of their page. `contracts` hold source,
    metric, label, anchors (array), period_in_table, scale. `match_count` must be one; a negative
    value is a problem, never dropped.
    """
    inside = tx.fold(table_text())
    t = tables.select(
        key, source, "table_no", inside.alias("_inside"), tx.fold(label).alias("_period"),
        F.concat(tx.fold("context"), F.lit(" "), inside).alias("_all"),
        F.posexplode("rows").alias("row_no", "cells"))
    cells = t.select(key, source, "table_no", "row_no", "cells", "_all", "_inside", "_period",
                     F.posexplode("cells").alias("_at", "_cell"))
    wanted = contracts.select(source, "metric", "anchors", "period_in_table", "scale",
                              tx.fold(F.col("label")).alias("_label"))
    hits = cells.withColumn("_label", tx.fold("_cell")).join(wanted, [source, "_label"])
    hits = hits.filter(F.forall(
        "anchors", lambda a: F.contains(F.col("_all"), tx.fold(a))))
    hits = hits.filter(~F.col("period_in_table") | F.contains("_inside", F.col("_period")))
    after = F.slice("cells", F.col("_at") + 2, F.size("cells"))
    number = F.filter(F.transform(after, lambda c: tx.cell_number(c)), lambda x: x.isNotNull())
    value = F.try_element_at(number, F.lit(1)) * F.col("scale").cast("decimal(12,6)")
    rows = hits.select(key, source, "metric", "table_no", "row_no", value.alias("value"))
    counts = rows.groupBy(key, "metric").agg(F.count(F.lit(1)).alias("match_count"))
    problem = (
        F.when(F.col("match_count") != 1, "matched more than once")
        .when(F.col("value").isNull(), "no number").when(F.col("value") < 0, "negative"))
    return rows.join(counts, [key, "metric"]).withColumn("problem", problem)


def billions(c: Column) -> Column:
    """A number in billions as millions."""
    return tx.cell_number(c) * 1000


def extract_level_pair(
    tables: DataFrame, labels: Mapping[str, str], total: str, key: str = "page_id",
    target_header: str = "target_header",
) -> DataFrame:
    """Target and previous level per series of a release table, in millions, and their change.

    The target column is the one headed by the page's `target_header`; the previous level stands
    left of it. `labels` map row labels to series; `total` must equal the sum of the others.
    """
    head = F.col("rows")[0]
    at = F.array_position(F.transform(head, tx.fold), tx.fold(target_header))
    t = tables.select(key, at.alias("_at"), F.size(head).alias("_w"),
                      F.explode(F.slice("rows", 2, F.size("rows"))).alias("cells"))
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in
                           (pair[0].lower(), pair[1])])
    rows = t.withColumn("series_id", names[tx.fold(F.col("cells")[0])]).filter(
        F.col("series_id").isNotNull())

    def column(offset: int) -> Column:
        index = F.col("_at") - F.col("_w") + F.size("cells") + offset
        return billions(F.try_element_at("cells", index.cast("int")))

    pairs = rows.select(key, "series_id", F.when(F.col("_at") > 1, column(0)).alias("level"),
                        F.when(F.col("_at") > 1, column(-1)).alias("previous_level"))
    sign = F.when(F.col("series_id") == labels[total], 1).otherwise(-1)
    sums = pairs.groupBy(key).agg(
        F.sum(F.col("level") * sign).alias("_r1"), F.sum(F.col("previous_level") * sign)
        .alias("_r0"), F.count(F.lit(1)).alias("_n"))
    joined = pairs.join(sums, key)
    off = F.greatest(F.abs("_r1"), F.abs("_r0")) > SUM_TOLERANCE
    problem = (
        F.when(F.col("_n") != len(labels), "rows missing or repeated")
        .when(F.col("level").isNull() | F.col("previous_level").isNull(), "level unavailable")
        .when(off, "parts do not sum to total"))
    return joined.select(key, "series_id", "level", "previous_level",
                         (F.col("level") - F.col("previous_level")).alias("change"),
                         problem.alias("problem"))


def week_date(header: Column, release: Column) -> Column:
    """`Mon d` as the latest such date not after the release; null unless 1 to 40 days before."""
    low = tx.fold(header)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTH_ABBREVIATIONS]),
                             F.substring(low, 1, 3))
    day = F.regexp_extract(low, r"^[a-z]{3} (\d{1,2})$", 1).try_cast("int")

    def in_year(y: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y.cast("string"), month.cast("string"),
                                         day.cast("string")), "y-M-d")

    this = in_year(F.year(release))
    date = F.when(this <= release, this).otherwise(in_year(F.year(release) - 1))
    return F.when(F.datediff(release, date).between(*WEEK_AGE_DAYS), date)


def extract_weekly_block(
    tables: DataFrame, labels: Mapping[str, str], total: str, key: str = "page_id",
    release: str = "release_date", weeks: int = 4,
) -> DataFrame:
    """Long rows of the last four weekly columns of a release table, in millions.

    Week headers must be rising Wednesdays shortly before the release; the total must equal its
    parts in every week.
    """
    head = F.filter(F.col("rows")[0], lambda c: F.lower(c).rlike(r"^[a-z]{3}\s+\d{1,2}$"))
    dates = F.transform(head, lambda c: week_date(c, F.col(release)))
    good = (F.size(dates) == weeks) & F.forall(
        dates, lambda d: d.isNotNull() & (F.weekday(d) == 2)) & (
        F.array_sort(F.array_distinct(dates)) == dates)
    t = tables.select(key, release, dates.alias("_dates"), F.coalesce(good, F.lit(False))
                      .alias("_good"), F.explode(F.slice("rows", 2, F.size("rows")))
                      .alias("cells"))
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in
                           (pair[0].lower(), pair[1])])
    series = F.filter(F.transform("cells", lambda c: names[tx.fold(c)]), lambda s: s.isNotNull())
    rows = t.withColumn("series_id", F.try_element_at(series, F.lit(1))).filter(
        "series_id is not null")
    last = F.slice("cells", F.lit(-weeks), F.lit(weeks))
    long = rows.select(
        key, release, "series_id", "_good",
        F.inline(F.arrays_zip(F.col("_dates").alias("obs_period"), last.alias("_raw"))))
    long = long.select(key, release, "series_id", "_good", "obs_period",
                       billions(F.col("_raw")).alias("value"))
    sign = F.when(F.col("series_id") == labels[total], 1).otherwise(-1)
    sums = long.groupBy(key, "obs_period").agg(
        F.sum(F.col("value") * sign).alias("_r"), F.count(F.lit(1)).alias("_n"))
    problem = (
        F.when(~F.col("_good"), "bad week headers")
        .when(F.col("_n") != len(labels), "rows missing or repeated")
        .when(F.col("value").isNull(), "value unavailable")
        .when(F.abs("_r") > SUM_TOLERANCE, "parts do not sum to total"))
    return long.join(sums, [key, "obs_period"], "left").select(
        key, release, "series_id", "obs_period", "value", problem.alias("problem"))
