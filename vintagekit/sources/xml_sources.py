"""XML readers on Spark's own XML source, which reads a file in one task, gzip or not.

So what is written here as XML is cut into files of `FILE_ROWS` rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.operators import loans as ln
from vintagekit.sources.json_sources import string_schema

# Tape tags and the names they get.
TAPE_TAGS = {
    "assetNumber": "asset_number",
    "reportingPeriodBeginningDate": "period_start",
    "reportingPeriodEndingDate": "period_end",
    "originalLoanAmount": "original_amount",
    "originalInterestRatePercentage": "original_rate",
    "originalLoanTerm": "original_term",
    "reportingPeriodBeginningLoanBalanceAmount": "beginning_balance",
    "reportingPeriodActualEndBalanceAmount": "ending_balance",
    "reportingPeriodInterestRatePercentage": "reporting_rate",
    "remainingTermToMaturityNumber": "remaining_term",
    "assetAddedIndicator": "added",
    "recoveredAmount": "recovered",
}
FILE_ROWS = 100_000
DATES, TERMS, TEXTS = ("period_start", "period_end"), ("original_term", "remaining_term"), (
    "asset_number", "added")
SERIES_ATTRIBUTES = ("SERIES_NAME", "FREQ", "UNIT", "UNIT_MULT", "CURRENCY", "SA")


def _xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    return (spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true")
            .schema(schema).load(path))


def write_xml(rows: DataFrame, path: str, row_tag: str, root_tag: str, compression: str = "none") -> None:
    """One element a row, in files of `FILE_ROWS` rows at most, so that no reader's task grows."""
    rows.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).option(
        "compression", compression).option("maxRecordsPerFile", FILE_ROWS).save(path)


def read_loan_tape(
    spark: SparkSession, path: str, row_tag: str = "assets", spread: int | None = None,
    more: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per asset; an absent tag is null. `source_file` tells tapes apart.

    A gzip file is one task, so `spread` deals the rows out again before heavy work. `more`: tags that
    a tape has besides, and the names they get as texts (the trust of each asset, say, in files that
    hold many trusts).
    """
    more = dict(more or {})
    raw = _xml(spark, path, row_tag, string_schema([*TAPE_TAGS, *more]))
    cols = []
    for tag, name in TAPE_TAGS.items():
        text = F.trim(F.col(tag))
        if name in DATES:
            col = ln.parse_mixed_dates(text)
        elif name in TEXTS:
            col = F.lower(text) if name == "added" else text
        elif name in TERMS:
            col = text.try_cast("decimal(20,8)").cast("int")
        else:
            col = text.try_cast("decimal(20,8)")
        cols.append(col.alias(name))
    cols += [F.trim(F.col(tag)).alias(name) for tag, name in more.items()]
    rows = raw.select(F.input_file_name().alias("source_file"), *cols)
    return rows.repartition(spread) if spread else rows


def bad_tape_values(
    spark: SparkSession, path: str, row_tag: str = "assets"
) -> DataFrame:
    """Tape fields that are there but empty or not of their kind, counted by field."""
    raw = _xml(spark, path, row_tag, string_schema(list(TAPE_TAGS)))
    problems = []
    for tag, name in TAPE_TAGS.items():
        text = F.trim(F.col(tag))
        number = text.try_cast("decimal(20,8)")
        if name in DATES:
            good = ln.parse_mixed_dates(text).isNotNull()
        elif name == "added":
            good = F.lower(text).isin("true", "false")
        elif name == "asset_number":
            good = text != ""
        elif name in TERMS:
            good = number.isNotNull() & (number == F.floor(number))
        else:
            good = number.isNotNull() & (number >= 0)
        problems.append(F.when(text.isNotNull() & ~F.coalesce(good, F.lit(False)), F.lit(name)))
    return raw.select(F.explode(F.array_compact(F.array(*problems))).alias("field")).groupBy(
        "field").agg(F.count(F.lit(1)).alias("row_count"))


def read_fund_holdings(
    spark: SparkSession, path: str, row_tag: str = "invstOrSec"
) -> DataFrame:
    return _xml(spark, path, row_tag, string_schema(["name", "cusip", "lei"]))


def read_fund_header(spark: SparkSession, path: str, row_tag: str = "genInfo") -> DataFrame:
    """Registrant and report period of a holdings filing."""
    raw = _xml(spark, path, row_tag, string_schema(["regName", "regCik", "repPdDate"]))
    return raw.select("regName", "regCik", F.to_date("repPdDate").alias("report_period"))


def repeated_holdings(holdings: DataFrame) -> DataFrame:
    """(name, cusip) pairs listed more than once: the pair is the usable key."""
    return holdings.groupBy("name", "cusip").agg(F.count(F.lit(1)).alias("row_count")).filter(
        "row_count > 1")


def read_sdmx_xml(
    spark: SparkSession, path: str, row_tag: str = "Series",
    attributes: Sequence[str] = SERIES_ATTRIBUTES,
) -> DataFrame:
    """Series elements with their observations, one row per observation.

    `row_tag` is the tag as written, with its prefix if the file has one (`common:Series`).
    """
    note = T.StructType([T.StructField("AnnotationText", T.StringType())])
    obs = string_schema(["_TIME_PERIOD", "_OBS_VALUE", "_OBS_STATUS"])
    schema = T.StructType([
        *[T.StructField(f"_{a}", T.StringType()) for a in attributes],
        T.StructField("Annotations", T.StructType([
            T.StructField("Annotation", T.ArrayType(note))])),
        T.StructField("Obs", T.ArrayType(obs)),
    ])
    raw = _xml(spark, path, row_tag, schema)
    titles = F.filter(F.transform("Annotations.Annotation",
                                  lambda a: F.trim(a["AnnotationText"])), lambda s: s != "")
    rows = raw.select(
        F.col("_SERIES_NAME").alias("series_id"), F.try_element_at(titles, F.lit(1)).alias("title"),
        *[F.col(f"_{a}").alias(a.lower()) for a in attributes if a != "SERIES_NAME"],
        F.explode_outer("Obs").alias("_o"))
    value = F.col("_o._OBS_VALUE").try_cast("decimal(30,8)")
    problem = (
        F.when(F.col("series_id").isNull(), "no series name").when(
            F.col("title").isNull(), "no title").when(F.col("_o").isNull(), "no observations"))
    return rows.select(
        *[c for c in rows.columns if c != "_o"],
        F.to_date("_o._TIME_PERIOD").alias("obs_period"), value.alias("value"),
        F.col("_o._OBS_STATUS").alias("status"), problem.alias("problem"))
