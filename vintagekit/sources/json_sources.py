"""JSON readers. Each has a form for a frame of documents and one for files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.functions import text as tx

ENVELOPE_FIELDS = ("TableName", "SeriesCode", "LineNumber", "LineDescription", "CL_UNIT",
                   "UNIT_MULT", "TimePeriod", "DataValue")
FILING_ARRAYS = ("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (doc, text): one document each."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("doc"), F.col("value").alias("text"))


def parse_json_envelope(
    docs: DataFrame, doc: str = "doc", text: str = "text",
    fields: Sequence[str] = ENVELOPE_FIELDS,
) -> DataFrame:
    """Rows under BEAAPI.Results.Data, all text, with the value as a decimal.

    A document without rows, or with a structured error, yields one row with `problem` set.
    """
    row = "struct<" + ",".join(f"`{f}`:string" for f in fields) + ">"
    shape = f"struct<BEAAPI:struct<Results:struct<Data:array<{row}>,Error:string>>>"
    parsed = docs.select(doc, F.from_json(text, shape)["BEAAPI"]["Results"].alias("_r"))
    rows = F.coalesce("_r.Data", F.array().cast(f"array<{row}>"))
    flat = parsed.select(doc, "_r", F.explode_outer(rows).alias("_d"))
    value = tx.marked_number("_d.DataValue", tx.NULL_MARKS_COMMA, True)
    problem = (
        F.when(F.col("_r.Error").isNotNull(), "source error")
        .when(F.col("_d").isNull(), "no rows")
        .when(tx.is_bad_number("_d.DataValue", tx.NULL_MARKS_COMMA, True), "bad number"))
    month = F.regexp_extract_all("_d.TimePeriod", F.lit(r"^(\d{4})M(\d{2})$"), F.lit(0))
    period = F.when(F.size(month) == 1, F.last_day(F.to_date(
        F.regexp_replace("_d.TimePeriod", "M", "-"), "yyyy-MM")))
    return flat.select(doc, *[F.col(f"_d.{f}").alias(f) for f in fields],
                       period.alias("obs_period"), value.alias("value"),
                       problem.alias("problem"))


def read_json_envelope(spark: SparkSession, path: str, **kw) -> DataFrame:
    return parse_json_envelope(documents(spark, path), **kw)


def parse_header_first_json(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """JSON arrays whose first element names the columns: one row per later element as a map."""
    arrays = docs.select(doc, F.from_json(text, "array<array<string>>").alias("_a"))
    rows = arrays.select(
        doc, F.try_element_at("_a", F.lit(1)).alias("_h"),
        F.posexplode_outer(F.when(F.size("_a") > 1, F.slice("_a", 2, F.size("_a"))))
        .alias("row_no", "_v"))
    ok = F.size("_h") == F.size("_v")
    problem = F.when(F.col("_v").isNull(), "no rows").when(~ok, "row width differs")
    return rows.select(doc, "row_no", F.when(ok, F.map_from_arrays("_h", "_v")).alias("fields"),
                       problem.alias("problem"))


def read_header_first_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_header_first_json(documents(spark, path))


def header_first_values(rows: DataFrame, keep: Sequence[str], value: str = "cell_value"):
    """Named fields and the decimal value of header-first rows."""
    v = F.col("fields")[value]
    return rows.select(
        *[c for c in rows.columns if c not in ("fields", "problem")],
        *[F.col("fields")[k].alias(k) for k in keep],
        tx.marked_number(v, tx.NULL_MARKS_PLAIN, False).alias("value"),
        F.coalesce("problem", F.when(tx.is_bad_number(v, tx.NULL_MARKS_PLAIN, False),
                                     "bad number")).alias("problem"))


def explode_parallel_arrays(
    df: DataFrame, keys: Sequence[str], arrays: Sequence[str] = FILING_ARRAYS
) -> DataFrame:
    """Equal-length arrays to rows with their position; unequal lengths give one problem row."""
    sizes = [F.coalesce(F.size(a), F.lit(-1)) for a in arrays]
    same = F.least(*sizes) == F.greatest(*sizes)
    zipped = F.arrays_zip(*arrays)
    rows = df.select(*keys, same.alias("_same"),
                     F.posexplode_outer(F.when(same, zipped)).alias("position", "_z"))
    return rows.filter(~F.col("_same") | F.col("_z").isNotNull()).select(
        *keys, "position", *[F.col(f"_z.{a}").alias(a) for a in arrays],
        F.when(~F.col("_same"), "array lengths differ").alias("problem"))


# A bare number after "val"; quoting it keeps every digit through the parser.
BARE_VALUE = r'"val"(\s*):(\s*)(-?\d[\d.eE+-]*)'
FACT = ("struct<start:string,`end`:string,val:string,accn:string,fy:int,fp:string,form:string,"
        "filed:string,frame:string>")
FACTS = (f"struct<cik:string,entityName:string,facts:map<string,map<string,struct<label:string,"
         f"description:string,units:map<string,array<{FACT}>>>>>>")


def flatten_company_facts(
    docs: DataFrame, pinned: DataFrame | None = None, form: str = "10-K", doc: str = "doc",
    text: str = "text",
) -> DataFrame:
    """Namespace, tag, unit and facts to rows; the raw scalar stays text, so no digit is lost.

    `pinned` (doc, accession) keeps only that filing's facts of the form. `fact_index` counts
    within the unit before anything is dropped.
    """
    quoted = F.regexp_replace(text, BARE_VALUE, '"val"$1:$2"$3"')
    f = docs.select(doc, F.from_json(quoted, FACTS).alias("_f"))
    ns = f.select(doc, "_f.cik", "_f.entityName", F.explode("_f.facts").alias("namespace", "_t"))
    tags = ns.select(doc, "cik", "entityName", "namespace", F.explode("_t").alias("tag", "_m"))
    units = tags.select(doc, "cik", "entityName", "namespace", "tag", "_m.label",
                        "_m.description", F.explode("_m.units").alias("unit", "_u"))
    rows = units.select(
        doc, "cik", F.col("entityName").alias("entity_name"), "namespace", "tag", "label",
        "description", "unit", F.posexplode("_u").alias("fact_index", "_x"))
    out = rows.select(
        *[c for c in rows.columns if c != "_x"],
        F.to_date("_x.start").alias("period_start"), F.to_date("_x.end").alias("period_end"),
        F.col("_x.fy").alias("fiscal_year"), F.col("_x.fp").alias("fiscal_period"),
        F.col("_x.form").alias("form"), F.to_date("_x.filed").alias("filed_at"),
        F.col("_x.accn").alias("accession"), F.col("_x.frame").alias("frame"),
        F.col("_x.val").alias("value_json"))
    if pinned is None:
        return out
    want = pinned.select(doc, F.col("accession"))
    return out.filter(F.col("form") == form).join(want, [doc, "accession"], "left_semi")


def unread_company_facts(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Documents of which `flatten_company_facts` gives no row: not JSON, or without any fact."""
    quoted = F.regexp_replace(text, BARE_VALUE, '"val"$1:$2"$3"')
    units = F.flatten(F.transform(
        F.flatten(F.transform(F.map_values("_f.facts"), lambda tags: F.map_values(tags))),
        lambda tag: F.map_values(tag["units"])))
    facts = F.aggregate(units, F.lit(0), lambda n, u: n + F.coalesce(F.size(u), F.lit(0)))
    parsed = docs.select(doc, F.col(text).alias("_t"), F.from_json(quoted, FACTS).alias("_f"))
    return parsed.filter(F.coalesce(facts, F.lit(0)) <= 0).select(
        doc, F.when(F.col("_f.facts").isNull(), "unreadable").otherwise("no facts").alias("problem"))


def parse_call_report(
    docs: DataFrame, fields: Sequence[str], doc: str = "doc", text: str = "text"
) -> DataFrame:
    """Bank rows of call-report documents: the wrapper's data, with the declared total beside.

    A document that is empty or cannot be read stays as one row of nulls with `row_total` 0.
    """
    row = "struct<REPDTE:string,CERT:bigint," + ",".join(f"{f}:bigint" for f in fields) + ">"
    shape = f"struct<meta:struct<total:bigint>,data:array<struct<data:{row}>>>"
    parsed = docs.select(doc, F.from_json(text, shape).alias("_p"))
    return parsed.select(
        doc, F.col("_p.meta.total").alias("declared_total"),
        F.greatest(F.coalesce(F.size("_p.data"), F.lit(0)), F.lit(0)).cast("bigint")
        .alias("row_total"), F.explode_outer("_p.data").alias("_d"),
    ).select(doc, "declared_total", "row_total",
             F.to_date("_d.data.REPDTE", "yyyyMMdd").alias("report_date"),
             F.col("_d.data.CERT").alias("cert"),
             *[F.col(f"_d.data.{f}").alias(f) for f in fields])


def read_call_report_json(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    return parse_call_report(documents(spark, path), fields)


def call_report_violations(rows: DataFrame, fields: Sequence[str], doc: str = "doc") -> DataFrame:
    """Wrong totals, repeated certificates, several report dates, negative or absent amounts."""
    bad = F.lit(False)
    for f in fields:
        bad = bad | F.col(f).isNull() | (F.col(f) < 0)
    per_cert = rows.filter("row_total > 0").groupBy(doc, "cert").agg(F.count(F.lit(1)).alias("n"))
    repeats = per_cert.filter("n > 1").select(doc, F.lit("certificate repeated").alias("problem"),
                                              F.col("cert").cast("string").alias("detail"))
    per_doc = rows.groupBy(doc).agg(
        F.max("declared_total").alias("d"), F.max("row_total").alias("n"),
        F.min("report_date").alias("r0"), F.max("report_date").alias("r1"),
        F.count_if(bad & (F.col("row_total") > 0)).alias("bad"))
    checks = F.array_compact(F.array(
        F.when(~F.col("d").eqNullSafe(F.col("n")), F.lit("declared total differs")),
        F.when(F.col("r0") != F.col("r1"), F.lit("several report dates")),
        F.when(F.col("bad") > 0, F.lit("amount missing or negative"))))
    return per_doc.select(doc, F.explode(checks).alias("problem"),
                          F.col("n").cast("string").alias("detail")).unionByName(repeats)


def string_schema(fields: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])
