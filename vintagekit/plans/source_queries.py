"""Queries for readers, sinks and streams.

Files in each source shape are written by Spark from the given tables and read back, so the twin is
plain SQL over the tables.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagekit.functions import keys as k
from vintagekit.operators import contracts as c
from vintagekit.operators import loans as ln
from vintagekit.plans import ledger_queries as lq
from vintagekit.plans.attribution_queries import company_facts
from vintagekit.plans.loan_queries import AGG, KEYS, tape
from vintagekit.plans.registry import query
from vintagekit.plans.tables import cents
from vintagekit.schemas import schema_for
from vintagekit.session import materialize, scratch_path
from vintagekit.sinks import feeds, lake
from vintagekit.sources import html as hs
from vintagekit.sources import json_sources as js
from vintagekit.sources import release_text as rt
from vintagekit.sources import sheets as sh
from vintagekit.sources import tables as tb
from vintagekit.sources import xml_sources as xs
from vintagekit.streaming import incremental as inc

OBS_COLS = ["series_id", "obs_period", "value", "checksum"]
OBS_SQL = "SELECT series_id, obs_period, round(value, 8) AS value, checksum FROM observations"


def text_docs(t, docs, text="text"):
    """Documents as text files, one document a line, read back with their line."""
    path = scratch_path(t.spark, "docs")
    docs.select(text).write.text(path)
    return t.spark.read.text(path).select(F.col("value").alias("doc"),
                                          F.col("value").alias("text"))


def typed_observations(t):
    schema = schema_for("raw_observations")
    return t.observations.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                                   for f in schema.fields])


def shown(df):
    return df.select("series_id", "obs_period", F.round("value", 8).alias("value"), "checksum")


@query("r01_read_table", OBS_SQL, "observations")
def _(t):
    root = scratch_path(t.spark, "lake")
    rows = materialize(typed_observations(t), "rows")
    early = F.col("obs_period") < F.lit("1998-01-01").cast("date")
    lake.append_batch(rows.filter(early), root, "raw_observations")
    lake.append_batch(rows.filter(~early), root, "raw_observations")
    return shown(tb.read_table(t.spark, root, "raw_observations"))


@query("r02_read_series", OBS_SQL + " WHERE series_id = '3-MEDIUM'", "observations")
def _(t):
    return shown(tb.read_series(t.observations, "3-MEDIUM"))


@query("r03_cache_series", """
SELECT 'first' AS reading, count(*) AS row_count, CAST(sum(value_cents) AS BIGINT) AS total
FROM vintages UNION ALL SELECT 'again', count(*), CAST(sum(value_cents) AS BIGINT) FROM vintages
""", "vintages")
def _(t):
    kept = tb.cache_series(t.vintages)

    def total(name):
        return kept.agg(F.count(F.lit(1)).alias("row_count"),
                        F.sum("value_cents").alias("total")).select(
            F.lit(name).alias("reading"), "row_count", "total")

    return total("first").unionByName(total("again"))


@query("r04_read_json_envelope", """
SELECT series_id AS "SeriesCode", obs_period,
       CASE WHEN month(obs_period) = 7 THEN NULL ELSE CAST(value_cents AS DOUBLE) END AS value,
       CASE WHEN month(obs_period) = 8 THEN 'bad number' END AS problem
FROM monthly WHERE month(obs_period) <> 8 UNION ALL
SELECT series_id, obs_period, NULL, 'bad number' FROM monthly WHERE month(obs_period) = 8
""", "monthly")
def _(t):
    value = F.when(F.month("obs_period") == 7, "(NA)").when(
        F.month("obs_period") == 8, "n/a").otherwise(F.format_number("value_cents", 0))
    row = F.struct(
        F.lit("T1").alias("TableName"), F.col("series_id").alias("SeriesCode"),
        F.lit("6").alias("UNIT_MULT"),
        F.date_format("obs_period", "yyyy'M'MM").alias("TimePeriod"), value.alias("DataValue"))
    docs = t.monthly.groupBy("series_id").agg(F.to_json(F.struct(F.struct(F.struct(
        F.collect_list(row).alias("Data")).alias("Results")).alias("BEAAPI"))).alias("text"))
    return js.parse_json_envelope(text_docs(t, docs)).select(
        "SeriesCode", "obs_period", F.col("value").cast("double").alias("value"), "problem")


@query("r04_json_column", """
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events
""")
def _(t):
    return t.events.select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


@query("r05_read_header_first_json", """
SELECT series_id, CAST(obs_period AS VARCHAR) AS "time",
       CASE WHEN month(obs_period) <> 7 THEN CAST(value_cents AS DOUBLE) END AS value,
       CAST(NULL AS VARCHAR) AS problem FROM monthly
""", "monthly")
def _(t):
    value = F.when(F.month("obs_period") == 7, "NA").otherwise(F.col("value_cents").cast("string"))
    row = F.array("series_id", F.col("obs_period").cast("string"), value)
    head = F.array(F.array(F.lit("category_code"), F.lit("time"), F.lit("cell_value")))
    docs = t.monthly.groupBy("series_id").agg(
        F.to_json(F.concat(head, F.collect_list(row))).alias("text"))
    rows = js.header_first_values(js.parse_header_first_json(text_docs(t, docs)),
                                  ["category_code", "time"])
    return rows.select(F.col("category_code").alias("series_id"), "time",
                       F.col("value").cast("double").alias("value"), "problem")


@query("r06_read_sdmx_xml", """
SELECT series_id, 'Orders ' || series_id AS title, '129' AS freq, obs_period,
       value_cents / 100 AS value, 'A' AS status, CAST(NULL AS VARCHAR) AS problem FROM monthly
""", "monthly")
def _(t):
    obs = F.struct(F.col("obs_period").cast("string").alias("_TIME_PERIOD"),
                   (F.col("value_cents") / 100).cast("decimal(20,2)").cast("string")
                   .alias("_OBS_VALUE"), F.lit("A").alias("_OBS_STATUS"))
    note = F.array(F.struct(F.concat(F.lit("Orders "), "series_id").alias("AnnotationText")))
    docs = t.monthly.groupBy(F.col("series_id").alias("_SERIES_NAME")).agg(
        F.max(F.lit("129")).alias("_FREQ"), F.first(F.struct(note.alias("Annotation")))
        .alias("Annotations"), F.collect_list(obs).alias("Obs"))
    path = scratch_path(t.spark, "sdmx")
    docs.write.format("xml").option("rowTag", "Series").option("rootTag", "DataSet").save(path)
    return xs.read_sdmx_xml(t.spark, path).select(
        "series_id", "title", "freq", "obs_period", F.col("value").cast("double").alias("value"),
        "status", "problem")


@query("r07_read_loan_tape", AGG, "tape")
def _(t):
    rows = tape(t).withColumns({"period_start": F.trunc("period_end", "month")})
    american = [F.date_format(c, "MM-dd-yyyy") for c in ("period_start", "period_end")]
    rows = rows.withColumns({"period_start": american[0], "period_end": american[1],
                             "assetTypeNumber": F.lit("sequential")})
    tags = [F.col(name).alias(tag) for tag, name in xs.TAPE_TAGS.items()]
    path = scratch_path(t.spark, "tape")
    # Files hold many trusts, each asset its own: a file a trust and task made millions of small ones.
    xs.write_xml(rows.select("assetTypeNumber", *tags, F.col("trust_id").alias("trustNumber")),
                 path, "assets", "assetData", "gzip")
    tape_rows = xs.read_loan_tape(t.spark, path, more={"trustNumber": "trust_id"}).withColumn(
        "trust_id", F.col("trust_id").cast("bigint"))
    out = ln.loan_aggregate(tape_rows, KEYS)
    return out.withColumns({f.name: F.col(f.name).cast("double") for f in out.schema.fields
                            if f.dataType.typeName() == "decimal"})


@query("r07_bad_tape_values", """
SELECT field, row_count FROM (
  SELECT 'period_end' AS field, count(*) FILTER (l_linenumber = 2) AS row_count FROM lineitem UNION ALL
  SELECT 'remaining_term', count(*) FILTER (l_linenumber = 3) FROM lineitem UNION ALL
  SELECT 'recovered', count(*) FILTER (l_linenumber = 4) FROM lineitem UNION ALL
  SELECT 'added', count(*) FILTER (l_linenumber = 5) FROM lineitem) WHERE row_count > 0
""")
def _(t):
    # A tape of all lines; each line number from two to five has one field of the wrong kind.
    no, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    rows = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("assetNumber"),
        F.when(no == 2, "soon").otherwise(F.date_format(F.to_date("l_shipdate"), "MM-dd-yyyy"))
        .alias("reportingPeriodEndingDate"),
        F.when(no == 3, F.concat(q, F.lit(".5"))).otherwise(q).alias("remainingTermToMaturityNumber"),
        F.when(no == 4, F.lit("-1")).otherwise(q).alias("recoveredAmount"),
        F.when(no == 5, "maybe").otherwise("true").alias("assetAddedIndicator"))
    path = scratch_path(t.spark, "bad_tape")
    xs.write_xml(rows, path, "assets", "assetData")
    return xs.bad_tape_values(t.spark, path)


@query("r08_read_fund_holdings", """
SELECT p_name AS name, lpad(CAST(p_size AS VARCHAR), 9, '0') AS cusip, count(*) AS row_count
FROM part GROUP BY ALL HAVING count(*) > 1
""")
def _(t):
    path = scratch_path(t.spark, "holdings")
    xs.write_xml(t.part.select(
        F.col("p_name").alias("name"), F.concat(F.lit("LEI"), "p_partkey").alias("lei"),
        F.lpad(F.col("p_size").cast("string"), 9, "0").alias("cusip"),
    ), path, "invstOrSec", "invstOrSecs")
    return xs.repeated_holdings(xs.read_fund_holdings(t.spark, path))


@query("r09_explode_parallel_arrays", """
SELECT o_orderkey // 50 AS doc, o_orderstatus AS form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR)
         AS "filingDate", CAST(o_orderkey AS VARCHAR) AS "accessionNumber",
       CAST(NULL AS VARCHAR) AS problem
FROM orders WHERE (o_orderkey // 50) % 7 <> 0 UNION ALL
SELECT DISTINCT o_orderkey // 50, NULL, NULL, NULL, 'array lengths differ' FROM orders
WHERE (o_orderkey // 50) % 7 = 0
""")
def _(t):
    key = F.expr("o_orderkey div 50")
    text = F.col("o_orderkey").cast("string")
    day = F.to_date("o_orderdate").cast("string")
    row = F.struct("o_orderstatus", day.alias("d"), text.alias("a"))
    docs = t.orders.groupBy(key.alias("doc")).agg(F.collect_list(row).alias("r"))
    cut = F.when(F.col("doc") % 7 == 0, F.size("r") - 1).otherwise(F.size("r"))
    docs = docs.select(
        "doc", F.col("r.o_orderstatus").alias("form"), F.col("r.d").alias("filingDate"),
        F.slice(F.col("r.a"), F.lit(1), cut).alias("accessionNumber"))
    out = js.explode_parallel_arrays(docs, ["doc"], ["form", "filingDate", "accessionNumber"])
    return out.drop("position")


@query("r10_flatten_company_facts", """
SELECT ticker AS doc, 'us-gaap' AS namespace, 'Revenues' AS tag, 'USD' AS unit,
       make_date(1999, 1, 1) AS period_start, e AS period_end, '10-K' AS form,
       ticker || '-1999-K' AS accession, CAST(v AS VARCHAR) AS value_json
FROM fact_ytd WHERE e = DATE '1999-12-31'
""", "fact_ytd")
def _(t):
    docs = fact_docs(t)
    pinned = docs.select("doc", F.concat("doc", F.lit("-1999-K")).alias("accession"))
    return js.flatten_company_facts(docs, pinned).select(
        "doc", "namespace", "tag", "unit", "period_start", "period_end", "form", "accession",
        "value_json")


@query("r10_unread_company_facts", """
SELECT DISTINCT ticker AS doc, CASE WHEN ticker < 'N03' THEN 'unreadable' ELSE 'no facts' END AS problem
FROM fact_ytd WHERE ticker < 'N05'
""", "fact_ytd")
def _(t):
    broken = F.when(F.col("doc") < "N03", F.substring("text", 2, 1000)).when(
        F.col("doc") < "N05", F.lit('{"cik":"1","facts":{}}')).otherwise(F.col("text"))
    return js.unread_company_facts(fact_docs(t).withColumn("text", broken))


def fact_docs(t):
    """A document of facts per company."""
    facts, _ = company_facts(t)
    item = F.struct(
        F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"),
        F.col("value").alias("val"),
        F.col("accession").alias("accn"), F.year("end").alias("fy"), "fp", "form",
        F.col("filed").cast("string").alias("filed"))
    units = F.create_map(F.lit("USD"), F.collect_list(item))
    tag = F.create_map(F.lit("Revenues"), F.struct(F.lit("Revenues").alias("label"),
                                                   units.alias("units")))
    return facts.groupBy("ticker").agg(F.to_json(F.struct(
        F.max(F.col("ticker")).alias("cik"), F.create_map(F.lit("us-gaap"), tag).alias("facts")))
        .alias("text")).select(F.col("ticker").alias("doc"), "text")


FIELDS = ("LNCON", "LNAUTO")


@query("r11_read_call_report_json", """
WITH r AS (SELECT c_custkey // 100 AS doc, c_custkey AS cert,
    CAST(round((c_acctbal + 1000) * 100) AS BIGINT) AS v FROM customer)
SELECT 'certificates' AS what, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM r UNION ALL
SELECT 'declared total differs', count(DISTINCT doc) + 2, 0 FROM r WHERE doc % 5 = 1 UNION ALL
SELECT 'amount missing or negative', count(DISTINCT doc), 0 FROM r WHERE v < 0
""")
def _(t):
    v = F.round((F.col("c_acctbal") + 1000) * 100).cast("bigint")
    row = F.struct(F.struct(F.lit("20010630").alias("REPDTE"), F.col("c_custkey").alias("CERT"),
                            v.alias("LNCON"), F.abs(v).alias("LNAUTO")).alias("data"))
    key = F.expr("c_custkey div 100")
    docs = t.customer.groupBy(key.alias("k")).agg(F.collect_list(row).alias("data"))
    total = F.size("data") + F.when(F.col("k") % 5 == 1, 1).otherwise(0)
    docs = docs.select(F.to_json(F.struct(F.struct(total.alias("total")).alias("meta"), "data"))
                       .alias("text"))
    # One document without rows, and one that is no JSON: both are missing what they declare.
    lost = t.spark.createDataFrame([('{"meta":{"total":5},"data":[]}',), ("no document",)], "text string")
    rows = js.parse_call_report(text_docs(t, docs.unionByName(lost)), FIELDS)
    seen = rows.agg(F.count("cert").alias("n"), F.sum("LNCON").alias("total")).select(
        F.lit("certificates").alias("what"), "n", "total")
    wrong = js.call_report_violations(rows, FIELDS).groupBy(F.col("problem").alias("what")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("total", F.lit(0).cast("bigint"))
    empty = t.spark.createDataFrame([(x,) for x in (
        "declared total differs", "amount missing or negative")], "what string")
    return seen.unionByName(empty.join(wrong, "what", "left").fillna(0, ["n", "total"]))


@query("r12_read_multi_schedule_csv", """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n,
                  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v
           FROM orders GROUP BY 1), c AS (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer)
SELECT 'both' AS what, count(*) AS reporters, CAST(sum(v) AS BIGINT) AS total FROM o JOIN c USING (k)
UNION ALL SELECT 'absent from a', count(*), 0 FROM c ANTI JOIN o USING (k)
UNION ALL SELECT 'absent from b', count(*), 0 FROM o ANTI JOIN c USING (k)
""")
def _(t):
    a, b = scratch_path(t.spark, "fs220"), scratch_path(t.spark, "fs220a")
    day = F.lit("6/30/2001 0:00:00").alias("CYCLE_DATE")
    t.orders.groupBy(F.col("o_custkey").alias("CU_NUMBER")).agg(
        F.sum(cents("o_totalprice")).alias("ACCT_1"), F.max(F.lit("6/30/2001")).alias("CYCLE_DATE")
    ).write.option("header", True).csv(a)
    t.customer.select(F.col("c_custkey").alias("CU_NUMBER"), day,
                      F.col("c_nationkey").alias("ACCT_2")).write.option("header", True).csv(b)
    rows = sh.read_multi_schedule_csv(t.spark, {"a": (a, ["ACCT_1"]), "b": (b, ["ACCT_2"])})
    both = rows.filter("in_a and in_b").agg(
        F.count(F.lit(1)).alias("reporters"), F.sum("ACCT_1").alias("total")).select(
        F.lit("both").alias("what"), "reporters", "total")
    bad = sh.schedule_violations(rows, ["a", "b"], "2001-06-30").groupBy(
        F.col("problem").alias("what")).agg(F.count(F.lit(1)).alias("reporters"))
    want = t.spark.createDataFrame([("absent from a",), ("absent from b",)], "what string")
    zero = F.lit(0).cast("bigint")
    return both.unionByName(want.join(bad, "what", "left").fillna(0, ["reporters"]).withColumn(
        "total", zero))


@query("r13_select_current_month_row", """
SELECT series_id, obs_period, value_cents AS amount, 1::BIGINT AS match_count FROM monthly
""", "monthly")
def _(t):
    return sh.select_current_month_row(statements(t), keys=["series_id"]).select(
        "series_id", "obs_period", "amount", "match_count")


@query("r13_statement_violations", """
SELECT series_id, obs_period, CASE WHEN month(obs_period) = 3 THEN 2 ELSE 0 END::BIGINT AS match_count
FROM monthly WHERE month(obs_period) IN (3, 5)
""", "monthly")
def _(t):
    # March rows stand twice, May rows are of another kind.
    rows = statements(t)
    month = F.month("obs_period")
    rows = rows.withColumn("data_type_cd", F.when(month == 5, "X").otherwise(F.col("data_type_cd")))
    rows = rows.unionByName(rows.filter((month == 3) & (F.col("classification_id") == "11")))
    chosen = sh.select_current_month_row(rows, keys=["series_id"])
    return sh.statement_violations(rows, chosen, keys=["series_id"])


def statements(t):
    """Each month as a statement: two fiscal years, the month under both, and a line to date."""
    fiscal = F.year("obs_period") + F.when(F.month("obs_period") >= 10, 1).otherwise(0)
    base = t.monthly.select("series_id", "obs_period", "value_cents", fiscal.alias("fy"))

    def row(cls, parent, desc, code, kind, amount):
        return F.struct(cls.alias("classification_id"), parent.alias("parent_id"),
                        desc.alias("classification_desc"), F.lit(code).alias("data_type_cd"),
                        F.lit(kind).alias("record_type_cd"), amount.alias("amount"))

    month = F.date_format("obs_period", "MMMM")
    no = F.lit(None).cast("string")
    return base.select("series_id", "obs_period", F.inline(F.array(
        row(F.lit("1"), no, F.concat(F.lit("FY "), "fy"), "T", "SUM", F.col("value_cents") * 9),
        row(F.lit("2"), no, F.concat(F.lit("FY "), (F.col("fy") - 1)), "T", "SUM",
            F.col("value_cents") * 8),
        row(F.lit("11"), F.lit("1"), month, "D", "MTH", F.col("value_cents")),
        row(F.lit("21"), F.lit("2"), month, "D", "MTH", F.col("value_cents") + 1),
        row(F.lit("12"), F.lit("1"), month, "D", "YTD", F.col("value_cents") + 2))))


@query("r14_unpivot_wide_sheet", """
SELECT series_id, last_day(CAST(date_trunc('quarter', obs_period) + INTERVAL 2 MONTH AS DATE))
         AS obs_period, CAST(sum(value_cents) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS problem
FROM monthly GROUP BY ALL
""", "monthly")
def _(t):
    return sh.unpivot_wide_sheet(wide_sheet(t))


@query("r14_sheet_lag_violations", """
WITH q AS (SELECT series_id, max(last_day(CAST(date_trunc('quarter', obs_period) + INTERVAL 2 MONTH AS DATE)))
             AS latest FROM monthly GROUP BY 1),
l(series_id, lag) AS (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 1), ('6-NONE', 1))
SELECT l.series_id, CAST(lag AS INTEGER) AS lag, latest,
       CAST(last_day(CAST(DATE '2001-12-31' - lag * INTERVAL 3 MONTH AS DATE)) AS DATE) AS expected
FROM l LEFT JOIN q USING (series_id)
WHERE latest IS DISTINCT FROM last_day(CAST(DATE '2001-12-31' - lag * INTERVAL 3 MONTH AS DATE))
""", "monthly")
def _(t):
    long = sh.unpivot_wide_sheet(wide_sheet(t)).filter("value is not null")
    return sh.sheet_lag_violations(
        long, "2001-12-31", {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 1, "6-NONE": 1})


def wide_sheet(t):
    """Quarters by priority, one column each."""
    names = [f"{i}-{n}" for i, n in enumerate(
        ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"), start=1)]
    label = F.concat(F.date_format("obs_period", "yy"), F.lit(":Q"),
                     F.quarter("obs_period").cast("string"))
    return t.monthly.groupBy(label.alias("period")).pivot("series_id", names).agg(F.sum("value_cents"))


@query("r15_extract_html_tables", """
SELECT page_id, CAST(t AS INTEGER) AS table_no, CAST(i - 1 AS INTEGER) AS row_no,
       trim(replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '&amp;', '&')) AS cell
FROM (SELECT page_id, 1 AS t, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS c,
             generate_subscripts(regexp_extract_all(html, '<li>(.*?)</li>', 1), 1) AS i FROM pages)
""")
def _(t):
    page = F.col("html")
    for a, b in (("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", "<tr><td>"),
                 ("</li>", "</td></tr>")):
        page = F.replace(page, F.lit(a), F.lit(b))
    tables = hs.extract_html_tables(t.pages.select("page_id", page.alias("html")))
    return hs.table_cells(tables).select("page_id", "table_no", "row_no",
                                         F.col("cells")[0].alias("cell"))


def tr(*cells):
    """A table row of cell columns."""
    parts = [F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells]
    return F.concat(F.lit("<tr>"), *parts, F.lit("</tr>"))


def text_of(c):
    return F.format_number(c, 2)


def metric_pages(t):
    """A page per month and priority with the month's figures as labelled rows."""
    name = F.date_format("obs_period", "MMMM d, yyyy")
    body = F.concat(
        F.lit("<p>Monthly report for "), name, F.lit("</p><table>"),
        tr(F.lit("Pool summary"), name),
        tr(F.lit("Ending  receivables"), F.lit("$"), text_of(F.col("value_cents") / 100)),
        tr(F.lit("Charge-off rate"), F.concat((F.month("obs_period") / 4).cast("string"),
                                              F.lit("%"))),
        tr(F.lit("Adjustment"), F.concat(F.lit("("), F.month("obs_period").cast("string"),
                                         F.lit(")"))),
        F.lit("</table><table>"), tr(F.lit("Other"), F.lit("1")), F.lit("</table>"))
    return t.monthly.select(
        k.row_hash(["series_id", "obs_period"]).alias("page_id"), "series_id", "obs_period",
        name.alias("period_label"), body.alias("html"))


@query("r16_extract_metric_rows", """
SELECT series_id, obs_period, 'receivables' AS metric, value_cents / 100 AS value,
       CAST(NULL AS VARCHAR) AS problem FROM monthly UNION ALL
SELECT series_id, obs_period, 'chargeoff', month(obs_period) / 4, NULL FROM monthly UNION ALL
SELECT series_id, obs_period, 'adjustment', CAST(-month(obs_period) AS DOUBLE), 'negative'
FROM monthly
""", "monthly")
def _(t):
    pages = metric_pages(t)
    tables = hs.extract_html_tables(pages).join(
        pages.select("page_id", "period_label", F.col("series_id").alias("source"), "obs_period"),
        "page_id")
    sources = t.monthly.select(F.col("series_id").alias("source")).distinct()
    rules = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(label).alias("label"),
                 F.array(F.lit("monthly report"), F.lit("Pool  Summary")).alias("anchors"),
                 F.lit(m == "receivables").alias("period_in_table"), F.lit(1.0).alias("scale"))
        for m, label in (("receivables", "ending receivables"), ("chargeoff", "Charge-off Rate"),
                         ("adjustment", "adjustment"))])
    out = hs.extract_metric_rows(tables, sources.select("source", F.inline(rules)))
    return out.join(pages.select("page_id", "series_id", "obs_period"), "page_id").select(
        "series_id", "obs_period", "metric", F.col("value").cast("double").alias("value"),
        "problem")


LEVELS = {"Total": "ALL", "Urgent": "FIRST", "Other": "REST"}


def level_pages(t):
    """A release page per month with this and the previous level of two parts and their total."""
    urgent = F.col("series_id") == "1-URGENT"
    m = t.monthly.groupBy("obs_period").agg(
        F.sum("value_cents").alias("a"), F.sum(F.when(urgent, F.col("value_cents"))).alias("u"))
    prev = m.select(F.last_day(F.add_months("obs_period", 1)).alias("obs_period"),
                    F.col("a").alias("pa"), F.col("u").alias("pu"))
    both = m.join(prev, "obs_period")

    def b(c):
        return (F.col(c) / 1000).cast("decimal(20,3)").cast("string")

    head = F.concat(F.date_format("obs_period", "MMM"), F.lit(" p"))
    rest = (((F.col("a") - F.col("u")) / 1000).cast("decimal(20,3)").cast("string"),
            ((F.col("pa") - F.col("pu")) / 1000).cast("decimal(20,3)").cast("string"))
    html = F.concat(
        F.lit("<p>Levels outstanding</p><table>"), tr(F.lit("Type"), F.lit("before r"), head),
        tr(F.lit("Total"), b("pa"), b("a")), tr(F.lit("Urgent"), b("pu"), b("u")),
        tr(F.lit("Other"), rest[1], rest[0]), F.lit("</table>"))
    return both.select(F.col("obs_period").cast("string").alias("page_id"),
                       head.alias("target_header"), html.alias("html"))


@query("r17_extract_level_pair", """
WITH m AS (SELECT obs_period, sum(value_cents) AS a,
                  sum(value_cents) FILTER (series_id = '1-URGENT') AS u FROM monthly GROUP BY 1),
p AS (SELECT m.obs_period, m.a, m.u, q.a AS pa, q.u AS pu FROM m
      JOIN m q ON m.obs_period = last_day(CAST(q.obs_period + INTERVAL 1 MONTH AS DATE)))
SELECT CAST(obs_period AS VARCHAR) AS page_id, s AS series_id, CAST(level AS DOUBLE) AS level,
       CAST(previous_level AS DOUBLE) AS previous_level,
       CAST(level - previous_level AS DOUBLE) AS change, CAST(NULL AS VARCHAR) AS problem
FROM (SELECT obs_period, 'ALL' AS s, a AS level, pa AS previous_level FROM p UNION ALL
      SELECT obs_period, 'FIRST', u, pu FROM p UNION ALL
      SELECT obs_period, 'REST', a - u, pa - pu FROM p)
""", "monthly")
def _(t):
    pages = level_pages(t)
    tables = hs.extract_html_tables(pages).join(pages.select("page_id", "target_header"),
                                                "page_id")
    out = hs.extract_level_pair(hs.choose_table(tables, "levels outstanding", ["total"]), LEVELS,
                                "Total")
    return out.withColumns({c: F.col(c).cast("double") for c in
                            ("level", "previous_level", "change")})


def week_pages(t):
    """A weekly release page with the last four weeks of two parts and their total."""
    last = t.weekly.filter("release_date = date_add(obs_period, 16)")
    urgent = F.col("series_id") == "1-URGENT"
    w = last.groupBy("obs_period").agg(
        F.sum("value_cents").alias("a"), F.sum(F.when(urgent, F.col("value_cents"))).alias("u"))
    near = w.select(
        F.explode(F.array(*[F.date_add("obs_period", 7 * i) for i in range(4)])).alias("last_week"),
        F.struct("obs_period", "a", "u").alias("v"))
    pages = near.groupBy("last_week").agg(F.sort_array(F.collect_list("v")).alias("v")).filter(
        "size(v) = 4")

    def cell(i, f):
        v = F.col("v")[i]
        x = {"a": v["a"], "u": v["u"], "r": v["a"] - v["u"]}[f]
        return (x / 1000).cast("decimal(20,3)").cast("string")

    heads = [F.date_format(F.col("v")[i]["obs_period"], "MMM d") for i in range(4)]
    rows = [tr(F.lit(str(n)), F.lit(label), *[cell(i, f) for i in range(4)])
            for n, label, f in ((15, "Total", "a"), (16, "Urgent", "u"), (17, "Other", "r"))]
    html = F.concat(F.lit("<table>"), tr(F.lit("Line"), F.lit("Account"), *heads), *rows,
                    F.lit("</table>"))
    return pages.select(F.col("last_week").cast("string").alias("page_id"),
                        F.date_add("last_week", 9).alias("release_date"), html.alias("html"))


@query("r18_extract_weekly_block", """
WITH w AS (SELECT obs_period, sum(value_cents) AS a,
                  sum(value_cents) FILTER (series_id = '1-URGENT') AS u
           FROM weekly WHERE release_date = obs_period + 16 GROUP BY 1),
p AS (SELECT CAST(obs_period + 7 * i AS DATE) AS last_week, obs_period, a, u FROM w
      CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, 4))),
g AS (SELECT last_week FROM p GROUP BY 1 HAVING count(*) = 4)
SELECT CAST(last_week AS VARCHAR) AS page_id, CAST(last_week + 9 AS DATE) AS release_date, series_id,
       obs_period, CAST(v AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS problem FROM (
  SELECT last_week, obs_period, 'ALL' AS series_id, a AS v FROM p UNION ALL
  SELECT last_week, obs_period, 'FIRST', u FROM p UNION ALL
  SELECT last_week, obs_period, 'REST', a - u FROM p) JOIN g USING (last_week)
""", "weekly")
def _(t):
    pages = week_pages(t)
    tables = hs.extract_html_tables(pages).join(pages.select("page_id", "release_date"), "page_id")
    out = hs.extract_weekly_block(tables, LEVELS, "Total")
    return out.withColumn("value", F.col("value").cast("double"))


@query("r19_extract_text_flow", """
SELECT series_id, obs_period AS target_period, CAST(CAST(obs_period + 15 AS DATE) AS TIMESTAMP)
         + INTERVAL 8 HOUR + INTERVAL 30 MINUTE + CASE WHEN zone = 'EDT' THEN 4 ELSE 5 END
         * INTERVAL 1 HOUR AS release_at,
       CAST(value_cents AS DOUBLE) AS current_level, CAST(value_cents + 777 AS DOUBLE) AS prior_level,
       -777.0::DOUBLE AS flow, CAST(NULL AS VARCHAR) AS problem
FROM (SELECT *, CASE WHEN month(obs_period + 15) BETWEEN 5 AND 10 OR month(obs_period + 15) = 4 AND day(obs_period + 15) > 10
             THEN 'EDT' ELSE 'EST' END AS zone FROM monthly)
""", "monthly")
def _(t):
    day = F.date_add("obs_period", 15)
    summer = F.month(day).between(5, 10) | ((F.month(day) == 4) & (F.day(day) > 10))
    zone = F.when(summer, "EDT").otherwise("EST")
    cells = [F.lit(x) for x in ("1.5", "-2", "3", "4", "5", "6", "7")]
    cells += [F.format_number("value_cents", 0), F.format_number(F.col("value_cents") + 777, 0)]
    cells += [F.lit(x) for x in ("10", "11", "0.2")]
    text = F.concat(
        F.lit("FOR RELEASE AT 8:30 A.M. "), zone, F.lit(", MONDAY, "),
        F.upper(F.date_format(day, "MMMM d, yyyy")), F.lit(" sales for "),
        F.date_format("obs_period", "MMMM yyyy"), F.lit(" Table 1. Estimates Retail & food services, "
                                                        "total "),
        F.concat_ws("  ", *cells), F.lit(" Total (excl. motor) 1 2"))
    docs = t.monthly.select("series_id", F.col("obs_period").alias("target_period"),
                            text.alias("text"))
    return rt.extract_text_flow(docs)


@query("r20_discover_by_pattern", """
SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS period,
       'https://data.example/pdf/m' || strftime(o_orderdate, '%y%m') || '.pdf' AS url,
       1::BIGINT AS url_count FROM orders WHERE o_orderdate >= DATE '1996-01-01'
""")
def _(t):
    links = F.concat(F.lit("<a href='https://data.example/pdf/m"),
                     F.date_format("o_orderdate", "yyMM"), F.lit(".pdf'>x</a> m9913.pdf"))
    docs = t.orders.select(links.alias("text"))
    return rt.discover_by_pattern(docs, "https://data.example/pdf/m", ".pdf", start="1996-01-01")


@query("r21_release_calendar", """
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
f AS (SELECT day, day = DATE '2024-01-12' AS off FROM d WHERE isodow(day) = 5)
SELECT 'Weekly week ' || CAST(day AS VARCHAR) AS release_name,
       CAST(day AS TIMESTAMP) - CASE WHEN off THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
         + INTERVAL 21 HOUR + INTERVAL 15 MINUTE AS expected_at,
       'EXPECTED_RULE' AS status, CAST(NULL AS TIMESTAMP) AS actual_at FROM f UNION ALL
SELECT DISTINCT event_type || ' 2024-01', CASE WHEN event_type IN ('click', 'view')
         THEN TIMESTAMP '2024-01-16 13:30:00' END,
       CASE WHEN event_type IN ('click', 'view') THEN 'EXPECTED_OFFICIAL'
            WHEN event_type = 'error' THEN 'BLOCKED_TIME_UNANNOUNCED'
            ELSE 'BLOCKED_DATE_UNANNOUNCED' END, NULL FROM events
""")
def _(t):
    kinds = t.events.select(F.col("event_type").alias("name")).distinct()
    day = F.lit("2024-01-16").cast("date")
    announced = kinds.select(
        "name", F.lit("2024-01-01").cast("date").alias("month"),
        F.when(F.col("name").isin("click", "view", "error"), day).alias("release_date"),
        F.when(F.col("name") != "error", "08:30").alias("clock"))
    holidays = t.events.select(F.to_date("ts").alias("day")).filter(
        "day = date'2024-01-12'").distinct()
    first, last = (t.events.agg(f(F.to_date("ts"))).scalar() for f in (F.min, F.max))
    return rt.release_calendar(t.spark, first, last, announced, holidays)


# ---- sinks ----------------------------------------------------------------------------------

RECEIPT = "step string, row_count bigint, already_present boolean, stored_rows bigint"


@query("w01_append_batch", """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (obs_period < DATE '1998-01-01') AS a FROM observations)
SELECT 'first' AS step, a AS row_count, false AS already_present, a AS stored_rows FROM n UNION ALL
SELECT 'again', a, true, a FROM n UNION ALL SELECT 'rest', n - a, false, n FROM n
""", "observations")
def _(t):
    root = scratch_path(t.spark, "lake")
    rows = materialize(typed_observations(t), "rows")
    early = F.col("obs_period") < F.lit("1998-01-01").cast("date")
    out = []
    for step, part in (("first", rows.filter(early)),
                       ("again", rows.filter(early).orderBy(F.desc("obs_period"))),
                       ("rest", rows.filter(~early))):
        r = lake.append_batch(part, root, "raw_observations")
        stored = tb.read_table(t.spark, root, "raw_observations").count()
        out.append((step, r.row_count, r.already_present, stored))
    return t.spark.createDataFrame(out, RECEIPT)


@query("w02_stable_write", "SELECT count(*) AS row_count, true AS same_hash FROM vintages",
       "vintages")
def _(t):
    a = lake.stable_write(t.vintages, scratch_path(t.spark, "a"), 4)
    path = scratch_path(t.spark, "b")
    b = lake.stable_write(t.vintages.orderBy("value_cents"), path, 4)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "same_hash", F.lit(a == b))


@query("w03_write_feed", """
SELECT 'json' AS fmt, prediction_id, target_series, target_period, point FROM preds UNION ALL
SELECT 'csv', prediction_id, target_series, target_period, point FROM preds UNION ALL
SELECT 'parquet', prediction_id, target_series, target_period, point FROM preds
""", "preds")
def _(t):
    rows = lq.predictions(t)
    out = None
    for fmt in feeds.FORMATS:
        path = scratch_path(t.spark, f"feed-{fmt}")
        feeds.write_feed(rows, path, fmt, {"license": "CC-BY-4.0"})
        part = feeds.read_feed(t.spark, path, fmt, rows.schema).select(
            F.lit(fmt).alias("fmt"), "prediction_id", "target_series", "target_period", "point")
        out = part if out is None else out.unionByName(part)
    return out


@query("w04_feed_schema", " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, '{kind}' AS kind, count(*) AS row_count, "
    f"count(*) FILTER ({name} IS NULL) AS null_count, CAST(min({name}) AS VARCHAR) AS least FROM preds"
    for name, kind in (("prediction_id", "string"), ("made_at", "date"), ("model_version", "string"),
                       ("inputs_hash", "string"), ("target_series", "string"), ("target_period", "date"),
                       ("status", "string"))), "preds")
def _(t):
    # How the rows of the first version fill its documented columns; numbers are checked elsewhere.
    v1 = feeds.as_version(lq.predictions(t), "predictions", 1)
    made = c.column_profile(v1, T.StructType([v1.schema[n] for n in v1.columns]))
    docs = feeds.feed_schema(t.spark, 1).filter("feed = 'predictions'").select("column_name")
    return made.join(docs, "column_name", "left_semi").filter("kind <> 'double'").select(
        "column_name", "kind", "row_count", "null_count", "least")


@query("w05_file_manifest", "SELECT 5::BIGINT AS file_count, true AS same_tree, count(*) AS row_count "
       "FROM vintages", "vintages")
def _(t):
    path = scratch_path(t.spark, "tree")
    lake.stable_write(t.vintages, f"{path}/v", 5)
    m = lake.file_manifest(t.spark, path)
    a, b = lake.tree_hash(m).first(), lake.tree_hash(m.orderBy(F.desc("file"))).first()
    rows = t.spark.read.parquet(f"{path}/v").agg(F.count(F.lit(1)).alias("row_count"))
    return rows.select(F.lit(a["file_count"]).cast("bigint").alias("file_count"),
                       F.lit(a["tree_hash"] == b["tree_hash"]).alias("same_tree"), "row_count")


@query("w06_publish_atomically", "SELECT * FROM vintages WHERE obs_period >= DATE '1998-01-01'",
       "vintages")
def _(t):
    root = scratch_path(t.spark, "published")
    early = F.col("obs_period") < F.lit("1998-01-01").cast("date")
    lake.publish_atomically(t.vintages.filter(early), root, "v1")
    lake.publish_atomically(t.vintages.filter(~early), root, "v2")
    lake.publish_atomically(t.vintages.filter(~early), root, "v2")  # a replay
    return lake.read_published(t.spark, root, t.vintages.schema)


# ---- streams --------------------------------------------------------------------------------

def landed(t, df, name, files=4):
    """The frame as files in a landing folder."""
    path = scratch_path(t.spark, name)
    df.repartition(files).write.parquet(path)
    return path


@query("i01_ingest_stream", OBS_SQL, "observations")
def _(t):
    rows = typed_observations(t)
    path = scratch_path(t.spark, "landing")
    rows.repartition(4, "checksum").write.parquet(path)
    rows.filter("series_id = '5-LOW'").repartition(1).write.mode("append").parquet(path)
    root, check = scratch_path(t.spark, "lake"), scratch_path(t.spark, "check")
    for _round in range(2):
        inc.ingest_stream(t.spark, path, root, "raw_observations", check,
                          files_per_trigger=2).awaitTermination()
    return shown(tb.read_table(t.spark, root, "raw_observations"))


@query("i02_grade_stream", """
SELECT prediction_id, round(abs_error, 6) AS abs_error, graded_at FROM graded
WHERE graded_at <= DATE '2001-03-31'
""", "graded")
def _(t):
    flows = lq.flows(t)
    stream = inc.file_stream(t.spark, landed(t, flows, "targets"), flows.schema, 1)
    root = scratch_path(t.spark, "grades")
    p = lq.predictions(t)
    check = scratch_path(t.spark, "check")
    # The first run has read every print, and grades those due; the second only has a later day.
    for day in ("2000-12-31", "2001-03-31"):
        inc.grade_stream(stream, p, root, check, day).awaitTermination()
    return tb.read_table(t.spark, root, "grades", inc.GRADES).select(
        "prediction_id", F.round("abs_error", 6).alias("abs_error"), "graded_at")


@query("i03_first_print_stream",
       "SELECT series_id, obs_period, release_date, value_cents FROM first_prints", "first_prints")
def _(t):
    path = landed(t, t.vintages, "vintages", 6)
    stream = inc.file_stream(t.spark, path, t.vintages.schema, 2)
    root, keys, order = scratch_path(t.spark, "prints"), ["series_id", "obs_period"], [
        "release_date", "value_cents"]
    inc.first_print_stream(stream, root, scratch_path(t.spark, "check"), keys,
                           order).awaitTermination()
    return inc.first_prints(t.spark, root, t.vintages.schema, keys, order)


@query("i04_watermark_stream", """
SELECT source, series_no, max(ingested_at) AS latest FROM seen GROUP BY ALL
""", "seen")
def _(t):
    rows = t.seen.select("source", "series_no", "ingested_at")
    stream = inc.file_stream(t.spark, landed(t, rows, "seen"), rows.schema, 2)
    root = scratch_path(t.spark, "marks")
    inc.watermark_stream(stream, root, scratch_path(t.spark, "check"), ["source", "series_no"],
                         "ingested_at").awaitTermination()
    schema = T.StructType([*rows.select("source", "series_no").schema.fields,
                           T.StructField("latest", rows.schema["ingested_at"].dataType)])
    return lake.read_published(t.spark, root, schema)
