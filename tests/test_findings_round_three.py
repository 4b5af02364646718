"""Findings of the third round: queries that met their SQL at sf0.01 only."""

import gzip
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import oracle
from vintagekit.operators import loans as ln
from vintagekit.plans import load_all, source_queries
from vintagekit.plans.tables import to_places
from vintagekit.sources import xml_sources as xs

QUERIES = load_all()


def test_rounding_of_ties_is_that_of_sql(spark):
    """Nine digits times 0.9 or 1.1 end in a five at every tenth number, which is no double."""
    rows = spark.range(5, 200_000, 10).select((F.col("id") / 1e9).alias("m"))
    for factor in (0.9, 1.1):
        got = [r[0] for r in rows.select("m", to_places(F.col("m") * factor, 9).alias("r"))
               .orderBy("m").select("r").collect()]
        want = [r[0] for r in duckdb.sql(
            f"SELECT round(m * {factor}::DOUBLE, 9) FROM (SELECT range / 1e9 AS m FROM range(5, 200000, 10))"
            " ORDER BY m").fetchall()]
        assert got == want


def test_group_freshness_at_any_size(spark, folder):
    """Groups of 15, of 14, of 30, and of 15 seen with one more later; one that comes only later."""
    early, late = "TIMESTAMP '2024-01-19 05:00:00'", "TIMESTAMP '2024-01-25 05:00:00'"
    n = {0: (15, 0), 1: (14, 0), 2: (30, 0), 3: (15, 1), 4: (0, 3), 5: (30, 2)}
    users = [(g + 10 * i, early if i < seen else late) for g, (seen, more) in n.items()
             for i in range(seen + more)]
    rows = " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS event_id, {u}::BIGINT AS user_id, {ts} AS ts, 'view' AS event_type, 1.5 AS value"
        for i, (u, ts) in enumerate(users))
    duckdb.execute(f"COPY ({rows}) TO '{folder}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    for name, count in (("q03_entity_freshness", 5), ("q03_group_freshness", 6)):
        df = QUERIES[name].run(spark, folder)
        assert df.count() == count
        assert oracle.compare(df, con, QUERIES[name].sql) is None


@pytest.mark.parametrize("name", ["r07_read_loan_tape", "r07_bad_tape_values"])
def test_tapes_are_few_files_of_bounded_size(spark, folder, monkeypatch, name):
    """Files grow in number with the rows, not with trusts times tasks, and none with the input."""
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(xs, "FILE_ROWS", 5000)
    monkeypatch.setattr(source_queries, "scratch_path", lambda spark, name: f"{folder}/{name}")
    df = QUERIES[name].run(spark, sf)
    assert oracle.compare(df, oracle.connect(sf), QUERIES[name].sql) is None
    files = [p for p in Path(folder).rglob("part-*") if p.is_file()]
    texts = [gzip.decompress(p.read_bytes()) if p.suffix == ".gz" else p.read_bytes() for p in files]
    assets = [t.count(b"<assets>") for t in texts]
    assert sum(assets) == 60_000 and max(assets) <= 5000
    assert len(files) <= 12 + 8


def test_loans_are_dealt_out_before_their_wide_sums(spark):
    rows = spark.range(40).select(
        (F.col("id") % 3).alias("trust_id"), F.lit("2024-01-31").cast("date").alias("period_end"),
        *[F.lit(1).cast("decimal(14,2)").alias(f) for f in
          ("original_amount", "beginning_balance", "ending_balance", "original_rate", "reporting_rate", "recovered")],
        *[F.lit(12).alias(f) for f in ("original_term", "remaining_term")], F.lit("true").alias("added"))
    out = ln.loan_aggregate(rows)
    assert {r["trust_id"]: r["asset_count"] for r in out.collect()} == {0: 14, 1: 13, 2: 13}
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [m.start() for m in re.finditer("REBALANCE_PARTITIONS_BY_COL", plan)]
    # Two exchanges: the loans, which Spark may split, and then partial sums by key.
    assert dealt and "ENSURE_REQUIREMENTS" in plan[:dealt[0]]
