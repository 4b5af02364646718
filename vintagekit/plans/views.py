"""The same derived views in DuckDB SQL, for the twins."""

from vintagekit.plans.registry import row_sha, view

view("vintages", """
SELECT series_id, obs_period, release_date,
       CAST(sum(c) OVER (PARTITION BY series_id, obs_period ORDER BY release_date
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value_cents
FROM (SELECT o.o_orderpriority AS series_id,
             last_day(CAST(o.o_orderdate AS DATE)) AS obs_period,
             last_day(CAST(l.l_shipdate AS DATE)) AS release_date,
             sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS c
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      WHERE last_day(CAST(l.l_shipdate AS DATE)) > last_day(CAST(o.o_orderdate AS DATE))
      GROUP BY ALL)
""")
view("observations", f"""
SELECT 'SALES' AS source, series_id, obs_period, value_cents, value_cents / 1e8 AS value,
       'million' AS unit, release_date, release_date AS vintage_date,
       CAST(release_date + 1 AS DATE) AS ingested_at,
       'https://data.example/sales/' || strftime(release_date, '%Y%m') || '/'
         || regexp_replace(series_id, '[^A-Z0-9]', '', 'g') AS source_url,
       {row_sha("series_id", "obs_period", "release_date", "value_cents")} AS checksum
FROM vintages
""", "vintages")
view("first_prints", """
SELECT series_id, obs_period, release_date, value_cents, value_cents / 1e8 AS value
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, obs_period
                                   ORDER BY release_date, value_cents) AS rn FROM vintages)
WHERE rn = 1
""", "vintages")
view("monthly", """
SELECT o_orderpriority AS series_id, last_day(CAST(o_orderdate AS DATE)) AS obs_period,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value_cents,
       sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e8 AS value,
       CAST(last_day(CAST(o_orderdate AS DATE)) + 37 AS DATE) AS release_date
FROM orders GROUP BY ALL
""")
view("targets", """
SELECT series_id, obs_period AS target_period, value, value_cents,
       CAST(obs_period + 10 AS DATE) AS release_at FROM monthly
""", "monthly")
view("weekly", f"""
SELECT series_id, obs_period, CAST(obs_period + d AS DATE) AS release_date,
       CAST(CASE WHEN d = 9 THEN first_cents ELSE all_cents END AS BIGINT) AS value_cents,
       CASE WHEN d = 9 THEN first_cents ELSE all_cents END / 1e8 AS value,
       {row_sha("series_id", "obs_period", "CAST(obs_period + d AS DATE)",
                "CAST(CASE WHEN d = 9 THEN first_cents ELSE all_cents END AS BIGINT)")} AS checksum
FROM (SELECT o_orderpriority AS series_id,
             CAST(CAST(o_orderdate AS DATE) + CAST((10 - isodow(o_orderdate)) % 7 AS INTEGER)
                  AS DATE) AS obs_period,
             sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT)
                 ELSE 0 END) AS first_cents,
             sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS all_cents
      FROM orders GROUP BY ALL) w CROSS JOIN (VALUES (9), (16)) p(d)
""")
view("monthly_flow", """
SELECT series_id, obs_period, CAST(c AS BIGINT) AS value_cents, c / 1e8 AS value,
       CAST(obs_period + CAST(month(obs_period) % 5 * 2 AS INTEGER) AS DATE) AS release_date
FROM (SELECT o.o_orderpriority AS series_id, last_day(CAST(l.l_shipdate AS DATE)) AS obs_period,
             sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS c
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY ALL)
""")
view("seen", """
SELECT event_type AS source, user_id % 10 AS series_no, event_id, user_id, ts AS ingested_at,
       CAST(ts AS DATE) AS obs_date, CAST(round(value * 100) AS BIGINT) AS value_cents
FROM events
""")
