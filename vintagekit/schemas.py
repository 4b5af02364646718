"""The sixteen table contracts. Column names, types and nullability are fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values: `name type`, with `?` after the type where null is allowed.
_COLUMNS = {
    "series_registry": """series_id string, source string, expected_title string, units string,
        frequency string, license_note string, verified_at timestamp?""",
    "raw_observations": """source string, series_id string, obs_period date, value double,
        unit string, release_date timestamp, vintage_date date, ingested_at timestamp,
        source_url string, checksum string""",
    "releases_calendar": """release_name string, expected_at timestamp?, actual_at timestamp?,
        status string""",
    "predictions": """prediction_id string, made_at timestamp, model_version string,
        inputs_hash string, target_series string, target_period date, point double, low80 double,
        high80 double, low95 double, high95 double, status string""",
    "grades": """prediction_id string, actual_first_print double, vintage_url string,
        abs_error double, graded_at timestamp""",
    "publication_records": """prediction_id string, published_at timestamp,
        data_vintage timestamp, methodology_version string""",
    "assumptions": """assumption_id string, statement string, value_or_prior string, tier tinyint,
        source_url string, evidence_snippet string, sensitivity_note string, version string,
        active boolean""",
    "matrix_a": """version string, debt_product string, spend_category string, weight_low double,
        weight_mid double, weight_high double, tier tinyint, assumption_ids array<string>""",
    "matrix_b": """version string, spend_category string, ticker string, weight_low double,
        weight_mid double, weight_high double, method string, evidence_refs array<string>""",
    "company_facts": """ticker string, cik string, period date, revenue_total double,
        revenue_us_consumer_est double, segment_evidence_refs array<string>,
        source_accessions array<string>""",
    "sec_xbrl_facts": """issuer_role string, ticker string, cik string, entity_name string,
        namespace string, tag string, label string?, description string?, unit string,
        fact_index int, period_start date?, period_end date, fiscal_year int?,
        fiscal_period string?, form string, filed_at date, accession string, frame string?,
        value_json string, source_url string, source_checksum string, ingested_at timestamp""",
    "sec_filing_evidence": """issuer_role string, ticker string, cik string, evidence_type string,
        period date, filed_at date, accession string, primary_document string, source_url string,
        source_checksum string, context string, evidence_snippet string, snippet_hash string,
        extracted_table_json string, ingested_at timestamp""",
    "auto_abs_aggregates": """trust_id string, trust_name string, credit_segment string,
        cik string, reporting_period_start date, reporting_period_end date, filed_at date,
        accession string, exhibit_document string, asset_count bigint,
        core_metric_asset_count bigint, recovery_only_asset_count bigint, asset_added_count bigint,
        asset_added_indicator_observed_count bigint, recovered_amount_sum decimal(38;8),
        recovered_amount_observed_asset_count bigint, original_loan_amount_sum decimal(38;8),
        asset_added_original_loan_amount_sum decimal(38;8), beginning_balance_sum decimal(38;8),
        ending_balance_sum decimal(38;8), weighted_avg_original_interest_rate decimal(18;10),
        weighted_avg_reporting_interest_rate decimal(18;10),
        reporting_interest_rate_asset_count bigint,
        reporting_interest_rate_balance_sum decimal(38;8),
        weighted_avg_original_loan_term decimal(18;8), weighted_avg_remaining_term decimal(18;8),
        remaining_term_asset_count bigint, remaining_term_balance_sum decimal(38;8),
        source_url string, source_checksum string, source_bytes bigint, filing_index_url string,
        filing_index_checksum string, ingested_at timestamp""",
    "card_trust_aggregates": """trust_id string, trust_name string, trust_cik string,
        archive_cik string, reporting_period_end date, filed_at date, accession string,
        primary_document string, exhibit_document string,
        ending_principal_receivables decimal(38;2), principal_payment_rate_pct decimal(18;6),
        payment_rate_basis string, portfolio_yield_pct decimal(18;6), yield_basis string,
        chargeoff_amount decimal(38;2)?, chargeoff_amount_status string,
        chargeoff_rate_pct decimal(18;6), chargeoff_basis string, metric_evidence_json string,
        evidence_snippet_hash string, source_url string, source_checksum string,
        source_bytes bigint, archive_index_url string, archive_index_checksum string,
        ingested_at timestamp""",
    "attribution_output": """ticker string, period date, dfr_low double, dfr_mid double,
        dfr_high double, tier1_share double, tier2_share double, tier3_share double,
        methodology_version string, data_vintage date, published_at timestamp""",
    "attribution_refreshes": """refresh_id string, target_quarter string, effective_at timestamp,
        data_vintage timestamp, methodology_version string, source_hash string,
        company_count smallint, updated_company_count smallint, payload_json string""",
}


def _schema(text: str) -> T.StructType:
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        nullable = kind.endswith("?")
        ddl = kind.rstrip("?").replace(";", ",")
        fields.append(T.StructField(name, T.StructType.fromDDL(f"c {ddl}")["c"].dataType, nullable))
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {}


def schema_for(table: str) -> T.StructType:
    """The table's schema; an unknown table is an error. Parsed on first use (needs a session)."""
    if table not in _COLUMNS:
        raise KeyError(f"unknown table: {table}")
    if table not in TABLES:
        TABLES[table] = _schema(_COLUMNS[table])
    return TABLES[table]


def table_names() -> list[str]:
    return list(_COLUMNS)


def required_columns(table: str) -> list[str]:
    return [f.name for f in schema_for(table).fields if not f.nullable]
