"""Fixed schemas of the landing tables, typed tables, configuration and results."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, BOOL = T.StringType(), T.LongType(), T.BooleanType()
DATE, STAMP = T.DateType(), T.TimestampNTZType()
MONEY, RATE, SCORE = T.DecimalType(18, 2), T.DecimalType(18, 6), T.DecimalType(5, 2)
PERCENT, CREDIT = T.DecimalType(10, 2), T.DecimalType(10, 6)
TEXTS = T.ArrayType(STRING)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


def _strings(*names: str) -> T.StructType:
    return _struct(**{n: STRING for n in names})


# Landing (bronze) columns in file order; every business column is text.
BRONZE_FILES = {
    "customer": _strings("customer_id", "customer_name", "email", "dob", "phone", "kyc_status",
                         "country", "created_date"),
    "account": _strings("account_id", "customer_id", "account_type", "account_status",
                        "opening_balance", "opened_date"),
    "transaction": _strings("transaction_id", "account_id", "transaction_type",
                            "transaction_amount", "transaction_date"),
    "daily_balance": _strings("account_id", "balance_date", "closing_balance"),
    "fx_rate": _strings("currency_code", "fx_rate_to_usd", "rate_date"),
}
# Table order where it differs from file order.
BRONZE_TABLE_ORDER = {"fx_rate": ("currency_code", "rate_date", "fx_rate_to_usd")}
AUDIT = _struct(load_timestamp=STAMP, source_file=STRING, load_batch_id=STRING)

_QUALITY = dict(is_valid=BOOL, dq_score=SCORE, validation_errors=TEXTS, source_system=STRING,
                load_timestamp=STAMP, updated_timestamp=STAMP, bronze_load_batch_id=STRING)
SILVER = {
    "customer": _struct(customer_id=STRING, customer_name=STRING, email=STRING, dob=DATE,
                        phone=STRING, kyc_status=STRING, country=STRING, created_date=DATE,
                        **_QUALITY),
    "account": _struct(account_id=STRING, customer_id=STRING, account_type=STRING,
                       account_status=STRING, opening_balance=MONEY, opened_date=DATE, **_QUALITY),
    "transaction": _struct(transaction_id=STRING, account_id=STRING, transaction_type=STRING,
                           transaction_amount=MONEY, transaction_date=DATE, **_QUALITY),
    "daily_balance": _struct(account_id=STRING, balance_date=DATE, closing_balance=MONEY,
                             **_QUALITY),
    "fx_rate": _struct(currency_code=STRING, rate_date=DATE, fx_rate_to_usd=RATE, **_QUALITY),
}

RULES = _struct(rule_id=LONG, rule_name=STRING, rule_type=STRING, rule_level=STRING,
                description=STRING, is_active=BOOL, has_check=BOOL)
DATASETS = _struct(dataset_id=STRING, source_database=STRING, source_schema=STRING,
                   source_table=STRING, business_domain=STRING, criticality=STRING,
                   is_active=BOOL, incremental_column=STRING, sla_threshold=PERCENT)
MAPPINGS = _struct(config_id=LONG, dataset_id=STRING, rule_id=LONG, column_name=STRING,
                   threshold_value=PERCENT, is_active=BOOL)
WEIGHTS = _struct(rule_type=STRING, business_domain=STRING, weight=SCORE, priority=LONG,
                  effective_date=DATE, expiry_date=DATE, is_active=BOOL)
ALLOWED_VALUES = _struct(dataset_id=STRING, column_name=STRING, allowed_values=STRING,
                         is_active=BOOL)

CHECK_RESULTS = _struct(
    check_id=STRING, run_id=STRING, check_timestamp=STAMP, dataset_id=STRING,
    database_name=STRING, schema_name=STRING, table_name=STRING, column_name=STRING,
    rule_id=LONG, rule_name=STRING, rule_type=STRING, rule_level=STRING, total_records=LONG,
    valid_records=LONG, invalid_records=LONG, null_records=LONG, duplicate_records=LONG,
    pass_rate=PERCENT, threshold=PERCENT, check_status=STRING, execution_time_ms=LONG,
    execution_credits=CREDIT, failure_reason=STRING, weight=SCORE, scan_scope=STRING,
    scan_reason=STRING)
RUN_CONTROL = _struct(
    run_id=STRING, run_type=STRING, triggered_by=STRING, start_ts=STAMP, end_ts=STAMP,
    duration_seconds=PERCENT, run_status=STRING, total_datasets=LONG, datasets_skipped=LONG,
    total_checks=LONG, passed_checks=LONG, failed_checks=LONG, warning_checks=LONG,
    skipped_checks=LONG, records_processed=LONG, invalid_records=LONG, total_rows_in_scope=LONG,
    row_level_records_processed=LONG, pass_rate=PERCENT, error_message=STRING)
METRICS = _struct(asset_id=STRING, column_name=STRING, metric_name=STRING,
                  metric_value=T.DoubleType(), metric_text=STRING, metric_time=STAMP,
                  source_system=STRING, run_id=STRING, tags=STRING)
LINEAGE = _strings("upstream_database", "upstream_schema", "upstream_table",
                   "downstream_database", "downstream_schema", "downstream_table",
                   "lineage_type", "transformation_logic")
REPORTS = _struct(report_id=STRING, report_type=STRING, scope=STRING, report_date=DATE,
                  generated_by=STRING, generated_at=STAMP, format=STRING, file_path=STRING)
