"""The shipped configuration: rules, datasets, mappings, weights, allowed values."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from assayer import schemas
from assayer.functions.clock import AsOf
from assayer.functions.scoring import RULE_TYPES
from assayer.sources.tables import literal_rows

# Names, kinds and levels of the rules.  The descriptions are for readers only.
RULES = (
    ("COMPLETENESS_CHECK", "COMPLETENESS", "COLUMN", "Share of rows whose value is present"),
    ("COMPLETENESS_CRITICAL_COLUMNS", "COMPLETENESS", "TABLE", "Share of rows in which all listed columns are present"),
    ("UNIQUENESS_PRIMARY_KEY", "UNIQUENESS", "COLUMN", "Rows against distinct values of one key column"),
    ("UNIQUENESS_COMPOSITE_KEY", "UNIQUENESS", "TABLE", "Rows against distinct values of several columns together"),
    ("VALIDITY_EMAIL_FORMAT", "VALIDITY", "COLUMN", "Value looks like a mail address"),
    ("VALIDITY_PHONE_FORMAT", "VALIDITY", "COLUMN", "Value looks like a telephone number"),
    ("VALIDITY_DATE_FORMAT", "VALIDITY", "COLUMN", "Value reads as a date"),
    ("VALIDITY_NUMERIC_FORMAT", "VALIDITY", "COLUMN", "Value reads as a number"),
    ("VALIDITY_POSITIVE_NUMBER", "VALIDITY", "COLUMN", "Number above zero"),
    ("VALIDITY_NON_NEGATIVE_NUMBER", "VALIDITY", "COLUMN", "Number not below zero"),
    ("VALIDITY_ALLOWED_VALUES", "VALIDITY", "COLUMN", "Value is one of those configured"),
    ("VALIDITY_DATE_RANGE", "VALIDITY", "COLUMN", "Date between the earliest accepted one and today"),
    ("VALIDITY_COUNTRY_CODE", "VALIDITY", "COLUMN", "Known country code"),
    ("VALIDITY_CURRENCY_CODE", "VALIDITY", "COLUMN", "Known currency code"),
    ("FRESHNESS_DATA_RECENCY", "FRESHNESS", "COLUMN", "Newest value is at most so many days old"),
    ("FRESHNESS_LOAD_TIMESTAMP", "FRESHNESS", "TABLE", "Last load is at most so many days ago"),
    ("CONSISTENCY_FOREIGN_KEY", "CONSISTENCY", "COLUMN", "Value occurs in the key of the parent dataset"),
    ("CONSISTENCY_LOGICAL_RELATIONSHIP", "CONSISTENCY", "TABLE", "A condition over several columns of a row holds"),
    ("VOLUME_ROW_COUNT_THRESHOLD", "VOLUME", "TABLE", "The dataset has rows"),
    ("VOLUME_ANOMALY_DETECTION", "VOLUME", "TABLE", "The day's rows against the mean of the days before"),
)
# Rules named without a check definition; they join the catalogue as extensions.
WITHOUT_DEFINITION = (
    "COMPLETENESS_CRITICAL_COLUMNS", "UNIQUENESS_COMPOSITE_KEY", "FRESHNESS_LOAD_TIMESTAMP",
    "CONSISTENCY_LOGICAL_RELATIONSHIP", "VOLUME_ANOMALY_DETECTION",
)
BRONZE_DATASETS = (
    ("DS_BRONZE_CUSTOMER", "BANKING_DW", "BRONZE", "STG_CUSTOMER", "CUSTOMER_MANAGEMENT", "CRITICAL"),
    ("DS_BRONZE_ACCOUNT", "BANKING_DW", "BRONZE", "STG_ACCOUNT", "ACCOUNT_MANAGEMENT", "CRITICAL"),
    ("DS_BRONZE_TRANSACTION", "BANKING_DW", "BRONZE", "STG_TRANSACTION", "TRANSACTION_PROCESSING",
     "HIGH"),
    ("DS_BRONZE_DAILY_BALANCE", "BANKING_DW", "BRONZE", "STG_DAILY_BALANCE", "FINANCIAL_REPORTING",
     "HIGH"),
    ("DS_BRONZE_FX_RATE", "BANKING_DW", "BRONZE", "STG_FX_RATE", "MARKET_DATA", "MEDIUM"),
)
SILVER_DATASETS = (
    ("DS_SILVER_CUSTOMER", "BANKING_DW", "SILVER", "CUSTOMER", "CUSTOMER_MANAGEMENT", "CRITICAL"),
    ("DS_SILVER_ACCOUNT", "BANKING_DW", "SILVER", "ACCOUNT", "ACCOUNT_MANAGEMENT", "CRITICAL"),
    ("DS_SILVER_TRANSACTION", "BANKING_DW", "SILVER", "TRANSACTION", "TRANSACTION_PROCESSING",
     "HIGH"),
    ("DS_SILVER_DAILY_BALANCE", "BANKING_DW", "SILVER", "DAILY_BALANCE", "FINANCIAL_REPORTING",
     "HIGH"),
    ("DS_SILVER_FX_RATE", "BANKING_DW", "SILVER", "FX_RATE", "MARKET_DATA", "MEDIUM"),
)
# dataset -> column -> rule -> threshold; the column None is the whole table.
BRONZE_CHECKS = {
    "DS_BRONZE_CUSTOMER": {
        "customer_id": {"COMPLETENESS_CHECK": 100, "UNIQUENESS_PRIMARY_KEY": 100},
        "customer_name": {"COMPLETENESS_CHECK": 95},
        "email": {"COMPLETENESS_CHECK": 90, "VALIDITY_EMAIL_FORMAT": 85},
        "dob": {"COMPLETENESS_CHECK": 90, "VALIDITY_DATE_FORMAT": 80, "VALIDITY_DATE_RANGE": 85},
        "phone": {"COMPLETENESS_CHECK": 85, "VALIDITY_PHONE_FORMAT": 80},
        "kyc_status": {"COMPLETENESS_CHECK": 100, "VALIDITY_ALLOWED_VALUES": 95},
        "country": {"COMPLETENESS_CHECK": 95, "VALIDITY_COUNTRY_CODE": 90},
        "created_date": {"COMPLETENESS_CHECK": 100, "VALIDITY_DATE_FORMAT": 95,
                         "FRESHNESS_DATA_RECENCY": 90},
        None: {"VOLUME_ROW_COUNT_THRESHOLD": 100},
    },
    "DS_BRONZE_ACCOUNT": {
        "account_id": {"COMPLETENESS_CHECK": 100, "UNIQUENESS_PRIMARY_KEY": 100},
        "customer_id": {"COMPLETENESS_CHECK": 100, "CONSISTENCY_FOREIGN_KEY": 95},
        "account_type": {"COMPLETENESS_CHECK": 100, "VALIDITY_ALLOWED_VALUES": 95},
        "account_status": {"COMPLETENESS_CHECK": 100, "VALIDITY_ALLOWED_VALUES": 95},
        "opening_balance": {"COMPLETENESS_CHECK": 95, "VALIDITY_NUMERIC_FORMAT": 90,
                            "VALIDITY_NON_NEGATIVE_NUMBER": 90},
        "opened_date": {"COMPLETENESS_CHECK": 100, "VALIDITY_DATE_FORMAT": 95,
                        "VALIDITY_DATE_RANGE": 95},
        None: {"VOLUME_ROW_COUNT_THRESHOLD": 100},
    },
    "DS_BRONZE_TRANSACTION": {
        "transaction_id": {"COMPLETENESS_CHECK": 100, "UNIQUENESS_PRIMARY_KEY": 100},
        "account_id": {"COMPLETENESS_CHECK": 100, "CONSISTENCY_FOREIGN_KEY": 90},
        "transaction_type": {"COMPLETENESS_CHECK": 100, "VALIDITY_ALLOWED_VALUES": 95},
        "transaction_amount": {"COMPLETENESS_CHECK": 100, "VALIDITY_NUMERIC_FORMAT": 95,
                               "VALIDITY_POSITIVE_NUMBER": 90},
        "transaction_date": {"COMPLETENESS_CHECK": 100, "VALIDITY_DATE_FORMAT": 95,
                             "VALIDITY_DATE_RANGE": 95, "FRESHNESS_DATA_RECENCY": 90},
        None: {"VOLUME_ROW_COUNT_THRESHOLD": 100},
    },
    "DS_BRONZE_DAILY_BALANCE": {
        "account_id": {"COMPLETENESS_CHECK": 100, "CONSISTENCY_FOREIGN_KEY": 90},
        "balance_date": {"COMPLETENESS_CHECK": 100, "VALIDITY_DATE_FORMAT": 95,
                         "FRESHNESS_DATA_RECENCY": 90},
        "closing_balance": {"COMPLETENESS_CHECK": 100, "VALIDITY_NUMERIC_FORMAT": 95},
        None: {"VOLUME_ROW_COUNT_THRESHOLD": 100},
    },
    "DS_BRONZE_FX_RATE": {
        "currency_code": {"COMPLETENESS_CHECK": 100, "VALIDITY_CURRENCY_CODE": 95},
        "fx_rate_to_usd": {"COMPLETENESS_CHECK": 100, "VALIDITY_NUMERIC_FORMAT": 95,
                           "VALIDITY_POSITIVE_NUMBER": 95},
        "rate_date": {"COMPLETENESS_CHECK": 100, "VALIDITY_DATE_FORMAT": 95,
                      "FRESHNESS_DATA_RECENCY": 85},
        None: {"VOLUME_ROW_COUNT_THRESHOLD": 100},
    },
}
# Several of these columns are absent from the typed tables: their checks report ERROR.
SILVER_CHECKS = {
    "DS_SILVER_CUSTOMER": {
        "customer_id": {"COMPLETENESS_CHECK": 100, "UNIQUENESS_PRIMARY_KEY": 100},
        "first_name": {"COMPLETENESS_CHECK": 99},
        "last_name": {"COMPLETENESS_CHECK": 99},
        "email": {"COMPLETENESS_CHECK": 95, "VALIDITY_EMAIL_FORMAT": 95},
        "phone": {"COMPLETENESS_CHECK": 90, "VALIDITY_PHONE_FORMAT": 90},
        "date_of_birth": {"COMPLETENESS_CHECK": 95, "VALIDITY_DATE_FORMAT": 95},
        "kyc_status": {"COMPLETENESS_CHECK": 100, "VALIDITY_ALLOWED_VALUES": 100},
        "country": {"VALIDITY_COUNTRY_CODE": 98},
        None: {"VOLUME_ROW_COUNT_THRESHOLD": 100},
    },
    "DS_SILVER_ACCOUNT": {
        "account_id": {"COMPLETENESS_CHECK": 100, "UNIQUENESS_PRIMARY_KEY": 100},
        "customer_id": {"COMPLETENESS_CHECK": 100, "CONSISTENCY_FOREIGN_KEY": 98},
        "account_type": {"COMPLETENESS_CHECK": 100, "VALIDITY_ALLOWED_VALUES": 100},
        "status": {"COMPLETENESS_CHECK": 100, "VALIDITY_ALLOWED_VALUES": 100},
        "balance": {"COMPLETENESS_CHECK": 100, "VALIDITY_NUMERIC_FORMAT": 100},
        "currency": {"COMPLETENESS_CHECK": 100, "VALIDITY_CURRENCY_CODE": 100},
        None: {"VOLUME_ROW_COUNT_THRESHOLD": 100},
    },
    "DS_SILVER_TRANSACTION": {
        "transaction_id": {"COMPLETENESS_CHECK": 100, "UNIQUENESS_PRIMARY_KEY": 100},
        "account_id": {"COMPLETENESS_CHECK": 100, "CONSISTENCY_FOREIGN_KEY": 98},
        "transaction_type": {"COMPLETENESS_CHECK": 100, "VALIDITY_ALLOWED_VALUES": 100},
        "amount": {"COMPLETENESS_CHECK": 100, "VALIDITY_NUMERIC_FORMAT": 100},
        "transaction_date": {"COMPLETENESS_CHECK": 100, "FRESHNESS_DATA_RECENCY": 95},
        None: {"VOLUME_ROW_COUNT_THRESHOLD": 100},
    },
    "DS_SILVER_DAILY_BALANCE": {
        "balance_id": {"COMPLETENESS_CHECK": 100, "UNIQUENESS_PRIMARY_KEY": 100},
        "account_id": {"COMPLETENESS_CHECK": 100, "CONSISTENCY_FOREIGN_KEY": 98},
        "balance_date": {"COMPLETENESS_CHECK": 100},
        "closing_balance": {"COMPLETENESS_CHECK": 100, "VALIDITY_NUMERIC_FORMAT": 100},
        None: {"VOLUME_ROW_COUNT_THRESHOLD": 100},
    },
    "DS_SILVER_FX_RATE": {
        "rate_id": {"COMPLETENESS_CHECK": 100, "UNIQUENESS_PRIMARY_KEY": 100},
        "to_currency": {"COMPLETENESS_CHECK": 100, "VALIDITY_CURRENCY_CODE": 100},
        "exchange_rate": {"COMPLETENESS_CHECK": 100, "VALIDITY_POSITIVE_NUMBER": 100},
        "rate_date": {"COMPLETENESS_CHECK": 100, "FRESHNESS_DATA_RECENCY": 95},
        None: {"VOLUME_ROW_COUNT_THRESHOLD": 100},
    },
}
# domain -> (weight, priority) per rule type, in the order of RULE_TYPES.
WEIGHTS = {
    "CUSTOMER_MANAGEMENT": ((2.50, 1), (3.00, 1), (2.00, 2), (1.50, 3), (1.00, 3), (1.00, 4)),
    "ACCOUNT_MANAGEMENT": ((2.50, 1), (3.00, 1), (2.50, 1), (2.00, 2), (1.00, 3), (1.00, 4)),
    "TRANSACTION_PROCESSING": ((3.00, 1), (3.00, 1), (2.50, 1), (2.00, 2), (2.00, 2), (1.50, 3)),
    "FINANCIAL_REPORTING": ((3.00, 1), (2.00, 2), (2.50, 1), (2.50, 1), (2.50, 1), (1.50, 3)),
    "MARKET_DATA": ((2.50, 1), (2.00, 2), (3.00, 1), (1.50, 3), (3.00, 1), (1.00, 4)),
}
ALLOWED_VALUES = (
    ("DS_BRONZE_CUSTOMER", "kyc_status", "'Verified','Pending','Rejected','Incomplete'"),
    ("DS_BRONZE_ACCOUNT", "account_type", "'Savings','Checking','Credit','Investment'"),
    ("DS_BRONZE_ACCOUNT", "account_status", "'Active','Inactive','Closed','Frozen'"),
    ("DS_BRONZE_TRANSACTION", "transaction_type", "'Deposit','Withdrawal','Transfer','Payment'"),
    ("DS_SILVER_CUSTOMER", "kyc_status",
     "'VERIFIED','PENDING','REJECTED','EXPIRED','NOT_STARTED'"),
    ("DS_SILVER_ACCOUNT", "account_type", "'SAVINGS','CHECKING','CREDIT','INVESTMENT','LOAN'"),
    ("DS_SILVER_ACCOUNT", "status", "'ACTIVE','CLOSED','SUSPENDED','PENDING'"),
    ("DS_SILVER_TRANSACTION", "transaction_type",
     "'DEPOSIT','WITHDRAWAL','TRANSFER','PAYMENT','FEE','INTEREST'"),
)
# child column -> (parent dataset, parent key)
FOREIGN_KEYS = {
    "customer_id": ("DS_BRONZE_CUSTOMER", "customer_id"),
    "account_id": ("DS_BRONZE_ACCOUNT", "account_id"),
}
# Tables and kinds of step; the last column is for readers only.
LINEAGE = (
    ("BANKING_DW", "BRONZE", "STG_CUSTOMER", "BANKING_DW", "SILVER", "CUSTOMER", "TRANSFORMATION",
     "Typed, checked and scored"),
    ("BANKING_DW", "BRONZE", "STG_ACCOUNT", "BANKING_DW", "SILVER", "ACCOUNT", "TRANSFORMATION",
     "Typed and checked, owner must exist"),
    ("BANKING_DW", "BRONZE", "STG_TRANSACTION", "BANKING_DW", "SILVER", "TRANSACTION",
     "TRANSFORMATION", "Typed and checked, amounts included"),
    ("BANKING_DW", "BRONZE", "STG_DAILY_BALANCE", "BANKING_DW", "SILVER", "DAILY_BALANCE",
     "TRANSFORMATION", "Typed and checked"),
    ("BANKING_DW", "BRONZE", "STG_FX_RATE", "BANKING_DW", "SILVER", "FX_RATE", "TRANSFORMATION",
     "Typed and checked"),
    ("BANKING_DW", "SILVER", "CUSTOMER", "BANKING_DW", "GOLD", "VW_CUSTOMER_360", "AGGREGATION",
     "One row per customer"),
    ("BANKING_DW", "SILVER", "ACCOUNT", "BANKING_DW", "GOLD", "VW_CUSTOMER_360", "AGGREGATION",
     "Accounts summed per customer"),
    ("BANKING_DW", "SILVER", "TRANSACTION", "BANKING_DW", "GOLD", "VW_CUSTOMER_360", "AGGREGATION",
     "Transactions summed per customer"),
)


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, name, kind, level, text, True, name not in WITHOUT_DEFINITION)
            for i, (name, kind, level, text) in enumerate(RULES, start=1)]
    return literal_rows(spark, rows, schemas.RULES)


def datasets(spark: SparkSession, layers=("BRONZE",), incremental: dict[str, str] | None = None,
             sla: int = 90) -> DataFrame:
    watermark = incremental or {}
    rows = [(*row, True, watermark.get(row[0]), Decimal(sla))
            for row in BRONZE_DATASETS + SILVER_DATASETS if row[2] in layers]
    return literal_rows(spark, rows, schemas.DATASETS)


def mappings(spark: SparkSession, layers=("BRONZE",)) -> DataFrame:
    checks = {}
    if "BRONZE" in layers:
        checks |= BRONZE_CHECKS
    if "SILVER" in layers:
        checks |= SILVER_CHECKS
    ids = {name: i for i, (name, *_) in enumerate(RULES, start=1)}
    flat = [(dataset, ids[name], column, Decimal(limit))
            for dataset, columns in checks.items()
            for column, named in columns.items() for name, limit in named.items()]
    rows = [(i, *row, True) for i, row in enumerate(flat, start=1)]
    return literal_rows(spark, rows, schemas.MAPPINGS)


def weights(spark: SparkSession, effective: AsOf = "2000-01-01") -> DataFrame:
    start = date.fromisoformat(str(effective)[:10])
    rows = [(kind, domain, Decimal(str(weight)), priority, start, None, True)
            for domain, values in WEIGHTS.items()
            for kind, (weight, priority) in zip(RULE_TYPES, values)]
    return literal_rows(spark, rows, schemas.WEIGHTS)


def allowed_values(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, [(*row, True) for row in ALLOWED_VALUES], schemas.ALLOWED_VALUES)


def lineage(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, list(LINEAGE), schemas.LINEAGE)
