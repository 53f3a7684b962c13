"""The three planted-defect tables and their configuration."""

from __future__ import annotations

from decimal import Decimal

from assayer import schemas
from assayer.plans import seeds
from assayer.plans.runs import Configuration
from assayer.sources.tables import Registry, literal_rows

NOW = "2026-02-10 14:00:00"
YESTERDAY = "2026-02-09 14:00:00"
TESTING = [(f"C{i:03d}", None if i in (3, 5) else "a$test.com" if i == 12 else f"u{i}@test.com",
            "2025-01-01") for i in range(1, 13)]
_CLEAN = [(f"ACC30{i:02d}", f"CUST7{i:02d}", "SAVINGS", "ACTIVE", f"{i}500.00", "2023-05-10",
           YESTERDAY) for i in range(1, 11)]
_TODAY = [
    ("ACC3011", "CUST711", "SAVINGS", "ACTIVE", "20000.00", "2023-04-10"),
    (None, "CUST712", "CHECKING", "ACTIVE", "8000.00", "2023-10-11"),
    ("ACC3013", "CUST713", "SAVINGS", "ACTIVE", "1200.00", "2022-01-01"),
    ("ACC3013", "CUST714", "SAVINGS", "ACTIVE", "1500.00", "2022-01-01"),
    ("ACC3015", "CUST715", "CURRENT", "ACTIVE", "5400.00", "2023-03-15"),
    ("ACC3016", "CUST716", "SAVINGS", "BLOCKED", "7500.00", "2023-08-19"),
    ("ACC3017", "CUST717", "CHECKING", "ACTIVE", "XYZ", "2024-02-01"),
    ("ACC3018", "CUST718", "SAVINGS", "ACTIVE", "-4500.00", "2024-01-01"),
    ("ACC3019", "CUST719", "SAVINGS", "ACTIVE", "3000.00", "31-02-2023"),
    ("ACC3020", None, "CHECKING", "ACTIVE", "9800.00", "2023-09-09"),
]
ACCOUNTS = _CLEAN + [(*row, NOW) for row in _TODAY]
CUSTOMERS = [(f"CUST7{i:02d}", f"Name {i}", f"n{i}@mail.com", f"98765010{i:02d}")
             for i in range(1, 11)] + [
    ("CUST711", "Rohan", "rohan@mail.com", "9876502001"), ("CUST712", None, "k@mail.com", "9876502002"),
    ("CUST713", "Anita", "anita.mail.com", "9876502003"), ("CUST714", "Kunal", "kunal@mail.com", "12345"),
    ("CUST715", "Deepa", "deepa@mail.com", "9876502005"), ("CUST715", "Deepa", "deepa@mail.com", "9876502005"),
    ("CUST716", "Sahil", None, "9876502006"), ("CUST717", "", "invalid@email", ""),
    ("CUST718", "Future", "future@mail.com", "9876502008"), ("CUST719", None, None, None),
]
DATASETS = [
    ("DS_BRONZE_TESTING", "BANKING_DW", "BRONZE", "TESTING", "TESTING_DOMAIN", "CRITICAL", True,
     None, Decimal(90)),
    ("DS_STG_ACCOUNT_TEST", "BANKING_DW", "TESTING", "STG_ACCOUNT_TEST", "BANKING", "MEDIUM", True,
     "LOAD_TIMESTAMP", Decimal(90)),
    ("DS_STG_CUSTOMER_TEST", "BANKING_DW", "TESTING", "STG_CUSTOMER_TEST", "BANKING", "MEDIUM",
     True, None, Decimal(90)),
]
CHECKS = [
    ("DS_BRONZE_TESTING", "COMPLETENESS_CHECK", "EMAIL", 95),
    ("DS_BRONZE_TESTING", "VALIDITY_EMAIL_FORMAT", "EMAIL", 95),
    ("DS_STG_ACCOUNT_TEST", "COMPLETENESS_CHECK", "ACCOUNT_ID", 100),
    ("DS_STG_ACCOUNT_TEST", "UNIQUENESS_PRIMARY_KEY", "ACCOUNT_ID", 100),
    ("DS_STG_ACCOUNT_TEST", "VALIDITY_NUMERIC_FORMAT", "OPENING_BALANCE", 95),
    ("DS_STG_ACCOUNT_TEST", "VOLUME_ROW_COUNT_THRESHOLD", None, 100),
    ("DS_STG_CUSTOMER_TEST", "COMPLETENESS_CHECK", "CUSTOMER_ID", 100),
    ("DS_STG_CUSTOMER_TEST", "UNIQUENESS_PRIMARY_KEY", "CUSTOMER_ID", 100),
    ("DS_STG_CUSTOMER_TEST", "COMPLETENESS_CHECK", "EMAIL", 95),
    ("DS_STG_CUSTOMER_TEST", "VOLUME_ROW_COUNT_THRESHOLD", None, 100),
]
EXPECTED = {
    ("DS_BRONZE_TESTING", "COMPLETENESS_CHECK", "EMAIL"): (12, 2, "83.33", "FAILED"),
    ("DS_BRONZE_TESTING", "VALIDITY_EMAIL_FORMAT", "EMAIL"): (12, 1, "91.67", "WARNING"),
    ("DS_STG_ACCOUNT_TEST", "COMPLETENESS_CHECK", "ACCOUNT_ID"): (10, 1, "90.00", "FAILED"),
    ("DS_STG_ACCOUNT_TEST", "UNIQUENESS_PRIMARY_KEY", "ACCOUNT_ID"): (10, 2, "80.00", "FAILED"),
    ("DS_STG_ACCOUNT_TEST", "VALIDITY_NUMERIC_FORMAT", "OPENING_BALANCE"):
        (10, 1, "90.00", "WARNING"),
    ("DS_STG_ACCOUNT_TEST", "VOLUME_ROW_COUNT_THRESHOLD", None): (10, 0, "100.00", "PASSED"),
    ("DS_STG_CUSTOMER_TEST", "COMPLETENESS_CHECK", "CUSTOMER_ID"): (20, 0, "100.00", "PASSED"),
    ("DS_STG_CUSTOMER_TEST", "UNIQUENESS_PRIMARY_KEY", "CUSTOMER_ID"): (20, 1, "95.00", "WARNING"),
    ("DS_STG_CUSTOMER_TEST", "COMPLETENESS_CHECK", "EMAIL"): (20, 2, "90.00", "WARNING"),
    ("DS_STG_CUSTOMER_TEST", "VOLUME_ROW_COUNT_THRESHOLD", None): (20, 0, "100.00", "PASSED"),
}


def registry(spark) -> Registry:
    accounts = spark.createDataFrame(
        ACCOUNTS, "account_id string, customer_id string, account_type string, "
        "account_status string, opening_balance string, opened_date string, load_timestamp string"
    ).selectExpr("* EXCEPT (load_timestamp)",
                 "CAST(load_timestamp AS TIMESTAMP_NTZ) AS load_timestamp")
    return (
        Registry(spark)
        .add("DS_BRONZE_TESTING", spark.createDataFrame(
            TESTING, "customer_id string, email string, created_at string"))
        .add("DS_STG_ACCOUNT_TEST", accounts)
        .add("DS_STG_CUSTOMER_TEST", spark.createDataFrame(
            CUSTOMERS, "customer_id string, customer_name string, email string, phone string"))
    )


def configuration(spark, datasets=DATASETS) -> Configuration:
    ids = {name: i for i, (name, *_) in enumerate(seeds.RULES, start=1)}
    mappings = [(i, d, ids[name], column, Decimal(limit), True)
                for i, (d, name, column, limit) in enumerate(CHECKS, start=1)]
    return Configuration(
        literal_rows(spark, datasets, schemas.DATASETS), seeds.rules(spark),
        literal_rows(spark, mappings, schemas.MAPPINGS), seeds.weights(spark),
        seeds.allowed_values(spark), seeds.FOREIGN_KEYS)
