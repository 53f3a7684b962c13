"""Typed tables of the workload and their SQL definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.operators.cleanse import silver_from_bronze
from workload.staging import AS_OF, derived

# Patterns, codes and enumerations of the typed layer, and below its weights and messages.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE = r"^\+?[0-9]{1,4}[-.\s]?[0-9]{3,4}[-.\s]?[0-9]{4}$"
CURRENCIES = ("'USD','EUR','GBP','CAD','JPY','AUD','CHF','CNY','INR','MXN','BRL','NZD','SEK'")
KYC = "('Verified','Pending','Rejected','Incomplete')"
KINDS = "('Savings','Checking','Credit','Investment')"
STATES = "('Active','Inactive','Closed','Frozen')"
MOVES = "('Deposit','Withdrawal','Transfer','Payment')"
ENTITIES = ("customer", "account", "transaction", "daily_balance", "fx_rate")


def silver(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    return silver_from_bronze(derived(spark, sf_dir, f"stg_{entity}"), entity, AS_OF)


def _date(c: str) -> str:
    return f"CAST(try_strptime({c}, '%Y-%m-%d') AS DATE)"


_COLUMNS = {
    "customer": ("customer_id customer_name email dob phone kyc_status country created_date "
                 "load_batch_id"),
    "account": ("account_id customer_id account_type account_status opening_balance opened_date "
                "load_batch_id"),
    "transaction": ("transaction_id account_id transaction_type transaction_amount "
                    "transaction_date load_batch_id"),
    "daily_balance": "account_id balance_date closing_balance load_batch_id",
    "fx_rate": "currency_code rate_date fx_rate_to_usd load_batch_id",
}
_KEYS = {
    "customer": ["customer_id"], "account": ["account_id"], "transaction": ["transaction_id"],
    "daily_balance": ["account_id", _date("balance_date")],
    "fx_rate": ["currency_code", _date("rate_date")],
}
_BLANK = "({0} IS NULL OR trim({0}) = '')".format
_BAD_EMAIL = f"(email IS NULL OR NOT regexp_matches(email, '{EMAIL}'))"
_MONEY = "TRY_CAST({} AS DECIMAL(18,2))".format
_RATE = "TRY_CAST(fx_rate_to_usd AS DECIMAL(18,6))"
_BAD_RATE = f"({_RATE} IS NULL OR {_RATE} <= 0)"

# entity -> (typed columns, invalid condition, [(weight, condition)], [(condition, message)])
_RULES = {
    "customer": (
        f"customer_id, customer_name, email, {_date('dob')} AS dob, phone, kyc_status, country, "
        f"{_date('created_date')} AS created_date",
        f"{_BLANK('customer_id')} OR {_date('dob')} IS NULL OR {_BAD_EMAIL}",
        [(20, f"NOT {_BLANK('customer_id')}"), (15, "customer_name IS NOT NULL"),
         (20, f"NOT {_BAD_EMAIL}"), (15, f"{_date('dob')} IS NOT NULL"),
         (10, "phone IS NOT NULL"), (10, f"kyc_status IN {KYC}"), (10, "country IS NOT NULL")],
        [(_BLANK("customer_id"), "Missing customer_id"),
         (f"{_date('dob')} IS NULL", "Invalid date of birth"),
         (_BAD_EMAIL, "Invalid email format"), (f"kyc_status NOT IN {KYC}", "Invalid KYC status")]),
    "account": (
        f"account_id, customer_id, account_type, account_status, "
        f"{_MONEY('opening_balance')} AS opening_balance, {_date('opened_date')} AS opened_date",
        f"{_BLANK('account_id')} OR {_BLANK('customer_id')} "
        f"OR {_MONEY('opening_balance')} IS NULL",
        [(25, f"NOT {_BLANK('account_id')}"), (25, f"NOT {_BLANK('customer_id')}"),
         (15, f"account_type IN {KINDS}"), (15, f"account_status IN {STATES}"),
         (20, f"{_MONEY('opening_balance')} IS NOT NULL")],
        [(_BLANK("account_id"), "Missing account_id"),
         (_BLANK("customer_id"), "Missing customer_id"),
         (f"{_MONEY('opening_balance')} IS NULL", "Invalid opening_balance"),
         (f"account_type NOT IN {KINDS}", "Invalid account_type"),
         (f"account_status NOT IN {STATES}", "Invalid account_status")]),
    "transaction": (
        f"transaction_id, account_id, transaction_type, "
        f"{_MONEY('transaction_amount')} AS transaction_amount, "
        f"{_date('transaction_date')} AS transaction_date",
        f"{_BLANK('transaction_id')} OR {_BLANK('account_id')} "
        f"OR {_MONEY('transaction_amount')} IS NULL OR {_date('transaction_date')} IS NULL",
        [(25, f"NOT {_BLANK('transaction_id')}"), (25, f"NOT {_BLANK('account_id')}"),
         (15, f"transaction_type IN {MOVES}"),
         (20, f"{_MONEY('transaction_amount')} IS NOT NULL"),
         (15, f"{_date('transaction_date')} IS NOT NULL")],
        [(_BLANK("transaction_id"), "Missing transaction_id"),
         (_BLANK("account_id"), "Missing account_id"),
         (f"{_MONEY('transaction_amount')} IS NULL", "Invalid transaction_amount"),
         (f"{_date('transaction_date')} IS NULL", "Invalid transaction_date"),
         (f"transaction_type NOT IN {MOVES}", "Invalid transaction_type")]),
    "daily_balance": (
        f"account_id, {_date('balance_date')} AS balance_date, "
        f"{_MONEY('closing_balance')} AS closing_balance",
        f"{_BLANK('account_id')} OR {_date('balance_date')} IS NULL "
        f"OR {_MONEY('closing_balance')} IS NULL",
        [(35, f"NOT {_BLANK('account_id')}"), (35, f"{_date('balance_date')} IS NOT NULL"),
         (30, f"{_MONEY('closing_balance')} IS NOT NULL")],
        [(_BLANK("account_id"), "Missing account_id"),
         (f"{_date('balance_date')} IS NULL", "Invalid balance_date"),
         (f"{_MONEY('closing_balance')} IS NULL", "Invalid closing_balance")]),
    "fx_rate": (
        f"currency_code, {_date('rate_date')} AS rate_date, {_RATE} AS fx_rate_to_usd",
        f"{_BLANK('currency_code')} OR {_date('rate_date')} IS NULL OR {_BAD_RATE}",
        [(35, f"currency_code IN ({CURRENCIES})"), (30, f"{_date('rate_date')} IS NOT NULL"),
         (35, f"NOT {_BAD_RATE}")],
        [(_BLANK("currency_code"), "Missing currency_code"),
         (f"{_date('rate_date')} IS NULL", "Invalid rate_date"),
         (_BAD_RATE, "Invalid fx_rate_to_usd"),
         (f"currency_code NOT IN ({CURRENCIES})", "Invalid currency_code")]),
}


def silver_sql(entity: str) -> str:
    """``silver_<entity>`` as a named subquery over ``stg_<entity>``."""
    columns, invalid, score, messages = _RULES[entity]
    keys = _KEYS[entity]
    order = ", ".join(["load_timestamp DESC NULLS LAST",
                       *[f"{c} DESC NULLS LAST" for c in _COLUMNS[entity].split()]])
    points = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for w, c in score)
    errors = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in messages)
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""silver_{entity} AS (
      SELECT {columns}, NOT coalesce({invalid}, FALSE) AS is_valid,
             CAST({points} AS DOUBLE) AS dq_score,
             concat_ws('; ', {errors}) AS validation_errors,
             'BRONZE_STG_{entity.upper()}' AS source_system, '{AS_OF}' AS load_timestamp,
             load_batch_id AS bronze_load_batch_id
      FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}) AS rn
            FROM stg_{entity} WHERE {present}) ranked WHERE rn = 1)"""
