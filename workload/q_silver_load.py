"""Loads into the typed tables and lasting surrogate keys, each loaded twice and read back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.keys import KeyMap
from assayer.plans.silver import KEY_NAMES, SilverTable, load_silver
from workload.base import ctes, fresh_dir, query
from workload.silver import ENTITIES, silver_sql
from workload.staging import AS_OF, derived

LATER = "2024-02-01 08:00:00"
#: Entity -> which landed rows the first and the second load take, what the second changes, and the typed columns.
LOADS = {
    "customer": ("load_timestamp < {stamp} '2024-01-20 00:00:00'", "load_timestamp > {stamp} '2024-01-15 00:00:00'",
                 ("phone", "CASE WHEN length(phone) = 5 THEN NULL ELSE '+00-555-0000' END"),
                 "customer_id customer_name email dob phone kyc_status country created_date"),
    "account": ("load_batch_id <> 'BATCH_O'", "load_batch_id <> 'BATCH_P'",
                ("account_status", "CASE WHEN account_type = 'Credit' THEN 'Frozen' ELSE account_status END"),
                "account_id customer_id account_type account_status opening_balance opened_date"),
    "transaction": ("transaction_type <> 'Payment' OR transaction_type IS NULL", "transaction_type <> 'Deposit' OR transaction_type IS NULL",
                    ("transaction_type", "upper(transaction_type)"),
                    "transaction_id account_id transaction_type transaction_amount transaction_date"),
    "daily_balance": ("balance_date < '2024-01-20'", "balance_date > '2024-01-15'",
                      ("closing_balance", "CASE WHEN closing_balance LIKE '-%' THEN '0' ELSE closing_balance END"),
                      "account_id balance_date closing_balance"),
    "fx_rate": ("load_batch_id IS NOT NULL", "currency_code IN ('USD', 'EUR', 'GBP')",
                ("fx_rate_to_usd", "'1.5'"), "currency_code rate_date fx_rate_to_usd"),
}
KEYS = {"customer": ["customer_id"], "account": ["account_id"], "transaction": ["transaction_id"],
        "daily_balance": ["account_id", "balance_date"], "fx_rate": ["currency_code", "rate_date"]}
_AS_TEXT = {"dob", "created_date", "opened_date", "transaction_date", "balance_date", "rate_date"}
_AS_NUMBER = {"opening_balance", "transaction_amount", "closing_balance", "fx_rate_to_usd"}


def loads(spark: SparkSession, sf_dir: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """The landed rows of the first and of the second load."""
    first, second, (column, changed), _ = LOADS[entity]
    staged = derived(spark, sf_dir, f"stg_{entity}")
    return (staged.where(first.format(stamp="TIMESTAMP_NTZ")),
            staged.where(second.format(stamp="TIMESTAMP_NTZ")).withColumn(column, F.expr(changed)))


def load_sql(entity: str) -> list[str]:
    """Both loads as named subqueries, then ``first_keys`` and ``second_keys`` with their numbers."""
    first, second, (column, changed), _ = LOADS[entity]
    keys = ", ".join(KEYS[entity])
    digest = "md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in KEYS[entity]) + "))"
    typed = silver_sql(entity)

    def load(name: str) -> str:
        return typed.replace(f"silver_{entity} AS", f"{name} AS").replace(f"FROM stg_{entity}", f"FROM landed_{name}")

    return [
        f"landed_first AS (SELECT * FROM stg_{entity} WHERE {first.format(stamp='TIMESTAMP')})",
        f"landed_second AS (SELECT * REPLACE ({changed} AS {column}) FROM stg_{entity} WHERE {second.format(stamp='TIMESTAMP')})",
        load("first"), load("second"),
        f"first_keys AS (SELECT {keys}, row_number() OVER (ORDER BY {digest}, {keys}) AS number FROM first)",
        f"""second_keys AS (SELECT {keys}, (SELECT coalesce(max(number), 0) FROM first_keys)
          + row_number() OVER (ORDER BY {digest}, {keys}) AS number
          FROM second ANTI JOIN first_keys USING ({keys}))""",
        "keys AS (FROM first_keys UNION ALL FROM second_keys)"]


def _column(name: str) -> str:
    return (f"CAST(r.{name} AS VARCHAR) AS {name}" if name in _AS_TEXT else
            f"CAST(r.{name} AS DOUBLE) AS {name}" if name in _AS_NUMBER else f"r.{name}")


def _table_sql(entity: str) -> str:
    keys = ", ".join(KEYS[entity])
    columns = ", ".join(_column(c) for c in LOADS[entity][3].split())
    return f"""
SELECT CAST(k.number AS BIGINT) AS {KEY_NAMES[entity]}, {columns}, r.is_valid, r.dq_score, r.validation_errors,
       r.source_system, r.bronze_load_batch_id, r.load_timestamp, r.updated_timestamp
FROM (SELECT *, '{AS_OF}' AS updated_timestamp FROM first ANTI JOIN second USING ({keys})
      UNION ALL BY NAME
      SELECT s.* REPLACE (CASE WHEN f.source_system IS NULL THEN '{LATER}' ELSE '{AS_OF}' END AS load_timestamp),
             '{LATER}' AS updated_timestamp
      FROM second s LEFT JOIN first f USING ({keys})) r JOIN keys k USING ({keys})"""


def _register(entity: str) -> None:
    @query(f"load_silver_{entity}", ctes([f"stg_{entity}"], _table_sql(entity), *load_sql(entity)))
    def run(spark, sf_dir):
        table = SilverTable(spark, fresh_dir(spark, f"silver-{entity}"), entity, rows_per_bucket=5_000)
        first, second = loads(spark, sf_dir, entity)
        table.load(first, AS_OF, "LOAD_1")
        table.load(second, LATER, "LOAD_2")
        return table.read()


for _entity in ENTITIES:
    _register(_entity)


def _counts_sql() -> str:
    def text(entity: str) -> list[str]:
        return [re.sub(r"\b(landed_first|landed_second|first|second)\b(?= AS \(| WHERE| ranked|\)|$)|(?<=FROM )(landed_first|landed_second)\b",
                       lambda m: f"{entity}_{m[0]}", part) for part in load_sql(entity)[:4]]

    lines = [f"""
SELECT '{e}' AS entity,
       (SELECT count(*) FROM {e}_second ANTI JOIN {e}_first USING ({', '.join(KEYS[e])})) AS rows_inserted,
       (SELECT count(*) FROM {e}_second SEMI JOIN {e}_first USING ({', '.join(KEYS[e])})) AS rows_updated""" for e in ENTITIES]
    return ctes([f"stg_{e}" for e in ENTITIES], " UNION ALL ".join(lines), *[p for e in ENTITIES for p in text(e)])


@query("load_silver_counts", _counts_sql())
def load_silver_counts(spark, sf_dir):
    """What the second load of all five entities inserted and updated."""
    root = fresh_dir(spark, "silver")
    landed = {e: loads(spark, sf_dir, e) for e in ENTITIES}
    load_silver(spark, {e: pair[0] for e, pair in landed.items()}, root, AS_OF, "LOAD_1")
    return load_silver(spark, {e: pair[1] for e, pair in landed.items()}, root, LATER, "LOAD_2").drop("buckets_written")


@query("surrogate_keys_second_load", ctes(["stg_transaction"], """
SELECT transaction_id, CAST(number AS BIGINT) AS transaction_key FROM numbers""", """
ids AS (SELECT transaction_id, bool_or(transaction_type = 'Deposit') AS early FROM stg_transaction
        WHERE transaction_id IS NOT NULL GROUP BY transaction_id)""", """
numbers AS (SELECT transaction_id, row_number() OVER (
              ORDER BY coalesce(early, FALSE) DESC, md5(transaction_id), transaction_id) AS number FROM ids)"""))
def surrogate_keys_second_load(spark, sf_dir):
    """Deposits first, then all transactions: those known keep their number, the others follow on."""
    staged = derived(spark, sf_dir, "stg_transaction")
    keys = KeyMap(spark, fresh_dir(spark, "keys"), ("transaction_id",), "transaction_key", per_task=2_000)
    keys.extend(staged.where("transaction_type = 'Deposit'"), "LOAD_1")
    keys.extend(staged, "LOAD_2")
    return keys.known().select("transaction_id", "transaction_key")
