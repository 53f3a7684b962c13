"""Landing, configuration and history tables derived from the driver's tables.

Each derived table is one SELECT that both Spark and the comparison engine run,
so that a comparison exercises the operators and not the derivation.  Defects
come from the data's own values (balances, prices, flags); every row is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30 12:00:00"
HISTORY_AS_OF = "2001-10-01 12:00:00"
# Moves order and ship dates so that the newest lie around AS_OF.
SHIFT_DAYS = 8200
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "labels", "pages", "conversations")


class SparkDialect:
    stamp = "TIMESTAMP_NTZ"

    @staticmethod
    def plus_days(d: str, n: str) -> str:
        return f"date_add({d}, CAST({n} AS INT))"

    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"(({a}) DIV ({b}))"


class DuckDialect:
    stamp = "TIMESTAMP"

    @staticmethod
    def plus_days(d: str, n: str) -> str:
        return f"({d} + CAST({n} AS INT))"

    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"(({a}) // ({b}))"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _customer(q) -> str:
    born = q.plus_days("DATE '1950-01-01'", "floor(abs(c_acctbal))")
    since = q.plus_days("DATE '2024-01-30'", "0 - floor(abs(c_acctbal) / 25)")
    loaded = q.plus_days("DATE '2024-01-30'", "0 - c_nationkey")
    return f"""
    SELECT CASE WHEN c_acctbal < -970 THEN NULL WHEN c_acctbal < -950 THEN '  '
                ELSE 'CUST' || {_s('c_custkey')} END AS customer_id,
           CASE WHEN c_acctbal > 9800 THEN NULL ELSE c_name END AS customer_name,
           CASE WHEN c_acctbal BETWEEN 5000 AND 5300 THEN NULL
                WHEN c_acctbal < -500 THEN lower(replace(c_name, '#', '.')) || '.example.com'
                ELSE lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment)
                     || '.example.com' END AS email,
           CASE WHEN c_acctbal BETWEEN 0 AND 200 THEN 'unknown'
                WHEN c_acctbal BETWEEN 200 AND 400 THEN '03/05/1990'
                WHEN c_acctbal BETWEEN 400 AND 500 THEN NULL
                WHEN c_acctbal BETWEEN 500 AND 600 THEN '2999-12-31'
                WHEN c_acctbal BETWEEN 600 AND 700 THEN '1850-01-01'
                ELSE {_s(born)} END AS dob,
           CASE WHEN c_acctbal BETWEEN 1000 AND 1500 THEN '12345'
                WHEN c_acctbal BETWEEN 1500 AND 1600 THEN NULL
                ELSE '+' || {_s('10 + c_nationkey')} || '-555-' || substr(c_name, -4)
                END AS phone,
           CASE WHEN c_acctbal BETWEEN 9000 AND 9100 THEN NULL
                WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Verified'
                WHEN c_mktsegment = 'BUILDING' THEN 'Pending'
                WHEN c_mktsegment = 'FURNITURE' THEN 'Rejected'
                WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Incomplete'
                ELSE 'Unknown' END AS kyc_status,
           CASE WHEN c_acctbal BETWEEN 8000 AND 8100 THEN NULL
                WHEN r_name = 'AFRICA' THEN 'India' WHEN r_name = 'AMERICA' THEN 'USA'
                WHEN r_name = 'ASIA' THEN 'Japan' WHEN r_name = 'EUROPE' THEN 'Germany'
                ELSE n_name END AS country,
           CASE WHEN c_acctbal BETWEEN 2000 AND 2100 THEN '31-02-2023'
                ELSE {_s(since)} END AS created_date,
           CAST({loaded} AS {q.stamp}) + INTERVAL '6' HOUR AS load_timestamp,
           lower(r_name) || '.csv' AS source_file,
           'BATCH_' || {_s('c_nationkey')} AS load_batch_id
    FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
         JOIN {{region}} ON n_regionkey = r_regionkey"""


def _account(q) -> str:
    opened = q.plus_days("CAST(o_orderdate AS DATE)", str(SHIFT_DAYS))
    price = _s("CAST(o_totalprice AS DECIMAL(18,2))")
    return f"""
    SELECT CASE WHEN o_totalprice < 1500 THEN NULL ELSE 'ACC' || {_s('o_orderkey')} END AS account_id,
           CASE WHEN o_totalprice > 495000 THEN 'GONE' || {_s('o_custkey')}
                WHEN o_totalprice < 2000 THEN NULL
                ELSE 'CUST' || {_s('o_custkey')} END AS customer_id,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'Savings'
                WHEN o_orderpriority = '2-HIGH' THEN 'Checking'
                WHEN o_orderpriority = '3-MEDIUM' THEN 'Credit'
                WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Investment'
                WHEN o_totalprice > 400000 THEN 'CURRENT' ELSE 'Savings' END AS account_type,
           CASE WHEN o_orderstatus = 'F' THEN 'Active' WHEN o_orderstatus = 'O' THEN 'Inactive'
                WHEN o_totalprice > 250000 THEN 'Frozen' WHEN o_totalprice > 240000 THEN 'BLOCKED'
                ELSE 'Closed' END AS account_status,
           CASE WHEN o_totalprice BETWEEN 100000 AND 102000 THEN 'XYZ'
                WHEN o_totalprice BETWEEN 102000 AND 103000 THEN NULL
                WHEN o_totalprice < 10000 THEN '-' || {price}
                ELSE {price} END AS opening_balance,
           CASE WHEN o_totalprice BETWEEN 200000 AND 202000 THEN '31-02-2023'
                WHEN o_totalprice BETWEEN 202000 AND 203000 THEN '2999-12-31'
                ELSE {_s(opened)} END AS opened_date,
           CAST({opened} AS {q.stamp}) + INTERVAL '9' HOUR AS load_timestamp,
           'accounts_' || o_orderstatus || '.csv' AS source_file,
           'BATCH_' || o_orderstatus AS load_batch_id
    FROM {{orders}}"""


def _transaction(q) -> str:
    when = q.plus_days("CAST(l_shipdate AS DATE)", str(SHIFT_DAYS))
    loaded = q.plus_days("DATE '2024-01-30'", "1 - l_linenumber")
    price = _s("CAST(l_extendedprice AS DECIMAL(18,2))")
    return f"""
    SELECT 'TX' || {_s('l_orderkey')} || '-' || {_s('l_linenumber')} AS transaction_id,
           CASE WHEN l_extendedprice > 104000 THEN 'LOST' || {_s('l_orderkey')}
                WHEN l_extendedprice < 1000 THEN NULL
                ELSE 'ACC' || {_s('l_orderkey')} END AS account_id,
           CASE WHEN l_returnflag = 'A' THEN 'Deposit' WHEN l_returnflag = 'N' THEN 'Withdrawal'
                WHEN l_tax > 0.075 THEN 'Refund' WHEN l_linestatus = 'F' THEN 'Transfer'
                ELSE 'Payment' END AS transaction_type,
           CASE WHEN l_quantity = 13 AND l_discount > 0.085 THEN 'n.a.'
                WHEN l_quantity = 17 THEN '0.00'
                WHEN l_quantity = 19 THEN '0.4'
                WHEN l_quantity = 23 AND l_tax < 0.01 THEN NULL
                WHEN l_returnflag = 'R' AND l_discount > 0.095 THEN '-' || {price}
                ELSE {price} END AS transaction_amount,
           CASE WHEN l_quantity = 7 AND l_tax < 0.005 THEN 'not-a-date'
                WHEN l_quantity = 8 AND l_tax < 0.005 THEN NULL
                ELSE {_s(when)} END AS transaction_date,
           CAST({loaded} AS {q.stamp}) + INTERVAL '6' HOUR AS load_timestamp,
           'transactions_' || l_linestatus || '.csv' AS source_file,
           'BATCH_' || {_s('l_linenumber')} AS load_batch_id
    FROM {{lineitem}}"""


def _daily_balance(q) -> str:
    return f"""
    SELECT CASE WHEN value < 0.5 THEN 'NOBODY' ELSE 'ACC' || {_s('user_id')} END AS account_id,
           {_s('CAST(ts AS DATE)')} AS balance_date,
           CASE WHEN value > 250 THEN NULL WHEN event_type = 'error' AND value > 150 THEN 'n/k'
                ELSE {_s('CAST(value AS DECIMAL(18,2))')} END AS closing_balance,
           ts AS load_timestamp,
           event_type || '.csv' AS source_file,
           'BATCH_' || event_type AS load_batch_id
    FROM {{events}}"""


def _fx_rate(q) -> str:
    when = q.plus_days("DATE '2024-02-01'", "0 - p_size * 3")
    return f"""
    SELECT CASE WHEN p_type = 'ECONOMY' THEN 'EUR' WHEN p_type = 'PROMO' THEN 'GBP'
                WHEN p_type = 'MEDIUM' THEN 'BRL' WHEN p_type = 'LARGE' THEN 'JPY'
                WHEN p_size > 45 THEN NULL WHEN p_size > 25 THEN 'XXX' ELSE 'CHF'
                END AS currency_code,
           CASE WHEN p_size = 33 THEN 'soon' ELSE {_s(when)} END AS rate_date,
           CASE WHEN p_size = 34 THEN 'free' WHEN p_size = 35 THEN '0.3'
                WHEN p_size = 36 THEN '-1.25'
                ELSE {_s('CAST(p_retailprice AS DECIMAL(18,6))')} END AS fx_rate_to_usd,
           CAST(DATE '2024-01-29' AS {q.stamp}) + INTERVAL '3' HOUR AS load_timestamp,
           p_brand || '.csv' AS source_file,
           'BATCH_' || p_type AS load_batch_id
    FROM {{part}}"""


def _history(q) -> str:
    total = "(l_partkey + 100)"
    invalid = f"CAST(floor({total} * l_discount) AS BIGINT)"
    cents = q.idiv(f"({total} - {invalid}) * 20000 + {total}", f"2 * {total}")
    return f"""
    SELECT *, CASE WHEN line = 7 THEN 'ERROR' WHEN pass_rate >= threshold THEN 'PASSED'
                   WHEN pass_rate >= threshold - 5 THEN 'WARNING' ELSE 'FAILED'
              END AS check_status
    FROM (
      SELECT {_s('l_orderkey')} || '-' || {_s('l_linenumber')} || '-' || {_s('l_partkey')}
               || '-' || {_s('l_suppkey')} AS check_id,
             'RUN_' || {_s('CAST(l_shipdate AS DATE)')} || '_' || l_linestatus AS run_id,
             CAST(l_shipdate AS {q.stamp}) AS check_timestamp,
             'DS_' || l_returnflag || l_linestatus AS dataset_id,
             'LAKE' AS database_name, 'BRONZE' AS schema_name,
             'T_' || l_returnflag || l_linestatus AS table_name,
             CASE WHEN l_linenumber < 6 THEN 'c' || {_s('l_linenumber')} END AS column_name,
             'CHECK_' || {_s('l_linenumber')} AS rule_name,
             CASE l_linenumber WHEN 1 THEN 'COMPLETENESS' WHEN 2 THEN 'UNIQUENESS'
                  WHEN 3 THEN 'VALIDITY' WHEN 4 THEN 'CONSISTENCY' WHEN 5 THEN 'FRESHNESS'
                  WHEN 6 THEN 'VOLUME' ELSE 'CONFIGURATION' END AS rule_type,
             CAST(l_linenumber AS INT) AS line,
             CASE WHEN l_linenumber = 7 THEN 0 ELSE {total} END AS total_records,
             CASE WHEN l_linenumber = 7 THEN 0 ELSE {invalid} END AS invalid_records,
             CASE WHEN l_linenumber = 7 THEN CAST(0 AS DECIMAL(10,2))
                  ELSE CAST({cents} * 0.01 AS DECIMAL(10,2)) END AS pass_rate,
             CAST(90 + l_tax * 100 AS DECIMAL(10,2)) AS threshold,
             CAST(0.5 * l_linenumber AS DECIMAL(5,2)) AS weight,
             CAST(l_quantity AS BIGINT) * 10 AS execution_time_ms,
             CAST(CAST(l_quantity AS INT) * 0.000001 AS DECIMAL(10,6)) AS execution_credits,
             CASE WHEN l_linestatus = 'O' THEN 'INCREMENTAL' ELSE 'FULL' END AS scan_scope
      FROM {{lineitem}}) history"""


def _history_datasets(q) -> str:
    return """
    SELECT DISTINCT 'DS_' || l_returnflag || l_linestatus AS dataset_id,
           CASE WHEN l_linestatus = 'O' THEN 'OPEN_DOMAIN' ELSE 'FINAL_DOMAIN' END
             AS business_domain,
           CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'A'
                THEN CAST(94 AS DECIMAL(10,2)) ELSE CAST(85 AS DECIMAL(10,2)) END AS sla_threshold
    FROM {lineitem}"""


def _metrics(q) -> str:
    return f"""
    SELECT CASE WHEN value < 1 THEN NULL ELSE 'Lake.Events.' || event_type END AS asset_id,
           CASE WHEN value BETWEEN 1 AND 2 THEN NULL ELSE 'dq_score' END AS metric_name,
           CASE WHEN value BETWEEN 2 AND 4 THEN NULL
                ELSE CAST(100 - CAST(least(value, 100) AS DECIMAL(10,2)) AS DOUBLE)
                END AS metric_value,
           ts AS metric_time,
           CASE WHEN event_type = 'click' THEN NULL ELSE 'EVENTS' END AS source_system,
           {_s('event_id')} AS run_id, props AS tags
    FROM {{events}}"""


def _cfg_datasets(q) -> str:
    return f"""
    SELECT 'DS_' || {_s('s_suppkey')} AS dataset_id, 'LAKE' AS source_database,
           n_name AS source_schema, upper(s_name) AS source_table, r_name AS business_domain,
           CASE WHEN s_acctbal > 7000 THEN 'CRITICAL' WHEN s_acctbal > 4000 THEN 'HIGH'
                WHEN s_acctbal > 1000 THEN 'MEDIUM' ELSE 'LOW' END AS criticality,
           s_acctbal > 0 AS is_active,
           CASE WHEN s_nationkey < 12 THEN 'load_timestamp' END AS incremental_column
    FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
         JOIN {{region}} ON n_regionkey = r_regionkey"""


def _cfg_rules(q) -> str:
    return """
    SELECT p_partkey AS rule_id, p_name AS rule_name,
           CASE p_type WHEN 'ECONOMY' THEN 'COMPLETENESS' WHEN 'PROMO' THEN 'UNIQUENESS'
                WHEN 'MEDIUM' THEN 'VALIDITY' WHEN 'LARGE' THEN 'CONSISTENCY'
                ELSE 'VOLUME' END AS rule_type,
           CASE WHEN p_size > 40 THEN 'TABLE' ELSE 'COLUMN' END AS rule_level,
           p_brand AS description, p_size > 5 AS is_active, p_retailprice > 910 AS has_check
    FROM {part}"""


def _cfg_mappings(q) -> str:
    return f"""
    SELECT l_orderkey * 10 + l_linenumber AS config_id, 'DS_' || {_s('l_suppkey')} AS dataset_id,
           l_partkey AS rule_id,
           CASE WHEN l_linenumber < 7 THEN 'c' || {_s('l_linenumber')} END AS column_name,
           CAST(90 + l_discount * 100 AS DECIMAL(10,2)) AS threshold_value,
           l_linestatus = 'O' AS is_active
    FROM {{lineitem}}"""


def _cfg_weights(q) -> str:
    start = q.plus_days("DATE '2024-01-20'", "min(p_size)")
    return f"""
    SELECT rule_type, business_domain, CAST(max(p_size) * 0.05 AS DECIMAL(5,2)) AS weight,
           1 + CAST(floor(max(p_size) / 13) AS BIGINT) AS priority, {start} AS effective_date,
           CASE WHEN rule_type = 'UNIQUENESS' THEN DATE '2024-01-29'
                WHEN rule_type = 'VALIDITY' THEN DATE '2024-12-31' END AS expiry_date,
           TRUE AS is_active
    FROM (SELECT p_size,
                 CASE p_type WHEN 'ECONOMY' THEN 'COMPLETENESS' WHEN 'PROMO' THEN 'UNIQUENESS'
                      WHEN 'MEDIUM' THEN 'VALIDITY' WHEN 'LARGE' THEN 'CONSISTENCY'
                      ELSE 'VOLUME' END AS rule_type,
                 CASE WHEN p_size <= 5 THEN 'AFRICA' WHEN p_size <= 9 THEN 'AMERICA'
                      WHEN p_size <= 14 THEN 'ASIA' ELSE 'EUROPE' END AS business_domain
          FROM {{part}}) sized
    GROUP BY rule_type, business_domain"""


def _lineage(q) -> str:
    return f"""
    SELECT DISTINCT 'LAKE' AS upstream_database, p_type AS upstream_schema,
           p_brand AS upstream_table, 'LAKE' AS downstream_database,
           n_name AS downstream_schema, s_name AS downstream_table,
           CASE WHEN l_returnflag = 'A' THEN 'DIRECT' WHEN l_returnflag = 'N'
                THEN 'TRANSFORMATION' ELSE 'AGGREGATION' END AS lineage_type,
           'line ' || {_s('l_linenumber')} AS transformation_logic
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
         JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey"""


TABLES: dict[str, Callable] = {
    "stg_customer": _customer, "stg_account": _account, "stg_transaction": _transaction,
    "stg_daily_balance": _daily_balance, "stg_fx_rate": _fx_rate,
    "history": _history, "history_datasets": _history_datasets, "metrics": _metrics,
    "cfg_datasets": _cfg_datasets, "cfg_rules": _cfg_rules, "cfg_mappings": _cfg_mappings,
    "cfg_weights": _cfg_weights, "lineage": _lineage,
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a lazy DataFrame."""
    text = TABLES[name](SparkDialect)
    used = {t: source(spark, sf_dir, t) for t in SOURCES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck_cte(name: str) -> str:
    """The same table as a named subquery for the comparison engine."""
    text = TABLES[name](DuckDialect).format(**{t: t for t in SOURCES})
    return f"{name} AS ({text})"
