"""Column profiles, the checks derived from them and the schema registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators.profile import (
    profile_checks, profile_columns, profile_run, schema_registry,
)
from assayer.plans.runs import Configuration, run_scan
from assayer.sources.tables import Registry
from workload.base import ctes, percent, query
from workload.q_checks import _rated, _seeded
from workload.staging import AS_OF, derived, source

# column -> (type text, category) in table order
TABLES = {
    "orders": {"o_orderkey": ("BIGINT", "n"), "o_custkey": ("BIGINT", "n"),
               "o_orderstatus": ("STRING", "s"), "o_totalprice": ("DOUBLE", "n"),
               "o_orderdate": ("TIMESTAMP_NTZ", "d"), "o_orderpriority": ("STRING", "s")},
    "documents": {"doc_id": ("BIGINT", "n"), "text": ("STRING", "s"), "lang": ("STRING", "s"),
                  "source": ("STRING", "s"), "n_chars": ("BIGINT", "n")},
    "events": {"event_id": ("BIGINT", "n"), "ts": ("TIMESTAMP_NTZ", "d"),
               "user_id": ("BIGINT", "n"), "event_type": ("STRING", "s"),
               "value": ("DOUBLE", "n"), "props": ("STRING", "s")},
    "stg_customer": {**{c: ("STRING", "s") for c in (
        "customer_id", "customer_name", "email", "dob", "phone", "kyc_status", "country",
        "created_date")}, "load_timestamp": ("TIMESTAMP_NTZ", "d"),
        "source_file": ("STRING", "s"), "load_batch_id": ("STRING", "s")},
    "cfg_datasets": {**{c: ("STRING", "s") for c in (
        "dataset_id", "source_database", "source_schema", "source_table", "business_domain",
        "criticality")}, "is_active": ("BOOLEAN", "o"), "incremental_column": ("STRING", "s")},
}
EVENTS_AS_OF = "2024-01-20 00:00:00"


def _line(table: str, i: int, c: str, kind: str, cat: str, as_of: str) -> str:
    low = f"substr(CAST(min({c}) AS VARCHAR), 1, 255)" if cat != "o" else "NULL"
    high = f"substr(CAST(max({c}) AS VARCHAR), 1, 255)" if cat != "o" else "NULL"
    number = f"round(avg({c}), 4), round(stddev_samp({c}), 4)" if cat == "n" else "NULL, NULL"
    length = (f"CAST(min(length({c})) AS BIGINT), CAST(max(length({c})) AS BIGINT), "
              f"round(avg(length({c})), 4)" if cat == "s" else "NULL, NULL, NULL")
    future = (f"CAST(count(*) FILTER (WHERE {c} > TIMESTAMP '{as_of}') AS BIGINT)"
              if cat == "d" else "NULL")
    return f"""SELECT '{c}', '{kind}', CAST({i} AS BIGINT), CAST(count(*) AS BIGINT),
      CAST(count(*) - count({c}) AS BIGINT), CAST(count(DISTINCT {c}) AS BIGINT), {low}, {high},
      {number}, {length}, {future} FROM {table}"""


_NAMES = """column_name, data_type, ordinal_position, total_records, null_count, distinct_count,
  min_value, max_value, avg_value, stddev_value, min_length, max_length, avg_length,
  future_date_count"""


def _profile(table: str, as_of: str) -> str:
    lines = " UNION ALL ".join(_line(table, i, c, kind, cat, as_of)
                               for i, (c, (kind, cat)) in enumerate(TABLES[table].items(), 1))
    return f"profile({_NAMES}) AS ({lines})"


def _sql(table: str, as_of: str, body: str) -> str:
    if table.startswith(("stg_", "cfg_")):
        return ctes([table], body, _profile(table, as_of))
    return f"WITH {_profile(table, as_of)} {body}"


def _frame(spark, sf_dir, table):
    read = derived if table.startswith(("stg_", "cfg_")) else source
    return read(spark, sf_dir, table)


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in ("avg_value", "stddev_value", "avg_length")})


def _register(table: str, as_of: str) -> None:
    @query(f"profile_{table}", _sql(table, as_of, "SELECT * FROM profile"))
    def run(spark, sf_dir):
        return _rounded(profile_columns(_frame(spark, sf_dir, table), as_of))


for _table, _when in (("orders", "2001-01-01 00:00:00"), ("documents", AS_OF),
                      ("events", EVENTS_AS_OF), ("stg_customer", AS_OF),
                      ("cfg_datasets", AS_OF)):
    _register(_table, _when)

_CHECKS = f"""
SELECT column_name, total_records, 'PROFILE_HIGH_NULLS' AS rule_name, 'COMPLETENESS' AS rule_type,
       'FAILED' AS check_status, {percent('total_records - null_count', 'total_records')} AS pass_rate,
       CAST(80 AS DOUBLE) AS threshold, null_count AS invalid_records,
       CAST(CAST((null_count * 2000 + total_records) // (2 * total_records) AS DOUBLE) / 10
            AS VARCHAR) || '% nulls' AS failure_reason
FROM profile WHERE null_count * 100 > total_records * 20
UNION ALL SELECT column_name, total_records, 'PROFILE_NULL_CHECK', 'COMPLETENESS',
       CASE WHEN null_count * 100 > total_records * 5 THEN 'WARNING' ELSE 'PASSED' END,
       {percent('total_records - null_count', 'total_records')}, 95, null_count,
       CASE WHEN null_count * 100 > total_records * 5 THEN
         CAST(CAST((null_count * 2000 + total_records) // (2 * total_records) AS DOUBLE) / 10
              AS VARCHAR) || '% nulls' END
FROM profile WHERE null_count * 100 <= total_records * 20
UNION ALL SELECT column_name, total_records, 'PROFILE_LOW_CARDINALITY', 'UNIQUENESS', 'WARNING',
       {percent('distinct_count', 'total_records')}, 10, total_records - distinct_count,
       'Only ' || CAST(distinct_count AS VARCHAR) || ' distinct values'
FROM profile WHERE distinct_count * 100 < total_records * 10 AND distinct_count > 1
  AND total_records > 10
UNION ALL SELECT column_name, total_records, 'PROFILE_FUTURE_DATES', 'VALIDITY', 'FAILED',
       {percent('total_records - future_date_count', 'total_records')}, 100, future_date_count,
       CAST(future_date_count AS VARCHAR) || ' future dates'
FROM profile WHERE future_date_count > 0"""


def _register_checks(table: str, as_of: str) -> None:
    @query(f"profile_checks_{table}", _sql(table, as_of, _CHECKS))
    def run(spark, sf_dir):
        return profile_checks(profile_columns(_frame(spark, sf_dir, table), as_of))


for _table, _when in (("events", EVENTS_AS_OF), ("stg_customer", AS_OF), ("cfg_datasets", AS_OF)):
    _register_checks(_table, _when)


@query("profile_run", _sql("events", EVENTS_AS_OF, f"""
SELECT CAST(count(*) AS BIGINT) AS total_checks,
       CAST(count(*) FILTER (WHERE check_status = 'PASSED') AS BIGINT) AS passed_checks,
       CAST(count(*) FILTER (WHERE check_status = 'FAILED') AS BIGINT) AS failed_checks,
       CAST(count(*) FILTER (WHERE check_status = 'WARNING') AS BIGINT) AS warning_checks,
       CASE WHEN count(*) FILTER (WHERE check_status = 'FAILED') > 0
            THEN 'COMPLETED_WITH_FAILURES' ELSE 'COMPLETED' END AS run_status
FROM ({_CHECKS}) checks"""))
def run_of_profile(spark, sf_dir):
    return profile_run(profile_checks(profile_columns(source(spark, sf_dir, "events"),
                                                      EVENTS_AS_OF)))


@query("schema_registry_profiled", _sql("orders", AS_OF, """
SELECT 'LAKE' AS database_name, 'BRONZE' AS schema_name, 'ORDERS' AS table_name, column_name,
       data_type, TRUE AS is_nullable, ordinal_position, total_records, null_count FROM profile"""))
def schema_registry_profiled(spark, sf_dir):
    """The columns of a registered table with the rows and NULLs found in each."""
    df = source(spark, sf_dir, "orders")
    registry = schema_registry({("LAKE", "BRONZE", "ORDERS"): df}).drop("column_comment")
    found = profile_columns(df, AS_OF).select("column_name", "total_records", "null_count")
    return registry.join(found, "column_name")


@query("scan_dispatch_full", _sql("stg_customer", AS_OF, f"""
SELECT column_name, rule_name, check_status, pass_rate FROM ({_CHECKS}) checks
UNION ALL SELECT column_name, rule_name, check_status, pass_rate FROM ({_rated(_seeded(("DS_BRONZE_CUSTOMER",)))}) rated"""))
def scan_dispatch_full(spark, sf_dir):
    """A full scan profiles and checks: the derived and the configured checks."""
    registry = Registry(spark).add("DS_BRONZE_CUSTOMER", derived(spark, sf_dir, "stg_customer"))
    done = run_scan(registry, Configuration.shipped(spark), AS_OF, "RUN", "DS_BRONZE_CUSTOMER",
                    "full")
    columns = ("column_name", "rule_name", "check_status", "pass_rate")
    return done["profile"][1].select(*columns).unionByName(done["checks"].results.select(*columns))
