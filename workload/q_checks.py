"""Rules, check runs, failures and run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import results as shape
from assayer.operators.evaluate import daily_volume, evaluate
from assayer.operators.rules import rule
from assayer.plans import seeds
from assayer.plans.runs import (
    Configuration, execute, profile_dataset, run_batch, run_checks, run_rule, run_scan,
)
from assayer.sources.tables import Registry, cut_lineage
from workload.base import ctes, fresh_dir, half_up, percent, query
from workload.silver import (
    CURRENCIES, EMAIL, ENTITIES, KINDS, KYC, MOVES, PHONE, STATES, silver, silver_sql,
)
from workload.staging import AS_OF, derived, source

STAGES = [f"stg_{e}" for e in ENTITIES]
TODAY = "DATE '2024-01-30'"
DATASET_OF = {f"stg_{e}": f"DS_BRONZE_{e.upper()}" for e in ENTITIES}
PARENTS = {"customer_id": ("stg_customer", "customer_id"),
           "account_id": ("stg_account", "account_id")}
ALLOWED = {"kyc_status": KYC, "account_type": KINDS, "account_status": STATES,
           "transaction_type": MOVES}
COUNTRIES = "('USA','Canada','UK','Mexico','India','Australia','Germany','France','Japan','China')"


def _error(name: str, c: str | None, threshold: float, **p) -> str:
    """Error condition of a row rule in the comparison engine's dialect."""
    num, date = f"TRY_CAST({c} AS DECIMAL(38,{p.get('scale', 0)}))", f"TRY_CAST({c} AS DATE)"
    given = f"{c} IS NOT NULL"
    return {
        "COMPLETENESS_CHECK": f"{c} IS NULL",
        "COMPLETENESS_CRITICAL_COLUMNS": " OR ".join(
            f"{x} IS NULL" for x in p.get("columns", ())) or "FALSE",
        "VALIDITY_EMAIL_FORMAT": f"NOT regexp_matches({c}, '{EMAIL}')",
        "VALIDITY_PHONE_FORMAT": f"NOT regexp_matches({c}, '{PHONE}')",
        "VALIDITY_DATE_FORMAT": f"{given} AND {date} IS NULL",
        "VALIDITY_NUMERIC_FORMAT": f"{given} AND {num} IS NULL",
        "VALIDITY_POSITIVE_NUMBER": f"{given} AND ({num} IS NULL OR {num} <= 0)",
        "VALIDITY_NON_NEGATIVE_NUMBER": f"{given} AND ({num} IS NULL OR {num} < 0)",
        "VALIDITY_ALLOWED_VALUES": f"{c} NOT IN {p.get('allowed') or ALLOWED.get(c, '()')}",
        "VALIDITY_DATE_RANGE": f"{given} AND ({date} IS NULL OR {date} > {TODAY} "
                               f"OR {date} < DATE '1900-01-01')",
        "VALIDITY_COUNTRY_CODE": f"{c} NOT IN {COUNTRIES}",
        "VALIDITY_CURRENCY_CODE": f"{c} NOT IN ({p.get('codes', CURRENCIES)})",
        "FRESHNESS_DATA_RECENCY":
            f"{date} < {TODAY} - {int(p.get('max_age_days', threshold))}",
        "CONSISTENCY_LOGICAL_RELATIONSHIP": f"NOT ({p.get('holds')})",
    }[name]


def _counts(table: str, name: str, c: str | None, threshold: float, where: str = "TRUE",
            **p) -> str:
    """Total and error count of one check as a subquery."""
    head = (f"SELECT '{p.get('dataset') or DATASET_OF.get(table, table)}' AS dataset_id, "
            f"'{name}' AS rule_name, "
            f"{repr(c) if c else 'NULL'} AS column_name, CAST({threshold} AS DOUBLE) AS threshold, ")
    if name == "UNIQUENESS_PRIMARY_KEY":
        return head + f"count(*) AS t, count(*) - count(DISTINCT {c}) AS e FROM {table} WHERE {where}"
    if name == "UNIQUENESS_COMPOSITE_KEY":
        keys = p["columns"]
        full = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        return head + (f"count(*) AS t, count(*) - count(DISTINCT CASE WHEN {full} THEN "
                       f"({', '.join(keys)}) END) AS e FROM {table} WHERE {where}")
    if name == "CONSISTENCY_FOREIGN_KEY":
        parent, key = p.get("parent") or PARENTS[c]
        keys = (f"(SELECT {key} AS pk FROM {parent} WHERE {key} IS NOT NULL)" if p.get("joined")
                else f"(SELECT DISTINCT {key} AS pk FROM {parent} WHERE {key} IS NOT NULL)")
        return head + (f"count(*) AS t, count(*) - count(pk) AS e FROM {table} LEFT JOIN {keys} p "
                       f"ON {c} = pk WHERE {c} IS NOT NULL AND ({where})")
    if name == "VOLUME_ROW_COUNT_THRESHOLD":
        return head + (f"count(*) AS t, CASE WHEN count(*) < {p.get('min_rows', 1)} THEN 1 ELSE 0 "
                       f"END AS e FROM {table} WHERE {where}")
    if name == "FRESHNESS_LOAD_TIMESTAMP":
        return head + (f"1 AS t, CASE WHEN max({c or 'load_timestamp'}) < TIMESTAMP '{AS_OF}' "
                       f"- INTERVAL {p['max_age_days']} DAY THEN 1 ELSE 0 END AS e "
                       f"FROM {table} WHERE {where}")
    return head + (f"count(*) AS t, coalesce(sum(CASE WHEN {_error(name, c, threshold, **p)} "
                   f"THEN 1 ELSE 0 END), 0) AS e FROM {table} WHERE {where}")


def _rated(parts: list[str], label: str = "") -> str:
    """Pass rate, status and reason for every counted check."""
    rate = f"coalesce({percent('(t - e)', 't')}, 100.0)"
    return f"""SELECT dataset_id, rule_name, column_name, total_records, invalid_records, pass_rate,
       threshold, check_status,
       CASE check_status
         WHEN 'FAILED' THEN {label}'Pass rate ' || CAST(pass_rate AS VARCHAR) || '% below threshold '
           || CAST(threshold AS VARCHAR) || '%. Found ' || CAST(invalid_records AS VARCHAR)
           || ' invalid records out of ' || CAST(total_records AS VARCHAR) || '.'
         WHEN 'WARNING' THEN {label}'Pass rate ' || CAST(pass_rate AS VARCHAR)
           || '% within warning range of threshold ' || CAST(threshold AS VARCHAR) || '%.'
       END AS failure_reason
FROM (SELECT *, CASE WHEN pass_rate >= threshold THEN 'PASSED'
                     WHEN pass_rate >= threshold - 5 THEN 'WARNING' ELSE 'FAILED' END AS check_status
      FROM (SELECT dataset_id, rule_name, column_name, CAST(t AS BIGINT) AS total_records,
                   CAST(e AS BIGINT) AS invalid_records, {rate} AS pass_rate, threshold
            FROM ({' UNION ALL '.join(parts)}) counted) rated) judged"""


RESULT = ("dataset_id", "rule_name", "column_name", "total_records", "invalid_records",
          "pass_rate", "threshold", "check_status", "failure_reason")


def _lookup(spark, sf_dir):
    def parent(spec):
        if "parent" in spec.params:
            table, key = spec.params["parent"]
            return source(spark, sf_dir, table), key
        table, key = PARENTS[spec.column]
        return derived(spark, sf_dir, table), key

    return parent


def _checked(spark, sf_dir, tables: dict) -> object:
    """Evaluate hand-bound rules per table and shape their results."""
    out = None
    for df, specs in tables.values():
        measured = evaluate(df, specs, AS_OF, _lookup(spark, sf_dir)).withColumns({
            **{c: F.lit(c.upper()) for c in ("database_name", "schema_name", "table_name")},
            "scan_scope": F.lit("FULL"), "scan_reason": F.lit("BASELINE"),
            "labelled": F.lit(False)})
        part = shape.outcomes_of(
            shape.shape_lines(measured, shape.spec_frame(spark, specs), "RUN", AS_OF))
        out = part if out is None else out.unionByName(part)
    return out.select(*RESULT)


def _rule_query(name: str, checks: list[tuple], raw: bool = False) -> None:
    """Register one rule over whole tables: (table, column, threshold, params)."""
    stages = sorted({t for t, *_ in checks if t.startswith("stg_")}
                    | {PARENTS[c][0] for t, c, *_ in checks
                       if name == "CONSISTENCY_FOREIGN_KEY" and t.startswith("stg_")})
    parts = [_counts(t, name, c, limit, **p.get("sql", p)) for t, c, limit, p in checks]
    text = _rated(parts)

    @query(f"rule_{name.lower()}", ctes(stages, text) if stages else text)
    def run(spark, sf_dir):
        tables: dict[str, tuple] = {}
        for table, column, limit, p in checks:
            df = (derived if table.startswith("stg_") else source)(spark, sf_dir, table)
            params = {k: v for k, v in p.get("spark", p).items()}
            spec = rule(name, column, limit, DATASET_OF.get(table, table), **params)
            tables.setdefault(table, (df, []))[1].append(spec)
        return _checked(spark, sf_dir, tables)


_rule_query("COMPLETENESS_CHECK", [
    *[("stg_customer", c, 95, {}) for c in ("customer_id", "customer_name", "email", "phone")],
    ("stg_transaction", "transaction_amount", 100, {}), ("documents", "text", 100, {}),
    ("events", "props", 100, {})])
_rule_query("COMPLETENESS_CRITICAL_COLUMNS", [
    ("stg_customer", None, 90, {"columns": ["customer_id", "email", "kyc_status"]})])
_rule_query("UNIQUENESS_PRIMARY_KEY", [
    ("stg_customer", "customer_id", 100, {}), ("stg_transaction", "transaction_id", 100, {}),
    ("lineitem", "l_orderkey", 20, {}), ("documents", "text", 99, {})])
_rule_query("UNIQUENESS_COMPOSITE_KEY", [
    ("stg_daily_balance", None, 100, {"columns": ["account_id", "balance_date"]}),
    ("lineitem", None, 80, {"columns": ["l_orderkey", "l_linenumber"]})])
_rule_query("VALIDITY_EMAIL_FORMAT", [("stg_customer", "email", 85, {})])
_rule_query("VALIDITY_PHONE_FORMAT", [("stg_customer", "phone", 80, {})])
_rule_query("VALIDITY_DATE_FORMAT", [
    ("stg_customer", "dob", 80, {}), ("stg_account", "opened_date", 95, {}),
    ("stg_transaction", "transaction_date", 95, {}), ("stg_fx_rate", "rate_date", 95, {})])
_rule_query("VALIDITY_NUMERIC_FORMAT", [
    ("stg_account", "opening_balance", 90, {}), ("stg_transaction", "transaction_amount", 95, {}),
    ("stg_daily_balance", "closing_balance", 95, {})])
_rule_query("VALIDITY_POSITIVE_NUMBER", [
    ("stg_transaction", "transaction_amount", 90, {}),
    ("stg_fx_rate", "fx_rate_to_usd", 95, {})])
_rule_query("VALIDITY_NON_NEGATIVE_NUMBER", [
    ("stg_account", "opening_balance", 90, {}),
    ("stg_transaction", "transaction_amount", 90, {"scale": 2})])
_rule_query("VALIDITY_ALLOWED_VALUES", [
    ("stg_customer", "kyc_status", 95, {"spark": {"allowed": ["Verified", "Pending", "Rejected",
                                                              "Incomplete"]}, "sql": {}}),
    ("stg_transaction", "transaction_type", 95,
     {"spark": {"allowed": ["Deposit", "Withdrawal", "Transfer", "Payment"]}, "sql": {}})])
_rule_query("VALIDITY_DATE_RANGE", [
    ("stg_customer", "dob", 85, {}), ("stg_account", "opened_date", 95, {}),
    ("stg_transaction", "transaction_date", 95, {})])
_rule_query("VALIDITY_COUNTRY_CODE", [("stg_customer", "country", 90, {})])
_rule_query("VALIDITY_CURRENCY_CODE", [("stg_fx_rate", "currency_code", 95, {})])
_rule_query("FRESHNESS_DATA_RECENCY", [
    ("stg_customer", "created_date", 90, {}), ("stg_transaction", "transaction_date", 90,
                                               {"max_age_days": 365}),
    ("stg_daily_balance", "balance_date", 50, {"max_age_days": 14})])
_rule_query("FRESHNESS_LOAD_TIMESTAMP", [
    ("stg_customer", None, 100, {"max_age_days": 1}), ("stg_fx_rate", None, 100,
                                                       {"max_age_days": 1})])
_rule_query("CONSISTENCY_FOREIGN_KEY", [
    ("stg_account", "customer_id", 95, {}), ("stg_transaction", "account_id", 90, {}),
    ("stg_daily_balance", "account_id", 90, {}),
    ("documents", "doc_id", 90, {"parent": ("labels", "doc_id")}),
    ("orders", "o_orderkey", 90, {"spark": {"parent": ("lineitem", "l_orderkey"),
                                            "count_joined_rows": True},
                                  "sql": {"parent": ("lineitem", "l_orderkey"), "joined": True}})])
_HOLDS = "TRY_CAST(opened_date AS DATE) <= CAST(load_timestamp AS DATE)"
_rule_query("CONSISTENCY_LOGICAL_RELATIONSHIP", [
    ("stg_account", None, 95, {"holds": _HOLDS}),
    ("lineitem", None, 60, {"holds": "l_extendedprice >= l_quantity * 1000"})])
_rule_query("VOLUME_ROW_COUNT_THRESHOLD", [
    ("stg_customer", None, 100, {}), ("documents", None, 100, {"min_rows": 100000000})])


@query("rule_scale_parameter", ctes(["stg_fx_rate", "stg_transaction"], _rated([
    _counts("stg_fx_rate", "VALIDITY_POSITIVE_NUMBER", "fx_rate_to_usd", 95, scale=6),
    _counts("stg_transaction", "VALIDITY_POSITIVE_NUMBER", "transaction_amount", 90, scale=2)])))
def rule_scale_parameter(spark, sf_dir):
    """Number rules at the column's own scale instead of whole numbers."""
    return _checked(spark, sf_dir, {
        t: (derived(spark, sf_dir, t),
            [rule("VALIDITY_POSITIVE_NUMBER", c, limit, DATASET_OF[t], scale=scale)])
        for t, c, limit, scale in (("stg_fx_rate", "fx_rate_to_usd", 95, 6),
                                   ("stg_transaction", "transaction_amount", 90, 2))})


# Every calendar day from the first with rows to today, also those without rows.
_DAYS = f"""counts AS (SELECT CAST({{0}} AS DATE) AS day, count(*) AS n FROM {{1}} GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM counts), DATE '{AS_OF[:10]}', INTERVAL 1 DAY)) AS DATE) AS day),
days AS (
  SELECT day, n, CAST(sum(n) OVER w AS DOUBLE) / count(*) OVER w AS expected
  FROM (SELECT day, coalesce(n, 0) AS n FROM spine LEFT JOIN counts USING (day)) d
  WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))""".format


@query("daily_volume", f"""WITH {_DAYS("ts", "events")}
SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS row_count,
       round(expected, 6) AS expected_rows,
       coalesce(abs(n - expected) > expected * 0.05, FALSE) AS is_anomaly FROM days""")
def volume_by_day(spark, sf_dir):
    out = daily_volume(source(spark, sf_dir, "events"), "ts", AS_OF, 7, 0.05)
    return out.withColumn("expected_rows", F.round("expected_rows", 6))


_SILENT = "(SELECT * FROM stg_account WHERE CAST(load_timestamp AS DATE) NOT BETWEEN DATE '2020-03-10' AND DATE '2020-03-15')"


@query("daily_volume_silent_days", ctes(["stg_account"], """
SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS row_count, round(expected, 6) AS expected_rows,
       coalesce(abs(n - expected) > expected * 0.5, FALSE) AS is_anomaly FROM days""", _DAYS("load_timestamp", _SILENT)))
def volume_with_silent_days(spark, sf_dir):
    """Six days without any load stand out, as do the days after the last load."""
    staged = derived(spark, sf_dir, "stg_account").where(
        ~F.col("load_timestamp").cast("date").between(F.lit("2020-03-10").cast("date"), F.lit("2020-03-15").cast("date")))
    out = daily_volume(staged, "load_timestamp", AS_OF)
    return out.withColumn("expected_rows", F.round("expected_rows", 6))


@query("rule_volume_anomaly_detection", f"WITH {_DAYS('ts', 'events')} " + _rated([
    """SELECT 'events' AS dataset_id, 'VOLUME_ANOMALY_DETECTION' AS rule_name, 'ts' AS column_name,
       CAST(90 AS DOUBLE) AS threshold, count(*) AS t,
       count(*) FILTER (WHERE abs(n - expected) > expected * 0.05) AS e FROM days"""]))
def rule_volume_anomaly(spark, sf_dir):
    return _checked(spark, sf_dir, {"events": (source(spark, sf_dir, "events"), [
        rule("VOLUME_ANOMALY_DETECTION", "ts", 90, "events", tolerance=0.05)])})


# ---- runs over the shipped configuration ---------------------------------------------------

def _registry(spark, sf_dir) -> Registry:
    registry = Registry(spark)
    for stage, dataset in DATASET_OF.items():
        registry.add(dataset, derived(spark, sf_dir, stage))
    return registry


def _seeded(datasets=None, rule_type=None, where=None, names=None) -> list[str]:
    kinds = {name: kind for name, kind, *_ in seeds.RULES}
    parts = []
    for dataset, columns in seeds.BRONZE_CHECKS.items():
        if datasets and dataset not in datasets:
            continue
        table = next(t for t, d in DATASET_OF.items() if d == dataset)
        for column, limits in columns.items():
            for name, limit in limits.items():
                if (rule_type and kinds[name] != rule_type) or (names and name not in names):
                    continue
                parts.append(_counts(table, name, column, limit, (where or {}).get(table, "TRUE")))
    return parts


@query("check_run_full", ctes(STAGES, _rated(_seeded())))
def check_run_full(spark, sf_dir):
    run = run_checks(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN")
    return run.results.select(*RESULT)


@query("check_run_critical", ctes(STAGES, _rated(_seeded(
    ("DS_BRONZE_CUSTOMER", "DS_BRONZE_ACCOUNT")))))
def check_run_critical(spark, sf_dir):
    run = run_checks(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN",
                     mode="CRITICAL_ONLY")
    return run.results.select(*RESULT)


@query("check_run_completeness", ctes(STAGES, _rated(_seeded(
    ("DS_BRONZE_TRANSACTION",), "COMPLETENESS"))))
def check_run_completeness(spark, sf_dir):
    run = run_checks(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN",
                     "DS_BRONZE_TRANSACTION", "COMPLETENESS")
    return run.results.select(*RESULT)


_INCREMENTAL = {"DS_BRONZE_CUSTOMER": "load_timestamp", "DS_BRONZE_ACCOUNT": "no_such_column",
                "DS_BRONZE_TRANSACTION": "load_timestamp", "DS_BRONZE_FX_RATE": "load_timestamp"}
_TODAY_ROWS = "load_timestamp >= TIMESTAMP '2024-01-30 00:00:00'"
_MISSING = ("Configured INCREMENTAL_COLUMN ''no_such_column'' does not exist in "
            "BANKING_DW.BRONZE.STG_ACCOUNT")


def _incremental_run(spark, sf_dir):
    conf = Configuration.shipped(spark, incremental=_INCREMENTAL)
    return run_checks(_registry(spark, sf_dir), conf, AS_OF, "RUN", incremental=True)


def _incremental_sql() -> str:
    label = ("CASE WHEN dataset_id = 'DS_BRONZE_DAILY_BALANCE' THEN '[FULL] ' "
             "ELSE '[INCREMENTAL] ' END || ")
    where = {"stg_customer": _TODAY_ROWS, "stg_transaction": _TODAY_ROWS,
             "stg_fx_rate": _TODAY_ROWS}
    parts = _seeded(("DS_BRONZE_CUSTOMER", "DS_BRONZE_TRANSACTION", "DS_BRONZE_DAILY_BALANCE",
                     "DS_BRONZE_FX_RATE"), where=where)
    return f"""SELECT * FROM ({_rated(parts, label)}) checks WHERE total_records > 0
UNION ALL SELECT 'DS_BRONZE_ACCOUNT', 'CONFIG_VALIDATION', NULL, 0, 0, 0.0, 0.0, 'ERROR',
       '{_MISSING}'"""


@query("check_run_incremental", ctes(STAGES, _incremental_sql()))
def check_run_incremental(spark, sf_dir):
    return _incremental_run(spark, sf_dir).results.select(*RESULT)


@query("custom_rule", ctes(STAGES, _rated([
    _counts("stg_transaction", "CONSISTENCY_FOREIGN_KEY", "account_id", 99.9)])))
def custom_rule(spark, sf_dir):
    """One mapped rule with its threshold replaced."""
    run = run_rule(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN",
                   "DS_BRONZE_TRANSACTION", "CONSISTENCY_FOREIGN_KEY", "account_id", 99.9)
    return run.results.select(*RESULT)


@query("custom_rule_adhoc", ctes(STAGES, _rated([
    _counts("stg_account", "VALIDITY_POSITIVE_NUMBER", "opening_balance", 97)])))
def custom_rule_adhoc(spark, sf_dir):
    """A rule that has no mapping, run with an explicit threshold."""
    run = run_rule(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN",
                   "DS_BRONZE_ACCOUNT", "VALIDITY_POSITIVE_NUMBER", "opening_balance", 97,
                   mode="ADHOC")
    return run.results.select(*RESULT)


@query("rule_batch", ctes(STAGES, _rated(_seeded(
    ("DS_BRONZE_ACCOUNT",), names=("COMPLETENESS_CHECK", "CONSISTENCY_FOREIGN_KEY")))))
def rule_batch(spark, sf_dir):
    """The checks of a dataset that a JSON selection of rule ids names."""
    run = run_batch(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN",
                    "DS_BRONZE_ACCOUNT", '{"customRules": ["1", "17"]}')
    return run.results.select(*RESULT)


@query("rule_profile_dataset", ctes(STAGES, _rated(_seeded(("DS_BRONZE_DAILY_BALANCE",)))))
def rule_profile_dataset(spark, sf_dir):
    """All configured checks of one dataset."""
    run = profile_dataset(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN",
                          "DS_BRONZE_DAILY_BALANCE")
    return run.results.select(*RESULT)


@query("scan_dispatch_checks", ctes(STAGES, _rated(_seeded(("DS_BRONZE_FX_RATE",)))))
def scan_dispatch_checks(spark, sf_dir):
    """A scan of type "checks" runs the dataset's rules and no profile."""
    done = run_scan(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN",
                    "DS_BRONZE_FX_RATE", "checks")
    assert set(done) == {"checks"}
    return done["checks"].results.select(*RESULT)


@query("executed_run", ctes(STAGES, f"""
SELECT '2024-01-30' AS summary_date, dataset_id, CAST(count(*) AS BIGINT) AS total_checks,
       CAST(count(*) FILTER (WHERE check_status = 'PASSED') AS BIGINT) AS passed_checks,
       CAST(count(*) FILTER (WHERE check_status = 'FAILED') AS BIGINT) AS failed_checks,
       {half_up('sum(round(pass_rate * 100))', 'count(*)')} AS dq_score,
       CAST(sum(total_records) AS BIGINT) AS total_records,
       CAST(sum(invalid_records) AS BIGINT) AS failed_records_count, 'RUN_2' AS last_run_id
FROM (SELECT * FROM ({_rated(_seeded(("DS_BRONZE_CUSTOMER", "DS_BRONZE_ACCOUNT")))}) a
      UNION ALL
      SELECT * FROM ({_rated(_seeded(("DS_BRONZE_CUSTOMER", "DS_BRONZE_ACCOUNT")))}) b) checks
GROUP BY dataset_id"""))
def executed_run(spark, sf_dir):
    """Two runs of one day, the second executed twice, and the day's summary read back."""
    conf, root = Configuration.shipped(spark), fresh_dir(spark, "runs")
    for run_id in ("RUN_1", "RUN_2", "RUN_2"):
        run = run_checks(_registry(spark, sf_dir), conf, AS_OF, run_id, mode="CRITICAL_ONLY")
        execute(run, root, conf.datasets)
    return spark.read.parquet(f"{root}/daily_summary").select(
        "summary_date", "dataset_id", "total_checks", "passed_checks", "failed_checks",
        "dq_score", "total_records", "failed_records_count", "last_run_id")


_SILVER_ALLOWED = {
    "kyc_status": "('VERIFIED','PENDING','REJECTED','EXPIRED','NOT_STARTED')",
    "account_type": "('SAVINGS','CHECKING','CREDIT','INVESTMENT','LOAN')",
    "transaction_type": "('DEPOSIT','WITHDRAWAL','TRANSFER','PAYMENT','FEE','INTEREST')"}
_ABSENT = {"first_name", "last_name", "date_of_birth", "status", "balance", "currency", "amount",
           "balance_id", "rate_id", "to_currency", "exchange_rate"}


def _silver_checks() -> str:
    runnable, errors = [], []
    for dataset, columns in seeds.SILVER_CHECKS.items():
        table = dataset.replace("DS_", "").lower()
        for column, limits in columns.items():
            for name, limit in limits.items():
                if column in _ABSENT:
                    errors.append(f"SELECT '{dataset}', '{name}', '{column}', 0, 0, 0.0, "
                                  f"CAST({limit} AS DOUBLE), 'ERROR', 'Column not found: {column}'")
                else:
                    runnable.append(_counts(table, name, column, limit, dataset=dataset,
                                            allowed=_SILVER_ALLOWED.get(column)))
    return " UNION ALL ".join([_rated(runnable), *errors])


@query("silver_check_run", ctes(STAGES, _silver_checks(), *[silver_sql(e) for e in ENTITIES]))
def silver_check_run(spark, sf_dir):
    """Typed-layer checks: those naming an absent column report ERROR, the rest run."""
    registry = _registry(spark, sf_dir)
    for entity in ENTITIES:
        registry.add(f"DS_SILVER_{entity.upper()}", silver(spark, sf_dir, entity))
    conf = Configuration.shipped(spark, layers=("SILVER",))
    return run_checks(registry, conf, AS_OF, "RUN").results.select(*RESULT)


@query("run_summary", ctes(STAGES, f"""
SELECT run_id, run_type, run_status, total_datasets, datasets_skipped, total_checks, passed_checks,
       failed_checks, warning_checks, skipped_checks, records_processed, invalid_records,
       total_rows_in_scope, {percent('passed_checks', 'total_checks')} AS pass_rate
FROM (
SELECT 'RUN' AS run_id, 'FULL' AS run_type,
       CASE WHEN count(*) FILTER (WHERE check_status = 'FAILED') > 0
            THEN 'COMPLETED_WITH_FAILURES' ELSE 'COMPLETED' END AS run_status,
       CAST(5 AS BIGINT) AS total_datasets, CAST(0 AS BIGINT) AS datasets_skipped,
       CAST(count(*) AS BIGINT) AS total_checks,
       CAST(count(*) FILTER (WHERE check_status = 'PASSED') AS BIGINT) AS passed_checks,
       CAST(count(*) FILTER (WHERE check_status = 'FAILED') AS BIGINT) AS failed_checks,
       CAST(count(*) FILTER (WHERE check_status = 'WARNING') AS BIGINT) AS warning_checks,
       CAST(0 AS BIGINT) AS skipped_checks,
       CAST(sum(total_records) AS BIGINT) AS records_processed,
       CAST(sum(invalid_records) AS BIGINT) AS invalid_records,
       CAST((SELECT count(*) FROM stg_customer) + (SELECT count(*) FROM stg_account)
          + (SELECT count(*) FROM stg_transaction) + (SELECT count(*) FROM stg_daily_balance)
          + (SELECT count(*) FROM stg_fx_rate) AS BIGINT) AS total_rows_in_scope
FROM ({_rated(_seeded())}) checks) counted"""))
def run_summary(spark, sf_dir):
    run = run_checks(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN")
    return run.control().select(
        "run_id", "run_type", "run_status", "total_datasets", "datasets_skipped", "total_checks",
        "passed_checks", "failed_checks", "warning_checks", "skipped_checks", "records_processed",
        "invalid_records", "total_rows_in_scope", "pass_rate")


@query("incremental_run_summary", ctes(STAGES, f"""
SELECT 'INCREMENTAL' AS run_type, CAST(3 AS BIGINT) AS total_datasets,
       CAST(2 AS BIGINT) AS datasets_skipped,
       CAST(count(*) FILTER (WHERE check_status <> 'ERROR') AS BIGINT) AS total_checks,
       CAST(count(*) FILTER (WHERE check_status = 'PASSED') AS BIGINT) AS passed_checks,
       CAST((SELECT count(*) FROM stg_customer WHERE {_TODAY_ROWS})
          + (SELECT count(*) FROM stg_transaction WHERE {_TODAY_ROWS})
          + (SELECT count(*) FROM stg_daily_balance) AS BIGINT) AS total_rows_in_scope
FROM ({_incremental_sql()}) checks"""))
def incremental_run_summary(spark, sf_dir):
    return _incremental_run(spark, sf_dir).control().select(
        "run_type", "total_datasets", "datasets_skipped", "total_checks", "passed_checks",
        "total_rows_in_scope")


_FAILURE_TYPE = """CASE rule_type WHEN 'COMPLETENESS' THEN 'NULL_VALUE'
  WHEN 'UNIQUENESS' THEN 'DUPLICATE_VALUE' WHEN 'VALIDITY' THEN 'INVALID_FORMAT'
  WHEN 'CONSISTENCY' THEN 'FK_VIOLATION' WHEN 'FRESHNESS' THEN 'STALE_DATA'
  WHEN 'VOLUME' THEN 'LOW_VOLUME' ELSE 'VALIDATION_FAILURE' END"""
_REMEDY = """CASE rule_type
  WHEN 'COMPLETENESS' THEN 'Implement default values or make field optional'
  WHEN 'UNIQUENESS' THEN 'Remove duplicates or update primary key logic'
  WHEN 'VALIDITY' THEN 'Add validation at source or implement data cleansing'
  WHEN 'CONSISTENCY' THEN 'Verify foreign key relationships and add missing parent records'
  WHEN 'FRESHNESS' THEN 'Check ETL schedule and data source availability'
  WHEN 'VOLUME' THEN 'Investigate data pipeline and source system'
  ELSE 'Review and correct data quality issues' END"""


@query("failure_classification", ctes(["history"], f"""
SELECT check_id, run_id, dataset_id, table_name, column_name, rule_name, rule_type,
       {_FAILURE_TYPE} AS failure_type, rule_type AS failure_category,
       threshold >= 98 AS is_critical, FALSE AS can_auto_remediate,
       {_REMEDY} AS remediation_suggestion, CAST(invalid_records AS BIGINT) AS invalid_records,
       CAST(check_timestamp AS VARCHAR) AS detected_ts
FROM history WHERE check_status IN ('FAILED', 'WARNING') AND invalid_records > 0"""))
def failure_classification(spark, sf_dir):
    return shape.failures(derived(spark, sf_dir, "history"))


_AUDIT = "load_timestamp source_file load_batch_id"
_LANDED = {
    "stg_customer": (["customer_id"], f"customer_id customer_name email dob phone kyc_status country created_date {_AUDIT}".split()),
    "stg_account": (["account_id"], f"account_id customer_id account_type account_status opening_balance opened_date {_AUDIT}".split()),
    "stg_transaction": (["transaction_id"], f"transaction_id account_id transaction_type transaction_amount transaction_date {_AUDIT}".split()),
    "stg_daily_balance": (["account_id", "balance_date"], f"account_id balance_date closing_balance {_AUDIT}".split()),
    "stg_fx_rate": (["currency_code", "rate_date"], f"currency_code rate_date fx_rate_to_usd {_AUDIT}".split()),
}
_SAMPLE_KEYS = {DATASET_OF[t]: keys for t, (keys, _) in _LANDED.items()}


def _sample_sql() -> str:
    """Samples of every failed or warned check of all landing tables."""
    parts = []
    for table, (keys, columns) in _LANDED.items():
        dataset, key = DATASET_OF[table], f"concat_ws('|', {', '.join(keys)})"
        order = ", ".join(["pk ASC NULLS FIRST", *[f"{c} ASC NULLS FIRST" for c in columns]])
        for column, limits in seeds.BRONZE_CHECKS[dataset].items():
            for name, limit in limits.items():
                head = f"SELECT '{dataset}' AS dataset_id, '{name}' AS rule_name, '{column}' AS column_name"
                if name == "VOLUME_ROW_COUNT_THRESHOLD":
                    continue
                if name == "UNIQUENESS_PRIMARY_KEY":
                    parts.append(f"""SELECT * FROM ({head}, coalesce({column}, '') AS failed_record_pk,
                      coalesce({column}, '') AS failed_column_value FROM {table} GROUP BY {column}
                      HAVING count(*) > 1 OR {column} IS NULL
                      ORDER BY {column} ASC NULLS FIRST LIMIT 100)""")
                    continue
                if name == "CONSISTENCY_FOREIGN_KEY":
                    parent, pkey = PARENTS[column]
                    bad = (f"{column} IN (SELECT DISTINCT {column} FROM {table} WHERE {column} "
                           f"IS NOT NULL AND {column} NOT IN (SELECT {pkey} FROM {parent} WHERE "
                           f"{pkey} IS NOT NULL) ORDER BY {column} LIMIT 100)")
                else:
                    bad = _error(name, column, limit)
                parts.append(f"""SELECT * FROM ({head}, pk AS failed_record_pk,
                  {column} AS failed_column_value
                  FROM (SELECT *, {key} AS pk FROM {table} c WHERE {bad}) bad
                  ORDER BY {order} LIMIT 100)""")
    judged = _rated(_seeded())
    return f"""SELECT s.dataset_id, s.rule_name, s.column_name, failed_record_pk,
       failed_column_value
FROM ({' UNION ALL '.join(parts)}) s JOIN ({judged}) j ON s.dataset_id = j.dataset_id
  AND s.rule_name = j.rule_name AND s.column_name = j.column_name
WHERE check_status IN ('FAILED', 'WARNING') AND invalid_records > 0"""


def _sampled(spark, sf_dir):
    """The sampled records of a run over all datasets; only checks that failed are looked at again."""
    run = run_checks(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN")
    run.lines = cut_lineage(run.lines)
    return run.failed_records(_SAMPLE_KEYS, counts=run.invalid_counts())


@query("failed_samples", ctes(STAGES, _sample_sql()))
def failed_samples(spark, sf_dir):
    """Up to 100 failing records per failed check, with key and value."""
    return _sampled(spark, sf_dir).select("dataset_id", "rule_name", "column_name", "failed_record_pk", "failed_column_value")


def _failing_sql() -> str:
    """Number of sampled records per failed check: all failures up to 100."""
    return f"""
SELECT dataset_id, rule_name, column_name, CAST(count(*) AS BIGINT) AS sampled, CAST(count(*) AS BIGINT) AS failing
FROM ({_sample_sql()}) samples GROUP BY ALL"""


@query("failed_samples_random", ctes(STAGES, _failing_sql()))
def failed_samples_random(spark, sf_dir):
    """Samples of the failed checks only: their size, and how many sampled records break their rule."""
    value, name = F.col("failed_column_value"), F.col("rule_name")
    number = value.try_cast("decimal(38,0)")
    known = [v.strip("'") for kinds in (KYC, KINDS, STATES, MOVES) for v in kinds.strip("()").split(",")]
    breaks = (
        F.when(name == "COMPLETENESS_CHECK", value.isNull())
        .when(name == "VALIDITY_POSITIVE_NUMBER", F.coalesce(number <= 0, F.lit(True)))
        .when(name == "VALIDITY_NON_NEGATIVE_NUMBER", F.coalesce(number < 0, F.lit(True)))
        .when(name == "VALIDITY_NUMERIC_FORMAT", number.isNull())
        .when(name == "VALIDITY_DATE_FORMAT", value.try_cast("date").isNull())
        .when(name == "VALIDITY_DATE_RANGE", F.coalesce(
            ~value.try_cast("date").between(F.lit("1900-01-01").cast("date"), F.lit("2024-01-30").cast("date")), F.lit(True)))
        .when(name == "FRESHNESS_DATA_RECENCY", value.try_cast("date") < F.lit("2023-11-06").cast("date"))
        .when(name == "VALIDITY_EMAIL_FORMAT", ~value.rlike(EMAIL))
        .when(name == "VALIDITY_PHONE_FORMAT", ~value.rlike(PHONE))
        .when(name == "VALIDITY_COUNTRY_CODE", ~F.lit(COUNTRIES).contains(F.concat(F.lit("'"), value, F.lit("'"))))
        .when(name == "VALIDITY_CURRENCY_CODE", ~F.lit(CURRENCIES).contains(F.concat(F.lit("'"), value, F.lit("'"))))
        .when(name == "VALIDITY_ALLOWED_VALUES", ~value.isin(*known))
        .when(name == "UNIQUENESS_PRIMARY_KEY", F.get_json_object("row_context", "$.copies").cast("int") >= 1)
        .when(name == "CONSISTENCY_FOREIGN_KEY", value.isNotNull()))
    return _sampled(spark, sf_dir).groupBy("dataset_id", "rule_name", "column_name").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(breaks).alias("failing"))


@query("latest_results", ctes(["history"], """
SELECT check_id, dataset_id, CAST(check_timestamp AS VARCHAR) AS check_timestamp, check_status
FROM history ORDER BY history.check_timestamp DESC, check_id LIMIT 10"""))
def latest_results(spark, sf_dir):
    return shape.latest_results(derived(spark, sf_dir, "history")).select(
        "check_id", "dataset_id", "check_timestamp", "check_status")


@query("results_by_scope", ctes(["history"], """
SELECT dataset_id, table_name, scan_scope, CAST(count(*) AS BIGINT) AS check_count,
       CAST(count(DISTINCT rule_name) AS BIGINT) AS rules_applied,
       CAST(sum(total_records) AS BIGINT) AS total_validations,
       CAST(max(total_records) AS BIGINT) AS rows_per_check
FROM history GROUP BY dataset_id, table_name, scan_scope"""))
def results_by_scope(spark, sf_dir):
    return shape.results_by_scope(derived(spark, sf_dir, "history"))


_RUNS = """runs AS (
  SELECT run_id, CASE WHEN max(scan_scope) = 'INCREMENTAL' THEN 'INCREMENTAL' ELSE 'FULL' END
           AS run_type, min(check_timestamp) AS start_ts,
         CAST(count(*) FILTER (WHERE check_status = 'FAILED') AS BIGINT) AS failed_checks
  FROM history GROUP BY run_id)"""


@query("runs_of_type", ctes(["history"], """
SELECT run_id, run_type, CAST(start_ts AS VARCHAR) AS start_ts, failed_checks,
       CASE WHEN failed_checks > 0 THEN 'COMPLETED_WITH_FAILURES' ELSE 'COMPLETED' END AS run_status
FROM runs WHERE run_type = 'INCREMENTAL' AND start_ts >= TIMESTAMP '1999-01-01 00:00:00'""",
                            _RUNS))
def runs_of_type(spark, sf_dir):
    history = derived(spark, sf_dir, "history")
    runs = history.groupBy("run_id").agg(
        F.max("scan_scope").alias("run_type"), F.min("check_timestamp").alias("start_ts"),
        F.count_if(F.col("check_status") == "FAILED").alias("failed_checks"))
    since = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    return shape.runs_of_type(runs, "INCREMENTAL", since).withColumn(
        "run_status", shape.run_status(F.col("failed_checks")))


@query("execution_estimate", ctes(["history"], """
SELECT check_id, CAST(execution_time_ms AS BIGINT) AS execution_time_ms,
       round(execution_time_ms / 1000.0 * 0.00001, 6) AS credits FROM history"""))
def execution_estimate(spark, sf_dir):
    from assayer.functions.scoring import credits
    return derived(spark, sf_dir, "history").select(
        "check_id", "execution_time_ms", credits(F.col("execution_time_ms")).alias("credits"))
