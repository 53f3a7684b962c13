"""Work that writes tables, read back: failing records, profiles, planned runs, backfills, reports, damaged landings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer import schemas
from assayer.operators import observe
from assayer.plans import seeds
from assayer.plans.runs import Configuration, execute, execute_profile, run_batch, run_checks, run_planned
from assayer.sources import bronze
from assayer.sources.tables import Registry, literal_rows
from workload.base import ctes, fresh_dir, percent, query
from workload.q_checks import _DAYS, _FAILURE_TYPE, DATASET_OF, PARENTS, RESULT, STAGES, _counts, _error, _rated, _registry, _seeded
from workload.q_observe import _UNIFIED_PARTS, MONTH_AGO, _unified
from workload.q_profile import _CHECKS, _profile, _rounded
from workload.q_summary import HISTORY, _daily, daily_sql
from workload.staging import AS_OF, HISTORY_AS_OF, derived, source

TYPES = ("COMPLETENESS", "UNIQUENESS", "VALIDITY", "CONSISTENCY", "FRESHNESS", "VOLUME")
TABLE_OF = {d: t for t, d in DATASET_OF.items()}
BUSINESS_KEYS = {"DS_BRONZE_CUSTOMER": ["customer_id"], "DS_BRONZE_ACCOUNT": ["account_id"],
                 "DS_BRONZE_TRANSACTION": ["transaction_id"], "DS_BRONZE_DAILY_BALANCE": ["account_id", "balance_date"],
                 "DS_BRONZE_FX_RATE": ["currency_code", "rate_date"]}
COLUMNS = {
    "stg_customer": "customer_id customer_name email dob phone kyc_status country created_date".split(),
    "stg_account": "account_id customer_id account_type account_status opening_balance opened_date".split(),
    "stg_transaction": "transaction_id account_id transaction_type transaction_amount transaction_date".split(),
    "stg_daily_balance": "account_id balance_date closing_balance".split(),
    "stg_fx_rate": "currency_code rate_date fx_rate_to_usd".split(),
}
AUDIT = ["load_timestamp", "source_file", "load_batch_id"]

# ---- check results in full ------------------------------------------------------------------


def _details() -> str:
    """What the shipped configuration says of every check, by dataset, rule and column."""
    known = {name: (i, kind, level) for i, (name, kind, level, _) in enumerate(seeds.RULES, 1)}
    lines = []
    for dataset, database, schema, table, domain, _ in seeds.BRONZE_DATASETS:
        for column, limits in seeds.BRONZE_CHECKS[dataset].items():
            for name in limits:
                rule_id, kind, level = known[name]
                weight = seeds.WEIGHTS[domain][TYPES.index(kind)][0]
                lines.append(f"('{dataset}', '{name}', {repr(column) if column else 'NULL'}, CAST({rule_id} AS BIGINT), '{kind}', "
                             f"'{level}', CAST({weight} AS DOUBLE), '{database}', '{schema}', '{table}')")
    return ("details(dataset, rule, col, rule_id, rule_type, rule_level, weight, database_name, schema_name, table_name) AS (VALUES "
            + ", ".join(lines) + ")")


@query("check_run_columns", ctes(STAGES, f"""
SELECT sha256('RUN|' || r.dataset_id || '|' || r.rule_name || '|' || coalesce(r.column_name, '*')) AS check_id,
       'RUN' AS run_id, '{AS_OF}' AS check_timestamp, r.*, total_records - invalid_records AS valid_records,
       CASE WHEN rule_type = 'COMPLETENESS' AND col IS NOT NULL THEN invalid_records ELSE 0 END AS null_records,
       CASE WHEN rule_type = 'UNIQUENESS' AND col IS NOT NULL THEN invalid_records ELSE 0 END AS duplicate_records,
       rule_id, rule_type, rule_level, weight, database_name, schema_name, table_name, 'FULL' AS scan_scope,
       'BASELINE' AS scan_reason
FROM ({_rated(_seeded())}) r JOIN details ON dataset = r.dataset_id AND rule = r.rule_name
     AND col IS NOT DISTINCT FROM r.column_name""", _details()))
def check_run_columns(spark, sf_dir):
    """Every column of a full run's results, with the ids and measures that derive from others."""
    run = run_checks(_registry(spark, sf_dir), Configuration.shipped(spark), AS_OF, "RUN")
    return run.results.drop("execution_time_ms", "execution_credits")


# ---- runs with every kind of rule -----------------------------------------------------------

_HOLDS = "TRY_CAST(opened_date AS DATE) <= CAST(load_timestamp AS DATE)"
#: Checks beside the shipped ones, so that every kind of rule runs: (dataset, rule, threshold, settings).
EXTRA = (
    ("DS_BRONZE_CUSTOMER", "FRESHNESS_LOAD_TIMESTAMP", 100, {"max_age_days": 0}),
    ("DS_BRONZE_CUSTOMER", "COMPLETENESS_CRITICAL_COLUMNS", 99, {"columns": ["customer_id", "email", "kyc_status"]}),
    ("DS_BRONZE_ACCOUNT", "CONSISTENCY_LOGICAL_RELATIONSHIP", 100, {"holds": _HOLDS}),
    ("DS_BRONZE_DAILY_BALANCE", "UNIQUENESS_COMPOSITE_KEY", 100, {"columns": ["account_id", "balance_date"]}),
    ("DS_BRONZE_ACCOUNT", "VOLUME_ANOMALY_DETECTION", 100, {}),
)
MIN_ROWS = {"DS_BRONZE_FX_RATE": 10 ** 9}


def _extended(spark: SparkSession, more: tuple = ()) -> Configuration:
    """The shipped configuration with further table-level checks."""
    conf, extra = Configuration.shipped(spark), EXTRA + more
    ids = {name: i for i, (name, *_) in enumerate(seeds.RULES, 1)}
    rows = [(1000 + i, dataset, ids[name], None, None, True) for i, (dataset, name, _, _) in enumerate(extra)]
    limits = F.create_map(*[F.lit(x) for i, (_, _, limit, _) in enumerate(extra) for x in (1000 + i, limit)])
    mapped = literal_rows(spark, rows, schemas.MAPPINGS).withColumn("threshold_value", limits[F.col("config_id")].cast("decimal(10,2)"))
    conf.mappings = conf.mappings.unionByName(mapped)
    conf.rules = conf.rules.withColumn("has_check", F.lit(True))

    def params(row: dict) -> dict:
        if row["config_id"] >= 1000:
            return extra[row["config_id"] - 1000][3]
        if row["rule_name"] == "VOLUME_ROW_COUNT_THRESHOLD" and row["dataset_id"] in MIN_ROWS:
            return {"min_rows": MIN_ROWS[row["dataset_id"]]}
        return {}

    conf.params = params
    return conf


def _checks(skip: tuple = ()) -> Iterator[tuple]:
    """Dataset, table, rule, column, threshold and settings of all checks."""
    for dataset, columns in seeds.BRONZE_CHECKS.items():
        for column, limits in columns.items():
            for name, limit in limits.items():
                if dataset not in skip:
                    settings = {"min_rows": MIN_ROWS[dataset]} if column is None and dataset in MIN_ROWS else {}
                    yield dataset, TABLE_OF[dataset], name, column, limit, settings
    for dataset, name, limit, settings in EXTRA:
        yield dataset, TABLE_OF[dataset], name, None, limit, settings


def _counted(skip: tuple = ()) -> list[str]:
    parts = []
    for dataset, table, name, column, limit, settings in _checks(skip):
        if name == "VOLUME_ANOMALY_DETECTION":
            parts.append(f"""SELECT '{dataset}' AS dataset_id, '{name}' AS rule_name, NULL AS column_name,
              CAST({limit} AS DOUBLE) AS threshold, count(*) AS t,
              count(*) FILTER (WHERE abs(n - expected) > expected * 0.5) AS e FROM days""")
        else:
            parts.append(_counts(table, name, column, limit, **settings))
    return parts


_ACCOUNT_DAYS = _DAYS("load_timestamp", "stg_account")
_ZERO = "length(phone) / (length(phone) - 5) > 0"
_UNREADABLE = "Source cannot be read: "


@query("check_run_errors", ctes(STAGES, f"""
SELECT * FROM ({_rated(_counted(("DS_BRONZE_FX_RATE",)))}) checked
UNION ALL SELECT 'DS_BRONZE_CUSTOMER', 'CONSISTENCY_LOGICAL_RELATIONSHIP', NULL, 0, 0, 0.0, 100.0, 'ERROR',
       'Check cannot be computed: DIVIDE_BY_ZERO'
UNION ALL SELECT dataset_id, rule_name, column_name, 0, 0, 0.0, threshold, 'ERROR', 'Source cannot be read'
FROM ({' UNION ALL '.join(_seeded(("DS_BRONZE_FX_RATE",)))}) unread""", _ACCOUNT_DAYS))
def check_run_errors(spark, sf_dir):
    """A planned run with a condition that divides by zero and a dataset whose files are damaged, written and read back."""
    conf = _extended(spark, (("DS_BRONZE_CUSTOMER", "CONSISTENCY_LOGICAL_RELATIONSHIP", 100, {"holds": _ZERO}),))
    damaged, root = fresh_dir(spark, "damaged"), fresh_dir(spark, "runs")
    rates = derived(spark, sf_dir, "stg_fx_rate")
    rates.select(F.to_json(F.struct("*")).alias("value")).write.text(damaged)
    registry = _registry(spark, sf_dir).add("DS_BRONZE_FX_RATE", spark.read.schema(rates.schema).parquet(damaged))
    execute(run_planned(registry, conf, AS_OF, "RUN"), root, conf.datasets)
    results = spark.read.parquet(f"{root}/check_results").select(*RESULT)
    # Why the files cannot be read is Spark's text.
    unread = F.col("failure_reason").startswith(_UNREADABLE)
    return results.withColumn("failure_reason", F.when(unread, F.lit(_UNREADABLE[:-2])).otherwise(F.col("failure_reason")))


@query("planned_run_control", ctes(STAGES, f"""
SELECT 'COMPLETED_WITH_FAILURES' AS run_status, CAST(5 AS BIGINT) AS total_datasets, CAST(0 AS BIGINT) AS datasets_skipped,
       CAST(count(*) AS BIGINT) AS total_checks,
       CAST(count(*) FILTER (WHERE check_status = 'PASSED') AS BIGINT) AS passed_checks,
       CAST(count(*) FILTER (WHERE check_status = 'FAILED') AS BIGINT) AS failed_checks,
       CAST(sum(total_records) AS BIGINT) AS records_processed, CAST(sum(invalid_records) AS BIGINT) AS invalid_records,
       TRUE AS timed
FROM ({_rated(_counted())}) checked""", _ACCOUNT_DAYS))
def planned_run_control(spark, sf_dir):
    """The record of a run of one job per dataset; each dataset's checks share its own time."""
    conf, root = _extended(spark), fresh_dir(spark, "runs")
    run = run_planned(_registry(spark, sf_dir), conf, AS_OF, "RUN")
    execute(run, root, conf.datasets)
    control = spark.read.parquet(f"{root}/run_control")
    shares = spark.read.parquet(f"{root}/check_results").groupBy("dataset_id").agg(
        F.countDistinct("execution_time_ms").alias("shares"), F.min("execution_time_ms").alias("least"))
    timed = shares.agg((F.expr("count_if(shares = 1 AND least >= 0)") == len(run.seconds)).alias("timed"))
    return control.select(
        "run_status", "total_datasets", "datasets_skipped", "total_checks", "passed_checks", "failed_checks",
        "records_processed", "invalid_records").crossJoin(timed)


# ---- failing records -------------------------------------------------------------------------

_EXPECTED = {
    "COMPLETENESS_CHECK": "NOT NULL", "COMPLETENESS_CRITICAL_COLUMNS": "NOT NULL", "UNIQUENESS_PRIMARY_KEY": "UNIQUE",
    "UNIQUENESS_COMPOSITE_KEY": "UNIQUE", "VALIDITY_DATE_FORMAT": "a date", "VALIDITY_NUMERIC_FORMAT": "a number",
    "VALIDITY_POSITIVE_NUMBER": "a number > 0", "VALIDITY_NON_NEGATIVE_NUMBER": "a number >= 0",
    "VALIDITY_DATE_RANGE": "a date from 1900-01-01 to today", "CONSISTENCY_FOREIGN_KEY": "an existing parent key",
    "CONSISTENCY_LOGICAL_RELATIONSHIP": _HOLDS,
}


def _json(columns: list[str], extra: str = "") -> str:
    """The columns of a row as JSON, NULLs left out."""
    parts = [f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":"' || """
             + (f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%g')" if c == "load_timestamp" else f"CAST({c} AS VARCHAR)") + """ || '"' END"""
             for c in columns]
    return "'{' || concat_ws(',', " + ", ".join(parts) + (f", {extra}" if extra else "") + ") || '}'"


def _records_of(dataset: str, table: str, name: str, column: str | None, limit: float, settings: dict) -> str:
    columns = [*COLUMNS[table], *AUDIT]
    keys = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in BUSINESS_KEYS[dataset]) + ")"
    head = f"SELECT '{dataset}' AS dataset_id, '{name}' AS rule_name, {repr(column) if column else 'NULL'} AS column_name"
    named = ([column] if column else []) + settings.get("columns", [])
    text = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in named) + ")" if named else "''"
    if name.startswith("UNIQUENESS"):
        missing = " OR ".join(f"{c} IS NULL" for c in named)
        order = ", ".join(f"{c} ASC NULLS FIRST" for c in named)
        copies = """'"copies":' || CAST(count(*) AS VARCHAR)"""
        return f"""SELECT * FROM ({head}, {text} AS failed_record_pk, {text} AS failed_column_value, {_json(named, copies)} AS row_context
          FROM {table} GROUP BY {', '.join(named)} HAVING count(*) > 1 OR {missing} ORDER BY {order} LIMIT 100)"""
    if name == "VOLUME_ANOMALY_DETECTION":
        return f"""SELECT * FROM ({head}, CAST(day AS VARCHAR), CAST(n AS VARCHAR), NULL FROM days
          WHERE abs(n - expected) > expected * 0.5 ORDER BY day LIMIT 100)"""
    if name == "VOLUME_ROW_COUNT_THRESHOLD":
        return f"{head}, NULL, CAST(count(*) AS VARCHAR), NULL FROM {table}"
    if name == "FRESHNESS_LOAD_TIMESTAMP":
        return f"{head}, NULL, CAST(max(load_timestamp) AS VARCHAR), NULL FROM {table}"
    if name == "CONSISTENCY_FOREIGN_KEY":
        parent, key = PARENTS[column]
        bad = (f"{column} IN (SELECT DISTINCT {column} FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN "
               f"(SELECT {key} FROM {parent} WHERE {key} IS NOT NULL) ORDER BY {column} LIMIT 100)")
    else:
        bad = _error(name, column, limit, **settings)
    value = column if column else text
    order = ", ".join(["pk ASC NULLS FIRST", *[f"{c} ASC NULLS FIRST" for c in columns]])
    return f"""SELECT * FROM ({head}, pk AS failed_record_pk, {value} AS failed_column_value, {_json(columns)} AS row_context FROM (SELECT *, {keys} AS pk FROM {table} WHERE {bad}) bad
      ORDER BY {order} LIMIT 100)"""


def _records_sql() -> str:
    names = [name for name in _EXPECTED]
    pattern = "CASE s.rule_name " + " ".join(f"WHEN '{n}' THEN '{_EXPECTED[n]}'" for n in names) + " END"
    parts = [_records_of(*check) for check in _checks()]
    return f"""
SELECT s.dataset_id, s.rule_name, s.column_name, failed_record_pk, failed_column_value, row_context,
       CASE WHEN s.rule_name IN ({', '.join(repr(n) for n in names)}) THEN {pattern} END AS expected_pattern,
       {_FAILURE_TYPE.replace('rule_type', 'kind')} AS failure_type,
       CASE WHEN s.column_name IS NOT NULL THEN 'string' END AS actual_value_type
FROM (SELECT *, CASE WHEN rule_name LIKE 'COMPLETENESS%' THEN 'COMPLETENESS' WHEN rule_name LIKE 'UNIQUENESS%' THEN 'UNIQUENESS'
        WHEN rule_name LIKE 'VALIDITY%' THEN 'VALIDITY' WHEN rule_name LIKE 'CONSISTENCY%' THEN 'CONSISTENCY'
        WHEN rule_name LIKE 'FRESHNESS%' THEN 'FRESHNESS' ELSE 'VOLUME' END AS kind
      FROM ({' UNION ALL '.join(parts)}) all_records) s
JOIN ({_rated(_counted())}) j ON s.dataset_id = j.dataset_id AND s.rule_name = j.rule_name
  AND s.column_name IS NOT DISTINCT FROM j.column_name
WHERE check_status IN ('FAILED', 'WARNING') AND invalid_records > 0"""


@query("failed_records_written", ctes(STAGES, _records_sql(), _ACCOUNT_DAYS))
def failed_records_written(spark, sf_dir):
    """The written failing records of a run over all datasets and kinds of rules, executed twice."""
    conf, root = _extended(spark), fresh_dir(spark, "runs")
    for _ in range(2):
        execute(run_planned(_registry(spark, sf_dir), conf, AS_OF, "RUN"), root, conf.datasets, keys=BUSINESS_KEYS)
    records = spark.read.parquet(f"{root}/failed_records")
    table_level = F.col("rule_name").isin("VOLUME_ANOMALY_DETECTION", "VOLUME_ROW_COUNT_THRESHOLD", "FRESHNESS_LOAD_TIMESTAMP")
    stated = F.col("rule_name").isin(*_EXPECTED)
    return records.select(
        "dataset_id", "rule_name", "column_name", "failed_record_pk", "failed_column_value",
        F.when(~table_level, F.col("row_context")).alias("row_context"),
        F.when(stated, F.col("expected_pattern")).alias("expected_pattern"), "failure_type", "actual_value_type")


# ---- profiles --------------------------------------------------------------------------------


def _profiled(spark: SparkSession, sf_dir: str) -> str:
    """Two profile runs of the customers under one run id; the folder of what they wrote."""
    root, conf = fresh_dir(spark, "profiles"), Configuration.shipped(spark)
    registry = Registry(spark).add("DS_BRONZE_CUSTOMER", derived(spark, sf_dir, "stg_customer"))
    for _ in range(2):
        execute_profile(registry, conf, AS_OF, "RUN_P", "DS_BRONZE_CUSTOMER", root)
    return root


@query("profile_columns_written", ctes(["stg_customer"], """
SELECT 'RUN_P' AS run_id, 'DS_BRONZE_CUSTOMER' AS dataset_id, 'STG_CUSTOMER' AS table_name, * FROM profile""",
                                       _profile("stg_customer", AS_OF)))
def profile_columns_written(spark, sf_dir):
    written = spark.read.parquet(f"{_profiled(spark, sf_dir)}/column_profile")
    return _rounded(written).drop("database_name", "schema_name", "profile_ts", "profile_date")


@query("profile_run_written", ctes(["stg_customer"], f"""
SELECT c.*, total_records - invalid_records AS valid_records,
       CASE WHEN rule_type = 'COMPLETENESS' THEN invalid_records ELSE 0 END AS null_records,
       sha256('RUN_P|DS_BRONZE_CUSTOMER|' || rule_name || '|' || column_name) AS check_id,
       CASE WHEN failed_checks > 0 THEN 'COMPLETED_WITH_FAILURES' ELSE 'COMPLETED' END AS run_status, r.*
FROM ({_CHECKS}) c, (
  SELECT CAST(count(*) AS BIGINT) AS total_checks, CAST(count(*) FILTER (WHERE check_status = 'FAILED') AS BIGINT) AS failed_checks,
         CAST(count(*) FILTER (WHERE check_status = 'WARNING') AS BIGINT) AS warning_checks,
         {percent("count(*) FILTER (WHERE check_status = 'PASSED')", 'count(*)')} AS run_pass_rate,
         CAST(sum(total_records) AS BIGINT) AS records_processed FROM ({_CHECKS}) k) r""", _profile("stg_customer", AS_OF)))
def profile_run_written(spark, sf_dir):
    """The checks of a written profile run beside the run's record and the day's summary."""
    root = _profiled(spark, sf_dir)
    results = spark.read.parquet(f"{root}/check_results").select(
        "check_id", "column_name", "rule_name", "rule_type", "check_status", "pass_rate", "threshold", "total_records",
        "invalid_records", "valid_records", "null_records", "failure_reason", F.lit("DS_BRONZE_CUSTOMER").alias("dataset_id"))
    control = spark.read.parquet(f"{root}/run_control").select(
        "run_status", "failed_checks", "warning_checks", F.col("pass_rate").alias("run_pass_rate"), "records_processed")
    summary = spark.read.parquet(f"{root}/daily_summary").select("dataset_id", "total_checks")
    return results.join(summary, "dataset_id").drop("dataset_id").crossJoin(control)


# ---- scheduled batches -----------------------------------------------------------------------

_GONE = "The specific rules selected for this schedule are no longer active."


@query("scheduler_config_rows", ctes(STAGES, f"""
SELECT * FROM ({_rated(_seeded(("DS_BRONZE_FX_RATE",), names=("VALIDITY_NUMERIC_FORMAT",)))}) checked
UNION ALL SELECT 'DS_BRONZE_FX_RATE', 'SCHEDULER_CONFIG_CHECK', NULL, 0, 0, 0.0, 0.0, 'WARNING', '{_GONE}'
UNION ALL SELECT 'DS_BRONZE_FX_RATE', 'SCHEDULER_CONFIG_CHECK', NULL, 0, 0, 0.0, 0.0, 'ERROR', 'Error parsing config'"""))
def scheduler_config_rows(spark, sf_dir):
    """Three schedules of one dataset: a rule that runs, rules that are gone, a selection that cannot be read."""
    conf, registry, out = Configuration.shipped(spark), _registry(spark, sf_dir), None
    for i, selection in enumerate(('{"customRules": ["8"]}', '{"customRules": ["999"]}', "{customRules")):
        run = run_batch(registry, conf, AS_OF, f"RUN_{i}", "DS_BRONZE_FX_RATE", selection)
        out = run.results if out is None else out.unionByName(run.results)
    reason = F.col("failure_reason")
    return out.select(*RESULT).withColumn("failure_reason", F.when(
        reason.startswith("Error parsing config: "), "Error parsing config").otherwise(reason))


# ---- metric history --------------------------------------------------------------------------


@query("metric_backfill_written", ctes([*HISTORY, "stg_customer"], f"""
SELECT metric_name, source_system, CAST(count(*) AS BIGINT) AS row_count,
       round(sum(metric_value), 2) AS total_value, min(metric_time) AS first_time, max(metric_time) AS last_time
FROM (SELECT metric_name, source_system, metric_value, metric_time FROM unified
      UNION ALL
      SELECT 'DQ_PASS_RATE', 'OLD', CAST(pass_rate AS DOUBLE), CAST(check_timestamp AS VARCHAR)
      FROM history WHERE check_timestamp < {MONTH_AGO}) m
GROUP BY metric_name, source_system""", *_UNIFIED_PARTS))
def metric_backfill_written(spark, sf_dir):
    """A written history whose last month is replaced twice by the same facts."""
    path = fresh_dir(spark, "facts")
    observe.write_facts(derived(spark, sf_dir, "history").select(
        F.lit("DQ_PASS_RATE").alias("metric_name"), F.lit("OLD").alias("source_system"),
        F.col("pass_rate").cast("double").alias("metric_value"), F.col("check_timestamp").alias("metric_time")), path)
    for _ in range(2):
        observe.write_backfill(_unified(spark, sf_dir), path, HISTORY_AS_OF)
    facts = spark.read.schema("metric_name string, source_system string, metric_value double, metric_time timestamp_ntz").parquet(path)
    return facts.groupBy("metric_name", "source_system").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("metric_value"), 2).alias("total_value"),
        F.min("metric_time").alias("first_time"), F.max("metric_time").alias("last_time"))


# ---- reports ---------------------------------------------------------------------------------

_REPORT = "summary_date, dataset_id, table_name, total_checks, failed_checks, dq_score, quality_grade, last_run_id"


@query("report_written", ctes(HISTORY, f"""
SELECT format, CAST(summary_date AS VARCHAR) AS summary_date, * EXCLUDE (format, summary_date)
FROM (SELECT {_REPORT} FROM daily), (VALUES ('CSV'), ('JSON')) formats(format)""", daily_sql()))
def report_written(spark, sf_dir):
    """The platform's report written as CSV and as JSON, found through its registry row and read again."""
    daily = observe.report_extract(_daily(spark, sf_dir)).select(*[c.strip() for c in _REPORT.split(",")])
    out = None
    for kind in ("CSV", "JSON"):
        row = observe.write_report(daily, fresh_dir(spark, "report"), kind, f"R_{kind}", "PLATFORM", "tests", AS_OF).first()
        reader = spark.read.schema(daily.schema).option("header", True)
        read = (reader.csv if row["format"] == "CSV" else reader.json)(row["file_path"])
        part = read.select(F.lit(row["format"]).alias("format"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# ---- damaged landings ------------------------------------------------------------------------


@query("json_bad_utf8", """
SELECT event_type, CAST(count(*) FILTER (WHERE event_type <> 'error' AND user_id % 7 <> 0) AS BIGINT) AS landed,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS bad_bytes,
       CAST(count(*) FILTER (WHERE event_type <> 'error' AND user_id % 7 = 0) AS BIGINT) AS malformed,
       CAST(sum(CASE WHEN event_type <> 'error' AND user_id % 7 <> 0 THEN event_id END) AS BIGINT) AS ids
FROM events GROUP BY event_type""")
def json_bad_utf8(spark, sf_dir):
    """Lines with bytes that are no UTF-8 and lines cut off, beside good ones: rejected one by one, with their reason."""
    path = fresh_dir(spark, "json")
    events = source(spark, sf_dir, "events").withColumn("text", F.to_json(F.struct("event_id", "event_type", "value")))
    bad = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("20FFFE"))).cast("string")
    cut = F.expr("substr(text, 1, length(text) - 9)")
    line = F.when(F.col("event_type") == "error", bad).when(F.col("user_id") % 7 == 0, cut).otherwise(F.concat(F.lit("["), "text", F.lit("]")))
    events.select(line.alias("value")).write.text(path)
    landing = bronze.land_json(spark, path, T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())]), AS_OF)
    kind = F.regexp_extract("text", '"event_type":"([a-z]+)"', 1)
    rejected = landing.rejects.select(kind.alias("event_type"), "reason", F.lit(None).cast("bigint").alias("event_id"))
    every = landing.elements.select("event_type", F.lit(None).cast("string").alias("reason"), "event_id").unionByName(rejected)
    return every.groupBy("event_type").agg(
        F.count("event_id").alias("landed"), F.count_if(F.col("reason") == "INVALID_UTF8").alias("bad_bytes"),
        F.count_if(F.col("reason") == "MALFORMED_JSON").alias("malformed"), F.sum("event_id").alias("ids"))


@query("csv_quoted_newlines", ctes(["stg_customer"], """
SELECT 'quoted lines' AS mode, CAST(count(*) AS BIGINT) AS rows_parsed, CAST(0 AS BIGINT) AS error_count,
       CAST(count(*) FILTER (WHERE customer_name IS NOT NULL AND country = 'India') AS BIGINT) AS broken_names FROM stg_customer
UNION ALL
SELECT 'lines', CAST(count(*) + count(*) FILTER (WHERE customer_name IS NOT NULL AND country = 'India') AS BIGINT),
       CAST(2 * count(*) FILTER (WHERE customer_name IS NOT NULL AND country = 'India') AS BIGINT), CAST(0 AS BIGINT) FROM stg_customer"""))
def csv_quoted_newlines(spark, sf_dir):
    """Names with a line break inside quotes: whole with the option, torn lines among the load errors without."""
    schema, path = schemas.BRONZE_FILES["customer"], fresh_dir(spark, "quoted")
    name = F.when(F.col("country") == "India", F.concat("customer_name", F.lit("\n\"von\" X"))).otherwise(F.col("customer_name"))
    rows = derived(spark, sf_dir, "stg_customer").withColumn("customer_name", name).select(*schema.names)
    rows.repartition(8).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    out = None
    for mode in ("quoted lines", "lines"):
        scan = bronze.scan_csv(spark, path, schema, quoted_lines=mode == "quoted lines")
        whole = F.col("customer_name").endswith("\n\"von\" X")
        part = scan.agg(F.count(F.lit(1)).alias("rows_parsed"), F.count(bronze.CORRUPT).alias("error_count"),
                        F.count_if(whole & F.col(bronze.CORRUPT).isNull()).alias("broken_names"), F.count(schema.names[0]).alias("_first"))
        part = part.drop("_first").select(F.lit(mode).alias("mode"), "*")
        out = part if out is None else out.unionByName(part)
    return out
