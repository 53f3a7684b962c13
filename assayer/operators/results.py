"""Shaping of evaluated measures into check results, run records and failures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer import schemas
from assayer.functions import scoring
from assayer.functions.clock import AsOf, instant
from assayer.operators.rules import RuleSpec
from assayer.sources.tables import literal_rows

_SPEC_FIELDS = T.StructType([
    T.StructField("check_key", T.StringType()), T.StructField("dataset_id", T.StringType()),
    T.StructField("column_name", T.StringType()), T.StructField("rule_id", T.LongType()),
    T.StructField("rule_name", T.StringType()), T.StructField("rule_type", T.StringType()),
    T.StructField("rule_level", T.StringType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
])


# Check results with the key of the check and the rows its dataset had in scope.
LINES = T.StructType([*schemas.CHECK_RESULTS.fields, T.StructField("check_key", T.StringType()),
                      T.StructField("rows_in_scope", T.LongType())])


def spec_frame(spark: SparkSession, specs: Iterable[RuleSpec]) -> DataFrame:
    """Configured checks as a small frame to join measures with."""
    rows = [(s.check_key, s.dataset_id, s.column, s.rule_id, s.rule_name, s.rule_type,
             s.rule_level, float(s.threshold), float(s.weight)) for s in specs]
    return literal_rows(spark, rows, _SPEC_FIELDS).withColumns({
        "threshold": F.col("threshold").cast("decimal(10,2)"),
        "weight": F.col("weight").cast("decimal(5,2)")})


def _aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns and types; absent ones are NULL."""
    present = set(df.columns)
    return df.selectExpr(*[
        f"CAST({f.name if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) "
        f"AS {f.name}" for f in schema.fields])


def check_id(run_id: Column, check_key: Column) -> Column:
    """Repeatable identifier of one check of one run."""
    return F.sha2(F.concat_ws("|", run_id, check_key), 256)


def shape_lines(measures: DataFrame, specs: DataFrame, run_id: str, as_of: AsOf,
                empty_volume_passes: bool = False) -> DataFrame:
    """Measures of one run with rate, status, reason and the parts of the dataset name.

    ``measures`` carries the scan columns of its dataset.  A check that could not
    run is an ERROR row; one with nothing to check in an incremental scan is
    SKIPPED.  Incremental datasets without rows in scope yield no rows at all.
    Beside the checks there is a line per dataset with its rows in scope; it has
    no check key.
    """
    total, invalid = F.col("total_records"), F.col("invalid_records")
    incremental = F.col("scan_scope") == "INCREMENTAL"
    in_scope = measures.where(~incremental | (F.col("rows_in_scope") > 0))
    joined = in_scope.join(specs, "check_key", "left")
    is_error = F.col("error_message").isNotNull()
    empty_volume = (F.col("rule_type") == "VOLUME") & F.lit(not empty_volume_passes)
    rate = (
        F.when(is_error, F.lit(0).cast("decimal(10,2)"))
        .when(empty_volume & (total == 0), F.lit(0).cast("decimal(10,2)"))
        .otherwise(scoring.pass_rate(total, invalid))
    )
    rated = joined.withColumn("pass_rate", rate)
    status = (
        F.when(is_error, "ERROR").when(incremental & (total == 0), "SKIPPED")
        .otherwise(scoring.check_status(F.col("pass_rate"), F.col("threshold")))
    )
    prefix = F.when(F.col("labelled"), F.concat(F.lit("["), F.col("scan_scope"), F.lit("] "))
                    ).otherwise("")
    on_column = F.col("column_name").isNotNull()

    def of_type(rule_type: str) -> Column:
        return F.when((F.col("rule_type") == rule_type) & on_column, invalid).otherwise(0)

    shaped = rated.withColumn("check_status", status).withColumns({
        "check_id": check_id(F.lit(run_id), F.col("check_key")),
        "run_id": F.lit(run_id),
        "check_timestamp": instant(as_of),
        "valid_records": total - invalid,
        "null_records": of_type("COMPLETENESS"),
        "duplicate_records": of_type("UNIQUENESS"),
        "failure_reason": F.coalesce(
            F.substring("error_message", 1, 500),
            scoring.failure_reason(F.col("check_status"), F.col("pass_rate"),
                                   F.col("threshold"), invalid, total, prefix)),
    })
    return _aligned(shaped, LINES)


def outcomes_of(lines: DataFrame) -> DataFrame:
    """The checks of a run without its row-count lines."""
    return lines.where("check_key IS NOT NULL").select(*schemas.CHECK_RESULTS.names)


def config_error(spark: SparkSession, run_id: str, as_of: AsOf, dataset: dict, name: str,
                 status: str, reason: str, scope: str | None) -> DataFrame:
    """A single row that records a configuration problem of a dataset."""
    row = spark.range(1).select(
        check_id(F.lit(run_id), F.lit(f"{dataset['dataset_id']}|{name}")).alias("check_id"),
        F.lit(run_id).alias("run_id"), instant(as_of).alias("check_timestamp"),
        F.lit(dataset["dataset_id"]).alias("dataset_id"),
        F.lit(dataset["source_database"]).alias("database_name"),
        F.lit(dataset["source_schema"]).alias("schema_name"),
        F.lit(dataset["source_table"]).alias("table_name"),
        F.lit(name).alias("rule_name"), F.lit("CONFIGURATION").alias("rule_type"),
        F.lit("TABLE").alias("rule_level"),
        *[F.lit(0).alias(c) for c in ("total_records", "valid_records", "invalid_records",
                                      "pass_rate", "threshold")],
        F.lit(status).alias("check_status"), F.lit(reason).alias("failure_reason"),
        F.lit(scope).alias("scan_scope"), F.lit(name).alias("check_key"))
    return _aligned(row, LINES)


def recorded(outcomes: DataFrame) -> DataFrame:
    """Outcomes that are logged: skipped checks leave no row."""
    return outcomes.where("check_status <> 'SKIPPED'")


def with_timing(results: DataFrame, elapsed_ms: float, checks: int) -> DataFrame:
    """Share a run's elapsed time evenly among its checks and estimate credits.

    Fused checks run together, so a check has no duration of its own.
    """
    each = F.lit(elapsed_ms / max(checks, 1))
    return results.withColumns({
        "execution_time_ms": F.round(each).cast("bigint"),
        "execution_credits": scoring.credits(each).cast("decimal(10,6)")})


def with_dataset_timing(results: DataFrame, seconds: dict[str, float]) -> DataFrame:
    """Share the time that each dataset's job took evenly among the checks of that dataset."""
    took = literal_rows(results.sparkSession, list(seconds.items()), T.StructType([
        T.StructField("dataset_id", T.StringType()), T.StructField("_seconds", T.DoubleType())]))
    checks = results.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_checks"))
    each = F.coalesce("_seconds", F.lit(0.0)) * 1000 / F.col("_checks")
    joined = results.join(checks, "dataset_id").join(took, "dataset_id", "left")
    return joined.withColumns({
        "execution_time_ms": F.round(each).cast("bigint"),
        "execution_credits": scoring.credits(each).cast("decimal(10,6)")}).select(*results.columns)


def run_control(lines: DataFrame, run_id: str, run_type: str, triggered_by: str, as_of: AsOf,
                datasets: int, seconds: float | None = None) -> DataFrame:
    """The run's record as one row: status counters, rows in scope, overall pass rate.

    Checks and row-count lines are aggregated together, so the run is evaluated once.
    ``seconds`` is the time a finished run took; without it there is no end.
    """
    status = F.col("check_status")
    is_check = F.col("check_key").isNotNull() & (F.col("rule_type") != "CONFIGURATION")
    is_scope = F.col("check_key").isNull()

    def checks(condition: Column) -> Column:
        return F.count_if(is_check & condition)

    def total(name: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(name))), F.lit(0))

    counted = lines.agg(
        F.count_if(is_check).alias("total_checks"),
        checks(status == "PASSED").alias("passed_checks"),
        checks(status == "FAILED").alias("failed_checks"),
        checks(status == "WARNING").alias("warning_checks"),
        checks(status.isin("ERROR", "SKIPPED")).alias("skipped_checks"),
        total("total_records", is_check).alias("records_processed"),
        total("invalid_records", is_check).alias("invalid_records"),
        total("rows_in_scope", is_scope).alias("total_rows_in_scope"),
        F.count_if(is_scope).alias("total_datasets"),
    )
    return _aligned(counted.withColumns({
        "run_id": F.lit(run_id), "run_type": F.lit(run_type),
        "triggered_by": F.lit(triggered_by), "start_ts": instant(as_of),
        "duration_seconds": F.lit(seconds),
        "end_ts": (F.lit(None) if seconds is None
                   else instant(as_of) + F.make_dt_interval(secs=F.lit(float(seconds)))),
        "run_status": run_status(F.col("failed_checks")),
        "datasets_skipped": F.lit(datasets) - F.col("total_datasets"),
        "row_level_records_processed": F.col("total_rows_in_scope"),
        "pass_rate": F.coalesce(scoring.share(F.col("passed_checks"), F.col("total_checks")),
                                F.lit(0)),
    }), schemas.RUN_CONTROL)


def run_status(failed: Column) -> Column:
    return F.when(failed > 0, "COMPLETED_WITH_FAILURES").otherwise("COMPLETED")


def failed_run(spark: SparkSession, run_id: str, run_type: str, triggered_by: str, as_of: AsOf,
               error: str) -> DataFrame:
    """The record of a run that could not be carried out."""
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(run_type).alias("run_type"),
        F.lit(triggered_by).alias("triggered_by"), instant(as_of).alias("start_ts"),
        instant(as_of).alias("end_ts"), F.lit("FAILED").alias("run_status"),
        F.lit(error[:4000]).alias("error_message"))
    return _aligned(row, schemas.RUN_CONTROL)


def failures(results: DataFrame) -> DataFrame:
    """One classified row per failed or warned check that found errors."""
    return results.where(
        F.col("check_status").isin("FAILED", "WARNING") & (F.col("invalid_records") > 0)
    ).select(
        "check_id", "run_id", "dataset_id", "table_name", "column_name", "rule_name", "rule_type",
        scoring.failure_type(F.col("rule_type")).alias("failure_type"),
        F.col("rule_type").alias("failure_category"),
        scoring.is_critical(F.col("threshold")).alias("is_critical"),
        F.lit(False).alias("can_auto_remediate"),
        scoring.remediation(F.col("rule_type")).alias("remediation_suggestion"),
        "invalid_records", F.col("check_timestamp").alias("detected_ts"))


def profile_results(checks: DataFrame, run_id: str, as_of: AsOf) -> DataFrame:
    """The checks derived from a profile as check results."""
    invalid, total = F.col("invalid_records"), F.col("total_records")

    def of_type(rule_type: str) -> Column:
        return F.when(F.col("rule_type") == rule_type, invalid).otherwise(0)

    key = F.concat_ws("|", "dataset_id", "rule_name", "column_name")
    return _aligned(checks.withColumns({
        "check_id": check_id(F.lit(run_id), key), "run_id": F.lit(run_id), "check_timestamp": instant(as_of),
        "rule_level": F.lit("COLUMN"), "valid_records": total - invalid, "null_records": of_type("COMPLETENESS"),
        "duplicate_records": of_type("UNIQUENESS"), "scan_scope": F.lit("FULL"), "scan_reason": F.lit("PROFILE")}),
        schemas.CHECK_RESULTS)


def profile_control(results: DataFrame, run_id: str, triggered_by: str, as_of: AsOf, rows: int,
                    seconds: float) -> DataFrame:
    """The record of a profile run of one dataset."""
    status = F.col("check_status")
    counted = results.agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if(status == "PASSED").alias("passed_checks"),
        F.count_if(status == "FAILED").alias("failed_checks"), F.count_if(status == "WARNING").alias("warning_checks"),
        F.coalesce(F.sum("total_records"), F.lit(0)).alias("records_processed"),
        F.coalesce(F.sum("invalid_records"), F.lit(0)).alias("invalid_records"))
    return _aligned(counted.withColumns({
        "run_id": F.lit(run_id), "run_type": F.lit("PROFILE"), "triggered_by": F.lit(triggered_by),
        "start_ts": instant(as_of), "end_ts": instant(as_of) + F.make_dt_interval(secs=F.lit(float(seconds))),
        "duration_seconds": F.lit(seconds), "run_status": run_status(F.col("failed_checks")),
        "total_datasets": F.lit(1), "datasets_skipped": F.lit(0), "skipped_checks": F.lit(0),
        "total_rows_in_scope": F.lit(rows), "row_level_records_processed": F.lit(rows),
        "pass_rate": F.coalesce(scoring.share(F.col("passed_checks"), F.col("total_checks")), F.lit(0))}),
        schemas.RUN_CONTROL)


def latest_results(results: DataFrame, limit: int = 10) -> DataFrame:
    """Newest check results; the check id settles ties."""
    return results.orderBy(F.desc("check_timestamp"), "check_id").limit(limit)


def results_by_scope(results: DataFrame) -> DataFrame:
    """Checks, validations and largest scan per dataset and scan scope."""
    return results.groupBy("dataset_id", "table_name", "scan_scope").agg(
        F.count(F.lit(1)).alias("check_count"),
        F.countDistinct("rule_name").alias("rules_applied"),
        F.sum("total_records").alias("total_validations"),
        F.max("total_records").alias("rows_per_check"),
    ).orderBy(F.desc("total_validations"), "dataset_id")


def runs_of_type(runs: DataFrame, run_type: str, since: Column) -> DataFrame:
    """Runs of one type since an instant, newest first."""
    return runs.where((F.col("run_type") == run_type) & (F.col("start_ts") >= since)).orderBy(
        F.desc("start_ts"), "run_id")
