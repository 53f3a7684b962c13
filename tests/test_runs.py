"""Check runs on the planted-defect tables: exact results in every mode."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from assayer.operators.evaluate import evaluate, unresolved
from assayer.operators.rules import rule
from assayer.plans.runs import (
    Configuration, execute, execute_or_record, run_batch, run_checks, run_rule, run_scan, watermark_problem,
)
from assayer.sources.tables import Registry, replace_run
from tests import planted
from tests.planted import NOW


def _by_check(results):
    return {(r["dataset_id"], r["rule_name"], r["column_name"]):
            (r["total_records"], r["invalid_records"], str(r["pass_rate"]), r["check_status"])
            for r in results.collect()}


def test_planted_defects_incremental(spark):
    run = run_checks(planted.registry(spark), planted.configuration(spark), NOW, "R1",
                     incremental=True)
    assert _by_check(run.results) == planted.EXPECTED
    record = run.control().first()
    assert record["run_status"] == "COMPLETED_WITH_FAILURES"
    assert (record["total_checks"], record["failed_checks"], record["warning_checks"],
            record["passed_checks"]) == (10, 3, 4, 3)
    assert record["total_rows_in_scope"] == 42 and record["total_datasets"] == 3


def test_full_scan_counts_the_whole_account_table(spark):
    run = run_checks(planted.registry(spark), planted.configuration(spark), NOW, "R1",
                     "DS_STG_ACCOUNT_TEST")
    found = _by_check(run.results)
    assert found["DS_STG_ACCOUNT_TEST", "UNIQUENESS_PRIMARY_KEY", "ACCOUNT_ID"] == (
        20, 2, "90.00", "FAILED")
    assert {r["scan_scope"] for r in run.results.collect()} == {"FULL"}


def test_incremental_dataset_without_rows_today_is_skipped(spark):
    run = run_checks(planted.registry(spark), planted.configuration(spark),
                     "2026-02-11 09:00:00", "R1", incremental=True)
    assert "DS_STG_ACCOUNT_TEST" not in {k[0] for k in _by_check(run.results)}
    record = run.control().first()
    assert (record["total_datasets"], record["datasets_skipped"]) == (2, 1)


def test_failure_reasons(spark):
    run = run_checks(planted.registry(spark), planted.configuration(spark), NOW, "R1",
                     incremental=True)
    reasons = {(r["dataset_id"], r["rule_name"], r["column_name"]): r["failure_reason"]
               for r in run.results.collect()}
    assert reasons["DS_STG_ACCOUNT_TEST", "COMPLETENESS_CHECK", "ACCOUNT_ID"] == (
        "[INCREMENTAL] Pass rate 90.0% below threshold 100.0%. "
        "Found 1 invalid records out of 10.")
    assert reasons["DS_STG_CUSTOMER_TEST", "COMPLETENESS_CHECK", "EMAIL"] == (
        "[FULL] Pass rate 90.0% within warning range of threshold 95.0%.")
    assert reasons["DS_STG_CUSTOMER_TEST", "COMPLETENESS_CHECK", "CUSTOMER_ID"] is None


@pytest.mark.parametrize("column, part", [
    ("no_such", "does not exist"), ("opened_date", "invalid datatype 'STRING'"),
    ("load timestamp", "invalid characters")])
def test_bad_watermark_becomes_an_error_row(spark, column, part):
    datasets = [(*row[:7], column, row[8]) if row[0] == "DS_STG_ACCOUNT_TEST" else row
                for row in planted.DATASETS]
    conf = planted.configuration(spark, datasets)
    run = run_checks(planted.registry(spark), conf, NOW, "R1", incremental=True)
    rows = [r for r in run.results.collect() if r["dataset_id"] == "DS_STG_ACCOUNT_TEST"]
    assert [(r["rule_name"], r["check_status"]) for r in rows] == [("CONFIG_VALIDATION", "ERROR")]
    assert part in rows[0]["failure_reason"]
    assert run.control().first()["datasets_skipped"] == 1


def test_watermark_may_be_a_date(spark):
    df = spark.sql("SELECT DATE '2026-02-10' AS d, TIMESTAMP '2026-02-10 01:00:00' AS t")
    assert watermark_problem(df, "D", "x") is None and watermark_problem(df, "t", "x") is None


def test_incremental_scope_of_each_watermark_type(spark):
    from assayer.operators.evaluate import rows_since_midnight
    df = spark.sql("""SELECT * FROM VALUES
      (DATE '2026-02-09', TIMESTAMP '2026-02-09 23:59:59', TIMESTAMP_NTZ '2026-02-09 23:59:59'),
      (DATE '2026-02-10', TIMESTAMP '2026-02-10 00:00:00', TIMESTAMP_NTZ '2026-02-10 00:00:00'),
      (NULL, NULL, NULL) AS t(d, ts, ntz)""")
    for column in ("d", "ts", "ntz"):
        assert rows_since_midnight(df, column, NOW).count() == 1


def test_missing_columns_report_errors_and_the_rest_runs(spark):
    customer = spark.createDataFrame([("C1", "a@b.com")], "customer_id string, email string")
    registry = Registry(spark).add("DS_SILVER_CUSTOMER", customer)
    conf = Configuration.shipped(spark, layers=("SILVER",))
    run = run_checks(registry, conf, NOW, "R1", "DS_SILVER_CUSTOMER")
    rows = {(r["rule_name"], r["column_name"]): r for r in run.results.collect()}
    assert len(rows) == 14
    assert rows["COMPLETENESS_CHECK", "first_name"]["check_status"] == "ERROR"
    assert "first_name" in rows["COMPLETENESS_CHECK", "first_name"]["failure_reason"]
    assert rows["COMPLETENESS_CHECK", "email"]["check_status"] == "PASSED"
    assert run.control().first()["skipped_checks"] == 9


def test_empty_table(spark):
    empty = spark.createDataFrame([], "customer_id string, email string, created_at string")
    registry = Registry(spark).add("DS_BRONZE_TESTING", empty)
    run = run_checks(registry, planted.configuration(spark), NOW, "R1", "DS_BRONZE_TESTING")
    assert {v for v in _by_check(run.results).values()} == {(0, 0, "100.00", "PASSED")}


def test_empty_table_fails_the_volume_check(spark):
    empty = spark.createDataFrame([], "customer_id string, customer_name string, email string")
    registry = Registry(spark).add("DS_STG_CUSTOMER_TEST", empty)
    run = run_checks(registry, planted.configuration(spark), NOW, "R1", "DS_STG_CUSTOMER_TEST")
    found = _by_check(run.results)
    assert found["DS_STG_CUSTOMER_TEST", "VOLUME_ROW_COUNT_THRESHOLD", None] == (
        0, 1, "0.00", "FAILED")
    lenient = run_checks(registry, planted.configuration(spark), NOW, "R1",
                         "DS_STG_CUSTOMER_TEST", empty_volume_passes=True)
    assert _by_check(lenient.results)["DS_STG_CUSTOMER_TEST", "VOLUME_ROW_COUNT_THRESHOLD",
                                      None] == (0, 1, "100.00", "PASSED")


def test_no_active_dataset(spark):
    with pytest.raises(ValueError, match="No active datasets"):
        run_checks(planted.registry(spark), planted.configuration(spark), NOW, "R1", "DS_NONE")


def test_rule_type_and_mode_filters(spark):
    conf, registry = planted.configuration(spark), planted.registry(spark)
    typed = run_checks(registry, conf, NOW, "R1", rule_type="UNIQUENESS")
    assert {k[1] for k in _by_check(typed.results)} == {"UNIQUENESS_PRIMARY_KEY"}
    critical = run_checks(registry, conf, NOW, "R1", mode="CRITICAL_ONLY")
    assert {k[0] for k in _by_check(critical.results)} == {"DS_BRONZE_TESTING"}


def test_single_rule(spark):
    conf, registry = planted.configuration(spark), planted.registry(spark)
    mapped = run_rule(registry, conf, NOW, "R1", "DS_BRONZE_TESTING", "VALIDITY_EMAIL_FORMAT",
                      "EMAIL", threshold=99)
    assert list(_by_check(mapped.results).values()) == [(12, 1, "91.67", "FAILED")]
    adhoc = run_rule(registry, conf, NOW, "R1", "DS_STG_CUSTOMER_TEST", "VALIDITY_PHONE_FORMAT",
                     "phone", threshold=50, mode="ADHOC")
    # '12345' and '' break the pattern, NULL does not.
    assert list(_by_check(adhoc.results).values()) == [(20, 2, "90.00", "PASSED")]
    table = run_rule(registry, conf, NOW, "R1", "DS_STG_CUSTOMER_TEST",
                     "VOLUME_ROW_COUNT_THRESHOLD")
    assert list(_by_check(table.results).values()) == [(20, 0, "100.00", "PASSED")]
    with pytest.raises(ValueError, match="No active rule mapping"):
        run_rule(registry, conf, NOW, "R1", "DS_BRONZE_TESTING", "VALIDITY_PHONE_FORMAT", "phone")
    with pytest.raises(ValueError, match="not found"):
        run_rule(registry, conf, NOW, "R1", "DS_BRONZE_TESTING", "NO_RULE", "x", 5, "ADHOC")


def test_batch_selection(spark):
    conf, registry = planted.configuration(spark), planted.registry(spark)
    some = run_batch(registry, conf, NOW, "R1", "DS_BRONZE_TESTING", '{"customRules": ["5"]}')
    assert [k[1] for k in _by_check(some.results)] == ["VALIDITY_EMAIL_FORMAT"]
    everything = run_batch(registry, conf, NOW, "R1", "DS_BRONZE_TESTING", "NULL")
    assert len(_by_check(everything.results)) == 2
    none = run_batch(registry, conf, NOW, "R1", "DS_BRONZE_TESTING", '{"customRules": [99]}')
    row = none.results.first()
    assert (row["rule_name"], row["check_status"]) == ("SCHEDULER_CONFIG_CHECK", "WARNING")
    assert "no longer active" in row["failure_reason"]


def test_scan_dispatch(spark):
    conf, registry = planted.configuration(spark), planted.registry(spark)
    for kind, parts in (("profiling", {"profile"}), ("anomalies", {"profile"}),
                        ("checks", {"checks"}), ("custom", {"checks"}),
                        ("FULL", {"profile", "checks"})):
        assert set(run_scan(registry, conf, NOW, "R1", "DS_BRONZE_TESTING", kind)) == parts


def test_failed_records(spark):
    run = run_checks(planted.registry(spark), planted.configuration(spark), NOW, "R1",
                     incremental=True)
    keys = {"DS_BRONZE_TESTING": ["customer_id"], "DS_STG_ACCOUNT_TEST": ["account_id"],
            "DS_STG_CUSTOMER_TEST": ["customer_id"]}
    for counts in (None, run.invalid_counts()):
        rows = run.failed_records(keys, counts=counts).collect()
        found = {}
        for r in rows:
            found.setdefault((r["dataset_id"], r["rule_name"]), []).append(r)
        emails = found["DS_BRONZE_TESTING", "VALIDITY_EMAIL_FORMAT"]
        assert [(r["failed_record_pk"], r["failed_column_value"]) for r in emails] == [
            ("C012", "a$test.com")]
        assert json.loads(emails[0]["row_context"])["created_at"] == "2025-01-01"
        assert (emails[0]["actual_value_type"], emails[0]["expected_pattern"][:3]) == (
            "string", "^[A")
        assert emails[0]["failure_type"] == "INVALID_FORMAT" and not emails[0]["is_critical"]
        assert sorted(r["failed_record_pk"] for r in
                      found["DS_BRONZE_TESTING", "COMPLETENESS_CHECK"]) == ["C003", "C005"]
        repeated = found["DS_STG_ACCOUNT_TEST", "UNIQUENESS_PRIMARY_KEY"]
        assert sorted(r["failed_record_pk"] for r in repeated) == ["", "ACC3013"]
        assert all(r["is_critical"] for r in repeated)


def test_random_sample_is_full_and_failing(spark):
    from assayer.operators.failed_rows import failed_rows
    from assayer.operators.rules import rule
    df = spark.range(50000).selectExpr(
        "CAST(id AS STRING) AS id", "CASE WHEN id % 3 = 0 THEN 'x' ELSE '1' END AS v",
        "CASE WHEN id < 7 THEN NULL ELSE 'y' END AS w")
    specs = [rule("VALIDITY_NUMERIC_FORMAT", "v", dataset_id="D"),
             rule("COMPLETENESS_CHECK", "w", dataset_id="D")]
    counts = {specs[0].check_key: 16667, specs[1].check_key: 7}
    rows = failed_rows(df, specs, NOW, ["id"], counts=counts).collect()
    by_check = {s.check_key: [r for r in rows if r["check_key"] == s.check_key] for s in specs}
    numeric = by_check[specs[0].check_key]
    assert len(numeric) == 100 and all(int(r["failed_record_pk"]) % 3 == 0 for r in numeric)
    assert len({r["failed_record_pk"] for r in numeric}) == 100
    assert sorted(int(r["failed_record_pk"]) for r in by_check[specs[1].check_key]) == list(range(7))


def test_execute_is_idempotent_per_day(spark, tmp_path):
    conf, registry = planted.configuration(spark), planted.registry(spark)
    root = str(tmp_path / "results")
    for run_id in ("R1", "R2"):
        run = run_checks(registry, conf, NOW, run_id, incremental=True)
        execute(run, root, conf.datasets)
    results = spark.read.parquet(f"{root}/check_results")
    assert results.count() == 20
    assert results.where("execution_time_ms IS NULL").count() == 0
    summary = spark.read.parquet(f"{root}/daily_summary")
    rows = {r["dataset_id"]: r for r in summary.collect()}
    assert len(rows) == summary.count() == 3
    assert rows["DS_STG_ACCOUNT_TEST"]["total_checks"] == 8
    assert str(rows["DS_STG_ACCOUNT_TEST"]["dq_score"]) == "90.00"
    assert rows["DS_STG_ACCOUNT_TEST"]["last_run_id"] == "R2"
    assert spark.read.parquet(f"{root}/run_control").count() == 2
    # A run of one dataset on the same day leaves the other summaries in place.
    execute(run_checks(registry, conf, NOW, "R3", "DS_BRONZE_TESTING"), root, conf.datasets)
    again = spark.read.parquet(f"{root}/daily_summary")
    assert again.count() == 3
    assert again.where(F.col("dataset_id") == "DS_BRONZE_TESTING").first()["total_checks"] == 6


def test_repeated_run_replaces_itself(spark, tmp_path):
    conf, registry = planted.configuration(spark), planted.registry(spark)
    root = str(tmp_path / "results")
    for _ in range(2):
        execute(run_checks(registry, conf, NOW, "001", "DS_BRONZE_TESTING"), root, conf.datasets)
    results = spark.read.parquet(f"{root}/check_results")
    assert results.count() == results.select("check_id").distinct().count() == 2
    record = spark.read.parquet(f"{root}/run_control").collect()
    assert [r["run_id"] for r in record] == ["001"] and record[0]["end_ts"] > record[0]["start_ts"]
    assert spark.read.parquet(f"{root}/daily_summary").first()["total_checks"] == 2
    assert spark.read.parquet(f"{root}/failed_checks").count() == 2
    # An attempt without failures leaves none behind, also where no other run failed that day.
    replace_run(spark.read.parquet(f"{root}/failed_checks").where("false"), f"{root}/failed_checks",
                "001", "detected_date", NOW[:10])
    assert not list((tmp_path / "results" / "failed_checks").rglob("part-*"))


def test_no_check_ends_a_run(spark):
    conf, registry = planted.configuration(spark), planted.registry(spark)
    df = registry.frame("DS_BRONZE_TESTING")
    assert unresolved(df, rule("CONSISTENCY_LOGICAL_RELATIONSHIP", holds="email <> 'x'")) is None
    for broken in (rule("CONSISTENCY_LOGICAL_RELATIONSHIP", holds="nowhere > 1"),
                   rule("CONSISTENCY_LOGICAL_RELATIONSHIP", holds="email >"),
                   rule("CONSISTENCY_LOGICAL_RELATIONSHIP"), rule("COMPLETENESS_CRITICAL_COLUMNS"),
                   rule("UNIQUENESS_COMPOSITE_KEY")):
        line = evaluate(df, [broken], NOW).where("check_key IS NOT NULL").first()
        assert line["error_message"] and line["total_records"] == 0
    del registry.entries["DS_BRONZE_TESTING"]
    registry.add("DS_STG_ACCOUNT_TEST", "/nowhere/at/all")
    rows = run_checks(registry, conf, NOW, "R1").results.collect()
    errors = {r["dataset_id"]: r["failure_reason"] for r in rows if r["check_status"] == "ERROR"}
    assert set(errors) == {"DS_BRONZE_TESTING", "DS_STG_ACCOUNT_TEST"}
    assert "no registered source" in errors["DS_BRONZE_TESTING"]
    assert sum(r["dataset_id"] == "DS_STG_CUSTOMER_TEST" for r in rows) == 4


def test_adhoc_rule_is_bound_like_a_mapped_one(spark):
    conf, registry = planted.configuration(spark), planted.registry(spark)
    row = run_rule(registry, conf, NOW, "R1", "DS_STG_CUSTOMER_TEST", "VALIDITY_EMAIL_FORMAT", "EMAIL",
                   threshold=50, mode="ADHOC").results.first()
    known = conf.rules.where("rule_name = 'VALIDITY_EMAIL_FORMAT' AND is_active").agg(
        F.max("rule_id")).first()[0]
    assert row["rule_id"] == known and float(row["threshold"]) == 50


@pytest.mark.parametrize("text", ["{broken", "[1, 2]", '{"customRules": ["x"]}'])
def test_unreadable_selection_is_an_error_row(spark, text):
    conf, registry = planted.configuration(spark), planted.registry(spark)
    rows = run_batch(registry, conf, NOW, "R1", "DS_BRONZE_TESTING", text).results.collect()
    assert [(r["rule_name"], r["check_status"]) for r in rows] == [("SCHEDULER_CONFIG_CHECK", "ERROR")]
    assert rows[0]["failure_reason"].startswith("Error parsing config")


def test_failed_run_is_recorded(spark, tmp_path):
    conf, registry = planted.configuration(spark), planted.registry(spark)
    root = str(tmp_path / "results")
    record = execute_or_record(
        spark, lambda: run_checks(registry, conf, NOW, "R9", "DS_NONE"), root, conf.datasets, "R9",
        "FULL", NOW).first()
    assert (record["run_status"], record["error_message"]) == ("FAILED", "No active datasets found")
    done = execute_or_record(
        spark, lambda: run_checks(registry, conf, NOW, "R10", "DS_BRONZE_TESTING"), root,
        conf.datasets, "R10", "FULL", NOW).first()
    assert done["run_status"] == "COMPLETED_WITH_FAILURES"
    assert spark.read.parquet(f"{root}/run_control").count() == 2
