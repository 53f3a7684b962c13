"""Scorecards, metric facts and insights."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.operators import observe, summary

NOW = "2026-02-10 14:00:00"


def _results(spark, rows):
    """rows: (day, dataset, rule type, rate, status, threshold)"""
    return spark.createDataFrame(
        [(f"{d} 10:00:00", ds, kind, str(rate), status, str(limit)) for d, ds, kind, rate, status,
         limit in rows],
        "t string, dataset_id string, rule_type string, r string, check_status string, l string"
    ).selectExpr(
        "CAST(t AS TIMESTAMP_NTZ) AS check_timestamp", "dataset_id", "'DB' AS database_name",
        "'S' AS schema_name", "concat('T_', dataset_id) AS table_name", "rule_type",
        "concat('R_', substr(t, 1, 10)) AS run_id", "CAST(r AS DECIMAL(10,2)) AS pass_rate",
        "CAST(l AS DECIMAL(10,2)) AS threshold", "check_status", "100L AS total_records",
        "CAST(100 - CAST(r AS DOUBLE) AS BIGINT) AS invalid_records", "1000L AS execution_time_ms",
        "CAST(0.00001 AS DECIMAL(10,6)) AS execution_credits", "CAST(1 AS DECIMAL(5,2)) AS weight",
        "CAST(NULL AS STRING) AS column_name", "rule_type AS rule_name")


def _datasets(spark, sla="90"):
    return spark.sql(f"SELECT * FROM VALUES ('A', 'dom', CAST({sla} AS DECIMAL(10,2))), "
                     "('B', 'dom', NULL) t(dataset_id, business_domain, sla_threshold)")


def test_daily_scores_grades_and_counts(spark):
    results = _results(spark, [
        ("2026-02-10", "A", "COMPLETENESS", 100, "PASSED", 90),
        ("2026-02-10", "A", "VALIDITY", 80, "FAILED", 95),
        ("2026-02-10", "A", "VALIDITY", 85.01, "WARNING", 90),
        ("2026-02-10", "B", "VOLUME", 0, "ERROR", 0)])
    rows = {r["dataset_id"]: r for r in summary.daily_summary(results, _datasets(spark)).collect()}
    a = rows["A"]
    assert str(a["dq_score"]) == "88.34" and str(a["validity_score"]) == "82.51"
    assert str(a["completeness_score"]) == "100.00" and a["volume_score"] is None
    assert (a["total_checks"], a["passed_checks"], a["failed_checks"], a["warning_checks"],
            a["skipped_checks"]) == (3, 1, 1, 1, 0)
    assert (a["trust_level"], a["quality_grade"], a["is_sla_met"]) == ("MEDIUM", "C", False)
    assert a["last_run_status"] == "COMPLETED_WITH_FAILURES"
    assert (a["total_records"], a["failed_records_count"], str(a["failure_rate"])) == (
        300, 34, "11.33")
    assert rows["B"]["skipped_checks"] == 1 and rows["B"]["quality_grade"] == "F"
    b = summary.daily_summary(results, _datasets(spark), scheme="incremental", failure_base="max",
                              last_status="check").where("dataset_id = 'A'").first()
    assert (b["quality_grade"], b["last_run_status"], str(b["failure_rate"])) == (
        "B", "WARNING", "34.00")


def test_daily_limits(spark):
    results = _results(spark, [("2026-02-10", "A", "VOLUME", 100, "PASSED", 90),
                               ("2026-02-09", "A", "VOLUME", 100, "PASSED", 90)])
    datasets = _datasets(spark)
    assert summary.daily_summary(results, datasets, as_of=NOW).count() == 1
    assert summary.daily_summary(results, datasets, run_id="R_2026-02-09").count() == 1


def test_weighted_score(spark):
    results = _results(spark, [("2026-02-10", "A", "VOLUME", 100, "PASSED", 90),
                               ("2026-02-10", "A", "VALIDITY", 50, "FAILED", 90)]
                       ).withColumn("weight", F.when(F.col("rule_type") == "VOLUME", 1)
                                    .otherwise(3).cast("decimal(5,2)"))
    row = summary.daily_summary(results, _datasets(spark)).first()
    assert (str(row["dq_score"]), str(row["weighted_dq_score"])) == ("75.00", "62.50")


def _weeks(spark, scores):
    from datetime import date, timedelta
    start = date(2025, 12, 1)
    return summary.daily_summary(_results(spark, [
        (str(start + timedelta(days=7 * i + 2)), "A", "VALIDITY", s, "PASSED", 90)
        for i, s in enumerate(scores)]), _datasets(spark))


def test_weekly_streaks_and_changes(spark):
    rows = summary.weekly_rollup(_weeks(spark, [95, 80, 85, 92, 89, 70, 60])).orderBy(
        "week_start_date").collect()
    assert [r["weeks_below_sla"] for r in rows] == [0, 1, 2, 0, 1, 2, 3]
    assert [r["score_trend"] for r in rows] == [
        "STABLE", "DEGRADING", "IMPROVING", "IMPROVING", "DEGRADING", "DEGRADING", "DEGRADING"]
    assert str(rows[1]["score_change_pct"]) == "-15.79" and rows[0]["score_change_pct"] is None
    assert [r["week_id"] for r in rows] == ["2025-W49", "2025-W50", "2025-W51", "2025-W52",
                                            "2026-W01", "2026-W02", "2026-W03"]
    assert (str(rows[4]["week_start_date"]), str(rows[4]["week_end_date"])) == (
        "2025-12-29", "2026-01-04")


def test_only_adjacent_weeks_count(spark):
    weeks = _weeks(spark, [80, 70, 75, 85]).where("dq_score <> 75")
    rows = summary.weekly_rollup(weeks).orderBy("week_start_date").collect()
    assert [r["weeks_below_sla"] for r in rows] == [1, 2, 1]
    assert [r["prev_week_score"] is None for r in rows] == [True, False, True]


def test_monthly_and_quarterly(spark):
    results = _results(spark, [
        *[("2026-01-05", "A", t, 50, "FAILED", 98) for t in ("VALIDITY", "VALIDITY", "VOLUME")],
        *[("2026-01-06", "A", t, 50, "FAILED", 90) for t in ("FRESHNESS", "UNIQUENESS")],
        ("2026-02-05", "A", "VALIDITY", 100, "PASSED", 90),
        ("2026-03-05", "A", "VALIDITY", 100, "PASSED", 90)])
    daily = summary.daily_summary(results, _datasets(spark))
    monthly = summary.monthly_rollup(daily, results)
    rows = {r["month_id"]: r for r in monthly.collect()}
    january = rows["2026-01"]
    assert january["top_failure_types"] == "VALIDITY, FRESHNESS, UNIQUENESS, VOLUME"
    assert january["total_critical_issues"] == 3 and rows["2026-02"]["total_critical_issues"] == 0
    assert (str(january["min_dq_score"]), str(january["month_end_date"]),
            str(january["sla_compliance_pct"])) == ("50.00", "2026-01-31", "0.00")
    quarter = summary.quarterly_rollup(daily, monthly).first()
    assert (quarter["quarter_id"], quarter["best_month"], quarter["worst_month"]) == (
        "2026-Q1", "2026-02", "2026-01")
    assert str(quarter["quarter_end_date"]) == "2026-03-31"
    assert str(quarter["sla_compliance_pct"]) == "50.00"


def test_score_trend_and_upsert(spark):
    daily = _weeks(spark, [90, 95, 95])
    assert {r["prev_day_score"] for r in summary.with_score_trend(daily).collect()} == {None}
    days = daily.withColumn("summary_date", F.expr(
        "date_add(DATE '2026-01-01', CAST(row_number() OVER (ORDER BY summary_date) - 1 AS INT))"))
    rows = summary.with_score_trend(days).orderBy("summary_date").collect()
    assert [r["score_trend"] for r in rows] == ["STABLE", "IMPROVING", "STABLE"]
    merged = summary.upsert_summary(daily, daily.where("dq_score = 90"))
    assert sorted(merged.collect(), key=str) == sorted(daily.collect(), key=str)


def _metrics(spark, rows):
    """rows: (asset, time, value)"""
    return spark.createDataFrame(
        [(a, "DQ_SCORE", v, t, i) for i, (a, t, v) in enumerate(rows)],
        "asset_id string, metric_name string, metric_value double, t string, n int"
    ).withColumn("metric_time", F.col("t").cast("timestamp_ntz")).drop("t")


_series = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 400),
                             st.one_of(st.none(), st.integers(0, 100))), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(series=_series)
def test_sliced_lag_equals_plain_lag(spark, series):
    rows = [(a, f"2026-02-0{1 + m // 300} {m % 300 // 20:02d}:{m % 20:02d}:00",
             None if v is None else float(v)) for a, m, v in series]
    df = _metrics(spark, rows)
    plain = df.withColumn("prev_value", F.lag("metric_value").over(
        Window.partitionBy("asset_id").orderBy("metric_time", "n")))
    sliced = observe.with_previous(df, "n")
    assert {(r["n"], r["prev_value"]) for r in plain.collect()} == {
        (r["n"], r["prev_value"]) for r in sliced.collect()}


def test_drop_trend_and_stale_insights(spark):
    rows = [("X", f"2026-02-{d:02d} 09:00:00", float(v)) for d, v in
            ((4, 95), (5, 94), (6, 93), (8, 92), (9, 75), (10, 74))]
    rows += [("Y", "2026-02-05 09:00:00", 60.0), ("Y", "2026-02-09 09:00:00", 70.0),
             ("Z", "2026-01-01 09:00:00", 99.0)]
    metrics = _metrics(spark, rows)
    drops = observe.score_drops(metrics, NOW, "n").collect()
    assert [(r["asset_id"], r["score_drop"]) for r in drops] == [("X", 17.0)]
    trends = {r["asset_id"]: r["trend"] for r in observe.score_trends(metrics, NOW).collect()}
    assert trends["Y"] == 10.0 and round(trends["X"], 2) == -13.67
    found = {(r["asset_id"], r["insight_type"]): r
             for r in observe.insights(metrics, NOW, "n", max_age_days=20).collect()}
    assert set(found) == {("X", "ANOMALY"), ("X", "TREND"), ("Y", "TREND"), ("Z", "FRESHNESS")}
    drop = found["X", "ANOMALY"]
    assert drop["summary"] == "DQ Score dropped 17.0% (from 92.0% to 75.0%)"
    details = json.loads(drop["details"])
    assert details["evidence"] == {"metric_name": "dq_score", "previous_value": 92.0,
                                   "current_value": 75.0, "change": -17.0}
    assert len(details["bullets"]) == 4 and len(details["recommendations"]) == 3
    assert (drop["severity"], drop["is_actionable"], drop["confidence_score"]) == (
        "WARNING", True, 85.0)
    assert str(drop["expires_at"]) == "2026-03-12 14:00:00"
    assert found["Y", "TREND"]["summary"] == "Quality improving: +10.0% over last week"
    assert (found["Y", "TREND"]["severity"], found["Y", "TREND"]["is_actionable"]) == (
        "INFO", False)
    assert found["X", "TREND"]["summary"] == "Quality degrading: -13.67% over last week"
    only = observe.insights(metrics, NOW, "n", asset="Y").collect()
    assert {r["asset_id"] for r in only} == {"Y"}
    assert observe.active_insights(observe.insights(metrics, NOW, "n"), "2026-03-12 14:00:00"
                                   ).count() == 0


def test_ingest_validates_and_normalises(spark):
    df = spark.createDataFrame(
        [("db.s.t", "row_count", 1.0, None), (None, "x", 2.0, "S"), ("a", None, 3.0, "S")],
        "asset_id string, metric_name string, metric_value double, source_system string")
    rows = observe.ingest_metrics(df, NOW, "DEFAULT").collect()
    assert [(r["asset_id"], r["metric_name"], r["source_system"], str(r["metric_time"]))
            for r in rows] == [("DB.S.T", "ROW_COUNT", "DEFAULT", NOW)]
    assert observe.rejected_metrics(df).count() == 2


def test_unified_metrics_and_backfill(spark):
    results = _results(spark, [("2026-02-10", "A", "VALIDITY", 80, "FAILED", 95),
                               ("2026-01-01", "A", "VALIDITY", 80, "FAILED", 95)])
    profile = spark.sql("SELECT 'db' AS database_name, 's' AS schema_name, 't' AS table_name, "
                        "'c' AS column_name, 'STRING' AS data_type, 3L AS distinct_count, "
                        "4L AS total_records, 1L AS null_count, 'P' AS run_id, "
                        "TIMESTAMP_NTZ '2026-02-09 00:00:00' AS profile_ts "
                        "UNION ALL SELECT 'db', 's', 't', 'e', 'STRING', 0L, 0L, 0L, 'P', "
                        "TIMESTAMP_NTZ '2026-02-09 00:00:00'")
    daily = summary.daily_summary(results, _datasets(spark))
    unified = observe.unified_metrics(results, profile, daily, NOW)
    rows = {(r["metric_name"], r["column_name"]): r for r in unified.collect()}
    assert set(rows) == {("DQ_PASS_RATE", None), ("NULL_RATE", "c"), ("NULL_RATE", "e"),
                         ("DQ_SCORE", None)}
    assert rows["NULL_RATE", "c"]["metric_value"] == 25.0
    assert rows["NULL_RATE", "e"]["metric_value"] is None
    assert json.loads(rows["DQ_PASS_RATE", None]["tags"]) == {
        "rule_type": "VALIDITY", "rule_name": "VALIDITY", "threshold": 95.00,
        "total_records": 100, "invalid_records": 20}
    assert rows["DQ_SCORE", None]["asset_id"] == "DB.S.T_A"
    once = observe.backfill(unified.limit(0), unified, NOW)
    twice = observe.backfill(once, unified, NOW)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    shorter = observe.backfill(unified, unified, NOW, days=1)
    assert sorted(map(str, shorter.collect())) == sorted(map(str, unified.collect()))


def test_reports_and_lineage(spark, tmp_path):
    from assayer.plans import seeds
    daily = _weeks(spark, [90, 95])
    extract = observe.report_extract(daily, "DB.S.T_A")
    assert extract.count() == 2 and observe.report_extract(daily, "X.Y.Z").count() == 0
    for kind in ("CSV", "JSON"):
        path = str(tmp_path / kind)
        row = observe.write_report(extract, path, kind, "r1", "DB.S.T_A", "me", NOW).first()
        assert (row["format"], row["report_type"]) == (kind, "DATASET")
        read = spark.read.option("header", True)
        assert (read.csv(path) if kind == "CSV" else read.json(path)).count() == 2
    with pytest.raises(ValueError):
        observe.write_report(extract, str(tmp_path / "x"), "PDF", "r", "PLATFORM", "me", NOW)
    edges = observe.lineage_listing(seeds.lineage(spark)).collect()
    assert len(edges) == 8 and edges[0]["upstream"] == "BANKING_DW.BRONZE.STG_ACCOUNT"


def test_hot_asset_is_spread_over_slices(spark):
    rng = random.Random(3)
    rows = [("HOT", f"2026-02-{4 + i % 6:02d} {i % 24:02d}:{i % 60:02d}:00",
             float(rng.randrange(100))) for i in range(2000)]
    df = _metrics(spark, rows)
    plan = observe.with_previous(df, "n")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(asset_id" in plan and "_slice" in plan
    plain = df.withColumn("p", F.lag("metric_value").over(
        Window.partitionBy("asset_id").orderBy("metric_time", "n")))
    assert {(r["n"], r["p"]) for r in plain.collect()} == {
        (r["n"], r["prev_value"]) for r in observe.with_previous(df, "n").collect()}
