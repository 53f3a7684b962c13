"""Column profiles and derived checks."""

from __future__ import annotations

import hashlib

from assayer.operators.profile import (
    profile_checks, profile_columns, profile_run, schema_registry,
)

NOW = "2026-02-10 14:00:00"


def _frame(spark):
    rows = [(i, None if i < 5 else f"t{i % 2}", i % 2 == 0, [i % 3], f"2026-02-{5 + i % 10:02d}")
            for i in range(20)]
    return spark.createDataFrame(
        rows, "n int, s string, b boolean, a array<int>, d string").selectExpr(
        "n", "s", "b", "a", "CAST(d AS TIMESTAMP) AS ts", "CAST(d AS DATE) AS `a day`")


def test_measures_per_type(spark):
    rows = {r["column_name"]: r for r in profile_columns(_frame(spark), NOW).collect()}
    assert [rows[c]["ordinal_position"] for c in ("n", "s", "b", "a", "ts", "a day")] == [
        1, 2, 3, 4, 5, 6]
    n = rows["n"]
    assert (n["total_records"], n["null_count"], n["distinct_count"], n["min_value"],
            n["max_value"], n["avg_value"]) == (20, 0, 20, "0", "19", 9.5)
    assert abs(n["stddev_value"] - 5.916079783099616) < 1e-9 and n["min_length"] is None
    s = rows["s"]
    assert (s["null_count"], s["distinct_count"], s["min_value"], s["min_length"],
            s["avg_length"]) == (5, 2, "t0", 2, 2.0)
    # Zero statistics stay zero.
    assert n["min_value"] == "0"
    assert (rows["b"]["distinct_count"], rows["b"]["min_value"]) == (2, None)
    assert rows["a"]["distinct_count"] == 3
    assert rows["ts"]["future_date_count"] == 8 and rows["a day"]["future_date_count"] == 8


def test_long_texts_count_by_their_whole_value(spark):
    base = "x" * 5000
    digest = hashlib.sha256(base.encode()).hexdigest()
    df = spark.createDataFrame([(base,), (base,), (base + "y",), (digest,), ("x" * 63,), (None,)],
                               "t string")
    row = profile_columns(df, NOW).first()
    # The digest text itself is long, so it is hashed again and stays a value of its own.
    assert row["distinct_count"] == 4
    assert (len(row["max_value"]), row["max_length"]) == (255, 5001)


def test_derived_checks(spark):
    checks = {(r["column_name"], r["rule_name"]): r
              for r in profile_checks(profile_columns(_frame(spark), NOW)).collect()}
    nulls = checks["s", "PROFILE_HIGH_NULLS"]
    assert (nulls["check_status"], float(nulls["pass_rate"]), float(nulls["threshold"]),
            nulls["failure_reason"]) == ("FAILED", 75.0, 80.0, "25.0% nulls")
    assert checks["n", "PROFILE_NULL_CHECK"]["check_status"] == "PASSED"
    assert checks["n", "PROFILE_NULL_CHECK"]["failure_reason"] is None
    future = checks["ts", "PROFILE_FUTURE_DATES"]
    assert (future["check_status"], float(future["pass_rate"]), future["invalid_records"],
            future["failure_reason"]) == ("FAILED", 60.0, 8, "8 future dates")
    # Two values in twenty rows are exactly ten percent: not low.
    assert ("s", "PROFILE_LOW_CARDINALITY") not in checks


def test_low_cardinality_and_warning(spark):
    df = spark.range(100).selectExpr("CASE WHEN id >= 10 THEN id % 3 END AS x", "1 AS one")
    checks = {(r["column_name"], r["rule_name"]): r
              for r in profile_checks(profile_columns(df, NOW)).collect()}
    assert checks["x", "PROFILE_NULL_CHECK"]["check_status"] == "WARNING"
    low = checks["x", "PROFILE_LOW_CARDINALITY"]
    assert (low["check_status"], float(low["pass_rate"]), low["invalid_records"],
            low["failure_reason"]) == ("WARNING", 3.0, 97, "Only 3 distinct values")
    # A constant column is not reported.
    assert ("one", "PROFILE_LOW_CARDINALITY") not in checks
    run = profile_run(profile_checks(profile_columns(df, NOW))).first()
    assert (run["total_checks"], run["warning_checks"], run["run_status"]) == (3, 2, "COMPLETED")


def test_empty_table_yields_no_checks(spark):
    df = spark.createDataFrame([], "x int")
    assert profile_columns(df, NOW).first()["total_records"] == 0
    assert profile_checks(profile_columns(df, NOW)).count() == 0


def test_many_columns(spark):
    df = spark.range(50).selectExpr(*[f"id % {i + 1} AS c{i}" for i in range(40)])
    rows = {r["column_name"]: r["distinct_count"] for r in profile_columns(df, NOW).collect()}
    assert rows == {f"c{i}": min(i + 1, 50) for i in range(40)}


def test_schema_registry(spark):
    rows = schema_registry({("D", "S", "T"): _frame(spark)}).collect()
    assert [(r["ordinal_position"], r["column_name"]) for r in rows] == [
        (1, "n"), (2, "s"), (3, "b"), (4, "a"), (5, "ts"), (6, "a day")]
    assert rows[0]["data_type"] == "INT" and rows[0]["is_nullable"]
