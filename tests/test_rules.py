"""Each rule on literal values, and properties of the evaluation."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from assayer.functions.scoring import check_status, pass_rate
from assayer.operators.evaluate import evaluate
from assayer.operators.rules import CATALOGUE, rule
from pyspark.sql import functions as F

NOW = "2026-02-10 14:00:00"


def _frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def _errors(spark, name, values, **params):
    row = [r for r in evaluate(_frame(spark, values), [rule(name, "x", **params)], NOW).collect()
           if r["check_key"] is not None]
    assert len(row) == 1 and row[0]["error_message"] is None, row
    return row[0]["total_records"], row[0]["invalid_records"]


@pytest.mark.parametrize("name, good, bad", [
    ("COMPLETENESS_CHECK", ["a", ""], [None]),
    ("VALIDITY_EMAIL_FORMAT", ["0@test.com", "a.b+c%d-e@x-y.co.uk", None],
     ["a$test.com", "a@b", "a@b.c", "a b@c.com", "a@b.com\n", "", " a@b.com"]),
    ("VALIDITY_PHONE_FORMAT", ["9876501001", "+1-555-1234", "555-123-4567", "+44 207 1234", None],
     ["12345", "", "abc", "+1--555-1234", "123-45-67890-1"]),
    ("VALIDITY_DATE_FORMAT", ["2024-02-29", "2023-3-5", None],
     ["31-02-2023", "03/05/2024", "2023-02-30", "soon", ""]),
    ("VALIDITY_NUMERIC_FORMAT", ["1200.50", "-3", "0", " 7 ", "1e3", None], ["XYZ", "1,000", ""]),
    ("VALIDITY_POSITIVE_NUMBER", ["1", "0.5", None], ["0.4", "0", "-1", "x"]),
    ("VALIDITY_NON_NEGATIVE_NUMBER", ["0", "-0.4", "5", None], ["-0.5", "-1", "x"]),
    ("VALIDITY_DATE_RANGE", ["1900-01-01", "2026-02-10", None],
     ["1899-12-31", "2026-02-11", "x"]),
    ("VALIDITY_COUNTRY_CODE", ["USA", "China", None], ["usa", "Atlantis", ""]),
    ("VALIDITY_CURRENCY_CODE", ["USD", "SEK", None], ["usd", "XXX"]),
    ("FRESHNESS_DATA_RECENCY", ["2026-02-10", "2025-11-12", "garbage", None],
     ["2025-11-11", "1999-01-01"]),
])
def test_row_rules(spark, name, good, bad):
    assert _errors(spark, name, good + bad) == (len(good) + len(bad), len(bad))
    assert _errors(spark, name, good) == (len(good), 0)


def test_parameters(spark):
    assert _errors(spark, "VALIDITY_POSITIVE_NUMBER", ["0.4", "0.000001"], scale=6) == (2, 0)
    assert _errors(spark, "VALIDITY_DATE_FORMAT", ["03/05/2024"],
                   date_formats=["dd/MM/yyyy"]) == (1, 0)
    assert _errors(spark, "FRESHNESS_DATA_RECENCY", ["2026-02-01"], max_age_days=3) == (1, 1)
    assert _errors(spark, "VALIDITY_ALLOWED_VALUES", ["A", "B", None], allowed=["A"]) == (3, 1)
    # Without a list only the empty string is allowed.
    assert _errors(spark, "VALIDITY_ALLOWED_VALUES", ["", "B", None]) == (3, 1)


def test_uniqueness_counts_nulls_and_extra_copies(spark):
    assert _errors(spark, "UNIQUENESS_PRIMARY_KEY", ["a", "a", "a", "b", None, None]) == (6, 4)


def test_table_rules(spark):
    df = spark.createDataFrame(
        [("a", 1, "2026-02-01"), ("a", 1, "2026-02-02"), ("b", None, "2026-02-09"),
         (None, 2, "2026-02-09")], "k string, n int, day string").selectExpr(
        "k", "n", "CAST(day AS TIMESTAMP_NTZ) AS load_timestamp", "CAST(day AS DATE) AS day")
    specs = [
        rule("UNIQUENESS_COMPOSITE_KEY", columns=["k", "n"]),
        rule("COMPLETENESS_CRITICAL_COLUMNS", columns=["k", "n"]),
        rule("CONSISTENCY_LOGICAL_RELATIONSHIP", holds="n < 2"),
        rule("FRESHNESS_LOAD_TIMESTAMP", max_age_days=2),
        rule("VOLUME_ROW_COUNT_THRESHOLD", min_rows=5),
        rule("VOLUME_ANOMALY_DETECTION", "day", tolerance=0.5),
    ]
    found = {r["check_key"]: (r["total_records"], r["invalid_records"])
             for r in evaluate(df, specs, NOW).collect() if r["check_key"]}
    assert found == {
        "|UNIQUENESS_COMPOSITE_KEY|*": (4, 3), "|COMPLETENESS_CRITICAL_COLUMNS|*": (4, 2),
        "|CONSISTENCY_LOGICAL_RELATIONSHIP|*": (4, 1), "|FRESHNESS_LOAD_TIMESTAMP|*": (1, 0),
        "|VOLUME_ROW_COUNT_THRESHOLD|*": (4, 1),
        # The 1st to the 10th, of which the 3rd to the 8th and the 10th have no rows and the 9th has two.
        "|VOLUME_ANOMALY_DETECTION|day": (10, 8)}


def test_foreign_key(spark):
    child = _frame(spark, ["a", "a", "b", "c", None])
    parent = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    for joined, expected in ((False, (4, 1)), (True, (6, 1))):
        spec = rule("CONSISTENCY_FOREIGN_KEY", "x", count_joined_rows=joined)
        row = [r for r in evaluate(child, [spec], NOW, lambda s: (parent, "id")).collect()
               if r["check_key"]][0]
        assert (row["total_records"], row["invalid_records"]) == expected
        assert row["rows_in_scope"] == 5


def test_unknown_parent_and_unknown_rule_are_errors(spark):
    from assayer.operators.rules import RuleSpec
    specs = [rule("CONSISTENCY_FOREIGN_KEY", "x"), RuleSpec("NO_SUCH_RULE", "VALIDITY", "x"),
             rule("VALIDITY_DATE_FORMAT", None), rule("COMPLETENESS_CHECK", "y")]
    rows = [r for r in evaluate(_frame(spark, ["a"]), specs, NOW, lambda s: None).collect()
            if r["check_key"]]
    assert len(rows) == 4 and all(r["error_message"] for r in rows)


def test_every_named_rule_has_a_definition():
    from assayer.plans.seeds import RULES
    assert {name for name, *_ in RULES} == set(CATALOGUE)
    assert all(CATALOGUE[name].rule_type == kind and CATALOGUE[name].level == level
               for name, kind, level, _ in RULES)


def test_plan_scans_once_for_all_row_rules(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("CAST(id AS STRING) AS x", "id AS unused").write.parquet(path)
    specs = [rule(n, "x") for n in ("COMPLETENESS_CHECK", "VALIDITY_NUMERIC_FORMAT",
                                    "VALIDITY_POSITIVE_NUMBER", "VALIDITY_DATE_FORMAT")]
    plan = evaluate(spark.read.parquet(path), specs, NOW)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("FileScan parquet") == 1 and "ReadSchema: struct<x:string>" in text


_texts = st.one_of(st.none(), st.sampled_from(
    ["", "a", "1", "-1", "0", "0.5", "2024-01-01", "2030-01-01", "x@y.com", "USA", "USD"]))


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(_texts, min_size=1, max_size=30))
def test_fused_equals_separate_and_counts_add_up(spark, values):
    names = [n for n, k in CATALOGUE.items() if k.level == "COLUMN"
             and n != "CONSISTENCY_FOREIGN_KEY"]
    df = _frame(spark, values)
    specs = [rule(n, "x") for n in names]
    fused = {r["check_key"]: (r["total_records"], r["invalid_records"])
             for r in evaluate(df, specs, NOW).collect() if r["check_key"]}
    assert set(fused) == {s.check_key for s in specs}
    assert all(t == len(values) and 0 <= e <= t for t, e in fused.values())
    for spec in specs[:3]:
        alone = [r for r in evaluate(df, [spec], NOW).collect() if r["check_key"]][0]
        assert (alone["total_records"], alone["invalid_records"]) == fused[spec.check_key]
    nulls = sum(v is None for v in values)
    assert fused["|COMPLETENESS_CHECK|x"][1] == nulls
    assert fused["|UNIQUENESS_PRIMARY_KEY|x"][1] == len(values) - len(set(values) - {None})


def test_status_is_monotone_in_the_threshold(spark):
    rows = spark.range(0, 101).selectExpr("CAST(id AS DECIMAL(10,2)) AS threshold")
    rate = pass_rate(F.lit(200), F.lit(17))
    ranks = {"PASSED": 0, "WARNING": 1, "FAILED": 2}
    found = [ranks[r["s"]] for r in rows.select(
        "threshold", check_status(rate, F.col("threshold")).alias("s"))
        .orderBy("threshold").collect()]
    assert found == sorted(found) and found.count(1) == 5


@pytest.mark.parametrize("total, invalid, rate", [
    (12, 2, "83.33"), (12, 1, "91.67"), (3, 1, "66.67"), (8, 1, "87.50"), (16, 1, "93.75"),
    (800, 1, "99.88"), (0, 0, "100.00"), (3 * 10 ** 12, 10 ** 12, "66.67")])
def test_pass_rate_rounds_half_up(spark, total, invalid, rate):
    assert str(spark.range(1).select(
        pass_rate(F.lit(total), F.lit(invalid)).alias("r")).first()["r"]) == rate


def test_more_checks_than_fit_one_pass(spark, monkeypatch):
    from assayer.operators import evaluate as module
    monkeypatch.setattr(module, "CHECKS_PER_PASS", 3)
    names = ["COMPLETENESS_CHECK", "VALIDITY_EMAIL_FORMAT", "VALIDITY_DATE_FORMAT",
             "VALIDITY_NUMERIC_FORMAT", "VALIDITY_COUNTRY_CODE", "VALIDITY_CURRENCY_CODE",
             "VALIDITY_PHONE_FORMAT"]
    specs = [rule(n, "x") for n in names] + [rule("COMPLETENESS_CHECK", "absent")]
    rows = evaluate(_frame(spark, ["a", None]), specs, NOW).collect()
    assert [r["check_key"] for r in rows].count(None) == 1
    assert {r["check_key"]: r["invalid_records"] for r in rows if r["check_key"]} == {
        s.check_key: int(s.column == "x") for s in specs}


def test_hot_keys_collapse_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("CAST(id % 3 AS STRING) AS x").write.parquet(path)
    df = spark.read.parquet(path)
    for spec in (rule("UNIQUENESS_PRIMARY_KEY", "x"), rule("CONSISTENCY_FOREIGN_KEY", "x")):
        out = evaluate(df, [spec], NOW, lambda s: (df, "x"))
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        keyed = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert keyed
        # The operator that feeds each keyed shuffle has already collapsed equal keys.
        assert all("HashAggregate(keys=[" in lines[i + 1] for i in keyed)
        assert any("partial_count" in lines[i + 1] for i in keyed)
