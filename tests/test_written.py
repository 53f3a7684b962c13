from __future__ import annotations

import os
import subprocess
import sys
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators import observe
from assayer.operators.evaluate import common_type, daily_volume, evaluate, key_digest
from assayer.operators.failed_rows import failed_rows
from assayer.operators.profile import distinct_counts
from assayer.operators.rules import rule
from assayer.plans.config import parse_allowed
from assayer.plans.runs import measured_safely
from assayer.sources import bronze

NOW = "2026-01-20 12:00:00"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def lines(found):
    return {r[0]: tuple(r)[1:] for r in found}


def parquet(spark, df, tmp_path, name="t"):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_one_scan_for_all_kinds_of_rules(spark, tmp_path):
    child = parquet(spark, spark.range(40).selectExpr("CAST(id % 7 AS STRING) AS k", "CAST(id AS STRING) AS x", "id % 3 AS d", "id AS unused",
                                                      "TIMESTAMP_NTZ '2026-01-10 00:00:00' + make_dt_interval(CAST(id % 5 AS INT)) AS load_timestamp"), tmp_path)
    parent = parquet(spark, spark.range(5).selectExpr("CAST(id AS STRING) AS id"), tmp_path, "p")
    specs = [rule("COMPLETENESS_CHECK", "x"), rule("UNIQUENESS_PRIMARY_KEY", "k"), rule("CONSISTENCY_FOREIGN_KEY", "k"),
             rule("UNIQUENESS_COMPOSITE_KEY", None, columns=["k", "d"]), rule("VOLUME_ROW_COUNT_THRESHOLD"), rule("FRESHNESS_LOAD_TIMESTAMP", max_age_days=7),
             rule("VOLUME_ANOMALY_DETECTION")]
    out = evaluate(child, specs, NOW, lambda s: (parent, "id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "unused" not in plan.split("ReadSchema")[1].split("\n")[0]
    found = lines(out.collect())
    assert found[None] == (40, 40, 0, None)
    assert found["|UNIQUENESS_PRIMARY_KEY|k"][1:3] == (40, 33) and found["|UNIQUENESS_COMPOSITE_KEY|*"][1:3] == (40, 19)
    assert found["|CONSISTENCY_FOREIGN_KEY|k"][1:3] == (40, 10) and found["|FRESHNESS_LOAD_TIMESTAMP|*"][1:3] == (1, 0)
    # Five days with 8 rows each, then the 15th to 20th without any: six silent days.
    assert found["|VOLUME_ANOMALY_DETECTION|*"][1:3] == (11, 6)


def test_silent_days(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2026-01-01', DATE '2026-01-10')) AS d").unionAll(spark.sql("SELECT DATE '2026-01-20'")).unionAll(
        spark.sql("SELECT DATE '2026-03-01'"))
    rows = {r["day"]: r for r in daily_volume(days, "d", NOW).collect()}
    assert len(rows) == 20 and rows[date(2026, 1, 1)]["expected_rows"] is None
    strange = sorted(d.day for d, r in rows.items() if r["is_anomaly"])
    assert strange == [11, 12, 13, 14, 15, 16, 17, 20]
    assert (rows[date(2026, 1, 18)]["row_count"], rows[date(2026, 1, 18)]["expected_rows"]) == (0, 0.0)
    assert daily_volume(days.limit(0), "d", NOW).count() == 0


def test_keys_compare_like_values(spark):
    def digest(sql, *kinds):
        df = spark.sql(f"SELECT {sql}")
        return df.select(key_digest([(F.col(f.name), f.dataType) for f in df.schema.fields]).alias("k")).first()[0]

    assert digest("0.0D AS a") == digest("-0.0D AS a") and digest("'ab' AS a, 'c' AS b") != digest("'a' AS a, 'bc' AS b")
    assert digest("CAST(NULL AS STRING) AS a, 1 AS b") is None and digest("'1' AS a") == digest("1 AS a")
    assert common_type(spark, T.DecimalType(10, 2), T.DecimalType(12, 4)) == T.DecimalType(12, 4)


def test_faulty_checks_are_found_alone(spark):
    df = spark.sql("SELECT id, CAST(id % 3 AS INT) AS z, CAST(id AS STRING) AS x FROM range(30)")
    specs = [rule("COMPLETENESS_CHECK", "x"), rule("CONSISTENCY_LOGICAL_RELATIONSHIP", None, holds="id / z > 0"),
             rule("UNIQUENESS_PRIMARY_KEY", "z"), rule("VALIDITY_NUMERIC_FORMAT", "x")]
    found = lines(measured_safely(df, specs, NOW, None))
    assert found["|CONSISTENCY_LOGICAL_RELATIONSHIP|*"] == (30, 0, 0, "Check cannot be computed: DIVIDE_BY_ZERO")
    assert found["|UNIQUENESS_PRIMARY_KEY|z"] == (30, 30, 27, None) and found["|VALIDITY_NUMERIC_FORMAT|x"] == (30, 30, 0, None)
    broken = df.where(F.raise_error(F.lit("gone")).isNull())
    assert all(m[4].startswith("Source cannot be read") for m in measured_safely(broken, specs, NOW, None))


def test_failing_rows_of_equal_keys(spark):
    """A blank key of many rows: the smallest whole rows of it, each as often as it stands there."""
    rows = [("", i % 50, None) for i in range(400)] + [("a", 1, None), ("b", 2, "x")]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    found = failed_rows(df, [rule("COMPLETENESS_CHECK", "v")], NOW, ["k"], limit=10).collect()
    assert [r["failed_record_pk"] for r in found] == [""] * 10
    assert sorted(r["row_context"] for r in found) == ['{"k":"","n":0}'] * 8 + ['{"k":"","n":1}'] * 2


def test_failing_rows_rank_narrow_rows(spark, tmp_path):
    df = parquet(spark, spark.range(30).selectExpr("CAST(id AS STRING) AS k", "CAST(NULL AS STRING) AS v", "repeat('x', 1000) AS wide"), tmp_path)
    plan = failed_rows(df, [rule("COMPLETENESS_CHECK", "v")], NOW, ["k"], limit=3)._jdf.queryExecution().executedPlan().toString()
    schemas = [part.split("\n")[0] for part in plan.split("ReadSchema: ")[1:]]
    assert sum("wide" in s for s in schemas) == 1 and sum("wide" not in s for s in schemas) >= 1


def test_distinct_counts_in_one_scan(spark, tmp_path):
    df = parquet(spark, spark.sql("SELECT id % 4 AS a, CAST(id AS STRING) AS b, CAST(NULL AS DATE) AS c FROM range(20)"), tmp_path)
    out = distinct_counts(df, df.schema.fields)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r[0]: r[1] for r in out.collect()} == {"a": 4, "b": 20, "c": 0}


def facts(spark, *rows):
    return spark.createDataFrame(rows, "metric_time string, metric_value double").withColumn("metric_time", F.col("metric_time").cast("timestamp_ntz"))


def test_backfill_leaves_older_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "facts")
    observe.write_facts(facts(spark, ("2025-11-01 08:00:00", 1.0), ("2026-01-10 08:00:00", 2.0), ("2026-01-10 18:00:00", 3.0), ("2026-01-12 08:00:00", 4.0)), path)
    stamp = {d: os.stat(f"{path}/{d}").st_mtime_ns for d in os.listdir(path) if d.startswith("metric_day")}
    for _ in range(2):
        observe.write_backfill(facts(spark, ("2026-01-13 09:00:00", 5.0), ("2025-12-01 00:00:00", 9.0)), path, NOW, 10)
    assert sorted(r["metric_value"] for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 5.0]
    assert os.stat(f"{path}/metric_day=2025-11-01").st_mtime_ns == stamp["metric_day=2025-11-01"]
    assert not os.path.exists(f"{path}/metric_day=2026-01-12")


def test_json_landing(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_bytes(b'{"a": 1, "b": "x"}\n[{"a": 2}, {"a": "no", "b": "y"}]\n\n  \n{"a": 3, "b": "\xff"}\n{"a": 4\nplain\n{}\n"text"\n')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    landing = bronze.land_json(spark, str(path), schema, NOW)
    assert [(r["a"], r["b"]) for r in landing.elements.orderBy("a", "b").collect()] == [(None, None), (None, "y"), (1, "x"), (2, None)]
    assert sorted(r["reason"] for r in landing.rejects.collect()) == ["INVALID_UTF8", "MALFORMED_JSON", "MALFORMED_JSON", "MALFORMED_JSON"]


@pytest.mark.parametrize("text, values", [("'it''s','b,c'", ["it's", "b,c"]), ("a, b ,'c'", ["a", "b", "c"]), ("'abc'''", ["abc'"])])
def test_quotes_in_allowed_values(spark, text, values):
    assert spark.createDataFrame([(text,)], "v string").select(parse_allowed(F.col("v")).alias("v")).first()["v"] == values


def test_a_missing_library_costs_its_own_queries_only():
    code = ("import sys; sys.modules['xxhash'] = None; sys.modules['public_tokenizers'] = None\n"
            "import __spark_entry__ as e; print(len(e.queries()), len(e.QUERIES), len(e.oracle_sql()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    every, library, _ = map(int, out.stdout.split()[-3:])
    assert library > 120 and every >= library, out.stderr
