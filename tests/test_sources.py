"""Landing of files, registries and result tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from assayer import schemas
from assayer.sources import bronze, tables

NOW = "2026-02-10 14:05:06"


def _write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_null_tokens_quotes_and_audit_columns(spark, tmp_path):
    path = _write(tmp_path / "in", "c.csv", (
        "customer_id,customer_name,email,dob,phone,kyc_status,country,created_date\n"
        'C1, "Doe, Jane" ,N/A,null,-,NULL,n/a,2024-01-01\n'
        "C2,x-y,NA,,  555  ,Verified,Null,\n"))
    rows = bronze.read_bronze(spark, "customer", path, NOW).orderBy("customer_id").collect()
    assert rows[0]["customer_name"] == "Doe, Jane"
    assert [rows[0][c] for c in ("email", "dob", "phone", "kyc_status", "country")] == [None] * 5
    assert (rows[1]["customer_name"], rows[1]["phone"], rows[1]["country"]) == ("x-y", "555", "Null")
    assert rows[1]["created_date"] is None
    assert rows[0]["load_batch_id"] == "BATCH_20260210_140506"
    assert rows[0]["source_file"].endswith("/c.csv")
    assert str(rows[0]["load_timestamp"]) == "2026-02-10 14:05:06"


def test_file_order_differs_from_table_order(spark, tmp_path):
    path = _write(tmp_path / "in", "f.csv",
                  "currency_code,fx_rate_to_usd,rate_date\nEUR,1.1,2024-01-01\n")
    df = bronze.read_bronze(spark, "fx_rate", path, NOW)
    assert df.columns[:3] == ["currency_code", "rate_date", "fx_rate_to_usd"]
    assert df.first()["rate_date"] == "2024-01-01"


def test_rows_of_another_width(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "a.csv", "account_id,balance_date,closing_balance\nA,2024-01-01,5\nB,2024-01-02\n")
    path = _write(folder, "b.csv", "account_id,balance_date,closing_balance\nC,2024-01-03,7,extra\n")
    kept = bronze.read_bronze(spark, "daily_balance", path, NOW)
    assert {(r["account_id"], r["closing_balance"]) for r in kept.collect()} == {
        ("A", "5"), ("B", None), ("C", "7")}
    strict = bronze.read_bronze(spark, "daily_balance", path, NOW, skip_bad_rows=True)
    assert [r["account_id"] for r in strict.collect()] == ["A"]
    scan = bronze.scan_csv(spark, path, schemas.BRONZE_FILES["daily_balance"])
    audit = {r["source_file"].rsplit("/", 1)[1]: (r["rows_parsed"], r["error_count"],
                                                  r["first_error"])
             for r in bronze.load_errors(scan).collect()}
    assert audit == {"a.csv": (2, 1, "B,2024-01-02"), "b.csv": (1, 1, "C,2024-01-03,7,extra")}


def test_json_outer_array(spark, tmp_path):
    path = _write(tmp_path / "j", "x.json", json.dumps([{"a": 1}, {"a": 2}], indent=2))
    assert sorted(r["a"] for r in bronze.read_json(
        spark, path, document_per_file=True).collect()) == [1, 2]
    lines = _write(tmp_path / "l", "x.json", '[{"a": 1}, {"a": 2}]\n{"a": 3}\n')
    assert sorted(r["a"] for r in bronze.read_json(spark, lines).collect()) == [1, 2, 3]


def test_listing_stats_and_samples(spark, tmp_path):
    folder = tmp_path / "in"
    path = _write(folder, "a.csv", "account_id,balance_date,closing_balance\nA,2024-01-01,5\n"
                                   "A,2024-01-01,6\nB,,7\n")
    assert [r["path"].rsplit("/", 1)[1] for r in bronze.list_files(spark, path).collect()] == ["a.csv"]
    df = bronze.read_bronze(spark, "daily_balance", path, NOW)
    stats = bronze.load_stats(df, "T").first()
    assert (stats["rows_loaded"], stats["batch_count"]) == (3, 1)
    summary = bronze.load_summary({"T": (df, ["account_id", "balance_date"])}).first()
    assert (summary["total_rows"], summary["unique_keys"], summary["batch_count"]) == (3, 1, 1)
    sample = bronze.labelled_sample(df, "LABEL", df.columns[:1], 2)
    assert sample.count() == 2 and sample.columns[0] == "dataset"


def test_registry_forms(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "p")
    df.write.parquet(path)
    df.createOrReplaceTempView("registered_view")
    registry = (tables.Registry(spark).add("frame", df).add("loader", lambda: df)
                .add("path", path).add("name", "registered_view"))
    assert all(registry.frame(k).count() == 3 for k in ("frame", "loader", "path", "name"))
    assert "path" in registry and "other" not in registry


def test_append_replace_and_schema_growth(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.sql("SELECT * FROM VALUES (DATE '2026-01-01', 1), (DATE '2026-01-02', 2) t(d, v)")
    tables.append(first, path, "d", ("v",))
    tables.append(first, path, "d")
    assert spark.read.parquet(path).count() == 4
    tables.replace_partitions(
        spark.sql("SELECT DATE '2026-01-02' AS d, 9 AS v, 'x' AS extra"), path, "d")
    rows = tables.read_if_exists(spark, path)
    assert sorted((str(r["d"]), r["v"], r["extra"]) for r in rows.collect()) == [
        ("2026-01-01", 1, None), ("2026-01-01", 1, None), ("2026-01-02", 9, "x")]
    tables.overwrite(first.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    assert tables.read_if_exists(spark, str(tmp_path / "absent")) is None


def test_watermark_audit(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2026-02-10 01:00:00'), "
                   "(TIMESTAMP_NTZ '2026-02-09 01:00:00'), (NULL) t(ts)")
    since = F.lit("2026-02-10 00:00:00").cast("timestamp_ntz")
    row = tables.watermark_audit(df, "ts", since).first()
    assert (row["total_rows"], row["today_rows"]) == (3, 1)
    counts = tables.counts_since({"T": df}, "ts", since).first()
    assert (counts["table_name"], counts["row_count"]) == ("T", 1)


def test_checkpoint_folder_comes_from_the_session(spark):
    assert tables.shared_dir(spark) in (spark.conf.get("spark.checkpoint.dir", None),
                                        spark.sparkContext.getCheckpointDir())
    cut = tables.cut_lineage(spark.range(5).selectExpr("id * 2 AS x"))
    assert cut.count() == 5
    assert "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()
