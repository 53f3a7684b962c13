from __future__ import annotations

import os

from pyspark.sql import functions as F

from assayer.operators.keys import BUCKET, KeyMap, bucket_of, digits_for, numbered
from assayer.plans import silver
from assayer.plans.silver import SilverTable, load_silver
from assayer.sources.tables import Scratch, append, overwrite, read_if_exists

COLUMNS = ("customer_id customer_name email dob phone kyc_status country created_date load_batch_id "
           "load_timestamp source_file").split()
FIRST, SECOND = "2024-01-30 12:00:00", "2024-02-01 08:00:00"


def landed(spark, *rows, hour=1):
    """Landed customers from ``customer_id, phone``."""
    full = [(i, "N", f"n{k}@example.com", "1990-01-01", phone, "Verified", "India", "2020-01-01", "B", f"2024-01-0{hour} 00:00:00", "f.csv")
            for k, (i, phone) in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in COLUMNS)).withColumn(
        "load_timestamp", F.col("load_timestamp").cast("timestamp_ntz"))


def by_id(table):
    return {r["customer_id"]: r for r in table.read().collect()}


def test_two_loads(spark, tmp_path):
    table = SilverTable(spark, str(tmp_path), "customer")
    first = table.load(landed(spark, ("a", "1"), ("b", "2"), ("  ", None), (None, "9")), FIRST, "L1").first()
    assert first[:3] == ("customer", 3, 0)
    before = by_id(table)
    assert sorted(r["customer_key"] for r in before.values()) == [1, 2, 3] and not before["  "]["is_valid"]
    second = table.load(landed(spark, ("b", "22"), ("c", "3"), hour=2), SECOND, "L2").first()
    assert second[:3] == ("customer", 1, 1)
    after = by_id(table)
    assert {i: after[i]["customer_key"] for i in before} == {i: r["customer_key"] for i, r in before.items()}
    assert after["c"]["customer_key"] == 4 and after["b"]["phone"] == "22" and after["a"] == before["a"]
    assert str(after["b"]["load_timestamp"]) == FIRST and str(after["b"]["updated_timestamp"]) == SECOND


def test_repeated_and_empty_loads(spark, tmp_path):
    table = SilverTable(spark, str(tmp_path), "customer")
    assert table.load(landed(spark), FIRST, "L0").first()[:3] == ("customer", 0, 0) and table.read() is None
    rows = landed(spark, ("a", "1"), ("b", "2"))
    table.load(rows, FIRST, "L1")
    once = by_id(table)
    assert table.load(rows, FIRST, "L1").first()[:3] == ("customer", 0, 2) and by_id(table) == once


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path):
    table = SilverTable(spark, str(tmp_path), "customer", rows_per_bucket=10)
    table.load(landed(spark, *[(f"c{i}", "1") for i in range(400)]), FIRST, "L1")
    before = files(table.path)
    table.load(landed(spark, ("c7", "2"), hour=2), SECOND, "L2")
    after = files(table.path)
    kept = {f.split("/")[-2] for f in before if f in after and before[f] == after[f]}
    assert len(kept) == 39 and len({f.split("/")[-2] for f in after}) == 40
    bucket = ({f.split("/")[-2] for f in after} - kept).pop()
    read = table.touched([int(bucket.split("=")[1])])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"{BUCKET}" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {f.split("/")[-2] for f in read.inputFiles() if read.where(F.input_file_name() == f).count()} == {bucket}


def test_counts_per_entity(spark, tmp_path):
    counts = load_silver(spark, {"customer": landed(spark, ("a", "1"))}, str(tmp_path), FIRST, "L1").collect()
    assert [tuple(r)[:3] for r in counts] == [("customer", 1, 0)]


def test_numbers_do_not_depend_on_pieces(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    found = [{r["k"]: r["n"] for r in numbered(df, ["k"], "n", 7, digits).collect()} for digits in (1, 2, 3)]
    assert found[0] == found[1] == found[2] and sorted(found[0].values()) == list(range(8, 508))
    assert digits_for(10) == 1 and digits_for(100_000 * 300) == 3


def test_a_broken_load_leaves_a_gap_and_repeats_no_number(spark, tmp_path):
    keys = KeyMap(spark, str(tmp_path), ("k", "d"), "n")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), (None, 1), ("b", None)], "k string, d int")
    assert keys.extend(rows, "L1") == 2 and keys.extend(rows, "L1") == 0
    lost = read_if_exists(spark, f"{keys.path}/allocations").withColumn("last_number", F.lit(9).cast("long"))
    append(lost, f"{keys.path}/allocations")
    assert keys.extend(rows.withColumn("d", F.col("d") + 1), "L2") == 1  # (a, 3)
    assert sorted(tuple(r) for r in keys.attach(spark.createDataFrame([("a", 3), ("z", 1)], "k string, d int"))
                  .select("k", "n").collect()) == [("a", 10), ("z", None)]


def test_scratch_tables_go(spark):
    with Scratch(spark, "test") as scratch:
        one, two = scratch.keep(spark.range(3)), scratch.keep(spark.range(4))
        scratch.drop(one)
        assert two.count() == 4 and read_if_exists(spark, scratch.tables[0][1]) is None
        root = scratch.root
    assert read_if_exists(spark, root) is None


def test_a_load_that_broke_off_is_made_up_for(spark, tmp_path):
    """Keys that were numbered and never written keep their number, whichever load brings them."""
    table = SilverTable(spark, str(tmp_path), "customer")
    table.load(landed(spark, ("a", "1")), FIRST, "L1")
    table.key_map.extend(landed(spark, ("b", "1"), ("c", "1")), "L2")  # what a load does before it breaks off
    given = {r["customer_id"]: r["customer_key"] for r in table.key_map.known().collect()}
    assert table.load(landed(spark, ("b", "2"), ("d", "2")), SECOND, "L3").first()[:3] == ("customer", 2, 0)
    assert table.load(landed(spark, ("a", "3"), ("c", "3")), SECOND, "L4").first()[:3] == ("customer", 1, 1)
    found = {i: r["customer_key"] for i, r in by_id(table).items()}
    assert found == given | {"d": 4} and sorted(found.values()) == [1, 2, 3, 4]


def test_whole_rows_are_shuffled_once(spark, tmp_path, monkeypatch):
    """One exchange of landed rows and one of the rows they replace, none to lay them out in buckets."""
    plans = []
    write = silver.replace_partitions
    monkeypatch.setattr(silver, "replace_partitions", lambda df, *rest: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *rest)))
    table = SilverTable(spark, str(tmp_path), "customer", rows_per_bucket=10)
    table.load(landed(spark, *[(f"c{i}", "1") for i in range(170)]), FIRST, "L1")
    table.load(landed(spark, *[(f"c{i}", "2") for i in range(100, 300)], hour=2), SECOND, "L2")
    wide = [[p for p in plan.split("Exchange hashpartitioning(")[1:] if not p.startswith("key_bucket")] for plan in plans]
    assert [plan.count("key_bucket") > 0 and "hashpartitioning(key_bucket" not in plan for plan in plans] == [True, True]
    assert [len(w) for w in wide][0] <= 2 and [len(w) for w in wide][1] <= 3
    assert all(len(f) == 1 for f in by_folder(table.path).values()) and len(by_folder(table.path)) == 24
    assert len(by_id(table)) == 300 and sorted(r["customer_key"] for r in by_id(table).values()) == list(range(1, 301))


def by_folder(path):
    found = {}
    for f in files(path):
        found.setdefault(os.path.dirname(f), []).append(f)
    return found


def test_folders_do_not_grow_with_the_rows(spark, tmp_path):
    table = SilverTable(spark, str(tmp_path), "customer", rows_per_bucket=5_000)
    assert table.buckets(160_000) == 32 and table.buckets(160_000_000) == 1_000
    assert SilverTable(spark, str(tmp_path), "customer").buckets(10 ** 9) == 2_000


def test_tables_of_the_former_layout_stay_in_use(spark, tmp_path):
    table = SilverTable(spark, str(tmp_path), "customer")
    overwrite(spark.sql("SELECT 8 AS buckets"), f"{table.root}/layout/customer")
    table.load(landed(spark, ("a", "1"), ("b", "1")), FIRST, "L1")
    assert {r[0] for r in table.touched(list(range(8))).select(F.col(BUCKET) - bucket_of(("customer_id",), 8)).collect()} == {0}
    assert table.load(landed(spark, ("b", "2"), hour=2), SECOND, "L2").first()[:3] == ("customer", 0, 1)
