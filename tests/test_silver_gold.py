"""Cleansing, upserts and analytics on literal rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from assayer.operators.cleanse import SPECS, cleanse, latest_per_key, silver_from_bronze
from assayer.operators.upsert import replace_by_key, upsert, upsert_counts, with_surrogate_keys
from assayer.plans import gold
from assayer import schemas

NOW, LATER = "2026-02-10 14:00:00", "2026-02-11 14:00:00"


def _bronze(spark, entity, rows):
    names = schemas.BRONZE_FILES[entity].names
    order = schemas.BRONZE_TABLE_ORDER.get(entity, names)
    return spark.createDataFrame(
        [(*r[:-1], r[-1], "f.csv", "B1") for r in rows],
        ", ".join(f"{c} string" for c in order) + ", t string, source_file string, "
        "load_batch_id string").withColumn("load_timestamp", F.col("t").cast("timestamp_ntz")).drop("t")


def _cust(i, name="N", email="a@b.com", dob="1990-01-01", phone="1", kyc="Verified", country="UK",
          created="2020-01-01", t="2026-01-01 00:00:00"):
    return (i, name, email, dob, phone, kyc, country, created, t)


def test_customer_flags_scores_and_messages(spark):
    rows = [_cust("C1"), _cust("C2", email=None), _cust("C3", dob="31-02-2023", kyc="Nope"),
            _cust("  "), _cust("C5", kyc=None, phone=None, country=None, name=None),
            _cust(None)]
    found = {r["customer_id"]: r for r in cleanse(_bronze(spark, "customer", rows), "customer",
                                                  NOW).collect()}
    assert set(found) == {"C1", "C2", "C3", "  ", "C5"}
    assert (found["C1"]["is_valid"], float(found["C1"]["dq_score"]),
            found["C1"]["validation_errors"]) == (True, 100.0, [])
    assert (found["C2"]["is_valid"], float(found["C2"]["dq_score"]),
            found["C2"]["validation_errors"]) == (False, 80.0, ["Invalid email format"])
    assert found["C3"]["validation_errors"] == ["Invalid date of birth", "Invalid KYC status"]
    assert float(found["C3"]["dq_score"]) == 75.0
    assert found["  "]["validation_errors"] == ["Missing customer_id"]
    # A NULL enumeration costs points but is no message.
    assert (found["C5"]["is_valid"], float(found["C5"]["dq_score"]),
            found["C5"]["validation_errors"]) == (True, 55.0, [])


def test_account_rules(spark):
    rows = [("A1", "C1", "Savings", "Active", "10.005", "2020-01-01", NOW),
            ("A2", None, "CURRENT", "BLOCKED", "XYZ", "x", NOW)]
    found = {r["account_id"]: r for r in cleanse(_bronze(spark, "account", rows), "account",
                                                 NOW).collect()}
    assert str(found["A1"]["opening_balance"]) == "10.01" and found["A1"]["is_valid"]
    assert found["A2"]["validation_errors"] == [
        "Missing customer_id", "Invalid opening_balance", "Invalid account_type",
        "Invalid account_status"]
    assert float(found["A2"]["dq_score"]) == 25.0


def test_every_typed_table_has_its_schema(spark):
    for entity in SPECS:
        names = schemas.BRONZE_TABLE_ORDER.get(entity, schemas.BRONZE_FILES[entity].names)
        row = ("x",) * len(names) + (NOW,)
        out = cleanse(_bronze(spark, entity, [row]), entity, NOW)
        assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [
            (f.name, f.dataType.simpleString()) for f in schemas.SILVER[entity].fields]


def test_newest_version_per_key(spark):
    rows = [("A", "2026-01-01", "1", "2026-01-01 00:00:00"), ("A", "2026-01-01", "2", NOW),
            ("A", "bad", "3", NOW), (None, "2026-01-01", "4", NOW)]
    out = silver_from_bronze(_bronze(spark, "daily_balance", rows), "daily_balance", NOW)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle
    assert [(r["account_id"], str(r["closing_balance"])) for r in out.collect()] == [("A", "2.00")]


def test_ties_are_settled_by_content(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b")], "k string, t int, v string")
    for frame in (df, df.orderBy(F.desc("v"))):
        assert latest_per_key(frame, ["k"], "t", ["v"]).first()["v"] == "b"


def test_upsert_updates_inserts_and_keeps(spark):
    old = cleanse(_bronze(spark, "customer", [_cust("C1"), _cust("C2")]), "customer", NOW)
    new = cleanse(_bronze(spark, "customer", [_cust("C2", phone=None, name="New"), _cust("C3")]),
                  "customer", LATER)
    out = {r["customer_id"]: r for r in upsert(old, new, ["customer_id"]).collect()}
    assert set(out) == {"C1", "C2", "C3"}
    assert (out["C2"]["customer_name"], out["C2"]["phone"]) == ("New", None)
    assert (str(out["C2"]["load_timestamp"]), str(out["C2"]["updated_timestamp"])) == (NOW, LATER)
    assert str(out["C3"]["load_timestamp"]) == LATER and str(out["C1"]["updated_timestamp"]) == NOW
    counts = upsert_counts(old, new, ["customer_id"]).first()
    assert (counts["rows_inserted"], counts["rows_updated"]) == (1, 1)
    once = upsert(old, new, ["customer_id"])
    twice = upsert(once, new, ["customer_id"])
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)
    replaced = replace_by_key(old, new, ["customer_id"])
    assert sorted(r["customer_id"] for r in replaced.collect()) == ["C1", "C2", "C3"]


def test_upsert_keeps_a_surrogate_key_the_source_lacks(spark):
    old = spark.createDataFrame([("a", 7, 1)], "k string, key int, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    out = {r["k"]: (r["key"], r["v"]) for r in upsert(old, new, ["k"], ()).collect()}
    assert out == {"a": (7, 2), "b": (None, 3)}


def test_surrogate_keys_are_dense_and_repeatable(spark):
    df = spark.range(5000).selectExpr("concat('k', id) AS k")
    numbered = with_surrogate_keys(df, ["k"], "key", 100, digits=2)
    rows = {r["k"]: r["key"] for r in numbered.collect()}
    assert sorted(rows.values()) == list(range(101, 5101))
    again = with_surrogate_keys(df.repartition(13), ["k"], "key", 100, digits=2)
    assert {r["k"]: r["key"] for r in again.collect()} == rows


def _gold_tables(spark):
    rng = random.Random(7)
    customers = [(f"C{i}", f"2000-01-0{1 + i % 9}") for i in range(6)]
    accounts = [(f"A{i}", f"C{rng.randrange(5)}", rng.choice(["Active", "Closed"]),
                 f"{rng.randrange(1000)}.50") for i in range(20)]
    txs = [(f"T{i}", f"A{rng.randrange(15)}", rng.choice(["Deposit", "Withdrawal", "Payment"]),
            None if i % 11 == 0 else f"{rng.randrange(5000)}.25",
            f"2026-01-{1 + rng.randrange(28):02d}") for i in range(80)]
    customer = spark.createDataFrame(customers, "customer_id string, d string").selectExpr(
        "customer_id", "'n' AS customer_name", "'e' AS email", "CAST(d AS DATE) AS dob",
        "'p' AS phone", "'Verified' AS kyc_status", "'UK' AS country",
        "CAST(d AS DATE) AS created_date", "CAST(90 AS DECIMAL(5,2)) AS dq_score",
        "TRUE AS is_valid", "1 AS load_timestamp", "1 AS updated_timestamp")
    account = spark.createDataFrame(
        accounts, "account_id string, customer_id string, account_status string, b string"
    ).selectExpr("account_id", "customer_id", "account_status", "'Savings' AS account_type",
                 "CAST(b AS DECIMAL(18,2)) AS opening_balance", "DATE '2025-01-01' AS opened_date",
                 "CAST(90 AS DECIMAL(5,2)) AS dq_score", "TRUE AS is_valid")
    transaction = spark.createDataFrame(
        txs, "transaction_id string, account_id string, transaction_type string, a string, d string"
    ).selectExpr("transaction_id", "account_id", "transaction_type",
                 "CAST(a AS DECIMAL(18,2)) AS transaction_amount", "CAST(d AS DATE) AS transaction_date",
                 "TRUE AS is_valid")
    return customer, account, transaction, accounts, txs


def test_customer_360_against_brute_force(spark):
    customer, account, transaction, accounts, txs = _gold_tables(spark)
    exact = {r["customer_id"]: r for r in gold.customer_360(
        customer, account, transaction, NOW, fan_out=False).collect()}
    fanned = {r["customer_id"]: r for r in gold.customer_360(
        customer, account, transaction, NOW).collect()}
    for cid in [f"C{i}" for i in range(6)]:
        mine = [a for a in accounts if a[1] == cid]
        repeat = {a[0]: max(1, sum(t[1] == a[0] for t in txs)) for a in mine}
        owned = [t for t in txs if t[1] in repeat]
        amounts = [float(t[3]) for t in owned if t[3]]
        for found, times in ((exact, dict.fromkeys(repeat, 1)), (fanned, repeat)):
            row = found[cid]
            assert row["total_accounts"] == len(mine)
            assert row["total_transactions"] == len(owned)
            assert row["active_accounts"] == sum(times[a[0]] for a in mine if a[2] == "Active")
            assert float(row["total_opening_balance"] or 0) == sum(
                float(a[3]) * times[a[0]] for a in mine)
            assert float(row["total_transaction_volume"] or 0) == sum(amounts)
            assert (row["avg_transaction_amount"] is None) == (not amounts)
    assert exact["C5"]["total_accounts"] == 0 and exact["C5"]["total_opening_balance"] is None
    assert exact["C0"]["age"] == 26


def test_segments_at_their_limits(spark):
    rows = spark.createDataFrame(
        [(100000, 100, 365), (99999, 99, 364), (50000, 20, 90), (49999, 19, 89), (9999, 0, 0),
         (None, None, None)], "v int, t int, d int").selectExpr(
        "'c' AS customer_id", "'n' AS customer_name", "'x' AS country", "'k' AS kyc_status",
        "1 AS total_accounts", "v AS total_transaction_volume", "t AS total_transactions",
        "d AS customer_tenure_days")
    found = [(r["customer_segment"], r["activity_level"], r["tenure_category"])
             for r in gold.customer_segmentation(rows).collect()]
    assert found == [
        ("Premium", "High Activity", "Loyal"), ("Gold", "Medium Activity", "Established"),
        ("Gold", "Medium Activity", "Established"), ("Silver", "Low Activity", "New"),
        ("Bronze", "Low Activity", "New"), ("Bronze", "Low Activity", "New")]


def test_latest_balance_and_account_summary(spark):
    customer, account, transaction, accounts, txs = _gold_tables(spark)
    balances = spark.sql("SELECT * FROM VALUES ('A1', DATE '2026-01-02', 5.00), "
                         "('A1', DATE '2026-01-03', 6.00), ('A2', DATE '2026-01-01', 7.00) "
                         "t(account_id, balance_date, closing_balance)")
    rows = {r["account_id"]: r for r in gold.account_summary(
        account, customer, transaction, balances, NOW).collect()}
    assert len(rows) == 20
    assert float(rows["A1"]["current_balance"]) == 6.0 and rows["A3"]["current_balance"] is None
    idle = [a[0] for a in accounts if a[0] not in {t[1] for t in txs}][0]
    assert (rows[idle]["total_transactions"], float(rows[idle]["total_deposits"]),
            rows[idle]["net_transaction_amount"]) == (0, 0.0, None)
    busy = {t[1] for t in txs}.intersection(rows).pop()
    deposits = [t for t in txs if t[1] == busy and t[2] == "Deposit" and t[3]]
    assert float(rows[busy]["total_deposits"] or 0) == sum(float(t[3]) for t in deposits)
