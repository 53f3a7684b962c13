"""Shipped configuration and its resolution."""

from __future__ import annotations

from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assayer import schemas
from assayer.plans import config, seeds
from assayer.sources.tables import literal_rows

NOW = "2026-02-10 14:00:00"


def test_shipped_counts(spark):
    assert seeds.rules(spark).count() == 20
    assert seeds.rules(spark).where("has_check").count() == 15
    per = Counter(r["dataset_id"] for r in seeds.mappings(spark).collect())
    assert per == {"DS_BRONZE_CUSTOMER": 18, "DS_BRONZE_ACCOUNT": 15, "DS_BRONZE_TRANSACTION": 14,
                   "DS_BRONZE_DAILY_BALANCE": 8, "DS_BRONZE_FX_RATE": 9}
    assert seeds.mappings(spark, ("SILVER",)).count() == 55
    assert seeds.datasets(spark).count() == 5
    assert seeds.datasets(spark, ("BRONZE", "SILVER")).count() == 10
    assert seeds.weights(spark).count() == 30
    assert seeds.allowed_values(spark).count() == 8
    assert seeds.lineage(spark).count() == 8


def _resolved(spark, **kw):
    return config.resolve_rules(seeds.mappings(spark), seeds.rules(spark), seeds.datasets(spark),
                                kw.pop("weights", seeds.weights(spark)), NOW, **kw)


def test_dataset_order_and_filters(spark):
    rows = config.resolve_datasets(seeds.datasets(spark)).collect()
    assert [r["criticality"] for r in rows] == ["CRITICAL", "CRITICAL", "HIGH", "HIGH", "MEDIUM"]
    assert config.resolve_datasets(seeds.datasets(spark), mode="CRITICAL_ONLY").count() == 2
    assert config.resolve_datasets(seeds.datasets(spark), "DS_BRONZE_FX_RATE").count() == 1
    frozen = config.stamp_update(seeds.datasets(spark), "me", NOW, is_active=False)
    assert config.resolve_datasets(frozen).count() == 0
    assert {r["modified_by"] for r in frozen.collect()} == {"me"}


def test_rules_come_in_priority_order(spark):
    specs = config.bind_rules(_resolved(spark).where("dataset_id = 'DS_BRONZE_TRANSACTION'"),
                              seeds.allowed_values(spark))
    assert len(specs) == 14
    assert [s.priority for s in specs] == sorted(s.priority for s in specs)
    assert specs[0].rule_type == "COMPLETENESS" and specs[-1].rule_type == "VOLUME"
    allowed = [s for s in specs if s.rule_name == "VALIDITY_ALLOWED_VALUES"]
    assert allowed[0].params["allowed"] == ["Deposit", "Withdrawal", "Transfer", "Payment"]
    assert {s.weight for s in specs if s.rule_type == "COMPLETENESS"} == {3.0}


def test_weights_outside_their_interval_fall_back(spark):
    rows = [("COMPLETENESS", "MARKET_DATA", Decimal("9"), 1, date(2026, 2, 11), None, True),
            ("VALIDITY", "MARKET_DATA", Decimal("8"), 1, date(2020, 1, 1), date(2026, 2, 9), True),
            ("VOLUME", "MARKET_DATA", Decimal("7"), 1, date(2026, 2, 10), date(2026, 2, 10), True),
            ("FRESHNESS", "MARKET_DATA", Decimal("6"), 1, date(2020, 1, 1), None, False)]
    weights = literal_rows(spark, rows, schemas.WEIGHTS)
    found = {(r["rule_type"], r["weight"], r["priority"])
             for r in _resolved(spark, weights=weights)
             .where("dataset_id = 'DS_BRONZE_FX_RATE'").collect()}
    assert found == {("COMPLETENESS", 1.0, 3), ("VALIDITY", 1.0, 3), ("VOLUME", 7.0, 1),
                     ("FRESHNESS", 1.0, 3)}


def test_rules_without_definition_or_inactive_are_left_out(spark):
    rules = seeds.rules(spark).withColumn("is_active", F.col("rule_name") != "COMPLETENESS_CHECK")
    resolved = config.resolve_rules(seeds.mappings(spark), rules, seeds.datasets(spark),
                                    seeds.weights(spark), NOW)
    assert resolved.where("rule_name = 'COMPLETENESS_CHECK'").count() == 0
    # Completeness checks: 8 customer, 6 account, 5 transaction, 3 balance, 3 rate columns.
    assert resolved.count() == 64 - 25


@pytest.mark.parametrize("text, ids", [
    ('{"customRules": [3, "5"]}', [3, 5]), ("NULL", []), (None, []), ("", []),
    ('{"other": 1}', []), ('{"customRules": "3"}', [])])
def test_selected_rule_ids(text, ids):
    assert config.selected_rule_ids(text) == ids


def test_single_mapping_is_null_safe(spark):
    resolved = _resolved(spark)
    table = config.resolve_single_mapping(resolved, "DS_BRONZE_CUSTOMER",
                                          "VOLUME_ROW_COUNT_THRESHOLD", None)
    assert table.count() == 1
    column = config.resolve_single_mapping(resolved, "DS_BRONZE_CUSTOMER", "COMPLETENESS_CHECK",
                                           "email").first()
    assert float(column["threshold_value"]) == 90.0
    assert config.resolve_single_mapping(resolved, "DS_BRONZE_CUSTOMER", "COMPLETENESS_CHECK",
                                         None).count() == 0


def test_allowed_lists_parse(spark):
    row = spark.createDataFrame([("'A', 'B c','D'",)], "t string").select(
        config.parse_allowed(F.col("t")).alias("v")).first()
    assert row["v"] == ["A", "B c", "D"]


def test_coverage_and_counts(spark):
    rows = {r["dataset_id"]: r for r in config.coverage(
        seeds.datasets(spark), seeds.mappings(spark), seeds.rules(spark)).collect()}
    customer = rows["DS_BRONZE_CUSTOMER"]
    assert (customer["total_rules"], customer["rule_types"], customer["columns_monitored"]) == (
        10, 5, 8)
    types = {r["rule_type"]: (r["rule_count"], r["active_rules"])
             for r in config.rules_by_type(seeds.rules(spark)).collect()}
    assert types["VALIDITY"] == (10, 10) and types["VOLUME"] == (2, 2)


def test_dataset_lookup_explains_failures(spark):
    datasets = seeds.datasets(spark).withColumn(
        "is_active", F.col("source_table") != "STG_FX_RATE")
    requests = spark.createDataFrame([("stg_customer",), ("Stg_Fx_Rate",), ("nope",)], "t string")
    found = {r["t"]: r["problem"] for r in
             config.find_datasets(requests, datasets, "t").collect()}
    assert found == {"stg_customer": None, "Stg_Fx_Rate": "Dataset STG_FX_RATE is inactive",
                     "nope": "Dataset not found for NOPE"}


def test_newest_rule_wins_by_name(spark):
    rows = [(1, "R", "VALIDITY", "COLUMN", "", True, True),
            (9, "R", "VALIDITY", "COLUMN", "", True, True),
            (12, "R", "VALIDITY", "COLUMN", "", False, True)]
    rules = literal_rows(spark, rows, schemas.RULES)
    assert config.latest_rule_ids(rules).first()["rule_id"] == 9
    direct = config.resolve_rule_direct(rules, seeds.weights(spark), "R", "MARKET_DATA", NOW)
    assert (direct.first()["rule_id"], direct.first()["weight"]) == (9, 3.0)
