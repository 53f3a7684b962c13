"""Configuration resolution over configuration tables as large as the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.plans import config
from workload.base import ctes, query
from workload.staging import AS_OF, derived, source

TODAY = "DATE '2024-01-30'"


def _tables(spark, sf_dir):
    return {n: derived(spark, sf_dir, f"cfg_{n}")
            for n in ("datasets", "rules", "mappings", "weights")}


_RANK = ("CASE criticality WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 "
         "ELSE 4 END")


@query("resolve_datasets", ctes(["cfg_datasets"], f"""
SELECT dataset_id, source_table, business_domain, criticality, incremental_column,
       CAST({_RANK} AS BIGINT) AS criticality_rank FROM cfg_datasets WHERE is_active"""))
def resolve_datasets(spark, sf_dir):
    return config.resolve_datasets(derived(spark, sf_dir, "cfg_datasets")).select(
        "dataset_id", "source_table", "business_domain", "criticality", "incremental_column",
        "criticality_rank")


@query("resolve_datasets_critical", ctes(["cfg_datasets"], """
SELECT dataset_id, source_table FROM cfg_datasets
WHERE is_active AND criticality = 'CRITICAL'"""))
def resolve_datasets_critical(spark, sf_dir):
    return config.resolve_datasets(derived(spark, sf_dir, "cfg_datasets"), mode="CRITICAL_ONLY"
                                   ).select("dataset_id", "source_table")


_RESOLVED = f"""resolved AS (
  SELECT m.config_id, m.dataset_id, m.column_name, m.threshold_value, r.rule_id, r.rule_name,
         r.rule_type, r.rule_level, d.business_domain,
         coalesce(CAST(w.weight AS DOUBLE), 1.0) AS weight,
         CAST(coalesce(w.priority, 3) AS BIGINT) AS priority
  FROM cfg_mappings m JOIN cfg_rules r ON m.rule_id = r.rule_id AND r.has_check
       JOIN cfg_datasets d ON d.dataset_id = m.dataset_id AND d.is_active
       LEFT JOIN cfg_weights w ON w.rule_type = r.rule_type
         AND w.business_domain = d.business_domain AND w.is_active
         AND {TODAY} BETWEEN w.effective_date AND coalesce(w.expiry_date, DATE '9999-12-31')
  WHERE m.is_active AND r.is_active)"""
_CFG = ["cfg_mappings", "cfg_rules", "cfg_datasets", "cfg_weights"]


def _resolved(spark, sf_dir, rule_type=None):
    t = _tables(spark, sf_dir)
    return config.resolve_rules(t["mappings"], t["rules"], t["datasets"], t["weights"], AS_OF,
                                rule_type)


_TYPE_RANK = """CAST(CASE rule_type WHEN 'COMPLETENESS' THEN 1 WHEN 'UNIQUENESS' THEN 2
  WHEN 'VALIDITY' THEN 3 WHEN 'CONSISTENCY' THEN 4 WHEN 'FRESHNESS' THEN 5 ELSE 6 END AS BIGINT)"""


@query("resolve_rules", ctes(_CFG, f"""
SELECT config_id, dataset_id, column_name, CAST(threshold_value AS DOUBLE) AS threshold_value,
       rule_id, rule_name, rule_type, rule_level, business_domain, weight, priority,
       {_TYPE_RANK} AS type_rank FROM resolved""", _RESOLVED))
def resolve_rules(spark, sf_dir):
    return config.in_execution_order(_resolved(spark, sf_dir)).drop("description")


@query("resolve_rules_of_type", ctes(_CFG, """
SELECT config_id, rule_id, weight, priority FROM resolved WHERE rule_type = 'VALIDITY'""",
                                     _RESOLVED))
def resolve_rules_of_type(spark, sf_dir):
    return _resolved(spark, sf_dir, "VALIDITY").select("config_id", "rule_id", "weight", "priority")


@query("resolve_rule_direct", ctes(["cfg_rules", "cfg_weights"], f"""
SELECT rule_id, rule_type, business_domain, coalesce(CAST(weight AS DOUBLE), 1.0) AS weight,
       CAST(coalesce(priority, 3) AS BIGINT) AS priority
FROM (SELECT *, 'ASIA' AS business_domain FROM cfg_rules
      WHERE rule_name = 'small widget' AND is_active AND has_check
      ORDER BY rule_id DESC LIMIT 1) r
LEFT JOIN (SELECT rule_type AS t, business_domain AS b, weight, priority FROM cfg_weights
           WHERE is_active AND {TODAY} BETWEEN effective_date
             AND coalesce(expiry_date, DATE '9999-12-31')) w
  ON t = rule_type AND b = business_domain"""))
def resolve_rule_direct(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return config.resolve_rule_direct(t["rules"], t["weights"], "small widget", "ASIA", AS_OF
                                      ).select("rule_id", "rule_type", "business_domain",
                                               "weight", "priority")


@query("resolve_single_mapping", ctes(_CFG, """
SELECT config_id, dataset_id, rule_id FROM resolved
WHERE dataset_id = 'DS_7' AND rule_name = 'small widget' AND column_name IS NULL
ORDER BY config_id DESC LIMIT 1""", _RESOLVED))
def resolve_single_mapping(spark, sf_dir):
    return config.resolve_single_mapping(_resolved(spark, sf_dir), "DS_7", "small widget", None
                                         ).select("config_id", "dataset_id", "rule_id")


@query("latest_rule_ids", ctes(["cfg_rules"], """
SELECT rule_name, max(rule_id) AS rule_id FROM cfg_rules WHERE is_active GROUP BY rule_name"""))
def latest_rule_ids(spark, sf_dir):
    return config.latest_rule_ids(derived(spark, sf_dir, "cfg_rules"))


@query("map_rules_by_name", ctes(["cfg_rules"], """
SELECT o_orderkey AS request_id, rule_name, max(rule_id) AS rule_id
FROM orders JOIN cfg_rules ON rule_name = CASE WHEN o_orderstatus = 'F' THEN 'small widget'
  WHEN o_orderstatus = 'O' THEN 'blue anvil' ELSE 'no such rule' END AND is_active
GROUP BY o_orderkey, rule_name"""))
def map_rules_by_name(spark, sf_dir):
    status = F.col("o_orderstatus")
    named = source(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(status == "F", "small widget").when(status == "O", "blue anvil")
        .otherwise("no such rule").alias("rule_name"))
    return config.map_by_name(named, derived(spark, sf_dir, "cfg_rules"))


@query("rules_by_json_selection", ctes(["cfg_mappings"], """
SELECT config_id, rule_id, dataset_id FROM cfg_mappings
WHERE is_active AND rule_id IN (SELECT user_id FROM events
                                UNION SELECT event_id FROM events WHERE event_type = 'view')"""))
def rules_by_json_selection(spark, sf_dir):
    """Mappings whose rule ids occur in JSON selections, one document per event."""
    first = F.concat(F.lit('{"customRules":['), F.col("user_id").cast("string"))
    more = F.when(F.col("event_type") == "view",
                  F.concat(F.lit(","), F.col("event_id").cast("string"))).otherwise("")
    documents = source(spark, sf_dir, "events").select(
        F.concat(first, more, F.lit("]}")).alias("custom_config"))
    return config.rules_selected_by(derived(spark, sf_dir, "cfg_mappings"), documents,
                                    "custom_config").select("config_id", "rule_id", "dataset_id")


@query("dataset_lookup", ctes(["cfg_datasets"], """
SELECT event_id, requested_table, dataset_id, is_active,
       CASE WHEN dataset_id IS NULL THEN 'Dataset not found for ' || requested_table
            WHEN NOT is_active THEN 'Dataset ' || requested_table || ' is inactive' END AS problem
FROM (SELECT event_id, 'SUPPLIER#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS requested_table
      FROM events) e LEFT JOIN cfg_datasets ON source_table = requested_table"""))
def dataset_lookup(spark, sf_dir):
    """Requests by table name, with the reason why some cannot run."""
    requests = source(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("Supplier#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
        .alias("wanted"))
    return config.find_datasets(requests, derived(spark, sf_dir, "cfg_datasets"), "wanted"
                                ).drop("wanted")


@query("config_coverage", ctes(["cfg_datasets", "cfg_mappings", "cfg_rules"], """
SELECT d.dataset_id, d.source_table, d.business_domain, d.criticality,
       CAST(count(DISTINCT m.rule_id) AS BIGINT) AS total_rules,
       CAST(count(DISTINCT r.rule_type) AS BIGINT) AS rule_types,
       CAST(count(DISTINCT m.column_name) AS BIGINT) AS columns_monitored
FROM cfg_datasets d JOIN cfg_mappings m ON d.dataset_id = m.dataset_id
     JOIN cfg_rules r ON m.rule_id = r.rule_id
WHERE d.is_active GROUP BY ALL"""))
def config_coverage(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return config.coverage(t["datasets"], t["mappings"], t["rules"])


@query("rules_by_type", ctes(["cfg_rules"], """
SELECT rule_type, CAST(count(*) AS BIGINT) AS rule_count,
       CAST(sum(CASE WHEN is_active THEN 1 ELSE 0 END) AS BIGINT) AS active_rules
FROM cfg_rules GROUP BY rule_type"""))
def rules_by_type(spark, sf_dir):
    return config.rules_by_type(derived(spark, sf_dir, "cfg_rules"))


@query("config_row_counts", ctes(_CFG, """
SELECT 'CONFIGURATION SUMMARY' AS section, NULL AS metric, NULL AS row_count
UNION ALL SELECT NULL, 'Datasets Registered', CAST(count(*) AS BIGINT) FROM cfg_datasets
UNION ALL SELECT NULL, 'Rules Defined', CAST(count(*) AS BIGINT) FROM cfg_rules
UNION ALL SELECT NULL, 'Rule Mappings', CAST(count(*) AS BIGINT) FROM cfg_mappings
UNION ALL SELECT NULL, 'Weight Configurations', CAST(count(*) AS BIGINT) FROM cfg_weights"""))
def config_row_counts(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return config.row_counts("CONFIGURATION SUMMARY", {
        "Datasets Registered": t["datasets"], "Rules Defined": t["rules"],
        "Rule Mappings": t["mappings"], "Weight Configurations": t["weights"]})


@query("allowed_value_lists", """
SELECT c_custkey, c_mktsegment || ', ' || c_custkey AS first_value, c_name AS second_value,
       CAST(2 AS BIGINT) AS list_size FROM customer""")
def allowed_value_lists(spark, sf_dir):
    """Quoted comma lists, one value with a comma of its own, parsed to their values."""
    text = F.concat(F.lit("'"), F.col("c_mktsegment"), F.lit(", "), F.col("c_custkey"), F.lit("', '"), F.col("c_name"), F.lit("'"))
    parsed = config.parse_allowed(text)
    return source(spark, sf_dir, "customer").select(
        "c_custkey", parsed[0].alias("first_value"), parsed[1].alias("second_value"),
        F.size(parsed).alias("list_size"))


@query("freeze_datasets", ctes(["cfg_datasets"], f"""
SELECT dataset_id, FALSE AS is_active, 'operator' AS modified_by, '{AS_OF}' AS modified_ts
FROM cfg_datasets"""))
def freeze_datasets(spark, sf_dir):
    frozen = config.stamp_update(derived(spark, sf_dir, "cfg_datasets"), "operator", AS_OF,
                                 is_active=False)
    return frozen.select("dataset_id", "is_active", "modified_by", "modified_ts")


@query("schema_evolution", ctes(["history"], """
SELECT CASE WHEN scan_scope = 'FULL' THEN NULL ELSE scan_scope END AS scan_scope,
       CAST(count(*) AS BIGINT) AS row_count,
       CAST(sum(total_records) AS BIGINT) AS total_records FROM history GROUP BY 1"""))
def schema_evolution(spark, sf_dir):
    """Results written before a column existed, read together with later ones."""
    history = derived(spark, sf_dir, "history")
    older = history.where("scan_scope = 'FULL'").drop("scan_scope", "execution_credits")
    newer = history.where("scan_scope = 'INCREMENTAL'")
    return config.with_columns_of(older, newer).groupBy("scan_scope").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("total_records").alias("total_records"))
