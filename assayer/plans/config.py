"""Configuration resolution as joins over the rule, dataset and weight tables.

These functions take and return DataFrames and never broadcast by hand: Spark
broadcasts a side whose measured size is small and shuffles it otherwise.  Only
:func:`bind_rules` brings rows to the driver, one per configured check.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.clock import AsOf, day, instant
from assayer.functions.scoring import RULE_TYPES
from assayer.operators.rules import RuleSpec

# Execution order of datasets and rules, and defaults.
CRITICALITY_RANK = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3}
DEFAULT_WEIGHT, DEFAULT_PRIORITY = 1.0, 3
NO_EXPIRY = "9999-12-31"


def _rank(c: Column, order: dict[str, int], last: int) -> Column:
    ranked = F.lit(last)
    for label, position in order.items():
        ranked = F.when(c == label, position).otherwise(ranked)
    return ranked


def resolve_datasets(datasets: DataFrame, dataset_id: str | None = None,
                     mode: str = "FULL") -> DataFrame:
    """Active datasets in execution order, optionally one or only critical ones."""
    chosen = datasets.where("is_active")
    if dataset_id:
        chosen = chosen.where(F.col("dataset_id") == dataset_id)
    if mode == "CRITICAL_ONLY":
        chosen = chosen.where("criticality = 'CRITICAL'")
    rank = _rank(F.col("criticality"), CRITICALITY_RANK, len(CRITICALITY_RANK) + 1)
    return chosen.withColumn("criticality_rank", rank).orderBy("criticality_rank", "dataset_id")


def current_weights(weights: DataFrame, as_of: AsOf) -> DataFrame:
    """Weights whose validity interval contains ``as_of``."""
    until = F.coalesce("expiry_date", F.lit(NO_EXPIRY).cast("date"))
    return weights.where(F.col("is_active") & day(as_of).between(F.col("effective_date"), until))


def _weighted(rules: DataFrame, weights: DataFrame, as_of: AsOf) -> DataFrame:
    """Attach weight and priority by rule type and business domain."""
    current = current_weights(weights, as_of).select(
        "rule_type", "business_domain", F.col("weight").alias("w"), F.col("priority").alias("p"))
    return (
        rules.join(current, ["rule_type", "business_domain"], "left")
        .withColumn("weight", F.coalesce(F.col("w").cast("double"), F.lit(DEFAULT_WEIGHT)))
        .withColumn("priority", F.coalesce("p", F.lit(DEFAULT_PRIORITY)).cast("bigint"))
        .drop("w", "p")
    )


def usable_rules(rules: DataFrame) -> DataFrame:
    """Active rules that have a check definition."""
    return rules.where(F.col("is_active") & F.col("has_check")).drop("is_active", "has_check")


def resolve_rules(mappings: DataFrame, rules: DataFrame, datasets: DataFrame, weights: DataFrame,
                  as_of: AsOf, rule_type: str | None = None) -> DataFrame:
    """Checks to run: active mappings of active datasets with rule, weight and priority."""
    usable = usable_rules(rules)
    if rule_type:
        usable = usable.where(F.col("rule_type") == rule_type)
    targets = datasets.where("is_active").select("dataset_id", "business_domain")
    bound = (
        mappings.where("is_active").drop("is_active")
        .join(usable, "rule_id").join(targets, "dataset_id")
    )
    type_rank = _rank(F.col("rule_type"), {t: i for i, t in enumerate(RULE_TYPES, 1)},
                      len(RULE_TYPES) + 1)
    return _weighted(bound, weights, as_of).withColumn("type_rank", type_rank)


def in_execution_order(resolved: DataFrame) -> DataFrame:
    return resolved.orderBy("dataset_id", "priority", "type_rank",
                            F.col("column_name").asc_nulls_last(), "config_id")


def resolve_rule_direct(rules: DataFrame, weights: DataFrame, rule_name: str, domain: str | None,
                        as_of: AsOf) -> DataFrame:
    """One rule without a dataset mapping: its newest active definition."""
    named = usable_rules(rules).where(F.col("rule_name") == rule_name)
    newest = named.orderBy(F.desc("rule_id")).limit(1)
    return _weighted(newest.withColumn("business_domain", F.lit(domain)), weights, as_of)


def resolve_single_mapping(resolved: DataFrame, dataset_id: str, rule_name: str,
                           column: str | None) -> DataFrame:
    """The mapping of one (dataset, rule, column); column None means table level."""
    return resolved.where(
        (F.col("dataset_id") == dataset_id) & (F.col("rule_name") == rule_name)
        & F.col("column_name").eqNullSafe(F.lit(column).cast("string"))
    ).orderBy(F.desc("config_id")).limit(1)


def latest_rule_ids(rules: DataFrame) -> DataFrame:
    """Newest active rule id per rule name."""
    return rules.where("is_active").groupBy("rule_name").agg(F.max("rule_id").alias("rule_id"))


def map_by_name(named: DataFrame, rules: DataFrame) -> DataFrame:
    """Turn (dataset, rule name, column, threshold) rows into mappings with rule ids."""
    return named.join(latest_rule_ids(rules), "rule_name")


def selected_rule_ids(custom_config: str | None) -> list[int]:
    """Rule ids named by a ``{"customRules": [...]}`` document; empty means all."""
    if not custom_config or custom_config == "NULL":
        return []
    chosen = json.loads(custom_config).get("customRules")
    return [int(i) for i in chosen] if isinstance(chosen, list) else []


def rules_selected_by(mappings: DataFrame, configs: DataFrame, config_column: str) -> DataFrame:
    """Active mappings whose rule id occurs in any JSON selection of ``configs``."""
    listed = configs.select(
        F.explode(F.from_json(config_column, "customRules array<bigint>")["customRules"])
        .alias("rule_id")).distinct()
    return mappings.where("is_active").join(listed, "rule_id", "left_semi")


def find_datasets(requests: DataFrame, datasets: DataFrame, table_column: str) -> DataFrame:
    """Look up datasets by table name (upper case) and say why a request cannot run."""
    by_table = datasets.select(
        F.col("source_table").alias("requested_table"), "dataset_id", "is_active")
    wanted = requests.withColumn("requested_table", F.upper(table_column))
    problem = (
        F.when(F.col("dataset_id").isNull(), F.concat(F.lit("Dataset not found for "),
                                                      F.col("requested_table")))
        .when(~F.col("is_active"), F.concat(F.lit("Dataset "), F.col("requested_table"),
                                            F.lit(" is inactive")))
    )
    return wanted.join(by_table, "requested_table", "left").withColumn("problem", problem)


def parse_allowed(c: Column) -> Column:
    """A comma list of quoted or bare values as an array.

    A comma inside quotes belongs to its value; a doubled quote inside quotes is one quote.
    """
    parts = F.regexp_extract_all(c, F.lit(r"\s*('(?:[^']|'')*'|[^,]*)\s*(?:,|$)"), F.lit(1))
    # The pattern also matches the empty end of the text, unless the text ends in a comma.
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda part: F.replace(F.regexp_replace(F.trim(part), "^'([\\s\\S]*)'$", "$1"), F.lit("''"), F.lit("'")))


def coverage(datasets: DataFrame, mappings: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct rules, rule types and columns configured per active dataset.

    Distinct mappings come first; a dataset's sets hold no more than the rules and columns
    that exist, and collapse in the map tasks.
    """
    pairs = mappings.select("dataset_id", "rule_id", "column_name").distinct()
    named = pairs.join(rules.select("rule_id", "rule_type"), "rule_id")
    counted = named.groupBy("dataset_id").agg(*[
        F.size(F.collect_set(c)).cast("bigint").alias(name) for c, name in
        (("rule_id", "total_rules"), ("rule_type", "rule_types"), ("column_name", "columns_monitored"))])
    active = datasets.where("is_active").select(
        "dataset_id", "source_table", "business_domain", "criticality")
    return active.join(counted, "dataset_id").orderBy("dataset_id")


def rules_by_type(rules: DataFrame) -> DataFrame:
    return rules.groupBy("rule_type").agg(
        F.count(F.lit(1)).alias("rule_count"), F.count_if("is_active").alias("active_rules"),
    ).orderBy("rule_type")


def row_counts(section: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A heading line followed by one count per table, padded with NULLs."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("metric"),
                                                                 "row_count")
              for name, df in tables.items()]
    lines = reduce(DataFrame.unionByName, counts)
    heading = lines.groupBy().agg(F.lit(section).alias("section"))
    return heading.unionByName(lines, allowMissingColumns=True)


def stamp_update(config: DataFrame, by: str, as_of: AsOf, **changes) -> DataFrame:
    """Set columns on every configuration row and record who changed it and when."""
    values = {c: F.lit(v) for c, v in changes.items()}
    return config.withColumns(
        {**values, "modified_by": F.lit(by), "modified_ts": instant(as_of)})


def with_columns_of(config: DataFrame, *newer: DataFrame) -> DataFrame:
    """Union of frames from different schema versions; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), newer, config)


def bind_rules(resolved: DataFrame, allowed: DataFrame | None = None,
               params: Callable[[dict], dict] | None = None) -> list[RuleSpec]:
    """Collect resolved checks (configuration rows only) as rule specs.

    Allowed values come from their table, keyed by dataset and column; ``params``
    may add further settings per check.
    """
    lists: dict[tuple[str, str], Sequence[str]] = {}
    if allowed is not None:
        parsed = allowed.where("is_active").select(
            "dataset_id", F.lower("column_name").alias("c"),
            parse_allowed(F.col("allowed_values")).alias("v"))
        lists = {(row["dataset_id"], row["c"]): row["v"] for row in parsed.collect()}
    specs = []
    for row in in_execution_order(resolved).collect():
        settings = dict(params(row.asDict())) if params else {}
        values = lists.get((row["dataset_id"], (row["column_name"] or "").lower()))
        if row["rule_name"] == "VALIDITY_ALLOWED_VALUES" and values is not None:
            settings.setdefault("allowed", list(values))
        specs.append(RuleSpec(
            rule_name=row["rule_name"], rule_type=row["rule_type"], column=row["column_name"],
            threshold=float(row["threshold_value"]), dataset_id=row["dataset_id"],
            rule_id=row["rule_id"], rule_level=row["rule_level"], weight=float(row["weight"]),
            priority=int(row["priority"]), params=settings))
    return specs
