"""Pass rates, statuses, grades and reasons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classification texts and cut-offs that results depend on.
WARNING_MARGIN = 5
CRITICAL_THRESHOLD = 98
CREDITS_PER_SECOND = 0.00001
RULE_TYPES = ("COMPLETENESS", "UNIQUENESS", "VALIDITY", "CONSISTENCY", "FRESHNESS", "VOLUME")
GRADE_CUTOFFS = {
    "full": (("A", 95), ("B", 90), ("C", 80), ("D", 70)),
    "incremental": (("A", 95), ("B", 85), ("C", 75), ("D", 65)),
}
TRUST_CUTOFFS = (("HIGH", 95), ("MEDIUM", 85))
FAILURE_TYPES = {
    "COMPLETENESS": "NULL_VALUE",
    "UNIQUENESS": "DUPLICATE_VALUE",
    "VALIDITY": "INVALID_FORMAT",
    "CONSISTENCY": "FK_VIOLATION",
    "FRESHNESS": "STALE_DATA",
    "VOLUME": "LOW_VOLUME",
}
OTHER_FAILURE_TYPE = "VALIDATION_FAILURE"
REMEDIATIONS = {
    "COMPLETENESS": "Implement default values or make field optional",
    "UNIQUENESS": "Remove duplicates or update primary key logic",
    "VALIDITY": "Add validation at source or implement data cleansing",
    "CONSISTENCY": "Verify foreign key relationships and add missing parent records",
    "FRESHNESS": "Check ETL schedule and data source availability",
    "VOLUME": "Investigate data pipeline and source system",
}
OTHER_REMEDIATION = "Review and correct data quality issues"


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` of ``whole`` in percent, half-up; NULL for an empty whole."""
    ratio = F.try_divide(part.cast("decimal(20,0)") * 100, whole.cast("decimal(20,0)"))
    return F.round(ratio, digits).cast(f"decimal(10,{digits})")


def mean(c: Column) -> Column:
    """Average of a decimal column at full scale, so that one rounding follows."""
    return F.try_divide(F.sum(c), F.count(c).cast("decimal(18,0)"))


def rounded_mean(c: Column) -> Column:
    return F.round(mean(c), 2).cast("decimal(10,2)")


def pass_rate(total: Column, invalid: Column, empty_rate: int = 100) -> Column:
    """Valid share in percent; an empty scope yields ``empty_rate``."""
    return F.when(total > 0, share(total - invalid, total)).otherwise(
        F.lit(empty_rate).cast("decimal(10,2)")
    )


def check_status(rate: Column, threshold: Column) -> Column:
    return (
        F.when(rate >= threshold, "PASSED")
        .when(rate >= threshold - WARNING_MARGIN, "WARNING")
        .otherwise("FAILED")
    )


def failure_reason(status: Column, rate: Column, threshold: Column,
                   invalid: Column, total: Column, prefix: Column) -> Column:
    """Sentence explaining a FAILED or WARNING check; NULL otherwise."""
    rate_text = rate.cast("double").cast("string")
    limit_text = threshold.cast("double").cast("string")
    failed = F.concat(
        prefix, F.lit("Pass rate "), rate_text, F.lit("% below threshold "), limit_text,
        F.lit("%. Found "), invalid.cast("string"), F.lit(" invalid records out of "),
        total.cast("string"), F.lit("."),
    )
    warned = F.concat(
        prefix, F.lit("Pass rate "), rate_text, F.lit("% within warning range of threshold "),
        limit_text, F.lit("%."),
    )
    return F.when(status == "FAILED", failed).when(status == "WARNING", warned)


def _lookup(key: Column, values: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def failure_type(rule_type: Column) -> Column:
    return _lookup(rule_type, FAILURE_TYPES, OTHER_FAILURE_TYPE)


def remediation(rule_type: Column) -> Column:
    return _lookup(rule_type, REMEDIATIONS, OTHER_REMEDIATION)


def is_critical(threshold: Column) -> Column:
    return threshold >= CRITICAL_THRESHOLD


def _ladder(score: Column, cutoffs, lowest: str) -> Column:
    steps = F.when(score >= cutoffs[0][1], cutoffs[0][0])
    for label, cutoff in cutoffs[1:]:
        steps = steps.when(score >= cutoff, label)
    return steps.otherwise(lowest)


def trust_level(score: Column) -> Column:
    return _ladder(score, TRUST_CUTOFFS, "LOW")


def quality_grade(score: Column, scheme: str = "full") -> Column:
    return _ladder(score, GRADE_CUTOFFS[scheme], "F")


def trend(change: Column, tolerance: float = 0.0) -> Column:
    """Direction of a score change; no earlier score counts as stable."""
    return (
        F.when(change > tolerance, "IMPROVING")
        .when(change < -tolerance, "DEGRADING")
        .otherwise("STABLE")
    )


def credits(milliseconds: Column) -> Column:
    """Rough compute-credit estimate of a duration."""
    return F.round(milliseconds / 1000.0 * CREDITS_PER_SECOND, 6)
