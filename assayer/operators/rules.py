"""The rule catalogue: what each rule counts, as Spark columns.

A rule is one of a few kinds.  ``row`` rules are a boolean error predicate, so
any number of them share one scan and one aggregate.  The others need a grouping,
a join or a table-wide measure, which :mod:`assayer.operators.evaluate` supplies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions import predicates as p
from assayer.functions.clock import AsOf

ROW = "row"
DISTINCT = "distinct"
FOREIGN_KEY = "foreign_key"
VOLUME = "volume"
LOAD_AGE = "load_age"
VOLUME_TREND = "volume_trend"


@dataclass(frozen=True)
class RuleSpec:
    """One configured check: a rule bound to a dataset, a column and a threshold."""

    rule_name: str
    rule_type: str
    column: str | None = None
    threshold: float = 90.0
    dataset_id: str = ""
    rule_id: int | None = None
    rule_level: str = "COLUMN"
    weight: float = 1.0
    priority: int = 3
    params: dict[str, Any] = field(default_factory=dict, compare=False)

    @property
    def check_key(self) -> str:
        """Identifies the check inside one run."""
        return f"{self.dataset_id}|{self.rule_name}|{self.column or '*'}"

    def columns(self) -> list[str]:
        """Names the check reads."""
        named = [self.column] if self.column else []
        return named + list(self.params.get("columns", ()))

    def bind(self, **params: Any) -> RuleSpec:
        return replace(self, params={**self.params, **params})


@dataclass(frozen=True)
class RuleKind:
    kind: str
    rule_type: str
    level: str
    error: Callable[[RuleSpec, AsOf], Column] | None = None


def _max_age(rule: RuleSpec) -> int:
    """Age limit in days; without one the pass threshold doubles as the limit."""
    return int(rule.params.get("max_age_days", rule.threshold))


def _col(rule: RuleSpec) -> Column:
    return F.col(rule.column)


def _formats(rule: RuleSpec):
    return rule.params.get("date_formats", ())


def _scale(rule: RuleSpec) -> int:
    return rule.params.get("scale", 0)


CATALOGUE: dict[str, RuleKind] = {
    "COMPLETENESS_CHECK": RuleKind(
        ROW, "COMPLETENESS", "COLUMN", lambda r, t: p.missing(_col(r))),
    "COMPLETENESS_CRITICAL_COLUMNS": RuleKind(
        ROW, "COMPLETENESS", "TABLE",
        lambda r, t: p.any_missing([F.col(c) for c in r.params["columns"]])),
    "UNIQUENESS_PRIMARY_KEY": RuleKind(DISTINCT, "UNIQUENESS", "COLUMN"),
    "UNIQUENESS_COMPOSITE_KEY": RuleKind(DISTINCT, "UNIQUENESS", "TABLE"),
    "VALIDITY_EMAIL_FORMAT": RuleKind(
        ROW, "VALIDITY", "COLUMN", lambda r, t: p.not_email(_col(r))),
    "VALIDITY_PHONE_FORMAT": RuleKind(
        ROW, "VALIDITY", "COLUMN", lambda r, t: p.not_phone(_col(r))),
    "VALIDITY_DATE_FORMAT": RuleKind(
        ROW, "VALIDITY", "COLUMN", lambda r, t: p.not_date(_col(r), _formats(r))),
    "VALIDITY_NUMERIC_FORMAT": RuleKind(
        ROW, "VALIDITY", "COLUMN", lambda r, t: p.not_number(_col(r), _scale(r))),
    "VALIDITY_POSITIVE_NUMBER": RuleKind(
        ROW, "VALIDITY", "COLUMN", lambda r, t: p.not_positive(_col(r), _scale(r))),
    "VALIDITY_NON_NEGATIVE_NUMBER": RuleKind(
        ROW, "VALIDITY", "COLUMN", lambda r, t: p.negative(_col(r), _scale(r))),
    "VALIDITY_ALLOWED_VALUES": RuleKind(
        ROW, "VALIDITY", "COLUMN", lambda r, t: p.not_in(_col(r), r.params.get("allowed", ()))),
    "VALIDITY_DATE_RANGE": RuleKind(
        ROW, "VALIDITY", "COLUMN", lambda r, t: p.outside_date_range(_col(r), t, _formats(r))),
    "VALIDITY_COUNTRY_CODE": RuleKind(
        ROW, "VALIDITY", "COLUMN", lambda r, t: p.not_in(_col(r), p.COUNTRIES)),
    "VALIDITY_CURRENCY_CODE": RuleKind(
        ROW, "VALIDITY", "COLUMN",
        lambda r, t: p.not_in(_col(r), r.params.get("allowed", p.CURRENCIES))),
    "FRESHNESS_DATA_RECENCY": RuleKind(
        ROW, "FRESHNESS", "COLUMN",
        lambda r, t: p.older_than(_col(r), t, _max_age(r), _formats(r))),
    "FRESHNESS_LOAD_TIMESTAMP": RuleKind(LOAD_AGE, "FRESHNESS", "TABLE"),
    "CONSISTENCY_FOREIGN_KEY": RuleKind(FOREIGN_KEY, "CONSISTENCY", "COLUMN"),
    "CONSISTENCY_LOGICAL_RELATIONSHIP": RuleKind(
        ROW, "CONSISTENCY", "TABLE", lambda r, t: ~F.expr(r.params["holds"])),
    "VOLUME_ROW_COUNT_THRESHOLD": RuleKind(VOLUME, "VOLUME", "TABLE"),
    "VOLUME_ANOMALY_DETECTION": RuleKind(VOLUME_TREND, "VOLUME", "TABLE"),
}


#: Settings without which a rule has nothing to check.
REQUIRED = {
    "COMPLETENESS_CRITICAL_COLUMNS": "columns",
    "UNIQUENESS_COMPOSITE_KEY": "columns",
    "CONSISTENCY_LOGICAL_RELATIONSHIP": "holds",
}


def expected(spec: RuleSpec) -> str | None:
    """What a valid value looks like, for the records of failing rows."""
    def one_of(values) -> str:
        return "one of " + ", ".join(values)

    texts: dict[str, Callable[[], str]] = {
        "COMPLETENESS_CHECK": lambda: "NOT NULL",
        "COMPLETENESS_CRITICAL_COLUMNS": lambda: "NOT NULL",
        "UNIQUENESS_PRIMARY_KEY": lambda: "UNIQUE",
        "UNIQUENESS_COMPOSITE_KEY": lambda: "UNIQUE",
        "VALIDITY_EMAIL_FORMAT": lambda: p.EMAIL_PATTERN,
        "VALIDITY_PHONE_FORMAT": lambda: p.PHONE_PATTERN,
        "VALIDITY_DATE_FORMAT": lambda: "a date",
        "VALIDITY_NUMERIC_FORMAT": lambda: "a number",
        "VALIDITY_POSITIVE_NUMBER": lambda: "a number > 0",
        "VALIDITY_NON_NEGATIVE_NUMBER": lambda: "a number >= 0",
        "VALIDITY_ALLOWED_VALUES": lambda: one_of(spec.params.get("allowed", ())),
        "VALIDITY_DATE_RANGE": lambda: f"a date from {p.EARLIEST_DATE} to today",
        "VALIDITY_COUNTRY_CODE": lambda: one_of(p.COUNTRIES),
        "VALIDITY_CURRENCY_CODE": lambda: one_of(spec.params.get("allowed", p.CURRENCIES)),
        "FRESHNESS_DATA_RECENCY": lambda: f"at most {_max_age(spec)} days old",
        "CONSISTENCY_FOREIGN_KEY": lambda: "an existing parent key",
        "CONSISTENCY_LOGICAL_RELATIONSHIP": lambda: spec.params.get("holds"),
    }
    return texts[spec.rule_name]() if spec.rule_name in texts else None


def rule(name: str, column: str | None = None, threshold: float = 90.0,
         dataset_id: str = "", **params: Any) -> RuleSpec:
    """A catalogue rule bound by hand, for ad-hoc checks and tests."""
    known = CATALOGUE[name]
    return RuleSpec(name, known.rule_type, column, threshold, dataset_id,
                    rule_level=known.level, params=params)


def kind_of(spec: RuleSpec) -> str | None:
    """Kind of a rule, or None when the catalogue has no definition for it."""
    known = CATALOGUE.get(spec.rule_name)
    return known.kind if known else None


def row_error(spec: RuleSpec, as_of: AsOf) -> Column:
    """True for rows that break a ``row`` rule; NULL or false for the others."""
    return CATALOGUE[spec.rule_name].error(spec, as_of)
