"""Assayer: data-quality checks, cleansing and analytics as Spark DataFrame plans."""

from assayer.operators.evaluate import evaluate
from assayer.operators.keys import KeyMap
from assayer.operators.profile import profile_checks, profile_columns
from assayer.operators.rules import RuleSpec, rule
from assayer.plans.runs import (
    Configuration, execute, execute_profile, run_checks, run_planned, run_rule, run_scan,
)
from assayer.plans.silver import SilverTable, load_silver
from assayer.sources.tables import Registry

__all__ = [
    "Configuration", "KeyMap", "Registry", "RuleSpec", "SilverTable", "evaluate", "execute",
    "execute_profile", "load_silver", "profile_checks", "profile_columns", "rule", "run_checks",
    "run_planned", "run_rule", "run_scan",
]
