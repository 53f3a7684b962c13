"""Check runs: configuration in, lazy result frames out.

A run resolves its checks (configuration rows only) and builds one fused plan per
dataset.  :func:`run_checks` unions them lazily, so a single action computes every check.
:func:`run_planned` gives each dataset a job of its own, a few at a time, and isolates
checks that cannot be computed, so the size of a plan does not grow with the number of
datasets and one bad dataset or check costs no other its results.  Writing is left to
:func:`execute`.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.clock import AsOf, instant
from assayer.operators import results as shape
from assayer.operators.evaluate import ParentLookup, evaluate, rows_since_midnight
from assayer.operators.failed_rows import (
    describe_failures, expectations, failed_rows,
)
from assayer.operators.profile import profile_checks, profile_columns
from assayer.operators.rules import RuleSpec
from assayer.operators.summary import daily_summary, upsert_summary
from assayer.plans import config, seeds
from assayer.sources.tables import (
    Registry, cut_lineage, literal_rows, read_if_exists, replace_partitions, replace_run,
)

# Fixed value: column names accepted as an incremental watermark.
WATERMARK_NAME = r"[A-Za-z0-9_]+"
_WATERMARK_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


_NO_MEASURES = T.StructType([
    T.StructField("check_key", T.StringType()), T.StructField("rows_in_scope", T.LongType()),
    T.StructField("total_records", T.LongType()), T.StructField("invalid_records", T.LongType()),
    T.StructField("error_message", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in
      ("database_name", "schema_name", "table_name", "scan_scope", "scan_reason")],
    T.StructField("labelled", T.BooleanType())])


@dataclass
class Configuration:
    """The configuration tables of a deployment."""

    datasets: DataFrame
    rules: DataFrame
    mappings: DataFrame
    weights: DataFrame
    allowed: DataFrame
    foreign_keys: dict[str, tuple[str, str]]
    params: Callable[[dict], dict] | None = None

    @classmethod
    def shipped(cls, spark: SparkSession, layers: Sequence[str] = ("BRONZE",),
                incremental: dict[str, str] | None = None) -> Configuration:
        return cls(seeds.datasets(spark, layers, incremental), seeds.rules(spark),
                   seeds.mappings(spark, layers), seeds.weights(spark),
                   seeds.allowed_values(spark), seeds.FOREIGN_KEYS)


@dataclass
class CheckRun:
    """One run.  ``lines`` is its only evaluated frame; the others are cut from it."""

    run_id: str
    run_type: str
    triggered_by: str
    as_of: AsOf
    lines: DataFrame
    datasets: int
    sources: dict[str, tuple[DataFrame, list[RuleSpec]]]
    parents: ParentLookup | None
    #: Seconds that the job of each dataset took, where each had its own.
    seconds: dict[str, float] = field(default_factory=dict)

    @property
    def outcomes(self) -> DataFrame:
        """Every check, also those without anything to check."""
        return shape.outcomes_of(self.lines)

    @property
    def results(self) -> DataFrame:
        """The checks that are logged."""
        return shape.recorded(self.outcomes)

    def control(self, seconds: float | None = None) -> DataFrame:
        """The run record."""
        return shape.run_control(self.lines, self.run_id, self.run_type, self.triggered_by,
                                 self.as_of, self.datasets, seconds)

    def failures(self) -> DataFrame:
        return shape.failures(self.results)

    def invalid_counts(self) -> dict[str, int]:
        """Failures per check of the checks that failed or warned (one row each)."""
        rows = self.failures().select("dataset_id", "rule_name", "column_name",
                                      "invalid_records").collect()
        return {f"{x['dataset_id']}|{x['rule_name']}|{x['column_name'] or '*'}":
                x["invalid_records"] for x in rows}

    def failed_records(self, keys: dict[str, Sequence[str]], limit: int = 100,
                       counts: dict[str, int] | None = None) -> DataFrame:
        """Sampled failing records of the checks that failed or warned.

        With :meth:`invalid_counts` as ``counts`` checks that passed are not looked at.
        """
        sampled = {d: source for d, source in self.sources.items() if d in keys}
        samples = [failed_rows(df, specs, self.as_of, keys[d], self.parents, limit, counts)
                   for d, (df, specs) in sampled.items()]
        expected = [expectations(df, specs) for df, specs in sampled.values()]
        return describe_failures(reduce(DataFrame.unionByName, samples), self.failures(),
                                 reduce(DataFrame.unionByName, expected))


def _parent_lookup(registry: Registry, foreign_keys: dict[str, tuple[str, str]]) -> ParentLookup:
    def lookup(spec: RuleSpec):
        known = foreign_keys.get((spec.column or "").lower())
        if known is None or known[0] not in registry:
            return None
        return registry.frame(known[0]), known[1]

    return lookup


def _measure(df: DataFrame, specs: list[RuleSpec], as_of: AsOf, parents: ParentLookup | None,
             dataset: dict, scope: str, labelled: bool, reason: str) -> DataFrame:
    return _labelled(evaluate(df, specs, as_of, parents), dataset, scope, labelled, reason)


def _labelled(measured: DataFrame, dataset: dict, scope: str, labelled: bool, reason: str) -> DataFrame:
    return measured.withColumns({
        "database_name": F.lit(dataset["source_database"]),
        "schema_name": F.lit(dataset["source_schema"]),
        "table_name": F.lit(dataset["source_table"]),
        "scan_scope": F.lit(scope), "scan_reason": F.lit(reason), "labelled": F.lit(labelled)})


def _grouped(specs: list[RuleSpec]) -> dict[str, list[RuleSpec]]:
    by_dataset: dict[str, list[RuleSpec]] = {}
    for spec in specs:
        by_dataset.setdefault(spec.dataset_id, []).append(spec)
    return by_dataset


def watermark_problem(df: DataFrame, column: str, table: str) -> str | None:
    """Why a column cannot serve as incremental watermark, or None."""
    if not re.fullmatch(WATERMARK_NAME, column):
        return (f"INCREMENTAL_COLUMN '{column}' contains invalid characters. "
                "Only [A-Za-z0-9_] allowed.")
    found = [f for f in df.schema.fields if f.name.lower() == column.lower()]
    if not found:
        return f"Configured INCREMENTAL_COLUMN '{column}' does not exist in {table}"
    if not isinstance(found[0].dataType, _WATERMARK_TYPES):
        return (f"INCREMENTAL_COLUMN '{column}' has invalid datatype "
                f"'{found[0].dataType.simpleString().upper()}' in {table}. "
                "Allowed: DATE, TIMESTAMP, TIMESTAMP_NTZ")
    return None


def _source(registry: Registry, name: str) -> tuple[DataFrame | None, str | None]:
    """A dataset's frame, or why there is none."""
    if name not in registry:
        return None, f"Dataset {name} has no registered source"
    try:
        return registry.frame(name), None
    except AnalysisException as error:
        return None, f"Source of dataset {name} cannot be read: {error.getCondition()}"


def _qualified(dataset: dict) -> str:
    return ".".join(dataset[k] for k in ("source_database", "source_schema", "source_table"))


@dataclass
class _Planned:
    """What a run has to do: the sources it can check, and rows for those that it cannot."""

    spark: SparkSession
    run_id: str
    as_of: AsOf
    incremental: bool
    datasets: list[dict]
    specs: list[RuleSpec]
    parents: ParentLookup
    problems: list[DataFrame] = field(default_factory=list)
    jobs: list[tuple[dict, DataFrame, list[RuleSpec], str, str]] = field(default_factory=list)

    def lines(self, measures: list[DataFrame], empty_volume_passes: bool) -> DataFrame:
        measured = reduce(DataFrame.unionByName, measures) if measures else literal_rows(self.spark, [], _NO_MEASURES)
        lines = shape.shape_lines(measured, shape.spec_frame(self.spark, self.specs), self.run_id, self.as_of,
                                  empty_volume_passes)
        return reduce(DataFrame.unionByName, self.problems, lines)

    def run(self, lines: DataFrame, triggered_by: str) -> CheckRun:
        sources = {dataset["dataset_id"]: (df, checks) for dataset, df, checks, _, _ in self.jobs}
        return CheckRun(self.run_id, "INCREMENTAL" if self.incremental else "FULL", triggered_by, self.as_of,
                        lines, len(self.datasets), sources, self.parents)


def _plan(registry: Registry, conf: Configuration, as_of: AsOf, run_id: str, dataset_id: str | None,
          rule_type: str | None, mode: str, incremental: bool) -> _Planned:
    spark = registry.spark
    chosen = config.resolve_datasets(conf.datasets, dataset_id, mode)
    datasets = [row.asDict() for row in chosen.collect()]
    if not datasets:
        raise ValueError("No active datasets found")
    wanted = [d["dataset_id"] for d in datasets]
    resolved = config.resolve_rules(conf.mappings, conf.rules, conf.datasets, conf.weights,
                                    as_of, rule_type).where(F.col("dataset_id").isin(wanted))
    specs = config.bind_rules(resolved, conf.allowed, conf.params)
    by_dataset = _grouped(specs)
    plan = _Planned(spark, run_id, as_of, incremental, datasets, specs, _parent_lookup(registry, conf.foreign_keys))
    for dataset in datasets:
        name = dataset["dataset_id"]
        watermark = dataset["incremental_column"] if incremental else None
        scope = "INCREMENTAL" if watermark is not None else "FULL"
        df, problem = _source(registry, name)
        if problem is None and watermark is not None:
            problem = watermark_problem(df, watermark, _qualified(dataset))
        if problem:
            plan.problems.append(shape.config_error(spark, run_id, as_of, dataset,
                                                    "CONFIG_VALIDATION", "ERROR", problem, scope))
            continue
        if watermark is not None:
            df = rows_since_midnight(df, watermark, as_of)
        reason = "WATERMARK" if watermark is not None else "BASELINE"
        plan.jobs.append((dataset, df, by_dataset.get(name, []), scope, reason))
    return plan


def run_checks(registry: Registry, conf: Configuration, as_of: AsOf, run_id: str,
               dataset_id: str | None = None, rule_type: str | None = None, mode: str = "FULL",
               incremental: bool = False, triggered_by: str = "spark",
               empty_volume_passes: bool = False) -> CheckRun:
    """Run the configured checks of all, one or only the critical datasets.

    With ``incremental`` a dataset with a watermark column is limited to the rows
    of ``as_of``'s day and left out when there are none; a bad watermark becomes
    an ERROR row, as does a dataset without a readable source.  Datasets without a
    watermark are scanned in full.  An empty table fails
    its volume check unless ``empty_volume_passes``.
    """
    plan = _plan(registry, conf, as_of, run_id, dataset_id, rule_type, mode, incremental)
    measures = [_measure(df, checks, as_of, plan.parents, dataset, scope, incremental, reason)
                for dataset, df, checks, scope, reason in plan.jobs]
    return plan.run(plan.lines(measures, empty_volume_passes), triggered_by)


def _reason(error: Exception) -> str:
    condition = getattr(error, "getCondition", lambda: None)()
    return condition or str(error).strip().splitlines()[0]


def measured_safely(df: DataFrame, specs: Sequence[RuleSpec], as_of: AsOf,
                    parents: ParentLookup | None) -> list[tuple]:
    """The measures of a dataset, with an error message for the checks that could not be computed.

    All checks are computed in one job.  When that fails, the rows alone are counted; if
    even this fails, the source cannot be read.  Otherwise the checks are halved until
    those that fail are alone, so ``k`` bad ones of ``n`` cost about ``2 k log n`` jobs.
    """
    def measures(part: Sequence[RuleSpec]) -> list[tuple]:
        return [tuple(row) for row in evaluate(df, part, as_of, parents).collect()]

    def of_checks(part: Sequence[RuleSpec], rows: int, error: Exception | None) -> list[tuple]:
        if error is None:
            try:
                return [m for m in measures(part) if m[0] is not None]
            except Exception as caught:  # noqa: BLE001 - whatever a check raises, it is recorded
                error = caught
        if len(part) == 1:
            return [(part[0].check_key, rows, 0, 0, f"Check cannot be computed: {_reason(error)}")]
        half = len(part) // 2
        return of_checks(part[:half], rows, None) + of_checks(part[half:], rows, None)

    try:
        return measures(specs)
    except Exception as error:  # noqa: BLE001
        try:
            scope = measures([])
        except Exception as unreadable:  # noqa: BLE001
            return [(s.check_key, 0, 0, 0, f"Source cannot be read: {_reason(unreadable)}") for s in specs]
        return scope + (of_checks(specs, scope[0][1], error) if specs else [])


def run_planned(registry: Registry, conf: Configuration, as_of: AsOf, run_id: str,
                dataset_id: str | None = None, rule_type: str | None = None, mode: str = "FULL",
                incremental: bool = False, triggered_by: str = "spark",
                empty_volume_passes: bool = False, at_once: int = 4) -> CheckRun:
    """The same run as a job per dataset, ``at_once`` of them at a time.

    A check that fails while it is computed becomes an ERROR row, as do all checks of a
    dataset that cannot be read; the others keep their results.  A row per check reaches
    the driver, and the seconds of each dataset are kept with the run.
    """
    plan = _plan(registry, conf, as_of, run_id, dataset_id, rule_type, mode, incremental)

    def job(item: tuple) -> tuple[DataFrame, float]:
        dataset, df, checks, scope, reason = item
        started = time.monotonic()
        found = measured_safely(df, checks, as_of, plan.parents)
        frame = literal_rows(plan.spark, found, T.StructType(_NO_MEASURES.fields[:5]))
        return _labelled(frame, dataset, scope, incremental, reason), time.monotonic() - started

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        done = list(pool.map(job, plan.jobs))
    run = plan.run(plan.lines([frame for frame, _ in done], empty_volume_passes), triggered_by)
    run.seconds = {item[0]["dataset_id"]: seconds for item, (_, seconds) in zip(plan.jobs, done)}
    return run


def profile_dataset(registry: Registry, conf: Configuration, as_of: AsOf, run_id: str,
                    dataset_id: str, rule_type: str | None = None) -> CheckRun:
    """All configured checks of one dataset."""
    return run_checks(registry, conf, as_of, run_id, dataset_id, rule_type)


def run_rule(registry: Registry, conf: Configuration, as_of: AsOf, run_id: str, dataset_id: str,
             rule_name: str, column: str | None = None, threshold: float | None = None,
             mode: str | None = None, triggered_by: str = "spark") -> CheckRun:
    """One check by name.

    In ADHOC mode with a threshold the rule needs no mapping; otherwise its
    mapping is looked up and ``threshold``, if given, replaces the configured one.
    """
    spark = registry.spark
    dataset = config.resolve_datasets(conf.datasets, dataset_id).first()
    if dataset is None:
        raise ValueError(f"No active dataset found for dataset_id = {dataset_id}")
    dataset = dataset.asDict()
    if threshold is not None and mode == "ADHOC":
        unmapped = config.resolve_rule_direct(
            conf.rules, conf.weights, rule_name, dataset["business_domain"], as_of).withColumns({
                "dataset_id": F.lit(dataset_id), "column_name": F.lit(column).cast("string"),
                "threshold_value": F.lit(float(threshold)), "config_id": F.lit(0),
                "type_rank": F.lit(0)})
        bound = config.bind_rules(unmapped, conf.allowed, conf.params)
        if not bound:
            raise ValueError(f"Rule '{rule_name}' not found")
        spec = bound[0]
    else:
        resolved = config.resolve_rules(conf.mappings, conf.rules, conf.datasets, conf.weights,
                                        as_of)
        one = config.resolve_single_mapping(resolved, dataset_id, rule_name, column)
        bound = config.bind_rules(one, conf.allowed, conf.params)
        if not bound:
            raise ValueError(f"No active rule mapping found for dataset_id={dataset_id}, "
                             f"rule_name={rule_name}, column={column}")
        spec = bound[0]
        if threshold is not None:
            spec = replace(spec, threshold=float(threshold))
    return _run_specs(registry, conf, as_of, run_id, dataset, [spec], "CUSTOM", triggered_by)


def _run_specs(registry: Registry, conf: Configuration, as_of: AsOf, run_id: str, dataset: dict,
               specs: list[RuleSpec], run_type: str, triggered_by: str) -> CheckRun:
    df = registry.frame(dataset["dataset_id"])
    parents = _parent_lookup(registry, conf.foreign_keys)
    measured = _measure(df, specs, as_of, parents, dataset, "FULL", False, run_type)
    lines = shape.shape_lines(measured, shape.spec_frame(registry.spark, specs), run_id, as_of)
    return CheckRun(run_id, run_type, triggered_by, as_of, lines, 1,
                    {dataset["dataset_id"]: (df, specs)}, parents)


def run_batch(registry: Registry, conf: Configuration, as_of: AsOf, run_id: str, dataset_id: str,
              custom_config: str | None = None) -> CheckRun:
    """The checks of one dataset that a JSON selection names, or all of them.

    When nothing is left to run the result is a single warning row, and an unreadable
    selection gives a single error row.
    """
    dataset = config.resolve_datasets(conf.datasets, dataset_id).first()
    if dataset is None:
        raise ValueError(f"No active dataset found for dataset_id = {dataset_id}")
    dataset = dataset.asDict()
    resolved = config.resolve_rules(conf.mappings, conf.rules, conf.datasets, conf.weights,
                                    as_of).where(F.col("dataset_id") == dataset_id)
    try:
        chosen, unreadable = config.selected_rule_ids(custom_config), None
    except (ValueError, TypeError, AttributeError) as error:
        chosen, unreadable = [], f"Error parsing config: {error}"
        resolved = resolved.limit(0)
    if chosen:
        resolved = resolved.where(F.col("rule_id").isin(chosen))
    specs = config.bind_rules(resolved, conf.allowed, conf.params)
    run = _run_specs(registry, conf, as_of, run_id, dataset, specs, "CUSTOM_BATCH", "SCHEDULED")
    if unreadable:
        run.lines = shape.config_error(registry.spark, run_id, as_of, dataset,
                                       "SCHEDULER_CONFIG_CHECK", "ERROR", unreadable, None)
    elif not specs:
        reason = ("The specific rules selected for this schedule are no longer active." if chosen
                  else "No active custom rules found. Please configure rules.")
        run.lines = shape.config_error(registry.spark, run_id, as_of, dataset,
                                       "SCHEDULER_CONFIG_CHECK", "WARNING", reason, None)
    return run


def run_profile(registry: Registry, conf: Configuration, as_of: AsOf, run_id: str,
                dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """Column profile of a dataset and the checks derived from it."""
    dataset = config.resolve_datasets(conf.datasets, dataset_id).first()
    if dataset is None:
        raise ValueError(f"No active dataset found for dataset_id = {dataset_id}")
    profile = profile_columns(registry.frame(dataset_id), as_of)
    named = profile.withColumns({
        "run_id": F.lit(run_id), "dataset_id": F.lit(dataset_id),
        "database_name": F.lit(dataset["source_database"].upper()),
        "schema_name": F.lit(dataset["source_schema"].upper()),
        "table_name": F.lit(dataset["source_table"].upper())})
    return named, profile_checks(named)


def execute_profile(registry: Registry, conf: Configuration, as_of: AsOf, run_id: str, dataset_id: str,
                    root: str, triggered_by: str = "spark") -> DataFrame:
    """Profile a dataset once and write its column profiles, checks, run record and daily summary.

    Repeating a run id on its day replaces what it had written.  A dataset without columns
    leaves a FAILED record alone.
    """
    spark, day = registry.spark, str(as_of)[:10]
    if not registry.frame(dataset_id).columns:
        record = shape.failed_run(spark, run_id, "PROFILE", triggered_by, as_of, "No columns found")
        _write_control(record, root, run_id, as_of)
        return record
    started = time.monotonic()
    profile, _ = run_profile(registry, conf, as_of, run_id, dataset_id)
    profile = cut_lineage(profile.withColumn("profile_ts", instant(as_of)))
    seconds = time.monotonic() - started
    results = cut_lineage(shape.profile_results(profile_checks(profile), run_id, as_of))
    timed = shape.with_timing(results, seconds * 1000, results.count())
    replace_run(profile.withColumn("profile_date", F.to_date("profile_ts")), f"{root}/column_profile", run_id,
                "profile_date", day, ("table_name", "column_name"))
    replace_run(timed.withColumn("check_date", F.to_date("check_timestamp")), f"{root}/check_results", run_id,
                "check_date", day, ("table_name",))
    rows = profile.agg(F.coalesce(F.max("total_records"), F.lit(0))).first()[0]
    control = cut_lineage(shape.profile_control(results, run_id, triggered_by, as_of, rows, seconds))
    _write_control(control, root, run_id, as_of)
    if not results.isEmpty():
        write_summary(spark, root, day, conf.datasets)
    return control


def run_scan(registry: Registry, conf: Configuration, as_of: AsOf, run_id: str, dataset_id: str,
             scan_type: str, custom_config: str | None = None) -> dict[str, object]:
    """Dispatch a scan: profiling, full and anomalies profile; checks, custom and full check."""
    kind, done = scan_type.lower(), {}
    if kind in ("profiling", "full", "anomalies"):
        done["profile"] = run_profile(registry, conf, as_of, run_id + "_P", dataset_id)
    if kind in ("checks", "custom", "full"):
        done["checks"] = run_batch(registry, conf, as_of, run_id + "_C", dataset_id, custom_config)
    return done


def execute_or_record(spark: SparkSession, build: Callable[[], CheckRun], root: str,
                      datasets: DataFrame, run_id: str, run_type: str, as_of: AsOf,
                      triggered_by: str = "spark") -> DataFrame:
    """Build and execute a run; one that cannot be carried out leaves a FAILED record."""
    try:
        return execute(build(), root, datasets)
    except Exception as error:  # noqa: BLE001 - whatever the cause, the run must be recorded
        record = shape.failed_run(spark, run_id, run_type, triggered_by, as_of, str(error))
        _write_control(record, root, run_id, as_of)
        return record


def _write_control(record: DataFrame, root: str, run_id: str, as_of: AsOf) -> None:
    replace_run(record.withColumn("run_date", F.to_date("start_ts")), f"{root}/run_control",
                run_id, "run_date", str(as_of)[:10])


def execute(run: CheckRun, root: str, datasets: DataFrame, scheme: str = "full",
            keys: dict[str, Sequence[str]] | None = None, limit: int = 100) -> DataFrame:
    """Compute a run once, write its tables below ``root`` and return its record.

    A run id that is executed again on its day, whether complete or broken off, replaces
    what it had written.  The evaluated checks (one row each) are written to the shared folder first, so
    results, failures, run record and summary all read that copy.  With the business
    ``keys`` of the datasets, up to ``limit`` failing records of each failed check are
    written as well, to ``failed_records``.
    """
    started = time.monotonic()
    run.lines = cut_lineage(run.lines)
    seconds = sum(run.seconds.values()) or time.monotonic() - started
    if run.seconds:
        timed = shape.with_dataset_timing(run.results, run.seconds)
    else:
        timed = shape.with_timing(run.results, seconds * 1000, run.outcomes.count())
    timed = timed.withColumn("check_date", F.to_date("check_timestamp"))
    day = str(run.as_of)[:10]
    replace_run(timed, f"{root}/check_results", run.run_id, "check_date", day, ("table_name",))
    replace_run(run.failures().withColumn("detected_date", F.to_date("detected_ts")),
                f"{root}/failed_checks", run.run_id, "detected_date", day, ("table_name",))
    if keys is not None:
        records = run.failed_records(keys, limit, run.invalid_counts())
        replace_run(records.withColumn("detected_date", F.to_date("detected_ts")),
                    f"{root}/failed_records", run.run_id, "detected_date", day, ("table_name",))
    control = cut_lineage(run.control(seconds))
    _write_control(control, root, run.run_id, run.as_of)
    write_summary(run.lines.sparkSession, root, day, datasets, scheme)
    return control


def write_summary(spark: SparkSession, root: str, day: str, datasets: DataFrame, scheme: str = "full") -> None:
    """Bring the summary of a day up to its logged results."""
    today = F.lit(day).cast("date")
    logged = spark.read.parquet(f"{root}/check_results").where(F.col("check_date") == today)
    fresh = daily_summary(logged, datasets, scheme=scheme)
    existing = read_if_exists(spark, f"{root}/daily_summary")
    merged = fresh if existing is None else upsert_summary(
        existing.where(F.col("summary_date") == today), fresh)
    replace_partitions(cut_lineage(merged), f"{root}/daily_summary", "summary_date",
                       ("table_name",))
