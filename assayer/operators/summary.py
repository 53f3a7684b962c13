"""Daily, weekly, monthly and quarterly scorecards of check results.

The daily summary reduces check results to one row per day and dataset; every
longer period is computed from those rows, so its windows run over a handful of
rows per dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import scoring
from assayer.functions.clock import AsOf, day
from assayer.operators.upsert import replace_by_key

# Fixed value: score a dataset must reach when it sets no threshold of its own.
DEFAULT_SLA = 90
IDENTITY = ("dataset_id", "database_name", "schema_name", "table_name", "business_domain")
SCORES = tuple(f"{t.lower()}_score" for t in scoring.RULE_TYPES)


def _status_counts() -> list[Column]:
    status = F.col("check_status")
    return [
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(status == "PASSED").alias("passed_checks"),
        F.count_if(status == "FAILED").alias("failed_checks"),
        F.count_if(status == "WARNING").alias("warning_checks"),
        F.count_if(status.isin("ERROR", "SKIPPED")).alias("skipped_checks"),
    ]


def daily_summary(results: DataFrame, datasets: DataFrame, as_of: AsOf | None = None,
                  run_id: str | None = None, scheme: str = "full",
                  failure_base: str = "sum", last_status: str = "run") -> DataFrame:
    """One row per day and dataset.

    Limited to ``as_of``'s day or to one run when given.  ``scheme`` picks the
    grade cut-offs, ``failure_base`` the denominator of the failure rate (``sum``
    or ``max`` of the records checked) and ``last_status`` whether the last status
    is that of the day's run (``run``) or the alphabetically last check status.
    """
    rows = results
    if as_of is not None:
        rows = rows.where(F.to_date("check_timestamp") == day(as_of))
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    rate, kind = F.col("pass_rate"), F.col("rule_type")
    base = F.sum if failure_base == "sum" else F.max
    weight = F.coalesce(F.col("weight"), F.lit(1).cast("decimal(5,2)"))
    aggregated = rows.groupBy(
        F.to_date("check_timestamp").alias("summary_date"), "dataset_id", "database_name",
        "schema_name", "table_name",
    ).agg(
        *_status_counts(),
        scoring.mean(rate).alias("score"),
        F.round(F.try_divide(F.sum(rate * weight), F.sum(F.when(rate.isNotNull(), weight))), 2)
        .cast("decimal(10,2)").alias("weighted_dq_score"),
        *[scoring.rounded_mean(F.when(kind == t, rate)).alias(s)
          for t, s in zip(scoring.RULE_TYPES, SCORES)],
        base("total_records").alias("total_records"),
        F.sum("invalid_records").alias("failed_records_count"),
        F.round(F.sum(F.coalesce("execution_time_ms", F.lit(0))) / 1000, 2)
        .cast("decimal(10,2)").alias("total_execution_time_sec"),
        F.sum(F.coalesce("execution_credits", F.lit(0).cast("decimal(10,6)")))
        .cast("decimal(18,6)").alias("total_credits_consumed"),
        F.max("run_id").alias("last_run_id"),
        F.max("check_timestamp").alias("last_run_ts"),
        F.max("check_status").alias("max_status"),
    )
    limits = datasets.select("dataset_id", "business_domain", "sla_threshold")
    score = F.col("score")
    by_run = F.when(F.col("failed_checks") > 0, "COMPLETED_WITH_FAILURES").otherwise("COMPLETED")
    return aggregated.join(limits, "dataset_id", "left").select(
        "summary_date", *IDENTITY, "total_checks", "passed_checks", "failed_checks",
        "warning_checks", "skipped_checks",
        F.round(score, 2).cast("decimal(10,2)").alias("dq_score"), "weighted_dq_score", *SCORES,
        scoring.trust_level(score).alias("trust_level"),
        scoring.quality_grade(score, scheme).alias("quality_grade"),
        (score >= F.coalesce("sla_threshold", F.lit(DEFAULT_SLA))).alias("is_sla_met"),
        "total_records", "failed_records_count",
        scoring.share(F.col("failed_records_count"), F.col("total_records")).alias("failure_rate"),
        "total_execution_time_sec", "total_credits_consumed", "last_run_id", "last_run_ts",
        (by_run if last_status == "run" else F.col("max_status")).alias("last_run_status"),
    )


def upsert_summary(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace summary rows by (day, dataset): repeating a run changes nothing."""
    return replace_by_key(existing, fresh, ("summary_date", "dataset_id"))


def with_score_trend(daily: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """The score of the day before, NULL without a summary of it, and the direction of change."""
    history = Window.partitionBy("dataset_id").orderBy("summary_date")
    previous = F.when(F.lag("summary_date").over(history) == F.date_sub("summary_date", 1),
                      F.lag("dq_score").over(history))
    return daily.withColumn("prev_day_score", previous).withColumn(
        "score_trend", scoring.trend(F.col("dq_score") - F.col("prev_day_score"), tolerance))


def _period_scores() -> list[Column]:
    return [
        F.sum("total_checks").alias("total_checks"),
        F.sum("passed_checks").alias("passed_checks"),
        F.sum("failed_checks").alias("failed_checks"),
        F.sum("warning_checks").alias("warning_checks"),
        scoring.mean(F.col("dq_score")).alias("score"),
        *[scoring.rounded_mean(F.col(s)).alias(f"avg_{s}") for s in SCORES],
        F.sum("total_records").alias("total_records_checked"),
        F.sum("failed_records_count").alias("total_invalid_records"),
        scoring.rounded_mean(F.col("failure_rate")).alias("avg_failure_rate"),
        F.sum("total_execution_time_sec").alias("total_execution_time_sec"),
        F.sum("total_credits_consumed").alias("total_credits_consumed"),
    ]


def _graded(periods: DataFrame, period: str, before: Column, previous: str, change: str,
            tolerance: float) -> DataFrame:
    """Rounded score, grade, trust level and change against the calendar period before.

    ``before`` is where that period starts; without rows of it there is no change.
    """
    history = Window.partitionBy("dataset_id").orderBy(period)
    scored = periods.withColumn("avg_dq_score", F.round("score", 2).cast("decimal(10,2)"))
    compared = scored.withColumn(previous, F.when(
        F.lag(period).over(history) == before, F.lag("avg_dq_score").over(history)))
    difference = F.col("avg_dq_score") - F.col(previous)
    return compared.withColumns({
        change: F.round(F.try_divide(difference * 100, F.col(previous)), 2).cast("decimal(10,2)"),
        "score_trend": scoring.trend(difference, tolerance),
        "quality_grade": scoring.quality_grade(F.col("score")),
        "trust_level": scoring.trust_level(F.col("score"))}).drop("score")


def weekly_rollup(daily: DataFrame, sla: float = DEFAULT_SLA, tolerance: float = 0.0,
                  datasets: DataFrame | None = None) -> DataFrame:
    """ISO weeks per dataset, with the length of the current run of adjacent weeks below the SLA.

    The limit is the ``sla_threshold`` of the dataset where ``datasets`` is given and sets one, else ``sla``.
    """
    start = F.to_date(F.date_trunc("week", F.col("summary_date")))
    weeks = daily.withColumn("week_start_date", start).groupBy(
        "week_start_date", "dataset_id", "table_name", "business_domain",
    ).agg(F.countDistinct("last_run_id").alias("total_runs"), *_period_scores())
    before = F.date_sub("week_start_date", 7)
    graded = _graded(weeks, "week_start_date", before, "prev_week_score", "score_change_pct",
                     tolerance)
    limit = F.lit(sla)
    if datasets is not None:
        graded = graded.join(datasets.select("dataset_id", F.col("sla_threshold").alias("_sla")), "dataset_id", "left")
        limit = F.coalesce("_sla", limit)
    below = F.col("avg_dq_score") < limit
    history = Window.partitionBy("dataset_id").orderBy("week_start_date")
    follows = F.coalesce(F.lag("week_start_date").over(history) == before, F.lit(False))
    streaks = graded.withColumn("_broken", (~below | ~follows).cast("int")).withColumn(
        "_streak", F.sum("_broken").over(history.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("dataset_id", "_streak").orderBy("week_start_date").rowsBetween(
        Window.unboundedPreceding, 0)
    year = F.year(F.date_add("week_start_date", 3))
    return streaks.withColumns({
        "week_id": F.concat(year.cast("string"), F.lit("-W"),
                            F.lpad(F.weekofyear("week_start_date").cast("string"), 2, "0")),
        "week_end_date": F.date_add("week_start_date", 6),
        "weeks_below_sla": F.sum(below.cast("int")).over(inside)}).drop("_streak", "_broken", "_sla")


def top_failure_types(results: DataFrame, period: Column, top: int | None = None) -> DataFrame:
    """Rule types of failed checks per period and dataset, most frequent first, as text."""
    counted = (
        results.where("check_status = 'FAILED'")
        .groupBy(period.alias("period"), "dataset_id", "rule_type")
        .agg(F.count(F.lit(1)).alias("failed"),
             F.count_if(scoring.is_critical(F.col("threshold"))).alias("critical"))
    )
    # A (period, dataset) group holds at most one row per rule type.
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("failed")).alias("rank"), "rule_type")))
    return counted.groupBy("period", "dataset_id").agg(
        F.array_join(ranked["rule_type"] if top is None else F.slice(ranked["rule_type"], 1, top), ", ")
        .alias("top_failure_types"),
        F.sum("critical").alias("total_critical_issues"))


def monthly_scores(daily: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Calendar months per dataset: scores, range, volatility, SLA compliance."""
    month = F.trunc("summary_date", "MM")
    months = daily.withColumn("month_start_date", month).groupBy(
        "month_start_date", "dataset_id", "table_name", "business_domain",
    ).agg(
        F.countDistinct("last_run_id").alias("total_runs"), *_period_scores(),
        F.min("dq_score").alias("min_dq_score"), F.max("dq_score").alias("max_dq_score"),
        F.round(F.stddev_samp(F.col("dq_score").cast("double")), 2).alias("score_volatility"),
        scoring.share(F.count_if("is_sla_met"), F.count(F.lit(1))).alias("sla_compliance_pct"),
    )
    graded = _graded(months, "month_start_date", F.add_months("month_start_date", -1),
                     "prev_month_score", "score_change_pct", tolerance)
    return graded.withColumns({
        "month_id": F.date_format("month_start_date", "yyyy-MM"),
        "month_end_date": F.last_day("month_start_date")})


def monthly_rollup(daily: DataFrame, results: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Monthly scores with the main failure types and the number of critical failures."""
    failed = top_failure_types(results, F.trunc(F.to_date("check_timestamp"), "MM"))
    return monthly_scores(daily, tolerance).join(
        failed.withColumnRenamed("period", "month_start_date"),
        ["month_start_date", "dataset_id"], "left").withColumn(
        "total_critical_issues", F.coalesce("total_critical_issues", F.lit(0)))


def quarterly_rollup(daily: DataFrame, monthly: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Quarters per dataset with their best and worst month of the monthly scores."""
    def quarter(c: str) -> Column:
        return F.to_date(F.date_trunc("quarter", F.col(c)))

    quarters = daily.withColumn("quarter_start_date", quarter("summary_date")).groupBy(
        "quarter_start_date", "dataset_id", "table_name", "business_domain",
    ).agg(
        F.countDistinct("last_run_id").alias("total_runs"), *_period_scores(),
        scoring.share(F.count_if("is_sla_met"), F.count(F.lit(1))).alias("sla_compliance_pct"),
    )
    # The earlier month wins a tie on either side.
    age = -F.datediff("month_start_date", F.lit("1970-01-01").cast("date"))
    best = F.max_by("month_id", F.struct("avg_dq_score", age))
    worst = F.max_by("month_id", F.struct(-F.col("avg_dq_score"), age))
    months = monthly.groupBy(quarter("month_start_date").alias("quarter_start_date"), "dataset_id",
                             ).agg(best.alias("best_month"), worst.alias("worst_month"))
    graded = _graded(quarters, "quarter_start_date", F.add_months("quarter_start_date", -3),
                     "prev_quarter_score", "score_improvement_pct", tolerance)
    start = F.col("quarter_start_date")
    return graded.join(months, ["quarter_start_date", "dataset_id"]).withColumns({
        "quarter_id": F.concat(F.year(start).cast("string"), F.lit("-Q"),
                               F.quarter(start).cast("string")),
        "quarter_end_date": F.last_day(F.add_months(start, 2))})
