"""Daily to quarterly scorecards over a long history of check results."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import summary
from assayer.operators.observe import report_extract
from workload.base import cents, change, ctes, half_up, percent, query
from workload.staging import derived

TYPES = ("COMPLETENESS", "UNIQUENESS", "VALIDITY", "CONSISTENCY", "FRESHNESS", "VOLUME")
SCORES = [f"{t.lower()}_score" for t in TYPES]
HISTORY = ["history", "history_datasets"]


def _ladder(s: str, n: str, steps, lowest: str) -> str:
    whens = " ".join(f"WHEN {s} >= {cut * 100} * {n} THEN '{label}'" for label, cut in steps)
    return f"CASE {whens} ELSE '{lowest}' END"


FULL = (("A", 95), ("B", 90), ("C", 80), ("D", 70))
INCREMENTAL = (("A", 95), ("B", 85), ("C", 75), ("D", 65))
TRUST = (("HIGH", 95), ("MEDIUM", 85))


def daily_sql(grades=FULL, base: str = "sum", by_run: bool = True, where: str = "TRUE") -> str:
    """``daily`` as a named subquery over the history."""
    rate = cents("pass_rate")
    w = "CAST(weight * 2 AS BIGINT)"
    typed = ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE rule_type = '{t}') > 0 THEN "
        f"{half_up(f'''sum({rate}) FILTER (WHERE rule_type = '{t}')''', f'''greatest(count(*) FILTER (WHERE rule_type = '{t}'), 1)''')}"
        f" END AS {s}" for t, s in zip(TYPES, SCORES))
    status = ("CASE WHEN failed_checks > 0 THEN 'COMPLETED_WITH_FAILURES' ELSE 'COMPLETED' END"
              if by_run else "max_status")
    return f"""daily AS (
  SELECT CAST(day AS VARCHAR) AS summary_date, d.dataset_id, database_name, schema_name,
         table_name, business_domain, total_checks, passed_checks, failed_checks, warning_checks,
         skipped_checks, {half_up('s', 'n')} AS dq_score, weighted_dq_score, {', '.join(SCORES)},
         {_ladder('s', 'n', TRUST, 'LOW')} AS trust_level,
         {_ladder('s', 'n', grades, 'F')} AS quality_grade,
         s >= coalesce({cents('sla_threshold')}, 9000) * n AS is_sla_met,
         total_records, failed_records_count,
         {percent('failed_records_count', 'total_records')} AS failure_rate,
         total_execution_time_sec, total_credits_consumed, last_run_id, last_run_ts,
         {status} AS last_run_status
  FROM (
    SELECT CAST(check_timestamp AS DATE) AS day, dataset_id, database_name, schema_name, table_name,
           CAST(count(*) AS BIGINT) AS total_checks,
           CAST(count(*) FILTER (WHERE check_status = 'PASSED') AS BIGINT) AS passed_checks,
           CAST(count(*) FILTER (WHERE check_status = 'FAILED') AS BIGINT) AS failed_checks,
           CAST(count(*) FILTER (WHERE check_status = 'WARNING') AS BIGINT) AS warning_checks,
           CAST(count(*) FILTER (WHERE check_status IN ('ERROR', 'SKIPPED')) AS BIGINT)
             AS skipped_checks,
           CAST(sum({rate}) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n,
           {half_up(f'sum({rate} * {w})', f'sum({w})')} AS weighted_dq_score, {typed},
           CAST({base}(total_records) AS BIGINT) AS total_records,
           CAST(sum(invalid_records) AS BIGINT) AS failed_records_count,
           CAST(sum(execution_time_ms) AS BIGINT) / CAST(1000 AS DOUBLE)
             AS total_execution_time_sec,
           CAST(sum(execution_credits) AS DOUBLE) AS total_credits_consumed,
           max(run_id) AS last_run_id, CAST(max(check_timestamp) AS VARCHAR) AS last_run_ts,
           max(check_status) AS max_status
    FROM history WHERE {where} GROUP BY ALL) d
  JOIN history_datasets l ON d.dataset_id = l.dataset_id)"""


def _daily(spark, sf_dir, **options):
    return summary.daily_summary(derived(spark, sf_dir, "history"),
                                 derived(spark, sf_dir, "history_datasets"), **options)


@query("daily_summary", ctes(HISTORY, "SELECT * FROM daily", daily_sql()))
def daily_summary(spark, sf_dir):
    return _daily(spark, sf_dir)


@query("daily_summary_variant", ctes(HISTORY, "SELECT * FROM daily",
                                     daily_sql(INCREMENTAL, "max", by_run=False)))
def daily_summary_variant(spark, sf_dir):
    """Other grade cut-offs, failure base and last status."""
    return _daily(spark, sf_dir, scheme="incremental", failure_base="max", last_status="check")



@query("daily_summary_for_run", ctes(HISTORY, "SELECT * FROM daily", daily_sql(
    where="run_id = (SELECT max(run_id) FROM history)")))
def daily_summary_for_run(spark, sf_dir):
    history = derived(spark, sf_dir, "history")
    newest = history.agg(F.max("run_id").alias("run_id"))
    return summary.daily_summary(history.join(newest, "run_id", "left_semi"),
                                 derived(spark, sf_dir, "history_datasets"))


@query("daily_upsert", ctes(HISTORY, "SELECT * FROM daily", daily_sql()))
def daily_upsert(spark, sf_dir):
    """Days kept, days of which part was summed up before, and days that are new: same as all at once."""
    datasets = derived(spark, sf_dir, "history_datasets")
    history = derived(spark, sf_dir, "history")
    early = "check_timestamp < TIMESTAMP_NTZ '1998-01-01 00:00:00'"
    first = summary.daily_summary(history.where(
        f"{early} OR (check_status <> 'PASSED' AND check_timestamp < TIMESTAMP_NTZ '2000-01-01 00:00:00')"), datasets)
    return summary.upsert_summary(first, summary.daily_summary(history.where(f"NOT ({early})"), datasets))


@query("score_trend", ctes(HISTORY, """
SELECT dataset_id, summary_date, dq_score, prev_day_score,
       CASE WHEN dq_score > prev_day_score THEN 'IMPROVING'
            WHEN dq_score < prev_day_score THEN 'DEGRADING' ELSE 'STABLE' END AS score_trend
FROM (SELECT d.*, p.dq_score AS prev_day_score
      FROM daily d LEFT JOIN daily p ON p.dataset_id = d.dataset_id
       AND CAST(p.summary_date AS DATE) = CAST(d.summary_date AS DATE) - 1) t""", daily_sql()))
def score_trend(spark, sf_dir):
    return summary.with_score_trend(_daily(spark, sf_dir)).select(
        "dataset_id", "summary_date", "dq_score", "prev_day_score", "score_trend")


def _period(start: str) -> str:
    """Aggregates of daily rows per period as a named subquery ``p``."""
    averages = ", ".join(
        f"CASE WHEN count({s}) > 0 THEN {half_up(f'sum(round({s} * 100))', f'greatest(count({s}), 1)')} "
        f"END AS avg_{s}" for s in SCORES)
    return f"""p AS (
  SELECT {start} AS start, dataset_id, table_name, business_domain,
         CAST(count(DISTINCT last_run_id) AS BIGINT) AS total_runs,
         CAST(sum(total_checks) AS BIGINT) AS total_checks,
         CAST(sum(passed_checks) AS BIGINT) AS passed_checks,
         CAST(sum(failed_checks) AS BIGINT) AS failed_checks,
         CAST(sum(warning_checks) AS BIGINT) AS warning_checks,
         CAST(sum(round(dq_score * 100)) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n,
         (2 * CAST(sum(round(dq_score * 100)) AS BIGINT) + count(*)) // (2 * count(*)) AS c,
         {averages},
         CAST(sum(total_records) AS BIGINT) AS total_records_checked,
         CAST(sum(failed_records_count) AS BIGINT) AS total_invalid_records,
         CASE WHEN count(failure_rate) > 0 THEN
           {half_up('sum(round(failure_rate * 100))', 'greatest(count(failure_rate), 1)')} END
           AS avg_failure_rate,
         round(sum(total_execution_time_sec), 2) AS total_execution_time_sec,
         round(sum(total_credits_consumed), 6) AS total_credits_consumed,
         min(dq_score) AS min_dq_score, max(dq_score) AS max_dq_score,
         round(stddev_samp(dq_score), 2) AS score_volatility,
         {percent('count(*) FILTER (WHERE is_sla_met)', 'count(*)')} AS sla_compliance_pct
  FROM daily GROUP BY 1, 2, 3, 4)"""


def _scored(previous: str, changed: str) -> str:
    """Score, previous score, change, trend, grade and trust columns of ``p``."""
    return f"""start, dataset_id, table_name, business_domain, total_runs, total_checks,
       passed_checks, failed_checks, warning_checks, c / CAST(100 AS DOUBLE) AS avg_dq_score,
       {', '.join('avg_' + s for s in SCORES)}, total_records_checked, total_invalid_records,
       avg_failure_rate, total_execution_time_sec, total_credits_consumed,
       pc / CAST(100 AS DOUBLE) AS {previous}, {change('c', 'pc')} AS {changed},
       CASE WHEN c > pc THEN 'IMPROVING' WHEN c < pc THEN 'DEGRADING' ELSE 'STABLE' END
         AS score_trend,
       {_ladder('s', 'n', FULL, 'F')} AS quality_grade,
       {_ladder('s', 'n', TRUST, 'LOW')} AS trust_level"""


def _with_previous(periods: str, step: str) -> str:
    """Periods with the score of the one that ends where they start."""
    return (f"(SELECT a.*, b.c AS pc FROM {periods} a LEFT JOIN {periods} b ON b.dataset_id = a.dataset_id "
            f"AND b.table_name IS NOT DISTINCT FROM a.table_name AND b.start + INTERVAL {step} = a.start)")


_WEEK = "CAST(date_trunc('week', CAST(summary_date AS DATE)) AS DATE)"
_MONTH = "CAST(date_trunc('month', CAST(summary_date AS DATE)) AS DATE)"
_QUARTER = "CAST(date_trunc('quarter', CAST(summary_date AS DATE)) AS DATE)"


@query("weekly_rollup", ctes(HISTORY, f"""
SELECT * EXCLUDE (start, island, lim), CAST(start AS VARCHAR) AS week_start_date,
       strftime(start, '%G-W%V') AS week_id, CAST(start + 6 AS VARCHAR) AS week_end_date,
       CAST(sum(CASE WHEN avg_dq_score * 100 < lim THEN 1 ELSE 0 END) OVER (
         PARTITION BY dataset_id, island ORDER BY start) AS BIGINT) AS weeks_below_sla
FROM (SELECT {_scored('prev_week_score', 'score_change_pct')}, lim,
             sum(CASE WHEN c >= lim OR pc IS NULL THEN 1 ELSE 0 END) OVER (
               PARTITION BY dataset_id ORDER BY start) AS island
      FROM {_with_previous("p", "7 DAY")} q
      JOIN (SELECT dataset_id AS owner, coalesce({cents('sla_threshold')}, 9000) AS lim FROM history_datasets) limits
        ON owner = dataset_id) w""", daily_sql(), _period(_WEEK)))
def weekly_rollup(spark, sf_dir):
    return summary.weekly_rollup(_daily(spark, sf_dir), datasets=derived(spark, sf_dir, "history_datasets"))


_TOP = """top AS (
  SELECT start, dataset_id, string_agg(rule_type, ', ' ORDER BY failed DESC, rule_type)
           AS top_failure_types,
         CAST(sum(critical) AS BIGINT) AS total_critical_issues
  FROM (SELECT *, row_number() OVER (PARTITION BY start, dataset_id
                                     ORDER BY failed DESC, rule_type) AS place
        FROM (SELECT CAST(date_trunc('month', check_timestamp) AS DATE) AS start, dataset_id,
                     rule_type, count(*) AS failed,
                     count(*) FILTER (WHERE threshold >= 98) AS critical
              FROM history WHERE check_status = 'FAILED' GROUP BY 1, 2, 3) f) r
  GROUP BY start, dataset_id)"""
_MONTHLY = f"""monthly AS (
  SELECT m.*, top_failure_types, coalesce(total_critical_issues, 0) AS total_critical_issues,
         strftime(m.start, '%Y-%m') AS month_id
  FROM (SELECT {_scored('prev_month_score', 'score_change_pct')}, min_dq_score, max_dq_score,
               score_volatility, sla_compliance_pct FROM {_with_previous("p", "1 MONTH")} q) m
  LEFT JOIN top ON top.start = m.start AND top.dataset_id = m.dataset_id)"""


@query("monthly_rollup", ctes(HISTORY, """
SELECT * EXCLUDE (start), CAST(start AS VARCHAR) AS month_start_date,
       CAST(last_day(start) AS VARCHAR) AS month_end_date FROM monthly""",
                              daily_sql(), _period(_MONTH), _TOP, _MONTHLY))
def monthly_rollup(spark, sf_dir):
    return summary.monthly_rollup(_daily(spark, sf_dir), derived(spark, sf_dir, "history"))


_MONTHS = ("months AS (SELECT * FROM (SELECT start, dataset_id, c, strftime(start, '%Y-%m') "
           "AS month_id FROM p) x)")


@query("quarterly_rollup", ctes(HISTORY, f"""
SELECT * EXCLUDE (start), CAST(start AS VARCHAR) AS quarter_start_date,
       strftime(start, '%Y') || '-Q' || CAST(quarter(start) AS VARCHAR) AS quarter_id,
       CAST(last_day(start + INTERVAL 2 MONTH) AS VARCHAR) AS quarter_end_date
FROM (SELECT {_scored('prev_quarter_score', 'score_improvement_pct')}, sla_compliance_pct,
             best_month, worst_month
      FROM {_with_previous("q", "3 MONTH")} z
      JOIN (SELECT CAST(date_trunc('quarter', start) AS DATE) AS qs, dataset_id AS ds,
                   first(month_id ORDER BY c DESC, start) AS best_month,
                   first(month_id ORDER BY c, start) AS worst_month
            FROM months GROUP BY 1, 2) b ON qs = start AND ds = dataset_id) y""",
    daily_sql(), _period(_MONTH), _MONTHS,
    _period(_QUARTER).replace("p AS (", "q AS (", 1)))
def quarterly_rollup(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    return summary.quarterly_rollup(daily, summary.monthly_scores(daily))


@query("report_extract", ctes(HISTORY, """
SELECT * FROM daily WHERE database_name || '.' || schema_name || '.' || table_name = 'LAKE.BRONZE.T_AF'
""", daily_sql()))
def dataset_report(spark, sf_dir):
    return report_extract(_daily(spark, sf_dir), "LAKE.BRONZE.T_AF")
