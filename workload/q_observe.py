"""Metric facts, insights and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import observe, summary
from assayer.operators.profile import profile_columns
from workload.base import ctes, query
from workload.q_profile import _profile
from workload.q_summary import HISTORY, daily_sql
from workload.staging import AS_OF, HISTORY_AS_OF, derived

WEEK_AGO = f"TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"
RECENT = f"TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY"
LATER = "2024-02-05 00:00:00"
MONTH_AGO = f"TIMESTAMP '{HISTORY_AS_OF}' - INTERVAL 30 DAY"

_FACTS = f"""facts AS (
  SELECT upper(asset_id) AS asset_id, upper(metric_name) AS metric_name, metric_value, metric_time,
         coalesce(source_system, 'MANUAL') AS source_system, run_id, tags
  FROM metrics WHERE asset_id IS NOT NULL AND metric_name IS NOT NULL)"""


def _facts(spark, sf_dir):
    return observe.ingest_metrics(derived(spark, sf_dir, "metrics"), AS_OF)


@query("metric_ingest", ctes(["metrics"], """
SELECT asset_id, metric_name, metric_value, CAST(metric_time AS VARCHAR) AS metric_time,
       source_system, run_id, tags FROM facts""", _FACTS))
def metric_ingest(spark, sf_dir):
    return _facts(spark, sf_dir)


@query("metric_rejects", ctes(["metrics"], """
SELECT run_id, asset_id, metric_name FROM metrics
WHERE asset_id IS NULL OR metric_name IS NULL"""))
def metric_rejects(spark, sf_dir):
    return observe.rejected_metrics(derived(spark, sf_dir, "metrics")).select(
        "run_id", "asset_id", "metric_name")


_LAGGED = """lagged AS (
  SELECT *, lag(metric_value) OVER (PARTITION BY asset_id ORDER BY metric_time, run_id) AS prev
  FROM facts)"""


@query("metric_lag", ctes(["metrics"], """
SELECT asset_id, run_id, metric_value, prev AS prev_value FROM lagged""", _FACTS, _LAGGED))
def metric_lag(spark, sf_dir):
    """Every measurement with the previous one of its asset."""
    return observe.with_previous(_facts(spark, sf_dir), "run_id").select(
        "asset_id", "run_id", "metric_value", "prev_value")


_WINDOWED = f"""recent AS (SELECT * FROM facts WHERE metric_name = 'DQ_SCORE'
  AND metric_time >= {WEEK_AGO})"""
_DROPS = """drops AS (
  SELECT asset_id, CAST(metric_time AS VARCHAR) AS metric_time, run_id,
         metric_value AS dq_score, prev AS prev_score, prev - metric_value AS score_drop
  FROM (SELECT *, lag(metric_value) OVER (PARTITION BY asset_id ORDER BY metric_time, run_id)
          AS prev FROM recent) l
  WHERE prev - metric_value > 10
  ORDER BY score_drop DESC, asset_id, l.metric_time, run_id LIMIT 5)"""


@query("score_drop_anomaly", ctes(["metrics"], "SELECT * FROM drops", _FACTS, _WINDOWED, _DROPS))
def score_drop_anomaly(spark, sf_dir):
    return observe.score_drops(_facts(spark, sf_dir), AS_OF, "run_id")


def _trends(minimum: float) -> str:
    value = "CAST(metric_value AS DECIMAL(18,4))"
    recent = f"metric_time >= {RECENT}"
    return f"""trends AS (
  SELECT asset_id, recent_avg, older_avg, recent_avg - older_avg AS trend
  FROM (SELECT asset_id,
          CAST(sum({value}) FILTER (WHERE {recent}) AS DOUBLE)
            / count(metric_value) FILTER (WHERE {recent}) AS recent_avg,
          CAST(sum({value}) FILTER (WHERE NOT {recent}) AS DOUBLE)
            / count(metric_value) FILTER (WHERE NOT {recent}) AS older_avg
        FROM recent GROUP BY asset_id) a
  WHERE abs(recent_avg - older_avg) > {minimum} ORDER BY abs(trend) DESC, asset_id LIMIT 5)"""


_ROUNDED = "round({0}, 6) AS {0}".format


@query("score_trend_insight", ctes(["metrics"], f"""
SELECT asset_id, {_ROUNDED('recent_avg')}, {_ROUNDED('older_avg')}, {_ROUNDED('trend')}
FROM trends""", _FACTS, _WINDOWED, _trends(0.05)))
def score_trend_insight(spark, sf_dir):
    out = observe.score_trends(_facts(spark, sf_dir), AS_OF, minimum=0.05)
    return out.withColumns({c: F.round(c, 6) for c in ("recent_avg", "older_avg", "trend")})


_TEXT = "CAST(round({}, 2) AS VARCHAR)".format
_SIGNED = f"CASE WHEN round(trend, 2) > 0 THEN '+' ELSE '' END || {_TEXT('trend')}"
_INSIGHTS = f"""
SELECT asset_id, 'ANOMALY' AS insight_type,
       'DQ Score dropped ' || {_TEXT('score_drop')} || '% (from ' || {_TEXT('prev_score')} || '% to '
         || {_TEXT('dq_score')} || '%)' AS summary,
       '{{"bullets":["Previous score: ' || {_TEXT('prev_score')} || '%","Current score: '
         || {_TEXT('dq_score')} || '%","Drop: ' || {_TEXT('score_drop')}
         || '%","Investigate recent data changes or rule updates"],"evidence":{{"metric_name":"dq_score","previous_value":'
         || {_TEXT('prev_score')} || ',"current_value":' || {_TEXT('dq_score')} || ',"change":-'
         || {_TEXT('score_drop')} || '}},"recommendations":["Review failed checks in DQ_CHECK_RESULTS","Check for schema changes or data pipeline issues","Verify data source quality"]}}'
         AS details,
       'WARNING' AS severity, TRUE AS is_actionable, CAST(85 AS DOUBLE) AS confidence_score,
       '{AS_OF}' AS created_at, '2024-02-29 12:00:00' AS expires_at FROM drops
UNION ALL
SELECT asset_id, 'TREND',
       CASE WHEN round(trend, 2) > 0 THEN 'Quality improving: ' ELSE 'Quality degrading: ' END
         || {_SIGNED} || '% over last week',
       '{{"bullets":["Recent average (3 days): ' || {_TEXT('recent_avg')}
         || '%","Previous average (4-7 days ago): ' || {_TEXT('older_avg')} || '%","Trend: '
         || {_SIGNED} || '%"],"evidence":{{"metric_name":"dq_score","recent_avg":'
         || {_TEXT('recent_avg')} || ',"older_avg":' || {_TEXT('older_avg')} || ',"trend":'
         || {_TEXT('trend')} || '}}}}',
       CASE WHEN round(trend, 2) > 0 THEN 'INFO' ELSE 'WARNING' END, round(trend, 2) < 0,
       CAST(75 AS DOUBLE), '{AS_OF}', '2024-02-29 12:00:00' FROM trends
UNION ALL
SELECT asset_id, 'FRESHNESS', 'No metrics for ' || CAST(days_stale AS VARCHAR) || ' days',
       '{{"bullets":["Last metric: ' || last_metric_time || '"]}}', 'WARNING', TRUE,
       CAST(75 AS DOUBLE), '{AS_OF}', '2024-02-29 12:00:00' FROM stale"""


def _stale(days: float, as_of: str = AS_OF) -> str:
    return f"""stale AS (
  SELECT asset_id, CAST(last_time AS VARCHAR) AS last_metric_time,
         CAST(date_diff('day', CAST(last_time AS DATE), DATE '{as_of[:10]}') AS BIGINT) AS days_stale
  FROM (SELECT asset_id, max(metric_time) AS last_time FROM facts GROUP BY asset_id) m
  WHERE last_time < TIMESTAMP '{as_of}' - INTERVAL {days} DAY)"""


@query("stale_assets", ctes(["metrics"], "SELECT * FROM stale",
       _FACTS, _stale(5, LATER)))
def stale_assets(spark, sf_dir):
    return observe.stale_assets(_facts(spark, sf_dir), LATER, 5)


@query("insights", ctes(["metrics"], _INSIGHTS, _FACTS, _WINDOWED, _DROPS, _trends(0.05),
                        _stale(0)))
def all_insights(spark, sf_dir):
    return observe.insights(_facts(spark, sf_dir), AS_OF, "run_id", trend_minimum=0.05,
                            max_age_days=0).drop("insight_id")


@query("active_insights", ctes(["metrics"], f"""
SELECT run_id, asset_id, CAST(metric_time AS VARCHAR) AS created_at
FROM facts WHERE metric_time + INTERVAL 20 DAY > TIMESTAMP '{AS_OF}'
ORDER BY facts.metric_time DESC, run_id LIMIT 10""", _FACTS))
def active_insights(spark, sf_dir):
    """Newest unexpired rows of a ledger (here: measurements that expire after 20 days)."""
    ledger = _facts(spark, sf_dir).select(
        F.col("run_id").alias("insight_id"), "asset_id", F.col("metric_time").alias("created_at"),
        (F.col("metric_time") + F.make_dt_interval(F.lit(20))).alias("expires_at"))
    return observe.active_insights(ledger, AS_OF).select(
        F.col("insight_id").alias("run_id"), "asset_id", "created_at")


def _tag(pairs) -> str:
    """JSON text of the present values of (name, text expression, is a string)."""
    parts = ", ".join(
        f"""CASE WHEN {c} IS NOT NULL THEN '"{name}":' || """
        + (f"""'"' || {c} || '"'""" if quoted else f"CAST({c} AS VARCHAR)") + " END"
        for name, c, quoted in pairs)
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


PROFILE_TS = "2001-09-20 00:00:00"
_UNIFIED = f"""unified AS (
  SELECT database_name || '.' || schema_name || '.' || table_name AS asset_id, column_name,
         'DQ_PASS_RATE' AS metric_name, CAST(pass_rate AS DOUBLE) AS metric_value,
         check_status AS metric_text, CAST(check_timestamp AS VARCHAR) AS metric_time,
         'DQ_CHECK' AS source_system, run_id,
         {_tag([('rule_type', 'rule_type', True), ('rule_name', 'rule_name', True),
                ('threshold', 'threshold', False), ('total_records', 'total_records', False),
                ('invalid_records', 'invalid_records', False)])} AS tags
  FROM history WHERE check_timestamp >= {MONTH_AGO}
  UNION ALL
  SELECT 'LAKE.BRONZE.STG_CUSTOMER', column_name, 'NULL_RATE',
         null_count * CAST(100 AS DOUBLE) / total_records, NULL, '{PROFILE_TS}', 'PROFILING', 'P1',
         {_tag([('data_type', 'data_type', True), ('distinct_count', 'distinct_count', False),
                ('total_records', 'total_records', False)])}
  FROM profile WHERE total_records > 0
  UNION ALL
  SELECT database_name || '.' || schema_name || '.' || table_name, NULL, 'DQ_SCORE', dq_score,
         quality_grade, CAST(CAST(summary_date AS TIMESTAMP) AS VARCHAR), 'DAILY_SUMMARY',
         last_run_id,
         {_tag([('business_domain', 'business_domain', True),
                ('trust_level', 'trust_level', True), ('is_sla_met', 'is_sla_met', False),
                ('total_checks', 'total_checks', False),
                ('failed_checks', 'failed_checks', False)])}
  FROM daily WHERE CAST(summary_date AS TIMESTAMP) >= {MONTH_AGO})"""


def _unified(spark, sf_dir):
    history = derived(spark, sf_dir, "history")
    profile = profile_columns(derived(spark, sf_dir, "stg_customer"), AS_OF).withColumns({
        "database_name": F.lit("LAKE"), "schema_name": F.lit("BRONZE"),
        "table_name": F.lit("STG_CUSTOMER"), "run_id": F.lit("P1"),
        "profile_ts": F.lit(PROFILE_TS).cast("timestamp_ntz")})
    daily = summary.daily_summary(history, derived(spark, sf_dir, "history_datasets"))
    return observe.unified_metrics(history, profile, daily, HISTORY_AS_OF)


_UNIFIED_PARTS = (daily_sql(), _profile("stg_customer", AS_OF), _UNIFIED)


@query("unified_metrics", ctes([*HISTORY, "stg_customer"], """
SELECT * REPLACE (round(metric_value, 6) AS metric_value) FROM unified""", *_UNIFIED_PARTS))
def unified_metrics(spark, sf_dir):
    return _unified(spark, sf_dir).withColumn("metric_value", F.round("metric_value", 6))


@query("metric_backfill", ctes([*HISTORY, "stg_customer"], f"""
SELECT metric_name, source_system, CAST(count(*) AS BIGINT) AS row_count,
       round(sum(metric_value), 2) AS total_value, min(metric_time) AS first_time,
       max(metric_time) AS last_time
FROM (SELECT metric_name, source_system, metric_value, metric_time FROM unified
      UNION ALL
      SELECT 'DQ_PASS_RATE', 'OLD', CAST(pass_rate AS DOUBLE), CAST(check_timestamp AS VARCHAR)
      FROM history WHERE check_timestamp < {MONTH_AGO}) m
GROUP BY metric_name, source_system""", *_UNIFIED_PARTS))
def metric_backfill(spark, sf_dir):
    """Facts older than the window are kept, those inside it replaced."""
    existing = derived(spark, sf_dir, "history").select(
        F.lit("DQ_PASS_RATE").alias("metric_name"), F.lit("OLD").alias("source_system"),
        F.col("pass_rate").cast("double").alias("metric_value"),
        F.col("check_timestamp").alias("metric_time"))
    filled = observe.backfill(existing, _unified(spark, sf_dir), HISTORY_AS_OF)
    return filled.groupBy("metric_name", "source_system").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("metric_value"), 2).alias("total_value"),
        F.min("metric_time").alias("first_time"), F.max("metric_time").alias("last_time"))


@query("lineage_listing", ctes(["lineage"], """
SELECT upstream_database || '.' || upstream_schema || '.' || upstream_table AS upstream,
       downstream_database || '.' || downstream_schema || '.' || downstream_table AS downstream,
       lineage_type, transformation_logic FROM lineage"""))
def lineage_listing(spark, sf_dir):
    return observe.lineage_listing(derived(spark, sf_dir, "lineage"))
