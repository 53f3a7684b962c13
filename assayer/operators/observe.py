"""Metric facts, insights drawn from them, lineage edges and report extracts."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions.clock import AsOf, day, days_before, instant
from assayer.sources.tables import (
    Scratch, append, asset_id, delete_folder, partition_values, read_if_exists, replace_partitions,
)

# Windows, limits and confidences that insights depend on.
HISTORY_DAYS, INSIGHT_DAYS, RECENT_DAYS = 30, 7, 3
DROP_LIMIT, TREND_LIMIT, TOP = 10, 5, 5
DROP_CONFIDENCE, TREND_CONFIDENCE = 85.0, 75.0
EXPIRY_DAYS = 30
SCORE_METRIC = "DQ_SCORE"
DROP_RECOMMENDATIONS = (
    "Review failed checks in DQ_CHECK_RESULTS",
    "Check for schema changes or data pipeline issues",
    "Verify data source quality",
)
DROP_ADVICE = "Investigate recent data changes or rule updates"


def _fact(df: DataFrame, as_of: AsOf, time: Column, name: str, value: Column, text: Column,
          column: Column, source: str, run_id: Column, tags: list[Column], days: int) -> DataFrame:
    """One source of metrics as facts; tags keep only the values that are present."""
    recent = df.where(time >= days_before(as_of, days))
    facts = recent.select(
        asset_id(F.col("database_name"), F.col("schema_name"), F.col("table_name"))
        .alias("asset_id"),
        column.cast("string").alias("column_name"), F.lit(name.upper()).alias("metric_name"),
        value.cast("double").alias("metric_value"), text.cast("string").alias("metric_text"),
        time.cast("timestamp_ntz").alias("metric_time"), F.lit(source).alias("source_system"),
        run_id.alias("run_id"), F.to_json(F.struct(*tags)).alias("tags"))
    return facts.select(*schemas.METRICS.names)


def unified_metrics(results: DataFrame, profiles: DataFrame, daily: DataFrame, as_of: AsOf,
                    days: int = HISTORY_DAYS) -> DataFrame:
    """Pass rates, null rates and daily scores of the last days as one fact table."""
    checks = _fact(
        results, as_of, F.col("check_timestamp"), "dq_pass_rate", F.col("pass_rate"),
        F.col("check_status"), F.col("column_name"), "DQ_CHECK", F.col("run_id"),
        [F.col(c) for c in ("rule_type", "rule_name", "threshold", "total_records",
                            "invalid_records")], days)
    null_rate = F.try_divide(F.col("null_count") * F.lit(100.0), F.col("total_records"))
    nulls = _fact(
        profiles, as_of, F.col("profile_ts"), "null_rate", null_rate, F.lit(None),
        F.col("column_name"), "PROFILING", F.col("run_id"),
        [F.col(c) for c in ("data_type", "distinct_count", "total_records")], days)
    scores = _fact(
        daily, as_of, F.col("summary_date").cast("timestamp_ntz"), "dq_score", F.col("dq_score"),
        F.col("quality_grade"), F.lit(None), "DAILY_SUMMARY", F.col("last_run_id"),
        [F.col(c) for c in ("business_domain", "trust_level", "is_sla_met", "total_checks",
                            "failed_checks")], days)
    return reduce(DataFrame.unionByName, [checks, nulls, scores])


def ingest_metrics(incoming: DataFrame, as_of: AsOf, default_source: str = "MANUAL") -> DataFrame:
    """Validated metric facts: asset and name required and upper-cased."""
    usable = incoming.where(F.col("asset_id").isNotNull() & F.col("metric_name").isNotNull())
    source = F.col("source_system") if "source_system" in incoming.columns else F.lit(None)
    time = F.col("metric_time") if "metric_time" in incoming.columns else F.lit(None)
    return usable.withColumns({
        "asset_id": F.upper("asset_id"), "metric_name": F.upper("metric_name"),
        "source_system": F.coalesce(source, F.lit(default_source)),
        "metric_time": F.coalesce(time.cast("timestamp_ntz"), instant(as_of)),
    }).select(*[c for c in schemas.METRICS.names if c in
                {*incoming.columns, "source_system", "metric_time"}])


def rejected_metrics(incoming: DataFrame) -> DataFrame:
    """Metrics that lack an asset or a name."""
    return incoming.where(F.col("asset_id").isNull() | F.col("metric_name").isNull())


def backfill(existing: DataFrame, unified: DataFrame, as_of: AsOf,
             days: int = HISTORY_DAYS) -> DataFrame:
    """Replace the last ``days`` of facts by freshly unified ones of the same window."""
    since = days_before(as_of, days)
    kept = existing.where(F.col("metric_time") < since)
    return kept.unionByName(unified.where(F.col("metric_time") >= since),
                            allowMissingColumns=True)


#: The partition column of a written history of metric facts.
METRIC_DAY = "metric_day"


def write_facts(facts: DataFrame, path: str) -> None:
    """Append metric facts to a history partitioned by the day of their metric time."""
    append(facts.withColumn(METRIC_DAY, F.to_date("metric_time")).repartition(METRIC_DAY), path, METRIC_DAY)


def write_backfill(unified: DataFrame, path: str, as_of: AsOf, days: int = HISTORY_DAYS) -> None:
    """Replace the last ``days`` of a written history by freshly unified facts of the same window.

    Only partitions from the first day of the window on are read, namely that day's for the
    facts before the window's first instant, and replaced; those left without facts are
    deleted.  Repeating it changes nothing.
    """
    spark, since = unified.sparkSession, days_before(as_of, days)
    first = date.fromisoformat(str(as_of)[:10]) - timedelta(days=days)
    fresh = unified.where(F.col("metric_time") >= since).withColumn(METRIC_DAY, F.to_date("metric_time"))
    # The folders' names tell the days; only that of the first day is opened.
    old = {d for d in partition_values(spark, path, METRIC_DAY) if d >= first.isoformat()}
    with Scratch(spark, "backfill") as scratch:
        if first.isoformat() in old:
            edge = read_if_exists(spark, f"{path}/{METRIC_DAY}={first}").withColumn(METRIC_DAY, F.lit(first))
            fresh = fresh.unionByName(edge.where(F.col("metric_time") < since), allowMissingColumns=True)
        merged = scratch.keep(fresh)
        new = {str(r[0]) for r in merged.select(METRIC_DAY).distinct().collect()}
        if new:
            replace_partitions(merged.repartition(METRIC_DAY), path, METRIC_DAY)
        for gone in sorted(old - new):
            delete_folder(spark, f"{path}/{METRIC_DAY}={gone}")


def _scores(metrics: DataFrame, as_of: AsOf, asset: str | None) -> DataFrame:
    chosen = metrics.where((F.col("metric_name") == SCORE_METRIC)
                           & (F.col("metric_time") >= days_before(as_of, INSIGHT_DAYS)))
    return chosen.where(F.col("asset_id") == asset) if asset else chosen


def with_previous(metrics: DataFrame, tie_break: str, slice_unit: str = "hour") -> DataFrame:
    """Each measurement with the asset's previous one, safe for an asset that dominates.

    An asset's series is cut into time slices that are ordered independently; the
    first row of a slice takes the last value of the asset's slice before it, which
    comes from one row per slice.
    """
    sliced = metrics.withColumn("_slice", F.date_trunc(slice_unit, "metric_time"))
    inside = Window.partitionBy("asset_id", "_slice").orderBy("metric_time", tie_break)
    position = F.struct("metric_time", F.col(tie_break))
    ends = sliced.groupBy("asset_id", "_slice").agg(
        F.max_by(F.struct(F.col("metric_value").alias("v")), position).alias("_end"))
    carried = ends.select("asset_id", "_slice", F.lag("_end").over(
        Window.partitionBy("asset_id").orderBy("_slice"))["v"].alias("_carried"))
    numbered = sliced.withColumns({"_n": F.row_number().over(inside),
                                   "_inside": F.lag("metric_value").over(inside)})
    return numbered.join(carried, ["asset_id", "_slice"]).withColumn(
        "prev_value", F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_inside"))
    ).drop("_slice", "_n", "_inside", "_carried")


def score_drops(metrics: DataFrame, as_of: AsOf, tie_break: str, asset: str | None = None,
                limit: int = TOP) -> DataFrame:
    """Largest falls between consecutive scores of an asset in the last week."""
    drop = F.col("prev_value") - F.col("metric_value")
    return (
        with_previous(_scores(metrics, as_of, asset), tie_break)
        .where(F.col("prev_value").isNotNull() & (drop > DROP_LIMIT))
        .select("asset_id", "metric_time", F.col(tie_break),
                F.col("metric_value").alias("dq_score"), F.col("prev_value").alias("prev_score"),
                drop.alias("score_drop"))
        .orderBy(F.desc("score_drop"), "asset_id", "metric_time", tie_break).limit(limit)
    )


def score_trends(metrics: DataFrame, as_of: AsOf, asset: str | None = None,
                 minimum: float = TREND_LIMIT, limit: int = TOP) -> DataFrame:
    """Assets whose mean of the last three days left that of the four before."""
    boundary = days_before(as_of, RECENT_DAYS)
    value = F.col("metric_value").cast("decimal(18,4)")
    recent = F.col("metric_time") >= boundary

    def mean(condition: Column) -> Column:
        return (F.try_divide(F.sum(F.when(condition, value)), F.count(F.when(condition, value)))
                .cast("double"))

    trend = F.col("recent_avg") - F.col("older_avg")
    return (
        _scores(metrics, as_of, asset).groupBy("asset_id")
        .agg(mean(recent).alias("recent_avg"), mean(~recent).alias("older_avg"))
        .where(F.abs(trend) > minimum)
        .select("asset_id", "recent_avg", "older_avg", trend.alias("trend"))
        .orderBy(F.desc(F.abs("trend")), "asset_id").limit(limit)
    )


def stale_assets(metrics: DataFrame, as_of: AsOf, max_age_days: int = 1) -> DataFrame:
    """Assets without a metric for longer than the limit."""
    newest = metrics.groupBy("asset_id").agg(F.max("metric_time").alias("last_metric_time"))
    return newest.where(F.col("last_metric_time") < days_before(as_of, max_age_days)).withColumn(
        "days_stale", F.datediff(day(as_of), F.to_date("last_metric_time")))


def _number(c: Column) -> Column:
    return F.round(c, 2).cast("string")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _insight(df: DataFrame, as_of: AsOf, kind: str, summary: Column, details: Column,
             severity: Column, actionable: Column, confidence: float) -> DataFrame:
    return df.select(
        F.sha2(F.concat_ws("|", "asset_id", F.lit(kind), summary, F.lit(str(as_of))), 256)
        .alias("insight_id"),
        "asset_id", F.lit(kind).alias("insight_type"), summary.alias("summary"),
        F.to_json(details).alias("details"), severity.alias("severity"),
        actionable.alias("is_actionable"), F.lit(confidence).alias("confidence_score"),
        instant(as_of).alias("created_at"),
        (instant(as_of) + F.make_dt_interval(F.lit(EXPIRY_DAYS))).alias("expires_at"))


def drop_insights(drops: DataFrame, as_of: AsOf) -> DataFrame:
    """Score drops as insight rows."""
    drop, now, before = (F.round(c, 2) for c in ("score_drop", "dq_score", "prev_score"))
    summary = _text("DQ Score dropped ", _number(drop), "% (from ", _number(before), "% to ",
                    _number(now), "%)")
    details = F.struct(
        F.array(_text("Previous score: ", _number(before), "%"),
                _text("Current score: ", _number(now), "%"), _text("Drop: ", _number(drop), "%"),
                F.lit(DROP_ADVICE)).alias("bullets"),
        F.struct(F.lit("dq_score").alias("metric_name"), before.alias("previous_value"),
                 now.alias("current_value"), (-drop).alias("change")).alias("evidence"),
        F.array(*[F.lit(t) for t in DROP_RECOMMENDATIONS]).alias("recommendations"))
    return _insight(drops, as_of, "ANOMALY", summary, details, F.lit("WARNING"), F.lit(True),
                    DROP_CONFIDENCE)


def trend_insights(trends: DataFrame, as_of: AsOf) -> DataFrame:
    """Score trends as insight rows."""
    trend, recent, older = (F.round(c, 2) for c in ("trend", "recent_avg", "older_avg"))
    rising = trend > 0
    signed = _text(F.when(rising, "+").otherwise(""), _number(trend))
    summary = _text(F.when(rising, "Quality improving: ").otherwise("Quality degrading: "),
                    signed, "% over last week")
    details = F.struct(
        F.array(_text("Recent average (3 days): ", _number(recent), "%"),
                _text("Previous average (4-7 days ago): ", _number(older), "%"),
                _text("Trend: ", signed, "%")).alias("bullets"),
        F.struct(F.lit("dq_score").alias("metric_name"), recent.alias("recent_avg"),
                 older.alias("older_avg"), trend.alias("trend")).alias("evidence"))
    return _insight(trends, as_of, "TREND", summary, details,
                    F.when(rising, "INFO").otherwise("WARNING"), trend < 0, TREND_CONFIDENCE)


def stale_insights(stale: DataFrame, as_of: AsOf) -> DataFrame:
    """Stale assets as insight rows."""
    summary = _text("No metrics for ", F.col("days_stale").cast("string"), " days")
    details = F.struct(
        F.array(_text("Last metric: ", F.col("last_metric_time").cast("string"))).alias("bullets"))
    return _insight(stale, as_of, "FRESHNESS", summary, details, F.lit("WARNING"), F.lit(True),
                    TREND_CONFIDENCE)


def insights(metrics: DataFrame, as_of: AsOf, tie_break: str, asset: str | None = None,
             trend_minimum: float = TREND_LIMIT, max_age_days: int = 1) -> DataFrame:
    """All insight kinds of one run."""
    chosen = metrics.where(F.col("asset_id") == asset) if asset else metrics
    return reduce(DataFrame.unionByName, [
        drop_insights(score_drops(metrics, as_of, tie_break, asset), as_of),
        trend_insights(score_trends(metrics, as_of, asset, trend_minimum), as_of),
        stale_insights(stale_assets(chosen, as_of, max_age_days), as_of)])


def active_insights(ledger: DataFrame, as_of: AsOf, limit: int = 10) -> DataFrame:
    """Insights that have not expired, newest first."""
    return ledger.where(F.col("expires_at").isNull() | (F.col("expires_at") > instant(as_of))
                        ).orderBy(F.desc("created_at"), "insight_id").limit(limit)


def lineage_listing(edges: DataFrame) -> DataFrame:
    """Lineage edges with qualified names, in name order."""
    return edges.select(
        asset_id(*[F.col(f"upstream_{p}") for p in ("database", "schema", "table")])
        .alias("upstream"),
        asset_id(*[F.col(f"downstream_{p}") for p in ("database", "schema", "table")])
        .alias("downstream"),
        "lineage_type", "transformation_logic",
    ).orderBy("upstream", "downstream", "lineage_type", "transformation_logic")


def report_extract(daily: DataFrame, scope: str = "PLATFORM") -> DataFrame:
    """Summary rows of the whole platform or of one ``DATABASE.SCHEMA.TABLE``."""
    if scope == "PLATFORM":
        return daily
    return daily.where(asset_id(F.col("database_name"), F.col("schema_name"),
                                F.col("table_name")) == scope)


def write_report(extract: DataFrame, path: str, file_format: str, report_id: str, scope: str,
                 by: str, as_of: AsOf) -> DataFrame:
    """Write a report extract as CSV or JSON and return its registry row."""
    if file_format.upper() == "CSV":
        extract.write.mode("overwrite").option("header", True).csv(path)
    elif file_format.upper() == "JSON":
        extract.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"Unsupported report format: {file_format}")
    kind = "PLATFORM" if scope == "PLATFORM" else "DATASET"
    return extract.sparkSession.range(1).select(
        F.lit(report_id).alias("report_id"), F.lit(kind).alias("report_type"),
        F.lit(scope).alias("scope"), day(as_of).alias("report_date"),
        F.lit(by).alias("generated_by"), instant(as_of).alias("generated_at"),
        F.lit(file_format.upper()).alias("format"), F.lit(path).alias("file_path"))
