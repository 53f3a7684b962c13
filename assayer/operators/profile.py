"""Column profiles and the checks derived from them.

Plain measures of the columns share an aggregate over one scan.  Exact distinct counts
share another: several of them in one aggregate would copy every row once per column, so
each row becomes an entry of column and digest per column, which are grouped once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import scoring
from assayer.functions.clock import AsOf, instant
from assayer.operators.evaluate import key_digest
from assayer.sources.tables import literal_rows

# Profile limits that results depend on.
TEXT_LIMIT = 255
HIGH_NULLS, SOME_NULLS = 20, 5
LOW_CARDINALITY, LOW_CARDINALITY_ROWS = 10, 10

# Columns per aggregate, which keeps it below the width where Spark stops generating code.
COLUMNS_PER_PASS = 14


_REGISTRY = T.StructType([
    T.StructField("database_name", T.StringType()), T.StructField("schema_name", T.StringType()),
    T.StructField("table_name", T.StringType()), T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()), T.StructField("is_nullable", T.BooleanType()),
    T.StructField("ordinal_position", T.IntegerType()),
    T.StructField("column_comment", T.StringType()),
])


def category(data_type: T.DataType) -> str:
    """numeric, string, date or other."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "other"


def distinct_counts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Exact numbers of distinct non-NULL values of columns, from one scan and one grouping.

    A row becomes an entry of column and digest for each column; equal ones collapse in
    the map tasks.
    """
    entries = F.array(*[F.struct(F.lit(f.name).alias("column_name"), key_digest([(F.col(f"`{f.name}`"), f.dataType)]).alias("value"))
                        for f in fields])
    values = df.select(F.inline(entries)).groupBy("column_name", "value").agg(F.lit(1))
    return values.groupBy("column_name").agg(F.count("value").alias("distinct_count"))


def _measures(i: int, field: T.StructField, as_of: AsOf) -> dict[str, Column]:
    c, kind = F.col(f"`{field.name}`"), category(field.dataType)
    found = {f"v{i}": F.count(c)}
    if kind != "other":
        found |= {f"lo{i}": F.min(c), f"hi{i}": F.max(c)}
    if kind == "numeric":
        found |= {f"av{i}": F.avg(c.cast("double")), f"sd{i}": F.stddev_samp(c.cast("double"))}
    if kind == "string":
        found |= {f"sl{i}": F.min(F.length(c)), f"ll{i}": F.max(F.length(c)),
                  f"al{i}": F.avg(F.length(c))}
    if kind == "date":
        found[f"fu{i}"] = F.count_if(c > instant(as_of).cast(
            "timestamp" if isinstance(field.dataType, T.TimestampType) else "timestamp_ntz"))
    return found


def _line(i: int, field: T.StructField, present: dict[str, Column]) -> Column:
    def value(slot: str, data_type: str) -> Column:
        found = F.col(f"{slot}{i}") if f"{slot}{i}" in present else F.lit(None)
        return found.cast(data_type)

    return F.struct(
        F.lit(field.name).alias("column_name"),
        F.lit(field.dataType.simpleString().upper()).alias("data_type"),
        F.lit(i).alias("ordinal_position"),
        F.col("n").alias("total_records"),
        (F.col("n") - F.col(f"v{i}")).alias("null_count"),
        F.substring(value("lo", "string"), 1, TEXT_LIMIT).alias("min_value"),
        F.substring(value("hi", "string"), 1, TEXT_LIMIT).alias("max_value"),
        value("av", "double").alias("avg_value"), value("sd", "double").alias("stddev_value"),
        value("sl", "bigint").alias("min_length"), value("ll", "bigint").alias("max_length"),
        value("al", "double").alias("avg_length"),
        value("fu", "bigint").alias("future_date_count"),
    )


def _plain_measures(df: DataFrame, fields: Sequence[tuple[int, T.StructField]],
                    as_of: AsOf) -> DataFrame:
    """Everything but distinct counts of some columns, from one scan of them."""
    measures: dict[str, Column] = {}
    for i, field in fields:
        measures |= _measures(i, field, as_of)
    lines = [_line(i, field, measures) for i, field in fields]
    return (
        df.agg(F.count(F.lit(1)).alias("n"), *[m.alias(name) for name, m in measures.items()])
        .select(F.inline(F.array(*lines)))
    )


def profile_columns(df: DataFrame, as_of: AsOf, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: counts, distinct values, range, moments, lengths, future dates."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    numbered = list(enumerate(fields, start=1))
    plain = reduce(DataFrame.unionByName, [
        _plain_measures(df, numbered[i:i + COLUMNS_PER_PASS], as_of)
        for i in range(0, len(numbered), COLUMNS_PER_PASS)])
    distinct = distinct_counts(df, fields)
    # Both sides have one row per column; grouping the union joins them.
    merged = plain.unionByName(distinct, allowMissingColumns=True)
    return merged.groupBy("column_name").agg(
        *[(F.coalesce(F.max(c), F.lit(0)) if c == "distinct_count" else F.max(c)).alias(c)
          for c in merged.columns if c != "column_name"])


def profile_checks(profile: DataFrame) -> DataFrame:
    """Checks implied by a profile: nulls, low cardinality, dates in the future.

    A column of an empty table yields no check.  Percentages compare exactly, as
    products of whole numbers.
    """
    total, nulls = F.col("total_records"), F.col("null_count")
    distinct, future = F.col("distinct_count"), F.col("future_date_count")
    null_share = scoring.share(nulls, total, 1)
    null_text = F.concat(null_share.cast("double").cast("string"), F.lit("% nulls"))
    high = nulls * 100 > total * HIGH_NULLS
    some = nulls * 100 > total * SOME_NULLS

    def check(name: Column, rule_type: str, status: Column, rate: Column, threshold: Column,
              invalid: Column, reason: Column) -> Column:
        return F.struct(
            name.alias("rule_name"), F.lit(rule_type).alias("rule_type"),
            status.alias("check_status"), rate.cast("decimal(10,2)").alias("pass_rate"),
            threshold.cast("decimal(10,2)").alias("threshold"),
            invalid.cast("bigint").alias("invalid_records"),
            reason.cast("string").alias("failure_reason"))

    null_check = check(
        F.when(high, "PROFILE_HIGH_NULLS").otherwise("PROFILE_NULL_CHECK"), "COMPLETENESS",
        F.when(high, "FAILED").when(some, "WARNING").otherwise("PASSED"),
        scoring.share(total - nulls, total), F.when(high, 80).otherwise(95), nulls,
        F.when(some, null_text))
    cardinality = F.when(
        (distinct * 100 < total * LOW_CARDINALITY) & (distinct > 1)
        & (total > LOW_CARDINALITY_ROWS),
        check(F.lit("PROFILE_LOW_CARDINALITY"), "UNIQUENESS", F.lit("WARNING"),
              scoring.share(distinct, total), F.lit(LOW_CARDINALITY), total - distinct,
              F.concat(F.lit("Only "), distinct.cast("string"), F.lit(" distinct values"))))
    future_dates = F.when(
        future > 0,
        check(F.lit("PROFILE_FUTURE_DATES"), "VALIDITY", F.lit("FAILED"),
              scoring.share(total - future, total), F.lit(100), future,
              F.concat(future.cast("string"), F.lit(" future dates"))))
    identity = [c for c in ("run_id", "dataset_id", "database_name", "schema_name", "table_name")
                if c in profile.columns]
    return profile.where(total > 0).select(
        *identity, "column_name", "total_records",
        F.inline(F.array_compact(F.array(null_check, cardinality, future_dates))))


def profile_run(checks: DataFrame) -> DataFrame:
    """Status and counters of a profile run."""
    status = F.col("check_status")
    return checks.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(status == "PASSED").alias("passed_checks"),
        F.count_if(status == "FAILED").alias("failed_checks"),
        F.count_if(status == "WARNING").alias("warning_checks"),
    ).withColumn("run_status", F.when(F.col("failed_checks") > 0, "COMPLETED_WITH_FAILURES")
                 .otherwise("COMPLETED"))


def schema_registry(tables: dict[tuple[str, str, str], DataFrame]) -> DataFrame:
    """Columns of registered tables in ordinal order: name, type and nullability."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(*name, f.name, f.dataType.simpleString().upper(), f.nullable, i,
             f.metadata.get("comment"))
            for name, df in tables.items() for i, f in enumerate(df.schema.fields, start=1)]
    return literal_rows(spark, rows, _REGISTRY).orderBy("schema_name", "table_name", "ordinal_position")
