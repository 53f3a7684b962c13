"""Samples of the rows that break each check.

All row rules of a dataset share two scans.  The first ranks narrow rows, the check and
the key, and keeps the smallest keys of each check; Spark applies that limit inside the
map tasks before shuffling, so a check that most rows break moves no more data than one
that few rows break.  The second fetches the whole rows of the keys chosen, which are at
most the limit for each check, and orders rows of equal keys by all their columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.clock import AsOf
from assayer.operators import rules as r
from assayer.operators.evaluate import ParentLookup, child_counts, daily_volume, unresolved
from assayer.operators.rules import RuleSpec
from assayer.sources.tables import literal_rows

# Fixed value: documented sample size per check.
SAMPLE_SIZE = 100
_OUT = ("check_key", "failed_record_pk", "failed_column_value", "row_context")
_CHECKS = T.StructType([T.StructField("_check", T.IntegerType()),
                        T.StructField("check_key", T.StringType())])

_EXPECTED = T.StructType([T.StructField("check_key", T.StringType()),
                          T.StructField("expected_pattern", T.StringType()),
                          T.StructField("actual_value_type", T.StringType())])


def _text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _top(df: DataFrame, group: str, order: Sequence[Column | str], limit: int) -> DataFrame:
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= limit).drop("_n")


def failed_rows(df: DataFrame, specs: Iterable[RuleSpec], as_of: AsOf, key: Sequence[str],
                parents: ParentLookup | None = None, limit: int = SAMPLE_SIZE,
                counts: Mapping[str, int] | None = None) -> DataFrame:
    """Up to ``limit`` failing records per check.

    Row and foreign-key rules give failing rows with their whole content as JSON;
    uniqueness rules give repeated key values with their number of copies, volume trends
    the days, and rules on a table as a whole what they measured.  The records with the
    smallest keys are taken, however many fail.  ``counts`` (failures per check key)
    spares the checks that passed.
    """
    specs = [s for s in specs if unresolved(df, s) is None]
    if counts is not None:
        specs = [s for s in specs if counts.get(s.check_key, 0) > 0]
    parts = []
    row_specs = [s for s in specs if r.kind_of(s) == r.ROW]
    if row_specs:
        parts.append(_row_failures(df, row_specs, as_of, key, limit))
    for spec in specs:
        if r.kind_of(spec) == r.DISTINCT:
            parts.append(_repeated_keys(df, spec, limit))
        elif r.kind_of(spec) == r.FOREIGN_KEY and parents and parents(spec):
            parts.append(_orphans(df, spec, key, *parents(spec), limit))
        elif r.kind_of(spec) == r.VOLUME_TREND:
            parts.append(_bad_days(df, spec, as_of, limit))
        elif r.kind_of(spec) in (r.VOLUME, r.LOAD_AGE):
            parts.append(_of_table(df, spec))
    if not parts:
        return df.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in _OUT])
    return reduce(DataFrame.unionByName, parts)


# Key first, then the whole row, so that the choice is repeatable.
_BY_KEY = ("_pk", "_row")


def _finish(df: DataFrame) -> DataFrame:
    return df.select(
        "check_key", F.col("_pk").alias("failed_record_pk"),
        F.col("_value").alias("failed_column_value"), F.to_json("_row").alias("row_context"))


def _row_failures(df: DataFrame, specs: Sequence[RuleSpec], as_of: AsOf, key: Sequence[str],
                  limit: int) -> DataFrame:
    def tag(number: int, spec: RuleSpec, chosen: Column | None = None) -> Column:
        broken = r.row_error(spec, as_of)
        if chosen is None:
            return F.when(broken, F.struct(F.lit(number).alias("_check")))
        columns = spec.columns()
        value = F.col(columns[0]).cast("string") if len(columns) == 1 else _text(columns)
        return F.when(F.array_contains(chosen, number) & broken,
                      F.struct(F.lit(number).alias("_check"), value.alias("_value")))

    # Dropping the empty tags after the generator keeps all of this in generated code,
    # which compacting the array first would not.
    tags = F.array(*[tag(i, s) for i, s in enumerate(specs)])
    narrow = df.select(_text(key).alias("_pk"), F.inline(tags)).where("_check IS NOT NULL")
    chosen = _top(narrow, "_check", ("_pk",), limit).groupBy("_pk").agg(F.collect_set("_check").alias("_checks"))
    again = F.array(*[tag(i, s, F.col("_checks")) for i, s in enumerate(specs)])
    rows = df.select("*", _text(key).alias("_pk"), F.struct(*df.columns).alias("_row")).join(F.broadcast(chosen), "_pk")
    tagged = rows.select("_pk", "_row", F.inline(again)).where("_check IS NOT NULL")
    names = literal_rows(df.sparkSession, [(i, s.check_key) for i, s in enumerate(specs)], _CHECKS)
    return _finish(_top(tagged, "_check", _BY_KEY, limit).join(names, "_check"))


def _bad_days(df: DataFrame, spec: RuleSpec, as_of: AsOf, limit: int) -> DataFrame:
    """The first days whose row count strays, with what was expected."""
    days = daily_volume(df, spec.column or "load_timestamp", as_of, spec.params.get("window_days", 7),
                        spec.params.get("tolerance", 0.5)).where("is_anomaly").drop("is_anomaly")
    return _finish(days.orderBy("day").limit(limit).select(
        F.lit(spec.check_key).alias("check_key"), F.col("day").cast("string").alias("_pk"),
        F.col("row_count").cast("string").alias("_value"), F.struct("*").alias("_row")))


def _of_table(df: DataFrame, spec: RuleSpec) -> DataFrame:
    """What a rule on the table as a whole measured: its rows, or its newest load."""
    if r.kind_of(spec) == r.VOLUME:
        measured = df.agg(F.count(F.lit(1)).alias("row_count"))
    else:
        stamp = F.col(spec.column or "load_timestamp").try_cast("timestamp_ntz")
        measured = df.agg(F.max(stamp).alias("newest_load"))
    return _finish(measured.select(
        F.lit(spec.check_key).alias("check_key"), F.lit(None).cast("string").alias("_pk"),
        F.col(measured.columns[0]).cast("string").alias("_value"), F.struct("*").alias("_row")))


def _orphans(df: DataFrame, spec: RuleSpec, key: Sequence[str], parent: DataFrame,
             parent_key: str, limit: int) -> DataFrame:
    """Rows of the smallest key values that have no parent.

    Orphaned values are found from one row per value; no more than ``limit`` of
    them are sent to the scan that fetches their rows, so the rows stay in place.
    """
    known = parent.select(F.col(parent_key).alias("fk")).distinct()
    orphaned = (
        child_counts(df, spec.column).where("fk IS NOT NULL").join(known, "fk", "left_anti")
        .select(F.col("fk").alias("_fk")).orderBy("_fk").limit(limit)
    )
    child = F.col(spec.column)
    rows = df.join(F.broadcast(orphaned), child == F.col("_fk"), "left_semi")
    tagged = rows.select(
        F.lit(spec.check_key).alias("check_key"), child.cast("string").alias("_value"),
        _text(key).alias("_pk"), F.struct(*df.columns).alias("_row"))
    return _finish(_top(tagged, "check_key", _BY_KEY, limit))


def _repeated_keys(df: DataFrame, spec: RuleSpec, limit: int) -> DataFrame:
    columns = spec.columns()
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in columns])
    repeated = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where(
        (F.col("copies") > 1) | missing)
    return _finish(repeated.orderBy(*columns).limit(limit).select(
        F.lit(spec.check_key).alias("check_key"), _text(columns).alias("_pk"),
        _text(columns).alias("_value"), F.struct("*").alias("_row")))


def expectations(df: DataFrame, specs: Iterable[RuleSpec]) -> DataFrame:
    """Expected value and actual column type of each check of a frame."""
    types = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    rows = [(s.check_key, r.expected(s), types.get((s.column or "").lower())) for s in specs]
    return literal_rows(df.sparkSession, rows, _EXPECTED)


def describe_failures(sample: DataFrame, failures: DataFrame, expected: DataFrame) -> DataFrame:
    """Failing records with the classification and the expectation of their check."""
    named = failures.withColumn("check_key", F.concat_ws(
        "|", "dataset_id", "rule_name", F.coalesce("column_name", F.lit("*"))))
    return (named.join(expected, "check_key", "left").join(sample, "check_key")
            .drop("check_key", "invalid_records"))
