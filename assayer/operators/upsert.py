"""Keyed upsert as a join: update matching keys, insert new ones.

Files have no in-place MERGE, so an upsert yields the next version of the table,
which the caller writes to a new location.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IN_SOURCE, IN_TARGET = "_in_source", "_in_target"


def _paired(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on the keys with every other column prefixed by its side."""
    def side(df: DataFrame, prefix: str, flag: str) -> DataFrame:
        return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c)
                           for c in df.columns], F.lit(True).alias(flag))

    return side(target, "t_", IN_TARGET).join(side(source, "s_", IN_SOURCE), list(keys),
                                              "full_outer")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
           keep_on_update: Sequence[str] = ("load_timestamp",)) -> DataFrame:
    """Next version of ``target``; ``source`` must hold each key once.

    A matched row takes every source value, NULLs included, except the columns in
    ``keep_on_update`` and those the source lacks.
    """
    paired = _paired(target, source, keys)
    from_source = F.coalesce(F.col(IN_SOURCE), F.lit(False))
    existing = F.coalesce(F.col(IN_TARGET), F.lit(False))

    def value(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name not in source.columns:
            return F.col("t_" + name).alias(name)
        use_source = from_source & ~existing if name in keep_on_update else from_source
        return F.when(use_source, F.col("s_" + name)).otherwise(F.col("t_" + name)).alias(name)

    return paired.select(*[value(c) for c in target.columns])


def upsert_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many source rows an upsert inserts and updates."""
    known = target.select(*keys, F.lit(True).alias(IN_TARGET))
    return source.select(*keys).join(known, list(keys), "left").agg(
        F.count_if(F.col(IN_TARGET).isNull()).alias("rows_inserted"),
        F.count(IN_TARGET).alias("rows_updated"))


def replace_by_key(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace whole rows by key: untouched target rows plus all source rows."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(
        source, allowMissingColumns=True)


def with_surrogate_keys(df: DataFrame, keys: Sequence[str], name: str, start_after: Column | int = 0,
                        digits: int = 3) -> DataFrame:
    """Number rows ``start_after + 1, ...`` without gaps and without one global sort.

    Rows fall into ``16 ** digits`` buckets by key digest; each bucket is numbered
    on its own and shifted by the rows of the buckets before it.  The numbering
    depends only on the keys, so recomputed tasks agree.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    bucketed = df.withColumn("_bucket", F.substring(F.md5(text.cast("binary")), 1, digits))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0))
                           .alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    first = start_after if isinstance(start_after, Column) else F.lit(start_after)
    return (
        bucketed.withColumn("_position", inside).join(offsets, "_bucket")
        .withColumn(name, (first + F.col("_offset") + F.col("_position")).cast("bigint"))
        .drop("_bucket", "_position", "_offset")
    )
