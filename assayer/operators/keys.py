"""Surrogate keys that last: a stored map from business keys to numbers.

A map is two tables below one folder: ``keys``, a row per business key with its number,
laid out in buckets of the key, and ``allocations``, a row per load with the numbers it
took.  Only keys that the map lacks are numbered, after the last number allocated.  The
allocation is written before the keys, so a load that breaks off leaves a gap and never
gives a number twice; run again, it finds the keys it had written.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.sources.tables import Scratch, append, freeing_shuffles, literal_rows, read_if_exists

BUCKET, MAP_BUCKET = "key_bucket", "map_bucket"
#: Keys that one task numbers, as a rule; rows that a bucket of a new table holds.
KEYS_PER_TASK, ROWS_PER_BUCKET = 100_000, 500_000

_ALLOCATION = T.StructType([
    T.StructField("load_id", T.StringType()), T.StructField("first_number", T.LongType()),
    T.StructField("last_number", T.LongType()), T.StructField("buckets", T.IntegerType())])


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row by its business key."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def key_digest(keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).cast("binary"))


def digits_for(rows: int, per_task: int = KEYS_PER_TASK) -> int:
    """Leading digits of a digest that part so many rows into pieces for a task."""
    return max(1, math.ceil(math.log(max(rows / per_task, 1), 16)))


def numbered(df: DataFrame, keys: Sequence[str], name: str, start_after: int = 0, digits: int = 2) -> DataFrame:
    """Rows numbered ``start_after + 1, ...`` without gaps, in the order of the keys' digests.

    ``digits`` leading digits of the digest make a piece, which is numbered on its own;
    pieces that share the first half of these digits make a group.  A row's number is its
    place in its piece, plus the rows of earlier pieces of its group, plus those of earlier
    groups, so the only window without a partition runs over one row per group.  The
    numbers do not depend on ``digits``.
    """
    coarse = max(1, digits // 2)
    # Keys travel without their digests, which are worked out again behind the shuffle.
    placed = df.withColumn("_piece", F.substring(key_digest(keys), 1, digits))
    rows = placed.repartition("_piece").withColumn("_digest", key_digest(keys))
    pieces = placed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_size")).withColumn("_group", F.substring("_piece", 1, coarse))
    groups = pieces.groupBy("_group").agg(F.sum("_size").alias("_size"))

    def before(part: Column | str, order: str) -> Column:
        window = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_size").over(window), F.lit(0))

    group_starts = groups.select("_group", before(F.lit(0), "_group").alias("_earlier"))
    starts = pieces.withColumn("_within", before("_group", "_piece")).join(group_starts, "_group").select(
        "_piece", (F.col("_within") + F.col("_earlier")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_piece").orderBy("_digest", *keys))
    return rows.withColumn("_place", place).join(starts, "_piece").withColumn(
        name, (F.lit(start_after) + F.col("_offset") + F.col("_place")).cast("bigint")).drop(
        "_digest", "_piece", "_place", "_offset")


@dataclass
class KeyMap:
    """The stored numbers of one kind of business key."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    name: str
    per_task: int = KEYS_PER_TASK

    def known(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """``keys, name`` of all keys, or of those in some buckets; None before the first load."""
        table = read_if_exists(self.spark, f"{self.path}/keys", merge=False)
        if table is not None and buckets is not None:
            table = table.where(F.col(MAP_BUCKET).isin(list(buckets)))
        return table

    def last(self) -> int:
        """The highest number ever allocated."""
        table = read_if_exists(self.spark, f"{self.path}/allocations")
        return 0 if table is None else table.agg(F.max("last_number")).first()[0] or 0

    def allocated(self) -> int:
        """How many numbers were ever allocated."""
        table = read_if_exists(self.spark, f"{self.path}/allocations")
        return 0 if table is None else table.agg(F.sum(F.col("last_number") - F.col("first_number") + 1)).first()[0] or 0

    def buckets(self, rows: int) -> int:
        """Buckets of the map: set by the first load, by its size."""
        table = read_if_exists(self.spark, f"{self.path}/allocations")
        found = None if table is None else table.agg(F.max("buckets")).first()[0]
        return found or max(8, math.ceil(rows / ROWS_PER_BUCKET))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the map that the keys of ``rows`` fall into."""
        bucket = bucket_of(self.keys, self.buckets(0)).alias(MAP_BUCKET)
        return sorted(r[0] for r in rows.select(bucket).distinct().collect())

    def extend(self, rows: DataFrame, load_id: str, distinct: bool = False) -> int:
        """Number the keys of ``rows`` that are not yet known; how many there were.

        Rows with a NULL in their key are given none.  ``distinct`` says that ``rows`` is a
        written table that holds whole keys, each once, which needs no copy.
        """
        with Scratch(self.spark, "keys") as scratch:
            wanted = rows.select(*self.keys) if distinct else scratch.keep(rows.select(*self.keys).dropna().distinct())
            buckets = self.buckets(wanted.count())
            known = self.known()
            if known is None:
                new = wanted
            else:
                known = self.known(self.touched(wanted))
                new = scratch.keep(wanted.join(known.select(*self.keys), list(self.keys), "left_anti"))
            count = new.count()
            if count:
                after = self.last()
                append(literal_rows(self.spark, [(load_id, after + 1, after + count, buckets)], _ALLOCATION),
                       f"{self.path}/allocations")
                numbers = numbered(new, self.keys, self.name, after, digits_for(count, self.per_task))
                numbers = numbers.withColumn(MAP_BUCKET, bucket_of(self.keys, buckets))
                with freeing_shuffles(self.spark):
                    append(numbers.repartition(MAP_BUCKET), f"{self.path}/keys", MAP_BUCKET)
        return count

    def attach(self, rows: DataFrame, buckets: Sequence[int] | None = None, after: int = 0) -> DataFrame:
        """``rows`` with their number; NULL for a key that the map lacks.

        Only the buckets of the map that the rows' keys fall into are read; ``buckets`` spares
        a pass over the rows to find them.  Only numbers beyond ``after`` are attached.
        """
        known = self.known()
        if known is None:
            return rows.withColumn(self.name, F.lit(None).cast("bigint"))
        known = self.known(self.touched(rows) if buckets is None else buckets)
        if after:
            known = known.where(F.col(self.name) > after)
        return rows.join(known.drop(MAP_BUCKET), list(self.keys), "left")
