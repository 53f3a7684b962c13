"""Loads of landed rows into the typed tables: cleansed, numbered, upserted, written.

A typed table is laid out in buckets of its business key.  A load finds the buckets that
its rows fall into, reads and joins these alone, and overwrites these partitions; the
others are neither read nor written.  The number of buckets is set when the table is
first written and kept with it.  Surrogate keys come from a stored map (`KeyMap`), so a
key keeps its number through all loads.

A load reads its landed rows twice, first their keys alone, so they must be the same both
times.  Whole rows are shuffled once, by key: the newest version, its number and the row it
replaces meet there, and buckets are made of the hash by which Spark shuffles, so each is
written where its rows are.

A load that breaks off can be run again: it upserts the same values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.clock import AsOf
from assayer.operators.cleanse import SPECS, landed_keys, silver_from_bronze
from assayer.operators.keys import BUCKET, ROWS_PER_BUCKET, KeyMap, bucket_of
from assayer.operators.upsert import upsert
from assayer.sources.tables import Scratch, append, freeing_shuffles, literal_rows, overwrite, read_if_exists, replace_partitions

#: Names of the surrogate keys.
KEY_NAMES = {"customer": "customer_key", "account": "account_key", "transaction": "transaction_key",
             "daily_balance": "balance_key", "fx_rate": "rate_key"}

#: Folders of a table up to which its buckets keep to ``rows_per_bucket``; larger tables have larger buckets.
FOLDERS = 1_000

#: ``hash`` as Spark shuffles; tables first written without this field are laid out by ``bucket_of``.
_LAYOUT = T.StructType([T.StructField("buckets", T.IntegerType()), T.StructField("hashing", T.StringType())])
_INSERTED = T.StructType([T.StructField("load_id", T.StringType()), T.StructField("rows_inserted", T.LongType())])
_LOADED = T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("rows_inserted", T.LongType()),
    T.StructField("rows_updated", T.LongType()), T.StructField("buckets_written", T.LongType())])


@dataclass
class SilverTable:
    """One typed table below a root folder."""

    spark: SparkSession
    root: str
    entity: str
    rows_per_bucket: int = ROWS_PER_BUCKET

    @property
    def path(self) -> str:
        return f"{self.root}/{self.entity}"

    @property
    def keys(self) -> tuple[str, ...]:
        return SPECS[self.entity]().keys

    @property
    def key_map(self) -> KeyMap:
        return KeyMap(self.spark, f"{self.root}/keys/{self.entity}", self.keys, KEY_NAMES[self.entity])

    def read(self) -> DataFrame | None:
        """The table with its surrogate key, without its buckets."""
        table = read_if_exists(self.spark, self.path, merge=False)
        return None if table is None else table.drop(BUCKET)

    def buckets(self, rows: int) -> int:
        """Buckets of a new table of so many rows: a multiple or a divisor of the partitions of a shuffle."""
        wanted = max(8, math.ceil(rows / self.rows_per_bucket))
        wanted = min(wanted, max(FOLDERS, math.ceil(rows / ROWS_PER_BUCKET)))
        width = _width(self.spark)
        if wanted >= width:
            return math.ceil(wanted / width) * width
        return next(n for n in range(wanted, width + 1) if width % n == 0)

    def layout(self, rows: int) -> tuple[Column, bool]:
        """The bucket of a row, fixed by the first load, and whether a shuffle by key keeps a bucket together."""
        path = f"{self.root}/layout/{self.entity}"
        stored = read_if_exists(self.spark, path)
        if stored is None:
            buckets, hashed = self.buckets(rows), True
            overwrite(literal_rows(self.spark, [(buckets, "hash")], _LAYOUT), path)
        else:
            found = stored.first().asDict()
            buckets, hashed = found["buckets"], found.get("hashing") == "hash"
        if not hashed:
            return bucket_of(self.keys, buckets), False
        width = _width(self.spark)
        fits = buckets % width == 0 or width % buckets == 0
        return F.pmod(F.hash(*self.keys), F.lit(buckets)).cast("int"), fits

    def inserted(self) -> int:
        """Rows that finished loads have inserted."""
        loads = read_if_exists(self.spark, f"{self.root}/loads/{self.entity}")
        return 0 if loads is None else loads.agg(F.sum("rows_inserted")).first()[0] or 0

    def touched(self, buckets: list[int]) -> DataFrame | None:
        """The rows in some buckets; the literal list prunes the other folders."""
        table = read_if_exists(self.spark, self.path, merge=False)
        return None if table is None else table.where(F.col(BUCKET).isin(buckets))

    def load(self, bronze: DataFrame, as_of: AsOf, load_id: str) -> DataFrame:
        """Take the newest landed version of every key over; one row of counts.

        New keys are inserted, known ones updated in every column but their load time.
        """
        with Scratch(self.spark, f"load-{self.entity}") as scratch:
            keys = scratch.keep(landed_keys(bronze, self.entity), "keys")
            rows = keys.count()
            if not rows:
                return literal_rows(self.spark, [(self.entity, 0, 0, 0)], _LOADED)
            bucket, fits = self.layout(rows)
            found = sorted(r[0] for r in keys.select(bucket.alias(BUCKET)).distinct().collect())
            # Where every number given so far is in the table, only those of new keys are fetched from the map;
            # after a load that broke off, or over a table without a record of its loads, all are.
            numbers = self.key_map
            after = numbers.last() if numbers.allocated() == self.inserted() else 0
            numbers.extend(keys, load_id, distinct=True)
            version = numbers.attach(silver_from_bronze(bronze, self.entity, as_of), numbers.touched(keys), after)
            target = self.touched(found)
            before = 0
            if target is not None:
                before = target.count()
                version = upsert(target.select(*version.columns), version, self.keys, ("load_timestamp", numbers.name))
            version = version.withColumn(BUCKET, bucket)
            # The partitions that are read are replaced only when the whole new version is written.
            with freeing_shuffles(self.spark):
                replace_partitions(version if fits else version.repartition(BUCKET), self.path, BUCKET, self.keys)
            inserted = self.touched(found).count() - before
            append(literal_rows(self.spark, [(load_id, inserted)], _INSERTED), f"{self.root}/loads/{self.entity}")
        return literal_rows(self.spark, [(self.entity, inserted, rows - inserted, len(found))], _LOADED)


def _width(spark: SparkSession) -> int:
    """Partitions of a shuffle before adaptive execution joins small ones."""
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
               or spark.conf.get("spark.sql.shuffle.partitions"))


def load_silver(spark: SparkSession, landed: Mapping[str, DataFrame], root: str, as_of: AsOf,
                load_id: str, at_once: int = 4) -> DataFrame:
    """Load several entities, ``at_once`` of them at a time; a row of counts for each."""
    def one(item: tuple[str, DataFrame]) -> tuple:
        return tuple(SilverTable(spark, root, item[0]).load(item[1], as_of, load_id).first())

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return literal_rows(spark, list(pool.map(one, landed.items())), _LOADED)
