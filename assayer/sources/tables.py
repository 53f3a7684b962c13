"""Named datasets, and reading and writing of result tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Loader = Callable[[], DataFrame]


@dataclass
class Registry:
    """Resolves a dataset id to a DataFrame: a frame, a loader, a path or a table name."""

    spark: SparkSession
    entries: dict[str, DataFrame | Loader | str] = field(default_factory=dict)

    def add(self, dataset_id: str, source: DataFrame | Loader | str) -> Registry:
        self.entries[dataset_id] = source
        return self

    def __contains__(self, dataset_id: str) -> bool:
        return dataset_id in self.entries

    def frame(self, dataset_id: str) -> DataFrame:
        source = self.entries[dataset_id]
        if isinstance(source, DataFrame):
            return source
        if callable(source):
            return source()
        if "/" in source:
            return self.spark.read.parquet(source)
        return self.spark.table(source)


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType) -> DataFrame:
    """A small frame of given rows, held in the plan itself so that no task parses Python."""
    columns = list(zip(*rows)) or [()] * len(schema.fields)
    arrow = to_arrow_schema(schema)
    table = pa.table([pa.array(values, field.type) for values, field in zip(columns, arrow)],
                     schema=arrow)
    return spark.createDataFrame(table, schema)


def asset_id(*parts: Column) -> Column:
    """``DATABASE.SCHEMA.TABLE``; NULL when any part is NULL."""
    pieces = [x for part in parts for x in (F.lit("."), part)][1:]
    return F.concat(*pieces)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a session that runs in one
    process, such as a test, may leave it unset and gets a temporary folder.
    """
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getCheckpointDir())
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="assayer-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting that deletes the shuffle files of an execution at its end.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared or result store with all it holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_freeing: dict[str, object] = {"lock": Lock(), "depth": 0, "before": None}


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the actions inside are deleted when these end; several threads may be inside."""
    with _freeing["lock"]:
        if _freeing["depth"] == 0:
            _freeing["before"] = spark.conf.get(FREES, None)
            spark.conf.set(FREES, "true")
        _freeing["depth"] += 1
    try:
        yield
    finally:
        with _freeing["lock"]:
            _freeing["depth"] -= 1
            if _freeing["depth"] == 0:
                before = _freeing["before"]
                spark.conf.unset(FREES) if before is None else spark.conf.set(FREES, before)


class Scratch:
    """Intermediate tables of one piece of work, in a folder of their own below the shared one.

    A table is written as Parquet, so it survives lost executors, cuts the lineage and is
    pruned when read.  What was shuffled for it is deleted as soon as it is written.  Leaving
    the scope deletes all tables; :meth:`drop` deletes one as soon as it has been used.
    Only results that are written or collected inside the scope may leave it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write ``df`` and go on with the written copy."""
        path = f"{self.root}/{len(self.tables)}-{name}"
        with freeing_shuffles(self.spark):
            df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((kept, path))
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df, path in self.tables:
            if any(df is x for x in kept):
                delete_folder(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete_folder(self.spark, self.root)


def append(df: DataFrame, path: str, partition: str | None = None,
           cluster: tuple[str, ...] = ()) -> None:
    """Append rows, partitioned by a date column and sorted inside each file."""
    _writer(df, partition, cluster).mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, partition: str | None = None,
              cluster: tuple[str, ...] = ()) -> None:
    _writer(df, partition, cluster).mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str,
                       cluster: tuple[str, ...] = ()) -> None:
    """Replace just the partitions that occur in ``df``."""
    (_writer(df, partition, cluster).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def replace_run(df: DataFrame, path: str, run_id: str, partition: str, day: str,
                cluster: tuple[str, ...] = ()) -> None:
    """Write the rows that a run left on a day in place of those of an earlier attempt.

    Only that day's partition is rewritten; the other runs in it are kept.
    """
    spark = df.sparkSession
    existing = read_if_exists(spark, path)
    if existing is not None:
        others = existing.where((F.col(partition) == F.lit(day).cast("date"))
                                & ~F.col("run_id").eqNullSafe(run_id))
        df = others.unionByName(df, allowMissingColumns=True)
    merged = cut_lineage(df)
    if existing is not None and merged.isEmpty():
        delete_folder(spark, f"{path}/{partition}={day}")
    else:
        replace_partitions(merged, path, partition, cluster)


def _writer(df: DataFrame, partition: str | None, cluster: tuple[str, ...]):
    if cluster:
        df = df.sortWithinPartitions(*([partition] if partition else []), *cluster)
    return df.write.partitionBy(partition) if partition else df.write


def read_if_exists(spark: SparkSession, path: str, merge: bool = True) -> DataFrame | None:
    """A result table, or None where no folder stands; a damaged table raises.

    With ``merge`` the columns of all files are brought together, for which all files are opened.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.option("mergeSchema", merge).parquet(path)


def partition_values(spark: SparkSession, path: str, partition: str) -> list[str]:
    """The values of a table's partition column, read off the names of its folders; none where no table stands."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    return [n.split("=", 1)[1] for n in names if n.startswith(f"{partition}=")]


def counts_since(tables: dict[str, DataFrame], column: str, since: Column) -> DataFrame:
    """Rows at or after an instant, per table."""
    lines = [df.where(F.col(column) >= since).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, lines)


def watermark_audit(df: DataFrame, column: str, since: Column) -> DataFrame:
    """Total rows, rows since an instant, first and last stamp, in one aggregate."""
    c = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(c >= since).alias("today_rows"),
        F.min(c).alias("earliest_load"), F.max(c).alias("latest_load"))
