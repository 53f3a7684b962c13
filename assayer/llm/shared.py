"""Helpers of the training-data operators: intermediate tables and worker code."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.sources.tables import FREES, literal_rows, shared_dir

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting for the rows of a batch that a task hands to Python.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("first", T.LongType())])


def by_value(module: str) -> None:
    """Ship functions of ``module`` inside the plan instead of by name."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def batches(spark: SparkSession, rows: int):
    """Python gets so many rows at a time from what is written or collected inside.

    A frame that is written by others later takes the batches of that time.
    """
    return _set(spark, {BATCH: str(rows)})


def stored(df: DataFrame, name: str, free: bool = False, batch: int | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    The written table survives lost executors, cuts the lineage and has a known
    size, so that Spark broadcasts it only when it is small.  With ``free``, what was
    shuffled for it is deleted as soon as it is written.  With ``batch``, Python gets
    so many rows at a time, of which JVM and worker hold a copy each.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    with _set(spark, {**({FREES: "true"} if free else {}), **({BATCH: str(batch)} if batch else {})}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Files whose names are sent to every task to number their rows; with more, the rows are written with numbers.
MOST_FILES, ROW_BITS = 100_000, 40


def packed(docs: DataFrame) -> DataFrame:
    """``row, doc``: the rows of a table, numbered, whatever their columns are called.

    Rows of a Parquet table are numbered by their file and their place in it, which every
    later read repeats.  Of any other frame the numbers depend on how it is split, so they
    are written down once, with a copy of the rows.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns and docs.inputFiles():
        paths = docs.select(F.col("_metadata.file_path").alias("path")).distinct().limit(MOST_FILES + 1).toArrow()["path"].to_pylist()
        if len(paths) <= MOST_FILES:
            files = literal_rows(docs.sparkSession, [(p, i << ROW_BITS) for i, p in enumerate(sorted(paths))], _FILES)
            placed = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("index"), doc)
            return placed.join(F.broadcast(files), "path").select((F.col("first") + F.col("index")).alias("row"), "doc")
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), doc), "numbered")


#: Neighbouring rows whose counts travel together; with more blocks, documents are shuffled to their counts.
BLOCK_BITS, MOST_BLOCKS = 12, 8_192


def repeated(rows: DataFrame, counts: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The documents of :func:`packed`, each as often as ``row, copies`` says, which has every row once.

    Counts are sent to the documents, two bytes for each, so that no text moves.
    """
    block, at = F.shiftrightunsigned("row", BLOCK_BITS), F.col("row").bitwiseAND(F.lit(2 ** BLOCK_BITS - 1)).cast("int")
    listed = F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col("copies").cast("short").alias("copies"))))["copies"]
    whole = F.when(F.size(listed) == F.max(at) + 1, listed).otherwise(F.raise_error(F.lit("rows without a count")))
    blocks = stored(counts.groupBy(block.alias("block")).agg(whole.alias("copies")), "copies", free=True)
    if blocks.limit(most_blocks + 1).count() > most_blocks:
        each = blocks.select("block", F.posexplode("copies").alias("at", "copies")).where("copies > 0").select(
            (F.shiftleft("block", BLOCK_BITS) + F.col("at")).alias("row"), "copies")
        taken = rows.join(each, "row").select("doc", "copies")
    else:
        taken = rows.join(F.broadcast(blocks), block == F.col("block")).select(
            "doc", F.element_at("copies", at + 1).alias("copies")).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def fold(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 5``; NULL for a NULL id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


by_value(__name__)
