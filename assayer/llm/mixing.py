"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words by its weight; a share stops at
``max_repeat`` times the source's own words, and what it leaves is shared again by
weight.  Within a source each row is expected ``target / source_size`` times.  The
expected copies are summed along the source, one random offset is added, and a row
is emitted once for every whole number that its stretch of the sum crosses.  Rows
lie in the order of their sizes, so each source's words come near the target.

A source may hold most rows: its rows are cut into size classes, and large classes
into slices, whose counts follow the data.  Running sums are taken inside slices;
slice totals give the offsets.  Only tables of a row per source or per slice meet in
one window.

Defined results
  NULL text                 size 0
  NULL source               a source of its own, last in order
  NULL or repeated id, repeated rows   every row is sampled by itself; equal rows are interchangeable
  a source without words    target 0, nothing taken
  equal sizes               ordered by id
  empty table               no rows
Built from DataFrame functions only; reruns agree, as the offset is a digest of the
seed and the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.shared import WORD, packed, repeated, stored

#: Weights repeat along the sources; rows of a slice that one task sorts.
WEIGHTS, MAX_REPEAT, SLICE_ROWS, SEED = (5, 2, 1), 3, 50_000, "mix"


def _digest(text: Column) -> Column:
    """A whole number below 2^32 from a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``target`` to one row per source with ``source, source_size``.

    Let the sources stand by the level at which they reach their limit.  If all
    before one are at theirs, the rest share what remains at some level per unit of
    weight; the highest of these levels is the one at which all words are shared.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("position", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.col("position") % len(weights) + 1).cast("int")).cast("long")
    limit = (F.lit(max_repeat) * F.col("source_size")).cast("long")
    rows = listed.withColumns({"weight": weight, "limit": limit})
    by_level = W.orderBy(F.col("limit") / F.col("weight"), "position")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(rest))
    highest = F.max("level").over(everything)
    return rows.select("source", "source_size", F.least(
        F.col("limit").cast("double"), F.col("weight") * highest).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT,
        slice_rows: int = SLICE_ROWS, seed: str = SEED, keys: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row, and its ``keys``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # Equal rows of a task become one with a count, so that no id can crowd a slice.
    rows = stored(
        docs.select("doc_id", "source", size.alias("size"), F.spark_partition_id().alias("part"), *keys)
        .groupBy("doc_id", "source", "size", "part", *keys).agg(F.count("*").alias("n"))
        .withColumn("class", F.length(F.bin("size"))), "sizes", free=True)
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = targets(totals, weights, max_repeat)
    classes = stored(rows.groupBy("source", "class").agg(F.sum("n").alias("rows")).select(
        "source", "class", F.ceil(F.col("rows") / slice_rows).alias("slices")), "classes", free=True)
    cut = (rows.alias("r").join(classes.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))
                                & (F.col("r.class") == F.col("c.class")))
           .select("r.*", F.when(F.col("slices") == 1, 0).otherwise(
               _digest(F.coalesce(F.col("r.doc_id").cast("string"), F.lit(""))) % F.col("slices")).alias("slice")))
    before = W.partitionBy("source").orderBy("class", "slice").rowsBetween(W.unboundedPreceding, -1)
    starts = (cut.groupBy("source", "class", "slice").agg(F.sum("n").alias("rows"))
              .withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))))
    # Steps of 1/2048 between the whole numbers keep the sums exact where a row is taken in full.
    offset = (_digest(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))) % 1023 + 0.5) / 1024
    starts = stored(
        starts.alias("s").join(wanted.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")))
        .select("s.source", "class", "slice", "start", "source_size", "target"), "starts", free=True)
    running = W.partitionBy("source", "class", "slice").orderBy("size", "doc_id", "part", *keys).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    placed = cut.withColumn("upto", F.sum("n").over(running))
    joined = placed.alias("p").join(
        starts.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))
        & (F.col("p.class") == F.col("s.class")) & (F.col("p.slice") == F.col("s.slice")))
    each = joined.select(
        *[F.col(f"p.{k}").alias(k) for k in ("doc_id", "source", "size", *keys)], "s.source_size", "s.target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        F.explode(F.sequence(F.col("start") + F.col("upto") - F.col("n") + 1, F.col("start") + F.col("upto"))).alias("k"))
    return each.withColumn("offset", offset).withColumn(
        "copies", F.floor(F.col("offset") + F.col("rate") * F.col("k"))
        - F.floor(F.col("offset") + F.col("rate") * (F.col("k") - 1))).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), *keys)


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of a stored table, each as often as the mix takes it."""
    rows = packed(docs)
    needed = rows.select("row", "doc.doc_id", "doc.source", "doc.text")
    return repeated(rows, mix(needed, keys=("row",), **options).select("row", "copies"))
