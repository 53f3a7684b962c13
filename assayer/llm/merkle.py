"""Merkle manifest of a table: a digest per row, per group and of the whole, with proofs.

A row's leaf is the SHA-256 of its columns, each ``-`` if NULL, else its UTF-8 byte
count, ``:`` and its value.  Leaves of a group lie in the order of an id; every eight
neighbours become their parent, the digest of their hexadecimal digests one after the
other, until one node remains, the group's subroot.  The subroots, in the order of
their groups (NULL first, bytewise), become the root in the same way.

Method: per level one pass of lag and lead windows.  Nodes carry their position and
the number of nodes in their group; lags of 1 to 7 and leads of 1 to 7, masked by the
slot in the run and the length of the run, are the siblings left and right of a node,
and the first child of each run hashes the parent.  Paths come down from the root: a
node's path is its own siblings and then its parent's path, so each level is joined
once with the level above, an eighth of its size.

Positions need no window over a group: rows are dealt by ranges of (group, id), sorted
within their tasks and written with running numbers; the rows of every (group, task)
are counted and summed up per group.  Windows run over blocks of ``BLOCK`` neighbours.
So a group that holds all rows is as evenly spread as many small ones.

Defined results
  NULL in any column       `-` in the leaf; a NULL id comes first in its group and is never tampered with
  NULL group               a group of its own, the first one
  repeated ids             in the order of their leaves; whole rows that repeat are leaves each
  one row in a group       its leaf is the subroot; one group: its subroot is the root
  no siblings at all       the proof is the digest of the empty text
  very long texts          hashed whole
  empty table              no rows
  further columns          not part of the leaf
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.shared import stored

#: Children of a node; neighbours in a window, a whole number of runs; rows of a task are numbered by so many bits.
FAN, BLOCK, TASK_BITS = 8, 4096, 33
#: Columns of the leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(values: Sequence[Column]) -> Column:
    """SHA-256 of columns, each with its length."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of ``grp, id, digest`` with ``pos``, their place in the group from 0, and ``n``, the size of the group."""
    at = "_at"
    # Whole rows that repeat are told apart by their place in the input, so that ranges can part them.
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(
        F.col("grp"), F.col("id").asc_nulls_first(), F.col("digest"), F.col("_tie"))
    written = stored(
        dealt.sortWithinPartitions("grp", F.col("id").asc_nulls_first(), "digest", "_tie").drop("_tie")
        .withColumn(at, F.monotonically_increasing_id()), name, free=True)
    task = F.shiftright(at, TASK_BITS).alias("_task")
    parts = written.groupBy("grp", task).agg(F.min(at).alias("_first"), F.count("*").alias("_rows"))
    whole = W.partitionBy("grp")
    before = whole.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(parts.select(
        "grp", "_task", F.sum("_rows").over(whole).alias("n"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), f"{name}-starts", free=True)
    return written.withColumn("_task", task).join(starts, ["grp", "_task"]).withColumn(
        "pos", F.col(at) + F.col("_shift")).drop(at, "_task", "_shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes of ``grp, pos, n, digest`` with the digests ``left`` and ``right`` of them in their run, in one text each."""
    slot = F.pmod(F.col("pos"), F.lit(FAN))
    length = F.least(F.lit(FAN), F.col("n") - (F.col("pos") - slot))
    near = W.partitionBy("grp", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    none = F.lit("")
    left = [F.when(slot >= o, F.lag("digest", o).over(near)).otherwise(none) for o in range(FAN - 1, 0, -1)]
    right = [F.when(slot + o < length, F.lead("digest", o).over(near)).otherwise(none) for o in range(1, FAN)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def parents(level: DataFrame) -> DataFrame:
    """The first child of each run hashes the run; groups of one node are complete."""
    return level.where((F.pmod(F.col("pos"), F.lit(FAN)) == 0) & (F.col("n") > 1)).select(
        "grp", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("n") / FAN).alias("n"),
        F.sha2(F.concat("digest", "right"), 256).alias("digest"))


def levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """All levels from the leaves up, each node with its siblings; written, since the way down needs them again."""
    found = [stored(with_siblings(leaves), f"{name}-0", free=True)]
    most = found[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        found.append(stored(with_siblings(parents(found[-1])), f"{name}-{len(found)}", free=True))
        most = -(-most // FAN)
    return found


def tops(found: list[DataFrame]) -> DataFrame:
    """``grp, digest``: the node that remains of each group."""
    return reduce(DataFrame.unionAll, [level.where("n = 1").select("grp", "digest") for level in found])


def paths(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with the columns of ``above`` (by ``grp``), whose ``path`` is led on down to them.

    ``path`` holds the siblings left and right of each node from the leaf up; the last node of a group has none.
    """
    carried = [c for c in above.columns if c not in ("grp", "path")]
    down = None
    for level in reversed(found):
        here = level.where("n = 1").join(above, "grp")
        if down is not None:
            over = down.select("grp", F.col("pos").alias("_up"), "path", *carried)
            joined = level.where("n > 1").withColumn("_up", F.floor(F.col("pos") / FAN)).join(over, ["grp", "_up"])
            here = here.unionByName(joined.drop("_up").withColumn(
                "path", F.concat(F.array(F.struct("left", "right")), "path")))
        down = here.drop("left", "right")
    return down


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, digest, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    ``tampered`` says which rows are to be checked with their text's A-Z lower-cased instead of as they are.
    """
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    # Bytewise `-` comes before `=`, so the order of the group keys is that of the groups with NULL first.
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    rows = docs.select(grp.alias("grp"), F.col("doc_id").alias("id"), leaf([F.col(c) for c in FIELDS]).alias("digest"),
                       F.when(hit, leaf(changed)).alias("changed"))
    found = levels(numbered(rows, "leaves"), "nodes")
    groups = tops(found).withColumnRenamed("digest", "subroot")
    upper = levels(numbered(groups.select(
        F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("subroot").alias("digest")), "groups"), "group-nodes")
    root = tops(upper).select("grp", F.col("digest").alias("root"), F.expr(
        "CAST(array() AS array<struct<left: string, right: string>>)").alias("path"))
    above = stored(paths(upper, root).select(
        F.col("id").alias("grp"), F.col("digest").alias("subroot"), "root", "path"), "above")
    below = paths(found, above)
    folded = fold(F.coalesce("changed", "digest"), F.col("path"))
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    return below.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))
