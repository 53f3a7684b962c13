"""Fused evaluation: all checks of a dataset in one scan.

Every row becomes a few entries of a slot and a key:

* the row rules that it breaks, as the bits of a pattern; rows with equal patterns
  collapse in the map tasks, as there are few different ones;
* for each uniqueness or foreign-key rule the digest of its key; parents' keys come in as
  entries of the same slot, so one grouping finds repeated and orphaned keys alike;
* for each volume trend its day.

One grouping by slot and key, combined in the map tasks, gives the counts of all rules; a
hot key costs one partial row per task.  Sums over few rows then make a line per check.
Nothing is collected: the result is one lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.clock import AsOf, day, instant, start_of_day
from assayer.operators import rules as r
from assayer.operators.rules import RuleSpec
from assayer.sources.tables import literal_rows

#: Row rules whose errors make one pattern, the bits of a long.
CHECKS_PER_PASS = 62
# check_key NULL marks the frame's own row-count line.
MEASURE_COLUMNS = (
    "check_key", "rows_in_scope", "total_records", "invalid_records", "error_message",
)
ParentLookup = Callable[[RuleSpec], "tuple[DataFrame, str] | None"]

_LINES = T.StructType([
    T.StructField("check_key", T.StringType()), T.StructField("slot", T.IntegerType()),
    T.StructField("measure", T.StringType()), T.StructField("bit", T.IntegerType()),
    T.StructField("bound", T.LongType()), T.StructField("error_message", T.StringType()),
])
_SLOT = T.StructType([T.StructField("slot", T.IntegerType())])


def common_type(spark, one: T.DataType, other: T.DataType) -> T.DataType:
    """The type in which Spark compares two columns."""
    if one == other:
        return one
    pair = F.coalesce(F.lit(None).cast(one), F.lit(None).cast(other))
    return spark.range(1).select(pair.alias("c")).schema[0].dataType


def key_digest(columns: Iterable[tuple[Column, T.DataType]]) -> Column:
    """Digest of a key of typed columns, NULL if any of them is; texts of any length count whole."""
    def text(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return (c + F.lit(0).cast(kind)).cast("string")  # minus zero is zero
        if isinstance(kind, T.BinaryType):
            return F.hex(c)
        if isinstance(kind, (T.ArrayType, T.StructType)):
            return F.to_json(F.struct(c))
        return c.cast("string")

    texts = [F.when(c.isNotNull(), text(c, kind)) for c, kind in columns]
    # The length in front keeps ("ab", "c") and ("a", "bc") apart.
    whole = texts if len(texts) == 1 else [p for t in texts for p in (F.octet_length(t).cast("string"), F.lit(":"), t)]
    return F.unhex(F.md5(F.concat(*whole).cast("binary")))


def _type(df: DataFrame, column: str) -> T.DataType:
    return df.select(F.col(column)).schema[0].dataType


@dataclass
class _Slots:
    """What the rows of a frame are turned into, and the line each check makes of it."""

    df: DataFrame
    as_of: AsOf
    patterns: list[list[Column]] = field(default_factory=lambda: [[]])
    keys: dict[int, Column] = field(default_factory=dict)
    days: dict[int, tuple[Column, int, float]] = field(default_factory=dict)
    loaded: list[Column] = field(default_factory=list)
    sides: list[DataFrame] = field(default_factory=list)
    lines: list[tuple] = field(default_factory=lambda: [(None, 0, "scope", 0, 0, None)])

    def _line(self, spec: RuleSpec, slot: int, measure: str, bit: int = 0, bound: int = 0, problem: str | None = None) -> None:
        self.lines.append((spec.check_key, slot, measure, bit, bound, problem))

    def _new_slot(self) -> int:
        # Slots of patterns are 0, -1, ..., of keys and days 1, 2, ...
        return len(self.keys) + len(self.days) + 1

    def add(self, spec: RuleSpec, parents: ParentLookup | None) -> None:
        problem, kind, params = unresolved(self.df, spec), r.kind_of(spec), spec.params
        parent = None
        if problem is None and kind == r.FOREIGN_KEY:
            parent = parents(spec) if parents else None
            problem = None if parent is not None else f"No parent table known for column {spec.column}"
        if problem is not None:
            self._line(spec, 0, "none", problem=problem)
        elif kind == r.VOLUME:
            self._line(spec, 0, "volume", bound=params.get("min_rows", 1))
        elif kind == r.LOAD_AGE:
            self.loaded.append(F.col(spec.column or "load_timestamp").try_cast("timestamp_ntz"))
            self._line(spec, 0, "load_age", len(self.loaded) - 1, params.get("max_age_days", 1))
        elif kind == r.DISTINCT:
            slot = self._new_slot()
            self.keys[slot] = key_digest([(F.col(c), _type(self.df, c)) for c in spec.columns()])
            self._line(spec, slot, "distinct")
        elif kind == r.FOREIGN_KEY:
            slot, (owner, key) = self._new_slot(), parent
            one, other = _type(self.df, spec.column), _type(owner, key)
            shared = common_type(self.df.sparkSession, one, other)
            as_shared = [c if kind_ == shared else c.try_cast(shared) for c, kind_ in ((F.col(spec.column), one), (F.col(key), other))]
            self.keys[slot] = key_digest([(as_shared[0], shared)])
            self.sides.append(owner.select(F.lit(slot).alias("slot"), key_digest([(as_shared[1], shared)]).alias("key")).where("key IS NOT NULL"))
            self._line(spec, slot, "joined" if params.get("count_joined_rows") else "children")
        elif kind == r.VOLUME_TREND:
            slot = self._new_slot()
            stamp = F.col(spec.column or "load_timestamp").try_cast("timestamp_ntz")
            self.days[slot] = (F.unix_date(stamp.cast("date")).cast("bigint"), params.get("window_days", 7), params.get("tolerance", 0.5))
            self._line(spec, slot, "trend")
        else:
            if len(self.patterns[-1]) == CHECKS_PER_PASS:
                self.patterns.append([])
            self._line(spec, 1 - len(self.patterns), "row", len(self.patterns[-1]))
            self.patterns[-1].append(r.row_error(spec, self.as_of))

    def _entries(self) -> DataFrame:
        """Slot, key, pattern and side of every row, every parent, and one empty entry of every slot."""
        def entry(slot: int, key: Column | None = None, pattern: Column | None = None, newest: bool = False) -> Column:
            return F.struct(
                F.lit(slot).alias("slot"), (key if key is not None else F.lit(None).cast("binary")).alias("key"),
                (pattern if pattern is not None else F.lit(None).cast("bigint")).alias("pattern"),
                *[(c if newest else F.lit(None).cast("timestamp_ntz")).alias(f"newest{i}") for i, c in enumerate(self.loaded)])

        def bits(errors: list[Column]) -> Column:
            return reduce(Column.bitwiseOR, [F.when(e, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, e in enumerate(errors)],
                          F.lit(0).cast("bigint"))

        entries = [entry(-i, pattern=bits(errors), newest=i == 0) for i, errors in enumerate(self.patterns)]
        entries += [entry(slot, key=key) for slot, key in self.keys.items()]
        entries += [entry(slot, pattern=number) for slot, (number, _, _) in self.days.items()]
        rows = self.df.select(F.inline(F.array(*entries))).withColumn("child", F.lit(True))
        for side in self.sides:
            rows = rows.unionByName(side.withColumn("child", F.lit(False)), allowMissingColumns=True)
        slots = [(-i,) for i in range(len(self.patterns))] + [(s,) for s in (*self.keys, *self.days)]
        return rows.unionByName(literal_rows(self.df.sparkSession, slots, _SLOT), allowMissingColumns=True)

    def _totals(self) -> DataFrame:
        """Per slot and pattern (or day): rows, and what the keys of the slot add up to."""
        newest = [f"newest{i}" for i in range(len(self.loaded))]
        counted = self._entries().groupBy("slot", "key", "pattern").agg(
            F.count_if("child").alias("c"), F.count_if(~F.col("child")).alias("p"), *[F.max(c).alias(c) for c in newest])
        known, c = F.col("key").isNotNull(), F.col("c")

        def summed(value: Column, name: str) -> Column:
            return F.sum(F.when(known, value).otherwise(0)).alias(name)

        return counted.groupBy("slot", "pattern").agg(
            F.sum("c").alias("n"), F.count_if(known & (c > 0)).alias("distinct"), summed(c, "children"),
            summed(c * F.greatest("p", F.lit(1)), "joined"), summed(F.when(F.col("p") == 0, c).otherwise(0), "orphans"),
            *[F.max(x).alias(x) for x in newest])

    def _with_trend(self, totals: DataFrame) -> DataFrame:
        """Days with the rows of the days before them: each day hands its count on to those that follow.

        So days without rows appear as long as they follow one with rows within the
        window; later ones expect nothing and are no anomalies.
        """
        if not self.days:
            return totals.withColumns({"span": F.lit(None).cast("bigint"), "anomaly": F.lit(False)})
        is_day = F.col("slot").isin(list(self.days))
        window = reduce(lambda w, s: w.when(F.col("slot") == s, self.days[s][1]), self.days, F.when(F.lit(False), 0))
        tolerance = reduce(lambda w, s: w.when(F.col("slot") == s, self.days[s][2]), self.days, F.when(F.lit(False), 0.0))
        others = [x for x in totals.columns if x not in ("slot", "pattern", "n")]
        first = totals.withColumn("first", F.min(F.when(is_day, F.col("pattern"))).over(Window.partitionBy("slot")))
        steps = F.when(is_day & F.col("pattern").isNotNull(), F.sequence(F.lit(0), window)).otherwise(F.array(F.lit(0)))
        step = F.col("step")
        handed = first.select("*", F.explode(steps).alias("step")).groupBy(
            "slot", (F.col("pattern") + step).alias("pattern")).agg(
            F.sum(F.when(step == 0, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(step > 0, F.col("n")).otherwise(0)).alias("before"),
            F.max("first").alias("first"), *[F.max(F.when(step == 0, F.col(x))).alias(x) for x in others])
        today = F.unix_date(day(self.as_of))
        expected = F.col("before") / F.least(window, F.col("pattern") - F.col("first"))
        strays = F.abs(F.col("n") - expected) > expected * tolerance
        judged = is_day & (F.col("pattern") > F.col("first")) & (F.col("pattern") <= today)
        return handed.withColumns({
            "span": F.when(is_day, F.greatest(today - F.col("first") + 1, F.lit(0))).cast("bigint"),
            "anomaly": F.coalesce(F.when(judged, strays), F.lit(False))})

    def measured(self) -> DataFrame:
        totals = self._with_trend(self._totals())
        lines = literal_rows(self.df.sparkSession, self.lines, _LINES)
        n = F.col("n")
        hit = F.expr("shiftright(pattern, bit) & 1 = 1")
        sums = totals.join(F.broadcast(lines), "slot").groupBy("slot", "check_key", "measure", "bit", "bound", "error_message").agg(
            F.sum(F.when((F.col("measure") != "trend") | F.col("pattern").isNotNull(), n).otherwise(0)).alias("n"),
            F.sum(F.when(hit, n).otherwise(0)).alias("hits"), *[F.sum(x).alias(x) for x in ("distinct", "children", "joined", "orphans")],
            F.max("span").alias("span"), F.count_if("anomaly").alias("anomalies"),
            *[F.max(f"newest{i}").alias(f"newest{i}") for i in range(len(self.loaded))])
        measure = F.col("measure")
        limit = instant(self.as_of) - F.make_dt_interval(F.col("bound").cast("int"))
        newest = reduce(lambda w, i: w.when(F.col("bit") == i, F.col(f"newest{i}")), range(len(self.loaded)), F.when(F.lit(False), limit))
        total = (F.when(measure == "load_age", 1).when(measure == "children", F.col("children")).when(measure == "joined", F.col("joined"))
                 .when(measure == "trend", F.coalesce("span", F.lit(0))).when(measure == "none", 0).otherwise(F.col("n")))
        errors = (F.when(measure == "row", F.col("hits")).when(measure == "volume", (F.col("n") < F.col("bound")).cast("bigint"))
                  .when(measure == "load_age", F.when(newest >= limit, 0).otherwise(1))
                  .when(measure == "distinct", F.col("n") - F.col("distinct"))
                  .when(measure.isin("children", "joined"), F.col("orphans")).when(measure == "trend", F.col("anomalies")).otherwise(0))
        return sums.select("check_key", F.col("n").alias("rows_in_scope"), total.cast("bigint").alias("total_records"),
                           errors.cast("bigint").alias("invalid_records"), "error_message")


def unresolved(df: DataFrame, spec: RuleSpec) -> str | None:
    """Why a check cannot run on this frame, or None when it can."""
    if r.kind_of(spec) is None:
        return f"Rule {spec.rule_name} has no definition"
    present = {c.lower() for c in df.columns}
    absent = [c for c in spec.columns() if c.lower() not in present]
    if absent:
        return f"Column not found: {', '.join(absent)}"
    if r.CATALOGUE[spec.rule_name].level == "COLUMN" and not spec.column:
        return f"Rule {spec.rule_name} needs a column"
    setting = r.REQUIRED.get(spec.rule_name)
    if setting and not spec.params.get(setting):
        return f"Rule {spec.rule_name} needs the setting '{setting}'"
    if setting == "holds":
        try:
            df.select(F.expr(spec.params["holds"]).cast("boolean"))
        except AnalysisException as error:
            return f"Condition cannot be evaluated: {error.getCondition()}"
    return None


def evaluate(df: DataFrame, specs: Iterable[RuleSpec], as_of: AsOf,
             parents: ParentLookup | None = None) -> DataFrame:
    """Total and error counts per check, plus one row-count line for the frame.

    A foreign key counts each child with a key once; with ``count_joined_rows`` a child
    whose parent occurs twice counts twice.  A volume trend judges the days from the first
    with rows to that of ``as_of``, also those without any.
    """
    slots = _Slots(df, as_of)
    for spec in specs:
        slots.add(spec, parents)
    return slots.measured()


def child_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per foreign-key value, combined before any shuffle."""
    return df.groupBy(F.col(column).alias("fk")).agg(F.count(F.lit(1)).alias("children"))


def daily_volume(df: DataFrame, day_column: str, as_of: AsOf, window_days: int = 7,
                 tolerance: float = 0.5) -> DataFrame:
    """Rows of every calendar day, from the first with rows to ``as_of``'s, against the mean of the days before.

    A day is anomalous when it differs from that mean by more than ``tolerance`` (a
    fraction).  The mean is over ``window_days`` days, fewer at the start, with or without
    rows; each day hands its count on to those that follow, so no window runs over all days.
    Rows without a readable stamp belong to no day.
    """
    per_day = (
        df.groupBy(F.col(day_column).try_cast("timestamp_ntz").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("day").isNotNull())
    )
    handed = per_day.select("n", "day", F.explode(F.sequence(F.lit(0), F.lit(window_days))).alias("step")).groupBy(
        F.date_add("day", F.col("step")).alias("day")).agg(
        F.sum(F.when(F.col("step") == 0, F.col("n"))).alias("n"), F.sum(F.when(F.col("step") > 0, F.col("n"))).alias("before"))
    spine = per_day.agg(F.min("day").alias("first")).where(F.col("first") <= day(as_of)).select(
        "first", F.explode(F.sequence("first", day(as_of))).alias("day"))
    count = F.coalesce("n", F.lit(0))
    expected = F.when(F.col("day") > F.col("first"), F.coalesce("before", F.lit(0)) / F.least(
        F.lit(window_days), F.date_diff("day", "first")))
    return spine.join(handed, "day", "left").select(
        "day", count.alias("row_count"), expected.alias("expected_rows"),
        F.coalesce(F.abs(count - expected) > expected * tolerance, F.lit(False)).alias("is_anomaly"))


def rows_since_midnight(df: DataFrame, column: str, as_of: AsOf) -> DataFrame:
    """The incremental scope: rows stamped on ``as_of``'s day or later.

    The bound is a literal of the column's own type, so it reaches the file scan.
    """
    c = F.col(column)
    bound = start_of_day(as_of).cast(df.select(c).schema[0].dataType)
    return df.where(c.isNotNull() & (c >= bound))
