"""Registration of queries and helpers shared by them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.sources.tables import shared_dir
from workload.staging import duck_cte

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL counterpart where one is practical."""
    def add(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(run(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def _plain(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.DecimalType):
        return (c.cast("double") if kind.scale else c.cast("bigint")).alias(field.name)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("string").alias(field.name)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("bigint").alias(field.name)
    if isinstance(kind, T.ArrayType):
        return F.array_join(c, "; ").alias(field.name)
    return c


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for queries that write files and read them back."""
    return f"{shared_dir(spark)}/workload-{name}-{uuid.uuid4().hex}"


def plain(df: DataFrame) -> DataFrame:
    """Result columns as text, whole numbers, doubles and booleans."""
    return df.select(*[_plain(f) for f in df.schema.fields])


def ctes(tables: Iterable[str], body: str, *more: str) -> str:
    """``body`` over derived tables and further named subqueries."""
    return "WITH " + ",\n".join([*[duck_cte(t) for t in tables], *more]) + "\n" + body


def half_up(total: str, count: str) -> str:
    """Mean of whole hundredths, rounded half up to hundredths, as a double."""
    s, n = f"CAST({total} AS BIGINT)", f"CAST({count} AS BIGINT)"
    return f"(CAST((2 * {s} + {n}) // (2 * {n}) AS DOUBLE) / 100)"


def mean_of(total: str, count: str) -> str:
    """An amount over a count, rounded half away from zero to hundredths, as a double."""
    s, n = f"CAST({total} * 100 AS BIGINT)", f"CAST({count} AS BIGINT)"
    return (f"(CASE WHEN {n} > 0 THEN sign({s}) * ((2 * abs({s}) + {n}) // (2 * {n})) "
            f"/ CAST(100 AS DOUBLE) END)")


def mean_money(c: str) -> str:
    """Mean of an amount, rounded half away from zero to hundredths, as a double."""
    return mean_of(f"sum({c})", f"count({c})")


def percent(part: str, whole: str) -> str:
    """Share in percent, rounded half up to hundredths; NULL for an empty whole."""
    p, w = f"CAST({part} AS BIGINT)", f"CAST({whole} AS BIGINT)"
    return (f"(CASE WHEN {w} > 0 THEN CAST(({p} * 20000 + {w}) // (2 * {w}) AS DOUBLE) / 100 END)")


def change(current: str, previous: str) -> str:
    """Relative change in percent of two scores in hundredths, half away from zero.

    NULL when the previous score is zero.
    """
    diff, base = f"({current} - {previous})", f"nullif({previous}, 0)"
    return (f"(sign({diff}) * ((2 * abs({diff}) * 10000 + {base}) // (2 * {base})) "
            f"/ CAST(100 AS DOUBLE))")


def cents(c: str) -> str:
    return f"CAST({c} * 100 AS BIGINT)"
