"""Landing delimited and JSON files as raw text tables with audit columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer import schemas
from assayer.functions.clock import AsOf, batch_id, instant

# Texts that stand for NULL in a landing file.
NULL_TOKENS = ("NULL", "null", "", "N/A", "NA", "n/a", "-")
CORRUPT = "_corrupt"


def null_tokens_to_null(c: Column) -> Column:
    """Trim and turn every null token into NULL."""
    trimmed = F.trim(c)
    return F.when(~trimmed.isin(*NULL_TOKENS), trimmed)


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
             quoted_lines: bool = False) -> DataFrame:
    """Raw parse in file order; a row of another width keeps its text in ``_corrupt``.

    With ``quoted_lines`` a quoted field may hold line breaks.  A file is then one task, as
    a split could begin inside quotes, so land such data as many files.  Without it files
    are split, and a record with such a break shows as torn lines among the load errors.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    return (
        spark.read.schema(wide)
        .option("header", True).option("sep", ",").option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", quoted_lines)
        .option("enforceSchema", True)
        # A parser that skips unused fields cannot tell that a row has another width.
        .option("columnPruning", False)
        .csv(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def split_by_width(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the declared width, and the others."""
    return scan.where(F.col(CORRUPT).isNull()), scan.where(F.col(CORRUPT).isNotNull())


def land(scan: DataFrame, columns: Sequence[str], as_of: AsOf,
         batch: Column | None = None) -> DataFrame:
    """Table-order projection with null tokens resolved and audit columns added."""
    return scan.select(
        *[null_tokens_to_null(F.col(c)).alias(c) for c in columns],
        instant(as_of).alias("load_timestamp"),
        F.col("source_file"),
        (batch if batch is not None else batch_id(as_of)).alias("load_batch_id"),
    )


def read_bronze(spark: SparkSession, entity: str, path: str | Sequence[str], as_of: AsOf,
                skip_bad_rows: bool = False, quoted_lines: bool = False) -> DataFrame:
    """Land one entity's files.

    Rows with too few or too many fields are kept (missing fields NULL, surplus
    ignored) unless ``skip_bad_rows``; either way reading continues past them.
    """
    file_schema = schemas.BRONZE_FILES[entity]
    order = schemas.BRONZE_TABLE_ORDER.get(entity, tuple(file_schema.names))
    scan = scan_csv(spark, path, file_schema, quoted_lines)
    if skip_bad_rows:
        scan, _ = split_by_width(scan)
    return land(scan, order, as_of)


def load_errors(scan: DataFrame) -> DataFrame:
    """Rows parsed and rows of a wrong width per file, with one example text.

    The first field is counted too: the reader refuses scans that need nothing but
    the text of broken rows.
    """
    return scan.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_parsed"),
        F.count(scan.columns[0]).alias("rows_with_first_field"),
        F.count(CORRUPT).alias("error_count"),
        F.min(CORRUPT).alias("first_error"),
    )


def read_json(spark: SparkSession, path: str | Sequence[str],
              schema: T.StructType | None = None, document_per_file: bool = False) -> DataFrame:
    """JSON files; an outer array is stripped to one row per element.

    A document per line lets Spark split large files; ``document_per_file`` reads a
    whole file as one document.
    """
    reader = spark.read.option("multiLine", document_per_file).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).json(path)


@dataclass
class JsonLanding:
    """Landed JSON lines: the elements that could be read, and the lines that could not."""

    elements: DataFrame
    rejects: DataFrame


def land_json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, as_of: AsOf) -> JsonLanding:
    """JSON lines as typed rows with audit columns; an outer array is stripped to a row per element.

    A line is rejected as a whole, with its reason, if its bytes are not UTF-8 or if it is
    no JSON object or array; the text of a reject has the bad bytes replaced.  Blank lines
    are passed over.  A field of another type than declared is NULL, its line is kept.
    """
    line = F.col("value")
    lines = spark.read.text(path).where(F.trim(line) != "").select(
        line, F.col("_metadata.file_path").alias("source_file"), F.is_valid_utf8(line).alias("readable"))
    wrapped = T.ArrayType(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
    parsed = F.from_json(F.when(F.col("readable"), line), wrapped, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    shaped = F.trim(line).rlike(r"^[\[{]")
    broken = ~shaped | F.coalesce(F.exists("elements", lambda e: e[CORRUPT].isNotNull() & F.forall(
        F.array(*[e[n] for n in schema.names]), lambda v: v.isNull())), F.lit(True))
    read = lines.withColumn("elements", parsed).withColumn("reason", F.when(
        ~F.col("readable"), "INVALID_UTF8").when(broken, "MALFORMED_JSON"))
    audit = [instant(as_of).alias("load_timestamp"), F.col("source_file"), batch_id(as_of).alias("load_batch_id")]
    elements = read.where("reason IS NULL").select(F.inline("elements"), *audit).drop(CORRUPT)
    rejects = read.where("reason IS NOT NULL").select(F.make_valid_utf8(line).alias("text"), "reason", *audit)
    return JsonLanding(elements, rejects)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and modification time of the files below a landing folder."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length", "modificationTime"))


def load_stats(df: DataFrame, table_name: str) -> DataFrame:
    """Rows, batches and load interval of one landed table."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_loaded"),
        F.countDistinct("load_batch_id").alias("batch_count"),
        F.min("load_timestamp").alias("first_load"),
        F.max("load_timestamp").alias("last_load"),
    ).select(F.lit(table_name).alias("table_name"), "*")


def load_summary(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows, distinct keys and batches of every landed table.

    A key of several columns counts as their concatenation, so a NULL part drops
    the row from the distinct count.  Keys are grouped before they are counted;
    the number of batches comes from the same grouping.
    """
    lines = []
    for name, (df, key) in tables.items():
        per_key = df.groupBy(F.concat(*[F.col(c) for c in key]).alias("k")).agg(
            F.count(F.lit(1)).alias("n"))
        keys = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
                           F.count("k").alias("unique_keys"))
        batches = df.agg(F.countDistinct("load_batch_id").alias("batch_count"))
        both = keys.unionByName(batches, allowMissingColumns=True)
        lines.append(both.agg(*[F.max(c).alias(c) for c in
                                ("total_rows", "unique_keys", "batch_count")])
                     .select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, lines).orderBy("table_name")


def labelled_sample(df: DataFrame, label: str, key: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows of a table by its key, under a label."""
    return df.orderBy(*key).limit(rows).select(F.lit(label).alias("dataset"), "*")
