"""Landing, load statistics, cleansing and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer import schemas
from assayer.functions.clock import start_of_day
from assayer.operators.cleanse import cleanse, latest_per_key
from assayer.operators.upsert import (
    replace_by_key, upsert, upsert_counts, with_surrogate_keys,
)
from assayer.sources import bronze, tables
from workload.base import ctes, fresh_dir, query
from workload.silver import ENTITIES, silver, silver_sql
from workload.staging import AS_OF, derived, source

BATCH = "BATCH_20240130_120000"
STAGED = {e: f"stg_{e}" for e in ENTITIES}
KEYS = {"customer": ["customer_id"], "account": ["account_id"],
        "transaction": ["transaction_id"], "daily_balance": ["account_id", "balance_date"],
        "fx_rate": ["currency_code", "rate_date"]}
TOKENS = "('NULL','null','','N/A','NA','n/a','-')"


def _written_csv(spark: SparkSession, sf_dir: str, entity: str, defects: dict) -> str:
    """The entity's rows as delimited files, some values replaced by null tokens."""
    names = schemas.BRONZE_FILES[entity].names
    df = derived(spark, sf_dir, f"stg_{entity}")
    path = fresh_dir(spark, entity)
    (df.select(*[defects.get(c, F.col(c)).alias(c) for c in names])
     .write.option("header", True).option("emptyValue", "").csv(path))
    return path


_CUSTOMER_NAMES = schemas.BRONZE_FILES["customer"].names


@query("csv_bronze_customer", ctes(["stg_customer"], f"""
SELECT {', '.join(f"CASE WHEN trim({c}) NOT IN {TOKENS} THEN trim({c}) END AS {c}"
                  for c in _CUSTOMER_NAMES if c not in ('phone', 'country'))},
       CASE WHEN phone = '12345' THEN NULL ELSE phone END AS phone,
       CASE WHEN country = 'India' THEN NULL ELSE country END AS country,
       '{AS_OF}' AS load_timestamp, '{BATCH}' AS load_batch_id, TRUE AS has_source_file
FROM stg_customer"""))
def csv_bronze_customer(spark, sf_dir):
    """Landing of delimited files: trimming, null tokens, audit columns."""
    path = _written_csv(spark, sf_dir, "customer", {
        "phone": F.when(F.col("phone") == "12345", "N/A").otherwise(F.col("phone")),
        "country": F.when(F.col("country") == "India", " - ").otherwise(F.col("country"))})
    landed = bronze.read_bronze(spark, "customer", path, AS_OF)
    return landed.withColumn("has_source_file", F.col("source_file").endswith(".csv")).drop(
        "source_file")


@query("csv_fx_reorder", ctes(["stg_fx_rate"], f"""
SELECT currency_code, rate_date, fx_rate_to_usd, '{BATCH}' AS load_batch_id FROM stg_fx_rate"""))
def csv_fx_reorder(spark, sf_dir):
    """File order differs from table order."""
    path = _written_csv(spark, sf_dir, "fx_rate", {})
    return bronze.read_bronze(spark, "fx_rate", path, AS_OF).drop("source_file", "load_timestamp")


def _ragged(spark: SparkSession, sf_dir: str) -> str:
    """Transaction lines, refunds with a surplus field and payments with a missing one."""
    df = derived(spark, sf_dir, "stg_transaction")
    fields = [F.coalesce(c, F.lit("")) for c in schemas.BRONZE_FILES["transaction"].names]
    line = (F.when(F.col("transaction_type") == "Refund", F.concat_ws(",", *fields, F.lit("x")))
            .when(F.col("transaction_type") == "Payment", F.concat_ws(",", *fields[:-1]))
            .otherwise(F.concat_ws(",", *fields)))
    header = ",".join(schemas.BRONZE_FILES["transaction"].names)
    path = fresh_dir(spark, "ragged")
    df.select(line.alias(header)).write.option("header", True).option("quote", "").csv(
        path, sep="\u0001")
    return path


@query("csv_load_errors", ctes(["stg_transaction"], """
SELECT CAST(count(*) AS BIGINT) AS rows_parsed,
       CAST(count(*) FILTER (WHERE transaction_type IN ('Refund', 'Payment')) AS BIGINT)
         AS error_count, CAST(count(transaction_id) AS BIGINT) AS with_id
FROM stg_transaction"""))
def csv_load_errors(spark, sf_dir):
    """Audit of rows whose width differs from the declared one."""
    scan = bronze.scan_csv(spark, _ragged(spark, sf_dir), schemas.BRONZE_FILES["transaction"])
    return bronze.load_errors(scan).agg(F.sum("rows_parsed").alias("rows_parsed"),
                                        F.sum("error_count").alias("error_count"),
                                        F.sum("rows_with_first_field").alias("with_id"))


@query("csv_skip_bad_rows", ctes(["stg_transaction"], """
SELECT transaction_id, account_id, transaction_type, transaction_amount, transaction_date
FROM stg_transaction WHERE transaction_type NOT IN ('Refund', 'Payment')"""))
def csv_skip_bad_rows(spark, sf_dir):
    """A load that skips malformed rows and continues."""
    landed = bronze.read_bronze(spark, "transaction", _ragged(spark, sf_dir), AS_OF,
                                skip_bad_rows=True)
    return landed.drop("load_timestamp", "source_file", "load_batch_id")


@query("csv_tolerate_ragged_rows", ctes(["stg_transaction"], """
SELECT transaction_id, account_id, transaction_type, transaction_amount,
       CASE WHEN transaction_type = 'Payment' THEN NULL ELSE transaction_date END
         AS transaction_date
FROM stg_transaction"""))
def csv_tolerate_ragged_rows(spark, sf_dir):
    """A load that keeps rows of another width."""
    landed = bronze.read_bronze(spark, "transaction", _ragged(spark, sf_dir), AS_OF)
    return landed.drop("load_timestamp", "source_file", "load_batch_id")


@query("json_scan", """
SELECT event_type, CAST(count(*) AS BIGINT) AS row_count,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM events
GROUP BY event_type""")
def json_scan(spark, sf_dir):
    """JSON documents whose outer array is stripped."""
    path = fresh_dir(spark, "json")
    events = source(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    events.select(F.to_json(F.array(F.struct("event_id", "event_type", "value"))).alias("value")
                  ).write.text(path)
    scanned = bronze.read_json(spark, path, T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType())]))
    return scanned.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("value").cast("decimal(18,2)")).alias("total_value"))


@query("load_append_batches", ctes(["stg_account"], """
SELECT batch AS load_batch_id, CAST(count(*) AS BIGINT) AS row_count,
       CAST(count(DISTINCT account_id) AS BIGINT) AS unique_keys
FROM stg_account, (VALUES ('BATCH_A'), ('BATCH_B')) batches(batch) GROUP BY batch"""))
def load_append_batches(spark, sf_dir):
    """Loading the same rows twice appends a second batch."""
    path = fresh_dir(spark, "batches")
    df = derived(spark, sf_dir, "stg_account").drop("load_batch_id")
    for batch in ("BATCH_A", "BATCH_B"):
        tables.append(df.withColumn("load_batch_id", F.lit(batch)), path, "load_batch_id",
                      ("account_id",))
    return spark.read.parquet(path).groupBy("load_batch_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("account_id").alias("unique_keys"))


@query("replace_partitions", ctes(["stg_account"], """
SELECT load_batch_id, CAST(count(*) AS BIGINT) AS row_count,
       CAST(count(*) FILTER (WHERE load_batch_id = 'BATCH_F') AS BIGINT) AS replaced
FROM stg_account GROUP BY load_batch_id"""))
def replace_partitions(spark, sf_dir):
    """Truncate-and-reload of single partitions leaves the others alone."""
    path = fresh_dir(spark, "partitions")
    df = derived(spark, sf_dir, "stg_account").withColumn("version", F.lit(1))
    tables.overwrite(df, path, "load_batch_id")
    again = df.where("load_batch_id = 'BATCH_F'").withColumn("version", F.lit(2))
    tables.replace_partitions(again, path, "load_batch_id")
    return spark.read.parquet(path).groupBy("load_batch_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("version") == 2).alias("replaced"))


@query("file_listing", """
SELECT CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS segments, TRUE AS all_sized
FROM customer""")
def file_listing(spark, sf_dir):
    """Listing of a landing folder with one sub-folder per market segment."""
    path = fresh_dir(spark, "listing")
    source(spark, sf_dir, "customer").write.partitionBy(
        "c_mktsegment").csv(path)
    listed = bronze.list_files(spark, path)
    folder = F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1)
    return listed.where(F.col("path").contains("c_mktsegment=")).agg(
        F.countDistinct(folder).alias("segments"),
        (F.min("length") > 0).alias("all_sized"))


def _stats_sql(entity: str) -> str:
    return f"""SELECT 'STG_{entity.upper()}' AS table_name, CAST(count(*) AS BIGINT) AS rows_loaded,
       CAST(count(DISTINCT load_batch_id) AS BIGINT) AS batch_count,
       CAST(min(load_timestamp) AS VARCHAR) AS first_load,
       CAST(max(load_timestamp) AS VARCHAR) AS last_load FROM stg_{entity}"""


@query("load_stats", ctes(STAGED.values(), " UNION ALL ".join(_stats_sql(e) for e in ENTITIES)))
def load_stats(spark, sf_dir):
    out = None
    for entity, name in STAGED.items():
        line = bronze.load_stats(derived(spark, sf_dir, name), name.upper())
        out = line if out is None else out.unionByName(line)
    return out


def _summary_sql(entity: str) -> str:
    return f"""SELECT 'STG_{entity.upper()}' AS table_name, CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(DISTINCT {' || '.join(KEYS[entity])}) AS BIGINT) AS unique_keys,
       CAST(count(DISTINCT load_batch_id) AS BIGINT) AS batch_count FROM stg_{entity}"""


@query("load_summary_union",
       ctes(STAGED.values(), " UNION ALL ".join(_summary_sql(e) for e in ENTITIES)))
def load_summary_union(spark, sf_dir):
    return bronze.load_summary({name.upper(): (derived(spark, sf_dir, name), KEYS[e])
                                for e, name in STAGED.items()})


@query("labelled_sample", ctes(["stg_account"], """
SELECT 'ACCOUNT SAMPLE' AS dataset, account_id, customer_id, account_type, account_status,
       opening_balance, opened_date
FROM stg_account ORDER BY account_id NULLS FIRST, opening_balance NULLS FIRST LIMIT 5"""))
def labelled_sample(spark, sf_dir):
    """The first five rows of a landed table by its key, under a label."""
    return bronze.labelled_sample(
        derived(spark, sf_dir, "stg_account"), "ACCOUNT SAMPLE", ["account_id", "opening_balance"]).select(
        "dataset", "account_id", "customer_id", "account_type", "account_status", "opening_balance",
        "opened_date")


@query("counts_since_midnight", ctes(["stg_customer", "stg_account", "stg_transaction"],
       " UNION ALL ".join(f"""SELECT 'STG_{e.upper()}' AS table_name,
       CAST(count(*) AS BIGINT) AS row_count FROM stg_{e}
       WHERE load_timestamp >= TIMESTAMP '2024-01-30 00:00:00'"""
                          for e in ("customer", "account", "transaction"))))
def counts_since_midnight(spark, sf_dir):
    return tables.counts_since(
        {f"STG_{e.upper()}": derived(spark, sf_dir, f"stg_{e}")
         for e in ("customer", "account", "transaction")}, "load_timestamp", start_of_day(AS_OF))


@query("watermark_audit", ctes(["stg_transaction"], """
SELECT CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(CASE WHEN load_timestamp >= TIMESTAMP '2024-01-30 00:00:00' THEN 1 END) AS BIGINT)
         AS today_rows,
       CAST(min(load_timestamp) AS VARCHAR) AS earliest_load,
       CAST(max(load_timestamp) AS VARCHAR) AS latest_load
FROM stg_transaction"""))
def watermark_audit(spark, sf_dir):
    return tables.watermark_audit(derived(spark, sf_dir, "stg_transaction"), "load_timestamp",
                                  start_of_day(AS_OF))


@query("safe_casts", ctes(["stg_transaction", "stg_account", "stg_fx_rate"], """
SELECT transaction_amount AS raw,
       CAST(TRY_CAST(transaction_amount AS DECIMAL(18,2)) AS DOUBLE) AS money,
       CAST(TRY_CAST(transaction_amount AS DECIMAL(38,0)) AS BIGINT) AS whole,
       CAST(CAST(try_strptime(transaction_date, '%Y-%m-%d') AS DATE) AS VARCHAR) AS day
FROM stg_transaction
UNION ALL SELECT opening_balance, CAST(TRY_CAST(opening_balance AS DECIMAL(18,2)) AS DOUBLE),
       CAST(TRY_CAST(opening_balance AS DECIMAL(38,0)) AS BIGINT),
       CAST(CAST(try_strptime(opened_date, '%Y-%m-%d') AS DATE) AS VARCHAR) FROM stg_account
UNION ALL SELECT fx_rate_to_usd, CAST(TRY_CAST(fx_rate_to_usd AS DECIMAL(18,2)) AS DOUBLE),
       CAST(TRY_CAST(fx_rate_to_usd AS DECIMAL(38,0)) AS BIGINT),
       CAST(CAST(try_strptime(rate_date, '%Y-%m-%d') AS DATE) AS VARCHAR) FROM stg_fx_rate"""))
def safe_casts(spark, sf_dir):
    """Parsing of raw text to money, whole numbers and dates."""
    out = None
    for table, amount, day in (("stg_transaction", "transaction_amount", "transaction_date"),
                               ("stg_account", "opening_balance", "opened_date"),
                               ("stg_fx_rate", "fx_rate_to_usd", "rate_date")):
        c = F.col(amount)
        part = derived(spark, sf_dir, table).select(
            c.alias("raw"), c.try_cast("decimal(18,2)").alias("money"),
            c.try_cast("decimal(38,0)").alias("whole"),
            F.try_to_date(F.col(day), "yyyy-MM-dd").alias("day"))
        out = part if out is None else out.unionByName(part)
    return out


def _register_cleanse(entity: str) -> None:
    body = (f"SELECT * REPLACE (" + ", ".join(
        f"CAST({c} AS {'VARCHAR' if kind == 'd' else 'DOUBLE'}) AS {c}"
        for c, kind in {"customer": {"dob": "d", "created_date": "d"},
                        "account": {"opened_date": "d", "opening_balance": "n"},
                        "transaction": {"transaction_date": "d", "transaction_amount": "n"},
                        "daily_balance": {"balance_date": "d", "closing_balance": "n"},
                        "fx_rate": {"rate_date": "d", "fx_rate_to_usd": "n"}}[entity].items())
            + f") FROM silver_{entity}")

    @query(f"cleanse_{entity}", ctes([f"stg_{entity}"], body, silver_sql(entity)))
    def run(spark, sf_dir):
        return silver(spark, sf_dir, entity).drop("updated_timestamp")


for _entity in ENTITIES:
    _register_cleanse(_entity)

LATER = "2024-02-01 08:00:00"


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A typed customer table of older rows, and a load that overlaps it."""
    blank = F.col("customer_id").like(" %")
    staged = derived(spark, sf_dir, "stg_customer").withColumn("customer_id", F.when(
        blank, F.concat("customer_id", "customer_name")).otherwise(F.col("customer_id")))  # so that each key occurs once
    old = cleanse(staged.where("load_timestamp < TIMESTAMP_NTZ '2024-01-20 00:00:00'"),
                  "customer", AS_OF)
    new = cleanse(staged.where("load_timestamp > TIMESTAMP_NTZ '2024-01-15 00:00:00'")
                  .withColumn("phone", F.when(F.col("phone").rlike("^.{5}$"), None)
                              .otherwise(F.lit("+00-555-0000"))), "customer", LATER)
    return old, new


_UPSERT_SQL = f"""
FROM (SELECT * REPLACE (CASE WHEN customer_id LIKE ' %' THEN customer_id || customer_name ELSE customer_id END AS customer_id)
      FROM stg_customer) named WHERE customer_id IS NOT NULL"""


@query("upsert_customer", ctes(["stg_customer"], f"""
SELECT customer_id, email,
       CASE WHEN load_timestamp > TIMESTAMP '2024-01-15 00:00:00'
            THEN CASE WHEN length(phone) = 5 THEN NULL
                      ELSE '+00-555-0000' END ELSE phone END AS phone,
       CASE WHEN load_timestamp < TIMESTAMP '2024-01-20 00:00:00' THEN '{AS_OF}'
            ELSE '{LATER}' END AS load_timestamp,
       CASE WHEN load_timestamp > TIMESTAMP '2024-01-15 00:00:00' THEN '{LATER}'
            ELSE '{AS_OF}' END AS updated_timestamp {_UPSERT_SQL}"""))
def upsert_customer(spark, sf_dir):
    """Matched rows take new values, unmatched ones are inserted or kept."""
    old, new = _versions(spark, sf_dir)
    return upsert(old, new, ["customer_id"]).select(
        "customer_id", "email", "phone", "load_timestamp", "updated_timestamp")


@query("upsert_row_counts", ctes(["stg_customer"], f"""
SELECT CAST(count(*) FILTER (WHERE load_timestamp >= TIMESTAMP '2024-01-20 00:00:00') AS BIGINT)
         AS rows_inserted,
       CAST(count(*) FILTER (WHERE load_timestamp > TIMESTAMP '2024-01-15 00:00:00'
            AND load_timestamp < TIMESTAMP '2024-01-20 00:00:00') AS BIGINT) AS rows_updated
{_UPSERT_SQL}"""))
def upsert_row_counts(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return upsert_counts(old, new, ["customer_id"])


@query("replace_by_key", ctes(["stg_customer"], f"""
SELECT CASE WHEN load_timestamp > TIMESTAMP '2024-01-15 00:00:00' THEN '{LATER}'
            ELSE '{AS_OF}' END AS load_timestamp, CAST(count(*) AS BIGINT) AS row_count
{_UPSERT_SQL} GROUP BY 1"""))
def replace_rows_by_key(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return replace_by_key(old, new, ["customer_id"]).groupBy("load_timestamp").agg(
        F.count(F.lit(1)).alias("row_count"))


@query("surrogate_keys", ctes(["stg_transaction"], """
SELECT transaction_id, CAST(1000 + row_number() OVER (
         ORDER BY substr(md5(transaction_id), 1, 3), transaction_id) AS BIGINT) AS transaction_key
FROM (SELECT DISTINCT transaction_id FROM stg_transaction) ids"""))
def surrogate_keys(spark, sf_dir):
    """Gap-free numbering of new keys after the highest existing one."""
    ids = derived(spark, sf_dir, "stg_transaction").select("transaction_id").distinct()
    return with_surrogate_keys(ids, ["transaction_id"], "transaction_key", 1000)


@query("latest_per_key", ctes(["stg_transaction"], """
SELECT transaction_id, CAST(load_timestamp AS VARCHAR) AS load_timestamp, transaction_amount
FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
             ORDER BY load_timestamp DESC NULLS LAST, transaction_amount DESC NULLS LAST) AS rn
      FROM stg_transaction) ranked WHERE rn = 1"""))
def newest_per_key(spark, sf_dir):
    staged = derived(spark, sf_dir, "stg_transaction")
    return latest_per_key(staged, ["transaction_id"], "load_timestamp", ["transaction_amount"]
                          ).select("transaction_id", "load_timestamp", "transaction_amount")
