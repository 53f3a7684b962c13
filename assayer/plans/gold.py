"""Analytics over the typed tables.

Typed tables hold each business key once (the upsert sees to that), so measures
are aggregated per key before joining: no join multiplies rows, and a key that
owns much of a table is combined in the map tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import scoring
from assayer.functions.clock import AsOf, day

# Segment limits, largest first; below the last one the lowest label holds.
VOLUME_SEGMENTS = (("Premium", 100000), ("Gold", 50000), ("Silver", 10000))
ACTIVITY_LEVELS = (("High Activity", 100), ("Medium Activity", 20))
TENURE_LEVELS = (("Loyal", 365), ("Established", 90))


def _per_account(transaction: DataFrame) -> DataFrame:
    amount, kind = F.col("transaction_amount"), F.col("transaction_type")

    def total_of(label: str) -> Column:
        return F.sum(F.when(kind == label, amount).otherwise(0))

    return transaction.where("account_id IS NOT NULL").groupBy("account_id").agg(
        F.count(F.lit(1)).alias("tx_rows"), F.count("transaction_id").alias("tx"),
        F.sum(amount).alias("tx_sum"), F.count(amount).alias("tx_amounts"),
        F.max("transaction_date").alias("tx_last"),
        total_of("Deposit").alias("tx_deposits"), total_of("Withdrawal").alias("tx_withdrawals"))


def customer_360(customer: DataFrame, account: DataFrame, transaction: DataFrame, as_of: AsOf,
                 fan_out: bool = True) -> DataFrame:
    """Accounts and transactions per customer.

    With ``fan_out`` the balance total and the active-account count repeat each
    account once per transaction, as a plain three-way join would; without it every
    account counts once.
    """
    repeat = F.greatest(F.coalesce("tx_rows", F.lit(0)), F.lit(1)) if fan_out else F.lit(1)
    is_active = F.when(F.col("account_status") == "Active", 1).otherwise(0)
    per_customer = (
        account.where("customer_id IS NOT NULL")
        .select("account_id", "customer_id", "account_status", "opening_balance")
        .join(_per_account(transaction), "account_id", "left")
        .groupBy("customer_id").agg(
            F.count("account_id").alias("total_accounts"),
            F.sum(is_active * repeat).alias("active_accounts"),
            F.sum(F.col("opening_balance") * repeat.cast("decimal(18,0)"))
            .alias("total_opening_balance"),
            F.sum("tx").alias("total_transactions"),
            F.sum("tx_sum").alias("total_transaction_volume"),
            F.sum("tx_amounts").alias("tx_amounts"),
            F.max("tx_last").alias("last_transaction_date"))
    )
    today = day(as_of)
    return customer.join(per_customer, "customer_id", "left").select(
        "customer_id", "customer_name", "email", "dob",
        (F.year(today) - F.year("dob")).alias("age"), "phone", "kyc_status", "country",
        "created_date", F.datediff(today, F.col("created_date")).alias("customer_tenure_days"),
        F.coalesce("total_accounts", F.lit(0)).alias("total_accounts"),
        F.coalesce("active_accounts", F.lit(0)).alias("active_accounts"),
        "total_opening_balance",
        F.coalesce("total_transactions", F.lit(0)).alias("total_transactions"),
        "total_transaction_volume",
        F.try_divide(F.col("total_transaction_volume"), F.col("tx_amounts"))
        .alias("avg_transaction_amount"),
        "last_transaction_date", F.col("dq_score").alias("customer_dq_score"),
        F.col("is_valid").alias("customer_is_valid"), "load_timestamp", "updated_timestamp")


def _segment(c: Column, levels, lowest: str) -> Column:
    label = F.when(c >= levels[0][1], levels[0][0])
    for name, limit in levels[1:]:
        label = label.when(c >= limit, name)
    return label.otherwise(lowest)


def customer_segmentation(customers: DataFrame) -> DataFrame:
    """Segment, activity and tenure labels; a NULL measure falls to the lowest label."""
    return customers.select(
        "customer_id", "customer_name", "country", "kyc_status", "total_accounts",
        "total_transaction_volume",
        _segment(F.col("total_transaction_volume"), VOLUME_SEGMENTS, "Bronze")
        .alias("customer_segment"),
        _segment(F.col("total_transactions"), ACTIVITY_LEVELS, "Low Activity")
        .alias("activity_level"),
        _segment(F.col("customer_tenure_days"), TENURE_LEVELS, "New").alias("tenure_category"))


def latest_balance(daily_balance: DataFrame) -> DataFrame:
    """Newest closing balance per account, without sorting any account's history."""
    return daily_balance.groupBy("account_id").agg(
        F.max_by("closing_balance", "balance_date").alias("current_balance"))


def account_summary(account: DataFrame, customer: DataFrame, transaction: DataFrame,
                    daily_balance: DataFrame, as_of: AsOf) -> DataFrame:
    """Transaction totals and current balance per account."""
    def or_zero(c: str) -> Column:
        """0 for an account without transactions; NULL amounts stay NULL."""
        return F.when(F.col("tx_rows").isNull(), 0).otherwise(F.col(c))

    return (
        account.join(_per_account(transaction), "account_id", "left")
        .join(latest_balance(daily_balance), "account_id", "left")
        .join(customer.select("customer_id", "customer_name"), "customer_id", "left")
        .select(
            "account_id", "customer_id", "customer_name", "account_type", "account_status",
            "opening_balance", "opened_date",
            F.datediff(day(as_of), F.col("opened_date")).alias("account_age_days"),
            F.coalesce("tx", F.lit(0)).alias("total_transactions"),
            or_zero("tx_deposits").alias("total_deposits"),
            or_zero("tx_withdrawals").alias("total_withdrawals"),
            F.col("tx_sum").alias("net_transaction_amount"), "current_balance",
            F.col("dq_score").alias("account_dq_score"),
            F.col("is_valid").alias("account_is_valid"))
    )


def daily_transaction_summary(transaction: DataFrame) -> DataFrame:
    """Valid transactions per day and type."""
    amount = F.col("transaction_amount")
    return transaction.where("is_valid").groupBy("transaction_date", "transaction_type").agg(
        F.count("transaction_id").alias("transaction_count"),
        F.countDistinct("account_id").alias("unique_accounts"),
        F.sum(amount).alias("total_amount"), scoring.mean(amount).alias("avg_amount"),
        F.min(amount).alias("min_amount"), F.max(amount).alias("max_amount"),
        F.stddev_samp(amount.cast("double")).alias("stddev_amount"),
    ).orderBy(F.desc("transaction_date"), "transaction_type")


def transaction_trends(transaction: DataFrame) -> DataFrame:
    """Valid transactions per month and type."""
    amount = F.col("transaction_amount")
    month = F.trunc("transaction_date", "MM")
    return transaction.where("is_valid").groupBy(month.alias("month"), "transaction_type").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum(amount).alias("total_volume"),
        scoring.mean(amount).alias("avg_transaction_size"),
        F.countDistinct("account_id").alias("active_accounts"),
    ).orderBy(F.desc("month"), "transaction_type")


def quality_scorecard(tables: dict[str, DataFrame]) -> DataFrame:
    """Validity counts and mean score of each typed table."""
    lines = []
    for entity, df in tables.items():
        n, valid = F.count(F.lit(1)), F.count_if("is_valid")
        lines.append(df.agg(
            n.alias("total_records"), valid.alias("valid_records"),
            F.count_if(~F.col("is_valid")).alias("invalid_records"),
            scoring.rounded_mean(F.col("dq_score")).alias("avg_dq_score"),
            scoring.share(valid, n).alias("validity_percentage"),
        ).select(F.lit(entity.upper()).alias("entity_type"), "*"))
    return reduce(DataFrame.unionByName, lines)


def quality_issues(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Invalid rows of several tables, newest first.

    Rows of one load share a timestamp; the entity and its id extend the order so
    that the sort can spread them.
    """
    lines = [df.where(~F.col("is_valid")).select(
        F.lit(entity.upper()).alias("entity_type"), F.col(key).alias("entity_id"),
        F.col(name).alias("entity_name"), "dq_score", "validation_errors", "load_timestamp")
        for entity, (df, key, name) in tables.items()]
    return reduce(DataFrame.unionByName, lines).orderBy(
        F.desc("load_timestamp"), "entity_type", "entity_id")


def executive_dashboard(customer: DataFrame, account: DataFrame, transaction: DataFrame,
                        as_of: AsOf) -> DataFrame:
    """Headline figures as one row, each table read once."""
    valid = F.col("is_valid")
    lines = [
        customer.agg(
            F.count_if(valid).alias("total_customers"),
            F.count_if(F.col("kyc_status") == "Verified").alias("verified_customers"),
            scoring.mean(F.col("dq_score")).alias("avg_customer_dq_score")),
        account.agg(
            F.count_if(valid).alias("total_accounts"),
            F.count_if(F.col("account_status") == "Active").alias("active_accounts"),
            F.sum(F.when(valid, F.col("opening_balance"))).alias("total_deposits"),
            scoring.mean(F.col("dq_score")).alias("avg_account_dq_score")),
        transaction.agg(
            F.count_if(valid).alias("total_transactions"),
            F.sum(F.when(valid, F.col("transaction_amount"))).alias("total_transaction_volume"),
            scoring.mean(F.when(valid, F.col("transaction_amount")))
            .alias("avg_transaction_amount"),
            scoring.mean(F.col("dq_score")).alias("avg_transaction_dq_score")),
    ]
    # Three rows with disjoint columns; the maximum of each column is its only value.
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lines)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns]).withColumn(
        "report_generated_at", F.lit(str(as_of)).cast("timestamp_ntz"))
