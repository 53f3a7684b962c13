"""Landing text to typed rows with validity flag, score and error list.

Each entity is a declaration: typed columns, hard conditions that invalidate a
row, weighted conditions that add to its score, and messages.  One projection
evaluates all of it, so cleansing is a narrow, codegen-only pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import predicates as p
from assayer.functions.clock import AsOf, instant

# Enumerations and the date pattern of the typed layer.
KYC_STATUSES = ("Verified", "Pending", "Rejected", "Incomplete")
ACCOUNT_TYPES = ("Savings", "Checking", "Credit", "Investment")
ACCOUNT_STATUSES = ("Active", "Inactive", "Closed", "Frozen")
TRANSACTION_TYPES = ("Deposit", "Withdrawal", "Transfer", "Payment")
DATE_PATTERN = "yyyy-MM-dd"


@dataclass(frozen=True)
class CleanseSpec:
    """How one entity is typed and judged; all columns refer to the landing table."""

    entity: str
    keys: tuple[str, ...]
    columns: dict[str, Column]
    invalid: tuple[Column, ...]
    score: tuple[tuple[int, Column], ...]
    messages: tuple[tuple[Column, str], ...]


def _date(name: str) -> Column:
    return F.try_to_date(F.col(name), DATE_PATTERN)


def _number(name: str, precision: int, scale: int) -> Column:
    return F.col(name).try_cast(f"decimal({precision},{scale})")


def _raw(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def customer_spec() -> CleanseSpec:
    email = F.col("email")
    no_id, bad_dob = p.is_blank(F.col("customer_id")), _date("dob").isNull()
    bad_email = email.isNull() | p.not_email(email)
    return CleanseSpec(
        "customer", ("customer_id",),
        {**_raw("customer_id", "customer_name", "email"), "dob": _date("dob"),
         **_raw("phone", "kyc_status", "country"), "created_date": _date("created_date")},
        invalid=(no_id, bad_dob, bad_email),
        score=((20, ~no_id), (15, F.col("customer_name").isNotNull()), (20, ~bad_email),
               (15, ~bad_dob), (10, F.col("phone").isNotNull()),
               (10, F.col("kyc_status").isin(*KYC_STATUSES)), (10, F.col("country").isNotNull())),
        messages=((no_id, "Missing customer_id"), (bad_dob, "Invalid date of birth"),
                  (bad_email, "Invalid email format"),
                  (~F.col("kyc_status").isin(*KYC_STATUSES), "Invalid KYC status")),
    )


def account_spec() -> CleanseSpec:
    no_id, no_owner = p.is_blank(F.col("account_id")), p.is_blank(F.col("customer_id"))
    balance = _number("opening_balance", 18, 2)
    kind, status = F.col("account_type"), F.col("account_status")
    return CleanseSpec(
        "account", ("account_id",),
        {**_raw("account_id", "customer_id", "account_type", "account_status"),
         "opening_balance": balance, "opened_date": _date("opened_date")},
        invalid=(no_id, no_owner, balance.isNull()),
        score=((25, ~no_id), (25, ~no_owner), (15, kind.isin(*ACCOUNT_TYPES)),
               (15, status.isin(*ACCOUNT_STATUSES)), (20, balance.isNotNull())),
        messages=((no_id, "Missing account_id"), (no_owner, "Missing customer_id"),
                  (balance.isNull(), "Invalid opening_balance"),
                  (~kind.isin(*ACCOUNT_TYPES), "Invalid account_type"),
                  (~status.isin(*ACCOUNT_STATUSES), "Invalid account_status")),
    )


def transaction_spec() -> CleanseSpec:
    no_id, no_account = p.is_blank(F.col("transaction_id")), p.is_blank(F.col("account_id"))
    amount, when = _number("transaction_amount", 18, 2), _date("transaction_date")
    kind = F.col("transaction_type")
    return CleanseSpec(
        "transaction", ("transaction_id",),
        {**_raw("transaction_id", "account_id", "transaction_type"),
         "transaction_amount": amount, "transaction_date": when},
        invalid=(no_id, no_account, amount.isNull(), when.isNull()),
        score=((25, ~no_id), (25, ~no_account), (15, kind.isin(*TRANSACTION_TYPES)),
               (20, amount.isNotNull()), (15, when.isNotNull())),
        messages=((no_id, "Missing transaction_id"), (no_account, "Missing account_id"),
                  (amount.isNull(), "Invalid transaction_amount"),
                  (when.isNull(), "Invalid transaction_date"),
                  (~kind.isin(*TRANSACTION_TYPES), "Invalid transaction_type")),
    )


def daily_balance_spec() -> CleanseSpec:
    no_account, when = p.is_blank(F.col("account_id")), _date("balance_date")
    balance = _number("closing_balance", 18, 2)
    return CleanseSpec(
        "daily_balance", ("account_id", "balance_date"),
        {"account_id": F.col("account_id"), "balance_date": when, "closing_balance": balance},
        invalid=(no_account, when.isNull(), balance.isNull()),
        score=((35, ~no_account), (35, when.isNotNull()), (30, balance.isNotNull())),
        messages=((no_account, "Missing account_id"), (when.isNull(), "Invalid balance_date"),
                  (balance.isNull(), "Invalid closing_balance")),
    )


def fx_rate_spec() -> CleanseSpec:
    code, when = F.col("currency_code"), _date("rate_date")
    rate = _number("fx_rate_to_usd", 18, 6)
    unusable = F.coalesce(rate <= 0, F.lit(True))
    return CleanseSpec(
        "fx_rate", ("currency_code", "rate_date"),
        {"currency_code": code, "rate_date": when, "fx_rate_to_usd": rate},
        invalid=(p.is_blank(code), when.isNull(), unusable),
        score=((35, code.isin(*p.CURRENCIES)), (30, when.isNotNull()), (35, ~unusable)),
        messages=((p.is_blank(code), "Missing currency_code"),
                  (when.isNull(), "Invalid rate_date"), (unusable, "Invalid fx_rate_to_usd"),
                  (~code.isin(*p.CURRENCIES), "Invalid currency_code")),
    )


SPECS = {
    "customer": customer_spec, "account": account_spec, "transaction": transaction_spec,
    "daily_balance": daily_balance_spec, "fx_rate": fx_rate_spec,
}


def cleanse(bronze: DataFrame, entity: str, as_of: AsOf, typed: Mapping[str, Column] | None = None) -> DataFrame:
    """Typed rows of one entity; rows without a key are dropped.

    ``typed`` names columns of ``bronze`` that hold a value as typed already.
    """
    spec = SPECS[entity]()
    columns = {**spec.columns, **(typed or {})}
    valid = F.when(spec.invalid[0], False)
    for condition in spec.invalid[1:]:
        valid = valid.when(condition, False)
    points = sum((F.when(ok, weight).otherwise(0) for weight, ok in spec.score), F.lit(0))
    # Joined one-element arrays stay in generated code; compacting an array would not.
    none = F.array().cast("array<string>")
    errors = F.concat(*[F.when(broken, F.array(F.lit(text))).otherwise(none)
                        for broken, text in spec.messages])
    key_present = columns[spec.keys[0]].isNotNull()
    for key in spec.keys[1:]:
        key_present = key_present & columns[key].isNotNull()
    return bronze.where(key_present).select(
        *[c.alias(name) for name, c in columns.items()],
        valid.otherwise(True).alias("is_valid"),
        points.cast("decimal(5,2)").alias("dq_score"),
        errors.alias("validation_errors"),
        F.lit(f"BRONZE_STG_{entity.upper()}").alias("source_system"),
        instant(as_of).alias("load_timestamp"),
        instant(as_of).alias("updated_timestamp"),
        F.col("load_batch_id").alias("bronze_load_batch_id"),
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: str,
                   tie_break: Sequence[str] = ()) -> DataFrame:
    """One row per key: the newest, ties settled by the given columns (largest first).

    Spark limits each group inside the map tasks before it shuffles, so a key that
    holds much of the table still sends only one row per task.
    """
    order = [F.col(newest).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tie_break]]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def _keyed(bronze: DataFrame, spec: CleanseSpec) -> tuple[DataFrame, dict[str, str]]:
    """Landed rows with a whole key, and the column that holds each key as typed.

    The first key is taken over as landed, the others are typed beside their text.
    """
    columns = {key: f"_key{i}" if i else key for i, key in enumerate(spec.keys)}
    keyed = bronze.select("*", *[spec.columns[key].alias(c) for key, c in columns.items() if c != key])
    for c in columns.values():
        keyed = keyed.where(F.col(c).isNotNull())
    return keyed, columns


def landed_keys(bronze: DataFrame, entity: str) -> DataFrame:
    """The keys, as typed, that ``silver_from_bronze`` has a row for, each once."""
    keyed, columns = _keyed(bronze, SPECS[entity]())
    return keyed.select(*[F.col(c).alias(key) for key, c in columns.items()]).distinct()


def silver_from_bronze(bronze: DataFrame, entity: str, as_of: AsOf) -> DataFrame:
    """Newest landed version of every key, cleansed: the input of an upsert.

    Keys are compared after typing, so two texts of one date are one key.  The rows stay
    partitioned by the typed keys, so a join on these shuffles only its other side.
    """
    spec = SPECS[entity]()
    keyed, columns = _keyed(bronze, spec)
    # The first key cannot differ within a group.
    settled = ("load_timestamp", "source_file", spec.keys[0])
    tie_break = [c for c in bronze.columns if c not in settled]
    newest = latest_per_key(keyed, list(columns.values()), "load_timestamp", tie_break)
    return cleanse(newest, entity, as_of, {key: F.col(c) for key, c in columns.items()})
