"""The provider's page feed (JSON lines with an explicit schema), and its normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.money import to_minor

ROW = (
    "struct<entry_reference: string, transaction_id: string, booking_date: string, value_date: string, transaction_amount: struct<currency: string, amount: string>, "
    "credit_debit_indicator: string, status: string, creditor: struct<name: string>, debtor: struct<name: string>, remittance_information: array<string>>"
)
PAGE = f"account_id long, page_no int, transactions array<{ROW}>, continuation_key string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).json(path)


def complete(pages: DataFrame, cap: int = 60) -> DataFrame:
    """Pages of accounts whose fetch ended within the cap; a partial fetch is left out whole."""
    ended = pages.groupBy("account_id").agg(F.bool_or(F.col("continuation_key").isNull()).alias("ended"), F.count(F.lit(1)).alias("n")).filter((F.col("n") <= cap) & F.col("ended"))
    return pages.join(ended.select("account_id"), "account_id", "left_semi")


BALANCES = "balances array<struct<balance_type: string, balance_amount: struct<currency: string, amount: string>, reference_date: string>>"


def read_balances(spark: SparkSession, path: str) -> DataFrame:
    """Balance answers of a landing folder, JSON lines with account_id; an answer is whole, it has no pages."""
    return balances_of(spark.read.text(path).select(F.get_json_object("value", "$.account_id").cast("long").alias("account_id"), F.col("value").alias("answer")))


def balances_of(answers: DataFrame) -> DataFrame:
    """(account_id, seq, balance_type, amount_minor, currency, reference_date) from answers (account_id, answer as JSON).

    An amount that its currency can't hold is null. An empty answer gives no rows and proves nothing.
    """
    each = answers.select("account_id", F.posexplode(F.from_json("answer", BALANCES)["balances"]).alias("seq", "b"))
    currency = F.col("b.balance_amount.currency")
    return each.select("account_id", "seq", "b.balance_type", to_minor(F.col("b.balance_amount.amount"), currency).alias("amount_minor"), currency.alias("currency"), "b.reference_date")


def rows_of(pages: DataFrame) -> DataFrame:
    return pages.select("account_id", "page_no", F.posexplode("transactions").alias("at", "t")).select("account_id", "page_no", "at", "t.*")


def normalise(rows: DataFrame) -> DataFrame:
    """Flat rows; `error` says why a row is refused (no sound amount, unknown direction, negative, no date)."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))  # noqa: E731  an empty text counts as absent
    currency = F.col("transaction_amount.currency")
    minor = to_minor(F.col("transaction_amount.amount"), currency)
    debit = F.col("credit_debit_indicator") == "DBIT"
    date = F.coalesce(given("booking_date"), given("value_date"))
    error = F.when(minor.isNull(), "amount").when(~F.coalesce(F.col("credit_debit_indicator").isin("CRDT", "DBIT"), F.lit(False)), "direction").when(minor < 0, "negative").when(date.isNull(), "date")
    kept = [c for c in rows.columns if c in ("account_id", "page_no", "at", "fetch_idx")]
    return rows.select(
        *kept, date.alias("booking_date"), "value_date", minor.alias("amount_minor"), currency.alias("currency"), F.col("credit_debit_indicator").alias("direction"), "status",
        F.when(debit, F.col("creditor.name")).otherwise(F.col("debtor.name")).alias("counterparty"),
        F.when(F.size("remittance_information") > 0, F.array_join("remittance_information", " ")).alias("remittance"),
        F.coalesce(given("entry_reference"), given("transaction_id")).alias("provider_ref"),
        F.when(given("entry_reference").isNotNull(), "entry_reference").when(given("transaction_id").isNotNull(), "transaction_id").alias("provider_ref_kind"),
        error.alias("error"),
    )
