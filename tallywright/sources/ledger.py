"""The ledger's tables as DataFrames, derived from the driver's tables.

Every table is a projection that Catalyst can push filters and column pruning through; none needs a
shuffle but `transactions`, which takes its currency from `accounts`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that stands for "today"; queries never ask the clock.
AS_OF = "2024-02-01"

#: rule_id, counterparty_canon, remittance_token, direction, currency, amount_min_minor, amount_max_minor, dom_min, dom_max, weekdays, tags
RULES = [
    (1, "payee 7 gmbh", None, None, None, None, None, None, None, None, "groceries food"),
    (2, None, "urgent", "DBIT", None, None, None, None, None, None, "priority"),
    (3, None, "high", None, "EUR", 1000000, 20000000, None, None, None, "large"),
    (4, "payee 12 gmbh", None, None, None, None, None, 1, 10, None, "rent household"),
    (5, None, "low", None, None, None, None, None, None, "sat,sun", "weekend"),
    (6, "payee 31 gmbh", "medium", "CRDT", None, None, None, None, None, None, "income"),
    (7, None, "specified", None, "JPY", None, 30000000, 15, 31, "mon,tue,wed", "office"),
    (8, "payee 3 gmbh", None, None, "USD", 500000, None, None, None, None, "travel"),
]
RULE_COLUMNS = "rule_id int, counterparty_canon string, remittance_token string, direction string, currency string, amount_min_minor long, amount_max_minor long, dom_min int, dom_max int, weekdays string, tags string"


class Ledger:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def accounts(self) -> DataFrame:
        key = F.col("c_custkey")
        currency = F.when(key % 5 == 0, "EUR").when(key % 5 == 1, "USD").when(key % 5 == 2, "GBP").when(key % 5 == 3, "JPY").otherwise("BHD")
        return self.table("customer").select(
            key.alias("account_id"), F.col("c_name").alias("name"), currency.alias("currency"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "business").otherwise("personal").alias("category"),
            (key % 10 != 0).alias("included"),
            F.concat(F.lit("BANK"), (F.col("c_nationkey") % 7).cast("string")).alias("aspsp"),
            F.concat(F.lit("s"), (key % 40).cast("string")).alias("session_id"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        key = F.col("o_orderkey")
        cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long")
        rows = self.table("orders").join(self.accounts.select(F.col("account_id").alias("o_custkey"), F.col("currency").alias("own")), "o_custkey")
        amount = F.when(F.col("own") == "JPY", F.expr("CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) div 100")).when(F.col("own") == "BHD", cents * 10).otherwise(cents)
        priority = F.substring("o_orderpriority", 1, 1)
        reason = F.when(key % 35 == 0, "amount_changed").when(key % 35 == 7, "direction_or_currency_changed").when(key % 35 == 14, "provider_ref_reuse").when(key % 35 == 21, "cluster_oversized").otherwise("content_present")
        return rows.select(
            key.alias("row_id"), F.col("o_custkey").alias("account_id"),
            F.when(key % 211 == 0, "2024-2-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("booking_date"),
            amount.alias("amount_minor"),
            F.when(key % 101 == 0, "").when(key % 103 == 0, F.lit(None)).otherwise(F.col("own")).alias("currency"),
            F.when(key % 89 == 0, F.lit(None)).when(priority.isin("1", "2"), "CRDT").otherwise("DBIT").alias("direction"),
            F.when(F.col("o_orderstatus") == "F", "BOOK").when(F.col("o_orderstatus") == "O", "PDNG").otherwise("HOLD").alias("status"),
            F.when(key % 23 != 0, F.concat(F.lit("  Payee  "), (F.col("o_custkey") % 50).cast("string"), F.when(key % 2 == 0, " GmbH").otherwise(" gmbh "))).alias("counterparty"),
            F.when(key % 29 != 0, F.concat(F.lit("Invoice "), F.col("o_orderpriority"), F.lit(" ref_"), (key % 1000).cast("string"))).alias("remittance"),
            F.when(key % 4 != 0, F.concat(F.lit("R"), (key % 300).cast("string"))).alias("provider_ref"),
            F.when(key % 4 == 1, "transaction_id").when(key % 4 != 0, "entry_reference").alias("provider_ref_kind"),
            F.when(key % 13 == 0, "superseded").when(key % 17 == 0, "vanished").otherwise("active").alias("state"),
            (key % 7 == 0).alias("needs_review"), F.when(key % 7 == 0, reason).alias("review_reason"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        key = F.col("o_orderkey")
        found = [(3, 0, "groceries"), (5, 0, "household"), (7, 1, "travel"), (11, 0, "awaiting-operator"), (19, 0, "unclassifiable")]
        each = F.explode(F.array_compact(F.array(*[F.when(key % n == r, F.lit(t)) for n, r, t in found])))
        return self.table("orders").select(key.alias("row_id"), each.alias("tag"))

    @cached_property
    def balances(self) -> DataFrame:
        key = F.col("c_custkey")
        amount = F.when(key % 31 != 0, (F.col("c_acctbal").cast("decimal(18,2)") * 100).cast("long"))
        kind = lambda when, seq, name, more: F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("balance_type"), F.lit(more).alias("more")))
        kinds = F.explode(F.array_compact(F.array(kind(key % 4 == 0, 0, "XPCD", 7), kind(key % 2 == 0, 1, "CLBD", 0), kind(key % 3 != 0, 2, "ITAV", 3), kind(key % 9 == 0, 3, "OTHR", 1))))
        rows = self.accounts.select("account_id", "currency").join(self.table("customer").select(key.alias("account_id"), amount.alias("amount"), kinds.alias("k")), "account_id")
        return rows.select("account_id", "k.seq", "k.balance_type", (F.col("amount") + F.col("k.more")).alias("amount_minor"), F.when(F.col("account_id") % 37 == 0, "").otherwise(F.col("currency")).alias("currency"))

    @cached_property
    def coverage(self) -> DataFrame:
        start = F.to_date("ts")
        return self.table("events").select(F.col("user_id").alias("account_id"), start.alias("start"), F.date_add(start, (F.col("event_id") % 3 + 1).cast("int")).alias("end"))

    @cached_property
    def notes(self) -> DataFrame:
        key = F.col("doc_id")
        return self.table("documents").select(key.alias("note_id"), (key * 7 % 997).alias("row_id"), F.when(key % 3 == 0, "operator").otherwise("classifier").alias("author"), F.col("text").alias("note"))

    @cached_property
    def sync_state(self) -> DataFrame:
        """Last success 0 to 1999 minutes before AS_OF; stamps with and without a zone; some ahead of the clock, some absent."""
        key = F.col("c_custkey")
        at = F.expr(f"timestamp '{AS_OF} 00:00:00' - make_dt_interval(0, 0, CAST(c_custkey % 2000 AS INT) - 60)")
        text = F.when(key % 3 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
        return self.table("customer").select(
            key.alias("account_id"), F.when(key % 13 != 0, text).alias("last_success_at"),
            F.when(key % 5 == 0, "partial").otherwise("complete").alias("completeness"),
            F.concat(F.lit("s"), (F.when(key % 6 == 0, key + 1).otherwise(key) % 40).cast("string")).alias("last_success_session"),
        )

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(RULES, RULE_COLUMNS)
