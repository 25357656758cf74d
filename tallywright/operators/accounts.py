"""Accounts, their sessions, and writes that hold only for the account's present life."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = ("name", "product", "currency", "usage", "aspsp")  # an absent value keeps the one recorded
OVERWRITTEN = ("uid", "session_id")


def upsert(held: DataFrame, fetched: DataFrame) -> DataFrame:
    """The accounts after a fetch, with `refused`: an account that the fetch binds to another bank stays as it was.

    Both have account_id; the other columns are those of held. New accounts are added as fetched.
    """
    columns = [c for c in held.columns if c != "account_id"]
    old, new = held.withColumn("there", F.lit(True)).alias("o"), fetched.withColumn("got", F.lit(True)).alias("n")
    both = old.join(new, "account_id", "full")
    refused = F.coalesce(F.col("o.there") & F.col("n.got") & (F.col("o.aspsp") != F.col("n.aspsp")), F.lit(False))

    def after(c: str):
        if c not in fetched.columns:
            return F.col(f"o.{c}")
        kept = F.col(f"n.{c}") if c in OVERWRITTEN else F.coalesce(f"n.{c}", f"o.{c}")
        return F.when(refused | F.col("n.got").isNull(), F.col(f"o.{c}")).otherwise(kept)

    return both.select("account_id", *[after(c).alias(c) for c in columns], refused.alias("refused"))


def with_session(accounts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each account with its session's columns, null where it has none."""
    return accounts.join(sessions, "session_id", "left")


def binding_reviews(sync_state: DataFrame, accounts: DataFrame) -> DataFrame:
    """Refused rebindings that wait for a review, with the account's name where it is known."""
    due = sync_state.filter("resource = 'account_binding' AND completeness = 'review_required'")
    return due.select("account_id", "last_error").join(accounts.select("account_id", "name"), "account_id", "left")


def guarded(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """The rows that may be written: those of an account's present incarnation. An account forgotten and linked again has another."""
    return rows.join(accounts.select("account_id", "incarnation"), ["account_id", "incarnation"], "left_semi")


def verify(intended: DataFrame, returned: DataFrame) -> DataFrame:
    """By bank, what a consent returned against what was intended: (aspsp, verdict, missing, unexpected, extra_currency).

    Both have aspsp and number; returned has currency too. A number in several currencies is several accounts of the
    ledger, of which one at most was approved, so it counts as extra even where the numbers agree.
    """
    got = returned.filter("number IS NOT NULL").groupBy("aspsp", "number").agg(F.count_distinct(F.coalesce("currency", F.lit(""))).alias("currencies"))
    both = intended.select("aspsp", "number").distinct().withColumn("want", F.lit(True)).join(got, ["aspsp", "number"], "full")
    sums = both.groupBy("aspsp").agg(
        F.count("currencies").alias("n"), F.count_if(F.expr("want AND currencies IS NULL")).alias("missing"), F.count_if(F.expr("want IS NULL")).alias("unexpected"), F.count_if(F.expr("currencies > 1")).alias("extra_currency")
    )
    verdict = F.when(F.col("n") == 0, "zero").when(F.col("missing") > 0, "missing").when(F.col("unexpected") > 0, "unexpected").when(F.col("extra_currency") > 0, "currency").otherwise("exact")
    return sums.select("aspsp", verdict.alias("verdict"), "missing", "unexpected", "extra_currency")


def renewable(sessions: DataFrame) -> DataFrame:
    """Each bank's session to renew: of the newest generation, then the latest authorised, then by id."""
    order = F.struct("generation", "authorized_at", "session_id")
    return sessions.groupBy("aspsp").agg(F.max_by(F.struct("session_id", "generation"), order).alias("top")).select("aspsp", "top.session_id", "top.generation")
