"""Bounded reads: filters, tag predicates, balances, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTED = ("active", "vanished")
WORKFLOW = ("awaiting-operator", "unclassifiable")
PREFERENCE = ("CLBD", "ITBD", "ITAV", "XPCD")
MONEY_REASONS = ("amount_changed", "direction_or_currency_changed")


def listed(rows: DataFrame) -> DataFrame:
    """Rows in a known live state; an unknown state is left out."""
    return rows.filter(F.col("state").isin(*LISTED))


def in_scope(rows: DataFrame, accounts: DataFrame, category: str | None = None) -> DataFrame:
    keep = accounts.filter("included")
    keep = keep.filter(F.col("category") == category) if category else keep
    return rows.join(keep.select("account_id"), "account_id", "left_semi")


def tagged_all(rows: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """One semi join: rows whose wanted tags are as many as wanted."""
    full = tags.filter(F.col("tag").isin(wanted)).groupBy("row_id").agg(F.countDistinct("tag").alias("n")).filter(F.col("n") == len(set(wanted)))
    return rows.join(full, "row_id", "left_semi")


def tagged_any(rows: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    return rows.join(tags.filter(F.col("tag").isin(wanted)), "row_id", "left_semi")


def tagged_none(rows: DataFrame, tags: DataFrame, unwanted: list[str]) -> DataFrame:
    return rows.join(tags.filter(F.col("tag").isin(unwanted)), "row_id", "left_anti")


def states(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """row_id and its classification: terminal, else parked, else classified, else workable."""
    flags = tags.groupBy("row_id").agg(
        F.bool_or(F.col("tag") == "unclassifiable").alias("terminal"), F.bool_or(F.col("tag") == "awaiting-operator").alias("parked"), F.bool_or(~F.col("tag").isin(*WORKFLOW)).alias("content")
    )
    state = F.when(F.col("terminal"), "terminal").when(F.col("parked"), "parked").when(F.col("content"), "classified").otherwise("workable")
    return rows.join(flags, "row_id", "left").select("row_id", state.alias("classification"))


def queue(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Listed rows that are workable or parked, over all accounts."""
    return rows.join(states(listed(rows), tags).filter(F.col("classification").isin("workable", "parked")), "row_id")


def page(rows: DataFrame, key: str, size: int, before: int | None = None) -> DataFrame:
    """Newest first by key, below the cursor; the last row tells whether this was all (one more is probed)."""
    rows = rows.filter(F.col(key) < before) if before is not None else rows
    return rows.orderBy(F.desc(key)).limit(_size(size) + 1)


def shown(rows: DataFrame, key: str, size: int, before: int | None = None) -> DataFrame:
    """A page without its probe row; has_more says whether there was one."""
    place = F.row_number().over(Window.orderBy(F.desc(key)))  # over at most 201 rows
    found = page(rows, key, size, before).withColumns({"place": place, "has_more": F.count(F.lit(1)).over(Window.partitionBy()) > _size(size)})
    return found.filter(F.col("place") <= _size(size)).drop("place")


def _size(asked: int) -> int:
    return min(max(asked, 1), 200)


def pick_balance(balances: DataFrame) -> DataFrame:
    """One balance per account: the first of each type by seq, then by preference, else the first seen."""
    rank = F.coalesce(*[F.when(F.col("balance_type") == t, i) for i, t in enumerate(PREFERENCE)], F.lit(len(PREFERENCE)))
    first = F.row_number().over(Window.partitionBy("account_id").orderBy(rank, "seq"))
    return balances.withColumn("n", first).filter("n = 1").drop("n")


def usable_balance() -> Column:
    return F.col("amount_minor").isNotNull() & F.coalesce(F.col("currency") != "", F.lit(False))


def latest(notes: DataFrame, n: int = 20) -> DataFrame:
    """Each row's n latest notes; Catalyst limits each window while it sorts."""
    return notes.withColumn("rank", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("note_id")))).filter(F.col("rank") <= n)


def reason_counts(rows: DataFrame, named: int = 3) -> DataFrame:
    """Counts by reason: both money reasons always named, the `named` most frequent others, the rest in one row."""
    counts = rows.filter("needs_review").groupBy("review_reason").agg(F.count(F.lit(1)).alias("n"))
    money = F.col("review_reason").isin(*MONEY_REASONS)
    rank = F.when(~money, F.row_number().over(Window.partitionBy(money).orderBy(F.desc("n"), "review_reason")))
    label = F.when(money | (rank <= named), F.col("review_reason")).otherwise("(other)")
    return counts.withColumn("reason", label).groupBy("reason").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("reasons"))
