"""Spend and usage aggregates; currencies are never added together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.money import signed, usable_currency

UNTAGGED = "(untagged)"


def spend_by_tag(rows: DataFrame, tags: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Signed totals per tag and currency, plus rows without a tag unless `only` picks tags. Groups overlap; bad currencies are left out."""
    good = rows.filter(usable_currency(F.col("currency"))).select("row_id", F.upper("currency").alias("currency"), signed(F.col("amount_minor"), F.col("direction")).alias("value"))
    wanted = tags.filter(F.col("tag").isin(only)) if only else tags
    found = good.join(wanted.distinct(), "row_id").select("tag", "currency", "value")
    if not only:
        found = found.unionByName(good.join(tags, "row_id", "left_anti").select(F.lit(UNTAGGED).alias("tag"), "currency", "value"))
    return found.groupBy("tag", "currency").agg(F.sum("value").alias("total_minor"), F.count(F.lit(1)).alias("n"))


def bad_currency(rows: DataFrame) -> DataFrame:
    """How many rows have no usable currency, each once however many tags it has."""
    return rows.agg(F.count_if(~usable_currency(F.col("currency"))).alias("n"))


def tag_usage(rows: DataFrame, tags: DataFrame, limit: int = 200) -> DataFrame:
    """Rows per tag, not superseded ones, most used first."""
    live = rows.filter(~F.coalesce(F.col("state") == "superseded", F.lit(False)))
    return tags.join(live.select("row_id"), "row_id").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def tag_total(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """How many tags are in use, those beyond a listing's limit included."""
    live = rows.filter(~F.coalesce(F.col("state") == "superseded", F.lit(False)))
    return tags.join(live.select("row_id"), "row_id", "left_semi").agg(F.count_distinct("tag").alias("tags"))


def spend_listing(spend: DataFrame, cap: int = 200) -> DataFrame:
    """The groups as shown: by currency, largest first; no more than cap, with how many are `omitted`."""
    top = spend.orderBy("currency", F.desc(F.abs("total_minor")), "tag").limit(cap)
    count = spend.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("omitted"))  # one row
    return top.withColumn("omitted", count.scalar())
