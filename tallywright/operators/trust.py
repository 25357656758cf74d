"""Trust in provider references, derived from what each run measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import strict_date
from tallywright.operators.intervals import bands

LEAST_TRANSACTIONS, LEAST_DAYS = 100, 180


def measure_references(rows: DataFrame, by: list[str], identity: list[str]) -> DataFrame:
    """Per run: rows_total, ref_transactions, distinct_refs, reused_refs, span_days.

    Rows of one reference and identity within three days of the first are one transaction. rows has
    provider_ref, provider_ref_kind, booking_date and the columns of by and identity.
    """
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_total"))
    dated = rows.filter(F.coalesce(F.col("provider_ref") != "", F.lit(False))).withColumn("d", strict_date(F.col("booking_date"))).filter("d IS NOT NULL")
    kinds = dated.withColumn("entry", (F.col("provider_ref_kind") == "entry_reference").cast("int"))
    key = [*by, "provider_ref", *identity]
    banded = bands(kinds, key, "d")
    dates = kinds.groupBy(*key, "d").agg(F.max("entry").alias("entry"))
    entry = banded.join(dates, [F.col("anchor") <= F.col("d"), F.col("d") <= F.col("last"), *[banded[k].eqNullSafe(dates[k]) for k in key]], "left").groupBy(*[banded[k] for k in key], "anchor").agg(F.max("entry").alias("entry"))
    per_ref = entry.groupBy(*by, "provider_ref").agg(F.count(F.lit(1)).alias("groups"), F.sum("entry").alias("entries"), F.min(F.when(F.col("entry") == 1, F.col("anchor"))).alias("first"), F.max(F.when(F.col("entry") == 1, F.col("anchor"))).alias("last"))
    found = per_ref.groupBy(*by).agg(
        F.sum("entries").alias("ref_transactions"), F.count(F.lit(1)).alias("distinct_refs"), F.count_if(F.col("groups") > 1).alias("reused_refs"), F.coalesce(F.datediff(F.max("last"), F.min("first")), F.lit(0)).alias("span_days")
    )
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return total.join(found, by, "left").select(*by, "rows_total", none("ref_transactions"), none("distinct_refs"), none("reused_refs"), none("span_days"))


def bank_key(name):
    return F.upper(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))


def capability(observations: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_id, ref_stable, ref_scope, observed_n: any reuse is disqualifying, one deep enough run grants."""
    enough = (F.col("kind") == "deep") & (F.col("ref_transactions") >= LEAST_TRANSACTIONS) & (F.col("span_days") >= LEAST_DAYS)
    found = observations.withColumn("bank", bank_key(F.col("aspsp"))).groupBy("account_id", "bank").agg(F.bool_or(F.col("reused_refs") > 0).alias("reuse"), F.max(F.when(enough, F.col("ref_transactions"))).alias("best"))
    seen = accounts.withColumn("bank", bank_key(F.col("aspsp"))).join(found, ["account_id", "bank"], "left")
    stable = F.coalesce(~F.col("reuse") & F.col("best").isNotNull(), F.lit(False))
    return seen.select("account_id", stable.alias("ref_stable"), F.when(stable, "account").otherwise("unknown").alias("ref_scope"), F.when(stable, F.col("best")).otherwise(F.lit(0)).cast("long").alias("observed_n"))


def capability_warning(observations: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_id, warning: unnamed, unmeasured, measured under another name, or null."""
    names = observations.groupBy("account_id").agg(F.collect_set("aspsp").alias("recorded"))
    key = bank_key(F.col("aspsp"))
    found = accounts.join(names, "account_id", "left")
    warning = F.when(key == "", "unnamed").when(F.col("recorded").isNull(), "unmeasured").when(~F.array_contains("recorded", key), "renamed")
    return found.select("account_id", warning.alias("warning"))
