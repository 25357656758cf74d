"""Erasure: each function returns the tables that remain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators.intervals import trim


def _without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table keyed by row alone (tags, notes, references) without the rows that go."""
    return {name: df.join(gone, "row_id", "left_anti") if "row_id" in df.columns and name != "transactions" else df for name, df in tables.items()}


def purge(tables: dict[str, DataFrame], cutoff: str) -> dict[str, DataFrame]:
    """Without rows booked before the cutoff, and what hangs on them; coverage is trimmed; rules and high water stay. A row without a date stays."""
    out = _without(tables, tables["transactions"].filter(F.col("booking_date") < cutoff).select("row_id"))
    out["transactions"] = tables["transactions"].filter(F.coalesce(F.col("booking_date") >= cutoff, F.lit(True)))
    if "coverage" in tables:
        out["coverage"] = trim(tables["coverage"], F.lit(cutoff).cast("date"))
    return out


def purged_coverage(coverage: DataFrame, cutoff: str) -> DataFrame:
    """One row: how many spans a purge drops, as they end by the cutoff, and how many it trims, as they lie across it."""
    day = F.lit(cutoff).cast("date")
    return coverage.agg(F.count_if(F.col("end") <= day).alias("dropped"), F.count_if((F.col("start") < day) & (F.col("end") > day)).alias("trimmed"))


def forget(tables: dict[str, DataFrame], account_id: int) -> dict[str, DataFrame]:
    """Without an account: what hangs on its rows, its rows, and every table that names the account."""
    out = _without(tables, tables["transactions"].filter(F.col("account_id") == account_id).select("row_id"))
    return {name: df.filter(~F.col("account_id").eqNullSafe(F.lit(account_id))) if "account_id" in df.columns else df for name, df in out.items()}


def delete_all(tables: dict[str, DataFrame], meta: DataFrame, kept: tuple[str, ...]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table empty, its schema kept; of the key-value table only the structural keys."""
    return {name: df.limit(0) for name, df in tables.items()}, meta.filter(F.col("key").isin(*kept))


def counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, before, after): rows of each table, counted where they are."""
    out = None
    for side, tables in (("before", before), ("after", after)):
        for name, df in tables.items():
            n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(side).alias("side"), "n")
            out = n if out is None else out.unionByName(n)
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).alias(side)
    return out.groupBy("name").agg(of("before"), of("after"))
