"""Stream forms of the ledger's aggregates: daily totals, activity sessions, and refresh by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.sources.store import Store


def daily_totals(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events per type and day; a day closes when the watermark has passed it."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.to_date("window.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """Spans of a user's activity with no gap of this length: the stream form of an interval merge."""
    spans = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return spans.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def refresh_into(store: Store, merge: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]], tables: list[str]):
    """A foreachBatch function: merges a micro-batch into the store's tables and writes them as one version.

    merge has to be idempotent, as a batch may come twice; reconciliation is: what is known already changes nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        store.write(merge({t: store.read(t) for t in tables}, batch))

    return run


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what there is, into Parquet."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
