"""Refresh control as column expressions over sync_state: windows, cooldowns, back-off, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARGIN_DAYS, DEFAULT_DAYS = 7, 90
COOLDOWN_S, BACKOFF_S, MAX_RETRY_S, FLIGHT_TTL_S = 900, 900, 86400, 300


def window_days(newest: Column, today: Column) -> Column:
    """Days to ask for: since the newest booked date plus a margin; the default without a sound date."""
    text = F.substring(newest, 1, 10)
    last = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text.try_cast("date"))
    days = F.datediff(today, last)
    return F.when(days >= 0, days + MARGIN_DAYS).otherwise(DEFAULT_DAYS)


def retry_after(seconds: Column) -> Column:
    """Seconds to wait after a refusal: the provider's figure up to a day; ours if there is none, or it is not positive."""
    return F.when((seconds > 0) & ~F.isnan(seconds), F.least(seconds, F.lit(float(MAX_RETRY_S)))).otherwise(F.lit(float(BACKOFF_S)))


def admission(now: Column, attempted: Column, retry_at: Column, automatic: Column) -> Column:
    """admitted, provider (its wait binds all), future or cooldown (these bind automatic refreshes only)."""
    since = F.unix_timestamp(now) - F.unix_timestamp(attempted)
    return F.when(retry_at > now, "provider").when(automatic & (since < 0), "future").when(automatic & (since < COOLDOWN_S), "cooldown").otherwise("admitted")


def in_flight(now: Column, started: Column) -> Column:
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(started) < FLIGHT_TTL_S, F.lit(False))


def completeness(prior: Column, current: Column, narrow: Column) -> Column:
    """A narrow pass never turns a standing partial into complete, nor hides a new partial."""
    return F.when(narrow & (current == "complete"), F.coalesce(prior, current)).otherwise(current)


def replace_set(held: DataFrame, fetched: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """The set after a fetch: an owner's non-empty answer replaces what is held; an empty one proves nothing."""
    return fetched.unionByName(held.join(fetched.select(owner).distinct(), owner, "left_anti"))
