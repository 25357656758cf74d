"""Late and amended rows as a stream: state by account and identity, so a change is told from a new row.

State holds an identity's open rows (reference day, status, content). A row within three days of an open one
is that row again: the same, amended, or booked after pending. An identity that the watermark has left behind is dropped,
so state is in proportion to what the last days brought, not to the ledger. A batch may come twice: what is known changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywright.operators.identity import NEAR_DAYS
from tallywright.operators.reconcile import prepared

CHANGES = "account_id long, identity_key string, op string, day int, was_day int, fetch_idx long"
STATE = "days array<int>, ranks array<int>, contents array<string>"


def _changes(near: int, ttl_days: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        days, ranks, contents = (list(part) for part in state.get) if state.exists else ([], [], [])
        rows = sorted((r for frame in frames for r in frame[["day", "rank", "content", "fetch_idx"]].itertuples(index=False, name=None)), key=lambda r: (r[0], r[1], r[3]))
        out = []
        for day, rank, content, fetch_idx in rows:
            open_ = [(content != contents[i], abs(day - d), i) for i, d in enumerate(days) if abs(day - d) <= near]
            if not open_:
                out.append((*key, "insert", day, None, fetch_idx))
                days.append(int(day)), ranks.append(int(rank)), contents.append(content)
                continue
            changed, _, i = min(open_)
            if not changed or (rank == 2 and ranks[i] == 0):  # known already, or a pending form that its booking has overtaken
                continue
            out.append((*key, "supersede" if ranks[i] == 2 and rank == 0 else "update", day, days[i], fetch_idx))
            days[i], ranks[i], contents[i] = int(day), int(rank), content
        state.update((days, ranks, contents))
        state.setTimeoutTimestamp((max(days) + ttl_days + 1) * 86_400_000)  # later than the watermark, as no row is behind it
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"day": "Int32", "was_day": "Int32"})

    return run


def changes(rows: DataFrame, ttl_days: int = 30, near: int = NEAR_DAYS) -> DataFrame:
    """CHANGES of a stream of normalised rows with fetch_idx: insert, update or supersede.

    Booking dates are the event time: rows over ttl_days older than the newest date seen are left to the next full
    reconciliation, as are those without a sound date (reconcile.unsound()).
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).cast("timestamp").alias("ts")
    keyed = prepared(rows).filter("day IS NOT NULL").select("account_id", "identity_key", "day", "rank", "content", F.col("fetch_idx").cast("long").alias("fetch_idx"), day)
    marked = keyed.withWatermark("ts", f"{ttl_days} days").groupBy("account_id", "identity_key")
    return marked.applyInPandasWithState(_changes(near, ttl_days), CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
