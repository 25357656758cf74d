"""Reconciliation: which stored row each fetched row is, if any.

The account is the unit of parallelism: references, content clusters and occurrence numbers interact
within one and never across two. Spark prepares what the kernel compares (identity digests, canonical
party and unit, a digest of the mutable fields), and brings the rows of an account together, in order, so that
a partition is one stream of accounts. Contents join back by fetch index, so those rows are narrow. The kernel
is plain Python over one account's rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import canon_ascii, identity_text, strict_date
from tallywright.operators.identity import BOOKED, NEAR_DAYS, PENDING, WINDOW_DAYS, canon, identity

EXACT = 8  # rows a side up to which a cluster is matched exactly
MUTABLE = ("booking_date", "value_date", "amount_minor", "status", "counterparty", "remittance", "provider_ref")
ACTIONS = "account_id long, op string, row_id long, fetch_idx int, local_id int, replaced_by int, identity_key string, occurrence int, method string, confidence double, needs_review boolean, reason string"


def prepared(rows: DataFrame, unicode_text: bool = True) -> DataFrame:
    """rows with the columns that the kernel compares; a row without a sound booking date has no day, see unsound()."""
    rows = rows if "value_date" in rows.columns else rows.withColumn("value_date", F.lit(None).cast("string"))
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    return rows.withColumns({
        "identity_key": identity(unicode_text), "day": F.datediff(strict_date(F.col("booking_date")), F.lit("1970-01-01").cast("date")), "party": F.coalesce((identity_text if unicode_text else canon_ascii)(F.col("counterparty")), F.lit("")),
        "unit": F.concat_ws("|", canon("direction", unicode_text), canon("currency", unicode_text)), "rank": F.when(status.isin(*BOOKED), 0).when(status.isin(*PENDING), 2).otherwise(1), "content": F.sha2(F.to_json(F.struct(*MUTABLE), {"ignoreNullFields": "false"}), 256),
    })


def unsound(rows: DataFrame) -> DataFrame:
    """The rows that reconcile() can't place in time, to be reported: their booking date is absent or not YYYY-MM-DD."""
    return rows.filter(strict_date(F.col("booking_date")).isNull())


def best_pairs(fetched: list, stored: list, window: int, blocked: set) -> tuple[list, bool]:
    """One-to-one pairs (fetched, stored, days) within the window, and whether they are the best there are.

    Best is most pairs, then fewest days in all, then earliest fetched dates, stored dates and row ids. Found
    over subsets of stored rows: prefixes that use the same subset have as many pairs, so the least of
    them extends to the least whole. Larger clusters are paired greedily, in order of date.
    """
    if len(fetched) > EXACT or len(stored) > EXACT:
        free, pairs = sorted(stored, key=lambda s: (s.booking_date, s.row_id)), []
        for f in sorted(fetched, key=lambda f: (f.booking_date, f.fetch_idx)):
            near = [(abs(f.day - s.day), i) for i, s in enumerate(free) if abs(f.day - s.day) <= window and (f.fetch_idx, s.row_id) not in blocked]
            if near:
                days, i = min(near)
                pairs.append((f, free.pop(i), days))
        return pairs, False
    best: dict[int, tuple] = {0: (0, 0, (), (), (), ())}
    for i, f in enumerate(fetched):
        after = dict(best)
        for used, (n, days, *ties) in best.items():
            for j, s in enumerate(stored):
                gap = abs(f.day - s.day)
                if used >> j & 1 or gap > window or (f.fetch_idx, s.row_id) in blocked:
                    continue
                new = (n - 1, days + gap, ties[0] + (f.booking_date,), ties[1] + (s.booking_date,), ties[2] + (s.row_id,), ties[3] + ((i, j),))
                if used | 1 << j not in after or new < after[used | 1 << j]:
                    after[used | 1 << j] = new
        best = after
    return [(fetched[i], stored[j], abs(fetched[i].day - stored[j].day)) for i, j in min(best.values())[5]], True


def borne_out(s, f) -> tuple[str, float] | None:
    """How near rows that share a reference agree: on the amount, or on a party that both name."""
    if abs(s.day - f.day) > NEAR_DAYS:
        return None
    if s.amount_minor == f.amount_minor:
        return "reference", 1.0
    return ("reference_corroborated", 0.7) if s.party and s.party == f.party else None


def money_moved(s, f) -> str | None:
    if s.unit != f.unit:
        return "direction_or_currency_changed"
    return "amount_changed" if s.amount_minor != f.amount_minor else None


def transactions_of(rows: list) -> list[list]:
    """Restatements together: rows of one identity within three days of the first."""
    out: list[list] = []
    for f in sorted(rows, key=lambda f: (f.identity_key, f.booking_date, f.fetch_idx)):
        if out and out[-1][0].identity_key == f.identity_key and f.day - out[-1][0].day <= NEAR_DAYS:
            out[-1].append(f)
        else:
            out.append([f])
    return out


@dataclass
class Account:
    """One account's pass; actions are dicts of ACTIONS."""

    stored: list
    fetched: list
    trusted: bool = False
    window: int = WINDOW_DAYS
    issued: dict = field(default_factory=dict)  # identity to the next occurrence never issued
    interval: tuple[int, int] | None = None  # days proven to be whole; None: nothing is missed
    actions: list = field(default_factory=list)

    def __post_init__(self):
        self.next = defaultdict(int, self.issued)
        for s in self.stored:
            self.next[s.identity_key] = max(self.next[s.identity_key], int(s.occurrence) + 1)
        self.live = [s for s in self.stored if s.state == "active"]
        self.days = defaultdict(list)
        for f in self.fetched:
            self.days[f.identity_key].append(f.day)
        self.paired_rows, self.done, self.reused, self.unsure = set(), set(), set(), set()
        self.claimants, self.blocked = set(), set()  # fetched rows whose reference was refused; pairs that were
        self.local = 0

    def slot(self, key: str) -> int:
        self.next[key] += 1
        return self.next[key] - 1

    def present(self, s) -> bool:
        return any(abs(s.day - d) <= NEAR_DAYS for d in self.days.get(s.identity_key, ()))

    def act(self, op: str, **values) -> None:
        self.actions.append({"op": op, **values})

    def insert(self, f, method: str, confidence: float, reason: str | None) -> int:
        self.act("insert", fetch_idx=f.fetch_idx, local_id=self.local, identity_key=f.identity_key, occurrence=self.slot(f.identity_key), method=method, confidence=confidence, needs_review=reason is not None, reason=reason)
        self.local += 1
        return self.local - 1

    def pair(self, s, f, method: str, confidence: float, reason: str | None) -> None:
        self.paired_rows.add(s.row_id)
        self.done.add(f.fetch_idx)
        if s.rank == 2 and f.rank == 0:  # a booked row supersedes a pending one, and takes over a standing review
            review = reason is not None or bool(s.needs_review)
            reason = reason or (s.review_reason if review else None)
            new = self.insert(f, method, confidence, reason)
            self.actions[-1]["needs_review"] = review
            self.act("supersede", row_id=s.row_id, replaced_by=new, method=method, confidence=confidence, needs_review=review, reason=reason)
            return
        moved = f.identity_key != s.identity_key
        occurrence = self.slot(f.identity_key) if moved else int(s.occurrence)
        if moved or f.content != s.content or reason is not None:
            self.act("update", row_id=s.row_id, fetch_idx=f.fetch_idx, identity_key=f.identity_key, occurrence=occurrence, method=method, confidence=confidence, needs_review=reason is not None, reason=reason)

    def by_reference(self) -> None:
        """Rows that share a reference, if this account's references are trusted."""
        held, offered = defaultdict(list), defaultdict(list)
        for s in self.live:
            held[s.provider_ref].append(s)
        for f in self.fetched:
            offered[f.provider_ref].append(f)
        for ref in sorted(r for r in offered if r):
            stand = []
            for band in transactions_of(offered[ref]):
                kept = min(band, key=lambda f: (f.rank, f.booking_date, f.fetch_idx))
                stand.append(kept)
                self.done.update(f.fetch_idx for f in band if f is not kept)
            rows = sorted(held.get(ref, ()), key=lambda s: s.row_id)
            if not rows:
                continue
            agree = {s.row_id: [f for f in stand if borne_out(s, f)] for s in rows}
            taken: dict[int, int] = {}  # fetched row to the stored row that it is kept for, or is
            for s in rows:
                twin = next((f for f in agree[s.row_id] if f.identity_key == s.identity_key and f.fetch_idx not in taken), None)
                if twin:
                    taken[twin.fetch_idx] = s.row_id
            for s in rows:
                choice = [f for f in agree[s.row_id] if taken.get(f.fetch_idx, s.row_id) == s.row_id]
                if not choice:
                    self.act("flag", row_id=s.row_id, needs_review=True, reason="provider_ref_reuse")
                    self.reused.add(s.row_id)
                    self.blocked |= {(f.fetch_idx, s.row_id) for f in stand if f.fetch_idx not in taken}
                    continue
                twins = [f for f in choice if f.identity_key == s.identity_key]
                f = (twins or choice)[0]
                if len(choice) > 1 and len(twins) != 1:
                    reason = "reference_shared_in_fetch"
                elif f.identity_key != s.identity_key and self.present(s):
                    reason = "content_present_elsewhere"
                else:
                    reason = money_moved(s, f)
                taken[f.fetch_idx] = s.row_id
                self.pair(s, f, *borne_out(s, f), reason)
            self.claimants |= {f.fetch_idx for f in stand if f.fetch_idx not in taken}

    def by_content(self) -> None:
        """Rows of one identity, nearest in time."""
        clusters: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for f in self.fetched:
            if f.fetch_idx not in self.done:
                clusters[f.identity_key][0].append(f)
        for s in self.live:
            if s.row_id not in self.paired_rows and s.identity_key in clusters:
                clusters[s.identity_key][1].append(s)
        for key in sorted(clusters):
            pairs, exact = best_pairs(*clusters[key], self.window, self.blocked) if clusters[key][1] else ([], True)
            for f, s, days in pairs:
                sure = round(1 - days / (self.window + 1), 3)
                reason = "provider_ref_reuse" if f.fetch_idx in self.claimants else None if exact else "windowed_ambiguous"
                self.pair(s, f, "windowed", sure if exact else min(sure, 0.5), reason)
            if not exact:
                self.unsure.add(key)
                told = {a["row_id"] for a in self.actions if a.get("row_id") is not None}
                for s in clusters[key][1]:
                    if s.row_id not in told:
                        self.act("flag", row_id=s.row_id, needs_review=True, reason="unresolved_cluster")

    def the_rest(self) -> None:
        for f in self.fetched:
            if f.fetch_idx not in self.done:
                self.insert(f, "inserted", 1.0, "provider_ref_reuse" if f.fetch_idx in self.claimants else "windowed_ambiguous" if f.identity_key in self.unsure else None)
        for s in self.live:
            if s.row_id in self.paired_rows or s.row_id in self.reused or s.identity_key in self.unsure:
                continue
            if self.present(s):
                self.act("flag", row_id=s.row_id, needs_review=True, reason="content_present_elsewhere")
            elif self.interval and self.interval[0] + self.window <= s.day < self.interval[1] - self.window:
                self.act("tombstone", row_id=s.row_id, reason="absent_from_a_proven_interval")

    def run(self) -> list[dict]:
        if self.trusted:
            self.by_reference()
        self.by_content()
        self.the_rest()
        return self.actions


_COLUMNS = [c.split()[0] for c in ACTIONS.split(", ")]


def _kernel(window: int, interval: tuple[int, int] | None):
    def actions(account_id: int, rows: list) -> list[dict]:
        sides = [[r for r in rows if r.side == side] for side in (0, 1)]
        return [{**a, "account_id": account_id} for a in Account(*sides, rows[0].trusted, window, {}, interval).run()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, out = None, [], []
        for batch in batches:
            names = batch.schema.names
            for values in zip(*[batch[n].to_pylist() for n in names]):
                r = SimpleNamespace(**dict(zip(names, values)))
                if r.account_id != current:
                    out += actions(current, rows) if rows else []
                    current, rows = r.account_id, []
                rows.append(r)
            yield _batch(out)
            out = []
        yield _batch(actions(current, rows) if rows else [])

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(actions: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(actions, schema=pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in ACTIONS.split(", "))]))


def reconcile(stored: DataFrame, fetched: DataFrame, capability: DataFrame, *, window: int = WINDOW_DAYS, interval: tuple[int, int] | None = None) -> DataFrame:
    """The actions that bring the ledger up to date, as ACTIONS.

    Rows of unsound() take no part. stored has every state (an occurrence, once issued, is never issued again); fetched has fetch_idx.
    capability is (account_id, ref_stable, ref_scope). Without an interval nothing is marked as vanished.
    """
    trust = capability.select("account_id", F.coalesce(F.col("ref_stable") & (F.col("ref_scope") == "account"), F.lit(False)).alias("trusted"))
    narrow = ["account_id", "identity_key", "booking_date", "day", "amount_minor", "unit", "party", "rank", "content", "provider_ref"]
    old = prepared(stored).filter("day IS NOT NULL").select(*narrow, "row_id", "occurrence", "state", "needs_review", "review_reason", F.lit(0).alias("side"))
    new = prepared(fetched).filter("day IS NOT NULL").select(*narrow, F.col("fetch_idx").cast("int").alias("fetch_idx"), F.lit(1).alias("side"))
    both = old.unionByName(new, allowMissingColumns=True).join(trust, "account_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    # One account's rows follow one another in one partition; the kernel holds one account at a time.
    return both.repartition("account_id").sortWithinPartitions("account_id", "side", "row_id", "fetch_idx").mapInArrow(_kernel(window, interval), ACTIONS)
