"""Identity and corroboration of transactions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import ABSENT, canon_ascii, identity_text

WINDOW_DAYS, NEAR_DAYS = 7, 3
PENDING, BOOKED = ("PDNG", "PNDG", "PENDING", "HOLD"), ("BOOK", "BOOKED")


def canon(name: str, unicode_text: bool = True) -> Column:
    """The canonical form of a column; absent differs from empty. Texts beyond ASCII go through Arrow, unless the caller knows that there are none."""
    return F.coalesce((identity_text if unicode_text else canon_ascii)(F.col(name)), F.lit(ABSENT))


def identity(unicode_text: bool = True) -> Column:
    """SHA-256 over account, amount, currency, direction, counterparty, remittance; dates and status are not part of it."""
    material = F.to_json(F.array(F.col("account_id").cast("string"), F.col("amount_minor").cast("string"), *[canon(c, unicode_text) for c in ("currency", "direction", "counterparty", "remittance")]))
    return F.sha2(material, 256)


def with_party(rows: DataFrame) -> DataFrame:
    """Rows with counterparties in canonical form: made once a row here, not once a pair."""
    return rows.withColumn("counterparty", identity_text(F.col("counterparty")))


def corroborated(stored: str, fetched: str, canonical: bool = False) -> Column:
    """How a shared reference is borne out between rows aliased so: reference, reference_corroborated or rejected; canonical: both come from with_party."""
    s, f = (lambda c: F.col(f"{stored}.{c}")), (lambda c: F.col(f"{fetched}.{c}"))
    near = F.abs(F.datediff(s("d"), f("d"))) <= NEAR_DAYS
    party = lambda x: x("counterparty") if canonical else identity_text(x("counterparty"))
    same_party = F.coalesce((party(s) == party(f)) & (party(s) != ""), F.lit(False))
    return F.when(near & (s("amount_minor") == f("amount_minor")), "reference").when(near & same_party, "reference_corroborated").otherwise("rejected")


def confidence(method: Column) -> Column:
    return F.when(method == "reference", 1.0).when(method == "reference_corroborated", 0.7).otherwise(0.0)


def with_units(rows: DataFrame) -> DataFrame:
    """Rows with directions and currencies in canonical form: made once a row here, not once a pair."""
    return rows.withColumns({c: canon_ascii(F.col(c)) for c in ("direction", "currency")})


def money_change(stored: str, fetched: str, canonical: bool = False) -> Column:
    """What money a match would rewrite: a sign or unit before an amount; null if nothing; canonical: both come from with_units."""
    s, f = (lambda c: F.col(f"{stored}.{c}")), (lambda c: F.col(f"{fetched}.{c}"))
    form = (lambda x: x) if canonical else canon_ascii
    moved = lambda c: ~form(s(c)).eqNullSafe(form(f(c)))
    return F.when(moved("direction") | moved("currency"), "direction_or_currency_changed").when(s("amount_minor") != f("amount_minor"), "amount_changed")
