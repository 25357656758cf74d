"""Text contracts of the ledger. The two canonical forms differ on purpose and are never mixed."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABSENT = "\x00ABSENT"


@F.pandas_udf(T.StringType())
def identity_canon(values: pd.Series) -> pd.Series:
    """NFC, trimmed, lower case, white space collapsed; a null is told apart from an empty text."""
    return values.map(lambda v: ABSENT if v is None else " ".join(unicodedata.normalize("NFC", v).strip().lower().split()))


@F.pandas_udf(T.StringType())
def rule_canon(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC, trimmed, white space collapsed, case folded; a null is empty."""
    for v in values:
        yield v.map(lambda x: "" if x is None else " ".join(unicodedata.normalize("NFC", x).strip().split()).casefold())


def canon_ascii(value: Column) -> Column:
    """What both forms give for ASCII text: trimmed, lower case, white space collapsed. JVM only."""
    return F.lower(F.trim(F.regexp_replace(value, r"[ \t\n\r\f\x0B]+", " ")))


def _by_row(value: Column, whole) -> Column:
    plain = value.rlike(r"^[\t-\r -~]*\z")
    return F.when(plain, canon_ascii(value)).when(value.isNotNull(), whole(F.when(~plain, value)))


def identity_text(value: Column) -> Column:
    """identity_canon by row: in the JVM where the text is plain ASCII, else by Arrow; a null stays null."""
    return _by_row(value, identity_canon)


def rule_text(value: Column) -> Column:
    """rule_canon by row: in the JVM where the text is plain ASCII, else by Arrow; a null stays null."""
    return _by_row(value, rule_canon)


def tokens(canon: Column) -> Column:
    """Maximal runs of letters and digits of a canonical text, in order."""
    return F.filter(F.split(canon, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def fold_ascii(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains(value: Column, pattern: Column) -> Column:
    r"""LIKE '%pattern%' with only A-Z folded; % and _ in the pattern are wild, a backslash is itself."""
    wild = F.concat(F.lit("%"), F.replace(fold_ascii(pattern), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.like(fold_ascii(value), wild)


def strict_date(text: Column) -> Column:
    """The date of YYYY-MM-DD, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text.try_cast("date"))


def instant(text: Column) -> Column:
    """An ISO stamp as a timestamp; without a zone it is UTC."""
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})\z") | ~text.contains("T"), text).otherwise(F.concat(text, F.lit("Z")))
    return zoned.try_cast("timestamp")


def mask_iban(iban: Column) -> Column:
    """First and last four characters of more than eight."""
    return F.when(F.char_length(iban) > 8, F.concat(F.left(iban, F.lit(4)), F.lit("…"), F.right(iban, F.lit(4)))).otherwise(iban)


def clip(text: Column, cap: int = 256) -> Column:
    return F.when(F.char_length(text) > cap, F.concat(F.left(text, F.lit(cap)), F.lit("...(clipped from "), F.char_length(text).cast("string"), F.lit(" chars)"))).otherwise(text)


def neutral(text: Column, opening: str, closing: str, cap: int = 256) -> Column:
    """One line that can't open or close the fence marks given, cut at cap with a sign that it was."""
    flat = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(opening), F.lit("[fence-open removed]")), F.lit(closing), F.lit("[fence-close removed]"))
    return clip(F.regexp_replace(flat, "\r\n|\n|\r", " "), cap)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC of a text, as lowercase hex: two nested digests over the padded key, in the JVM."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def account_key(key: bytes, iban: Column, currency: Column) -> Column:
    return hmac_sha256(key, F.concat(F.upper(F.trim(iban)), F.lit("|"), currency))


#: What a reason code is shown as.
REASONS = {
    "provider_ref_reuse": "provider reference reuse",
    "unresolved_cluster": "an unresolved cluster of identical rows",
    "windowed_ambiguous": "an ambiguous time-window match",
    "amount_changed": "the amount changed after booking",
    "content_present_elsewhere": "identical content matched elsewhere in the ledger",
    "direction_or_currency_changed": "the direction or currency changed after booking",
    "reference_shared_in_fetch": "the provider reference was shared by more than one fetched row",
}


def reason_label(code: Column, opening: str, closing: str) -> Column:
    """A reason code in words; an unknown one with blanks for underscores, without the fence marks given; none is said to be none."""
    out = F.when(F.coalesce(code, F.lit("")) == "", F.lit("no reason recorded"))
    for known, words in REASONS.items():
        out = out.when(code == known, F.lit(words))
    return out.otherwise(neutral(F.replace(code, F.lit("_"), F.lit(" ")), opening, closing))
