"""Money as whole minor units. Nothing here passes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies whose exponent is not 2 (ISO 4217).
ZERO = ["BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "MGA", "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF"]
THREE = ["BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND"]


def exponent(currency: Column) -> Column:
    """Digits after the point; null unless the code is three letters A-Z."""
    code = F.upper(currency)
    return F.when(code.rlike(r"^[A-Z]{3}\z"), F.when(code.isin(ZERO), 0).when(code.isin(THREE), 3).otherwise(2))


def to_minor(text: Column, currency: Column) -> Column:
    """Minor units of a decimal text; null for junk and for more digits than the currency has."""
    plain = F.trim(text)
    number = F.when(plain.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?\z|^[+-]?\.[0-9]+\z"), plain.try_cast("decimal(38,9)"))
    scaled = F.when(exponent(currency) == 0, number).when(exponent(currency) == 2, number * 100).otherwise(number * 1000)
    return F.when(exponent(currency).isNotNull() & (scaled == F.floor(scaled)), scaled.try_cast("bigint"))


def format_minor(amount: Column, currency: Column) -> Column:
    """"-12.34": as many digits after the point as the currency has; null for a currency that isn't a code."""
    digits = F.abs(amount).cast("string")
    sign = F.when(amount < 0, "-").otherwise("")

    def pointed(n: int) -> Column:
        padded = F.when(F.char_length(digits) <= n, F.lpad(digits, n + 1, "0")).otherwise(digits)
        return F.concat(sign, F.substring(padded, F.lit(1), F.char_length(padded) - n), F.lit("."), F.right(padded, F.lit(n)))

    e = exponent(currency)
    return F.when(e == 0, F.concat(sign, digits)).when(e == 3, pointed(3)).when(e == 2, pointed(2))


def signed(amount: Column, direction: Column) -> Column:
    """Debits are negative; an unknown direction counts as positive; no amount is 0."""
    value = F.coalesce(amount, F.lit(0)).cast("long")
    return F.when(F.upper(F.coalesce(direction, F.lit(""))) == "DBIT", -value).otherwise(value)


def usable_currency(currency: Column) -> Column:
    return F.coalesce(currency.rlike(r"^\p{L}{3}\z"), F.lit(False))
