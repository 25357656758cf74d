"""Text scanners: account numbers that pass their checksum, and lines by category."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, from the public IBAN registry: what follows the four header characters by country. n digits, a capitals, c either.
STRUCTURE = {
    "AD": "8n12c",
    "AE": "19n",
    "AL": "8n16c",
    "AT": "16n",
    "AZ": "4a20c",
    "BA": "16n",
    "BE": "12n",
    "BG": "4a6n8c",
    "BH": "4a14c",
    "BI": "23n",
    "BR": "23n1a1c",
    "BY": "4c4n16c",
    "CH": "5n12c",
    "CR": "18n",
    "CY": "8n16c",
    "CZ": "20n",
    "DE": "18n",
    "DJ": "23n",
    "DK": "14n",
    "DO": "4c20n",
    "EE": "16n",
    "EG": "25n",
    "ES": "20n",
    "FI": "14n",
    "FK": "2a12n",
    "FO": "14n",
    "FR": "10n11c2n",
    "GB": "4a14n",
    "GE": "2a16n",
    "GI": "4a15c",
    "GL": "14n",
    "GR": "7n16c",
    "GT": "24c",
    "HN": "4a20n",
    "HR": "17n",
    "HU": "24n",
    "IE": "4a14n",
    "IL": "19n",
    "IQ": "4a15n",
    "IS": "22n",
    "IT": "1a10n12c",
    "JO": "4a4n18c",
    "KW": "4a22c",
    "KZ": "3n13c",
    "LB": "4n20c",
    "LC": "4a24c",
    "LI": "5n12c",
    "LT": "16n",
    "LU": "3n13c",
    "LV": "4a13c",
    "LY": "21n",
    "MC": "10n11c2n",
    "MD": "20c",
    "ME": "18n",
    "MK": "3n10c2n",
    "MN": "16n",
    "MR": "23n",
    "MT": "4a5n18c",
    "MU": "4a19n3a",
    "NI": "4a20n",
    "NL": "4a10n",
    "NO": "11n",
    "OM": "3n16c",
    "PK": "4a16c",
    "PL": "24n",
    "PS": "4a21c",
    "PT": "21n",
    "QA": "4a21c",
    "RO": "4a16c",
    "RS": "18n",
    "RU": "14n15c",
    "SA": "2n18c",
    "SC": "4a20n3a",
    "SD": "14n",
    "SE": "20n",
    "SI": "15n",
    "SK": "20n",
    "SM": "1a10n12c",
    "SO": "19n",
    "ST": "21n",
    "SV": "4a20n",
    "TL": "19n",
    "TN": "20n",
    "TR": "6n16c",
    "UA": "6n19c",
    "VA": "18n",
    "VG": "4a16n",
    "XK": "16n",
    "YE": "4a4n18c",
}
_PARTS = {c: re.findall(r"(\d+)([nac])", s) for c, s in STRUCTURE.items()}
LENGTH = {c: 4 + sum(int(n) for n, _ in p) for c, p in _PARTS.items()}
_SHAPE = {c: re.compile("".join({"n": "[0-9]", "a": "[A-Z]", "c": "[0-9A-Z]"}[k] + "{%s}" % n for n, k in p)) for c, p in _PARTS.items()}
_UNSEEN = "​‌‍⁠﻿"
_GAP = r"[\s\-./_  –]"
_START = re.compile(rf"[A-Za-z](?:{_GAP}|[{_UNSEEN}])*[A-Za-z](?:{_GAP}|[{_UNSEEN}])*[0-9](?:{_GAP}|[{_UNSEEN}])*[0-9]")
_CHAR = re.compile(rf"([A-Za-z0-9])|([{_UNSEEN}])|({_GAP})")


def checksum(number: str) -> int:
    """The remainder by 97 of a number with its header moved behind, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97


def numbers_in(text: str) -> list[str]:
    """Account numbers in a text, once each: of their country's length and structure, with a right checksum, and written
    without breaks, with one, or in groups of four."""
    out: list[str] = []
    for m in _START.finditer(text):
        country = "".join(c for c in m[0] if c.isascii() and c.isalpha()).upper()
        length = LENGTH.get(country)
        if not length:
            continue
        got, breaks, at, gap = [], [], m.start(), False
        while len(got) < length and (c := _CHAR.match(text, at)):
            if c[1]:
                if gap and got:
                    breaks.append(len(got))
                got.append(c[1].upper())
                gap = False
            elif c[3]:
                gap = True
            at = c.end()
        number = "".join(got)
        if len(number) == length and (len(breaks) <= 1 or all(b % 4 == 0 for b in breaks)) and number[2:4].isdigit() and _SHAPE[country].fullmatch(number[4:]) and checksum(number) == 1 and number not in out:
            out.append(number)
    return out


_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([0-7]{1,3})|(.))", re.DOTALL)
_CONTROL = {"n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\n": ""}
_ENCODED = re.compile(r"(?:[A-Za-z0-9+/_-]{20,}\s+)*[A-Za-z0-9+/_-]{4,}={0,2}")
_LEAST_ENCODED = 20


def _said(m: re.Match) -> str:
    """What an escape in a string literal stands for."""
    digits, base = (m[1] or m[2] or m[3], 16) if not m[4] else (m[4], 8)
    if digits:
        code = int(digits, base)
        return chr(code) if code <= 0x10FFFF else m[0]
    return _CONTROL.get(m[5], m[5])


def _decoded(run: str) -> str | None:
    try:
        return base64.b64decode(run.translate(str.maketrans("-_", "+/")).rstrip("=") + "=" * (-len(run.rstrip("=")) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None


def views(text: str) -> list[str]:
    """The text, and what it says behind percent signs, escapes of string literals, and one layer of base64.

    base64 may be of either alphabet and wrapped; a run is read joined, without a word that follows it, and by segment.
    """
    out = [text]
    if "%" in text:
        out.append(unquote(text))
    if "\\" in text:
        out.append(_ESCAPE.sub(_said, text))
    for m in _ENCODED.finditer(text):
        parts = m[0].split()
        runs = dict.fromkeys(["".join(parts), "".join(parts[:-1]), *parts])
        out += [said for run in runs if len(run) >= _LEAST_ENCODED and (said := _decoded(run)) is not None]
    return out


def may_hold(text: Column) -> Column:
    """Whether a text can hold a number in any view; the others never reach Python."""
    return text.rlike(r"[A-Za-z][^A-Za-z0-9]*[A-Za-z][^A-Za-z0-9]*[0-9][^A-Za-z0-9]*[0-9]") | text.contains("%") | text.contains("\\") | text.rlike(r"[A-Za-z0-9+/_-]{20}")


@F.pandas_udf(T.ArrayType(T.StringType()))
def account_numbers(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Numbers in any view of each text."""
    for t in texts:
        yield t.map(lambda x: list(dict.fromkeys(n for v in views(x or "") for n in numbers_in(v))))


def scan_numbers(rows: DataFrame, key: str, text: str, known: list[str] | None = None) -> DataFrame:
    """(key, number) without the known ones."""
    found = rows.filter(may_hold(F.col(text))).select(key, F.explode(account_numbers(F.col(text))).alias("number"))
    return found.filter(~F.col("number").isin(known)) if known else found


# Categories in order of precedence, each with its pattern.
CATEGORIES = {
    "ruling": r"(?i)\brulings?\b",
    "reviewer": r"(?i)(?<![A-Za-z])(?:sol|terra|reviewers?)(?![A-Za-z])",
    "review_round": r"(?i)(?<![A-Za-z])rounds?[\s_-]*[0-9]",
    "severity": r"(?<![A-Za-z0-9])(?:(?<![Tt]he )(?<![Aa] )(?<![Aa]n )(?<![Tt]his )(?<![Tt]hat )(?<![Ii]ts )P[0-3]|(?:MAJOR|MINOR|CRITICAL|IMPORTANT|Major|Minor|Critical|Important)\s*[0-9]+)(?![A-Za-z0-9])",
    "task_number": r"(?i)(?<![A-Za-z])tasks?[\s_-]*[0-9]+[a-z]?(?![A-Za-z0-9])",
    "work_slice": r"(?i)(?<![A-Za-z])slices?[\s_-]*[0-9]",
    "private_spec": r"(?:[A-Za-z]+\s*)?§\s*[0-9.]*|(?i:\bthe briefs?\b|\bbrief's\b)",
    "decision_code": r"(?<![A-Za-z0-9])(?:[CDEFM][0-9]{1,2}|T1[0-9]-[a-z])(?![A-Za-z0-9])",
}


def category(line: Column) -> Column:
    """The first category whose pattern a line has, or null."""
    return F.coalesce(*[F.when(line.rlike(p), name) for name, p in CATEGORIES.items()])


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, category) of lines that have one."""
    each = rows.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return each.select(key, (F.col("at") + 1).alias("line_no"), category(F.col("line")).alias("category")).filter("category IS NOT NULL")
