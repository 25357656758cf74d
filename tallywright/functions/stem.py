"""The Porter stemmer (M. F. Porter, 1980), by tables of endings."""

from __future__ import annotations

import re

# Fixed values of the published algorithm: ending and what replaces it, by step.
_PLURAL = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
_STEP2 = dict(p.split(":") for p in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
_STEP3 = dict(p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_RUN = re.compile(r"v+c+")


def _kinds(word: str) -> str:
    """v or c by letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_RUN.findall(_kinds(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and any but a-z, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for end, new in _PLURAL:
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                rest = word[: -len(end)]
                if "v" in _kinds(rest):
                    if rest.endswith(("at", "bl", "iz")) or (_measure(rest) == 1 and _short(rest)):
                        rest += "e"
                    elif _double(rest) and rest[-1] not in "lsz":
                        rest = rest[:-1]
                    word = rest
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = _longest(word, _STEP4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
