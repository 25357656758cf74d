"""Full text over notes: postings, boolean match, BM25. Everything is a join or an aggregate over (term, note)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.stem import stem

K1, B = 1.2, 0.75


def postings(notes: DataFrame, key: str = "note_id", text: str = "note") -> DataFrame:
    """(key, term, times, length): terms are runs of letters and digits, lower-cased, not stemmed; search() stems."""
    terms = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    each = notes.select(key, terms.alias("terms"))
    return each.select(key, F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("times"), F.first("length").alias("length"))


def match(notes: DataFrame, every: list[str], none: list[str] | None = None, *, prefix: list[str] | None = None, key: str = "note_id", text: str = "note") -> DataFrame:
    """(key, score): notes with every term and, for each prefix, a word that begins with it, and none of `none`."""
    found = postings(notes, key, text)
    total = notes.agg(F.count(F.lit(1)).alias("notes"), F.avg(F.size(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))).alias("mean"))
    wanted = found.filter(F.col("term").isin(every))
    rarity = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = wanted.join(F.broadcast(rarity), "term").join(F.broadcast(total))  # one row per query term, and one row
    idf = F.log(1 + (F.col("notes") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("times") * (K1 + 1) / (F.col("times") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hits = scored.groupBy(key).agg(F.count(F.lit(1)).alias("terms"), F.sum(weight).alias("score")).filter(F.col("terms") == len(set(every)))
    for p in prefix or []:
        hits = hits.join(found.filter(F.col("term").startswith(p)), key, "left_semi")
    if none:
        hits = hits.join(found.filter(F.col("term").isin(none)), key, "left_anti")
    return hits.select(key, "score")


def phrase(notes: DataFrame, words: list[str], key: str = "note_id", text: str = "note") -> DataFrame:
    """Notes in which the words follow one another."""
    terms = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return notes.filter(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")).contains(" " + " ".join(words) + " ")).select(key)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield batch.map(lambda own: [stem(w) for w in own])


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def parse(query: str) -> list[list[tuple[bool, list[str], bool]]]:
    """A query as alternatives of clauses (wanted, words in a row, last word is a prefix).

    Words side by side and AND ask for all, OR for either, NOT for none of what follows; "..." is a phrase; * ends a
    prefix. An unbalanced quote, an operator without a word, or a query that only excludes is an error.
    """
    pieces = re.findall(r'"([^"]*)"|(")|([^\s"]+)', query)
    out: list[list[tuple[bool, list[str], bool]]] = [[]]
    wanted, due = True, True
    for phrase, open_quote, word in pieces:
        if open_quote:
            raise ValueError("unbalanced quote")
        if word in ("AND", "OR", "NOT"):
            if due and word != "NOT" or not wanted:
                raise ValueError(f"{word} without a word before it")
            if word == "OR":
                out.append([])
            wanted, due = word != "NOT", True
            continue
        prefix = word.endswith("*")
        words = [stem(w) if not prefix else w for w in re.split(r"[\W_]+", (phrase or word.rstrip("*")).lower()) if w]
        if not words:
            raise ValueError("a clause without a word")
        out[-1].append((wanted, words, prefix))
        wanted, due = True, False
    if due or not all(any(w for w, *_ in clauses) for clauses in out):
        raise ValueError("nothing to look for")
    return out


def search(notes: DataFrame, query: str, key: str = "note_id", text: str = "note") -> DataFrame:
    """The keys of notes that a query asks for, over stemmed words; each note is read once."""
    rows = notes.select(key, _terms(F.col(text)).alias("plain"))
    rows = rows.withColumn("line", F.concat(F.lit(" "), F.array_join(stemmed("plain"), " "), F.lit(" "))).withColumn("raw", F.concat(F.lit(" "), F.array_join("plain", " "), F.lit(" ")))

    def has(words: list[str], prefix: bool) -> Column:
        return F.col("raw" if prefix else "line").contains(" " + " ".join(words) + ("" if prefix else " "))

    keep = F.lit(False)
    for clauses in parse(query):
        every = F.lit(True)
        for wanted, words, prefix in clauses:
            every = every & (has(words, prefix) if wanted else ~has(words, prefix))
        keep = keep | every
    return rows.filter(keep).select(key)


def best(notes: DataFrame, scores: DataFrame, key: str = "note_id", row: str = "row_id") -> DataFrame:
    """(row, key, score): the best-ranked note of each row among those with a score; of equal scores the first note."""
    ranked = notes.select(key, row).join(scores.select(key, "score"), key)
    top = F.max_by(F.struct(key, "score"), F.struct("score", -F.col(key))).alias("top")
    return ranked.groupBy(row).agg(top).select(row, f"top.{key}", "top.score")
