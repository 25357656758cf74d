"""Toxicity by maximum-scoring segment search.

A token's score is the log-odds of its rate in toxic against other texts, both smoothed by a
Dirichlet prior (FLAT a token, and more in proportion to its rate in all), brought towards 0 by SURE standard
errors, so that a word seen in few texts has no say, less a margin that makes plain text score below zero on average.
A text, or copies of one, counts a token once, as its repeats are no further evidence. One
linear scan finds every maximal scoring segment of a text (Ruzzo and Tompa). In plain text segments above a
score come at random, K a token, and exponentially fewer the higher they are, so that the largest of n tokens follows
an extreme-value law: LAMBDA * S - ln(K * n) is Gumbel distributed for any n. K and LAMBDA are measured over the
fitted plain texts, LAMBDA being at most that of the scores' distribution. Segments that the law makes unlikely are the
passages; how far they exceed it, at most and in sum, gives the text's score by a logistic fit.

Fitted on about PER_CLASS labelled training rows a class, chosen by a hash of their id.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch

PER_CLASS = 8_000
PRIOR = 2_000.0  # tokens that the prior weighs
FLAT = 0.5  # tokens that the prior weighs a token, whatever its rate
SURE = 1.64  # standard errors
MARGIN = 1.0
SIGNIFICANT = 0.01  # chance of such a segment in a plain text
_MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def token(chunk: str) -> str:
    return chunk.strip(_MARKS).lower()


class Scores(dict):
    """Chunk to score, by way of its token; bounded."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known

    def __missing__(self, chunk: str) -> float:
        s = self.known.get(token(chunk), -MARGIN)
        if len(self) < 300_000:
            self[chunk] = s
        return s


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order: linear in tokens, with a stack of positive ones."""
    after = np.cumsum(scores)
    held: list[list] = []  # start, end, sum before, sum after
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, after[i] - scores[i], after[i]]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                held.append([*new, j])
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
    return [(s[0], s[1], float(s[3] - s[2])) for s in held]


class Model:
    def __init__(self, known: dict[str, float], scale: float = 1.0, centre: float = 0.0, weights: tuple = (-4.0, 0.0, 0.0)):
        self.key = uuid.uuid4().hex
        self.known, self.scale, self.centre, self.weights = known, scale, centre, np.array(weights)
        self.scores: Scores | None = None

    def __getstate__(self):
        return {**self.__dict__, "scores": None}

    def found(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        if self.scores is None:
            self.scores = Scores(self.known)
        words = (text or "").split()
        s = np.fromiter(map(self.scores.__getitem__, words), np.float64, len(words))
        return len(words), segments(s)

    def excess(self, n: int, s: float) -> float:
        """Standardised Gumbel variate of a segment of score s in n tokens."""
        return self.scale * s - np.log(max(n, 1)) - self.centre

    def features(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        """Constant, largest excess, log of the sum of positive excesses; and the significant segments."""
        n, all_found = self.found(text)
        each = [self.excess(n, s) for _, _, s in all_found]
        limit = -np.log(-np.log1p(-SIGNIFICANT))
        x = np.array([1.0, min(max([*each, -3.0]), 30.0), np.log1p(sum(e for e in each if e > 0))])
        return x, [f for f, e in zip(all_found, each) if e >= limit]

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        x, passages = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))), passages


def log_odds(toxic: Column, plain: Column, all_toxic: int, all_plain: int, tokens: int) -> Column:
    """Of a token that occurs in so many toxic and plain texts, out of all such counts summed; 0 if it may as well be 0."""
    prior = F.lit(PRIOR / (all_toxic + all_plain)) * (toxic + plain) + FLAT
    spread = PRIOR + FLAT * tokens
    ra, rb = (F.least((n + prior) / F.lit(total + spread), F.lit(0.999)) for n, total in ((toxic, all_toxic), (plain, all_plain)))
    odds = F.ln(ra / (1 - ra)) - F.ln(rb / (1 - rb))
    error = F.sqrt(1 / (toxic + prior) + 1 / (plain + prior))
    return F.signum(odds) * F.greatest(F.abs(odds) - SURE * error, F.lit(0.0))


def karlin(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p * exp(root * s) = 1; 1 if there is none."""
    p = weights / weights.sum()
    if (values * p).sum() >= 0 or values.max() <= 0:
        return 1.0
    lo, hi = 1e-6, 50.0 / values.max()
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * values)).sum() < 1 else (lo, mid)
    return lo


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by = (Counter(), Counter())
        for text, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
            by[toxic].update(set(map(token, set((text.as_py() or "").split()))))
        both: dict[str, list[int]] = {}
        for k, counter in enumerate(by):
            for word, n in counter.items():
                both.setdefault(word, [0, 0])[k] = n
        both.pop("", None)
        yield pa.RecordBatch.from_arrays([pa.array(list(both), pa.string()), pa.array([v[1] for v in both.values()], pa.int64()), pa.array([v[0] for v in both.values()], pa.int64())], ["token", "toxic", "plain"])


def _measure(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, rest, tox = [], [], []
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
                n, all_found = shared.value.found(text.as_py())
                ns.append(n)
                tox.append(toxic)
                rest.append([s for _, _, s in all_found])
            yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int64()), pa.array(tox, pa.int32()), pa.array(rest, pa.list_(pa.float64()))], ["n", "toxic", "found"])

    return run


def fit(rows: DataFrame, scratch: Scratch) -> Model:
    """From rows (text, toxic 0 or 1), a bounded sample."""
    spark = rows.sparkSession
    rows = scratch.save(rows, "sample")
    table = rows.dropDuplicates(["text", "toxic"]).mapInArrow(_count, "token string, toxic long, plain long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    table = scratch.save(table, "tokens")
    a, b, tokens = table.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("plain"), F.lit(0)), F.count(F.lit(1))).first()
    if not a or not b:
        return Model({})
    odds = log_odds(F.col("toxic"), F.col("plain"), a, b, tokens)
    told = table.select("token", "plain", odds.alias("odds")).filter("odds <> 0").orderBy("token").toArrow()  # any other token is at -MARGIN
    values, times = told["odds"].to_numpy() - MARGIN, told["plain"].to_numpy()
    known = dict(zip(told["token"].to_pylist(), values.tolist()))
    model = Model(known, karlin(np.append(values, -MARGIN), np.append(times, b - times.sum()).astype(np.float64)))
    measured = rows.mapInArrow(_measure(spark.sparkContext.broadcast(model)), "n long, toxic int, found array<double>").toArrow()
    n, toxic = (measured[c].to_numpy() for c in ("n", "toxic"))
    found = measured["found"].to_pylist()
    plain = [s for own, t in zip(found, toxic) if t == 0 for s in own]
    # By their median, which toxic wording that labels have missed hardly moves.
    model.scale = min(model.scale, np.log(2) / max(float(np.median(plain)), 1e-9)) if plain else model.scale
    model.centre = float(np.log((len(plain) + 1) / (n[toxic == 0].sum() + 1)))
    x = np.ones((len(n), 3))
    for i, own in enumerate(found):
        each = [model.excess(n[i], s) for s in own]
        x[i, 1:] = min(max([*each, -3.0]), 30.0), np.log1p(sum(e for e in each if e > 0))
    model.weights = logistic(x, toxic.astype(np.float64), np.ones(len(n)))
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t.as_py()) for t in batch["text"]]
            passages = [[{"start": s, "end": e, "score": x} for s, e, x in p] for _, p in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([s for s, _ in found], pa.float64()), pa.array(passages, kind)], ["doc_id", "held_out", "score", "passages"])

    return run


def rate(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), passages (start, end in tokens, score).

    part is true for rows that are held out, as an expression over doc_id. labels is (doc_id, toxic); a null
    label teaches nothing, and of repeated ones the largest holds. Null text is empty and has no passage.
    Without labels of both kinds all scores are low. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    taught = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).filter(~part)
    taught = scratch.save(taught, "labels")
    counts = {r.toxic: r.n for r in taught.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, PER_CLASS / max(counts.get(1, 1), 1)))).otherwise(F.lit(min(1.0, PER_CLASS / max(counts.get(0, 1), 1))))
    sample = F.broadcast(taught.filter(draw < share))  # about 2 * PER_CLASS rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), part.alias("held_out"))
    model = fit(rows.join(sample, "doc_id").select("text", "toxic"), scratch)
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    used = [min(counts.get(k, 0), PER_CLASS) + 1 for k in (0, 1)]
    if model.known:  # from the sample's share of toxic rows to that of all
        model.weights[0] += np.log(prior / (1 - prior)) - np.log(used[1] / used[0])
    kind = dict(rows.dtypes)["doc_id"]
    shared = spark.sparkContext.broadcast(model)  # tokens of the sample
    return rows.select("doc_id", "held_out", "text").mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, score double, passages array<struct<start: int, end: int, score: double>>")
