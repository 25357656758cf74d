"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: of the character n-grams of 1 to 4 that occur
in either, how many occur in both, divided by the root of the product of how many each has. n-grams of
the whole lower-cased text, runs of white space, digits and signs as one space, are 32-bit hashes; a long text has as many as
it needs. Nystroem landmarks make the kernel a map into LANDMARKS dimensions, on which one-versus-rest kernel ridge
regression is solved. Texts are scored in batches by two matrix products, whose columns are the landmarks' n-grams.

Fitted on about PER_LANGUAGE labelled training rows a language, chosen by a hash of their id. Their n-grams stay on
the executors, but for the landmarks: those of a language are its first ones in order of that hash, of at most
LANDMARK_GRAMS n-grams, or else those with the fewest.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch, bounded_batches, numbered

LANDMARKS = 128
LANDMARK_GRAMS = 2500
PER_LANGUAGE = 400
RIDGE = 1e-2
BATCH = 64
SPAN = 1 << 20  # characters whose n-grams are hashed at once
UNKNOWN = "und"

_OTHER = re.compile(r"(?:[\W\d_])+")
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    """Whether a character is of the Unicode categories L*."""
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of text, as hashes in order."""
    codes = np.frombuffer(f" {_OTHER.sub(' ', text.lower())} ".encode("utf-32-le", "replace"), np.uint32)
    seen = np.zeros(0, np.uint32)
    for start in range(0, len(codes), SPAN):
        piece, found = codes[start : start + SPAN + 3], [seen]
        h = np.zeros(len(piece), np.uint32)
        for n in range(4):
            m = min(SPAN, len(piece) - n)
            if m <= 0:
                break
            h = (h[:m] ^ piece[n : n + m]) * _PRIMES[n]
            h ^= h >> np.uint32(15)
            found.append((h + np.uint32(n)) * _PRIMES[3])
        seen = np.unique(np.concatenate(found))
    return seen


class Landmarks:
    def __init__(self, sets: list[np.ndarray]):
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint32), *sets]))
        self.holds = np.zeros((len(self.grams), len(sets)), np.float32)
        for i, own in enumerate(sets):
            self.holds[np.searchsorted(self.grams, own), i] = 1
        self.root = np.sqrt(np.maximum([len(own) for own in sets], 1))

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row per set, a column per landmark."""
        sizes = np.array([len(own) for own in sets])
        key, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        at = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        hit = self.grams[at] == key
        x = np.zeros((len(sets), len(self.grams)), np.float32)
        x[row[hit], at[hit]] = 1
        return (x @ self.holds) / (np.sqrt(np.maximum(sizes, 1))[:, None] * self.root)


class Model:
    def __init__(self, landmarks: Landmarks | None, own: np.ndarray, rows: np.ndarray, langs: list[str]):
        """own: the kernel of the landmarks with themselves; rows: of training rows with them, labelled langs."""
        self.landmarks, self.langs = landmarks, sorted(set(langs))
        if landmarks is None:
            return
        values, vectors = np.linalg.eigh(own)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        mapped = rows @ root
        goal = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        sizes = Counter(langs)
        weight = 1.0 / np.array([sizes[lang] for lang in langs])  # each language weighs the same
        gram = mapped.T @ (mapped * weight[:, None]) + RIDGE / len(self.langs) * np.eye(mapped.shape[1])
        self.weights = root @ np.linalg.solve(gram, mapped.T @ (goal * weight[:, None]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        good = [i for i, t in enumerate(texts) if has_letter(t)] if self.landmarks else []
        for a in range(0, len(good), BATCH):
            some = good[a : a + BATCH]
            f = self.landmarks.kernel([grams(texts[i]) for i in some]) @ self.weights
            for i, best, top in zip(some, f.argmax(1).tolist(), f.max(1).tolist()):
                langs[i], scores[i] = self.langs[best], min(1.0, max(0.0, (top + 1) / 2))
        return langs, scores


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            some = batch.slice(start, BATCH)
            found = [grams(t) if has_letter(t) else None for t in some["text"].to_pylist()]
            columns = [some["lang"], some["draw"], pa.array([None if f is None else f.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "draw", "grams"]).filter(pa.array([f is not None for f in found]))


def _kernels(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                some = batch.slice(start, BATCH)
                k = shared.value.kernel([np.frombuffer(g.as_py(), np.uint32) for g in some["grams"]])
                yield pa.RecordBatch.from_arrays([some["row"], pa.array(list(k), pa.list_(pa.float64()))], ["row", "k"])

    return run


def fit(train: DataFrame) -> Model:
    """From train (doc_id, text, lang), all three not null."""
    spark = train.sparkSession
    counts = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return Model(None, np.zeros((0, 0)), np.zeros((0, 0)), [])
    share = spark.createDataFrame([(lang, min(1.0, PER_LANGUAGE / n)) for lang, n in sorted(counts.items())], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    drawn = train.withColumn("draw", draw).join(F.broadcast(share), "lang").filter(F.col("draw") < F.col("share"))
    sets = drawn.select("lang", "draw", "text").mapInArrow(_sets, "lang string, draw double, grams binary")
    sample = numbered(sets, "row", Scratch(spark, "langid"), "sample")
    rows = sample.select("row", "lang", "draw", (F.octet_length("grams") / 4).cast("int").alias("n"), F.xxhash64("grams").alias("same")).collect()  # about PER_LANGUAGE rows a language
    rows.sort(key=lambda r: (r.lang, max(0, r.n - LANDMARK_GRAMS), r.draw, r.same))
    if not rows:
        return Model(None, np.zeros((0, 0)), np.zeros((0, 0)), [])
    each = max(1, LANDMARKS // len({r.lang for r in rows}))
    chosen = [r.row for _, own in itertools.groupby(rows, lambda r: r.lang) for r in itertools.islice(own, each)]
    own = {r.row: np.frombuffer(r.grams, np.uint32) for r in sample.filter(F.col("row").isin(chosen)).select("row", "grams").collect()}
    landmarks = Landmarks([own[i] for i in chosen])
    found = {r.row: r.k for r in sample.select("row", "grams").mapInArrow(_kernels(spark.sparkContext.broadcast(landmarks)), "row long, k array<double>").collect()}
    return Model(landmarks, np.array([found[i] for i in chosen]), np.array([found[r.row] for r in rows]), [r.lang for r in rows])


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4 * BATCH):
                some = batch.slice(start, 4 * BATCH)
                langs, scores = shared.value.predict(some["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (0 to 1).

    Learns from text and lang of rows that are not held out and have both. Null text, or text without a
    letter, is "und" with score 0, as is everything if there is nothing to learn from. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out.alias("held_out"))
    model = fit(rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()))
    shared = spark.sparkContext.broadcast(model)  # LANDMARKS by at most LANDMARKS * LANDMARK_GRAMS numbers, where enough texts are that short
    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
