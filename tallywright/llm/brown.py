"""Brown class-based n-gram language model, its classes found by exchange clustering.

Every word of the training rows has a learnt class. One pass counts words, one writes documents as ids of the HEAD
most frequent words, with their other words beside them. Exchange clustering moves the CORE most frequent words between
CLASSES classes while the likelihood of the pairs rises. Each other word of the head, and then each word beyond it,
joins the class with the greatest gain in the same likelihood, from how often each class stands left and right of
it, in as many tasks as there are. The pairs of all words, summed by class, give transitions; word counts give emissions:

    p(w | v) = MIX * P(class w | class v) * P(w | class w) + (1 - MIX) * (c(w) + 0.1) / (N + 0.1 * (V + 1))

Only a word unseen in training has no learnt class: it falls in a signature class (a hash of its last two bytes), which
has no pairs, so that the second term scores it and the word after it follows the mean of all classes. HEAD and CORE bound
what is broadcast and clustered on the driver, not what is counted or placed; words beyond the head get counts and classes by a join.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch

HEAD = 200_000  # words whose counts are broadcast
CORE = 2_000  # words that are clustered
CLASSES = 48
SIGNATURES = 64
SWEEPS = 8
MIX = 0.9
ADD = 0.1
BACK = 50.0  # weight of the class distribution in transitions
NEAR = CLASSES + 2  # what stands beside a word while words are placed: a class, an end, or a word that has no class yet
END_ID = -2


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def signature(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SIGNATURES


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counter.keys()), pa.binary()), pa.array(list(counter.values()), pa.int64())], ["word", "n"])
        counter.clear()
        return batch

    for batch in batches:
        for text in batch["text"]:
            counter.update(words_of(text.as_py()))
            if len(counter) > 150_000:
                yield out()
    yield out()


def _encode(shared):
    """Documents as ids of head words, -1 for any other word, and those words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {w: i for i, w in enumerate(shared.value)}.get
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                ids, rare = [], []
                for text in some["text"]:
                    words = words_of(text.as_py())
                    at = np.fromiter(map(get, words, itertools.repeat(-1)), np.int32, len(words))
                    ids.append(at.tobytes())
                    rare.append([words[i] for i in np.flatnonzero(at < 0).tolist()])
                columns = [pa.array(range(row, row + len(ids)), pa.int64()), some["doc_id"], some["held_out"], pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))]
                row += len(ids)
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "ids", "rare"])

    return run


def _stream(ids: pa.Array) -> np.ndarray:
    """The documents' ids one after another, with END_ID before, between and after them."""
    end = np.array([END_ID], np.int32)
    return np.concatenate([end, *itertools.chain.from_iterable((np.frombuffer(x.as_py(), np.int32), end) for x in ids)])


def _pairs(shared, symbols: int):
    """Pairs of neighbouring symbols; the shared table gives the symbol by id, its last two those of END_ID and of words beyond the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(symbols * symbols, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                s = shared.value[_stream(batch["ids"].slice(start, 2000))].astype(np.int64)
                pair, n = np.unique(s[:-1] * symbols + s[1:], return_counts=True)
                seen[pair] += n
        at = np.flatnonzero(seen)
        for a in range(0, len(at), 200_000):
            some = at[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["pair", "n"])

    return run


def _gather(encoded: DataFrame, shared, symbols: int) -> np.ndarray:
    """The matrix of pairs over all training rows."""
    found = encoded.filter(~F.col("held_out")).select("ids").mapInArrow(_pairs(shared, symbols), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most one row per pair of symbols
    pairs = np.zeros(symbols * symbols)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    return pairs.reshape(symbols, symbols)


def _head_near(shared, core: int):
    """(word, near, n): how often each class stands left (near < NEAR) and right of each head word that is not in the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((key // (2 * NEAR)).astype(np.int32)), pa.array((key % (2 * NEAR)).astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "near", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                ids = _stream(batch["ids"].slice(start, 2000))
                cls, at = shared.value[ids].astype(np.int64), np.flatnonzero(ids >= core)
                key = ids[at].astype(np.int64) * (2 * NEAR)
                held += [key + cls[at - 1], key + NEAR + cls[at + 1]]
                size += 2 * len(at)
                if size > 3_000_000:
                    yield out()
                    size = 0
        yield out()

    return run


def _tail_near(shared):
    """(word, left, right): the classes beside each word beyond the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                some = batch.slice(start, 2000)
                ids = _stream(some["ids"])
                cls, at = shared.value[ids].astype(np.int32), np.flatnonzero(ids == -1)
                yield pa.RecordBatch.from_arrays([some["rare"].flatten(), pa.array(cls[at - 1]), pa.array(cls[at + 1] + NEAR)], ["word", "left", "right"])

    return run


def place(word: np.ndarray, near: np.ndarray, n: np.ndarray, words: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the greatest gain, and the count, of words 0 to words - 1: word i has class near[j] beside it n[j] times where word[j] is i.

    pairs are the pairs of classes, NEAR by NEAR. The gain is that of exchange(), for a word that is in no class yet.
    """
    k = np.arange(CLASSES)
    key, at = np.unique(word.astype(np.int64) * (2 * NEAR) + near, return_inverse=True)
    n = np.bincount(at, n, len(key))
    word, near = key // (2 * NEAR), key % (2 * NEAR)
    beside = np.concatenate((pairs[:, :CLASSES], pairs[:CLASSES].T))
    size, own = pairs.sum(0)[:CLASSES], np.bincount(word, n * (near < NEAR), words)
    known = _xlogx(beside)
    gain = np.zeros((words, CLASSES))
    for a in range(0, len(key), 50_000):
        w, f = word[a : a + 50_000], near[a : a + 50_000]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[first]] += np.add.reduceat(_xlogx(beside[f] + n[a : a + 50_000, None]) - known[f], first)
    both = np.zeros((2, words, CLASSES))
    left, right = near < CLASSES, (near >= NEAR) & (near < NEAR + CLASSES)
    both[0, word[left], near[left]] = n[left]
    both[1, word[right], near[right] - NEAR] = n[right]
    i, c = np.nonzero((both[0] > 0) & (both[1] > 0))
    l, r, d = both[0, i, c], both[1, i, c], pairs[c, c]
    gain[i, c] += _xlogx(d + l + r) - _xlogx(d + l) - _xlogx(d + r) + _xlogx(d)
    gain -= 2 * (_xlogx(size[k] + own[:, None]) - _xlogx(size[k]))
    if size.any():  # words are placed apart from one another, so a class that no word is in yet would draw unlike ones together
        gain[:, size == 0] = -np.inf
    return gain.argmax(1), own


def _placed(pairs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                some = batch.slice(start, 2000)
                near = some["near"].flatten().to_numpy(zero_copy_only=False)
                times = some["n"].flatten().to_numpy(zero_copy_only=False) if "n" in batch.schema.names else np.ones(len(near))
                word = np.repeat(np.arange(some.num_rows), some["near"].value_lengths().to_numpy(zero_copy_only=False))
                cls, n = place(word, near, times, some.num_rows, pairs)
                yield pa.RecordBatch.from_arrays([some["word"], pa.array(cls.astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "cls", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-9))


def exchange(pairs: np.ndarray, core: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each symbol: the first `core` are clustered, each other one is a class of its own.

    The likelihood of a class model is sum f(N(c, d)) - 2 sum f(N(c)) with f(x) = x log x. Each word leaves its class
    and joins the one that raises that most, until a sweep moves hardly any word.
    """
    symbols = len(pairs)
    cls = np.concatenate((np.arange(core) % classes, classes + np.arange(symbols - core)))
    total = classes + symbols - core
    member = np.zeros((symbols, total))
    member[np.arange(symbols), cls] = 1
    n = member.T @ pairs @ member
    size = pairs.sum(0) @ member
    weight = pairs.sum(0)
    for _ in range(sweeps):
        moves = 0
        for w in range(core):
            old = cls[w]
            left, right, own = np.bincount(cls, pairs[:, w], total), np.bincount(cls, pairs[w], total), pairs[w, w]
            left[old] -= own
            right[old] -= own
            n[:, old] -= left
            n[old] -= right
            n[old, old] -= own
            size[old] -= weight[w]
            cols, rows = n[:, :classes], n[:classes]
            gain = (_xlogx(cols + left[:, None]) - _xlogx(cols)).sum(0) + (_xlogx(rows + right) - _xlogx(rows)).sum(1)
            k = np.arange(classes)
            diagonal = n[k, k]
            gain += _xlogx(diagonal + left[k] + right[k] + own) - _xlogx(diagonal + left[k]) - _xlogx(diagonal + right[k]) + _xlogx(diagonal)
            gain -= 2 * (_xlogx(size[k] + weight[w]) - _xlogx(size[k]))
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moves += new != old
            cls[w] = new
            n[:, new] += left
            n[new] += right
            n[new, new] += own
            size[new] += weight[w]
        if moves <= core // 200:
            break
    return cls


@dataclass
class Model:
    key: str
    head: list[bytes]  # most frequent first; the first ones are the core
    counts: np.ndarray  # of the head
    total: int  # N, ends included
    distinct: int  # V, the end included
    core: int
    classes: np.ndarray  # class by symbol: core words, signatures, end
    transition: np.ndarray  # P(class | class before), by class before
    room: np.ndarray  # by class: what (c + ADD) is divided by in a signature class, c in a learnt class
    head_class: np.ndarray | None = None  # class by head word; without it, words beyond the core are in their signature's

    @property
    def spread(self) -> float:
        return self.total + ADD * (self.distinct + 1)


def fit(rows: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model of the rows that are not held out (text as binary), and all rows as ids with the classes and counts of words beyond the head."""
    spark = rows.sparkSession
    train = rows.filter(~F.col("held_out")).select("text")
    counts = scratch.save(train.mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    ends = train.count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    head_words, head_counts = head["word"].to_pylist(), head["n"].to_numpy().astype(np.float64)
    share = spark.sparkContext.broadcast
    kind = dict(rows.dtypes)["doc_id"]
    encoded = scratch.save(rows.mapInArrow(_encode(share(head_words)), f"row long, doc_id {kind}, held_out boolean, ids binary, rare array<binary>"), "encoded")
    scratch.drop("counts")
    learn = encoded.filter(~F.col("held_out"))

    core, end, rest = min(CORE, len(head_words)), CLASSES, CLASSES + 1
    symbol = np.full(len(head_words) + 2, core + 1)
    symbol[:core], symbol[END_ID] = np.arange(core), core
    pairs = _gather(encoded, share(symbol), core + 2)
    cls = exchange(pairs, core)
    member = np.zeros((core + 2, NEAR))
    member[np.arange(core + 2), cls] = 1

    beside = np.full(len(head_words) + 2, rest)
    beside[:core], beside[END_ID] = cls[:core], end
    near = learn.select("ids").mapInArrow(_head_near(share(beside), core), "word int, near int, n long").repartition("word").groupBy("word", "near").agg(F.sum("n").alias("n"))
    listed = near.groupBy("word").agg(F.collect_list(F.struct("near", "n")).alias("x")).select("word", "x.near", "x.n")  # at most 2 * NEAR a word
    found = listed.mapInArrow(_placed(member.T @ pairs @ member), "word int, cls int, n long").toArrow()  # at most HEAD rows
    beside[found["word"].to_numpy()] = found["cls"].to_numpy()

    shared = share(beside)
    beyond = learn.select("ids", "rare").mapInArrow(_tail_near(shared), "word binary, left int, right int").groupBy("word").agg(F.concat(F.collect_list("left"), F.collect_list("right")).alias("near"))
    tail = beyond.mapInArrow(_placed(_gather(encoded, shared, NEAR)), "word binary, cls int, n long")

    signed = F.when(F.octet_length("word") >= 2, F.expr("substring(word, octet_length(word) - 1, 2)")).otherwise(F.col("word"))
    rare = encoded.select("row", F.posexplode("rare").alias("pos", "word")).join(tail, "word", "left")
    looked = rare.select("row", "pos", F.coalesce("cls", F.crc32(signed) % SIGNATURES + CLASSES).cast("int").alias("cls"), F.coalesce("n", F.lit(0)).alias("n"))
    sets = looked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "cls", "n"))).alias("x")).select("row", F.col("x.cls").alias("cls"), F.col("x.n").alias("n"))
    full = scratch.save(encoded.drop("rare").join(sets, "row", "left"), "full")
    scratch.drop("encoded")

    total = CLASSES + SIGNATURES + 1
    classes = np.concatenate((cls[:core], CLASSES + np.arange(SIGNATURES + 1)))
    model = Model(uuid.uuid4().hex, head_words, head_counts, tokens + ends, distinct + (ends > 0), core, classes, np.zeros((total, total)), np.ones(total), beside[: len(head_words)])
    found = full.filter(~F.col("held_out")).mapInArrow(_class_pairs(share((model.head_class, total))), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(total * total)
    n[found["pair"].to_numpy()] = found["n"].to_numpy()
    n = n.reshape(total, total)
    model.transition = (n + BACK * n.sum(0) / max(n.sum(), 1)) / (n.sum(1, keepdims=True) + BACK)
    model.room = np.maximum(n.sum(0), 1)
    return model, full


def _classes(batch: pa.RecordBatch, i: int, head_class: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a row, and its classes with an end before and after."""
    ids = np.frombuffer(batch["ids"][i].as_py(), np.int32)
    cls = np.full(len(ids) + 2, end, np.int64)
    inside = ids >= 0
    cls[1:-1][inside] = head_class[ids[inside]]
    if not inside.all():
        cls[1:-1][~inside] = batch["cls"][i].values.to_numpy()
    return ids, cls


def _class_pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_class, total = shared.value
        seen = np.zeros(total * total, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                cls = _classes(batch, i, head_class, total - 1)[1]
                np.add.at(seen, cls[:-1] * total + cls[1:], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["pair", "n"])

    return run


_ready: dict = {}


def _prepared(model: Model) -> tuple:
    if model.key not in _ready:
        _ready.clear()
        index = {w: i for i, w in enumerate(model.head)}
        symbol = np.array([i if i < model.core else model.core + signature(w) for i, w in enumerate(model.head)], np.int64)
        _ready[model.key] = index, model.classes[symbol] if model.head_class is None and len(symbol) else model.head_class
    return _ready[model.key]


def score_classes(cls: np.ndarray, c: np.ndarray, learnt: np.ndarray, model: Model) -> tuple[float, float]:
    """Base and model scores (log10) of words and their end; cls has an end before them, c their counts."""
    step = (MIX if model.total else 0.0) * model.transition[cls[:-1], cls[1:]]
    floor = (1 - (MIX if model.total else 0.0)) / model.spread
    counted, room = c + ADD, model.room[cls[1:]]
    p = np.where(learnt, step * c / room + floor * counted, counted * (step / room + floor))
    return float(np.log10(counted).sum() - len(counted) * np.log10(model.spread)), float(np.log10(p).sum())


def score_text(text: bytes | None, model: Model, ends: int) -> tuple[int, int, float, float]:
    """Tokens, known tokens, base and model scores of a text; words beyond the head count as unseen."""
    index, head_class = _prepared(model)
    words = words_of(text)
    at = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
    cls = np.array([model.classes[-1], *[head_class[i] if i >= 0 else model.classes[model.core + signature(w)] for i, w in zip(at, words)], model.classes[-1]], np.int64)
    c = np.array([*[model.counts[i] if i >= 0 else 0.0 for i in at], ends])
    learnt = np.array([*(at >= 0) & ((at < model.core) | (model.head_class is not None)), True])
    return len(c), int((c > 0).sum()), *score_classes(cls, c, learnt, model)


def _scores(shared, ends: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                ids, cls = _classes(batch, i, model.head_class, len(model.room) - 1)
                c = np.full(len(ids) + 1, float(ends))
                inside = ids >= 0
                c[:-1][inside] = model.counts[ids[inside]]
                if not inside.all():
                    c[:-1][~inside] = batch["n"][i].values.to_numpy()
                found.append((len(c), int((c > 0).sum()), *score_classes(cls, c, c > 0, model)))
            columns = [batch["doc_id"], batch["held_out"]]
            columns += [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the rows that are not held out. Null text is empty: its one token is the end. Repeated rows
    count and score as rows of their own. With nothing to learn from, score is base_score. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), held_out.alias("held_out"))
    model, full = fit(rows, Scratch(docs.sparkSession, "brown"))
    ends = int(model.room[-1]) if model.total else 0
    model.head = []  # ids stand for words from here on
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
    scored = full.mapInArrow(_scores(shared, ends), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
