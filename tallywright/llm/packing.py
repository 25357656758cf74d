"""Best-fit packing of tokenized documents with swap-based local search.

Documents become token ids, then pieces of at most a sequence's length. Pieces are dealt by hash into
groups of a few thousand, and each group is packed in one task: best fit decreasing first, then
local search that moves or exchanges documents between underfull bins, each step raising the sum of
squared fill, until no step gains or the group holds as few bins as its tokens allow. A group costs at most
a part of one bin over what a single packing of all rows could reach.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch, bounded_batches, numbered

LENGTH = 4096
END_ID = 1
GROUP = 4096  # pieces in a group, about


class ChunkCodec:
    """Token ids of texts, by way of a bounded pool of their blank-separated chunks.

    The tokenizer drops white space and never joins tokens across it, so a text's ids are those of its chunks in order;
    it lowers A-Z too. Only space and line feed part chunks here; other white space stays within one, for the tokenizer
    to handle. Arrow parts the texts of a batch and finds its distinct chunks; each new one is encoded once, and the ids of
    all texts are then gathered from the pool at once.
    """

    def __init__(self, path: str, limit: int = 600_000, core: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.core = limit, core
        self.at = {"": 0}  # chunk to its place in the pool
        self.start, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        vocabulary = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            ends[i] = token.endswith("</w>")
        self.ends = ends

    def ids_of(self, chunk: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, np.uint32)

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places one after another, and where each place's begin, with the end of the last."""
        size = self.size[place]
        after = np.concatenate(([0], np.cumsum(size)))
        return self.ids[np.repeat(self.start[place] - after[:-1], size) + np.arange(after[-1])], after

    def add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New chunks with their ids one after another."""
        n = len(self.at)
        first = int(self.start[n - 1] + self.size[n - 1])
        self.start, self.size, self.ids = _room(self.start, n + len(chunks)), _room(self.size, n + len(chunks)), _room(self.ids, first + len(ids))
        self.ids[first : first + len(ids)] = ids
        self.size[n : n + len(chunks)] = sizes
        self.start[n : n + len(chunks)] = first + np.cumsum(sizes) - sizes
        self.at.update(zip(chunks, range(n, n + len(chunks))))

    def add_each(self, chunks: list[str]) -> None:
        for a in range(0, len(chunks), 2000):
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(chunks[a : a + 2000], add_special_tokens=False)]
            self.add(chunks[a : a + 2000], np.concatenate(found), np.array([len(x) for x in found]))

    def learn(self, missing: list[str]) -> None:
        """Words of letters are encoded many at a time: each ends with a token that closes a word. Marks after one are tokens of their own."""
        parts = {c: m.groups() for c in missing if (m := _MARKED.match(c))}
        words = {c for c in missing if c.isalpha()}
        words.update(w for w, _ in parts.values())
        words = list(words.difference(self.at))
        for a in range(0, len(words), 2000):
            some = words[a : a + 2000]
            lines = [" ".join(some[b : b + 100]) for b in range(0, len(some), 100)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                self.add(some, ids, np.diff(stops, prepend=0))
            else:
                self.add_each(some)
        self.add_each(list({marks for _, marks in parts.values()}.difference(self.at)))
        if parts:
            place = np.fromiter((self.at[x] for own in parts.values() for x in own), np.int64, 2 * len(parts))
            self.add(list(parts), self.gather(place)[0], self.size[place].reshape(-1, 2).sum(1))
        self.add_each([c for c in missing if c not in self.at])

    def trim(self) -> None:
        if len(self.at) > self.limit:
            self.at = dict(itertools.islice(self.at.items(), self.core))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (no null) one after another, and where each text's begin, with the end of the last."""
        parted = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        coded = parted.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if missing := [c for c in chunks if c not in self.at]:
            self.learn(missing)
        place = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))[coded.indices.to_numpy()] if chunks else np.zeros(0, np.int64)
        ids, after = self.gather(place)
        ends = parted.value_lengths().to_numpy(zero_copy_only=False)
        self.trim()
        return ids, after[np.concatenate(([0], np.cumsum(ends)))]


#: Letters and then marks other than the apostrophe, which may go with letters.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)\Z")


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))


def _spans(sizes: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters in all; a longer text is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _segments(text: str, chars: int = 2_000_000) -> Iterator[str]:
    """A long text in parts that end before a space, so that no more than a part is parted at a time."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + chars)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


_codecs: dict[str, ChunkCodec] = {}


def codec_for(path: str) -> ChunkCodec:
    """One codec per Python worker. Called through the module, so that tasks share it and its cache."""
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


def _pieces(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = codec_for(path), np.array([end_id], np.uint32)
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            sizes, sums = [], []

            def cut(ids: np.ndarray) -> None:
                ids = np.concatenate((ids, end)).astype("<u4", copy=False)
                sizes.append(len(ids))
                sums.append([zlib.crc32(ids[a : a + length]) for a in range(0, len(ids), length)])

            for a, b in _spans(pc.binary_length(texts).to_pylist()):
                if b - a > 1:
                    ids, at = codec.encode(texts.slice(a, b - a))
                    for i in range(b - a):
                        cut(ids[at[i] : at[i + 1]])
                else:
                    cut(np.concatenate([np.zeros(0, np.uint32), *(codec.encode(pa.array([part]))[0] for part in _segments(texts[a].as_py()))]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "n", "sums"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and its end id, cut only if longer than length."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    coded = rows.mapInArrow(_pieces(tokenizer, length, end_id), f"doc_id {dict(rows.dtypes)['doc_id']}, n long, sums array<long>")
    return coded.select("doc_id", "n", F.posexplode("sums").alias("piece", "ids_crc32")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * length).alias("start"),
        F.least(F.lit(length), F.col("n") - F.col("piece") * length).cast("long").alias("length"), "ids_crc32",
    )


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indexes into sizes, by best fit decreasing."""
    bins: list[list[int]] = []
    left: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(left, (sizes[i], -1))
        if at == len(left):
            bins.append([i])
            rest = room - sizes[i]
            b = len(bins) - 1
        else:
            rest, b = left.pop(at)
            bins[b].append(i)
            rest -= sizes[i]
        if rest:
            insort(left, (rest, b))
    return bins


class _Options:
    """What a bin can give or take: one piece or two, by distinct size; a bin of `room` has few distinct sizes, however many pieces."""

    def __init__(self, own: list[int]):
        self.one, n = np.unique(np.array(own, np.int64), return_counts=True)
        i, j = np.triu_indices(len(self.one))
        there = (i < j) | (n[i] > 1)
        self.two, at = np.unique((self.one[i] + self.one[j])[there], return_index=True)
        self.half = self.one[i][there][at]  # the smaller piece of a pair
        self.few = np.append(0, self.one)  # what goes against one piece or two; a pair only goes against one
        sums = np.concatenate((self.one, self.two))
        order = np.argsort(sums, kind="stable")
        self.sums, self.halves = sums[order], np.concatenate((np.zeros(len(self.one), np.int64), self.half))[order]


def _most(gives: np.ndarray, takes: np.ndarray, room: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """For each give the take that gains most within the room, and the gain, which may be below zero."""
    at = np.searchsorted(takes, gives + room, "right") - 1
    return at, np.where(at < 0, -1, takes[at] - gives)


def _exchange(full: _Options, low: _Options, room: int) -> tuple[list[int], list[int], int] | None:
    """The sizes to take from `full` and from `low` so that `full` gains most within its room; None if nothing gains."""
    at, gain = _most(full.few, low.sums, room)
    k = int(gain.argmax())
    best = (int(gain[k]), [int(full.few[k])], [int(low.halves[at[k]]), int(low.sums[at[k]] - low.halves[at[k]])])
    if len(full.two):
        at, gain = _most(full.two, low.one, room)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (int(gain[k]), [int(full.half[k]), int(full.two[k] - full.half[k])], [int(low.one[at[k]])])
    gain, give, take = best
    return ([g for g in give if g], [t for t in take if t], gain) if gain > 0 else None


def improve(sizes: list[int], bins: list[list[int]], room: int, passes: int | None = None) -> list[list[int]]:
    """Local search between underfull bins: the emptiest bin gives, fuller ones gain, until no step gains or no bin can go.

    A step moves one or two documents, or exchanges one for one, two for one or one for two, and always
    towards the fuller bin, which raises the sum of squared fill; so the search ends. passes, if given, bounds it.
    """
    least = -(-sum(sizes) // room)
    bins = [list(b) for b in bins if b]
    fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
    options = [_Options([sizes[i] for i in b]) for b in bins]
    table: tuple | None = None  # the options of all bins and whose they are, until a step changes them

    def gaining(low: int) -> list[int]:
        """The bins that can gain from `low`, the fullest first."""
        nonlocal table
        if table is None:
            live = np.flatnonzero((fill > 0) & (fill < room))
            table = *(np.concatenate([getattr(options[b], kind) for b in live]) for kind in ("few", "two")), *(np.repeat(live, [len(getattr(options[b], kind)) for b in live]) for kind in ("few", "two"))
        few, two, few_of, two_of = table
        found = np.concatenate((few_of[_most(few, options[low].sums, room - fill[few_of])[1] > 0], two_of[_most(two, options[low].one, room - fill[two_of])[1] > 0]))
        found = np.unique(found[(fill[found] >= fill[low]) & (found != low)])
        return found[np.argsort(-fill[found], kind="stable")].tolist()

    def swap(b: int, out: list[int], into: list[int]) -> None:
        own = bins[b]
        for i in out:
            own.remove(i)
        own += into
        options[b] = _Options([sizes[i] for i in own])

    def pick(b: int, wanted: list[int]) -> list[int]:
        out: list[int] = []
        for size in wanted:
            out.append(next(i for i in bins[b] if sizes[i] == size and i not in out))
        return out

    moved = True
    while moved:
        moved = False
        for low in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[low] < room and np.count_nonzero(fill) > least and (passes is None or passes > 0):
                passes = None if passes is None else passes - 1
                before = fill[low]
                for b in gaining(low):
                    step = _exchange(options[b], options[low], int(room - fill[b])) if fill[b] >= fill[low] else None
                    if step:
                        give, take = pick(b, step[0]), pick(low, step[1])
                        swap(b, give, take)
                        swap(low, take, give)
                        fill[b] += step[2]
                        fill[low] -= step[2]
                        table = None
                        if not fill[low]:
                            break
                if fill[low] == before:
                    break
                moved = True
    return [b for b in bins if b]


def _pack_group(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        sizes = group["length"].tolist()
        bins = improve(sizes, best_fit(sizes, length), length)
        place, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for b, own in enumerate(bins):
            at = 0
            for i in own:
                place[i], offset[i] = b, at
                at += sizes[i]
        return group.assign(sequence_id=group["bucket"].astype(np.int64) * (1 << 24) + place, offset=offset).drop(columns="bucket")

    return run


def pack(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer is the path of a tokenizer file that each executor can read. Null or empty text has the end
    id alone. Repeated rows are packed as rows of their own. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    bounded_batches(docs.sparkSession)
    pieces = numbered(token_pieces(docs, tokenizer, length=length, end_id=end_id), "row", scratch, "pieces")
    buckets = max(1, -(-pieces.count() // group))
    # Repeated rows go to a bucket each, by their number.
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "doc_id", "piece"), F.lit(buckets)).cast("int")).drop("row")
    kinds = dict(dealt.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "piece", "start", "length", "ids_crc32")) + ", sequence_id long, offset long"
    return dealt.groupBy("bucket").applyInPandas(_pack_group(length), schema)
