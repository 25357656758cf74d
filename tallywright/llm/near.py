"""N-gram Jaccard self-join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

Two documents link when the Jaccard similarity of their sets of word shingles reaches num/den.

1. Documents of equal sets form a class; its smallest id stands for it from there on.
2. Candidates, at a similarity of PARTS or more. Size bands: a linked pair differs in at most D = min(|A|,|B|) * (den-num)/num shingles. Within a band of
   sizes, sets are cut by hash range into D + 1 + SPARE parts, so a linked pair has over SPARE equal
   parts (pigeonhole), and shares the key of one that isn't empty. A set with over SPARE empty parts has one key
   more that says so. No pair is lost, and rows grow with the text, not with its square.
   Below PARTS parts would be too short to tell texts apart that share passages. There, sets are ordered rarest
   shingle first and share one of their first n - ceil(n * num / den) + 1 (prefix filter, right for any order). How many
   documents have a shingle is counted for a share of all shingles, chosen by hash, which come first in the order; that
   share is over what a prefix takes. Shingles of one document can't be shared and give no key.
3. Classes that share keys form families (components over a class and its keys' smallest members).
4. A small family is one tile. A large one is first contracted: each class is compared to the members that most of its
   keys lead to, a few at most, in streams that hold one array at a time. Where all classes that meet at one member
   are connected by then, nothing more is needed. The others are cut by size band into blocks; tiles are the pairs of
   blocks of the same or adjoining bands that meet, except those within the family's largest contracted part.
5. In a tile, bits set in one bitmap and not in the other bound the overlap from above; pairs that pass
   are decided by intersecting the sorted arrays. Pairs already connected are skipped, so a tile emits
   fewer links than it has members.
6. Components over all links.

Arrays travel in rows of CHUNK shingles, so that no Arrow batch grows with the length of texts.
Shingles are 64-bit hashes of words' 64-bit hashes, and sets are taken as equal if their size and two 64-bit sums over
their shingles agree: stated limits, as two such values meet by chance once in 2^64 pairs.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch, bounded_batches, components

PARTS = 0.9
COUNTED = 1.65  # times (den - num) / den: the share of shingles that is counted
SPARE = 3
BAND = 1.5
BITS = 1024  # of a bitmap, at least
TILE_ROWS = 100  # members of a block
TILE_SHINGLES = 1_000_000  # shingles in a small family; half in a block
LEADS = 4  # members that a class of a large family is compared to before blocks are made
STREAM_ROWS = 500  # classes compared to one member in one stream
CHUNK = 1024  # shingles in a row

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """Word to 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = h
        return h


_hashes = _Hashes()


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles; fewer words than k are one shingle, none are no shingle."""
    words = text.lower().split()
    m = len(words)
    if not m:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, m)
    width = min(k, m)
    s = h[: m - width + 1] * _ODD[0]
    for j in range(1, width):
        s = s + h[j : m - width + 1 + j] * (_ODD[j % 8] + np.uint64(2 * j))
    return np.unique(_mix(s + np.uint64(width)))


class Bands:
    """Bands of set sizes, the parts that a set is cut into in each, and the keys of a set."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.top = [0]
        while self.apart(self.top[-1] + 1) == 0:  # sizes at which a link means equal sets
            self.top[-1] += 1
        while self.top[-1] < 1 << 40:
            self.top.append(max(self.top[-1] + 1, int(self.top[-1] * BAND)))

    def apart(self, n: int) -> int:
        """The most shingles that a set of n and a linked one, not smaller, don't share."""
        return n * (self.den - self.num) // self.num

    def keys(self, u: np.ndarray) -> np.ndarray:
        band = bisect_left(self.top, len(u))
        if not len(u):
            return np.empty(0, np.uint64)
        out = []
        for b in (band - 1, band):
            if b < 1 or (b < band and -(-self.num * len(u) // self.den) > self.top[b]):
                continue
            parts = self.apart(self.top[b]) + 1 + SPARE
            part = ((u >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            at = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
            salt = (np.uint64(b) << np.uint64(40)) + part[at] + np.uint64(1)
            out.append(_mix(np.add.reduceat(u, at) + salt * _ODD[1]))
            if parts - len(at) > SPARE:
                out.append(_mix(np.array([(b << 40) + (1 << 39)], np.uint64) * _ODD[2]))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


class Prefixes:
    """Where sets are compared by their rarest shingles: what is counted of a set, and what its prefix needs besides."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.limit = np.uint64(min(1024, math.ceil(1024 * COUNTED * (den - num) / den)))

    def prefix(self, n: int) -> int:
        return n - -(-n * self.num // self.den) + 1

    def split(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counted = (u >> np.uint64(20)) & np.uint64(1023) < self.limit
        own = u[counted]
        return own, u[~counted][: max(0, self.prefix(len(u)) - len(own))] if len(u) else u


def _signatures(k: int, num: int, den: int):
    by_parts = num >= PARTS * den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, prefixes = Bands(num, den), Prefixes(num, den)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                sizes, ones, twos, keys, ends, rest, rest_ends = [], [], [], [], [0], [], [0]
                for text in some["text"]:
                    u = shingle_set(text.as_py() or b"", k)
                    sizes.append(len(u))
                    ones.append(int(u.sum().view(np.int64)) if len(u) else 0)
                    twos.append(int(_mix(u + _ODD[3]).sum().view(np.int64)) if len(u) else 0)
                    own, more = (bands.keys(u), u[:0]) if by_parts else prefixes.split(u)
                    keys.append(own)
                    rest.append(more)
                    ends.append(ends[-1] + len(own))
                    rest_ends.append(rest_ends[-1] + len(more))
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(np.concatenate(x).view(np.int64))) for e, x in ((ends, keys), (rest_ends, rest))]
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), *lists], ["doc_id", "n", "d1", "d2", "keys", "more"])

    return run


def _arrays(k: int):
    """The sets in rows of CHUNK shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, seq, parts = [], [], []
            for c, text in zip(batch["cls"].to_pylist(), batch["text"]):
                u = shingle_set(text.as_py() or b"", k)
                for at in range(0, len(u), CHUNK):
                    cls.append(c)
                    seq.append(at // CHUNK)
                    parts.append(u[at : at + CHUNK].tobytes())
                if len(parts) >= 1000:
                    yield _chunks(cls, seq, parts)
                    cls, seq, parts = [], [], []
            yield _chunks(cls, seq, parts)

    return run


def _chunks(cls: list, seq: list, parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(seq, pa.int32()), pa.array(parts, pa.binary())], ["cls", "seq", "shingles"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(tile, side, cls, label, set) from chunks ordered by tile, side, cls and seq."""
    at, parts = None, []
    for batch in batches:
        for row, shingles in zip(zip(*(batch[c].to_pylist() for c in ("tile", "side", "cls", "label"))), batch["shingles"]):
            if row != at:
                if at:
                    yield *at, np.frombuffer(b"".join(parts), np.uint64)
                at, parts = row, []
            parts.append(shingles.as_py())
    if at:
        yield *at, np.frombuffer(b"".join(parts), np.uint64)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted arrays of distinct values reach the similarity."""
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(both) - shared)


def bitmap(u: np.ndarray, width: int = BITS) -> np.ndarray:
    bits = np.zeros(width, np.uint8)
    bits[u & np.uint64(width - 1)] = 1
    return np.packbits(bits).view(np.uint64)


def tile_links(ids: list, labels: list, sets: list[np.ndarray], num: int, den: int, sides: list[int] | None = None) -> list[tuple]:
    """Links that connect the members of a tile as all their links would. labels: what is connected already.

    With two sides, only pairs across them are compared.
    """
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = np.array([len(u) for u in sets])
    width = max(BITS, 1 << int(sizes.max()).bit_length())
    maps = np.stack([bitmap(u, width) for u in sets])
    side = np.zeros(len(ids), np.int8) if sides is None else np.array(sides, np.int8)
    across = side.min() < side.max()
    tops, out = [root(x) for x in labels], []
    for i in range(len(ids) - 1):
        n = sizes[i]
        some = np.arange(i + 1, len(ids))
        some = some[(sizes[i + 1 :] * num <= n * den) & (sizes[i + 1 :] * den >= n * num) & ((side[i + 1 :] != side[i]) | (not across))]
        if not len(some):
            continue
        extra = np.bitwise_count(maps[i] & ~maps[some]).sum(1)
        lack = np.bitwise_count(~maps[i] & maps[some]).sum(1)
        bound = np.minimum(n - extra.astype(np.int64), sizes[some] - lack.astype(np.int64))
        for j in some[(num + den) * bound >= num * (n + sizes[some])].tolist():
            a, b = root(tops[i]), root(tops[j])
            if a != b and linked(sets[i], sets[j], num, den):
                parent[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
    return out


def _tiles(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        tile = None

        def done() -> list[tuple]:
            members = sorted(held, key=lambda m: (len(m[3]), m[1]))
            held.clear()
            return tile_links([m[1] for m in members], [m[2] for m in members], [m[3] for m in members], num, den, [m[0] for m in members]) if len(members) > 1 else []

        for t, side, cls, label, u in _sets(batches):
            if t != tile:
                if found := done():
                    yield _links(found)
                tile = t
            held.append((side, cls, label, u))
        yield _links(done())

    return run


def _links(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])


def _streams(num: int, den: int):
    """Links of the one member of side 0, which comes first, to those of side 1; one array of each is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, lead, found = None, None, []
        for t, side, cls, _, u in _sets(batches):
            if t != tile:
                tile, lead = t, None
            if side == 0:
                lead = (cls, u)
            elif lead and linked(lead[1], u, num, den):
                found.append((cls, lead[0]))
            if len(found) >= 10_000:
                yield _links(found)
                found = []
        yield _links(found)

    return run


def near_groups(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs (doc_id long, text): doc_id, n_shingles, component_id.

    Texts are lower-cased in A-Z. component_id is the smallest doc_id reached over links, the row's own
    included. A text without words has no shingles and links with nothing. A row without an id takes no
    part in links and has no component. Repeated rows are one class. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    signed = scratch.save(rows.mapInArrow(_signatures(k, num, den), "doc_id long, n long, d1 long, d2 long, keys array<long>, more array<long>"), "signed")
    alike, many = ["n", "d1", "d2"], signed.count()
    usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = scratch.save(signed.filter(usable).groupBy(*alike).agg(F.min("doc_id").alias("cls")), "classes", many)
    stands = lambda c: F.when(F.col("doc_id") == F.col("cls"), F.col(c)).alias(c)
    classed = signed.join(classes, alike, "left").select("doc_id", "n", F.when(usable, F.col("cls")).alias("cls"), stands("keys"), stands("more"))
    classed = scratch.save(classed, "classed", many)
    scratch.drop("signed")

    keyed = classed.filter("keys IS NOT NULL").select("cls", F.explode("keys").alias("key"))
    if num < PARTS * den:
        keyed = _rarest(scratch, classed, keyed, num, den, many)
    shared = scratch.save(keyed.groupBy("key").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).filter("first < last").select("key", "first"), "shared", many)
    # One row per class and first member of its keys; each class ties them all to the smallest.
    met = scratch.save(keyed.join(shared, "key").groupBy("cls", "first").agg(F.count(F.lit(1)).alias("keys")), "met", many)
    firsts = met.groupBy("cls").agg(F.collect_set("first").alias("f")).withColumn("f", F.array_union("f", F.array("cls")))
    tied = firsts.withColumn("b", F.array_min("f")).select(F.explode("f").alias("a"), "b").filter("a <> b")
    family = scratch.save(components(tied, scratch, "families").select(F.col("node").alias("cls"), F.col("label").alias("family")), "family")
    many = family.count()
    texts = rows.withColumnRenamed("doc_id", "cls").join(family.select("cls"), "cls", "left_semi")
    # Of repeated rows, equal in id and set, one is enough.
    arrays = scratch.save(texts.mapInArrow(_arrays(k), "cls long, seq int, shingles binary").dropDuplicates(["cls", "seq"]), "arrays")

    members = scratch.save(family.join(classes.select("cls", "n"), "cls"), "members", many)
    sums = members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    sums = scratch.save(sums.withColumn("large", (F.col("rows") > TILE_ROWS) | (F.col("shingles") > TILE_SHINGLES)), "sums", many)
    small = family.join(sums.filter("NOT large").select("family"), "family").select("cls", F.col("cls").alias("label"), F.xxhash64("family").alias("tile"), F.lit(0).alias("side"))
    tiles, links = small, None
    if sums.filter("large").limit(1).count():
        links, large_tiles = _contract(scratch, met, members, sums, arrays, num, den, many)
        tiles = small.unionByName(large_tiles)
    found = scratch.save(_arranged(tiles, arrays).mapInArrow(_tiles(num, den), "a long, b long"), "found")
    scratch.drop("arrays", "shared", "met", "members", "family", "classes")
    labels = components(found if links is None else found.union(links), scratch, "links").withColumnRenamed("node", "cls")
    return classed.join(labels, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "cls", "doc_id").alias("component_id"))


def _arranged(tiles: DataFrame, arrays: DataFrame) -> DataFrame:
    """The chunks of the members of tiles (cls, label, tile, side), each tile in one task and in order."""
    work = tiles.join(arrays, "cls").select("tile", "side", "cls", "label", "seq", "shingles")
    return work.repartition("tile").sortWithinPartitions("tile", "side", "cls", "seq").drop("seq")


def _rarest(scratch: Scratch, classed: DataFrame, counted: DataFrame, num: int, den: int, many: int) -> DataFrame:
    """(cls, key): the shingles of each prefix that others can have."""
    repeated = scratch.save(counted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "repeated", many)
    known = counted.join(repeated, "key").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("known"))
    rows = classed.filter("keys IS NOT NULL").select("cls", "more", F.size("keys").alias("counted"), (F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1).alias("prefix"))
    rows = rows.join(known, "cls", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<df: bigint, key: bigint>>")))
    # The counted shingles that no one else has come first in the order.
    needs = F.least(F.col("prefix") - (F.col("counted") - F.size("known")), F.size("known")).cast("int")
    first = F.when(needs > 0, F.slice("known", F.lit(1), needs)["key"]).otherwise(F.array().cast("array<bigint>"))
    return scratch.save(rows.select("cls", F.explode(F.concat(first, "more")).alias("key")), "rarest", many)


def _contract(scratch: Scratch, met: DataFrame, members: DataFrame, sums: DataFrame, arrays: DataFrame, num: int, den: int, many: int) -> tuple[DataFrame, DataFrame]:
    """Links that contract the large families, and the tiles of what they leave apart.

    Keys count by their smallest member: classes that share a key share the smallest member of it, and rows of class and
    smallest member are far fewer than keys.
    """
    large = scratch.save(members.join(sums.filter("large").select("family"), "family"), "large", many)
    order = Window.partitionBy("cls").orderBy(F.desc("keys"), "first")  # a class has as many rows as keys, at most
    leads = met.filter("cls <> first").join(large.select("cls"), "cls").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LEADS).select("cls", "first")
    leads = scratch.save(leads, "large-leads", many)
    streams = leads.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / STREAM_ROWS).cast("int").alias("streams"))
    streams = scratch.save(streams, "large-streams", many)
    held = streams.select(F.col("first").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("s"), F.col("first")).withColumn("side", F.lit(0))
    compared = leads.join(streams, "first").select("cls", F.pmod(F.xxhash64("cls"), F.col("streams")).cast("int").alias("s"), "first").withColumn("side", F.lit(1))
    tiles = held.unionByName(compared).select("cls", F.lit(0).cast("long").alias("label"), F.xxhash64("first", "s").alias("tile"), "side")
    links = scratch.save(_arranged(tiles, arrays).mapInArrow(_streams(num, den), "a long, b long"), "large-links")
    labels = components(links, scratch, "large").withColumnRenamed("node", "cls")
    large = scratch.save(large.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "large-labels", many)

    # Smallest members whose classes aren't all connected, and those classes.
    lead = scratch.save(met.select("cls", "first").join(large.select("cls", "label"), "cls"), "large-met", many)
    apart = lead.groupBy("first").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("first")
    lead = scratch.save(lead.join(apart, "first").select("cls", "first"), "large-open", many)
    near = lead.groupBy("cls").agg(F.min("first").alias("near"))
    most = large.groupBy("family", "label").agg(F.count(F.lit(1)).alias("rows")).groupBy("family").agg(F.max(F.struct("rows", "label")).alias("most")).select("family", F.col("most.label").alias("main"))
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(den / num))).cast("int")
    dealt = large.join(near, "cls").join(most, "family").select("cls", "n", "label", band.alias("band"), (F.col("label") == F.col("main")).alias("main"), "family", "near")
    # Classes that meet should share a block: dealt by where they meet first, and by class where too many do.
    counts = dealt.groupBy("family", "band", "main").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("n") * 2 / TILE_SHINGLES)).alias("parts"))
    dealt = dealt.join(counts, ["family", "band", "main"]).withColumn("part", F.pmod(F.xxhash64("near"), F.col("parts"))).drop("parts", "near")
    dealt = scratch.save(dealt, "large-dealt", many)
    salts = dealt.groupBy("family", "band", "main", "part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("n") * 2 / TILE_SHINGLES)).alias("salts"))
    dealt = dealt.join(salts, ["family", "band", "main", "part"]).withColumn("block", F.xxhash64("family", "band", "main", "part", F.pmod(F.xxhash64("cls"), F.col("salts"))))
    dealt = scratch.save(dealt.select("cls", "label", "band", "main", "block"), "large-blocks", many)
    places = scratch.save(lead.join(dealt.select("cls", "band", "main", "block"), "cls").select("first", "band", "main", "block").distinct(), "large-places", many)
    other = places.select("first", *[F.col(c).alias(f"{c}2") for c in ("band", "main", "block")])
    # Pairs of blocks, each once; two blocks of the largest part are connected already.
    pairs = places.join(other, "first").filter("block <= block2 AND abs(band - band2) <= 1 AND NOT (main AND main2)").select("block", "block2").distinct()
    pairs = scratch.save(pairs, "large-pairs", many)
    own = dealt.select("cls", "label", "block")
    tile = F.xxhash64("block", "block2").alias("tile")
    left = own.join(pairs, "block").select("cls", "label", tile, F.lit(0).alias("side"))
    right = own.withColumnRenamed("block", "block2").join(pairs.filter("block < block2"), "block2").select("cls", "label", tile, F.lit(1).alias("side"))
    return links, left.unionByName(right)


def drop_near(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay, one of each component: its smallest doc_id. Rows without an id stay."""
    groups = near_groups(docs, k=k, num=num, den=den)
    gone = groups.filter("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
