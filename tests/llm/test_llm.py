"""Operators of the training-data part against brute force, and on odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywright.llm import brown, chat, exact, langid, mixing, near, packing, quality, sharding, toxicity
from tallywright.llm.common import components, part_of, Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, n int, label string, `_w` string"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "se") for b in ("n", "st", "r", "l") for c in ("a", "o", "en", "it", "us")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies."""
    base = prose(1, 120)
    changed = base.replace(base.split()[60], "zzz", 1)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, changed, "en", "b"), (4, None, None, None), (5, "", "de", "b"), (6, " \n\t ", None, "b"), (None, base, "en", None), (None, None, None, None)]
    rows += [(7, "one", "en", "c"), (8, "ONE", "en", "c"), (9, "one two", "en", "c"), (10, prose(2, 30_000), "fr", "a"), (11, "é ß 漢字   x\x0by", "fr", "a")]
    rows += [(100 + i, prose(100 + i, 60 + i), "en", f"s{i % 3}") for i in range(60)]
    return [(d, t, g, s, len(t or ""), d, 1, "x", "w") for d, t, g, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(row):
    return row[1] or ""


def test_exact_groups(docs, none):
    by = defaultdict(list)
    for r in odd_rows():
        by[text_of(r)].append(r[0])
    found = exact.exact_groups(docs, first=4, growth=3).collect()
    assert len(found) == len(odd_rows())
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    kept = Counter()
    for r in found:
        own = by[sha[r.text_sha256]]
        assert r.group_size == len(own)
        assert r.keep_id == max((d for d in own if d is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact.exact_groups(none).count() == 0
    assert sorted(r.text for r in exact.drop_copies(docs).select(F.coalesce("text", F.lit("")).alias("text")).collect()) == sorted(by)


def test_near_groups(docs, none):
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] is not None]
    for k, num, den in ((3, 90, 100), (5, 80, 100), (1, 50, 100)):
        want = Counter(brute.components(list(dict.fromkeys(rows)), k, num, den))
        found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.near_groups(docs, k=k, num=num, den=den).collect() if r.doc_id is not None)
        assert set(found) == set(want)
        assert sum(found.values()) == len(rows)
    assert near.near_groups(none).count() == 0


def test_near_large_family(spark, monkeypatch):
    """A family over a tile's rows goes through contraction and blocks, and loses no link."""
    r, base = random.Random(5), prose(9, 90).split()
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(r.randrange(0, 7)):
            own[r.randrange(len(own))] = f"w{r.randrange(400)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near, "TILE_ROWS", 40)
    found = sorted(tuple(x) for x in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=90, den=100).collect())
    assert found == brute.components(rows, 3, 90, 100)


def test_near_copies_of_a_long_text(spark):
    """2,000 near copies of one long text, each a link from the next ones: one component, besides a plain text and an empty one."""
    r, base = random.Random(9), prose(77, 1500).split()
    rows = [(0, "alone " + prose(78, 40)), (1, "")]
    for i in range(2000):
        own = list(base)
        for _ in range(r.randrange(0, 4)):
            own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
        rows.append((10 + i, " ".join(own)))
    found = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=5, num=80, den=100).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == {d: min(d, 10) for d, _ in rows}


def test_chunks_make_up_sets():
    sets = [np.sort(np.random.default_rng(i).integers(0, 1 << 62, 700 * i).astype(np.uint64)) for i in range(4)]
    rows = [(t, 0, c, c, sets[c][a : a + 1000].tobytes()) for t, c in ((5, 1), (5, 2), (6, 2), (6, 3)) for a in range(0, len(sets[c]), 1000)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("tile", "side", "cls", "label", "shingles"), row)) for row in rows[a : a + 2]]) for a in range(0, len(rows), 2)]
    assert [(t, c, u.tolist()) for t, _, c, _, u in near._sets(batches)] == [(t, c, sets[c].tolist()) for t, c in ((5, 1), (5, 2), (6, 2), (6, 3))]


def test_tile_with_sides_compares_across_only():
    sets = [np.arange(100, dtype=np.uint64) + np.uint64(i) for i in (0, 1, 2, 3)]
    assert near.tile_links([0, 1, 2, 3], [0, 1, 2, 3], sets, 90, 100, [0, 0, 1, 1]) == [(0, 2), (0, 3), (1, 2)]


def test_keys_meet_for_every_linked_pair():
    r = random.Random(3)
    bands = near.Bands(80, 100)
    for _ in range(400):
        n = r.randrange(4, 300)
        a = {r.getrandbits(64) for _ in range(n)}
        drop = r.randrange(0, n // 5 + 1)
        b = set(list(a)[drop:]) | {r.getrandbits(64) for _ in range(r.randrange(0, n // 8 + 1))}
        u, v = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert near.linked(u, v, 80, 100) == (100 * len(a & b) >= 80 * len(a | b))
        if a != b and near.linked(u, v, 80, 100):
            assert set(bands.keys(u).tolist()) & set(bands.keys(v).tolist())


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    found = {r.node: r.label for r in components(edges, Scratch(spark, "t"), "c").collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_statistics_and_verdict(docs, none):
    found = quality.judge(docs).collect()
    assert len(found) == len(odd_rows())
    want = Counter((r[0], *brute.statistics(r[1])) for r in odd_rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0
    assert quality.drop_poor(docs).columns == docs.columns


def test_quality_rejects_junk_and_keeps_prose(spark):
    rows = [(i, prose(i, 100 + i % 50), "en", "a") for i in range(200)] + [(1000 + i, " | ".join(prose(i, 80).upper().split()) + " !!", "en", "a") for i in range(20)]
    found = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i] for i in range(200)) and not any(found[1000 + i] for i in range(20))


def plain_model(x):
    """Centre and covariance of the three quarters nearest to the centre, by steps from both starts until the determinant stays; with numpy."""
    least = np.array(list(quality.FLOOR.values()))
    middle = np.sort(x, 0)[(len(x) - 1) // 2]
    wide = np.maximum(1.4826 * np.sort(np.abs(x - middle), 0)[(len(x) - 1) // 2], least)
    t = np.tanh((x - middle) / wide)
    ends = []
    for cov in (np.diag(wide**2), np.outer(wide, wide) * (t.T @ t / len(x) + 0.1 * np.eye(x.shape[1]))):
        centre, was = middle, None
        while was is None or np.linalg.det(cov) < was * (1 - quality.FALL):
            was = np.linalg.det(cov) if centre is not middle else np.inf
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            nearest = x[d2 <= np.quantile(d2, quality.SHARE, method="inverted_cdf")]
            centre = nearest.mean(0)
            cov = (nearest - centre).T @ (nearest - centre) / len(nearest) * quality.CONSISTENT + np.diag(least**2)
            ends.append((np.linalg.det(cov), centre, cov))
    return min(ends, key=lambda e: e[0])[1:]


def test_distances_are_those_of_a_plain_estimate(spark):
    """Verdicts and distances over two pools, one with junk, against numpy; a small source falls to the model of all rows."""
    rows = [(i, prose(i, 60 + i % 90) + " Ab, C!" * (i % 4), "en", "ab"[i % 2]) for i in range(400)] + [(1000 + i, "|| ".join(prose(i, 80).split()), "en", "a") for i in range(15)] + [(2000, prose(5, 90), "xx", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in quality.judge(table).collect()}
    assert not any(r.base_failed for r in found.values()) and not any(found[1000 + i].kept for i in range(15))
    vectors = {r.doc_id: np.array(r[1:]) for r in quality.text_statistics(table).withColumns(quality._vector()).select("doc_id", *quality.FLOOR).collect()}
    for pool in ("a", "b", None):
        own = [d for d, _, _, s in rows if s == pool or pool is None]
        centre, cov = plain_model(np.array([vectors[d] for d in own]))
        for d in own if pool else [2000]:
            off = vectors[d] - centre
            want = float(off @ np.linalg.inv(cov) @ off)
            assert found[d].distance == pytest.approx(want, rel=0.02, abs=0.02)
            assert found[d].kept == (found[d].distance <= quality.CUTOFF)


def test_repeats(spark):
    texts = ["a b c a b c", "a a a a", "a b c d", "x y z x y", "a b c x a b c y a b c", "a\na\n\nb\n a\na"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.text_statistics(rows).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.statistics(r.text), r.text


def targets(sizes):
    """Water filling, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(sum(weight[s] for s in rest), 1e-9)
        over = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped.update({s: 3 * sizes[s] for s in over})


def test_mixing(docs, none):
    sizes = defaultdict(int)
    for r in odd_rows():
        sizes[r[3]] += len(brute.words(r[1]))
    want = targets(sizes)
    plan = mixing.plan_mix(docs, keep=["doc_id", "source"]).collect()
    assert len(plan) == len(odd_rows())
    took = defaultdict(int)
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        took[r.source] += r.taken
    largest = {s: max(r.size for r in plan if r.source == s) for s in sizes}
    assert all(abs(took[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.plan_mix(docs.repartition(7, "n_chars"), keep=["doc_id", "source"]).collect()
    told = lambda rows: Counter((r.doc_id, r.source, r.size, r.copies) for r in rows)
    assert told(plan) == told(again)  # however the input is laid out
    assert mixing.plan_mix(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)


def test_mixing_reduction_tree(spark):
    rows = spark.createDataFrame([(i, prose(i, 20 + i % 40), "ab"[i % 7 == 0]) for i in range(1500)], "doc_id long, text string, source string")
    took, goal = defaultdict(int), {}
    for r in mixing.plan_mix(rows, keep=["source"]).collect():
        took[r.source] += r.taken
        goal[r.source] = r.target
    assert all(abs(took[s] - goal[s]) <= 20 for s in goal)


def test_sharding(spark, docs, none):
    found = sharding.shard_documents(docs, 4, slots=16)
    rows = found.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r[0], len(text_of(r).encode()) + 16, zlib.crc32(text_of(r).encode())) for r in odd_rows())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(none, 4).count() == 0


def test_slot_maps():
    r = random.Random(1)
    weight = [r.randrange(1, 100) for _ in range(500)]
    owner = sharding.rebalance(sharding.first_map(500, 9), weight, 9)
    load = [sum(w for w, o in zip(weight, owner) if o == s) for s in range(9)]
    assert max(load) - min(load) <= 2
    grown = sharding.grow(owner, weight, 9)
    assert all(a == b or b == 9 for a, b in zip(owner, grown)) and 9 in grown


def test_map_versions(spark, tmp_path):
    sharding.save_map(spark, str(tmp_path / "m"), 1, [0, 1])
    for owner in ([0, 0], [1, 1]):  # a version saved again is replaced
        sharding.save_map(spark, str(tmp_path / "m"), 2, owner)
    assert [sorted(map(tuple, sharding.load_map(spark, str(tmp_path / "m"), v).collect())) for v in (1, 2)] == [[(0, 0), (1, 1)], [(0, 1), (1, 1)]]


TURNS = "conv_id long, turn long, role string, text string, id string, f string"


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\[", "[\\INST]", "[INS", "T]", "<s", "><s></s>", "[/SYS][SEP][TURN]", "", None, "a\nb", "é 漢"]
    rows = [(c, i, ["user", "assistant", "system", "tool[SEP]", None][(i + c) % 5], hard[(i * 7 + c) % len(hard)], "x", "y") for c in range(12) for i in range(9)]
    rows += [(50, 1, "user", "b", "", ""), (50, 1, "user", "a", "", ""), (50, None, "user", "c", "", ""), (None, 0, "assistant", "n", "", ""), (50, 1, "user", "a", "", "")]
    want = defaultdict(list)
    for c, t, role, text, _, _ in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    rows += [(60, i, "assistant", prose(i, 20_000) + "</s>\\<s>𝒳", "", "") for i in range(2)]
    want[60] = [(True, r[1], r[2], r[3]) for r in rows[-2:]]
    found = chat.format_chats(spark.createDataFrame(rows, TURNS)).withColumn("said", chat.masked(F.col("formatted"), F.col("loss_mask"))).collect()
    assert len(found) == len(want)
    for r in found:
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in sorted(want[r.conv_id])]
        assert len(r.loss_mask) == len(r.formatted)
        assert r.said == [t.text for t in r.turns if t.role == "assistant" and t.text]  # turn by turn
    plain = [r for r in found if r.conv_id is None][0]
    assert (plain.formatted, plain.loss_mask, plain.escaped) == ("<s>n</s>", "00010000", False)
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return public.path("word_bpe_49k.json"), Tokenizer.from_file(public.path("word_bpe_49k.json"))


def test_packing(docs, none):
    path, plain = tokenizer()
    found = packing.pack(docs.filter("doc_id IS NOT NULL"), path, length=64, group=50).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    want = defaultdict(list)
    for r in odd_rows():
        if r[0] is not None:
            ids = plain.encode(text_of(r), add_special_tokens=False).ids + [1]
            want[r[0]] += [(k, 64 * k, len(ids[64 * k : 64 * k + 64]), zlib.crc32(np.array(ids[64 * k : 64 * k + 64], "<u4").tobytes())) for k in range(-(-len(ids) // 64))]
    assert {d: sorted(v) for d, v in pieces.items()} == {d: sorted(v) for d, v in want.items()}
    assert packing.pack(none, path).count() == 0
    assert packing.pack(docs.filter("doc_id IS NULL"), path).count() == 2


def test_codec_is_the_tokenizer():
    path, plain = tokenizer()
    codec = packing.ChunkCodec(path, limit=40, core=20)
    r = random.Random(2)
    marks = ["", ".", ",", "!!", "'s", "…", "́", " ", " ", "<|endoftext|>", "12", "ß", "İ", "Σ", "\t", "\r\n", "漢字", "don't"]
    for _ in range(300):
        text = "".join(r.choice(WORDS) + r.choice(marks) + r.choice([" ", "\n", "", "  "]) for _ in range(r.randrange(12)))
        assert codec.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids, text
    texts = [prose(i, i * 7) + r.choice(marks) for i in range(30)]
    ids, at = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_local_search_empties_bins():
    sizes = [60, 40, 55, 45, 70, 30, 35, 65] + [50] * 4
    start = [[i] for i in range(len(sizes))]
    done = packing.improve(sizes, start, 100, passes=1000)
    assert sorted(i for b in done for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in done) and len(done) == 6
    parts = list(packing._segments("ab cd " * 600_000))
    assert len(parts) > 1 and parts[1].startswith(" ") and "".join(parts) == "ab cd " * 600_000
    assert list(packing._spans([3, 9, 1, 1, 8], 5)) == [(0, 1), (1, 2), (2, 4), (4, 5)]


def test_local_search_goes_on_until_no_step_gains():
    """With the default settings, where best fit is far from the bound: no move or exchange that gains is left."""
    r = random.Random(8)
    sizes, room = [r.randrange(1000, 2001) for _ in range(500)], 4096
    start = packing.best_fit(sizes, room)
    done = packing.improve(sizes, [list(b) for b in start], room)
    assert sorted(i for b in done for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= room for b in done)
    assert len(done) < len(start)
    some = lambda b, n: [sum(sizes[i] for i in c) for c in itertools.combinations(b, n)]
    for full, low in itertools.permutations(done, 2):
        left = room - sum(sizes[i] for i in full)
        if sum(sizes[i] for i in full) >= sum(sizes[i] for i in low):
            for give, take in ((0, 1), (0, 2), (1, 1), (1, 2), (2, 1)):
                assert not any(0 < t - g <= left for g in some(full, give) for t in some(low, take))
    assert len(packing.improve([1] * 98, [list(range(60)), list(range(60, 98))], 100)) == 1  # bins of many pieces, too


def test_language_model(docs, none):
    rows = odd_rows()
    held = part_of(F.col("doc_id"), 10) == 0
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter()
    for r in rows:
        if not out(r[0]):
            c.update(brute.words(brute.lower_az(r[1])))
            c["\n"] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        w = [*brute.words(brute.lower_az(r[1])), "\n"]
        want[r[0], out(r[0]), len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 5)] += 1
    for head in (200_000, 5):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(brown, "HEAD", head)
            found = brown.score_documents(docs, held).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == want
        assert all(r.score < 0 for r in found)
    assert brown.score_documents(none, held).count() == 0


def test_exchange_finds_classes():
    r = np.random.default_rng(0)
    pairs = np.zeros((21, 21))
    for _ in range(4000):  # words 0-9 follow words 10-19 and the reverse; 20 is a class of its own
        a = r.integers(10)
        pairs[a, 10 + r.integers(10)] += 1
        pairs[10 + r.integers(10), a] += 1
    cls = brown.exchange(pairs, 20, classes=2)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and cls[0] != cls[10]


def test_rare_words_have_learnt_classes(spark):
    """Words that end alike and differ in their neighbours: their classes come from the neighbours, in the core, in the head and beyond it."""
    r = random.Random(4)
    pick = lambda side: f"{side}{int(60 * r.random() ** 2)}zz"
    rows = [(i, " ".join(f"{s} {pick(s[0])}" for s in r.choices(("after", "before"), k=40)), False) for i in range(200)]
    rare = [f"{{}}{k}zz" for k in range(30, 60)]
    rows += [(1000 + j, " ".join(f"{left} {w.format(side)}" for w in rare), True) for j, (left, side) in enumerate((("after", "a"), ("after", "b"), ("before", "b"), ("before", "a")))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    for head in (200_000, 30):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(brown, "HEAD", head)
            m.setattr(brown, "CORE", 20)
            found = {x.doc_id: x.score - x.base_score for x in brown.score_documents(frame, F.col("held")).filter("held_out").collect()}
        assert min(found[1000], found[1002]) > max(found[1001], found[1003]) + 20, found


def test_placing_takes_the_greatest_gain():
    """place() against the likelihood counted anew with the word in each class."""
    r = np.random.default_rng(1)
    pairs = r.integers(0, 40, (brown.NEAR, brown.NEAR)).astype(float)
    near, n = np.array([3, 7, brown.NEAR - 1, brown.NEAR + 3, brown.NEAR + 9]), np.array([5, 2, 1, 4, 4])

    def likelihood(k):
        after, size = pairs.copy(), pairs.sum(0)
        for f, x in zip(near, n):
            if f < brown.NEAR:
                after[f, k] += x
            else:
                after[k, f - brown.NEAR] += x
        size[k] += n[near < brown.NEAR].sum()
        return brown._xlogx(after).sum() - 2 * brown._xlogx(size).sum()

    cls, count = brown.place(np.zeros(5, int), near, n, 1, pairs)
    assert cls[0] == max(range(brown.CLASSES), key=likelihood) and count[0] == 8


def test_model_is_a_distribution():
    head = [b"a", b"b", b"cc", b"dd"]
    total, classes = 2 + brown.SIGNATURES + 1, np.array([0, 1, *range(2, 2 + brown.SIGNATURES + 1)])
    counts = np.array([4.0, 3.0, 2.0, 1.0])
    room = np.ones(total)
    room[:2] = 4, 3
    kinds = np.zeros(brown.SIGNATURES)
    tokens = np.zeros(brown.SIGNATURES)
    for w, c in zip(head[2:], counts[2:]):
        kinds[brown.signature(w)] += 1
        tokens[brown.signature(w)] += c
    room[2:-1] = tokens + brown.ADD * (kinds + 1)
    room[-1] = 5
    transition = np.full((total, total), 1 / total)
    model = brown.Model("t", head, counts, 15, 5, 2, classes, transition, room)
    mass = sum(10 ** (brown.score_text(w, model, 5)[3] - brown.score_text(b"", model, 5)[3]) for w in head)
    end = 10 ** brown.score_text(b"", model, 5)[3]
    unseen = brown.MIX * (1 / total) * (brown.ADD / room[2:-1]).sum() + (1 - brown.MIX) * brown.ADD / model.spread
    assert mass + end + unseen == pytest.approx(1, abs=1e-9)


def test_languages(spark, docs, none):
    sound = {"aa": "kalo miru tasen", "bb": "xyrth qwelk vrons", "cc": "øåæ ñandú çelik"}
    rows = [(i, " ".join(random.Random(i).choice(sound[g].split()) + random.Random(i * j).choice("aeiou") for j in range(30)), g) for i, g in enumerate(list(sound) * 60)]
    rows += [(900, None, "aa"), (901, "123 !?", "bb"), (902, "", None), (None, "kalo", "aa")]
    held = part_of(F.col("doc_id"), 5) == 0
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held).collect()
    by = {r.doc_id: r for r in found}
    assert all(by[d].lang_pred == g for d, t, g in rows[:180]) and all(by[d].lang_pred == "und" for d in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in found) and len(found) == len(rows)
    assert langid.identify(none, held).count() == 0
    assert len(langid.identify(docs, held).collect()) == len(odd_rows())


def test_kernel_and_ridge_are_those_of_plain_sets(spark, monkeypatch):
    """With every training row a landmark, the map is exact: kernel ridge regression over plain sets of n-grams."""
    draw = random.Random(5)
    rows = [(i, " ".join("".join(draw.choice(("abcdeh", "defgh")[i % 2]) for _ in range(5)) for _ in range(6)), "xy"[i % 2]) for i in range(70)]
    rows.append((70, "Abc9 d-\n " * 3 + "dead " * 40_000, "x"))
    texts = [f" {re.sub(r'[^a-z]+', ' ', t.lower())} " for _, t, _ in rows]
    sets = [{t[a : a + n] for n in range(1, 5) for a in range(len(t) - n + 1)} for t in texts]
    train = [i for i, (d, _, _) in enumerate(rows) if zlib.crc32(str(d).encode()) % 5]
    k = np.array([[len(a & sets[j]) / (len(a) * len(sets[j])) ** 0.5 for j in train] for a in sets])
    each = {g: sum(rows[i][2] == g for i in train) for g in "xy"}
    goal = np.array([[1.0 if rows[i][2] == g else -1.0 for g in "xy"] for i in train])
    alpha = np.linalg.solve(k[train] + langid.RIDGE / 2 * np.diag([each[rows[i][2]] for i in train]), goal)
    want = k @ alpha
    monkeypatch.setattr(langid, "SPAN", 1000)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(table, part_of(F.col("doc_id"), 5) == 0).collect()}
    for (d, _, _), f in zip(rows, want):
        assert found[d].lang_pred == "xy"[f.argmax()] and found[d].score == pytest.approx(min(1, max(0, (f.max() + 1) / 2)), abs=1e-3)


def test_long_texts_keep_their_language(spark):
    """Texts of more distinct n-grams than any landmark are told by them all the same."""
    draw = random.Random(3)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randint(3, 9)))
    letters = {"aa": "abcdefghijklmno", "bb": "hijklmnopqrstuv"}
    rows = [(i, " ".join(word(letters[g]) for _ in range(40)), g) for i, g in enumerate(["aa", "bb"] * 60)]
    long = [(1000 + i, " ".join(word(letters[g]) for _ in range(60_000)), g) for i, g in enumerate(["aa", "bb"])]
    found = langid.identify(spark.createDataFrame(rows + long, "doc_id long, text string, lang string"), F.col("doc_id") >= 1000).collect()
    assert all(len(langid.grams(t)) > 30_000 for _, t, _ in long)
    assert {r.doc_id: r.lang_pred for r in found if r.held_out} == {1000: "aa", 1001: "bb"}


def test_segments_are_all_maximal():
    def plain(s):
        """By definition, recursively: the best segment, then both sides of it."""
        if not len(s) or max(s) <= 0:
            return []
        sums = np.concatenate(([0], np.cumsum(s)))
        best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
        i, j = -best[2], -best[2] - best[1]
        return [*plain(s[:i]), (i, j, best[0]), *[(a + j, b + j, c) for a, b, c in plain(s[j:])]]

    r = random.Random(4)
    for _ in range(300):
        s = np.array([r.choice([-3.1, -2.3, -1.7, 1.9, 2.7, 4.3, 0.6]) + r.random() / 7 for _ in range(r.randrange(14))])
        found, want = toxicity.segments(s), plain(list(s))
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert [c for *_, c in found] == pytest.approx([c for *_, c in want])


def test_toxicity(spark, docs, none):
    bad = ["vile", "scum", "trash"]
    rows, labels = [], []
    for i in range(400):
        r, words = random.Random(i), prose(i, 80).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (None, "vile scum trash " * 5)]
    labels += [(1001, None), (None, 1)]
    part = part_of(F.col("doc_id"), 5) == 0
    found = toxicity.rate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), part).collect()
    by = {r.doc_id: r for r in found}
    held = [d for d in range(400) if by[d].held_out]
    assert sum((by[d].score >= 0.5) == (d % 4 == 0) for d in held) >= 0.95 * len(held)
    assert by[1000].score < 0.5 and by[1001].score < 0.5 and all(0 <= r.score <= 1 for r in found)
    assert any(r.passages for r in found if r.doc_id in held and r.doc_id % 4 == 0)
    assert toxicity.rate(none, spark.createDataFrame([], "doc_id long, toxic int"), part).count() == 0
    assert len(toxicity.rate(docs, spark.createDataFrame([], "doc_id long, toxic int"), part).collect()) == len(odd_rows())


def test_toxicity_scores_are_those_of_the_plain_formulas(spark, monkeypatch):
    texts, marks = [], []
    for i in range(240):
        r, words = random.Random(i), prose(i % 200, 50).split()  # the last 40 repeat earlier texts where plain
        if i % 5 == 0:
            words[10:10] = [r.choice(["vile", "scum"]), r.choice(["trash", "vile"])]
        if i % 50 == 1:
            words[5:5] = ["vile", "onlyhere"] * 4  # plain all the same, and a word of one text
        texts.append(" ".join(words))
        marks.append(int(i % 5 == 0))
    models = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: models.append(fit(*a)) or models[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.rate(docs, spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int"), part_of(F.col("doc_id"), 5) == 0).collect()}
    train = [i for i in range(240) if not found[i].held_out]
    count = {(w, k): 0 for i in train for w in map(toxicity.token, texts[i].split()) for k in (0, 1)}
    for text, k in {(texts[i], marks[i]) for i in train}:
        for w in set(map(toxicity.token, text.split())):
            count[w, k] += 1
    total = [sum(n for (_, k), n in count.items() if k == side) for side in (0, 1)]
    words = {w for w, _ in count}
    score = {}
    for w in words:
        prior = toxicity.PRIOR * (count[w, 0] + count[w, 1]) / sum(total) + toxicity.FLAT
        rate = [(count[w, k] + prior) / (total[k] + toxicity.PRIOR + toxicity.FLAT * len(words)) for k in (0, 1)]
        odds = math.log(rate[1] / (1 - rate[1])) - math.log(rate[0] / (1 - rate[0]))
        error = math.sqrt(sum(1 / (count[w, k] + prior) for k in (0, 1)))
        score[w] = math.copysign(max(abs(odds) - toxicity.SURE * error, 0), odds) - toxicity.MARGIN
    (model,) = models
    assert all(model.known.get(w, -toxicity.MARGIN) == pytest.approx(s) for w, s in score.items()) and score["onlyhere"] <= -toxicity.MARGIN < 0 < score["scum"]

    def parts(i):
        s = np.array([score.get(toxicity.token(w), -toxicity.MARGIN) for w in texts[i].split()])
        return len(s), toxicity.segments(s)

    plain = [x for i in train if not marks[i] for _, _, x in parts(i)[1]]
    rate = (len(plain) + 1) / (sum(parts(i)[0] for i in train if not marks[i]) + 1)
    assert plain and model.centre == pytest.approx(math.log(rate)) and model.scale <= math.log(2) / np.median(plain) + 1e-9
    for i in range(240):
        n, own = parts(i)
        over = [model.scale * x - math.log(rate * n) for _, _, x in own]
        z = model.weights @ [1, min(max([*over, -3]), 30), math.log1p(sum(e for e in over if e > 0))]
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-min(max(z, -30), 30))), abs=1e-9)
        assert [(p.start, p.end) for p in found[i].passages] == [(a, b) for (a, b, _), e in zip(own, over) if 1 - math.exp(-math.exp(-e)) <= toxicity.SIGNIFICANT]


def test_layout_and_names_change_nothing(spark, tmp_path):
    """Rows are numbered once: stages keep the same rows when file splits change between plan and action, and whatever columns are called."""
    names = ["doc_id", "text", "lang", "source", "row", "_row", "n", "copies", "kept", "n_words", "pool"]
    rows = [(d, t, g, s, *range(7)) for d, t, g, s, *_ in odd_rows()] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in names[4:])).repartition(3).write.parquet(str(tmp_path / "d"))
    key = "spark.sql.files.maxPartitionBytes"
    was, found = spark.conf.get(key), []
    for now, later in (("128m", "16k"), ("16k", "128m")):
        spark.conf.set(key, now)
        docs = spark.read.parquet(str(tmp_path / "d"))
        plans = [quality.drop_poor(docs), exact.drop_copies(docs), near.drop_near(docs), mixing.mix(docs)]
        spark.conf.set(key, later)
        assert all(p.columns == names for p in plans)
        found.append([Counter(p.select("doc_id", "text").collect()) for p in plans])
    spark.conf.set(key, was)
    assert found[0] == found[1] and all(found[0])


def test_stages_on_empty_tables(none):
    for stage in (quality.drop_poor, exact.drop_copies, near.drop_near, mixing.mix):
        assert stage(none).columns == none.columns and stage(none).count() == 0


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([r[:5] for r in odd_rows()], ", ".join(SCHEMA.split(", ")[:5]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = Scratch(spark, "t").save(out, name)
    ids = {r.doc_id for r in docs.collect()}
    assert not {4, 5, 6, 7, 8, 9} & ids and len(ids & {1, 2, 3}) <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
