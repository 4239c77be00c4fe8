"""Exact, near and substring deduplication against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, SMALL, awkward, collected, empty, needs_tables
from tradelake.llm import exact_dedup, simhash, substring_dedup
from tradelake.llm.common import row_hash, without_rows
from tradelake.llm.components import connected_components


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        keep = min(g)[3]
        out.append((i, keep, len(g), i == keep))
    return sorted(out, key=repr)


def test_exact_groups_awkward(spark):
    docs = awkward(spark)
    got = collected(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept")
    assert got == brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 6, 7, 9, 10, None], key=repr)


def test_exact_prefix_alike(spark):
    """Same length and first characters, different ends; and white space before and among the first characters."""
    base = "x" * 70
    docs = spark.createDataFrame([(1, base + "a"), (2, base + "b"), (3, " " * 5000 + " ".join(base) + "a"), (4, base + "a")], "doc_id long, text string")
    assert collected(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size") == [(1, 3, 3), (2, 2, 1), (3, 3, 3), (4, 3, 3)]


def test_without_rows_without_broadcast(spark, monkeypatch):
    import tradelake.llm.common as common

    docs = awkward(spark)
    gone = docs.where("doc_id in (1, 9)").select("doc_id", row_hash(F.col("text")))
    once = docs.where("doc_id = 4").select("doc_id", row_hash(F.col("text")))
    few = collected(without_rows(docs, "doc_id", ["text"], gone, once), "doc_id", "text")
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert collected(without_rows(docs, "doc_id", ["text"], gone, once), "doc_id", "text") == few and len(few) == 9


def repeated_ids(spark):
    """One id on different texts, copies and near copies under one id, identical rows, and null ids."""
    near = " ".join(f"w{i}" for i in range(400))
    rows = [(1, "same"), (5, "s a m e"), (5, "another unique text"), (6, "twice"), (6, "twice"), (None, "same"), (None, "lonely"), (None, "lonely"), (7, near), (7, near + " end"), (8, near)]
    return spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, _dropped int")


def test_exact_dedup_tells_rows_apart(spark):
    docs = repeated_ids(spark)
    got = collected(exact_dedup.exact_dedup(docs), "doc_id", "text")
    near = " ".join(f"w{i}" for i in range(400))
    want = [(5, "s a m e"), (5, "another unique text"), (6, "twice"), (None, "lonely"), (7, near), (7, near + " end")]
    assert got == sorted(want, key=repr)


def test_near_dedup_tells_rows_apart(spark):
    docs = repeated_ids(spark)
    got = [(r.doc_id, r.text[:20]) for r in simhash.drop_near_duplicates(docs).collect()]
    # the fingerprints of the two long texts link; the row whose text has the smaller hash stays for id 7
    assert sorted(i for i, t in got if t.startswith("w0")) == [7]
    rest = sorted(((i, t) for i, t in got if not t.startswith("w0")), key=repr)
    assert rest == sorted([(1, "same"), (5, "s a m e"), (5, "another unique text"), (6, "twice"), (None, "lonely")], key=repr)


def test_bitmap_follows_the_keys(spark, monkeypatch):
    import tradelake.llm.common as common

    assert [common.bitmap_bits(n) for n in (0, 10**5, 10**7, 10**12)] == [18, 20, 27, 30]
    docs = awkward(spark)
    want = collected(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept")
    monkeypatch.setattr(common, "bitmap_bits", lambda n: 1)  # all rows go on to the full hash
    assert collected(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept") == want


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(prints):
    """prints [(id, fp)] -> {(id, fp): smallest id reachable}"""
    fps = sorted({fp for _, fp in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, fp in prints:
        if i is not None:
            least[find(fp)] = min(least.get(find(fp), i), i)
    return [(i, fp, least.get(find(fp))) for i, fp in prints]


def check_near(spark, docs):
    got = collected(simhash.near_duplicates(docs).withColumn("fp", F.col("fp").cast("decimal(20,0)")), "doc_id", "fp", "component_id")
    got = [(i, int(fp) % 2**64, c) for i, fp, c in got]
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fingerprint_is_the_engine_hash(spark):
    """The features are XXH64 with seed 42, as the engine's own function gives it."""
    one = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert xxhash.xxh64_intdigest(b"a b c", 42) == one % 2**64
    assert simhash.fingerprint("A b\x0bC") == one % 2**64


def test_near_awkward(spark):
    check_near(spark, awkward(spark))
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(awkward(spark)).columns == awkward(spark).columns


@needs_tables
def test_near_real(spark):
    check_near(spark, spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_fingerprint_in_pieces(monkeypatch):
    whole = simhash.fingerprint(LONG)
    monkeypatch.setattr(simhash, "COUNT_AT_ONCE", 100)
    assert simhash.fingerprint(LONG) == whole


@pytest.mark.parametrize("hot", [4096, 70, 2])
def test_links_connect_all(spark, hot):
    """Clusters with chains of differing bits, among them buckets above the limit."""
    rng = random.Random(hot)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    base = rng.getrandbits(32)
    fps |= {base << 32 | rng.getrandbits(12) for _ in range(300)}  # the same upper half
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot)
    pairs = {(r.a % 2**64, r.b % 2**64) for r in links.collect()}
    assert len(pairs) < 64 * len(fps)
    roots = {r.node % 2**64: r.root for r in connected_components(links).collect()}
    label = {f: roots.get(f, f"alone {f}") for f in fps}
    want = brute_components([(i, f) for i, f in enumerate(sorted(fps))])
    classes = defaultdict(set)
    for i, f, c in want:
        classes[c].add(label[f])
    assert all(len(x) == 1 for x in classes.values()) and len({x for s in classes.values() for x in s}) == len(classes)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and roots[600] == roots[601] != roots[0] and 500 not in roots
    assert connected_components(edges.limit(0)).count() == 0


def brute_repeats(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, 2**70), 2**69 if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < (2**69 if i is None else i):
                gone[j : j + 13] = [True] * 13
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def check_repeats(docs, **options):
    got = collected(substring_dedup.remove_repeats(docs, **options), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common = text(60)
    extra = [(100 + i, f"{text(rng.randint(0, 40))} {common} {text(rng.randint(0, 40))}", "en", "a") for i in range(40)]
    extra += [(200, f"{common} {common}", "en", "a"), (None, common, "en", "a"), (201, "x " * 40, "en", "a"), (202, "x " * 13, "en", "a"), (203, "x " * 12, "en", "a")]
    return awkward(spark, extra)


def test_repeats_awkward(spark):
    check_repeats(passages(spark).repartition(4), shape=substring_dedup.Shape(2000, 1, 16, 1))
    check_repeats(passages(spark).coalesce(1))
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_repeats_with_many_blocks_and_a_full_sketch(spark):
    """Many blocks; and an overfull sketch, which lets every window through: the result stays exact."""
    check_repeats(passages(spark).repartition(3), shape=substring_dedup.Shape(3000, 40, 8, 17))
    check_repeats(passages(spark).repartition(3), shape=substring_dedup.Shape(3000, 3, 2, 5))


def test_sketch_grows_with_the_input():
    """From 0.5 GB to 100 TB: the share of different windows that is estimated repeated, and what a block and a unit hold."""
    for n_bytes in (5 * 10**8, 3 * 10**10, 10**12, 10**13, 10**14):
        shape, windows = substring_dedup.shape_for(n_bytes), n_bytes / substring_dedup.WINDOW_BYTES
        false = (1 - np.exp(-windows / shape.counters)) ** substring_dedup.ROWS
        assert false < 0.1, n_bytes
        assert 1 << shape.width_bits <= 1 << 29 and windows / shape.blocks <= 1.1 * (1 << 25)  # a row of counters in bytes
        assert shape.unit_bytes <= 32 << 20 and windows / shape.entry_blocks <= 1 << 21
    assert substring_dedup.shape_for(0).blocks == 1


def test_sketch_rarely_takes_different_windows_for_repeated():
    shape, rng = substring_dedup.shape_for(6 * 2**20), np.random.default_rng(2)
    h = np.sort(rng.integers(0, 2**63, 2**20).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert shape.blocks == 1 or shape.blocks == 2
    hit = np.ones(len(h), bool)
    for block, part in substring_dedup._ranges(h, shape.blocks):
        for place in substring_dedup._counters(h[part], shape.width_bits):
            hit[part] &= np.bincount(place, minlength=1 << shape.width_bits)[place] > 1
    assert hit.mean() < 0.1


@needs_tables
def test_repeats_real(spark):
    check_repeats(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5), shape=substring_dedup.Shape(1 << 15, 7, 14, 3))


def test_sketch_overestimates():
    """Merged counters never fall below the true count, capped at 2."""
    rng = np.random.default_rng(1)
    units = [np.sort(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(5)]
    units[3][:50] = units[1][:50]
    units[3].sort()
    bits = 12
    counts = [np.zeros(1 << bits, np.uint8) for _ in range(substring_dedup.ROWS)]
    for h in units:
        raw = zstandard.decompress(substring_dedup._sketch_slice(h, np.zeros(len(h), int), bits))
        for row, count in enumerate(counts):
            at, many = substring_dedup._parse_slice(raw, row)
            count[at] = np.minimum(count[at] + 1 + many, 2)
    twice = np.intersect1d(units[1], units[3])
    assert len(twice) == 50
    assert all((count[place] == 2).all() for count, place in zip(counts, substring_dedup._counters(twice, bits), strict=True))
