"""Tokenizers, mixing, language ID, private data, licenses and audio against libraries, brute force and planted cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, SMALL, awkward, collected, empty, needs_tables
from tradelake.llm import chroma, langid, license_scan, mixing, pii, piece_bpe, token_counts

POOL = "ab  \n\t▁éß日本語가😀́\x00\x1c\x85　​10.,!\'s\'llTthe ing\U00020000\U0003fc2c՘<|endoftext|></s><s>@+-()"


def noise(seed, n=1500, longest=60):
    rng = random.Random(seed)
    return ["", " ", "  ", "▁", "▁▁a", "<|endoftext|>", "a<|endoftext|>b", "a" * 3000, "ab" * 2000, " " * 2000, "\n" * 500, "</s>", "<0x41>"] + ["".join(rng.choice(POOL) for _ in range(rng.randint(1, longest))) for _ in range(n)]


# SentencePiece


def test_codec_equals_library():
    codec = piece_bpe.codec()
    for text, ids in zip(texts := noise(1), codec.encode(texts), strict=True):
        assert ids.tolist() == codec.library.encode(text, add_eos=True)
        assert codec.decode(ids) == codec.library.decode(ids.tolist())


def test_both_agendas_agree():
    codec = piece_bpe.codec()
    for text in noise(2, 300):
        for chunk in codec.chunk.findall(codec.library.normalize(text)):
            assert codec._merged_short(chunk) == codec._merged_long(chunk)


def test_decode_of_any_ids():
    codec, rng = piece_bpe.codec(), random.Random(3)
    for _ in range(3000):
        ids = np.array([rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 12))], np.int32)
        assert codec.decode(ids) == codec.library.decode(ids.tolist())


def test_chunks_are_kept_and_dropped(monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT_CHUNKS", 5)
    codec = piece_bpe.PieceCodec(piece_bpe.default_model())
    for text in noise(4, 50):
        assert codec.encode([text])[0].tolist() == codec.library.encode(text, add_eos=True)
    assert len(codec.chunks) <= 5 and len(codec.chunks.older) <= 5


def test_codec_awkward(spark):
    docs = awkward(spark)
    library = piece_bpe.codec().library
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in piece_bpe.encode_decode(docs).collect()), key=repr)
    want = [(r.doc_id, i := library.encode(r.text or "", add_eos=True), library.decode(i)) for r in docs.collect()]
    assert got == sorted(want, key=repr)
    assert piece_bpe.encode_decode(empty(spark)).count() == 0


# token counts


def test_counts_equal_library():
    counter, texts = token_counts.RankCounter(token_counts.default_tokenizer()), noise(5)
    assert counter.count_texts(texts) == [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)]


def test_counts_with_a_full_table(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_TOKENS", 7)
    counter, texts = token_counts.RankCounter(token_counts.default_tokenizer()), noise(6, 100)
    for x in texts:
        assert counter.count_texts([x]) == [len(counter.library.encode(x, add_special_tokens=False).ids)]


def test_counts_awkward(spark):
    docs = awkward(spark)
    library = token_counts.counter().library
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert collected(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    assert token_counts.token_counts(empty(spark)).count() == 0


# mixing


def brute_targets(sizes):
    """{source: size} -> {source: target}, sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, total = dict.fromkeys(names, 0.0), sum(sizes.values())
    capped: set = set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over
        for s in over:
            target[s] = 3.0 * sizes[s]


def brute_mix(rows):
    words = [(i, s, len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n in words:
        sizes[s] += n
    target, out = brute_targets(sizes), []
    for i, s, n in words:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        draw = int(hashlib.md5(f"17:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((i, n, sizes[s], round(target[s], 6), int(rate) + (draw < rate - int(rate))))
    return sorted(out, key=repr)


def test_mixing_awkward(spark):
    docs = awkward(spark, [(20 + i, "w " * i, "en", f"s{i % 9}") for i in range(60)])
    plan = mixing.mixing_plan(docs).withColumn("target", F.round("target", 6))
    got = collected(plan, "doc_id", "size", "source_size", "target", "copies")
    assert got == brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[4] for r in got)
    assert collected(mixed, "doc_id", "text") == collected(mixing.mix(docs.repartition(3)), "doc_id", "text")
    assert mixing.mixing_plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    assert mixing.mixing_plan(docs.where("text IS NULL")).first().copies == 0


def test_mixing_without_broadcast(spark, monkeypatch):
    docs = awkward(spark)
    few = collected(mixing.mixing_plan(docs), "doc_id", "copies")
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 1)
    assert collected(mixing.mixing_plan(docs), "doc_id", "copies") == few


# language ID


@needs_tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    blind = docs.where("doc_id % 2 = 1").withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    found = langid.identify(blind, model).join(blind.select("doc_id", "truth"), "doc_id")
    assert found.where("language = truth").count() >= 0.98 * found.count()
    assert found.where("NOT kept").count() <= 0.02 * found.count()


@needs_tables
def test_language_awkward(spark):
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    extra = [(50, "漢字仮名交じり文の例文であり" * 20, "en", "a"), (51, "12345 67890 !!! ...", "en", "a"), (52, "the and of thation with", "xx-unknown", "h.example.fr")]
    got = {r.doc_id: r for r in langid.identify(awkward(spark, extra), model).collect()}
    assert len(got) == 14
    assert not any(got[i].kept for i in (4, 5, 6, 50, 51)) and got[51].language == "und" and got[50].language == "und"
    assert got[52].kept and got[52].language == "en"
    assert langid.identify(empty(spark), model).count() == 0
    kept = langid.keep_identified(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert langid.keep_identified(empty(spark)).count() == 0
    assert langid.fit(empty(spark))[0] == []


def test_evidence_decides_where_text_does_not(spark):
    """Two languages with the same words: the declaration, then the host, tips the balance."""
    train = spark.createDataFrame([(i, "lorem ipsum dolor", "aa" if i % 2 else "bb") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    rows = [(1, "lorem ipsum", "aa", None), (2, "lorem ipsum", "bb", None)]
    rows += [(100 + i, "lorem ipsum", "bb", f"www{i % 4}.site.bx") for i in range(400)] + [(3, "lorem ipsum", None, "new.site.bx")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model).collect()}
    assert got[1].language == "aa" and got[2].language == "bb"


def brute_prior(rows, i):
    """rows [(host, domain, suffix, p)]: the prior of row i, in which its own text does not count."""
    me, rest = rows[i], [r for j, r in enumerate(rows) if j != i]

    def level(members, above):
        n = len(above)
        return [(sum(r[3][k] for r in members) + 10 * above[k]) / (len(members) + 10) for k in range(n)]

    out = level(rest, [1 / len(me[3])] * len(me[3]))
    for k in (2, 1, 0):
        if me[k] is not None:
            out = level([r for r in rest if r[k] == me[k]], out)
    return out


def test_host_priors_are_smoothed_by_level(spark):
    names = [("a.x.de", "x.de", "de"), ("b.x.de", "x.de", "de"), ("c.y.de", "y.de", "de"), ("x.co.uk", "x.co.uk", "uk"), ("w.y.co.uk", "y.co.uk", "uk"), ("co.uk", "co.uk", "uk"), ("10.0.0.1", None, None), ("local", None, None), (None, None, None)]
    rng = random.Random(2)
    rows = [(i, *rng.choice(names[: 3 + i % 7]), [p, 1 - p]) for i in range(120) for p in [rng.random()]]
    df = spark.createDataFrame([(i, h, p) for i, h, _, _, p in rows], "id long, host string, p array<double>").withColumn("domain", langid.domain_of(F.col("host"))).withColumn("suffix", langid.suffix_of(F.col("host")))
    assert {(r.host, r.domain, r.suffix) for r in df.collect()} <= set(names)
    hosts, whole = langid.host_sums(df, 2)
    got = {r.id: r.prior for r in df.join(hosts, "host", "left").select("id", langid.prior(F.col("p"), F.lit(True), whole).alias("prior")).collect()}
    plain = [r[1:] for r in rows]
    assert all(got[i] == pytest.approx(brute_prior(plain, i)) for i in range(len(rows)))


def test_posterior_equals_brute_force(spark):
    """The fused posterior, from the texts' trigrams, declarations and hosts, in plain arithmetic."""
    rng, words = random.Random(8), {"aa": ["lorem", "ipsum", "dolor"], "bb": ["lorem", "sed", "amet"], "cc": ["zzyx", "qwxk", "ipsum"]}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    train = spark.createDataFrame([(i, text(k, 12), k) for i in range(30) for k in words], "doc_id long, text string, lang string")
    languages, weights = model = langid.fit(train)
    hosts = [None, "a.x.de", "b.x.de", "y.de", "w.z.co.uk", "q.co.uk"]
    rows = [(i, text(rng.choice(list(words)), rng.randint(1, 4)) if i % 9 else "12 34", rng.choice([None, "AA-x", "bb", "cc", "dd"]), rng.choice(hosts)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names, base = [*languages, "und"], [0.99 / 3] * 3 + [0.01]
    likes, counts = [], []
    for _, t, _, _ in rows:
        raw = np.frombuffer(langid.letters(t), np.uint8)
        like = np.r_[0.25 * weights[langid.trigrams(raw)].astype(float).sum(0), 0.0] if len(raw) > 2 else np.zeros(4)
        likes.append(like)
        p = np.exp(like + np.log(base))
        counts.append(p / p.sum())
    domain = {"a.x.de": "x.de", "b.x.de": "x.de", "y.de": "y.de", "w.z.co.uk": "z.co.uk", "q.co.uk": "q.co.uk", None: None}
    lettered = [i for i, r in enumerate(rows) if r[1] != "12 34"]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, (_, t, says, host) in enumerate(rows):
        here = lettered if i in lettered else [*lettered, i]
        known = [(rows[j][3], domain[rows[j][3]], rows[j][3].rsplit(".", 1)[1] if rows[j][3] else None, counts[j]) for j in here]
        prior = brute_prior(known, here.index(i))
        declared = says.lower().split("-")[0] if says else None
        word = [0.9 if x == declared else 0.1 / 3 for x in names] if declared in languages else [1.0] * 4
        post = np.exp(likes[i]) * prior * word
        post /= post.sum()
        assert got[i].probability == pytest.approx(post.max(), rel=1e-6), i
        if t == "12 34":
            assert got[i].language == "und" and not got[i].kept
        elif declared != "dd":
            assert got[i].language == names[int(post.argmax())] and got[i].kept == (names[int(post.argmax())] != "und" and post.max() >= 0.7)


def test_language_tells_rows_apart(spark):
    """Of one id, the row with a language stays and the one without goes; so do rows with a null id."""
    words = "the quick fox of that house went on and on "
    rows = [(i, words * 2 + f"number {i}", "en", None) for i in range(50)] + [(7, "12 34 !", "en", None), (None, words, "en", None), (None, "123", "en", None)]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("_dropped", F.lit(1)))
    assert collected(kept.select("doc_id", "text"), "doc_id", "text") == sorted([(i, t) for i, t, _, _ in [*rows[:50], rows[51]]], key=repr)


def test_unclosed_markup_takes_linear_time(spark):
    html = "<p>x</p>" + "<script <!-- <style " * 40_000
    pages = spark.createDataFrame([(1, "http://a.example.org/", html), (2, "http://a.example.org/", "<p>y<!-- " * 40_000)], "page_id long, url string, html string")
    assert [r.text.split() for r in langid.page_rows(pages).orderBy("page_id").collect()] == [["x"], ["y"]]


def test_every_label_is_modelled(spark):
    """40 labels with words of their own, one of them in 3 rows beside 6000 of another, in mixed case and with regions."""
    words = lambda k: " ".join(chr(0x3B1 + k % 20) * 2 + chr(0x430 + k // 2) + chr(97 + (k + j) % 26) for j in range(30))
    rows = [(i, words(0), "l00", None) for i in range(6000)] + [(10_000 + 10 * k + j, words(k), f"L{k:02}-X", None) for k in range(1, 40) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    assert model[0] == [f"l{k:02}" for k in range(40)]
    found = langid.identify(docs.where("doc_id >= 10000"), model).collect()
    assert all(r.kept and r.language == f"l{(r.doc_id - 10_000) // 10:02}" for r in found)
    other = spark.createDataFrame([(1, "漢字仮名交じり文の例文であり" * 20, "JA-jp", None), (2, "...", "ja", None)], docs.schema)
    assert [(r.language, r.kept) for r in langid.identify(other, model).orderBy("doc_id").collect()] == [("ja", True), ("und", False)]


def test_pages_give_markup_evidence(spark):
    html = '<!DOCTYPE html><HTML class="x" lang="fr-CA"><script>var t="</p>";</script><!-- ad --><p>Bonjour &amp; salut</p>'
    r = langid.page_rows(spark.createDataFrame([(1, "https://me:x@m.example.org:80/fr?x#y", html), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert r[0].lang == "fr" and r[0].source == "m.example.org" and r[0].text.split() == ["Bonjour", "salut"]
    assert r[1].lang is None and r[1].source is None


# private data


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(5)
    parts = ["a@b.c", ".", "@", "1.2.3.4", "256", " ", "-", "4041894974608795", "+1 (555) 123-4567", "x", "9" * 16, "\n", "+", "0", "_", "é", "٣", "4111 1111 1111 1111", "(", ")"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        spans = pii.base_spans(text)
        assert spans == brute_spans(text)
        for x in pii.seen_in(text):
            assert x["kind"] >= 0 or all(x["end"] <= a or b <= x["start"] for _, a, b in spans)


def test_long_runs_take_linear_time():
    for text in ("1" * 10**6, "a" * 10**6 + "@", "1." * 3 * 10**5, "+" * 10**5, "a1" * 5 * 10**5, "1 " * 10**5, "a1 " * 10**5, " " * 10**6 + "a1" + " " * 10**6 + "b2"):
        pii.seen_in(text)


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"Zeile {i}. bitte schreiben an user{i}@host{i % 7}.example.org danke", None, None) for i in range(60)]
    rows += [(100, "Zeile. bitte schreiben an user99(at)host danke", None, None), (101, "build 4711x9 was fine", None, None), (102, "version 12.7 is out", None, None)]
    got = {r.doc_id: r for r in pii.find_private(awkward(spark, rows)).collect()}
    found = got[100].spans
    assert [(s.kind, rows[60][1][s.start : s.end]) for s in found] == [(0, "user99(at)host")] and got[100].base == []
    assert got[101].spans == [] and got[102].spans == [] and len(got[3].spans) == 0
    assert all([tuple(s) for s in got[i].base] == [tuple(s) for s in got[i].spans] == brute_spans(rows[i][1]) for i in range(11, 60))
    assert pii.find_private(empty(spark)).count() == 0


def test_candidates():
    found = lambda t: [t[x["start"] : x["end"]] for x in pii.seen_in(t) if x["kind"] < 0]
    assert found("call me on 020 7946 0958, please") == ["020 7946 0958"]
    assert found("on (020) 7946-0958 or 4111 1111 1111 1112 now") == ["020) 7946-0958", "4111 1111 1111 1112"]
    assert found("anna(at)host and a.b and don't and end. x_y") == ["anna(at)host", "a.b", "x_y"] or found("anna(at)host and a.b") == ["anna(at)host", "a.b"]
    assert found("in 12, 13 and x14: 15") == ["12", "13", "x14", "15"]
    long = "x1" * 100
    assert found(f"see {long} there") == [long]
    ours = {x["surface"] for x in [*pii.seen_in(f"see {long}a there"), *pii.seen_in(f"see {long}b there")]}
    assert len(ours) == 2
    context = "w" * 300
    assert pii.seen_in(f"{context} {' ' * 500}mail a@b.example {context}")[0]["patterns"] == [f"{pii._named(context)} mail _", f"mail _ {pii._named(context)}"]


def brute_bootstrap(texts):
    """The spans that trusted patterns add to each text, in plain Python."""
    seen = [pii.seen_in(t) for t in texts]
    edges = defaultdict(int)
    for x in (x for xs in seen for x in xs):
        for p in x["patterns"]:
            edges[p, x["surface"], x["kind"]] += 1
    score = {}
    for turn in range(pii.ROUNDS):
        sums, total, seeds = defaultdict(lambda: [0.0] * 4), defaultdict(int), defaultdict(lambda: [0] * 4)
        for (p, surface, kind), n in edges.items():
            total[p] += n
            row = [float(kind == k) for k in range(4)] if kind >= 0 else score.get(surface, [0.0] * 4)
            for k in range(4):
                sums[p][k] += n * row[k]
                seeds[p][k] += kind == k
        confidence = {p: [x / (total[p] + pii.SMOOTHING) for x in xs] for p, xs in sums.items()}
        weights = defaultdict(int)
        score = defaultdict(lambda: [0.0] * 4)
        for (p, surface, kind), n in edges.items():
            if kind < 0:
                weights[surface] += n
                for k in range(4):
                    score[surface][k] += n * confidence[p][k]
        score = {s: [x / weights[s] for x in xs] for s, xs in score.items()}
    trusted = {}
    for p, xs in confidence.items():
        best = max(range(4), key=lambda k: (xs[k], -k))
        if xs[best] >= pii.LEAST_CONFIDENCE and seeds[p][best] >= pii.LEAST_SEEDS:
            trusted[p] = (xs[best], -best)
    return [sorted((-max(trusted[p] for p in x["patterns"] if p in trusted)[1], x["start"], x["end"]) for x in xs if x["kind"] < 0 and any(p in trusted for p in x["patterns"])) for xs in seen]


def test_added_spans_equal_brute_force(spark):
    """Planted contexts of three kinds, unseen forms in them, and the same contexts around other words."""
    rng = random.Random(6)
    mail = lambda: f"u{rng.randint(0, 60)}@h{rng.randint(0, 9)}.example"
    phone = lambda: f"+49 30 {rng.randint(100000, 999999)}"
    ip = lambda: f"10.0.{rng.randint(0, 99)}.{rng.randint(0, 99)}"
    odd = lambda: rng.choice([f"anna{rng.randint(0, 9)}(at)host", f"030 {rng.randint(1000, 9999)} 77", f"host-{rng.randint(1, 9)}", "x_y", "12.5", "soon"])
    frames = ["please write to {} today", "call me on {} after six", "server at {} is down", "we saw {} there", "version {} of it"]
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(5)
            value = rng.choice([mail, phone, ip][k : k + 1] * 4 + [odd]) if k < 3 else rng.choice([mail, odd, odd, odd])
            parts.append(frames[k].format(value()))
        texts.append(". ".join(parts))
    got = pii.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    want = brute_bootstrap(texts)
    assert sum(map(len, want)) > 20 and any("(at)" in t[a:b] for t, xs in zip(texts, want, strict=True) for _, a, b in xs) and any(" " in t[a:b] for t, xs in zip(texts, want, strict=True) for _, a, b in xs)
    for r in got:
        base = {tuple(s) for s in r.base}
        assert sorted(tuple(s) for s in r.spans if tuple(s) not in base) == want[r.doc_id]


def test_patterns_of_few_seeds_are_not_trusted(spark):
    rows = [(i, f"mail an u{i}@h.example.org bitte", None, None) for i in range(11, 14)] + [(100, "mail an u9(at)h bitte", None, None)]
    assert {r.doc_id: r for r in pii.find_private(awkward(spark, rows)).collect()}[100].spans == []


# licenses


def test_license_blocks(spark):
    mit = license_scan.TEMPLATES[2][1]
    changed = mit.replace("free of charge", "gratis").replace(". ", ".\n")
    rows = [
        (30, f"Title\n\nCopyright (c) 2020 A\n{changed}\n\nprose", "en", "a"),
        (31, "prose here\nLicensed under the Apache License, Version 2.0.\nmore prose of the day", "en", "a"),
        (32, "prose\nLicensed under CC BY 4.0.\nAll rights reserved.\nprose", "en", "a"),
        (33, "a driver's licence is needed for this car, said the man at the desk of the office", "en", "a"),
        (34, "x " * 3000 + "Released under the MIT License." + " y" * 3000, "en", "a"),
        (35, "İİİ\nReleased under the MIT License.", "en", "a"),
    ]
    got = defaultdict(list)
    for r in license_scan.scan_licenses(awkward(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert [r.license for r in got[30]] == ["MIT"] and got[30][0].confirmed and "-charge" in got[30][0].changes and "+gratis" in got[30][0].changes
    assert [(r.license, r.n_changes, r.confirmed) for r in got[31]] == [("Apache-2.0", 0, True)]
    assert sorted(r.license for r in got[32] if r.confirmed) == ["CC-BY-4.0", "all-rights-reserved"]
    assert not any(r.confirmed for r in got[33])
    assert got[35][0].license == "MIT" and rows[5][1][got[35][0].start : got[35][0].end] == "Released under the MIT License."
    assert set(got) <= {30, 31, 32, 33, 34, 35}
    assert license_scan.scan_licenses(empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 1.", None),
        ("General Public License, version 2", None),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-NC-ND 3.0.", "CC-BY-NC-ND-3.0"),
        ("Licensed under CC BY 2.5.", None),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
        ("CC BY-ND 4.0", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Licensed under the BSD License.", None),
        ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
        ("Some rights reserved.", None),
        ("No rights reserved.", None),
        ("All rights reserved.", "all-rights-reserved"),
        ("Not licensed under the MIT License.", None),
        ("This is no longer licensed under the MIT License.", None),
        ("It was never released under the MIT License.", None),
        ("It is not new. Released under the MIT License.", "MIT"),
        ("Released under the MIT Licence.", "MIT"),
        ("Licensed under the Mozilla Public License, version 2.0.", "MPL-2.0"),
        ("Licensed under the Mozilla Public License, version 1.1.", None),
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
        ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("SPDX-License-Identifier: Zed-1.0", None),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("This work is dedicated to the public domain under CC0 1.0.", "CC0-1.0"),
    ],
)
def test_licenses_are_told_apart(text, name):
    scanner = SCANNERS[0] if SCANNERS else SCANNERS.append(license_scan.Scanner()) or SCANNERS[0]
    assert [x["license"] for x in scanner.scan(text) if x["confirmed"]] == ([name] if name else []), scanner.scan(text)


SCANNERS = []


def test_each_wording_is_its_license():
    """Each template alone, within prose, and with a tenth of its plain words replaced, against the plain definition."""
    scanner, rng = license_scan.Scanner(), random.Random(4)
    for i, (name, wording) in enumerate(license_scan.TEMPLATES):
        for text in (wording, f"the quick fox went on\n{wording}\nto see a man"):
            found = [x for x in scanner.scan(text) if x["confirmed"]]
            assert [x["license"] for x in found] == [name], (text, found)
            assert found[0]["n_changes"] == 0 and wording.startswith(text[found[0]["start"] : found[0]["end"]].rstrip(" .")[:20])
        words = wording.split()
        plain = [k for k in range(3, len(words) - 3) if not license_scan.IDENTIFYING.fullmatch(words[k].lower().strip(".,;:()\"")) and not license_scan.VERSION.fullmatch(words[k].strip(".,;:"))]
        if len(words) > 40:
            for k in rng.sample(plain, len(words) // 12):
                words[k] = f"zz{k}"
            found = [x for x in scanner.scan(" ".join(words)) if x["confirmed"]]
            assert [x["license"] for x in found] == [name], (name, found)
            theirs = license_scan._WORD.findall(" ".join(words).lower())
            ours = scanner.words[found[0]["template"]]
            assert found[0]["n_changes"] == brute_changes(ours, theirs)


def brute_changes(a, b):
    """Words to take out and put in to get from a to b, by the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


def test_notices_inside_running_text():
    scanner, prose = license_scan.Scanner(), "the quick fox of the house went on to see a man in that town and "
    short, mit, apache, bsd = "Licensed under the Apache License, Version 2.0.", *(license_scan.TEMPLATES[i][1] for i in (2, 5, 6))

    def confirmed(text):
        return [(x["license"], text[x["start"] : x["end"]]) for x in scanner.scan(text) if x["confirmed"]]

    assert confirmed(prose * 4 + short + " " + prose * 4) == [("Apache-2.0", short)]
    assert confirmed("x " * 3000 + "Released under the MIT License." + " y" * 3000) == [("MIT", "Released under the MIT License.")]
    for name, wording in (("MIT", mit), ("Apache-2.0", apache), ("BSD-2-Clause", bsd)):
        assert confirmed(prose * 60 + wording + " " + prose * 60) == [(name, wording)]
    both = f"{prose * 60}{mit} {prose} {short} {prose} {short} {prose * 60}"
    assert confirmed(both) == [("MIT", mit), ("Apache-2.0", short), ("Apache-2.0", short)]
    assert confirmed("Licensed under CC BY 4.0. All rights reserved.") == [("CC-BY-4.0", "Licensed under CC BY 4.0."), ("all-rights-reserved", "All rights reserved.")]


def test_many_notices_in_one_text():
    scanner = license_scan.Scanner()
    text = "\n".join(f"part {i}\nReleased under the MIT License.\nthe licence of {i}" for i in range(1500))
    found = scanner.scan(text)
    assert sum(x["confirmed"] for x in found) == 1500
    assert all(x["end"] <= y["start"] for x, y in zip(found, found[1:]))


def test_all_changes_are_returned():
    words = license_scan.TEMPLATES[2][1].split()
    for i in range(3, len(words), 5):
        words[i] = f"other{i}"
    found = license_scan.Scanner().scan(" ".join(words))[0]
    assert found["n_changes"] > 50 and len(found["changes"].split()) == found["n_changes"]


def test_ranking_by_compression():
    scanner = license_scan.Scanner()
    for i, (_, wording) in enumerate(license_scan.TEMPLATES):
        best = scanner.ranked(wording)[0]
        assert scanner.templates[best[1]][0] == scanner.templates[i][0] and best[0] > 0.4
        assert scanner.differences(wording, i)[1] == []


# audio


def tune(seed, seconds, rate=11025):
    """A melody of notes with overtones."""
    rng, t = np.random.default_rng(seed), np.arange(int(0.25 * rate)) / rate
    notes = [220 * 2 ** (rng.integers(0, 24) / 12) for _ in range(int(seconds / 0.25))]
    return np.concatenate([sum(np.sin(2 * np.pi * k * f * t) / k for k in (1, 2, 3)) * np.hanning(len(t)) ** 0.2 for f in notes])


def pcm(x):
    return (np.clip(x / 3, -1, 1) * 32767).astype("<i2").tobytes()


def test_recordings_align(spark):
    spec, a, b = chroma.Spec(), tune(1, 30), tune(2, 30)
    noisy = a + np.random.default_rng(3).normal(0, 0.02, len(a))
    rows = [(1, pcm(a)), (2, pcm(noisy)), (3, pcm(a[spec.hop * 40 :])), (4, pcm(b)), (5, pcm(a * 0.5)), (6, None), (7, b""), (8, pcm(a[:100])), (None, pcm(a)), (9, pcm(np.zeros(11025 * 5)))]
    df = spark.createDataFrame(rows, "id long, samples binary")
    got = {r.id: r for r in chroma.align(chroma.fingerprints(df, "id", "samples", spec)).collect()}
    assert len(got) == 10
    assert all(got[i].aligned and got[i].reference_id == 1 and got[i].class_id == 1 for i in (2, 3, 5))
    assert got[2].offset == 0 and got[3].offset == -40 and got[3].bit_errors == 0 and got[2].bit_errors < 0.1
    assert not got[4].aligned and got[4].class_id == 4 and got[1].reference_id is None
    assert got[6].n_prints == got[7].n_prints == got[8].n_prints == 0
    assert chroma.align(chroma.fingerprints(df.limit(0), "id", "samples", spec)).count() == 0


def test_copies_of_shared_passages_are_linked(spark):
    """The landmarks of 3 and 4 are first in 1 and 2, which do not align with them; 5 repeats 4; 7's passage is second in 6."""
    rng = np.random.default_rng(7)
    x, y, u, v, w, z = (rng.integers(-(2**31), 2**31, 40).astype(np.int32) for _ in range(6))
    both, near = np.r_[x, y], np.r_[x, y]
    near[39:41] ^= 1
    fps = {1: np.r_[x, u], 2: np.r_[v, y], 3: both, 4: near, 5: near, 6: np.r_[w, z, w, u ^ 5], 7: np.r_[w, u ^ 5 ^ (1 << np.arange(40) % 31)]}
    rows = [(i, 0, [int(k) for k in f]) for i, f in fps.items()]
    got = {r.id: r for r in chroma.align(spark.createDataFrame(rows, "id long, n_samples long, fp array<int>")).collect()}
    assert {i: r.class_id for i, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6}
    assert (got[4].reference_id, got[5].reference_id, got[5].bit_errors, got[7].offset) == (3, 4, 0.0, -80)
    assert got[4].aligned and not got[3].aligned


def test_areas_equal_plain_sums():
    """The first filter over the integral image against sums over the frames themselves."""
    spec = chroma.Spec(window=4)
    x = np.random.default_rng(0).random((9, 12)).astype(np.float32)
    levels = np.tile([-0.35, 0.0, 0.35], (16, 1))
    got = chroma.packed(x, spec, levels)
    assert len(got) == 6
    for t in range(6):
        a, b = x[t : t + 2, 0:6].sum(), x[t + 2 : t + 4, 0:6].sum()
        kind, low, high, part = chroma.FILTERS[1]
        level = int(np.digitize(np.log((1e-6 + a) / (1e-6 + b)), levels[1]))
        assert (kind, low, high, part) == (0, 0, 6, 1) and got[t] >> 28 & 3 == level ^ (level >> 1)


def test_levels_are_quartiles(spark):
    spec = chroma.Spec()
    rows = [(i, pcm(tune(i, 5))) for i in range(6)]
    df = spark.createDataFrame([*rows, (7, None), (8, b"x")], "id long, samples binary")
    got = chroma.fit_levels(df, "id", "samples", spec)
    found = np.concatenate([chroma.answers(chroma.chroma(np.frombuffer(x, "<i2").astype(np.float32), spec), spec) for _, x in rows], 1)
    assert np.abs((found[:, None, :] < got[:, :, None]).mean(2) - [0.25, 0.5, 0.75]).max() < 0.02
    assert chroma.fit_levels(df.limit(0), "id", "samples", spec).shape == (16, 3)


def test_levels_come_from_all_recordings(spark):
    """Of 2,500 recordings, more than a sample of 2,000 holds, each has its part; prints are those of the levels, exactly."""
    spec, rng = chroma.SHORT, np.random.default_rng(11)
    rows = [(i, (128 + (40 + i % 60) * np.sin(np.arange(900) * rng.uniform(0.05, 2)) + rng.normal(0, 3, 900)).astype(np.uint8).tobytes()) for i in range(2500)]
    df = spark.createDataFrame([*rows, (3000, None)], "id long, samples binary")
    got = chroma.fit_levels(df, "id", "samples", spec, "u1")
    features = [chroma.chroma(np.frombuffer(x, np.uint8).astype(np.float32) - 128, spec) for _, x in rows]
    found = np.concatenate([chroma.answers(f, spec) for f in features], 1)
    # the least step below whose upper end a quarter, half and three quarters of all answers lie
    for k, q in enumerate((0.25, 0.5, 0.75)):
        assert ((found < got[:, k : k + 1]).mean(1) >= q).all() and ((found < got[:, k : k + 1] - 1 / chroma.STEPS).mean(1) < q).all()
    prints = {r.id: list(r.fp) for r in chroma.fingerprints(df, "id", "samples", spec, "u1").collect()}
    assert prints == {r.id: list(r.fp) for r in chroma.fingerprints(df, "id", "samples", spec, "u1", got).collect()}
    assert prints[3000] == [] and all(prints[i] == chroma.packed(features[i], spec, got).view(np.int32).tolist() for i in range(0, 2500, 50))


def brute_links(prints):
    """{id: fingerprint} -> pairs that share a landmark and align at an offset for which one votes."""
    places = {i: defaultdict(list) for i in prints}
    for i, fp in prints.items():
        for k in range(len(fp) - chroma.LANDMARKS[0] + 1):
            places[i][fp[k : k + chroma.LANDMARKS[0]].tobytes()].append(k)
    links = set()
    for i in prints:
        for j in (j for j in prints if j < i):
            votes = defaultdict(int)
            for key in places[i].keys() & places[j].keys():
                for k in {*(p - places[j][key][0] for p in places[i][key]), *(places[i][key][0] - q for q in places[j][key])}:
                    votes[k] += 1
            if votes and not chroma.best_offset(prints[i], prints[j], list(votes.items()))[0]:
                links.add((i, j))
    return links


def linked(classes, links):
    return sum(classes[i] == classes[j] for i, j in links) / max(1, len(links))


def test_alignment_against_brute_force(spark):
    """Recordings of few passages, many of them shared: all links of brute force are found, and no class has another member."""
    rng = np.random.default_rng(11)
    parts = [rng.integers(-(2**31), 2**31, rng.integers(8, 30)).astype(np.int32) for _ in range(25)]
    prints = {}
    for i in range(150):
        fp = np.concatenate([parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 7))])
        if i % 3 == 0 and i:  # a near copy, shifted, with some bits changed
            fp = prints[int(rng.integers(0, i))][int(rng.integers(0, 6)) :].copy()
            fp[rng.integers(0, len(fp), len(fp) // 6)] ^= 1 << 7
        prints[i] = fp
    rows = [(i, 0, fp.tolist()) for i, fp in prints.items()]
    got = {r.id: r.class_id for r in chroma.align(spark.createDataFrame(rows, "id long, n_samples long, fp array<int>")).collect()}
    links = brute_links({i: fp.view(np.uint32) for i, fp in prints.items()})
    assert len(links) > 100 and linked(got, links) >= 0.97
    root = {i: i for i in prints}
    for i, j in links:
        old, new = root[i], root[j]
        root = {k: new if r == old else r for k, r in root.items()}
    assert all(root[i] == root[c] for i, c in got.items())


def hidden_links(rng):
    """Pairs whose only landmark is held by 60 unrelated recordings of smaller ids, too: whatever holder is picked, hardly ever one of a pair."""
    some = lambda n: rng.integers(-(2**31), 2**31, n).astype(np.int32)
    prints = {}
    for group in range(6):
        passage, whole, at = some(4), some(40), 1000 * group
        for i in range(60):
            prints[at + i] = np.r_[some(30), passage, some(30)]
        whole[18:22] = passage
        near = whole.copy()
        near[[*range(0, 18, 3), 17, 22, *range(25, 40, 3)]] ^= 1  # no other run of four is equal
        prints[at + 500], prints[at + 501] = whole, near
    return prints


def test_pairs_that_few_landmarks_join_are_compared(spark, monkeypatch):
    """Each link is found, whether the pairs of a landmark are compared at once or in slices."""
    prints = hidden_links(np.random.default_rng(5))
    links = brute_links({i: fp.view(np.uint32) for i, fp in prints.items()})
    assert links == {(1000 * g + 501, 1000 * g + 500) for g in range(6)}
    df = spark.createDataFrame([(i, 0, fp.tolist()) for i, fp in prints.items()], "id long, n_samples long, fp array<int>").persist()
    for most in (chroma.PAIRS, 3000):
        monkeypatch.setattr(chroma, "PAIRS", most)
        got = {r.id: r for r in chroma.align(df).collect()}
        assert all(got[i].class_id == j and got[i].aligned and got[i].reference_id == j for i, j in links)
        assert sum(r.class_id != r.id for r in got.values()) == len(links)


def test_all_landmarks_of_a_pair_vote(spark):
    """2 and 3 meet first at a passage that lies elsewhere in each, and refuse that offset; the one at which they align has another landmark."""
    rng = np.random.default_rng(8)
    a, b, c, d, e = (rng.integers(-(2**31), 2**31, n).astype(np.int32) for n in (30, 4, 4, 40, 40))
    # b is first in 2, which 3 meets by it; c is first in 1, which both meet by it
    whole = np.r_[d, c, e[:4], b, e[4:20], b ^ 0]
    near = whole.copy()
    near[[*range(0, 40, 3), 39, 44, 47, *range(48, len(whole), 3)]] ^= 1
    near[48:52], near[2:6] = near[48:52] ^ 3, b
    fps = {1: np.r_[a, c, a[::-1]], 2: whole, 3: near}
    links = brute_links({i: fp.view(np.uint32) for i, fp in fps.items()})
    got = {r.id: r for r in chroma.align(spark.createDataFrame([(i, 0, f.tolist()) for i, f in fps.items()], "id long, n_samples long, fp array<int>")).collect()}
    assert links == {(3, 2)} and got[3].class_id == 2 and got[3].offset == 0


@needs_tables
def test_documents_as_recordings(spark):
    """Unrelated documents differ in half of the bits and do not align; recall against all pairs by brute force."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(docs.select(*[(F.col(c) + 1000).alias(c) if c == "doc_id" else F.substring("text", 257, 10**6).alias("text") if c == "text" else F.col(c) for c in docs.columns]))
    prints = chroma.fingerprints(docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("samples")), "doc_id", "samples", chroma.SHORT, "u1")
    got = {r.id: r for r in chroma.align(prints).collect()}
    fps = {r.id: np.array(r.fp, np.int32).view(np.uint32) for r in prints.collect()}
    links = brute_links(fps)
    bytes_of = {r.id: r.digest for r in prints.collect()}
    links |= {(i, j) for i in fps for j in fps if j < i and (bytes_of[i] == bytes_of[j] or (len(fps[i]) and fps[i].tobytes() == fps[j].tobytes()))}
    assert len(links) >= 100 and linked({i: r.class_id for i, r in got.items()}, links) >= 0.95
    rng = random.Random(3)
    fps = {i: fp for i, fp in fps.items() if len(fp) >= chroma.LEAST_OVERLAP}  # a share of the bits of fewer says little
    pairs = [(i, j) for i, j in (rng.sample(sorted(fps), 2) for _ in range(5000)) if (max(i, j), min(i, j)) not in links and got[i].class_id != got[j].class_id]
    errors = []
    for i, j in pairs:
        n = min(len(fps[i]), len(fps[j]))
        errors.append(int(np.bitwise_count(fps[i][:n] ^ fps[j][:n]).sum()) / (32 * n))
    assert np.mean(errors) > 0.45 and np.mean(np.array(errors) <= chroma.MOST_BIT_ERRORS) < 0.01


def test_short_recordings(spark):
    """Copies too short for landmarks or for any print share a class, empty ones too; null ones and other short ones do not."""
    spec, a = chroma.Spec(), tune(5, 30)
    short = lambda frames: pcm(a[: spec.frame + (frames - 1) * spec.hop])
    parts = {n: short(n) for n in (1, 5, spec.window, spec.window + 1, spec.window + 2)}
    rows = [(10 * n + k, x) for n, x in parts.items() for k in range(2)] + [(500, b""), (501, b""), (502, None), (503, None), (504, pcm(a[:50])), (505, pcm(a)), (506, pcm(a))]
    got = {r.id: r for r in chroma.align(chroma.fingerprints(spark.createDataFrame(rows, "id long, samples binary"), "id", "samples", spec)).collect()}
    assert {got[10 * n].n_prints for n in parts} == {0, 1, 2, 3}
    assert all(got[10 * n + 1].class_id == 10 * n and got[10 * n + 1].aligned and got[10 * n].class_id == 10 * n for n in parts)
    assert [got[i].class_id for i in range(500, 507)] == [500, 500, 502, 503, 504, 505, 505]


def test_best_offset_equals_trying_all():
    rng = np.random.default_rng(9)
    for n, m in ((300, 200), (5, 400), (64, 64), (1, 1)):
        whole, ref = (rng.integers(0, 2**32, k, np.uint32) for k in (n, m))
        if n > 200:
            ref[:150] = whole[100:250]
        tried = [(k, int(rng.integers(1, 3))) for k in range(1 - m, n)]
        least, every = max(chroma.LEAST_OVERLAP, chroma.LEAST_SHARE * min(n, m)), []
        for k, votes in tried:
            x, y = whole[max(0, k) :], ref[max(0, -k) :]
            o = min(len(x), len(y))
            errors = int(np.bitwise_count(x[:o] ^ y[:o]).sum()) / (32 * o)
            every.append((not (errors <= chroma.MOST_BIT_ERRORS and o >= least), -votes, k, o, errors))
        assert chroma.best_offset(whole, ref, tried) == min(every)


def test_constant_recordings_take_no_square():
    """20,000 equal integers, and half of them, with a vote for every offset: an instant, not minutes."""
    flat, other = np.full(20_000, 7, np.uint32), np.random.default_rng(1).integers(0, 2**32, 20_000, np.uint32)
    tried = [(k, 1) for k in range(-19_999, 20_000)]
    begin = time.perf_counter()
    assert not chroma.best_offset(flat, flat, tried)[0] and chroma.best_offset(flat, other, tried)[0]
    assert time.perf_counter() - begin < 20


def test_unrelated_tunes_do_not_align():
    spec = chroma.Spec()
    feats = [chroma.chroma(np.frombuffer(pcm(tune(50 + i, 10)), "<i2").astype(np.float32), spec) for i in range(12)]
    levels = np.quantile(np.concatenate([chroma.answers(f, spec) for f in feats], 1), [0.25, 0.5, 0.75], axis=1).T
    fps = [chroma.packed(f, spec, levels) for f in feats]
    for i in range(12):
        for j in range(i):
            assert chroma.best_offset(fps[i], fps[j], [(k, 1) for k in range(-30, 31)])[0]


def test_octaves_share_a_pitch_class():
    spec, t = chroma.Spec(), np.arange(11025) / 11025
    tops = {int(chroma.chroma(np.sin(2 * np.pi * f * t), spec)[2].argmax()) for f in (220.0, 440.0, 880.0)}
    assert tops == {0}


def test_long_text_is_whole():
    assert token_counts.counter().count_texts([LONG])[0] == len(token_counts.counter().library.encode(LONG, add_special_tokens=False).ids)
