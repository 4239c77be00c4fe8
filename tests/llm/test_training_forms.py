"""Fill-in-the-middle, conversation repair and model scores against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SMALL, awkward, collected, empty, needs_tables
from tradelake.llm import context_mixing as cm
from tradelake.llm import conversation, fill_middle, lm_score, queries

# fill-in-the-middle


def plain_cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_cut(spark):
    rng = random.Random(5)
    pool = ["\x01", "\x02", "\x021", "\x022", "1", "2", "a", "Zz", "é", "\U0001f600", " ", "\n", "\r", "\\", "$1", "$", "<", "<P", "S>", ">", "<P>", "\x00", " ", "word"]
    texts = ["".join(rng.choices(pool, weights=[3] * (len(pool) - 4) + [0.05] + [3] * 3, k=rng.randrange(30))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fill_middle.fill_in_middle(docs)
    assert collected(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted((plain_cut(*r) for r in enumerate(texts)), key=repr)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    again = made.select("doc_id", fill_middle.restored(made.output, made.form).alias("text"))
    assert collected(again, "doc_id", "text") == collected(docs, "doc_id", "text")


def test_fill_in_middle_awkward(spark):
    docs = awkward(spark, [(11, "a " * 200_000, "en", "a"), (12, "n <M> output", "en", "a")])
    made = fill_middle.fill_in_middle(docs.withColumn("form", docs.text).withColumn("_marked", docs.text))
    assert collected(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted((plain_cut(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert set(docs.columns) <= set(made.columns)
    assert fill_middle.fill_in_middle(empty(spark)).count() == 0


def test_fill_in_middle_moves_no_rows(spark):
    plan = fill_middle.fill_in_middle(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# conversation repair

SPACES = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def plain_faults(rows):
    """rows (turn, role, text) in order -> a fault each."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """The least (cost, audit) over all edits, by trying each; the repaired turns with it."""

    def step(roles, new):
        """The shortest roles in the same grammar state."""
        nexts = {"": "su", "s": "u", "u": "a", "ua": "u"}
        if not new or new not in nexts[roles]:
            return None
        return {"s": "s", "u": "u", "a": "ua"}[new]

    # more than a few inserts in a row are of no use
    def search(i, state, inserts):
        key = (i, state, inserts)
        if key in memo:
            return memo[key]
        found = []
        if i == len(rows):
            if state in ("", "ua"):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            c, a, t = search(i + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                for edit, to, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    new = step(state, to[:1])
                    if new is not None:
                        c, a, t = search(i + 1, new, 0)
                        found.append((c + cost + extra, edit + a, ((to, text), *t)))
        if inserts < 4:
            for to in ("user", "assistant"):
                new = step(state, to[0])
                if new is not None:
                    c, a, t = search(i, new, inserts + 1)
                    found.append((c + 3, "I" + a, ((to, ""), *t)))
        memo[key] = min(found, default=(1 << 40, "", ()))
        return memo[key]

    memo = {}
    return search(0, "", 0)


def plain_summary(rows):
    out = []
    kept = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in kept if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults = plain_faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, repaired = plain_repair(mine, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=repr)


SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Well.", "So", "Yes!", "Hm? ", "", " \t", "\u00a0", "end.\n", "a:b\nc.", None, ". "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys", "\U0001f600"]
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randint(1, longest)):
            turn = rng.choice([None, *range(-1, longest)])
            rows.append((conv, turn, rng.choice(roles[: rng.choice([3, 5, len(roles)])]), rng.choice(texts[: rng.choice([3, len(texts)])]) if rng.random() < 0.6 else f"{rng.random()}."))
    return rows


@pytest.mark.parametrize(("size", "n", "longest"), [(4096, 150, 9), (3, 60, 14), (1, 30, 6)])
def test_repair_equals_plain_repair(spark, size, n, longest):
    rows = conversations(size, n, longest)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit("x"), "cost": F.lit(1), "_c": F.lit(2), "kind": F.lit(3)})
    got = conversation.summary(turns, conversation.damaged(turns), size)
    assert collected(got, *SUMMARY) == plain_summary(rows)


def test_repaired_turns(spark):
    rows = conversations(7, 40, 12)
    turns = conversation.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    segments = conversation.repair(turns, 2).persist()
    made = conversation.repaired_turns(turns, segments).collect()
    digests = {r.conv_id: r.repaired_sha256 for r in conversation.repaired_digests(turns, segments).collect()}
    for conv, want in digests.items():
        mine = sorted((r for r in made if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert GRAMMAR.fullmatch("".join(r.role[0] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == want


def test_long_and_empty_conversations(spark):
    """A third of all turns in one conversation, over many segments, gives what one segment gives; a long text; no rows."""
    rows = [(1, i, ("user", "assistant", "user")[i % 3], f"turn {i}." if i % 7 else "same") for i in range(3000)] + [(2, 0, "user", "word " * 50_000), (2, 1, "assistant", "."), *((c, 0, "user", "Hi.") for c in range(3, 60))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert collected(conversation.summary(turns, turns, 64), *SUMMARY) == collected(conversation.summary(turns, turns), *SUMMARY)
    assert conversation.summary(turns.limit(0), turns.limit(0)).count() == 0
    gone = conversation.summary(turns, turns.limit(0)).where("conv_id = 5").first()
    assert (gone.gaps, gone.cost, gone.audit, gone.repaired_sha256) == (0, 0, "", hashlib.sha256().hexdigest())


@needs_tables
def test_repair_query_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.op11_conversation_repair(spark, SMALL), *SUMMARY) == plain_summary(rows)


# scores of the language model


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    words = [[*plain_words(t), None] for _, t in rows]  # None: the end
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n = sum(counts.values())
    base = [sum(math.log10((counts[w] + 1) / (n + len(counts) + 1)) for w in ws) for ws in words]
    return [(i, h, len(ws), sum(counts[w] > 0 for w in ws), n, b) for (i, _), h, ws, b in zip(rows, held, words, base, strict=True)]


def held_to_base(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm_score.lm_scores(docs).collect()), key=repr)
    want = sorted(plain_base(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    return got


def prose(seed, n, longest=60):
    """Texts of words that are made of few syllables, a third of them of one first word."""
    rng = random.Random(seed)
    parts = ["the", "an", "ing", "\u00e9l", "or", "sta", "tion", "qu"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(80)]
    texts = [" ".join(rng.choices(words, weights=[1 / (1 + i) for i in range(80)], k=rng.randint(0, longest))) for _ in range(n)]
    return [t.replace(" ", rng.choice([" ", "\n", " \t "])) for t in texts]


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_WORDS", 30)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 2000)
    docs = spark.createDataFrame(list(enumerate(prose(1, 200))), "doc_id long, text string").repartition(3)
    held_to_base(spark, docs)


def test_scores_of_awkward_texts(spark):
    docs = awkward(spark, [(13, "x" * 30_000, "en", "a"), (14, "\x00 \x01 \u00a0 A\u0130", "en", "a"), *((i, "", None, None) for i in range(20, 40))])
    rows = held_to_base(spark, docs)
    assert {True, False} == {r[1] for r in rows}
    assert lm_score.lm_scores(empty(spark)).count() == 0
    only_held = spark.createDataFrame([(i, "some text") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r.base_score == 0 and r.n_known == 0 and r.score < 0 for r in lm_score.lm_scores(only_held).collect())


def test_held_out_texts_teach_nothing(spark):
    """Other held-out texts, in number and length, and other partitions leave all other scores as they are; copies score the same."""
    texts = list(enumerate(prose(2, 150)))
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    other = [(i, "the other " * 300 if i in held else t) for i, t in texts if i % 2 or i not in held] + [(1000, texts[5][1])] * (5 in held)

    def scores(rows, n):
        return {r.doc_id: r.score for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()}

    a, b = scores(texts, 2), scores(other, 5)
    same = [i for i, _ in other if i in a and i not in held]
    assert len(same) > 100 and [a[i] for i in same] == pytest.approx([b[i] for i in same])


def test_model_learns(spark):
    """Held-out prose of the corpus costs less than by word frequencies where contexts tell the words, and nonsense costs more a byte."""
    texts = [" ".join(f"{a}{b}" for a, b in zip(["alpha", "beta", "gamma"] * 10, [f"{x:03d}" for x in np.random.default_rng(i).integers(0, 1000, 30)], strict=True)) for i in range(400)]
    noise = "".join(random.Random(1).choices("qxzjkw", k=200))
    fake = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm_score.lm_scores(spark.createDataFrame([*enumerate(texts), (fake, noise)], "doc_id long, text string")).collect()
    clean = [r for r in got if r.held_out and r.doc_id != fake]
    assert sum(r.bits for r in clean) / 30 / len(clean) < 16  # 3 digits are 10 bits
    assert next(r for r in got if r.doc_id == fake).bits_per_byte > 3 * max(r.bits_per_byte for r in clean)
    assert all(r.score == pytest.approx(-r.bits * math.log10(2)) for r in got)


def plain_slopes(x, n, gates, weights):
    """Mean cost in the layout of Mixer.slopes(), of bits told by x, n times each."""
    out = np.zeros((cm.GATES, 2 + cm.PREDICTORS + cm.PREDICTORS**2))
    for bit, times, gate in zip(x, n, gates, strict=True):
        miss = 1 / (1 + math.exp(weights[gate] @ bit))
        out[gate] += times * np.concatenate([[1, -math.log(1 - miss)], -miss * bit, (miss * (1 - miss) * np.outer(bit, bit)).ravel()])
    return out


def test_first_weights_come_from_all_training_words(spark, monkeypatch):
    """No change of them makes bits of all training words cheaper (but for what pulls them back), in many more texts than 2,048."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    monkeypatch.setattr(lm_score, "BUCKET_WORDS", 30)
    monkeypatch.setattr(lm_score, "TASK_WORDS", 100)
    texts = [*enumerate(prose(5, 400)), *((i, "quality quantity") for i in range(400, 6000))]
    lm_score.lm_scores(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    mixer, tops = sent[-1].mixer, sent[-1].tops
    counts = Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words = plain_words(t) or [""]
            top = min(Counter(words).items(), key=lambda x: (-x[1], x[0].encode()))[0]
            counts.update((w, k == len(words) - 1, tops.index(top) if top in tops else lm_score.CLASSES - 1) for k, w in enumerate(words))
    words, last, classes = (list(x) for x in zip(*counts, strict=True))
    made = cm.bits_of(pa.array(words), np.array(last, np.int64), np.array(classes), mixer.code, mixer.size)
    x = np.array([mixer.tables[k][made.slots(k)] for k in range(cm.PREDICTORS)], float).T * np.where(made.value, 1, -1)[:, None] / cm.SCALE
    gates = [int((x[i] != 0).sum()) for lo, hi in zip(made.begin, made.begin[1:], strict=False) for i in lo + np.arange(hi - lo) // cm.GROUP * cm.GROUP]
    n = np.repeat(list(counts.values()), np.diff(made.begin))
    for weights, close in ((mixer.weights, True), (cm.Mixer.first_weights(), False)):
        slopes = plain_slopes(x, n, gates, weights.astype(float))
        left = slopes[:, 2 : 2 + cm.PREDICTORS] / n.sum() + (weights - cm.FIRST_WEIGHT) / (cm.STEP * cm.SEGMENT_BITS)
        assert (np.abs(left).max() < 1e-4) == close
    got = mixer.slopes(pa.array(words), np.array(last, np.int64), np.array(classes), np.array(list(counts.values())))
    assert got == pytest.approx(plain_slopes(x, n, gates, mixer.weights.astype(float)), rel=1e-4, abs=1e-2)


def test_fit_of_weights_that_tell_the_wrong_bit():
    """Newton's first step is far too long here."""
    x, gates = np.array([[-8.0, 0, 0, 0, 0], [-7.0, -9.0, 1, 1, 1]]), [1, 5]
    weights = cm.fitted(lambda w: plain_slopes(x, [1, 3], gates, w))
    left = plain_slopes(x, [1, 3], gates, weights.astype(float))[:, 2 : 2 + cm.PREDICTORS] / 4 + cm.PULL * (weights - cm.FIRST_WEIGHT)
    assert np.abs(left).max() < 1e-3
    assert (cm.fitted(lambda _: np.zeros(cm.SLOPES)) == cm.FIRST_WEIGHT).all()


def test_byte_code_is_complete():
    for counts in ([0] * 256, [2**i if i < 40 else 0 for i in range(256)], list(range(256))):
        code = cm.ByteCode.of(counts)
        assert sum(2.0**-n for n in code.length.tolist()) == 1
        assert len({tuple(code.bit[b, : code.length[b]]) for b in range(256)}) == 256


def small_mixer():
    rng = np.random.default_rng(3)
    tables = [(rng.normal(0, 24, 1 << 12) * (rng.random(1 << 12) < 0.6)).astype(np.int8) for _ in range(cm.PREDICTORS)]
    return cm.Mixer(cm.ByteCode.of([1, *[5] * 20, *range(235)]), 12, tables, rng.normal(0.3, 0.1, (cm.GATES, cm.PREDICTORS)).astype(np.float32))


def plain_costs(mixer, made, which):
    """The bits of some words in a row, one after the other: each is told with the weights of its group of bits."""
    value = [int(made.value[b]) for w in which for b in range(made.begin[w], made.begin[w + 1])]
    slots = [made.slots(k) for k in range(cm.PREDICTORS)]
    known = [[int(mixer.tables[k][slots[k][b]]) for k in range(cm.PREDICTORS)] for w in which for b in range(made.begin[w], made.begin[w + 1])]
    total = 0.0
    for low in range(0, len(value), cm.SEGMENT_BITS):
        weights, cells = mixer.weights.copy(), {}
        for i in range(low, min(low + cm.SEGMENT_BITS, len(value)), cm.GROUP):
            gate = sum(x != 0 for x in known[i])
            step, learned = np.zeros(cm.PREDICTORS), {}
            for bit in range(i, min(i + cm.GROUP, low + cm.SEGMENT_BITS, len(value))):
                x, y = np.array(known[bit]) / cm.SCALE, value[bit]
                z = float(np.clip(weights[gate] @ x, -cm.MOST, cm.MOST))
                p = 1 / (1 + math.exp(-z))
                step += (y - p) * x * cm.STEP
                cell = (gate, int(abs(z) * 2 + 0.5))
                sure = cells.get(cell, 1 / (1 + math.exp(-cell[1] / 2)))
                hit = (z > 0) == (y == 1) and z != 0
                learned[cell] = sure + (hit - sure) * cm.RATE
                total -= math.log2(((p if y else 1 - p) + (sure if hit else 1 - sure)) / 2)
            weights[gate] += step
            cells |= learned
    return total


def test_lanes_equal_plain_steps():
    """Many pieces in step give what each gives by itself, one bit after the other."""
    mixer, rng = small_mixer(), random.Random(4)
    words = pa.array(["the", "a", "", "\u00e9t\u00e9", "longer" * 5, "x"])
    last, classes = np.array([0, 0, 1, 1, 0, 0]), np.array([0, 3, 1, 15, 2, 0])
    which = np.array([rng.randrange(6) for _ in range(700)])
    begin = np.array([0, 5, 6, 130, 131, 250, 700])
    cost, _ = mixer.costs(words, last, classes, which, begin)
    made = cm.bits_of(words, last, classes, mixer.code, mixer.size)
    want = [plain_costs(mixer, made, which[lo:hi]) for lo, hi in zip(begin, begin[1:], strict=False)]
    assert want[-1] > cm.SEGMENT_BITS and cost == pytest.approx(want, rel=1e-2)  # a rounded cell may differ


def test_probabilities_of_all_texts_of_two_bytes_are_at_most_one():
    mixer = small_mixer()
    words = pa.array([chr(i) for i in range(1, 128)] * 2)
    last = np.repeat([0, 1], 127)
    cost, _ = mixer.costs(words, last, np.zeros(254, np.int64), np.arange(254), np.arange(255))
    assert 0 < (2.0**-cost).sum() <= 1


def some_chunk(rng):
    """Texts of few words that begin alike, of several classes, as lm_score holds them."""
    words = pa.array(sorted(["", *{"inter" + "".join(rng.choices("aeiou", k=k % 4)) + "x" * (k % 3) for k in range(60)}]))
    n = np.array([rng.choice([1, 3, 40, 500]) for _ in range(60)])
    begin = np.concatenate([[0], np.cumsum(n)])
    refs, classes = np.array(rng.choices(range(len(words)), k=n.sum())), np.array(rng.choices(range(3), k=60))
    last = np.zeros(n.sum(), np.int64)
    last[begin[1:] - 1] = 1
    return lm_score.Chunk(None, words, refs, begin, np.zeros(60, bool), classes, (np.repeat(classes, n) * len(words) + refs) * 2 + last)


def test_tables_are_asked_once_for_words_of_a_chunk(monkeypatch):
    """However many blocks have a word, and words begin alike; less kept at once gives the same scores."""
    asked, ask, mixer = [], cm.Mixer._known, small_mixer()
    monkeypatch.setattr(cm.Mixer, "_known", lambda self, made: asked.append(len(made.value)) or ask(self, made))
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", 100)
    chunk = some_chunk(random.Random(6))
    model = lm_score.Model([], [4.0] * lm_score.CLASSES, mixer, 60, len(chunk.refs), len(chunk.words))
    got = lm_score._scores(model, chunk, np.ones(len(chunk.words), np.int64))
    words, last, classes = chunk.parts(np.unique(chunk.key))
    spelt = [(c, w.encode() + b" \n"[e : e + 1]) for w, e, c in zip(words.to_pylist(), last, classes, strict=True)]
    assert sum(asked) <= sum(int(mixer.code.length[x[-1]]) for _, x in {(c, w[: i + 1]) for c, w in spelt for i in range(len(w))})
    monkeypatch.setattr(lm_score, "KEPT_BYTES", 0)
    again = lm_score._scores(model, chunk, np.ones(len(chunk.words), np.int64))
    assert all((a == b).all() for a, b in zip(got, again, strict=True)) and len(asked) > 10
    made, (rows, begin) = cm.bits_of(words, last, classes, mixer.code, mixer.size), mixer.told(words, last, classes)
    monkeypatch.setattr(cm, "TOLD_AT_ONCE", 7)
    assert (rows[: -cm.GROUP] == ask(mixer, made).view(np.int64)[:, 0]).all() and (begin == made.begin).all() and (rows == mixer.told(words, last, classes)[0]).all()
    monkeypatch.setattr(cm.pd, "factorize", lambda x: (np.zeros(len(x), np.int64), x[:1]))  # all hashes alike
    assert (rows == mixer.told(words, last, classes)[0]).all()


def test_words_of_texts():
    texts = ["A b", "", " \t", "x\x0b\x0cY\r\n\u00a0 ", "\u00c9\x1f", "", "z"]
    got = lm_score.normal_words(pa.array(["left out", *texts]).slice(1))
    assert got.to_pylist() == [plain_words(t) or [""] for t in texts]
    assert lm_score.normal_words(pa.array(["", ""])).to_pylist() == [[""], [""]] and lm_score.normal_words(pa.array([], pa.string())).to_pylist() == []
