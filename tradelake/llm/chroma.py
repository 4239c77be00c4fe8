"""Chroma fingerprints of audio columns, and alignment of recordings by them.

A recording's samples are cut into overlapping frames whose spectrum is folded into twelve pitch classes. Over the integral
image of these frames, rectangular filters compare sums of neighbouring areas; each filter's answer is cut into four levels,
two Gray-coded bits, and sixteen filters make a packed 32-bit integer for each step. The bounds between a filter's levels are the
quartiles of its answers over all recordings, so that unrelated recordings differ in about half of the bits.

Runs of consecutive integers are landmarks. Recordings with equal fingerprints are folded into the one of the smallest id. Each
holder of a landmark votes, for each place of it, for an offset against another one; the bit errors over the aligned overlap
confirm or refuse each offset that got a vote. In rounds, each landmark has one holder that all others of it are compared with: the one of the
smallest id in the first round, which joins most copies, then one by a hash of landmark and id, so the cost of a round is linear in the
landmarks, however many recordings hold one. Further rounds are for landmarks whose holders are not in one class, while these have many pairs. Then
all pairs that share a landmark and are not in one class are compared, by all landmarks that they share, some at a time: so recordings have one
class if and only if links between pairs connect them. That last step is the square of a landmark's holders where these do not align.

Samples are read twice, for the bounds and for the fingerprints, which go to the shared folder: answers kept in between would take more disk. Landmarks that one recording holds alone are dropped
after a count of keys; the others are joined as written tables, which lets AQE split a landmark that is everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.functions.tables import delete_table, write_table
from tradelake.llm.common import map_texts, marked, materialize, scratch, small_batches
from tradelake.llm.components import connected_components

CLASSES = 12
#: Integers in a landmark, for each round by one holder that there may be.
LANDMARKS = (4, 4, 4, 4)
#: Pairs of landmarks' holders that are compared at once after the rounds; as many as there are landmarks, if these are more.
PAIRS = 1 << 22
#: Unrelated recordings differ in 0.3 to 0.5 of the bits, copies in noise in less than 0.15 (README).
MOST_BIT_ERRORS = 0.2
#: An overlap has so many integers at least, and this share of the shorter recording's.
LEAST_OVERLAP = 4
LEAST_SHARE = 0.5
#: Frames worked on at once.
AT_ONCE = 1 << 12
#: The sixteen filters: kind, first pitch class, pitch classes, share of the window; see _areas(). A rule, not trained values.
FILTERS = tuple((kind, low, high, part) for kind in range(4) for low, high, part in ((0, 12, 1), (0, 6, 1), (6, 6, 1), (3, 6, 2)))
#: Answers are counted in steps of 1 / STEPS, between -RANGE and RANGE, which holds all that the 1e-6 in answers() allows for windows
#: of up to 485 frames; beyond, the outermost steps hold the rest.
STEPS, RANGE = 256, 20


@dataclass(frozen=True)
class Spec:
    """Sample rate in Hz, samples in a frame and between frames, frames in a filter's window, pitches that count (Hz)."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    window: int = 16
    lowest: float = 28.0
    highest: float = 3520.0

    @cached_property
    def fold(self) -> np.ndarray:
        """(bins, CLASSES): each bin's energy goes to the pitch class of its frequency, counted from A."""
        hertz = np.fft.rfftfreq(self.frame, 1 / self.rate)
        out = np.zeros((len(hertz), CLASSES), np.float32)
        for i in np.flatnonzero((hertz >= self.lowest) & (hertz <= self.highest)):
            out[i, round(CLASSES * np.log2(hertz[i] / 440.0)) % CLASSES] = 1
        return out


#: For short recordings, such as the bytes of a text played as 8-bit samples.
SHORT = Spec(rate=8000, frame=256, hop=64, window=8, lowest=60.0, highest=3900.0)


def chroma(samples: np.ndarray, spec: Spec) -> np.ndarray:
    """(frames, CLASSES) shares of the energy; the last frame is filled up with silence, so all samples count."""
    if not len(samples):
        return np.zeros((0, CLASSES), np.float32)
    n = 1 + max(0, -(-(len(samples) - spec.frame) // spec.hop))
    padded = np.zeros((n - 1) * spec.hop + spec.frame, np.float32)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, spec.frame)[:: spec.hop]
    taper = np.hanning(spec.frame).astype(np.float32)
    out = np.empty((n, CLASSES), np.float32)
    for i in range(0, n, AT_ONCE):
        spectrum = np.fft.rfft(frames[i : i + AT_ONCE] * taper)
        out[i : i + AT_ONCE] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ spec.fold
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=np.full_like(out, 1 / CLASSES), where=total > 1e-9)


def answers(features: np.ndarray, spec: Spec) -> np.ndarray:
    """(filters, windows): the log ratio of each filter's two areas; no windows if there are fewer frames than one has."""
    n, w = len(features) - spec.window + 1, spec.window
    if n < 1:
        return np.zeros((len(FILTERS), 0))
    image = np.zeros((len(features) + 1, CLASSES + 1))
    image[1:, 1:] = features.astype(np.float64).cumsum(0).cumsum(1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        """Sums over frames t0 to t1 of each window and classes c0 to c1."""
        return image[t1 : t1 + n, c1] - image[t0 : t0 + n, c1] - image[t1 : t1 + n, c0] + image[t0 : t0 + n, c0]

    out = np.empty((len(FILTERS), n))
    for i, (kind, low, high, part) in enumerate(FILTERS):
        t0, t1 = (w - w // part) // 2, (w + w // part) // 2
        tm, cm, c0, c1 = (t0 + t1) // 2, low + high // 2, low, low + high
        if kind == 0:  # earlier against later
            a, b = area(t0, tm, c0, c1 if high < CLASSES else cm), area(tm, t1, c0, c1 if high < CLASSES else cm)
        elif kind == 1:  # lower against higher
            a, b = area(t0, t1, c0, cm), area(t0, t1, cm, c1)
        elif kind == 2:  # opposite quarters
            a, b = area(t0, tm, c0, cm) + area(tm, t1, cm, c1), area(t0, tm, cm, c1) + area(tm, t1, c0, cm)
        else:  # the middle third of the classes against the rest
            third = max(1, high // 3)
            a = area(t0, t1, c0 + third, c0 + 2 * third)
            b = area(t0, t1, c0, c1) - a
        out[i] = np.log((1e-6 + np.maximum(a, 0)) / (1e-6 + np.maximum(b, 0)))
    return out


def packed(features: np.ndarray, spec: Spec, levels: np.ndarray) -> np.ndarray:
    """uint32 per window of frames: for each filter the Gray-coded level of its answer between the three bounds in levels."""
    found = answers(features, spec)
    out = np.zeros(found.shape[1], np.uint32)
    for answer, bounds in zip(found, levels, strict=True):
        level = np.digitize(answer, bounds).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def _samples(raw: bytes | None, kind: np.dtype) -> np.ndarray:
    """Samples as floats; unsigned ones are centred, bytes at the end that make no whole sample are left out."""
    raw = raw or b""
    middle = float(1 << (8 * kind.itemsize - 1)) if kind.kind == "u" else 0.0
    return np.frombuffer(raw, kind, len(raw) // kind.itemsize).astype(np.float32) - middle


def fit_levels(recordings: DataFrame, id_col: str, samples_col: str, spec: Spec = Spec(), dtype: str = "<i2") -> np.ndarray:
    """(filters, 3): the quartiles of each filter's answers over all recordings, repeated ids and null ones included.

    Answers are counted by Spark; the counts of at most 16 x 2 x RANGE x STEPS steps reach the driver. Recordings without
    a window do not count; without any, the quartiles are those of even answers around zero.
    """
    kind, bins = np.dtype(dtype), 2 * RANGE * STEPS
    samples = recordings.select(F.col(samples_col).alias("samples")).where("samples IS NOT NULL")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(FILTERS) * bins, np.int64)
        for batch in small_batches(batches, 0):
            held = []
            for x in batch.column(0):
                found = answers(chroma(_samples(x.as_py(), kind), spec), spec)
                place = np.clip(np.floor(found * STEPS).astype(np.int64) + RANGE * STEPS, 0, bins - 1) + np.arange(len(FILTERS))[:, None] * bins
                held.append(place.ravel())
            # together, as a count of all steps costs more than that of a short recording
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        where = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(counts[where])], ["cell", "n"])

    table = map_texts(samples, each, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(FILTERS) * bins)
    counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    counts = counts.reshape(len(FILTERS), bins)
    counts[counts.sum(1) == 0] = 1
    share = counts.cumsum(1) / counts.sum(1, keepdims=True)
    # a quartile lies at the upper end of its step
    return np.array([[(np.searchsorted(row, q) + 1) / STEPS - RANGE for q in (0.25, 0.5, 0.75)] for row in share])


def fingerprints(recordings: DataFrame, id_col: str, samples_col: str, spec: Spec = Spec(), dtype: str = "<i2", levels: np.ndarray | None = None) -> DataFrame:
    """(id, n_samples, fp array<int>, digest) per row; digest is that of the bytes, null for null; samples_col is binary, raw mono samples of the given numpy type.

    levels are those of fit_levels(), which is applied to the recordings where none are given; fingerprints can be compared
    if they have the same. Unsigned samples are centred. Null and empty recordings, and those shorter than a window, have no
    fingerprint; bytes at the end that make no whole sample are left out. Rows that repeat an id are each returned; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    rows = recordings.select(F.col(id_col).cast("long").alias("id"), F.col(samples_col).alias("samples"))
    kind, bounds = np.dtype(dtype), fit_levels(recordings, id_col, samples_col, spec, dtype) if levels is None else levels

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            sizes, prints, digests = [], [], []
            for x in batch.column(1):
                raw = x.as_py()
                digests.append(None if raw is None else hashlib.sha256(raw).digest())
                samples = _samples(raw, kind)
                sizes.append(len(samples))
                prints.append(packed(chroma(samples, spec), spec, bounds).view(np.int32))
            offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in prints])].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*prints, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists, pa.array(digests, pa.binary())], ["id", "n_samples", "fp", "digest"])

    return map_texts(rows, each, "id long, n_samples long, fp array<int>, digest binary")


def landmarks(prints: DataFrame, length: int) -> DataFrame:
    """prints (id, fp) -> (key, id, pos, more, n): each different run of so many integers, its first place and the later ones, and the integers of fp."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            ids, keys, owner, place, sizes, later, ends = batch.column(0).to_numpy(zero_copy_only=False), [], [], [], [], [], [0]
            for i in range(len(batch)):
                fp = values[offsets[i] : offsets[i + 1]].view(np.uint32)
                n = len(fp) - length + 1
                if n < 1:
                    continue
                key = np.zeros(n, np.uint64)
                for k in range(length):
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + fp[k : k + n]
                key ^= key >> np.uint64(32)
                order = np.argsort(key, kind="stable")
                first = np.r_[True, key[order][1:] != key[order][:-1]]
                keys.append(key[order][first].view(np.int64))
                owner.append(np.full(int(first.sum()), ids[i]))
                place.append(order[first])
                sizes.append(np.full(int(first.sum()), len(fp)))
                later.append(order[~first])
                ends.extend(ends[-1] + np.cumsum(np.diff(np.r_[np.flatnonzero(first), n]) - 1))
            none = np.zeros(0, np.int64)
            columns = [pa.array(np.concatenate([*x, none]), pa.int64()) for x in (keys, owner, place)]
            more = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*later, none]), pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, more, pa.array(np.concatenate([*sizes, none]), pa.int32())], ["key", "id", "pos", "more", "n"])

    return prints.select("id", "fp").mapInArrow(each, "key long, id long, pos long, more array<long>, n int")


def _shared_landmarks(prints: DataFrame, length: int) -> DataFrame:
    """landmarks() that several recordings hold. Most are held by one, so keys alone are counted first, and only rows that a
    bitmap of the shared keys lets through are shuffled whole; finding landmarks twice costs less than writing them."""
    keys = materialize(landmarks(prints, length).select("key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    return marked(landmarks(prints, length), "key", keys, "_open").where("_open").drop("_open").join(keys, "key", "left_semi")


def _compared(shared: DataFrame, one: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """shared (id, pos, more, n, ref, ref_pos, ref_more, ref_n), a row for each landmark of a pair -> (id, ref, offset, votes, overlap,
    bit_errors, aligned) for each pair, at its best offset, and (id, ref, tried), the offsets and votes that are tried.

    Each place of a landmark in one recording votes with its first place in the other. All offsets with a vote are tried;
    an aligned one is better, then more votes, then the smaller offset. Pairs of which all offsets are in before (id, ref, tried) are
    left out. The shorter fingerprint of a pair is brought to the longer one.
    """
    first = F.array(F.col("pos") - F.col("ref_pos"))
    offsets = F.concat(first, F.transform("more", lambda p: p - F.col("ref_pos")), F.transform("ref_more", lambda p: F.col("pos") - p))
    shorter = (F.col("n") < F.col("ref_n")).alias("shorter")
    votes = shared.select("id", "ref", shorter, F.explode(offsets).alias("offset")).groupBy("id", "ref", "shorter", "offset").agg(F.count("*").alias("votes"))
    tried = votes.groupBy("id", "ref", "shorter").agg(F.collect_list(F.struct("offset", "votes")).alias("tried"))
    if before is not None:
        old = before.select("id", "ref", F.col("tried.offset").alias("old"))
        new = F.col("old").isNull() | (F.size(F.array_except(F.col("tried.offset"), F.col("old"))) > 0)
        tried = tried.join(old, ["id", "ref"], "left").where(new).drop("old")
    tried = materialize(tried)
    short, long = (F.when(F.col("shorter") == here, F.col("id")).otherwise(F.col("ref")) for here in (True, False))
    sides = [one.select(F.col("id").alias(f"{side}_id"), F.col("fp").alias(f"{side}_fp")) for side in ("short", "long")]
    pairs = tried.withColumns({"short_id": short, "long_id": long}).join(sides[0], "short_id").join(sides[1], "long_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shorter, tried, *prints in zip(batch.column("shorter").to_pylist(), batch.column("tried").to_pylist(), batch.column("short_fp"), batch.column("long_fp"), strict=True):
                whole, ref = (v.values.to_numpy().view(np.uint32) for v in (prints if shorter else prints[::-1]))
                rows.append(best_offset(whole, ref, [(t["offset"], t["votes"]) for t in tried]))
            columns = [pa.array([f(r) for r in rows], t) for f, t in ((lambda r: r[2], pa.int64()), (lambda r: -r[1], pa.int64()), (lambda r: r[3], pa.int64()), (lambda r: r[4], pa.float64()), (lambda r: not r[0], pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ref"), *columns], ["id", "ref", "offset", "votes", "overlap", "bit_errors", "aligned"])

    found = materialize(map_texts(pairs.select("id", "ref", "shorter", "tried", "short_fp", "long_fp"), compare, "id long, ref long, offset long, votes long, overlap long, bit_errors double, aligned boolean"))
    return found, tried.select("id", "ref", "tried")


#: Offsets of a pair that are compared one by one; beyond, the bit errors of all of them come from one correlation.
ONE_BY_ONE = 64


def best_offset(whole: np.ndarray, ref: np.ndarray, tried: list[tuple[int, int]]) -> tuple[bool, int, int, int, float]:
    """The best of (offset, votes): not aligned, -votes, offset, overlap, bit errors as a share.

    An aligned offset comes before others, then more votes, then the smaller offset; so they are tried in that order and the first
    aligned one is the best. Offsets whose overlap is too short cannot align.
    """
    least = max(LEAST_OVERLAP, LEAST_SHARE * min(len(whole), len(ref)))
    order = sorted((-votes, k) for k, votes in tried)

    def overlap(k: int) -> int:
        return max(0, min(len(whole) - max(0, k), len(ref) - max(0, -k)))

    def errors(k: int) -> int:
        n = overlap(k)
        return int(np.bitwise_count(whole[max(0, k) :][:n] ^ ref[max(0, -k) :][:n]).sum(dtype=np.int64))

    hopeful = [(votes, k) for votes, k in order if overlap(k) >= least]
    differing = errors
    for i, (votes, k) in enumerate(hopeful):
        if i == ONE_BY_ONE:
            every = _all_errors(whole, ref)
            differing = lambda k: every[k + len(ref) - 1]
        n, wrong = overlap(k), int(differing(k))
        if wrong <= MOST_BIT_ERRORS * 32 * n:
            return False, votes, k, n, wrong / (32 * n)
    votes, k = order[0]
    n = overlap(k)
    return True, votes, k, n, errors(k) / (32 * n) if n else 1.0


def _all_errors(whole: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Differing bits of the overlap at each offset from 1 - len(ref) to len(whole) - 1, by correlating bits as signs."""
    size = 1 << (len(whole) + len(ref) - 1).bit_length()
    total = np.zeros(size // 2 + 1, np.complex128)
    for bit in range(32):
        a, b = (1.0 - 2.0 * ((x >> np.uint32(bit)) & np.uint32(1)) for x in (whole, ref))
        total += np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size))
    agree = np.rint(np.roll(np.fft.irfft(total, size), len(ref) - 1)[: len(whole) + len(ref) - 1]).astype(np.int64)
    k = np.arange(1 - len(ref), len(whole))
    n = np.minimum(len(whole) - np.maximum(0, k), len(ref) - np.maximum(0, -k))
    return (32 * n - agree) // 2


def _classes(links: DataFrame) -> DataFrame:
    """links (id, ref) -> (id, class_id), the smallest id that links reach, for each id with one."""
    roots = connected_components(links.select(F.col("id").alias("a"), F.col("ref").alias("b")))
    return materialize(roots.join(materialize(roots.groupBy("root").agg(F.min("node").alias("class_id"))), "root").select(F.col("node").alias("id"), "class_id"))


def _with_class(marks: DataFrame, known: DataFrame | None) -> DataFrame:
    found = marks.join(known, "id", "left") if known is not None else marks.withColumn("class_id", F.col("id"))
    return found.withColumn("class_id", F.coalesce("class_id", "id"))


def _split(marks: DataFrame, known: DataFrame | None) -> tuple[DataFrame, int]:
    """The landmarks whose holders are not in one class, and how many pairs of holders from different classes they have."""
    of_class = _with_class(marks, known).groupBy("key", "class_id").agg(F.count("*").cast("double").alias("n"))
    pairs = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
    keys = materialize(of_class.groupBy("key").agg(pairs.alias("pairs"), F.count("*").alias("classes")).where("classes > 1").select("key", "pairs"))
    return materialize(marks.join(keys.select("key"), "key", "left_semi")), int(keys.agg(F.sum("pairs")).first()[0] or 0)


def _best(compared: DataFrame) -> DataFrame:
    """The best comparison of each recording: an aligned one before others, then that with the most votes, then the smaller reference."""
    order = F.struct("aligned", "votes", (-F.col("ref")).alias("r"), (-F.col("offset")).alias("o"))
    return compared.groupBy("id").agg(F.max_by(F.struct("ref", "offset", "votes", "overlap", "bit_errors", "aligned"), order).alias("b")).select("id", "b.*")


def _rounds(open_: DataFrame, one: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """_best() of the comparisons of recordings open_ (id, fp), the classes known (id, class_id), and links (id, ref) found after them.

    Rounds by one holder of each landmark join most recordings at little cost; after them each pair that shares a landmark and is
    not in one class is compared, at all offsets that its landmarks vote for, unless the rounds have tried these.
    """
    compared = known = links = before = None
    marks, pairs = materialize(_shared_landmarks(open_, LANDMARKS[0])), None
    for turn in range(len(LANDMARKS)):
        held = _with_class(marks, known)
        order = F.xxhash64("key", "id", F.lit(turn)) if turn else F.lit(0).cast("long")
        one_of = F.min(F.struct(order.alias("o"), "id", "pos", "more", "n", "class_id"))
        centres = materialize(held.groupBy("key").agg(one_of.alias("c")))
        met = held.join(centres, "key").where("id != c.id and class_id != c.class_id")
        later = F.col("id") > F.col("c.id")
        sides = [F.when(later, F.col(n)).otherwise(F.col(f"c.{n}")).alias(n) for n in ("id", "pos", "more", "n")]
        refs = [F.when(later, F.col(f"c.{n}")).otherwise(F.col(n)).alias(r) for n, r in (("id", "ref"), ("pos", "ref_pos"), ("more", "ref_more"), ("n", "ref_n"))]
        shared = met.select(*sides, *refs)
        if compared is not None:  # what these landmarks leave out is tried below
            shared = shared.join(compared.select("id", "ref"), ["id", "ref"], "left_anti")
        shared = materialize(shared)
        if shared.isEmpty():
            break
        found, tried = _compared(shared, one)
        compared = found if compared is None else materialize(compared.unionByName(found))
        before = tried if before is None else before.unionByName(tried)
        known = _classes(compared.where("aligned").select("id", "ref"))
        # only landmarks whose holders are still split go on
        marks, pairs = _split(marks, known)
        n_marks = marks.count()
        if 2 * pairs <= n_marks:  # so few that a round saves little
            break
    if compared is None:
        return None, None, None
    spark, best, slices = open_.sparkSession, materialize(_best(compared)), -(-pairs // max(PAIRS, n_marks))
    old: list[str] = []
    for part in range(slices):
        with scratch(spark):
            earlier, old = old, []
            if links is not None:
                known = materialize(_classes(known.select("id", F.col("class_id").alias("ref")).unionByName(links)), keep=True)
                links = None
            held = _with_class(marks, known)
            mine = held.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == part)
            refs = mine.select("key", F.col("id").alias("ref"), F.col("pos").alias("ref_pos"), F.col("more").alias("ref_more"), F.col("n").alias("ref_n"), F.col("class_id").alias("ref_class"))
            shared = held.join(refs, "key").where("id > ref and class_id != ref_class").select("id", "pos", "more", "n", "ref", "ref_pos", "ref_more", "ref_n")
            found, _ = _compared(materialize(shared), one, before)
            best, path = write_table(_best(best.unionByName(found)), keep=True)
            old.append(path)
            if not (aligned := found.where("aligned").select("id", "ref")).isEmpty():
                links, path = write_table(aligned, keep=True)
                old.append(path)
        for path in earlier:  # what the slice before has left was read by this one
            delete_table(spark, path)
    return best, known, links


def align(prints: DataFrame) -> DataFrame:
    """prints (id, n_samples, fp) -> a row per row: id, n_samples, n_prints, reference_id, offset, votes, overlap,
    bit_errors (share), aligned, class_id.

    reference_id is, of the recordings with a smaller id that were compared, an aligned one before others, then the one with
    the most votes at its offset (ties: the smaller id), null without a shared landmark; the recording's place p lies at
    p - offset of the reference. A recording whose fingerprint equals that of smaller ids has the smallest of them as its
    reference, however short it is; so has one that is too short for a fingerprint and whose bytes (prints.digest) are equal, as empty
    ones are, while null is equal to nothing. Recordings of 1 to 3 integers meet no others: so short an overlap proves nothing. class_id
    is the smallest id that aligned links reach, itself included. Rows with a null id are returned without a reference; of rows that repeat an id the one with the smallest digest is compared, and all get its result. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    digest = F.col("digest") if "digest" in prints.columns else F.lit(None).cast("binary")
    prints = materialize(prints.select("id", "n_samples", "fp", digest.alias("digest")))
    with scratch(prints.sparkSession):
        best, classes = _aligned(prints)
    rows = prints.select("id", "n_samples", F.size("fp").cast("long").alias("n_prints"))
    out = rows.join(best.withColumnRenamed("ref", "reference_id"), "id", "left").join(classes, "id", "left")
    return out.withColumn("aligned", F.coalesce("aligned", F.lit(False))).withColumn("class_id", F.coalesce("class_id", "id"))


def _aligned(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, ref, offset, votes, overlap, bit_errors, aligned), the best comparison of each recording, and (id, class_id)."""
    of_prints = F.sha2(F.array_join(F.col("fp").cast("array<string>"), ","), 256)
    digest = F.when(F.size("fp") > 0, of_prints).otherwise(F.concat(F.lit("bytes "), F.hex("digest")))
    one = prints.where("id is not null").select("id", "fp", digest.alias("digest")).groupBy("id").agg(F.min_by("fp", "digest").alias("fp"), F.min("digest").alias("digest"))
    one = materialize(one.where("digest is not null"))
    folds = materialize(one.groupBy("digest").agg(F.min("id").alias("ref"), F.count("*").alias("n")).where("n > 1").select("digest", "ref"))
    copies = materialize(one.join(folds, "digest").where("id != ref").select("id", "ref", F.size("fp").cast("long").alias("overlap")))
    open_ = one.select("id", "fp").where(F.size("fp") >= LANDMARKS[0]).join(copies.select("id"), "id", "left_anti")

    best, known, links = _rounds(open_, one)
    rest = [links] if links is not None else []
    if known is not None:
        rest.append(known.select("id", F.col("class_id").alias("ref")))
    classes = materialize(_classes(reduce(DataFrame.unionByName, rest, copies.select("id", "ref"))), keep=True)
    # each landmark of a copy votes for its place
    votes = F.greatest(F.col("overlap") - LANDMARKS[0] + 1, F.least(F.col("overlap"), F.lit(1)))
    whole = copies.select("id", "ref", F.lit(0).cast("long").alias("offset"), votes.alias("votes"), "overlap", F.lit(0.0).alias("bit_errors"), F.lit(True).alias("aligned"))
    return materialize(best.unionByName(whole) if best is not None else whole, keep=True), classes
