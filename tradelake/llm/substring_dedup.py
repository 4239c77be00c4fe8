"""Removal of repeated word windows with a count-min prefilter.

A window is WINDOW consecutive words of a document. A word goes if a window over it also starts in a document with a smaller
id. Documents are first packed into units of some MB, written once, so that later passes see the same units:

1. Each unit makes its partial count-min sketch: for each block of the hash space, the counters that its windows touch, in
   ROWS rows, counting a window once per document and no further than 2. Partial sketches are merged by block, and each
   unit gets back one bit per counter that it sent: whether the merged count reaches 2. A window whose counters all do is
   estimated repeated. Counters only overestimate, so no repeated window is lost.
2. Units send 128 bits of the SHA-256 of the words of the windows estimated repeated, with the smallest document id that has
   it in the unit. Grouped exactly, each entry gets back one bit: whether a smaller document elsewhere has the window.
3. Units mark the covered words and give the texts that are left.

Blocks are even shares of a hash. Their number follows the input so that each has COUNTERS counters a window at every size, and
units and blocks grow with the square root of the input within bounds, so that a unit's slice of a block does not get tiny too
soon and neither outgrows a task (see shape_for()). What is shuffled: about 3 bytes a window for the sketches, some 20 bytes for
each different window of a unit that is estimated repeated, and the compressed units twice. A window that occurs everywhere
costs one entry per unit; no task grows with one key, and nothing is broadcast or collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.llm.common import map_texts, materialize

WINDOW = 13
ROWS = 2
#: Counters in a row of the sketch for each window. With all windows different, one row takes 1 - exp(-1 / 4) of the others for
#: repeated, both rows 5 % of them, or less, as rows are rounded up to a power of two.
COUNTERS = 4
#: Bytes of text for each window, about; with fewer, blocks hold more windows than planned.
WINDOW_BYTES = 6
#: Bounds of a unit's text in bytes and of a block's windows.
UNIT_BYTES = (4 << 20, 32 << 20)
BLOCK_WINDOWS = (1 << 19, 1 << 25)
#: Windows of a block of the second pass, whose entries are whole digests.
ENTRY_WINDOWS = 1 << 21
MULTIPLIER = 0x9E3779B97F4A7C15
SECOND_ROW = 0xD6E8FEB86659FD93
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Shape:
    """Bytes of text in a unit, blocks of the sketch, bits of a counter's place in a row of a block, blocks of the entries."""

    unit_bytes: int
    blocks: int
    width_bits: int
    entry_blocks: int

    @property
    def counters(self) -> int:
        """Counters in a row of all blocks together."""
        return self.blocks << self.width_bits


def shape_for(n_bytes: int) -> Shape:
    """Counters in proportion to the windows at every size. At 0.5 GB a unit has 4 MB and a block 0.5 million windows; both grow with
    the square root of the input up to 32 MB and 34 million windows, from about 1 TB on."""
    windows = max(1, n_bytes // WINDOW_BYTES)
    root = windows**0.5
    blocks = max(1, round(windows / min(BLOCK_WINDOWS[1], max(BLOCK_WINDOWS[0], 64 * root))))
    width_bits = max(4, (COUNTERS * -(-windows // blocks) - 1).bit_length())
    return Shape(int(min(UNIT_BYTES[1], max(UNIT_BYTES[0], 128 * root))), blocks, width_bits, max(1, -(-windows // ENTRY_WINDOWS)))


def _ranges(ascending: np.ndarray, n_blocks: int) -> Iterator[tuple[int, slice]]:
    """Which of n_blocks equal ranges of the hash space ascending hashes fall into, and where."""
    block = ((ascending >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    cut = [*np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
    begin = 0
    for end in map(int, cut):
        if end > begin:
            yield int(block[begin]), slice(begin, end)
        begin = end


class Unit:
    """The words and windows of some documents."""

    def __init__(self, payload: bytes, window: int) -> None:
        with pa.ipc.open_stream(payload) as source:
            rows = source.read_all().combine_chunks()
        self.ids = rows.column("id")
        self.order = self.ids.fill_null(NO_ID).to_numpy()
        self.words = [(t or "").encode().split() for t in rows.column("text").to_pylist()]
        self.window = window
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.first = np.r_[0, np.cumsum(self.size)]
        word_hash = np.fromiter((xxhash.xxh3_64_intdigest(w) for seq in self.words for w in seq), np.uint64, int(self.first[-1]))
        owner = np.repeat(np.arange(len(self.words)), self.size)
        n = max(0, len(word_hash) - window + 1)
        start = np.flatnonzero(owner[:n] == owner[window - 1 : window - 1 + n]) if n else np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for k in range(window):
            h *= np.uint64(MULTIPLIER)
            h += word_hash[k : k + n]
        h = h[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        at = np.argsort(h, kind="stable")  # of equal hashes, in the order of the documents
        #: Windows in the order of their hashes: the hash, the first word's place, the document's place.
        self.hash, self.start = h[at], start[at]
        self.doc = owner[self.start] if len(at) else np.zeros(0, np.int64)

    def segments(self, n_blocks: int) -> Iterator[tuple[int, slice]]:
        """The windows of each block: blocks are ranges of the hash."""
        return _ranges(self.hash, n_blocks)

    def digests(self, chosen: np.ndarray) -> np.ndarray:
        """128 bits (two uint64 columns) of the SHA-256 of the words of the chosen windows (places in hash order)."""
        out = bytearray()
        for w, d in zip(self.start[chosen].tolist(), self.doc[chosen].tolist(), strict=True):
            i = w - int(self.first[d])
            out += hashlib.sha256(b" ".join(self.words[d][i : i + self.window])).digest()[:16]
        return np.frombuffer(bytes(out), "<u8").reshape(-1, 2)


def _counters(h: np.ndarray, width_bits: int) -> list[np.ndarray]:
    """The counter of each hash in each row of its block."""
    return [(((h * np.uint64(m)) >> np.uint64(64 - width_bits))).astype(np.uint32) for m in (MULTIPLIER, SECOND_ROW)][:ROWS]


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, which compress better than whole numbers."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _unplanes(raw: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel()


def _sketch_slice(h: np.ndarray, doc: np.ndarray, width_bits: int) -> bytes:
    """A unit's counters in a block: for each row the places, ascending, and whether the count is 2 or more."""
    once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    parts = []
    for place in _counters(h[once], width_bits):
        at, n = np.unique(place, return_counts=True)
        parts += [np.uint32(len(at)).tobytes(), _planes(np.diff(at, prepend=np.uint32(0)).astype("<u4")), np.packbits(n > 1).tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def _parse_slice(raw: bytes, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and flags of a row of an uncompressed slice."""
    i = 0
    while True:
        n = int(np.frombuffer(raw, "<u4", 1, i)[0])
        if row == 0:
            break
        i, row = i + 4 + 4 * n + -(-n // 8), row - 1
    at = np.cumsum(_unplanes(raw[i + 4 : i + 4 + 4 * n], "<u4", n), dtype=np.int64)
    return at, np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), i + 4 + 4 * n), count=n)


def _merge_sketches(key: tuple, rows: pa.Table, width_bits: int) -> pa.Table:
    """Merge the slices of a block; back to each unit goes a bit for each counter it sent. One row of counters is held at once."""
    units, slices = rows.column("unit").to_pylist(), rows.column("payload")
    replies = [b""] * len(units)
    for row in range(ROWS):
        count = np.zeros(1 << width_bits, np.uint8)
        for payload in slices:
            at, many = _parse_slice(zstandard.decompress(payload.as_py()), row)
            count[at] = np.minimum(count[at] + 1 + many, 2)
        for i, payload in enumerate(slices):
            at, _ = _parse_slice(zstandard.decompress(payload.as_py()), row)
            replies[i] += np.packbits(count[at] > 1).tobytes()
    packed = [zstandard.compress(x, 1) for x in replies]
    return pa.table([pa.array(units, pa.int64()), pa.array([key[0].as_py()] * len(units), pa.int32()), pa.array(packed, pa.binary())], ["unit", "block", "payload"])


def _estimated(unit: Unit, replies: dict[int, bytes], n_blocks: int, width_bits: int) -> np.ndarray:
    """Places (in hash order) of the windows whose counters all reach 2."""
    found = []
    for block, part in unit.segments(n_blocks):
        raw, i, hit = zstandard.decompress(replies[block]), 0, True
        for place in _counters(unit.hash[part], width_bits):
            at, inverse = np.unique(place, return_inverse=True)
            n = -(-len(at) // 8)
            hit = hit & np.unpackbits(np.frombuffer(raw, np.uint8, n, i), count=len(at)).astype(bool)[inverse]
            i += n
        found.append(np.flatnonzero(hit) + part.start)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _entries(unit: Unit, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different digests among the chosen windows, ascending; the smallest document of each; each window's digest's place."""
    digests = unit.digests(chosen)
    at = np.lexsort((digests[:, 1], digests[:, 0]))
    digests = digests[at]
    new = np.r_[True, (digests[1:] != digests[:-1]).any(1)] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(unit.order[unit.doc[chosen[at]]], first) if len(first) else np.zeros(0, np.int64)
    which = np.empty(len(at), np.int64)
    which[at] = np.cumsum(new) - 1
    return digests[first], least, which


def _merge_entries(key: tuple, rows: pa.Table) -> pa.Table:
    """Group the digests of a block exactly; back to each unit goes a bit for each entry: a smaller document is elsewhere."""
    units, parsed = rows.column("unit").to_pylist(), []
    for payload in rows.column("payload"):
        raw = zstandard.decompress(payload.as_py())
        n = len(raw) // 24
        parsed.append((_unplanes(raw[: 16 * n], "<u8", 2 * n).reshape(2, n).T, _unplanes(raw[16 * n :], "<i8", n)))
    keys, docs = np.concatenate([k for k, _ in parsed]), np.concatenate([d for _, d in parsed])
    at = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.r_[True, (keys[at][1:] != keys[at][:-1]).any(1)]
    least = np.minimum.reduceat(docs[at], np.flatnonzero(new))
    later = np.empty(len(at), bool)
    later[at] = docs[at] > least[np.cumsum(new) - 1]
    ends = np.cumsum([len(d) for _, d in parsed])[:-1]
    replies = [zstandard.compress(np.packbits(x).tobytes(), 1) for x in np.split(later, ends)]
    return pa.table([pa.array(units, pa.int64()), pa.array([-1 - key[0].as_py()] * len(units), pa.int32()), pa.array(replies, pa.binary())], ["unit", "block", "payload"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shape: Shape | None = None) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_text (the words left, joined by one space).

    Windows are judged on the input, not on what is left. Texts shorter than a window lose nothing; null texts count as
    empty. The id column holds integers; a null id counts as larger than any other. Rows that repeat an id do not remove
    each other's words. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    shape = shape or shape_for(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    n_blocks, width_bits = shape.blocks, shape.width_bits
    message = "unit long, block int, payload binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held)
            unit, whole = whole.column("row")[0].as_py(), whole.drop_columns("row")
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["unit", "payload"])

        for batch in batches:
            begin = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                if size and size + n > shape.unit_bytes:
                    held.append(batch.slice(begin, i - begin))
                    yield packed()
                    held, size, begin = [], 0, i
                size += int(n)
            if begin < len(batch):
                held.append(batch.slice(begin))
        if held:
            yield packed()

    units = materialize(map_texts(rows, pack, "unit long, payload binary"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                unit = Unit(payload.as_py(), window)
                found = [(b, _sketch_slice(unit.hash[p], unit.doc[p], width_bits)) for b, p in unit.segments(n_blocks)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["unit", "block", "payload"])

    def merge_sketches(key: tuple, slices: pa.Table) -> pa.Table:
        return _merge_sketches(key, slices, width_bits)

    repeated = materialize(units.mapInArrow(sketch, message).groupBy("block").applyInArrow(merge_sketches, message))

    def flagged(unit_rows: pa.Table, replies: pa.Table) -> Iterator[tuple[int, Unit, np.ndarray, dict[int, bytes]]]:
        by_block = dict(zip(replies.column("block").to_pylist(), replies.column("payload").to_pylist(), strict=True))
        for name, payload in zip(unit_rows.column("unit").to_pylist(), unit_rows.column("payload"), strict=True):
            unit = Unit(payload.as_py(), window)
            yield name, unit, _estimated(unit, by_block, n_blocks, width_bits), by_block

    def entries(unit_rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for name, unit, chosen, _ in flagged(unit_rows, replies):
            keys, least, _ = _entries(unit, chosen)
            for block, p in _ranges(keys[:, 0], shape.entry_blocks):
                raw = _planes(np.ascontiguousarray(keys[p].T).ravel()) + _planes(least[p].astype("<i8"))
                out.append((name, block, zstandard.compress(raw, 1)))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["unit", "block", "payload"])

    keyed = units.groupBy("unit").cogroup(repeated.groupBy("unit")).applyInArrow(entries, message)
    elsewhere = materialize(keyed.groupBy("block").applyInArrow(_merge_entries, message))

    def finish(unit_rows: pa.Table, replies: pa.Table) -> pa.Table:
        tables = []
        for _, unit, chosen, by_block in flagged(unit_rows, replies):
            keys, least, which = _entries(unit, chosen)
            later = np.zeros(len(keys), bool)
            for block, p in _ranges(keys[:, 0], shape.entry_blocks):
                bits = np.frombuffer(zstandard.decompress(by_block[-1 - block]), np.uint8)
                later[p] = np.unpackbits(bits, count=p.stop - p.start).astype(bool)
            hit = chosen[later[which] | (unit.order[unit.doc[chosen]] > least[which])]
            edge = np.zeros(int(unit.first[-1]) + window + 1, np.int64)
            np.add.at(edge, unit.start[hit], 1)
            np.add.at(edge, unit.start[hit] + window, -1)
            kept = np.cumsum(edge)[: int(unit.first[-1])] == 0
            texts = []
            for i, seq in enumerate(unit.words):
                keep = kept[unit.first[i] : unit.first[i + 1]]
                texts.append(b" ".join(seq if keep.all() else [w for w, k in zip(seq, keep.tolist(), strict=True) if k]))
            left = np.add.reduceat(np.r_[kept, False].astype(np.int64), unit.first[:-1]) * (unit.size > 0)
            tables.append(pa.table([unit.ids, pa.array(unit.size), pa.array(unit.size - left), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"]))
        return pa.concat_tables(tables) if tables else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    replies = repeated.unionByName(elsewhere)
    return units.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(finish, out).withColumnRenamed("id", id_col)
