"""Near-duplicates by SimHash with deletion-variant signatures.

Fingerprints of 64 bits link at 3 or fewer differing bits. Cut into two halves, one half of such a pair differs by at most
one bit, so the pair agrees on a half with one bit left out. Each distinct fingerprint is indexed under its 64 variants of
a half without one bit; rows that are equal in a variant meet in a bucket, where pairs are verified on all bits. A bucket of
up to SMALL_BUCKET members gives its links, a larger one a spanning set of them, one per member at most, and never all pairs.
Buckets above HOT_BUCKET members are dealt out again by variants of a quarter of the other half: there 46 bits are fixed, so a
bucket has at most 2 ** 18 members by construction, and no link is lost. Copies were folded into one fingerprint before.
Components and their smallest document ids come from distributed joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.llm.common import map_texts, materialize, row_hash, scratch, small_batches, without_rows
from tradelake.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 3
HOT_BUCKET = 4096
#: Buckets of up to so many members are compared together with others, by distance in the sorted rows.
SMALL_BUCKET = 64
#: Shingles of a document that are counted at once.
COUNT_AT_ONCE = 1 << 14


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned SimHash of a whole text.

    A-Z are lower-cased; words are what ASCII white space separates. The features are all runs of `words` words, repeats
    included, or the whole sequence if it is shorter. Without words the fingerprint is 0.
    """
    seq = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not seq:
        return 0
    count, n = np.zeros(64, np.int64), max(1, len(seq) - words + 1)
    for i in range(0, n, COUNT_AT_ONCE):
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(seq[j : j + words]), seed) for j in range(i, min(n, i + COUNT_AT_ONCE))), np.uint64)
        count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, fp) per row of docs; hash tells texts apart, fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), row_hash(F.col(text_col)).alias("hash"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], ["id", "hash", "fp"])

    return map_texts(rows, each, T.StructType([rows.schema["id"], rows.schema["hash"], T.StructField("fp", T.LongType())]))


def half_variants(fp: Column) -> Column:
    """64 keys: half, bit left out, and the half without that bit."""

    def key(k: Column) -> Column:
        half = F.when(k < 32, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
        bit = F.pow(F.lit(2.0), k % 32).cast("long")
        return k * F.lit(1 << 32) + half - F.when(half.bitwiseAND(bit) != 0, bit).otherwise(F.lit(0))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), key)


def quarter_variants(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of a hot bucket under 32 keys of its other half: a quarter and a bit left out."""
    other = np.where(key >> 32 < 32, fp.view(np.uint64) >> np.uint64(32), fp.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keys = []
    for quarter in range(2):
        part = (other >> (16 * quarter)) & 0xFFFF
        for bit in range(16):
            keys.append((((key * 2 + quarter) * 16 + bit) << 16) | (part & ~(1 << bit)))
    return np.concatenate(keys), np.tile(fp, 32)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _spanning(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is connected among fp, one for each member but the first of a component."""
    ends, roots, rest = [], [], fp
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        stack = [root]
        while stack and len(rest):
            near = _distance(rest, stack.pop()) <= MOST_BITS
            if near.any():
                found, rest = rest[near], rest[~near]
                stack.extend(found)
                ends.append(found)
                roots.append(np.full(len(found), root))
    if not ends:
        return fp[:0], fp[:0]
    return np.concatenate(roots), np.concatenate(ends)


def _pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within small buckets of rows sorted by key: members at distance 1, 2, ... in the sorted rows."""
    a, b, at, d = [], [], np.arange(len(key)), 0
    while True:
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        hit = at[_distance(fp[at], fp[at + d]) <= MOST_BITS]
        a.append(fp[hit])
        b.append(fp[hit + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _links(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> links (a, b, hot false), and rows of buckets above limit as (key, fp, hot true).

    A bucket that spans batches is carried along until it ends or passes the limit, so memory is bounded by a batch and a
    bucket of limit rows, or of 2 ** 18 by construction where there is no limit.
    """

    def out(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

    def closed(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
        yield out(*_pairs(key[small], fp[small]), False)
        for i, n in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
            if limit and n > limit:
                yield out(key[i : i + n], fp[i : i + n], True)
            else:
                yield out(*_spanning(fp[i : i + n]), False)

    key = fp = np.zeros(0, np.int64)
    hot_key = None  # the bucket at the end of what was read, if it has passed the limit
    for batch in batches:
        key = np.r_[key, batch.column(0).to_numpy(zero_copy_only=False)]
        fp = np.r_[fp, batch.column(1).to_numpy(zero_copy_only=False)]
        if not len(key):
            continue
        if hot_key is not None:
            n = int(np.searchsorted(key, hot_key, "right"))
            yield out(key[:n], fp[:n], True)
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            hot_key = None
        last = int(np.searchsorted(key, key[-1], "left"))
        yield from closed(key[:last], fp[:last])
        key, fp = key[last:], fp[last:]
        if limit and len(key) > limit:
            yield out(key, fp, True)
            hot_key, key, fp = key[-1], key[:0], fp[:0]
    yield from closed(key, fp)


def fingerprint_links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """distinct (fp) -> links (a, b) at 3 or fewer differing bits, enough of them to connect all that is connected."""
    schema = "a long, b long, hot boolean"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _links(batches, hot_bucket)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _links(batches, None)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = quarter_variants(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])

    keyed = distinct.select(F.explode(half_variants(F.col("fp"))).alias("key"), "fp")
    found = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(first, schema))
    links = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if hot.isEmpty():
        return links
    dealt = hot.mapInArrow(again, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return links.unionByName(dealt.mapInArrow(second, schema).select("a", "b"))


def _classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, fp, first): a row per row; first is the id and hash of the row with the smallest id of its component."""
    prints = materialize(fingerprints(docs, id_col, text_col))
    with scratch(docs.sparkSession):
        least = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "hash"))
        distinct = materialize(prints.groupBy("fp").agg(least.alias("first")))
        roots = connected_components(fingerprint_links(distinct.select("fp")))
        named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        smallest = materialize(named.groupBy("root").agg(F.min("first").alias("first")))
        classes = materialize(named.select("fp", "root").join(smallest, "root").select("fp", "first"), keep=True)
    return prints.join(classes, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, fp (signed long), component_id, the smallest id reachable over links.

    Null texts and texts without words have fingerprint 0 and link like any other. Null ids get their fingerprint's
    component but do not name one, unless it has no other id. Rows that repeat an id are each returned. An empty table
    gives no rows. Other columns of docs are ignored, whatever their names.
    """
    return _classed(docs, id_col, text_col).select(F.col("id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id; null ids come last.

    Rows are told apart by id and text: of rows that repeat an id with different texts, each stays or goes with its own
    component, and of rows that repeat both, one stays, whichever it is. An empty table gives no rows.
    """
    found = materialize(_classed(docs, id_col, text_col).select("id", "hash", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash"))).alias("kept")))
    again = found.where("kept").groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1")
    return without_rows(docs, id_col, [text_col], found.where("not kept").select("id", "hash"), again.select("id", "hash"))
