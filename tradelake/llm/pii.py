"""Personal data: fixed expressions as seeds, and contextual extraction bootstrapped from them.

One pass over the texts finds the base spans and, beside them, candidates outside any base span: words with a digit, an at sign or
another sign inside, as identifiers of these kinds have one, and whole runs of digit groups. Each span or candidate is an
instance (its surface) in lexical patterns (the words around it). On the graph of patterns and instances, Spark scores both in
turn: a pattern's confidence in a kind is the smoothed share of its occurrences
that its instances' scores give to that kind; an instance that is no seed takes the mean confidence of its patterns. Patterns
of high confidence that several different seeds support then turn candidates into spans of their kind; base spans stay.

Only spans, candidates and their context words leave the text pass, as one table in the shared folder. Edges are counted on
the map side; scores are sums by key, and written tables are joined, which lets AQE split a pattern or surface that is
everywhere.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.llm.common import map_texts, materialize, scratch, small_batches

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_CONFIDENCE = 0.7
LEAST_SEEDS = 5
#: Occurrences without a kind that are added to each pattern.
SMOOTHING = 1.0
#: A word or surface of more characters stands in the graph as its SHA-256, so that different ones stay different.
LONG = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin within a run of digits: what follows the run is the same from each of them.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[^\W_][(\[{<._#:/\\*=~|][^\W_]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GROUP = re.compile(r"[+(\[]*[0-9][0-9().+/-]*")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: from each at sign to both sides."""
    free = look = 0
    while (at := text.find("@", look)) >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        look = at + 1
        if begin < at and (m := _DOMAIN.match(text, look)):
            yield begin, m.end()
            free = look = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as in KINDS, then by start; code points, end exclusive."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_at_most_255, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := "".join(_DIGITS.findall(m[0]))) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def candidates(text: str, taken: list[tuple[int, int, int]], words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Words with a mark, without punctuation at their ends, and in place of single digit groups the longest runs of them that
    spaces separate; none touches a base span."""
    busy: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in taken):
        if busy and a <= busy[-1][1]:
            busy[-1][1] = max(busy[-1][1], b)
        else:
            busy.append([a, b])
    begins, out, run = [a for a, _ in busy], [], None

    def free(a: int, b: int) -> bool:
        i = bisect_left(begins, b) - 1
        return i < 0 or busy[i][1] <= a

    def add(a: int, b: int) -> None:
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if b > a:
            out.append((a, b))

    for a, b in words:
        if _MARK.search(text, a, b) is None or not free(a, b):
            end = None
        elif m := _GROUP.match(text, a, b):
            end = b if m.end() == b else a if not text[m.end() : b].strip(",;:!?\"')]}") else None
        else:
            end = None
        if run and (end is None or text[run[1] : a].strip(" ")):
            add(*run)
            run = None
        if end is None:
            if _MARK.search(text, a, b) and free(a, b):
                add(a, b)
        elif end == b:
            run = (run[0] if run else a, b)
        else:  # punctuation ends the run
            add(run[0] if run else a, b)
            run = None
    if run:
        add(*run)
    return out


def _named(word: str) -> str:
    return word if len(word) <= LONG else hashlib.sha256(word.encode("utf-8", "replace")).hexdigest()


def patterns(text: str, begin: int, end: int, words: list[tuple[int, int]]) -> list[str]:
    """The words around a span: two on the left, and one on each side; none for a side without words. What is left of a word that
    the span cuts is a word."""
    i, left = bisect_right(words, (begin, len(text) + 1)) - 1, []
    if i >= 0 and words[i][0] < begin:
        left.append(text[words[i][0] : min(begin, words[i][1])])
    while i > 0 and len(left) < 2:
        i -= 1
        left.append(text[words[i][0] : words[i][1]])
    j = bisect_right(words, (end - 1, len(text) + 1)) - 1
    right = text[end : words[j][1]] if words[j][1] > end else text[words[j + 1][0] : words[j + 1][1]] if j + 1 < len(words) else ""
    left, out = [_named(w.lower()) for w in left], []
    if len(left) == 2:
        out.append(f"{left[1]} {left[0]} _")
    if left and right:
        out.append(f"{left[0]} _ {_named(right.lower())}")
    return out


def seen_in(text: str) -> list[dict]:
    """The base spans and candidates of a text with their surfaces and patterns; kind -1 for candidates."""
    spans = base_spans(text)
    if not spans and not _MARK.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    spans += [(-1, a, b) for a, b in candidates(text, spans, words)]
    return [{"kind": k, "start": a, "end": b, "surface": _named(text[a:b]), "patterns": patterns(text, a, b, words)} for k, a, b in spans]


_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SEEN = T.StructType([*_SPAN, T.StructField("surface", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))])


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, seen): all spans and candidates of each row with their surfaces and patterns; kind -1 for candidates."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            seen = [seen_in(text) for text in batch.column(2).to_pylist()]
            fields = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string()), ("patterns", pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seen, pa.list_(pa.struct(fields)))], ["row", "id", "seen"])

    return map_texts(rows, each, T.StructType([rows.schema["row"], rows.schema["id"], T.StructField("seen", T.ArrayType(_SEEN))]))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges (pattern, surface, kind or -1, n) -> (pattern, kind, confidence, seeds), each pattern's best kind.

    The seeds' scores are 1 for their kind. seeds: different surfaces of that kind in the pattern.
    """
    k = range(len(KINDS))
    scores = edges.withColumns({f"r{i}": (F.col("kind") == i).cast("double") for i in k})
    for turn in range(rounds):
        share = [(F.sum(F.col("n") * F.col(f"r{i}")) / (F.sum("n") + SMOOTHING)).alias(f"c{i}") for i in k]
        seeds = [F.sum((F.col("kind") == i).cast("long")).alias(f"s{i}") for i in k]
        confidence = materialize(scores.groupBy("pattern").agg(*share, *seeds))
        if turn + 1 == rounds:
            break
        mean = [(F.sum(F.col("n") * F.col(f"c{i}")) / F.sum("n")).alias(f"m{i}") for i in k]
        open_ = edges.where("kind < 0").join(confidence, "pattern").groupBy("surface").agg(*mean)
        open_ = materialize(open_.select(F.col("surface").alias("of"), *[f"m{i}" for i in k]))
        joined = edges.join(open_, F.col("surface") == F.col("of"), "left")
        scores = joined.withColumns({f"r{i}": F.when(F.col("kind") >= 0, (F.col("kind") == i).cast("double")).otherwise(F.coalesce(f"m{i}", F.lit(0.0))) for i in k})
    best = F.array_max(F.array(*[F.struct(F.col(f"c{i}").alias("c"), F.lit(-i).alias("k"), F.col(f"s{i}").alias("s")) for i in k]))
    return confidence.select("pattern", best.alias("b")).select("pattern", (-F.col("b.k")).alias("found_kind"), F.col("b.c").alias("confidence"), F.col("b.s").alias("seeds"))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, base and spans, arrays of (kind, start, end) sorted by kind (its place in KINDS), start.

    spans holds base and what trusted patterns add. Null texts count as empty; both arrays are empty for rows without a
    find. Rows that repeat are each searched, an empty table gives no rows, other columns are ignored. Texts are searched
    whole; a digit run or a word of any length takes linear time.
    """
    found = materialize(mentions(docs, id_col, text_col))
    each = found.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "surface", "kind").groupBy("pattern", "surface", "kind").agg(F.count("*").alias("n"))
    with scratch(docs.sparkSession):
        trusted = bootstrap(materialize(edges)).where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("seeds") >= LEAST_SEEDS))
        trusted = materialize(trusted, keep=True)
    open_ = each.where("kind < 0").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    hits = open_.join(trusted, "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("found_kind")).alias("k"))).alias("b"))
    added = hits.groupBy("row").agg(F.collect_list(F.struct((-F.col("b.k")).cast("int").alias("kind"), "start", "end")).alias("added"))
    base = F.transform(F.filter("seen", lambda s: s["kind"] >= 0), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    joined = found.select("row", "id", F.array_sort(base).alias("base")).join(added, "row", "left")
    whole = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("added"))))
    return joined.select(F.col("id").alias(id_col), "base", whole.alias("spans"))
