"""Token counts of byte-level BPE vocabularies by rank-synchronous merging.

A batch's new pre-tokens are held as one ragged array of symbols. In each round every sequence finds the lowest rank among
its adjacent pairs and merges all pairs of that rank, all sequences at the same time; sequences without a pair in the
vocabulary are done, and what is left of them is their count. Pre-tokens recur, so a worker keeps the counts of those it has
met, up to a fixed number. Rows are independent: one pass in Arrow batches, no shuffle.

Pre-tokens are cut by the published pattern of the vocabulary. Character classes differ between Unicode versions, so a text
with characters outside the scripts of COMMON is cut by the tokenizers library's own pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.llm.common import map_texts, small_batches

#: Fixed value: the published pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Latin, Greek, Cyrillic, general punctuation, currency, kana, unified ideographs and Hangul: classes alike in all versions.
COMMON = re.compile("[^\u0000-ԧḀ-ỿ -⁯₠-₿　-〿ぁ-ゖァ-ヺ一-龥가-힣]")
KEPT_TOKENS = 700_000
KEPT_CHARS = 64
NONE = np.iinfo(np.int64).max


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: itself, or the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    own = set(own)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class RankCounter:
    """Counts tokens with the vocabulary of a tokenizers .json file (byte-level BPE without a normaliser)."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        spec = json.loads(open(file, encoding="utf-8").read())
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level BPE vocabulary without a normaliser")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take white space along are not handled")
        vocab = model["vocab"]
        self.size = len(vocab) + len(added)
        self.byte_symbol = np.array([vocab[c] for c in _byte_chars()], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        at = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[at], at.astype(np.int64), made
        self.pattern = regex.compile(PATTERN)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.known: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token, none of them empty."""
        counts = np.zeros(len(tokens), np.int64)
        if not tokens:
            return counts
        size = np.array([len(t) for t in tokens], np.int64)
        symbols = self.byte_symbol[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), size)
        rank = np.full(len(symbols), NONE)
        same = owner[:-1] == owner[1:]
        rank[:-1][same] = self.rank_of(symbols[:-1][same], symbols[1:][same])
        while len(symbols):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[begin, len(owner)])
            lowest = np.minimum.reduceat(rank, begin)
            done = lowest == NONE
            counts[owner[begin[done]]] = size[done]
            stay = np.repeat(~done, size)
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            if not len(symbols):
                break
            merge = rank == np.repeat(lowest[~done], size[~done])
            # of overlapping pairs (a run of the same symbol), every second one from the left
            place = np.arange(len(merge))
            run = np.maximum.accumulate(np.where(merge & ~np.r_[False, merge[:-1]], place, -1))
            merge &= (place - run) % 2 == 0
            symbols[merge] = self.made[rank[merge]]
            kept = ~np.r_[False, merge[:-1]]
            changed = (merge | np.r_[merge[1:], False] | np.r_[merge[2:], False, False][: len(merge)])[kept]
            symbols, owner, rank = symbols[kept], owner[kept], rank[kept]
            # ranks change where a pair was merged and just left of it
            at = np.flatnonzero(changed)
            rank[at] = NONE
            at = at[at < len(symbols) - 1]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self.rank_of(symbols[at], symbols[at + 1])
        return counts

    def pretokens(self, text: str) -> list[str]:
        if COMMON.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def count_texts(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for x in texts:
            parts = self.special.split(x) if self.special else [x]
            cut.append([t for p in parts if p for t in self.pretokens(p)])
            extra.append(len(parts) - 1)
        known = self.known
        new = list({t for tokens in cut for t in tokens if t not in known})
        if len(known) + len(new) > KEPT_TOKENS:
            known.clear()
            new = list({t for tokens in cut for t in tokens})
        found = dict(zip(new, self.count([t.encode() for t in new]).tolist(), strict=True))
        known.update(found)
        out = [sum(map(known.__getitem__, tokens)) + n for tokens, n in zip(cut, extra, strict=True)]
        for t in new:
            if len(t) > KEPT_CHARS:
                del known[t]
        return out


_counters: dict[str, RankCounter] = {}


def counter(file: str | None = None) -> RankCounter:
    file = file or default_tokenizer()
    if file not in _counters:
        _counters[file] = RankCounter(file)
    return _counters[file]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None) -> DataFrame:
    """One row per input row: id_col, n_bytes (UTF-8), n_tokens.

    No begin or end token is counted; the string of an added token inside a text is one token. Null texts count as empty:
    0 and 0. Rows that repeat are each counted, an empty table gives no rows, other columns are ignored. Texts are
    counted whole, however long.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = counter(tokenizer_file)
        for batch in small_batches(batches, 1):
            texts = batch.column(1).to_pylist()
            counts = mine.count_texts(texts)
            sizes = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return map_texts(rows, each, out).withColumnRenamed("id", id_col)
