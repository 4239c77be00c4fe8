"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece they would make and then from the left;
the best pair is merged, which puts its new neighbours on the agenda, until none is left. Symbols outside the vocabulary
become byte pieces. As no piece of such a vocabulary has a meta space after another character, a text falls into chunks
(meta spaces and what follows them) that no merge crosses; chunks recur, so a worker keeps the ids of those it has met, up
to a fixed number. Each chunk that the agenda encodes is compared with the sentencepiece library, a batch's new chunks at a
time. The text that each piece adds behind another is compared with the library's decoder when a worker loads the vocabulary, and
texts that decode to something else than themselves are compared with it whole: a difference raises.

Rows are independent: one pass over the table in Arrow batches, no shuffle.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.llm.common import map_texts, small_batches

META = "▁"
#: Chunks whose ids a worker keeps in either half of its table, and the longest that it keeps (characters).
KEPT_CHUNKS = 200_000
KEPT_CHARS = 64
#: Longest chunk (characters) whose agenda is a plain list, and the rank of what is no piece.
SHORT = 40
NO_PIECE = 1 << 30


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tradelake.one_byte", _one_byte)


class _Chunks(dict):
    """Chunk -> its ids as int32 bytes; a new chunk goes over the agenda and is noted for the check.

    When it is full, its chunks become the older half, from which those still in use come back.
    """

    def __init__(self, codec: PieceCodec) -> None:
        super().__init__()
        self.codec, self.new, self.older = codec, [], {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            ids = self.codec.agenda(chunk)
            self.new.append((chunk, ids))
            found = array("i", ids).tobytes()
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found


class PieceCodec:
    """Encoder and decoder over the vocabulary of a sentencepiece model file of type BPE with byte pieces."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        bytes_ = {int(pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(bytes_) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.byte_id = [bytes_[i] for i in range(256)]
        normal = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id_of = {pieces[i]: i for i in normal}
        if any(re.search(f"[^{META}]{META}", p) for p in self.id_of):
            raise ValueError("a piece of the vocabulary crosses the start of a word")
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in normal}, reverse=True))}
        self.rank = {pieces[i]: order[lib.get_score(i)] for i in normal}
        self.end_id = lib.eos_id()
        self.starts_word = [p.startswith(META) for p in pieces]
        self.silent = np.array([lib.is_control(i) for i in range(n)])
        self.bytes_of = [p.replace(META, " ").encode() for p in pieces]
        for value, i in bytes_.items():
            self.bytes_of[i] = bytes([value])
        for i in range(n):
            if lib.is_control(i):
                self.bytes_of[i] = b""
            elif lib.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
        self.chunk = re.compile(f"{META}+[^{META}]*|[^{META}]+")
        self.chunks = _Chunks(self)
        behind = next(i for i in normal if pieces[i] == META)
        for i, theirs in enumerate(lib.decode([[behind, behind, i] for i in range(n)])):
            if self.decode(np.array([behind, behind, i], np.int32)) != theirs:
                raise ValueError(f"the decoders differ on piece {i}")

    def agenda(self, chunk: str) -> list[int]:
        """The ids of a chunk of normalised text."""
        symbols = self._merged_short(chunk) if len(chunk) <= SHORT else self._merged_long(chunk)
        ids = []
        for s in symbols:
            found = self.id_of.get(s)
            ids += [found] if found is not None else [self.byte_id[b] for b in s.encode()]
        return ids

    def _merged_short(self, chunk: str) -> list[str]:
        """The agenda as a list by place, whose lowest rank is looked for each time: the fastest way for a word."""
        rank, symbols = self.rank.get, list(chunk)
        queue = [rank(a + b, NO_PIECE) for a, b in zip(chunk, chunk[1:])]
        while queue and (best := min(queue)) != NO_PIECE:
            i = queue.index(best)
            symbols[i] = pair = symbols[i] + symbols.pop(i + 1)
            del queue[i]
            if i < len(queue):
                queue[i] = rank(pair + symbols[i + 1], NO_PIECE)
            if i:
                queue[i - 1] = rank(symbols[i - 1] + pair, NO_PIECE)
        return symbols

    def _merged_long(self, chunk: str) -> list[str]:
        """The agenda as a heap, for time in proportion to n log n."""
        rank, symbols, n = self.rank, list(chunk), len(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (r := rank.get(pair)) is not None:
                queue.append((r, i, pair))
        heapify(queue)
        while queue:
            _, i, pair = heappop(queue)
            left = symbols[i]
            if left is None or (j := after[i]) == n or left + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                wider = pair + symbols[k]
                if (r := rank.get(wider)) is not None:
                    heappush(queue, (r, i, wider))
            if (h := before[i]) >= 0:
                wider = symbols[h] + pair
                if (r := rank.get(wider)) is not None:
                    heappush(queue, (r, h, wider))
        return [s for s in symbols if s is not None]

    def check(self) -> None:
        """Compare the chunks encoded since the last call with the library."""
        new, self.chunks.new = self.chunks.new, []
        # the library puts a meta space before a text by itself
        for (chunk, ids), theirs in zip(new, self.library.encode([c[1:].replace(META, " ") for c, _ in new], num_threads=1) if new else [], strict=True):
            if ids != theirs and not (chunk == META and not theirs):
                raise ValueError(f"the agenda and the library differ on {chunk!r}: {ids} and {theirs}")

    def encode(self, texts: list[str], end: bool = True) -> list[np.ndarray]:
        """int32 ids of each text, as the library's encode() gives them, with the end id behind if asked for."""
        tail = np.array([self.end_id] if end else [], np.int32).tobytes()
        chunk, of = self.chunk.findall, self.chunks.__getitem__
        out = [np.frombuffer(b"".join(map(of, chunk(x))) + tail, np.int32) for x in self.library.normalize(texts)] if texts else []
        self.check()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, as the library's decode() gives it: byte pieces that form no character become U+FFFD each."""
        silent = self.silent[ids]
        seq = ids[~silent].tolist()
        if silent[:-1].any():  # they end a run of byte pieces
            cut = np.flatnonzero(silent)
            runs = [part[~self.silent[part]].tolist() for part in np.split(ids, cut)]
        else:
            runs = [seq]
        text = "".join(b"".join(map(self.bytes_of.__getitem__, run)).decode("utf-8", "tradelake.one_byte") for run in runs)
        return text[1:] if seq and self.starts_word[seq[0]] else text  # without the meta space put before the text

    def decode_checked(self, ids: np.ndarray, text: str) -> str:
        got = self.decode(ids)
        if got != text and got != (theirs := self.library.decode(ids.tolist())):
            raise ValueError(f"the decoders differ: {got[:80]!r} and {theirs[:80]!r}")
        return got


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str | None = None) -> PieceCodec:
    """The codec of a model file, made once in a worker."""
    model_file = model_file or default_model()
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, end: bool = True) -> DataFrame:
    """One row per input row: id_col, ids (array of int), decoded (the text that the ids give).

    Null texts count as empty: no id but the end id, decoded to the empty text. Rows that repeat are each encoded; an
    empty table gives no rows; other columns are ignored. A text is encoded whole, however long.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(model_file)
        for batch in small_batches(batches, 1):
            texts = batch.column(1).to_pylist()
            ids = mine.encode(texts, end)
            decoded = [mine.decode_checked(i, x) for i, x in zip(ids, texts, strict=True)]
            offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    out = T.StructType([rows.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return map_texts(rows, each, out).withColumnRenamed("id", id_col)
