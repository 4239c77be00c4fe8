"""License notices by conditional compression.

Around license wording, as far as the longest template may reach, the passage that a template fits best is located by aligning
words. Each passage is compressed alone and with the template as a zstandard raw dictionary, and of overlapping passages the one
that shrinks most is ranked first; those close to it, and whether it is confirmed, are told apart by exact wording differences: the
words to be changed in the passage to get the template, words in front that deny it, and words behind that add an exception. A
block around such wording without a confirmed passage is returned whole with the template that shrinks it most. One pass in Arrow
batches, no shuffle; a document without such wording costs a few substring searches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.llm.common import map_texts, small_batches
from tradelake.llm.license_texts import TEMPLATES

#: Wording that makes a line a candidate, lower case.
CUES = ("licens", "licenc", "copyright", "rights reserved", "permission is", "permission to use", "redistribution", "warrant", "spdx", "creative commons", "public domain", "cc by", "cc0", "neither the name", "endorse or promote", "advertising materials")
#: Cue lines with at most so many lines between them are also tried as one block; a longer line is cut around its cues.
GAP_LINES = 4
LONG_LINE = 2000
AROUND = 400
#: Characters of a block that are aligned at once. Stretches overlap by half, so a notice of half that length is whole in one.
STRETCH = 8000
LEVEL = 9
LEAST_REDUCTION = 0.25
#: Share of the words that may differ; a replaced word counts once.
MOST_DIFFERENT = 0.2
#: Words that tell licenses apart or deny one: none of them may be missing or new. Numbers count where the wording itself has one.
IDENTIFYING = re.compile(
    r"(?:mit|x11|isc|[0-9]?bsd|bsl|boost|apache|mozilla|mpl|eclipse|epl|zlib|gnu|[al]?gpl|cc0?|creative)(?:[-v.0-9a-z]*)|clause|[0-9]-clause|lesser|library|affero|"
    r"public|general|commons|zero|universal|domain|dedicated|waived|unlicense|unencumbered|only|later|"
    r"(?:by|nc|sa|nd)(?:-(?:by|nc|sa|nd))*(?:-[0-9.]+)?|attribution(?:-.+)?|(?:share|non|no)-?(?:alike|commercial|derivatives|derivs)(?:-.+)?|"
    r"not|no|never|neither|nor|without|except|unless|cannot|proprietary"
)
#: Words close before a wording that turn it into its opposite.
NEGATIONS = frozenset(("not", "no", "never", "neither", "nor", "isn", "isn't", "wasn't", "aren't", "cannot", "without", "longer", "un"))
NEGATED_BEFORE = 3
#: Words that do so from anywhere before it in its sentence, of which SENTENCE_WORDS are read.
DENIALS = frozenset(("not", "never", "neither", "nor", "isn't", "wasn't", "aren't", "cannot", "longer", "previously", "formerly", "unlike", "instead"))
SENTENCE_WORDS = 40
#: Words behind a wording, in its sentence, that change what it grants if one of JOINING comes before them.
AMENDING = frozenset(("exception", "exceptions", "clause", "clauses", "addendum", "restriction", "restrictions", "condition", "conditions", "amendment", "amendments", "modifications"))
JOINING = frozenset(("with", "plus", "subject", "under", "except", "but", "and"))
AMENDED_WITHIN = 10
#: In a wording of at most so many words, a new word beside one that identifies the license is part of another name, unless it says nothing.
NAME_WORDS = 20
SAYS_NOTHING = frozenset(("the", "a", "an", "this", "that", "terms", "of", "version", "v", "license", "licence", "licenses", "licensed", "is", "in", "under", "software", "and", "or", "to", "by", "it"))
#: Passages that compression ranks this close to each other are told apart by their exact differences.
NEAR_RANK = 0.9
VERSION = re.compile(r"v?[0-9]{1,2}(?:\.[0-9]+)*")
#: Licenses whose wording is nothing but what identifies it.
EXACT = frozenset({"all-rights-reserved"})
_CUE = re.compile("|".join(r"\s+".join(map(re.escape, c.split(" "))) for c in CUES))
_FIRST = tuple({c.split(" ")[0] for c in CUES})
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_SENTENCE_END = re.compile(r"[.!?;:]\s|\n\s*\n|\n\s*(?=[A-Z])")


def _squeezed(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)


class _Spans:
    """Spans of a text without overlap, in order; given ones that overlap are joined."""

    def __init__(self, given: Iterable[tuple[int, int]] = ()) -> None:
        self.starts, self.ends = [], []
        for a, b in sorted(given):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Add a span unless it overlaps one."""
        i = bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.templates = templates
        self.alone = _plain()
        self.given = []
        for _, wording in templates:
            raw = zstandard.ZstdCompressionDict(_squeezed(wording), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.reach = max(len(wording) for _, wording in templates) * 3 // 2
        self.words = [_WORD.findall(wording.lower()) for _, wording in templates]
        self.numbered = [any(map(VERSION.fullmatch, words)) for words in self.words]

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Candidate blocks (start, end): lines with a cue, runs of lines between near cue lines, and in long lines the text
        around cues, neighbouring pieces of it joined."""
        low = text.lower()
        if len(low) != len(text):  # a character whose lower case is longer
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        if not any(c in low for c in CUES):
            return []
        lines, pieces, ends, at, number = [], [], [], 0, 0
        for line in low.split("\n"):
            ends.append((at + len(line), bool(line.strip())))
            hits = [i for c in CUES if (i := line.find(c)) >= 0]
            if hits:
                if len(line) <= LONG_LINE:
                    lines.append((number, at, at + len(line)))
                else:
                    edge, wide = -1, [0, -1]
                    for m in re.finditer("|".join(map(re.escape, CUES)), line):
                        a, b = max(0, m.start() - AROUND, edge), min(len(line), m.end() + AROUND)
                        if a < b and m.end() > edge:
                            pieces.append((at + a, at + b))
                            edge = b
                        # a notice goes on beyond its first and last cue, and may lie in several pieces
                        a, b = max(0, m.start() - 2 * AROUND), min(len(line), m.end() + 2 * AROUND)
                        if a > wide[1]:
                            if wide[1] > 0:
                                lines.append((number, at + wide[0], at + wide[1]))
                            wide[0] = a
                        wide[1] = b
                    lines.append((number, at + wide[0], at + wide[1]))
            at += len(line) + 1
            number += 1
        out, run = [*pieces, *((a, b) for _, a, b in lines)], lines[:1]
        for line in [*lines[1:], None]:
            if line and line[0] - run[-1][0] <= GAP_LINES + 1 and line[0] != run[-1][0]:
                run.append(line)
                continue
            if len(run) > 1:
                out.append((run[0][1], run[-1][2]))
            last = number = run[-1][0]  # a notice may go on for some lines without a cue
            while number + 1 < len(ends) and number < last + GAP_LINES and ends[number + 1][1]:
                number += 1
            if number > last and ends[number][0] - run[-1][2] <= STRETCH:
                out.append((run[0][1], ends[number][0]))
            run = [line]
        return sorted(set(out))

    def areas(self, text: str) -> list[tuple[int, int]]:
        """The text around cues, as far as the longest template may reach to either side, whatever lines it crosses."""
        low = text.lower()
        if not any(c in low for c in _FIRST):
            return []
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        return list(zip(*vars(_Spans((max(0, m.start() - self.reach), min(len(text), m.end() + self.reach)) for m in _CUE.finditer(low))).values(), strict=True))

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(size reduction as a share, template) from the largest on; ties by the templates' order."""
        raw = _squeezed(block)
        size = len(self.alone.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / size, i) for i, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def differences(self, block: str, template: int) -> tuple[int, list[str]]:
        """Words compared, and the changes from the wording to the block: "-word" is missing there, "+word" is new."""
        words, changes, _ = self._compared(template, _WORD.findall(block.lower()))
        return words, changes

    def _compared(self, template: int, theirs: list[str]) -> tuple[int, list[str], int]:
        """Words compared, changes, and the number of words that differ, where a replaced word counts once."""
        ours, changes, differ = self.words[template], [], 0
        for op, a, b, c, d in SequenceMatcher(None, ours, theirs, autojunk=False).get_opcodes():
            if op != "equal":
                changes += [f"-{w}" for w in ours[a:b]] + [f"+{w}" for w in theirs[c:d]]
                differ += max(b - a, d - c)
        return max(len(ours), len(theirs)), changes, differ

    def identified(self, template: int, changes: list[str]) -> bool:
        """Whether no change is of a word that identifies the license."""
        if self.templates[template][0] in EXACT:
            return not changes
        return not any(IDENTIFYING.fullmatch(c[1:]) or (self.numbered[template] and VERSION.fullmatch(c[1:])) for c in changes)

    @staticmethod
    def negated(text: str, spans: list[tuple[int, int]], first: int) -> bool:
        """Whether a word before the first one, in its sentence, says the opposite."""
        for i in range(first - 1, max(-1, first - 1 - SENTENCE_WORDS), -1):
            a, b = spans[i]
            if _SENTENCE_END.search(text[b : spans[i + 1][0] + 1]):
                return False
            word = text[a:b].lower()
            if word in DENIALS or (first - i <= NEGATED_BEFORE and word in NEGATIONS):
                return True
        return False

    @staticmethod
    def amended(text: str, spans: list[tuple[int, int]], last: int) -> bool:
        """Whether the words behind the last one, in its sentence, add an exception or a clause."""
        joined = False
        for i in range(last + 1, min(len(spans), last + 1 + AMENDED_WITHIN)):
            a, b = spans[i]
            if _SENTENCE_END.search(text[spans[i - 1][1] : a + 1]):
                return False
            word = text[a:b].lower()
            if joined and word.rsplit("-", 1)[-1] in AMENDING:
                return True
            if i == last + 1 and word not in SAYS_NOTHING and i + 1 < len(spans) and text[slice(*spans[i + 1])].lower() in ("license", "licence"):
                return True  # the name goes on
            joined = joined or word in JOINING
        return False

    def renamed(self, template: int, theirs: list[str]) -> bool:
        """Whether a short wording has a further word in its license's name, as the Modified MIT License."""
        ours = self.words[template]
        if len(ours) > NAME_WORDS:
            return False
        for op, _, _, c, d in SequenceMatcher(None, ours, theirs, autojunk=False).get_opcodes():
            beside = [theirs[k] for k in (c - 1, d) if 0 <= k < len(theirs)]
            if op == "insert" and any(w not in SAYS_NOTHING for w in theirs[c:d]) and any(IDENTIFYING.fullmatch(w) for w in beside):
                return True
        return False

    def passages(self, text: str, start: int, end: int) -> Iterator[dict]:
        """Where text[start:end] may hold a template, ranked by the bytes that the template as a dictionary saves: the passage, its
        reduction, its exact changes and, as confirmed, whether these confirm it. They may overlap."""
        for at in range(start, max(start + 1, end - STRETCH // 2), STRETCH // 2):
            spans = [(m.start() + at, m.end() + at) for m in _WORD.finditer(text[at : min(end, at + STRETCH)])]
            low = [text[a:b].lower() for a, b in spans]
            have = set(low)
            for i, ours in enumerate(self.words):
                if sum(w in have for w in ours) < (1 - MOST_DIFFERENT) * len(ours):
                    continue  # more words are missing than may differ
                todo = [(0, len(low))]
                while todo:
                    lo, hi = todo.pop()
                    c, d = self._passage(i, low[lo:hi])
                    if c == d:
                        continue
                    c, d = lo + c, lo + d
                    a, b = spans[c][0], spans[d - 1][1]
                    while a > start and not text[a - 1].isspace() and not text[a - 1].isalnum():
                        a -= 1
                    while b < end and not text[b].isspace() and not text[b].isalnum():
                        b += 1
                    raw = _squeezed(text[a:b])
                    alone = len(self.alone.compress(raw))
                    saved = alone - len(self.given[i].compress(raw))
                    words, changes, differ = self._compared(i, low[c:d])
                    if differ > MOST_DIFFERENT * words:
                        continue
                    # the same wording may come again beside it
                    todo += [(x, y) for x, y in ((lo, c), (d, hi)) if y - x >= (1 - MOST_DIFFERENT) * len(ours)]
                    if saved < LEAST_REDUCTION * alone:
                        continue
                    sure = self.identified(i, changes) and not self.renamed(i, low[c:d]) and not self.negated(text, spans, c) and not self.amended(text, spans, d - 1)
                    yield self._row(a, b, i, saved / alone, changes, sure) | {"saved": saved}

    def _passage(self, template: int, low: list[str]) -> tuple[int, int]:
        """The words (from, to) of low that match the template best: around the longest match, as far as matches outweigh
        the words between them."""
        ours = self.words[template]
        top = SequenceMatcher(None, ours, low, autojunk=False).find_longest_match()
        if not top.size:
            return 0, 0
        spare = 1 + int(2 * MOST_DIFFERENT * len(ours))
        lo, hi = max(0, top.b - top.a - spare), min(len(low), top.b + len(ours) - top.a + spare)
        found = [m for m in SequenceMatcher(None, ours, low[lo:hi], autojunk=False).get_matching_blocks() if m.size]
        best, gain, first = (0, 0, 0), 0, 0
        for k, m in enumerate(found):
            gain -= m.b - (found[k - 1].b + found[k - 1].size) if k else 0
            if gain <= 0:
                gain, first = 0, m.b
            gain += m.size
            if gain > best[0]:
                best = (gain, first, m.b + m.size)
        return lo + best[1], lo + best[2]

    def _row(self, a: int, b: int, template: int, reduction: float, changes: list[str], sure: bool) -> dict:
        return {"start": a, "end": b, "license": self.templates[template][0], "template": template, "reduction": round(reduction, 4), "n_changes": len(changes), "changes": " ".join(changes), "confirmed": sure}

    def scan(self, text: str) -> list[dict]:
        """Of overlapping passages the one that compression ranks first, of those ranked close to it the one with the fewest changes, if
        it is confirmed; then of the blocks that hold none of them, and overlap no other such block, the shortest."""
        blocks = self.blocks(text)
        every = {(x["start"], x["end"], x["template"]): x for a, b in self.areas(text) for x in self.passages(text, a, b)}
        out = []
        for group in _overlapping(every.values()):
            group.sort(key=lambda x: (-x["saved"], len(x["changes"]), x["start"], x["template"]))
            while group:
                near = [x for x in group if x["saved"] >= NEAR_RANK * group[0]["saved"] and x["start"] < group[0]["end"] and x["end"] > group[0]["start"]]
                won = min(near, key=lambda x: (not x["confirmed"], x["n_changes"], -x["saved"], x["start"], x["template"]))
                if won["confirmed"]:
                    out.append(won)
                    group = [x for x in group if x["end"] <= won["start"] or x["start"] >= won["end"]]
                else:
                    group = [x for x in group if x not in near]
        out.sort(key=lambda x: x["start"])
        # a block is settled by a passage in it, or beside it in a block of a few lines, such as a copyright line
        beside = []
        for x in out:
            k = bisect_left(blocks, (x["end"] - LONG_LINE, -1))
            while k < len(blocks) and blocks[k][0] <= x["start"]:
                if blocks[k][1] >= x["end"] and blocks[k][1] - blocks[k][0] <= LONG_LINE:
                    beside.append(blocks[k])
                k += 1
        taken = _Spans([*((x["start"], x["end"]) for x in out), *beside])
        for a, b in sorted(blocks, key=lambda x: (x[1] - x[0], x)):
            if not taken.add(a, b):
                continue
            ranks = self.ranked(text[a:b])
            best = ranks[0]
            changes = self.differences(text[a:b], best[1])[1]
            # of wordings that shrink it alike, the one with the fewest differences
            for other in ranks[1:]:
                if other[0] < best[0] - 0.1:
                    break
                c = self.differences(text[a:b], other[1])[1]
                if len(c) < len(changes):
                    best, changes = other, c
            out.append(self._row(a, b, best[1], best[0], changes, False))
        return sorted(out, key=lambda x: x["start"])


def _overlapping(found: Iterable[dict]) -> Iterator[list[dict]]:
    """Passages in groups that do not touch each other."""
    group: list[dict] = []
    edge = -1
    for x in sorted(found, key=lambda x: (x["start"], x["end"])):
        if group and x["start"] >= edge:
            yield group
            group = []
        group.append(x)
        edge = max(edge if len(group) > 1 else -1, x["end"])
    if group:
        yield group


_FOUND = [("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("reduction", pa.float64()), ("n_changes", pa.int64()), ("changes", pa.string()), ("confirmed", pa.bool_())]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per confirmed passage, and per candidate block without one: id_col, start and end (code points, end exclusive),
    license, template, reduction, n_changes, changes (all of them), confirmed.

    A passage is confirmed if the reduction reaches LEAST_REDUCTION, the words that differ are few and none of them identifies a
    license (its name, version number or terms such as BY, NC, SA, ND). Texts without
    license wording, null and empty ones give no row; rows that repeat are each scanned; other columns are ignored. Texts
    are scanned whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in small_batches(batches, 1):
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for x in scanner.scan(text):
                    at.append(i)
                    found.append(x)
            columns = [pa.array([x[n] for x in found], t) for n, t in _FOUND]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["id", *[n for n, _ in _FOUND]])

    spec = "start long, end long, license string, template int, reduction double, n_changes long, changes string, confirmed boolean"
    return map_texts(rows, each, T.StructType([rows.schema["id"], *T.StructType.fromDDL(spec)])).withColumnRenamed("id", id_col)
