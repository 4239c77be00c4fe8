"""Conversation structure repair: the cheapest edits that make the roles of a conversation an optional system turn and then
pairs of user and assistant.

A backward dynamic program gives, for each turn and grammar state, the cost to go; a forward walk takes at each step the
ASCII-least edit among those that keep to it. Both need one byte a turn (the role's initial and the fault), so texts stay out of
them. Turns are sorted across the cluster by ranges of (conversation, turn, role, text digest) and cut into segments of SEGMENT
turns at most. A conversation that lies in one segment is done there. Of longer ones each segment gives its costs from any state to
any other (a matrix of least sums), the few numbers of a segment are chained backward, each segment is walked from every
state it may begin in, and the states are chained forward; so one conversation may hold a large part of all turns. Texts are
shuffled once, for the repaired turns, and stream through in order.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradelake.llm.common import map_texts, materialize

#: Costs of the edits; a truncated turn that stays costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Turns of a segment.
SEGMENT = 4096

OTHER, SYSTEM, USER, ASSISTANT = range(4)
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Grammar states are START and the role that came last: START may be followed by system or user, system by user, and so on.
START = 0
ACCEPTED = (START, ASSISTANT)
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 60
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "cost")


def with_inserts(costs: list[int]) -> list[int]:
    """Costs to go from each state, where turns may be inserted first."""
    out = list(costs)
    for _ in range(3):  # the longest chain of inserts that leads to a new state
        for state, following in FOLLOWS.items():
            for to in following:
                if to != SYSTEM:
                    out[state] = min(out[state], INSERT + out[to])
    return out


END = with_inserts([0 if s in ACCEPTED else FAR for s in range(4)])


def edits(code: int, state: int, after: list[int]) -> Iterator[tuple[str, int, int]]:
    """The edits of a turn in a state, in ASCII order, as (initial, state after it, cost to go); after has the costs behind the turn."""
    role, fault = code & 3, code >> 2
    yield "D", state, DELETE + after[state]
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED * (fault == CUT_OFF)
    if role in FOLLOWS[state]:
        yield "K", role, extra + after[role]
    for to in FOLLOWS[state]:
        if to != SYSTEM:
            yield "R", to, REROLE + extra + after[to]


def costs_to_go(codes: bytes, end: list[int]) -> list[list[int]]:
    """Costs to go before each turn, inserts included, and as the last entry end, the costs behind them."""
    out = [end]
    for code in reversed(codes):
        out.append(with_inserts([min(c for _, _, c in edits(code, s, out[-1])) for s in range(4)]))
    out.reverse()
    return out


def walk(codes: bytes, costs: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The edits from a state on, and the state they end in; the last segment of a conversation also gets the inserts at its end."""
    audit = []

    def insert(now: list[int]) -> bool:
        nonlocal state
        for to in FOLLOWS[state]:
            if to != SYSTEM and now[state] == INSERT + now[to]:
                audit.append("I")
                state = to
                return True
        return False

    for i, code in enumerate(codes):
        while True:
            kind, to = next(((k, t) for k, t, c in edits(code, state, costs[i + 1]) if c == costs[i][state]), ("R", -1))
            if kind == "D" and to >= 0:
                break
            if not insert(costs[i]):  # "I" comes before "K" and "R"
                break
        audit.append(kind)
        state = to
    while last and state not in ACCEPTED:
        insert(END)
    return "".join(audit), state


def _matrix(codes: bytes) -> list[int]:
    """Least costs from each state before the turns to each state behind them, by rows."""
    columns = [costs_to_go(codes, [0 if s == to else FAR for s in range(4)])[0] for to in range(4)]
    return [min(columns[to][s], FAR) for s in range(4) for to in range(4)]


def _cost(codes: bytes, audit: str) -> int:
    """What the edits cost."""
    total, turn = 0, iter(codes)
    for edit in audit:
        if edit == "I":
            total += INSERT
            continue
        kept = TRUNCATED * (next(turn) >> 2 == CUT_OFF)
        total += DELETE if edit == "D" else kept + REROLE * (edit == "R")
    return total


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with one row in four damaged, chosen by the CRC of conv_id and turn: left out, emptied,
    without its sentence ends, repeated, or said by the user. Null roles and texts, and null ids in the choice, are one space."""

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = conversations.select("conv_id", "turn", kind.alias("_kind"), known("role").alias("role"), known("text").alias("text")).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"))
    return out.drop("_copy")


def _whole(turns: DataFrame) -> DataFrame:
    """The turns with what orders them: conversation, turn (null first), role, and the digest of the text."""
    space = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


ORDER = ("conv_id", "turn", "role", "digest")


def _coded(whole: DataFrame) -> DataFrame:
    """ORDER and code: the role's initial, and the fault but for a turn that repeats the one right before it."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    slim = materialize(whole.select(*ORDER, role.cast("int").alias("role_code"), fault.cast("int").alias("fault")))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = slim.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.count("*").alias("times"))
    said = said.where("times > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    same = slim.conv_id.eqNullSafe(F.col("_c")) & (slim.role == F.col("_r")) & (slim.digest == F.col("_d"))
    marked = slim.join(said, same, "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("first") < at), DUPLICATE).otherwise(F.col("fault"))
    return marked.select(*ORDER, (F.col("role_code") + 4 * fault).alias("code"))


def _segments_schema(conv: T.DataType) -> T.StructType:
    counts = [T.StructField(n, T.LongType()) for n in COUNTS]
    ends = [T.StructField(n, T.LongType()) for n in ("first_turn", "last_turn", "first_role", "last_role")]
    return T.StructType([
        T.StructField("conv_id", conv), T.StructField("seq", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("digest", T.BinaryType()),
        T.StructField("codes", T.BinaryType()), T.StructField("audit", T.StringType()), T.StructField("matrix", T.ArrayType(T.LongType())), *counts, *ends,
    ])


def _segment(conv: object, seq: int, first: tuple, codes: bytes, turns: list, alone: bool) -> dict:
    roles, faults = [c & 3 for c in codes], [c >> 2 for c in codes]
    known = [t for t in turns if t is not None]
    out = {"conv_id": conv, "seq": seq, "turn": first[0], "role": first[1], "digest": first[2], "codes": codes, "audit": None, "matrix": None, "cost": None}
    out |= {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF)}
    out |= {"illegal": sum(p not in LEGAL for p in zip(roles, roles[1:], strict=False)), "turns": len(set(known))}
    out |= {"first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "first_role": roles[0], "last_role": roles[-1]}
    if alone:
        costs = costs_to_go(codes, END)
        out |= {"audit": walk(codes, costs, START, True)[0], "cost": costs[0][START]}
    else:
        out["matrix"] = _matrix(codes)
    return out


def segmenter(schema: T.StructType, size: int = SEGMENT):
    """For sorted rows (ORDER, code, seq) of a partition: a row per segment. The first and the last conversation of a partition may go
    on in the next one, so these are not walked yet."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []
        now: object = None
        begun = whole = False  # a conversation is open; it began here, not at the edge of the partition or of a segment
        first, seq, codes, turns, before = (None, None, None), 0, bytearray(), [], None

        def close(alone: bool) -> None:
            if codes:
                ready.append(_segment(now, seq, first, bytes(codes), turns, alone))

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (*ORDER, "code", "seq")]
            for conv, turn, role, digest, code, place in zip(*columns, strict=True):
                if not begun or conv != now:
                    close(whole)
                    whole, begun, now, before = begun, True, conv, None
                    codes, turns = bytearray(), []
                elif len(codes) == size:
                    close(False)
                    whole, codes, turns = False, bytearray(), []
                key = (turn, role, digest)
                if not codes:
                    first, seq = key, place
                if key == before and code >> 2 != BLANK:
                    code = (code & 3) + 4 * DUPLICATE
                before = key
                codes.append(code)
                turns.append(turn)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, arrow)
                ready = []
        close(False)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, arrow)

    return run


def _chained(segments: DataFrame) -> DataFrame:
    """Segments that are not walked yet -> the same with audit and cost, and counts that hold what lies between two segments."""
    schema = segments.schema
    ends = T.StructType([*schema.fields, T.StructField("end", T.ArrayType(T.LongType())), T.StructField("last", T.BooleanType())])
    walked = T.StructType([*schema.fields, T.StructField("walks", T.ArrayType(T.StringType())), T.StructField("states", T.ArrayType(T.LongType())), T.StructField("costs", T.ArrayType(T.LongType()))])

    def streamed(each, out: T.StructType):
        shape = to_arrow_schema(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            carried = None
            for batch in batches:
                made = []
                for row in batch.to_pylist():
                    carried, new = each(row, carried if carried is not None and carried[0] == row["conv_id"] else None)
                    made.append(new)
                if made:
                    yield pa.RecordBatch.from_pylist(made, shape)

        return run

    def backward(row: dict, carried: tuple | None) -> tuple[tuple, dict]:
        end = carried[1] if carried else END
        m = row["matrix"]
        before = [min(m[4 * s + to] + end[to] for to in range(4)) for s in range(4)]
        return (row["conv_id"], before), row | {"end": end, "last": carried is None}

    def every_walk(row: dict, _: tuple | None) -> tuple[None, dict]:
        codes = row["codes"]
        costs = costs_to_go(codes, row["end"])
        found = [walk(codes, costs, s, row["last"]) for s in range(4)]
        return None, {k: row[k] for k in schema.names} | {"walks": [a for a, _ in found], "states": [s for _, s in found], "costs": [_cost(codes, a) for a, _ in found]}

    def forward(row: dict, carried: tuple | None) -> tuple[tuple, dict]:
        _, state, turn, role = carried or (None, START, None, None)
        out = {k: row[k] for k in schema.names} | {"audit": row["walks"][state], "cost": row["costs"][state]}
        if carried:
            out["illegal"] += (role, row["first_role"]) not in LEGAL
            out["turns"] -= turn is not None and turn == row["first_turn"]
        last_turn = row["last_turn"] if row["last_turn"] is not None else turn
        return (row["conv_id"], row["states"][state], last_turn, row["last_role"]), out

    back = segments.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq")).mapInArrow(streamed(backward, ends), ends)
    # apart, so that the segments of one conversation are walked in many tasks
    dealt = materialize(back).repartition("conv_id", "seq").mapInArrow(streamed(every_walk, walked), walked)
    return dealt.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(streamed(forward, schema), schema)


def repair(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """turns (conv_id, turn, role, text) -> segments of conversations in order: conv_id, seq, turn, role and digest of its first turn, audit, and
    the counts blank, duplicate, truncated, illegal, turns (distinct), first_turn, last_turn, cost.

    Turns are taken by turn (null first), ties by role and by the SHA-256 of the text. A null role or text is one space, a null conv_id
    is a conversation of its own; repeated rows are duplicates. An empty table gives no rows; further columns do not matter. A
    conversation has one segment for each SEGMENT turns, and one more where it goes over the edge of a range.
    """
    coded = _coded(_whole(turns))
    placed = coded.repartitionByRange(*[F.col(c) for c in ORDER]).sortWithinPartitions(*ORDER).withColumn("seq", F.monotonically_increasing_id())
    schema = _segments_schema(turns.schema["conv_id"].dataType)
    segments = materialize(placed.mapInArrow(segmenter(schema, size), schema))
    walked = segments.where("audit IS NOT NULL").unionByName(_chained(segments.where("audit IS NULL")))
    return walked.drop("codes", "matrix", "first_role", "last_role")


def _repaired(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """Turns and, before the first turn of each segment, its audit, in order and a conversation in one partition."""
    rows = _whole(turns).select(*ORDER, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), "text")
    plans = segments.select(*ORDER, F.lit(0).alias("kind"), "seq", F.col("audit").alias("text"))
    return rows.unionByName(plans).repartition("conv_id").sortWithinPartitions(*ORDER, "kind", "seq")


def _applied(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, str | None, str, str]]:
    """(conv_id, edit, role, text) for each turn that stays or is inserted, and (conv_id, None, "", "") behind each conversation."""
    plans: deque[str] = deque()
    at, state, now, open_ = 0, START, None, False

    def inserted() -> Iterator[tuple[object, str, str, str]]:
        nonlocal at, state
        while plans and at < len(plans[0]) and plans[0][at] == "I":
            state = next(to for to in FOLLOWS[state] if to != SYSTEM)
            at += 1
            yield now, "I", NAMES[state], ""

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "kind", "role", "text")]
        for conv, kind, role, text in zip(*columns, strict=True):
            if not open_ or conv != now:
                if open_:
                    yield from inserted()
                    yield now, None, "", ""
                plans.clear()
                at, state, now, open_ = 0, START, conv, True
            if kind == 0:
                plans.append(text)
                continue
            yield from inserted()
            if at == len(plans[0]):  # on to the next segment
                plans.popleft()
                at = 0
                yield from inserted()
            edit, at = plans[0][at], at + 1
            if edit == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                yield now, "K", role, text
            elif edit == "R":
                state = next(to for to in FOLLOWS[state] if to != SYSTEM)
                yield now, "R", NAMES[state], text
    if open_:
        yield from inserted()
        yield now, None, "", ""


#: Repaired turns that a worker holds at most.
AT_ONCE = 1000


def repaired_turns(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """The turns after repair() has told how: conv_id, place (from 0 on), role, text, edit (K, R or I)."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("place", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("role", "text", "edit")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, place = [], 0
        for conv, edit, role, text in _applied(batches):
            if edit is None:
                place = 0
                continue
            made.append({"conv_id": conv, "place": place, "role": role, "text": text, "edit": edit})
            place += 1
            if len(made) == AT_ONCE:
                yield pa.RecordBatch.from_pylist(made, arrow)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    return map_texts(_repaired(turns, segments), run, schema)


def repaired_digests(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the repaired turns, role:text, joined by newlines. The digest of a conversation is one
    sequence, so its turns pass through one task, which holds none of them."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, digest, n = [], hashlib.sha256(), 0
        for conv, edit, role, text in _applied(batches):
            if edit is not None:
                digest.update(f"{chr(10) * (n > 0)}{role}:{text}".encode())
                n += 1
                continue
            made.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
            digest, n = hashlib.sha256(), 0
            if len(made) == AT_ONCE:
                yield pa.RecordBatch.from_pylist(made, arrow)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    return map_texts(_repaired(turns, segments), run, schema)


def summary(conv_ids: DataFrame, turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """A row for each conv_id of conv_ids: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its turns.

    A conversation without turns has zeros, an empty audit and the hash of nothing; null is a conv_id like others.
    """
    segments = materialize(repair(turns, size))
    sums = segments.select("conv_id", *COUNTS, "first_turn", "last_turn", F.struct("seq", "audit").alias("part"))
    digests = repaired_digests(turns, segments)
    rows = sums.unionByName(digests, allowMissingColumns=True).unionByName(conv_ids.select("conv_id").distinct(), allowMissingColumns=True)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    gaps = F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns"), F.lit(0)).cast("long")
    # one part for each SEGMENT turns; their sum is the audit itself, a character for each edit
    audit = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["audit"]), "")
    nothing = hashlib.sha256().hexdigest()
    return rows.groupBy("conv_id").agg(gaps.alias("gaps"), *[total(c).alias(c) for c in COUNTS if c != "turns"], audit.alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))
