"""Operator 12: conversation structure repair by scalar big-integer weights.

A conversation's rows are edited so that the first letters of its roles read ``(s?(ua)+)?``: Keep a
row (0), Rerole it to user or assistant (3), Delete it (4, the only edit for a blank or repeated
row), Insert a row without text (3); a truncated row that stays costs 3 more. Among the cheapest
edits those with the ASCII-least string of initials (D, I, K, R) are made.

One integer weighs an edit sequence: the cost in the high digits, below it a fixed number of base-8
digits, one per edit letter, the first letter highest, unused ones at the end zero. So the least
integer is the cheapest sequence and, among those, the least string, and a plain minimum over the
edges of a DAG (row, role last written) decides everything; the letters are read off its digits.

Long conversations are solved in segments of SEGMENT rows, last one first. A segment's integers end
in the costs of what follows, without its letters: inserts belong to the row after them, so no string
of a segment is a prefix of another, and the first differing letter lies inside it. Integers thus
stay short, and a row costs the same in a conversation of any length.

A job makes two passes. The first sees no texts: rows that are equal are counted together, a repeated
(role, text) is found by its smallest turn, and a stream sorted by conversation and turn, one byte
kept per row, gives the edits. The second streams the texts past the edits into the repaired rows.

Cases: a null role or text is one space (so such a text is blank); a null conv_id is a conversation
of its own, with a null turn before all others; rows of one turn stand in the order of role, first
64 characters and SHA-256 of the text; equal rows stand together, and all but the first are
duplicates; roles with other first letters, or none, fit nowhere; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3      # costs; CUT_OFF: a truncated row that stays
SEGMENT = 256
_LETTERS = "\0DIKR"                                        # digit -> letter, in ASCII order
_D, _I, _K, _R = 1, 2, 3, 4
_START, _SYSTEM, _USER, _ASSISTANT = range(4)              # what was written last
_NEXT = {_START: {"s": _SYSTEM, "u": _USER}, _SYSTEM: {"u": _USER}, _USER: {"a": _ASSISTANT}, _ASSISTANT: {"u": _USER}}
_INITIALS = "sua"
_ENDS = (_START, _ASSISTANT)
_NEVER = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"


def symbol(initial: str, gone: bool, truncated: bool) -> int:
    """One byte of a row: 0 if it must go, else its initial (1 to 4) and 4 more if it is truncated."""
    return 0 if gone else 1 + "sua".find(initial) % 4 + 4 * truncated if initial else 4 + 4 * truncated


@functools.lru_cache(maxsize=1 << 14)
def solve(rows: bytes, after: tuple[int, ...] | None) -> tuple[tuple[int, str, int], ...]:
    """For each state before ``rows``: cost, edit letters, state after. ``after``: cost of what follows
    from each state, None at the end of the conversation, where inserts may follow."""
    digits = 3 * len(rows) + 2
    width = 3 * digits
    low = (1 << width) - 1

    def put(letter: int, cost: int, rest: int) -> int:
        """The weight of an edit before those that ``rest`` weighs."""
        return ((rest >> width) + cost << width) | letter << width - 3 | (rest & low) >> 3

    def with_inserts(least: list[int]) -> list[int]:
        """Before them up to two rows are inserted; more never pay, as two in a row undo each other."""
        for _ in range(2):
            least = [min(least[q], *(put(_I, INSERT, least[t]) for r, t in _NEXT[q].items() if r != "s")) for q in range(4)]
        return least

    if after is None:
        best = with_inserts([0 if q in _ENDS else _NEVER << width for q in range(4)])
    else:
        best = [cost << width for cost in after]
    for code in reversed(rows):
        own, late = (code - 1) % 4, CUT_OFF * (code > 4)
        here = []
        for q in range(4):
            ways = [put(_D, DELETE, best[q])]
            if code:
                ways += [put(_R, REROLE + late, best[t]) for r, t in _NEXT[q].items() if r != "s"]
                if own < 3 and _INITIALS[own] in _NEXT[q]:
                    ways.append(put(_K, KEEP + late, best[_NEXT[q][_INITIALS[own]]]))
            here.append(min(ways))
        best = with_inserts(here)
    out = []
    for q in range(4):
        letters = "".join(_LETTERS[best[q] >> 3 * i & 7] for i in range(digits - 1, -1, -1)).rstrip("\0")
        out.append((best[q] >> width, letters, _after(q, letters, rows)))
    return tuple(out)


def _after(state: int, letters: str, rows: bytes) -> int:
    """The state that edits lead to; a re-roled or inserted row is the user or assistant that fits."""
    at = 0
    for letter in letters:
        if letter == "K":
            state = _NEXT[state].get(_INITIALS[(rows[at] - 1) % 4], state)
        elif letter != "D":
            state = next(t for r, t in _NEXT[state].items() if r != "s")
        at += letter != "I"
    return state


def repair(rows: bytes, segment: int = SEGMENT) -> tuple[int, str]:
    """Least cost and edit letters of a conversation, one byte (:func:`symbol`) per row."""
    cuts = list(range(0, len(rows), segment)) or [0]
    after, solved = None, []
    for at in reversed(cuts):
        solved.append(solve(rows[at:at + segment], after))
        after = tuple(s[0] for s in solved[-1])
    state, letters = _START, []
    for found in reversed(solved):
        letters.append(found[state][1])
        state = found[state][2]
    return after[_START], "".join(letters)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the faults of a test: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0),
    loses its text (1) or its sentence ends (2), is repeated (3: ``copies`` is 2) or becomes a user's (4)."""
    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    return rows.where(fault != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"))


def _placed(rows: DataFrame) -> DataFrame:
    """With the columns that order the rows of a turn."""
    return rows.select("*", F.left("text", F.lit(64)).alias("head"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"))


_ORDER = ["conv_id", "turn", "role", "head", "hash"]         # ascending: nulls first
FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def find_edits(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, copies): counts of its faults, the
    least cost and the edits as ``audit``."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    tiny = (_placed(rows).withColumns({"initial": F.substring("role", 1, 1), "blank": bare == "", "last": F.right(bare, F.lit(1))})
            .groupBy("conv_id", "turn", "role", "head", "hash")
            .agg(F.sum("copies").alias("copies"), F.first("initial").alias("initial"), F.first("blank").alias("blank"),
                 F.first(~F.col("last").isin(".", "!", "?")).alias("truncated")))
    firsts = tiny.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h")).agg(
        F.min(F.struct(F.coalesce("turn", F.lit(-1 << 63)).alias("at"), F.col("turn").isNotNull().alias("known"))).alias("first"))
    same = (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h"))
    early = F.when(F.col("turn").isNull(), F.lit(False)).otherwise(
        (F.col("first.at") != F.col("turn")) | ~F.col("first.known"))
    seen = tiny.join(firsts, same).withColumn("seen", early)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: tuple | None = None
        counts, codes = [0] * 4, bytearray()
        low = high = turns = before = None
        done: list[tuple] = []

        def close() -> None:
            cost, audit = repair(bytes(codes), segment)
            done.append((conv[0], 0 if low is None else high - low + 1 - turns, *counts, cost, audit))

        def flush() -> pa.RecordBatch:
            names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
            out = {c: pa.array([d[i] for d in done], pa.int64()) for i, c in enumerate(names)}
            out["audit"] = pa.array([d[7] for d in done], pa.string())
            done.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "copies", "blank", "truncated", "seen"))
            for c, turn, initial, n, blank, truncated, repeated in zip(*columns):
                if conv != (c,):
                    if conv:
                        close()
                    conv, counts, codes = (c,), [0] * 4, bytearray()
                    low = high = turns = before = None
                if turn is not None and turn != high:
                    low, high, turns = (turn, turn, 1) if low is None else (low, turn, turns + 1)
                others = n - 1
                kinds = 0 if blank else 1 if repeated else 2 if truncated else 3
                if kinds == 0:
                    counts[0] += n
                else:
                    counts[1] += others + (kinds == 1)
                    counts[2] += kinds == 2
                codes.append(symbol(initial, kinds < 2, kinds == 2))
                codes.extend(bytes(others))
                counts[3] += (before is not None and before + initial not in ("su", "ua", "au")) + others
                before = initial
            if len(done) >= 4096:
                yield flush()
        if conv:
            close()
        if done:
            yield flush()

    return (seen.repartition("conv_id").sortWithinPartitions(*_ORDER)
            .select("conv_id", "turn", "initial", "copies", "blank", "truncated", "seen").mapInArrow(run, FOUND))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, str | None, str | None]]:
    """From conversations in order, the head row (kind 0) before the rows it is for: (head, None, None)
    where one starts, then (None, role, text) of one repaired row after another."""
    audit, at, state = "", 0, _START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = _ASSISTANT if state == _USER else _USER
            at += 1
            yield None, "user" if state == _USER else "assistant", ""

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                yield from inserted()
                yield row["found"], None, None
                audit, at, state = row["found"]["audit"], 0, _START
                continue
            for _ in range(row["copies"]):
                yield from inserted()
                letter, role = audit[at], row["role"]
                at += 1
                if letter == "D":
                    continue
                if letter == "R":
                    state = _ASSISTANT if state == _USER else _USER
                    role = "user" if state == _USER else "assistant"
                else:
                    state = _NEXT[state][role[0]]
                yield None, role, row["text"]
    yield from inserted()


def _in_order(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The heads and the rows they are for, in the order of :func:`find_edits`."""
    texts = _placed(rows).withColumn("kind", F.lit(1))
    first = heads.select("conv_id", F.lit(0).alias("kind"), F.struct(*heads.columns).alias("found"))
    return (texts.unionByName(first, allowMissingColumns=True).repartition("conv_id")
            .sortWithinPartitions(_ORDER[0], "kind", *_ORDER[1:]).select("kind", "role", "text", "copies", "found"))


def heads_of(every: DataFrame, edits: DataFrame) -> DataFrame:
    """The found faults and edits of every conv_id of ``every``, zeros where no row is left."""
    ids = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = edits.withColumnRenamed("conv_id", "c")
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"))


def repaired_rows(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text of the repaired conversations."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out = None, 0, []
        for head, role, text in _edited(batches):
            if head is not None:
                conv, place = head["conv_id"], 0
                continue
            out.append({"conv_id": conv, "place": place, "role": role, "text": text})
            place += 1
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _in_order(rows, heads).mapInArrow(run, "conv_id long, place long, role string, text string")


def repair_conversations(rows: DataFrame, every: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Faults, edits and digest (SHA-256 of the repaired ``role:text`` rows joined by line feeds) of
    every conv_id of ``every``, also of those without a row in ``rows`` (conv_id, turn, role, text,
    copies). SHA-256 reads its input in order, so a conversation is one stream here; what is kept of
    it is the digest's state and the audit."""
    schema = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                       + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, now_head, between, out = hashlib.sha256(), None, b"", []
        for head, role, text in _edited(batches):
            if head is None:
                now.update(between)
                now.update(f"{role}:{text}".encode())
                between = b"\n"
                continue
            if now_head is not None:
                out.append({**now_head, "repaired_sha256": now.hexdigest()})
            now, now_head, between = hashlib.sha256(), head, b""
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now_head is not None:
            out.append({**now_head, "repaired_sha256": now.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _in_order(rows, heads_of(every, find_edits(rows, segment))).mapInArrow(run, f"{FOUND}, repaired_sha256 string")
