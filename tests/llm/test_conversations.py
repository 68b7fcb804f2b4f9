"""Conversation structure repair (op 12)."""

import functools
import hashlib
import itertools
import random
import re
import zlib

from wardlight.llm import conversation_repair as cr
from wardlight.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, kind long, audit string, copies long, found string"
LEGAL = re.compile("(s?(ua)+)?")


def every_edit(rows):
    """Brute force: least (cost, letters) over all edit strings of ``rows`` (initial, gone, truncated);
    inserted and re-roled rows take either role."""
    best = None
    ways = []
    for initial, gone, late in rows:
        own = [("D", "", 4)]
        if not gone:
            own += [("K", initial or "?", 3 * late)] + [("R", r, 3 + 3 * late) for r in "ua"]
        ways.append(own)
    gap = [("", "", 0), ("I", "u", 3), ("I", "a", 3)] + [("II", r, 6) for r in ("ua", "au")]
    for picks in itertools.product(*[itertools.product(gap, w) for w in ways], gap):
        parts = [p for pick in picks[:-1] for p in pick] + [picks[-1]]
        if LEGAL.fullmatch("".join(p[1] for p in parts)):
            found = sum(p[2] for p in parts), "".join(p[0] for p in parts)
            best = found if best is None else min(best, found)
    return best


def plain_dp(rows):
    """The same by a forward search over (row, state) with (cost, letters) pairs."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @functools.cache
    def least(i, q, inserts):
        found = []
        if i == len(rows):
            if q in (0, 3):
                found.append((0, ""))
        else:
            initial, gone, late = rows[i]
            moves = [("D", 4, q)]
            if not gone:
                moves += [("K", 3 * late, after[q][initial])] if initial in after[q] else []
                moves += [("R", 3 + 3 * late, t) for r, t in after[q].items() if r != "s"]
            for letter, cost, t in moves:
                c, s = least(i + 1, t, 0)
                found.append((c + cost, letter + s))
        if inserts < 2:
            for r, t in after[q].items():
                if r != "s":
                    c, s = least(i, t, inserts + 1)
                    found.append((c + 3, "I" + s))
        return min(found, default=(10 ** 9, ""))

    return least(0, 0, 0)


def test_weights_equal_brute_force():
    rnd = random.Random(1)
    rows = [tuple((rnd.choice("suax") if rnd.random() < 0.95 else "", rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(0, 4)))
            for _ in range(60)]
    for r in rows:
        assert cr.repair(bytes(cr.symbol(*x) for x in r)) == every_edit(r) == plain_dp(r)


def test_segments_change_nothing():
    rnd = random.Random(2)
    for _ in range(300):
        r = tuple((rnd.choice("suaux"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(0, 40)))
        codes = bytes(cr.symbol(*x) for x in r)
        assert plain_dp(r) == cr.repair(codes) == cr.repair(codes, 1) == cr.repair(codes, 7)
    codes = bytes(rnd.choices(range(9), k=20_000))
    assert cr.repair(codes, 64) == cr.repair(codes, 300)


def expected(rows):
    """The contract, plainly, over (conv_id, turn, role, text) rows."""
    out, convs = {}, {}
    for c, t, role, text, *_ in rows:
        convs.setdefault(c, [])
        c_text, t_text = (" " if v is None else str(v) for v in (c, t))
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{c_text}:{t_text}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        convs[c] += [(t, role, text)] * (2 if fault == 3 else 1)
    for c, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, kinds = set(), []
        for t, role, text in found:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            kinds.append("blank" if not letters else "duplicate" if (role, text) in seen
                         else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in found if t is not None]
        pairs = [x[1][:1] + y[1][:1] for x, y in zip(found, found[1:])]
        cost, audit = plain_dp(tuple((r[1][:1], k in ("blank", "duplicate"), k == "truncated") for r, k in zip(found, kinds)))
        lines, at, state = [], 0, "a"
        for letter in audit:
            if letter in "IR":
                state = "a" if state == "u" else "u"
                lines.append(("user:" if state == "u" else "assistant:") + (found[at][2] if letter == "R" else ""))
            elif letter == "K":
                state = found[at][1][0]
                lines.append(f"{found[at][1]}:{found[at][2]}")
            at += letter != "I"
        out[c] = {"conv_id": c, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                  **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
                  "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
                  "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def edge_rows():
    rnd = random.Random(4)
    rows = []
    for c in [*range(40), None]:
        for t in [None] * (c is None or c % 9 == 0) + list(range(rnd.randint(1, 9))):
            role = rnd.choice(["user", "assistant", "system", "tool", "", None, "usher", "Über:x"])
            text = rnd.choice(["Yes. ", "no", "What?\n", None, "", " \t\x0b", "Long " * 40 + "end!", "x:y", "É.", f"turn {t}."])
            rows += [(c, t, role, text)] * rnd.choice([1, 1, 1, 3])
    rows += [(7, 3, "user", "tie b."), (7, 3, "user", "tie a."), (50, -5, "user", "far."), (50, 90, "assistant", "x. " * 40_000)]
    rows += [(51, t, "user", "again.") for t in range(700)]
    return [(*r, 1, "x", 2, "y") for r in rows]


def test_repair_equals_plain_contract(spark):
    rows = edge_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = cr.repair_conversations(cr.damaged(frame), frame, segment=16).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for g in got:
        assert g.asDict() == want[g["conv_id"]]


def test_repaired_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "tool", "cut off"), (1, 3, "user", " ")]
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).drop("copies")
    whole = frame.selectExpr("conv_id", "turn", "role", "text", "1 AS copies")
    heads = cr.heads_of(frame, cr.find_edits(whole))
    assert heads.first()["audit"] == plain_dp((("u", False, False), ("u", False, False), ("t", False, True), ("u", True, False)))[1]
    got = [(r["place"], r["role"], r["text"]) for r in cr.repaired_rows(whole, heads).orderBy("place").collect()]
    assert LEGAL.fullmatch("".join(r[1][0] for r in got)) and got[0] == (0, "user", "Hi.")
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair_conversations(cr.damaged(none), none).count() == 0


def test_query_on_small_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    got = QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want) and all(g.asDict() == want[g["conv_id"]] for g in got)
