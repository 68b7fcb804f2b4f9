"""Operator 4: byte-level BPE by a lazily determinised transducer, and streaming decoding.

The merges define, for every prefix of a piece, one last token; a token t may follow a token s iff
merging the bytes of s + t gives (s, t) back. So the possible continuations of what was read are the
live start places, from which some token still goes on. The transducer's state holds, for each live
place, where the bytes since it stand in the tokens' trie, and the tokens up to it that are not
emitted yet. Reading a byte moves to the next state and emits the tokens that all live places share:
a place lives no longer than the longest token, which bounds the lookahead. States and moves are made when first needed and kept up to a bound, then made anew.

Decoding joins the tokens' bytes in chunks; an incremental UTF-8 machine holds back at most three
bytes of an unfinished character.

Cases: a null or empty text has no ids; lone white space, unknown scripts and very long pieces take
the same path; repeated rows are encoded each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import LATIN_DIGITS, LATIN_LETTERS, LATIN_SPACE, Memo, held, is_latin

MAX_STATES = 250_000
MAX_PIECES = 150_000
MAX_PAIRS = 500_000
LONG_PIECE = 64            # characters; longer pieces are encoded but not kept


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _packed(base: int, places: list[tuple[int, tuple | None]]) -> bytes:
    flat = array("i", (base,))
    for node, tokens in places:
        flat.append(node)
        flat.append(-1 if tokens is None else len(tokens))
        if tokens:
            flat.extend(tokens)
    return flat.tobytes()


def _unpacked(state: bytes) -> tuple[int, list[tuple[int, tuple | None]]]:
    flat, at, places = array("i", state), 1, []
    while at < len(flat):
        n = flat[at + 1]
        places.append((flat[at], tuple(flat[at + 2:at + 2 + n]) if n >= 0 else None))
        at += 2 + max(n, 0)
    return flat[0], places


class BpeTransducer:
    """Token ids (little-endian 32-bit) of a piece, byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}                 # node << 8 | byte -> node
        self.token_at: list[int] = [-1]
        for raw, t in ranks.items():
            node = 0
            for byte in raw:
                at = node << 8 | byte
                node = self.child.get(at, 0)
                if not node:
                    node = self.child[at] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = t
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.pairs: dict[int, bool] = {}                # token << 32 | token after it
        self._fresh()

    def _fresh(self) -> None:
        # A state: last emitted token and live places, a place being (trie node of the bytes since
        # it, tokens up to it that are not emitted). The last place is the present one. States are
        # kept as packed integers, about a quarter of what they take as tuples.
        self.states: dict[bytes, int] = {_packed(-1, [(0, ())]): 0}
        self.places: list[bytes] = list(self.states)
        self.moves: dict[int, int] = {}                 # state << 8 | byte -> state, ~state if it emits
        self.emits: dict[int, bytes] = {}
        self.finals: dict[int, bytes] = {}

    def _merged(self, raw: bytes) -> tuple[list[int], list[tuple[bool, bool, int]]]:
        """The merges themselves, on the few bytes of one or two tokens: the tokens, and the merges
        made, in turn, as (first part taken, last part taken, result)."""
        parts, made = [raw[i:i + 1] for i in range(len(raw))], []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            made.append((at == 0, at == len(parts) - 2, rank))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts], made

    def _edges(self, t: int) -> tuple[list, list] | None:
        """How a token's first and last part grow while its bytes are merged: lists of (bytes, born,
        taken), ranks as times; None if merging its bytes doesn't give the token."""
        if t in self.edges:
            return self.edges[t]
        raw = self.bytes_of[t]
        ids, made = self._merged(raw)
        out = None
        if ids == [t]:
            out = ([], [])
            for side, part in ((0, raw[:1]), (1, raw[-1:])):
                born = -1
                for merge in made:
                    if merge[side]:
                        out[side].append((part, born, merge[2]))
                        part, born = self.bytes_of[merge[2]], merge[2]
                out[side].append((part, born, 1 << 40))
        self.edges[t] = out
        return out

    def _may_follow(self, s: int, t: int) -> bool:
        """Whether merging the bytes of s + t leaves s and t: no part that ever ends s and part that
        begins t at the same time have a rank before one of them is taken into a larger part."""
        ok = self.pairs.get(s << 32 | t)
        if ok is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            rank, ok = self.ranks.get, True
            for a, born_a, taken_a in self._edges(s)[1]:
                for b, born_b, taken_b in self._edges(t)[0]:
                    if born_a < taken_b and born_b < taken_a:
                        r = rank(a + b)
                        if r is not None and r < taken_a and r <= taken_b:
                            ok = False
                            break
                if not ok:
                    break
            self.pairs[s << 32 | t] = ok
        return ok

    def _move(self, move: int) -> int:
        base, places = _unpacked(self.places[move >> 8])
        byte, live, here = move & 255, [], None
        for node, tokens in places:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if here is None:
                t = self.token_at[node]
                if t >= 0 and self._edges(t) is not None:
                    before = tokens[-1] if tokens else base
                    if before < 0 or self._may_follow(before, t):
                        here = tokens + (t,)
            live.append((node, tokens))
        live.append((0, here))
        first, shared = live[0][1], 0
        for shared in range(len(first) + 1):
            head = first[:shared + 1]
            if len(head) == shared or any(tokens[:shared + 1] != head for _, tokens in live):
                break
        emitted = b""
        if shared:
            emitted, base = struct.pack(f"<{shared}I", *first[:shared]), first[shared - 1]
            live = [(node, tokens[shared:]) for node, tokens in live]
        if all(tokens for _, tokens in live):
            base = -2                                   # no place asks for it any more
        key = _packed(base, live)
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= MAX_STATES:
                self._fresh()
                move = -1
            found = self.states[key] = len(self.places)
            self.places.append(key)
        if emitted:
            found = ~found
            self.emits[move] = emitted
        if move >= 0:
            self.moves[move] = found
        return found

    def encode(self, piece: bytes) -> bytes:
        one = self.ranks.get(piece)
        if one is not None:
            return struct.pack("<I", one)
        state, out, moves = 0, [], self.moves
        for byte in piece:
            move = state << 8 | byte
            state = moves.get(move)
            if state is None:
                state = self._move(move)
                if moves is not self.moves:             # made anew: the move was not kept
                    moves, move = self.moves, -1
            if state < 0:
                out.append(self.emits[move])
                state = ~state
        final = self.finals.get(state)
        if final is None:
            rest = _unpacked(self.places[state])[1][-1][1]
            final = self.finals[state] = struct.pack(f"<{len(rest)}I", *rest)
        out.append(final)
        return b"".join(out)


class Pieces(Memo):
    """Piece -> ids, by the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        super().__init__(MAX_PIECES)
        self.transducer = BpeTransducer(ranks)
        # \s by its Unicode property: the engines' own \s differ on \x1c-\x1f.
        self.any = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}")
                                 .replace(r"\s", r"\p{White_Space}"))
        # The same classes written out for texts of the first 256 code points: re is faster.
        space, letters, digits = LATIN_SPACE, LATIN_LETTERS, LATIN_DIGITS
        self.latin = re.compile(
            pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{digits}]").replace(r"\S", f"[^{space}]")
            .replace(r"\s", f"[{space}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]"))

    def compute(self, piece: str) -> bytes:
        return self.transducer.encode(piece.encode())

    def __missing__(self, piece: str) -> bytes:
        return super().__missing__(piece) if len(piece) <= LONG_PIECE else self.compute(piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = (self.latin if is_latin(text) else self.any).findall(text)
        return b"".join(map(self.__getitem__, pieces))


class Utf8Stream:
    """Text of a byte stream cut anywhere: holds back the bytes of an unfinished character."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(raw: bytes) -> int:
        """Trailing bytes that begin a character which needs more."""
        for back in range(1, min(3, len(raw)) + 1):
            b = raw[-back]
            if b & 0xC0 != 0x80:
                need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
                return back if need > back else 0
        return 0

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        cut = len(raw) - self._unfinished(raw)
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def decode_ids(ids: np.ndarray, bytes_of: dict[int, bytes], chunk: int = 4096) -> str:
    """Text of the ids, ``chunk`` tokens at a time."""
    stream, out = Utf8Stream(), []
    for at in range(0, len(ids), chunk):
        out.append(stream.feed(b"".join(map(bytes_of.__getitem__, ids[at:at + chunk].tolist()))))
    out.append(stream.close())
    return "".join(out)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ids (binary, little-endian unsigned 32-bit) and the text decoded from them."""
    schema = docs.select(F.col(id_column).alias("id"), F.lit(b"").alias("ids"), F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(("pieces", ranks_path, pattern), lambda: Pieces(read_ranks(ranks_path), pattern))
        bytes_of = pieces.transducer.bytes_of
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [pieces.encode(t) for t in some["text"].to_pylist()]
                texts = [decode_ids(np.frombuffer(x, "<u4"), bytes_of) for x in ids]
                yield pa.RecordBatch.from_arrays([some["id"], pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                                                 ["id", "ids", "decoded"])

    return docs.select(F.col(id_column).alias("id"), "text").mapInArrow(run, schema).withColumnRenamed("id", id_column)
