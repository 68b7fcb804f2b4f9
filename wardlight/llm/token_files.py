"""Operator 1: token ids as directly addressable codes.

Ids are cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one;
a bitmap per level marks the ids that go on, and a rank directory (ones before every 512th bit)
finds an id's place in the next level. So any token is read in a few array accesses, and nothing
before it is decoded.

A token file is a table of segments (Parquet, one binary blob per row: a Spark job can write and
read it in any store). Documents stand in ascending doc_id order, null ids first; rows with one
doc_id are ordered by a hash of their text. Cases: a null or empty text is encoded as the end id alone; repeated
rows are kept as they are; an empty table makes no segment; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import LATIN_DIGITS, LATIN_LETTERS, LATIN_SPACE, Memo, held, is_latin, spread_partitions
from wardlight.session import scratch_path

END_ID = 1
CACHE_PIECES = 400_000
SEGMENT_TOKENS = 1_000_000
_MAGIC = b"DAC1"
_BLOCK = 64                # bytes of bitmap per rank entry
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint32)


class PretokenIds(Memo):
    """Pre-token -> little-endian 32-bit ids, by the tokenizer's own merges."""

    def __init__(self, model, size: int):
        super().__init__(size)
        self.model = model
        # Byte-level pre-tokenizers write every byte as one printable character: printable Latin
        # bytes as themselves, the others from code point 256 on, in order.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        sign = [chr(b if b in plain else next(others)) for b in range(256)]
        self.signs = {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}

    def compute(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.translate(self.signs))]
        return struct.pack(f"<{len(ids)}I", *ids)


class TextEncoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A text of the first 256 code points without the start of a special token is lower-cased and cut
    into pre-tokens here (its normal form is itself, and pre-tokens are encoded one by one), so each
    pre-token goes through the tokenizer's merges about once in a worker. Any other text, and all
    texts of a tokenizer with other steps than these, go through the tokenizer whole.
    """

    # Fixed value: the pre-token pattern the quick path stands for.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        normal = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])]
        cuts = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.quick = (normal == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2
                      and cuts[0].get("pattern", {}).get("Regex") == self.PATTERN and cuts[0].get("invert")
                      and cuts[1].get("type") == "ByteLevel" and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"])
        self.special = [t["content"] for t in steps["added_tokens"]]
        self.ids = PretokenIds(self.tokenizer.model, CACHE_PIECES)
        self.cut = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_DIGITS}]|[^{LATIN_SPACE}{LATIN_LETTERS}{LATIN_DIGITS}]+")

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.quick and is_latin(text) and not any(s in text for s in self.special):
            return b"".join(map(self.ids.__getitem__, self.cut.findall(text.lower())))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def pack_codes(ids: np.ndarray) -> bytes:
    """The levels of ``ids``: count, level count, then per level its chunks, bitmap and ranks."""
    parts, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = -(-len(bits) // _BLOCK)
        ones = np.zeros(blocks * _BLOCK, np.uint32)
        ones[:len(bits)] = _ONES[bits]
        per = ones.reshape(blocks, _BLOCK).sum(1)
        parts.append((rest.astype(np.uint8).tobytes(), bits.tobytes(),
                      (np.cumsum(per) - per).astype("<u4").tobytes()))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    head = struct.pack("<QB", len(ids), len(parts))
    return head + b"".join(struct.pack("<QQQ", *map(len, p)) + b"".join(p) for p in parts)


class Codes:
    """Random access to what :func:`pack_codes` wrote."""

    def __init__(self, blob: bytes | memoryview):
        self.n, levels = struct.unpack_from("<QB", blob)
        at, self.levels = 9, []
        for _ in range(levels):
            sizes = struct.unpack_from("<QQQ", blob, at)
            at += 24
            arrays = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
                arrays.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(arrays)

    def get(self, places: np.ndarray) -> np.ndarray:
        """Ids at any places, in any order."""
        at = np.asarray(places, np.int64)
        out, owner = np.zeros(len(at), np.uint32), None
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value = chunks[at].astype(np.uint32) << np.uint32(8 * k)
            if owner is None:
                out += value
            else:
                out[owner] += value
            byte = bits[at >> 3]
            more = (byte >> (at & 7).astype(np.uint8)) & 1 > 0
            if not more.any():
                break
            owner = np.flatnonzero(more) if owner is None else owner[more]
            at = self._rank(bits, ranks, at[more])
        return out

    def all(self) -> np.ndarray:
        """All ids in order: every level's chunks are added at the places that the bitmaps mark."""
        out = np.zeros(self.n, np.uint32)
        owner = None
        for k, (chunks, bits, _) in enumerate(self.levels):
            if owner is None:
                out += chunks
            else:
                out[owner] += chunks.astype(np.uint32) << np.uint32(8 * k)
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            owner = more if owner is None else owner[more]
        return out

    def _rank(self, bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before each place: the directory's count plus those since its block's start."""
        byte = at >> 3
        block = byte // _BLOCK
        lo, hi = int(block.min()) * _BLOCK, int(byte.max())
        run = np.cumsum(_ONES[bits[lo:hi + 1]], dtype=np.int64)
        before = np.where(byte > lo, run[byte - lo - 1], 0) - np.where(block * _BLOCK > lo, run[block * _BLOCK - lo - 1], 0)
        low = bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return ranks[block].astype(np.int64) + before + _ONES[low]


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One segment: magic, crc32 of the body, document count, ids, validity, lengths, codes."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    body = (struct.pack("<Q", len(doc_ids)) + docs.tobytes() + known.tobytes()
            + np.array(lengths, "<u8").tobytes() + pack_codes(ids))
    return _MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def open_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Document ids, the n + 1 token offsets of the documents, and the codes."""
    view = memoryview(blob)
    if bytes(view[:4]) != _MAGIC or zlib.crc32(view[8:]) != struct.unpack_from("<I", blob, 4)[0]:
        raise ValueError("not a token segment, or a damaged one")
    n = struct.unpack_from("<Q", blob, 8)[0]
    docs, known = np.frombuffer(blob, "<i8", n, 16), np.frombuffer(blob, np.uint8, n, 16 + 8 * n)
    ends = np.cumsum(np.frombuffer(blob, "<u8", n, 16 + 9 * n).astype(np.int64))
    ids = [d if k else None for d, k in zip(docs.tolist(), known.tolist())]
    return ids, np.concatenate([[0], ends]), Codes(view[16 + 17 * n:])


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write the segments to ``path`` in doc_id order.

    Rows are range-partitioned by doc_id, text hash and place in the input, so one id or one repeated
    row on a third of the table is split too; a task holds one Arrow batch of texts and one segment
    of ids.
    """
    schema = "part int, seq int, first long, n_tokens long, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = held(("words", tokenizer_path), lambda: TextEncoder(tokenizer_path)), TaskContext.get().partitionId()
        seq = first = waiting = 0
        doc_ids: list[int | None] = []
        found: list[bytes] = []
        end = struct.pack("<I", end_id)

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(found), "<u4")
            blob = pack_segment(doc_ids, [len(f) // 4 for f in found], ids)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                 "first": [first], "n_tokens": [waiting], "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for d, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist()):
                    ids = encoder.encode(text)
                    doc_ids.append(d)
                    found.append(ids + end)
                    waiting += len(ids) // 4 + 1
                if waiting >= SEGMENT_TOKENS:
                    yield segment()
                    seq, first, waiting, doc_ids, found = seq + 1, first + waiting, 0, [], []
        if doc_ids:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"),
                       F.monotonically_increasing_id().alias("place"))
    (rows.repartitionByRange(spread_partitions(docs), "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "place")
     .select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(path))


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32.

    A part's first token needs the totals of the parts before it: one long per range partition,
    which the driver adds up.
    """
    spark = segments.sparkSession
    totals = sorted(segments.groupBy("part").agg(F.sum("n_tokens")).collect())
    base, rows = 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, offs, codes = open_segment(row["blob"])
                ids = codes.all().astype("<u4", copy=False)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(doc_ids, pa.int64()), "start": offs[:-1] + row["base"] + row["first"],
                     "n_tokens": np.diff(offs), "ids_crc32": pa.array(crc, pa.int64())})

    return (segments.join(F.broadcast(bases), "part").select("base", "first", "blob")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_file_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token file of ``docs`` to the shared folder, read it back, digest each document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, tokenizer_path, path)
    return read_documents(spark.read.parquet(path))
