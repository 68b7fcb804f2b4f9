"""Count-min sketches of word windows, kept in shards.

Documents are dealt into blocks. A block hashes its windows once per sketch row into (shard, cell)
and sends each shard its partial sketch: the sorted cells it touches and their counts. A shard adds
the partial sketches and sends each block the totals of that block's cells, as binary orders of
magnitude. A window's count is estimated by the least of its rows, which is never too small, so a
window estimated to occur once occurs once. No sketch is broadcast and no task holds one whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import expand, mix64, release, squeeze

ROWS = 2
BLOCK_BYTES = 8 << 20      # text of a block
_WORD_BYTES = 6            # only sets how full the sketch gets
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
MESSAGES = "shard int, row int, block int, cells binary, counts binary"
MARKS = "block int, row int, shard int, orders binary"


class Layout:
    """Blocks, shards and cells for a text volume: about 2^20 windows in a shard, and beyond 4096
    shards up to 2^25, so that blocks times shards stays in bounds; 16 cells a window."""

    def __init__(self, total_bytes: int, block_bytes: int = BLOCK_BYTES):
        windows = max(1, total_bytes // _WORD_BYTES)
        self.blocks = max(1, -(-total_bytes // block_bytes))
        self.shards = max(1, min(-(-windows >> 20), 4096), -(-windows >> 25))
        self.bits = min(32, max(16, (16 * windows // self.shards).bit_length()))

    def keys(self, windows: np.ndarray, row: int) -> np.ndarray:
        """shard << 32 | cell of each window hash."""
        h = mix64(windows ^ np.uint64(_SEEDS[row]))
        cell = h & np.uint64((1 << self.bits) - 1)
        return (h >> np.uint64(33)) % np.uint64(self.shards) << np.uint64(32) | cell


def text_blocks(docs: DataFrame, carried: list[str], block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Layout]:
    """doc_id, text, the ``carried`` columns as one struct, and the row's block, by a hash of id and
    text; a block has about ``block_bytes`` of text, or one longer text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout(total, block_bytes)
    extra = F.struct(*carried) if carried else F.struct(F.lit(0).alias("none"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", extra.alias("carried"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(layout.blocks)).cast("int").alias("block")), layout


def partial_sketches(blocks: DataFrame, layout: Layout, windows_of: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """The messages of every block; ``windows_of`` gives a block's window hashes."""

    def run(table: pa.Table) -> pa.Table:
        release()
        windows, block = windows_of(table), table["block"][0].as_py()
        out: dict[str, list] = {"shard": [], "row": [], "block": [], "cells": [], "counts": []}
        for row in range(ROWS):
            keys, counts = np.unique(layout.keys(windows, row), return_counts=True)
            shard = (keys >> np.uint64(32)).astype(np.int64)
            cells = keys.astype(np.uint32)
            counts = np.minimum(counts, 255).astype(np.uint8)
            ends = np.flatnonzero(np.diff(shard, append=-1)) + 1
            for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist() if len(ends) else [], ends.tolist()):
                out["shard"].append(int(shard[a]))
                out["row"].append(row)
                out["block"].append(block)
                out["cells"].append(squeeze(np.diff(cells[a:b], prepend=np.uint32(0))))
                out["counts"].append(squeeze(counts[a:b]))
        return pa.table(out, schema=pa.schema([("shard", pa.int32()), ("row", pa.int32()), ("block", pa.int32()),
                                               ("cells", pa.binary()), ("counts", pa.binary())]))

    return blocks.groupBy("block").applyInArrow(run, MESSAGES)


def merged_orders(messages: DataFrame) -> DataFrame:
    """Per message, the order of magnitude (0: one, 1: two or three, ...) of its cells' totals."""

    def run(table: pa.Table) -> pa.Table:
        release()
        cells = [np.cumsum(expand(c, np.uint32), dtype=np.uint32) for c in table["cells"].to_pylist()]
        counts = [expand(c, np.uint8) for c in table["counts"].to_pylist()]
        every = np.concatenate(cells)
        by_cell = np.argsort(every)
        new = np.diff(every[by_cell], prepend=every[by_cell[0]] + np.uint32(1)) != 0
        group = np.cumsum(new) - 1
        total = np.bincount(group, np.concatenate(counts)[by_cell])
        orders = np.empty(len(every), np.uint8)
        orders[by_cell] = np.log2(total).astype(np.uint8)[group]
        parts = np.split(orders, np.cumsum([len(c) for c in cells])[:-1])
        return pa.table({"block": table["block"], "row": table["row"], "shard": table["shard"],
                         "orders": pa.array([squeeze(p) for p in parts], pa.binary())})

    return messages.groupBy("shard", "row").applyInArrow(run, MARKS)


def estimated_orders(windows: np.ndarray, layout: Layout, marks: pa.Table) -> np.ndarray:
    """Per window of a block, the estimated order of magnitude of its count, from the block's marks."""
    out = np.full(len(windows), 255, np.uint8)
    if not len(windows):
        return out
    rows, shards, orders = (marks[c].to_pylist() for c in ("row", "shard", "orders"))
    at = sorted(range(len(rows)), key=lambda i: (rows[i], shards[i]))
    for row in range(ROWS):
        _, place = np.unique(layout.keys(windows, row), return_inverse=True)
        got = np.concatenate([expand(orders[i], np.uint8) for i in at if rows[i] == row])
        np.minimum(out, got[place], out=out)
    return out
