"""Operator 5: removal of repeated passages, found by a count-min prefilter and grouped exactly.

A window is 13 consecutive words of one document. Pass one estimates window counts by sharded
count-min sketches (window_counts). Pass two sends only windows estimated to occur more than once,
each once per block, with the smallest doc_id that has it there, to a bucket of its 96-bit
fingerprint; the bucket finds the smallest doc_id of all and tells every other block. A word goes if
a window covering it also starts in a document with a smaller doc_id.

A window that a third of all documents share is one row per block, never one per document.

Cases: a null or empty text has no words; documents of fewer than 13 words keep all; rows with a
null doc_id have no order, so they neither lose words nor cost others any; equal doc_ids are not
smaller than each other, so repeated rows keep what the first keeps; an empty table gives an empty
result; other columns are carried where asked for and never clash.
"""

from __future__ import annotations

import functools
import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import Hasher, expand, release, slices, split_words, squeeze, text_bytes, window_starts
from wardlight.llm.window_counts import Layout, estimated_orders, merged_orders, partial_sketches, text_blocks

WINDOW = 13
BUCKET_BYTES = 32 << 20    # text volume per bucket of the exact grouping
_FIRST, _SECOND = 11, 12   # seeds
_WITH_SPACE = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


@functools.lru_cache(maxsize=4)
def _hasher(seed: int) -> Hasher:
    return Hasher(seed)


def _windows(table: pa.Table, width: int, seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the rows with a doc_id: window hashes per seed, each window's first word (in the block),
    and its row; and per row the word count."""
    buf, offs = text_bytes(table["text"])
    known = np.array([d is not None for d in table["doc_id"].to_pylist()], bool)
    hashes: list[list[np.ndarray]] = [[] for _ in seeds]
    firsts, rows, sizes, words = [], [], [], 0
    for i, j in slices(offs):
        part, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        starts, ends, counts = split_words(part, o)
        at, row = window_starts(counts, width)
        use = known[row + i]
        at, row = at[use], row[use]
        for out, seed in zip(hashes, seeds):
            h = _hasher(seed)
            out.append(h.windows(h.words(part, starts, ends, False), width)[at])
        firsts.append(at + words)
        rows.append(row + i)
        sizes.append(counts)
        words += len(starts)
    joined = [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hashes]
    z = np.zeros(0, np.int64)
    return joined, np.concatenate([z, *firsts]), np.concatenate([z, *rows]), np.concatenate([z, *sizes])


def _doc_ids(table: pa.Table) -> np.ndarray:
    return np.array([d or 0 for d in table["doc_id"].to_pylist()], np.int64)


def _suspects(blocks: DataFrame, marks: DataFrame, layout: Layout, width: int, buckets: int) -> DataFrame:
    """Windows estimated to be repeated, once per block: fingerprint and smallest doc_id there."""

    def run(table: pa.Table, got: pa.Table) -> pa.Table:
        release()
        out: dict[str, list] = {"bucket": [], "block": [], "first": [], "second": [], "doc": []}
        if table.num_rows and got.num_rows:
            (a, b), _, row, _ = _windows(table, width, (_FIRST, _SECOND))
            often = estimated_orders(a, layout, got) > 0
            a, b, doc = a[often], b[often].astype(np.uint32), _doc_ids(table)[row[often]]
            bucket = (b % np.uint32(buckets)).astype(np.int64)
            order = np.lexsort((doc, b, a, bucket))
            a, b, doc, bucket = a[order], b[order], doc[order], bucket[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, doc, bucket = a[new], b[new], doc[new], bucket[new]
            ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
            for i, j in zip(np.concatenate([[0], ends[:-1]]).tolist() if len(ends) else [], ends.tolist()):
                out["bucket"].append(int(bucket[i]))
                out["block"].append(table["block"][0].as_py())
                out["first"].append(a[i:j].tobytes())
                out["second"].append(b[i:j].tobytes())
                out["doc"].append(squeeze(doc[i:j]))
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("first", pa.binary()),
                                               ("second", pa.binary()), ("doc", pa.binary())]))

    return (blocks.groupBy("block").cogroup(marks.groupBy("block"))
            .applyInArrow(run, "bucket int, block int, first binary, second binary, doc binary"))


def _repeats(suspects: DataFrame) -> DataFrame:
    """Per block, the windows (first hash, sorted) whose smallest doc_id of all is below the block's."""

    def run(table: pa.Table) -> pa.Table:
        release()
        firsts = [np.frombuffer(x, np.uint64) for x in table["first"].to_pylist()]
        a = np.concatenate(firsts)
        b = np.concatenate([np.frombuffer(x, np.uint32) for x in table["second"].to_pylist()])
        doc = np.concatenate([expand(x, np.int64) for x in table["doc"].to_pylist()])
        part = np.repeat(np.arange(len(firsts)), [len(f) for f in firsts])
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        later = np.empty(len(a), bool)
        later[order] = doc[order] > least[group]
        blocks = table["block"].to_pylist()
        out = [(blocks[p], f[m].tobytes()) for p, (f, m) in
               enumerate(zip(firsts, np.split(later, np.cumsum([len(f) for f in firsts])[:-1]))) if m.any()]
        return pa.table({"block": pa.array([o[0] for o in out], pa.int32()), "gone": pa.array([o[1] for o in out], pa.binary())})

    return suspects.groupBy("bucket").applyInArrow(run, "block int, gone binary")


def _kept(blocks: DataFrame, repeats: DataFrame, width: int, layout: bool) -> DataFrame:
    schema = blocks.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
                           F.lit(None).cast("string").alias("kept"), "carried").schema

    def run(table: pa.Table, got: pa.Table) -> pa.Table:
        release()
        (a,), first, row, counts = _windows(table, width, (_FIRST,))
        gone = np.zeros(len(a), bool)
        lists = [np.frombuffer(x, np.uint64) for x in got["gone"].to_pylist()]
        if lists:
            known = np.sort(np.concatenate(lists))
            gone = known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a
        # Repeats inside the block: all but those of the smallest doc_id.
        doc = _doc_ids(table)[row]
        order = np.argsort(a, kind="stable")
        new = np.ones(len(a), bool)
        new[1:] = a[order][1:] != a[order][:-1]
        if not new.all():
            least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
            gone[order] |= doc[order] > least[np.cumsum(new) - 1]
        edge = np.zeros(int(counts.sum()) + 1, np.int64)
        np.add.at(edge, first[gone], 1)
        np.subtract.at(edge, first[gone] + width, 1)
        lost = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(counts)
        texts, removed = [], []
        for text, n, end in zip(table["text"].cast(pa.large_binary()).to_pylist(), counts.tolist(), ends.tolist()):
            out = lost[end - n:end]
            removed.append(int(out.sum()))
            if layout:
                texts.append(b"".join(compress(_WITH_SPACE.findall(text), (~out).tolist())) if removed[-1] else text)
            else:
                words = text.split() if text else []
                texts.append(b" ".join(compress(words, (~out).tolist()) if removed[-1] else words))
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(counts, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()),
                         "kept": pa.array(texts, pa.binary()).cast(pa.string()), "carried": table["carried"]})

    return blocks.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, width: int = WINDOW, carried: list[str] | None = None,
                   layout: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and the struct
    ``carried`` of the named columns. With ``layout``, the words that stay keep the white space
    before them, and a text that loses none is returned as it is.

    One job: the exchange of the texts by block is made once and read by all three passes.
    """
    blocks, plan = text_blocks(docs, carried or [])
    marks = merged_orders(partial_sketches(blocks, plan, lambda t: _windows(t, width, (_FIRST,))[0][0]))
    buckets = max(1, plan.blocks * 8 // (BUCKET_BYTES >> 20))
    return _kept(blocks, _repeats(_suspects(blocks, marks, plan, width, buckets)), width, layout)
